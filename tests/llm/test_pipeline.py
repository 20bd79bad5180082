import corpus_pipeline as p
from quillgraph.llm import decontaminate, pii, quality, segmentations, simhash
from quillgraph.session import stage


def test_stages_act_on_what_is_left(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    model = quality.fit_documents(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs, model).where("score >= 0.5").collect()}
    one = stage(p.quality(spark, docs, sf))
    assert {r.doc_id for r in one.select("doc_id").collect()} == good and one.columns == columns

    classes = {r.doc_id: r.component for r in simhash.near_duplicate_classes(one, **p.NEAR).collect()}
    two = stage(p.near_duplicates(spark, one, sf))
    kept = [r.doc_id for r in two.select("doc_id").collect()]
    assert sorted(kept) == sorted(set(classes.values())) and two.columns == columns and len(kept) < len(good)

    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    dirty = {r.doc_id for r in decontaminate.find_benchmark_passages(two, bench).where("size(matches) > 0").collect()}
    three = stage(p.decontamination(spark, two, sf))
    assert {r.doc_id for r in three.select("doc_id").collect()} == set(kept) - dirty and dirty and three.columns == columns

    four = stage(p.personal_data(spark, three, sf))
    before = {r.doc_id: r.text for r in three.collect()}
    after = {r.doc_id: r for r in four.collect()}
    assert before.keys() == after.keys() and four.columns == columns
    for k, r in after.items():
        spans = pii.base_spans(before[k])
        assert pii.base_spans(r.text) == [] and r.n_chars == len(r.text) and (r.text == before[k] or spans)

    five = p.segmentation(spark, four, sf)
    texts = {(r.doc_id, r.text) for r in segmentations.decode(five).select("doc_id", "text").collect()}
    assert texts == {(k, r.text) for k, r in after.items()}
    whole = p.run(spark, sf)
    assert whole.columns == five.columns
    assert sorted((r.doc_id, r.rank, r.ids) for r in whole.collect()) == sorted((r.doc_id, r.rank, r.ids) for r in five.collect())


def test_repeated_and_empty_rows(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "same text of some words", "en", "a", 3), (1, "same text of some words", "en", "a", 3), (2, "Same text of some words", None, None, None), (3, None, None, None, None), (4, "", "en", "b", 0)]
    docs = spark.createDataFrame(rows, schema)
    assert sorted(r.doc_id for r in p.near_duplicates(spark, docs, sf).collect()) == [1, 3]
    assert p.decontamination(spark, docs, sf).count() == 5
    assert p.personal_data(spark, docs, sf).count() == 5
    assert p.near_duplicates(spark, docs.limit(0), sf).count() == 0


def test_rows_without_an_id_and_rows_that_share_one(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    texts = ["clay pots of the early towns were fired in pits", "no river is as long as its own map of bends", "seven ships left harbour on a night without wind", "bread rises slowly where the kitchen stays cold"]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[0]), (9, texts[2]), (None, texts[1])]
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], schema)
    got = p.near_duplicates(spark, docs, sf).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(8, texts[0]), (0, texts[1]), (7, texts[2]), (7, texts[3])])
