"""Exact samples, curricula, scoped groups, names as substrings, archives, background jobs and what they report."""

import hashlib
import io
import random
import threading
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import resolution as r, sampling as s
from quillgraph.sources import archives as a, files
from quillgraph.streaming import jobs


def by_digest(keys, n, seed):
    return sorted(sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), str(k)))[:n])


@pytest.mark.parametrize("ranked", [50_000, 3])
def test_samples_are_exact(spark, monkeypatch, ranked):
    monkeypatch.setattr(s, "RANKED", ranked)
    monkeypatch.setattr(s, "DIGITS", 1)
    rows = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).repartition(7)
    for n in (0, 1, 7, 250, 499, 500, 600):
        assert sorted(x.k for x in s.exact_sample(rows, n, "k", 5).collect()) == by_digest(range(500), n, 5)
    same = spark.range(90).select(F.lit("x").alias("k"))
    assert s.exact_sample(same, 31, "k").count() == 31 and s.exact_sample(same.limit(0), 3, "k").count() == 0


def test_split_sizes(spark):
    sizes = [s.eval_size(n, share) for n, share in ((0, 0.1), (1, 0.5), (2, 0.5), (7, 0.5), (8, 0.0), (8, 0.9), (25, 0.1), (35, 0.1), (1000, 0.1), (1000, -1.0))]
    assert sizes == [0, 0, 1, 4, 1, 4, 2, 4, 100, 1] or sizes == [0, 0, 1, 4, 1, 4, 2, 3, 100, 1]
    got = s.exact_split(spark.range(1000).select(F.col("id").alias("k")), "k", 0.1, 3)
    assert sorted(x.k for x in got.where("split = 'eval'").collect()) == by_digest(range(1000), 100, 3) and got.count() == 1000
    assert s.exact_split(spark.range(0).select(F.col("id").alias("k")), "k", 0.1).count() == 0


def test_curriculum(spark):
    rows = [(f"k{i}", t, "split" if i % 2 else "parse") for i in range(40) for t in (("gold", "silver") if i < 10 else ("silver",) if i < 25 else ("synthetic", "other"))]
    got = s.curriculum(spark.createDataFrame(rows, "key string, tier string, task string"), "key", "tier", "task", {"gold": 3, "silver": 2, "synthetic": 1}, {"a": ({"gold": 2, "silver": 1}, {"split": 3}, 0), "b": ({"synthetic": 5}, {}, 11)}, 0.2, 1).collect()
    tier = {f"k{i}": "gold" if i < 10 else "silver" if i < 25 else "synthetic" for i in range(40)}
    assert all(tier[x.key] == x.tier for x in got)
    held = {x.key for x in got if x.stage == "eval"}
    assert sum(tier[k] == "gold" for k in held) == 2 and sum(tier[k] == "silver" for k in held) == 3 and sum(tier[k] == "synthetic" for k in held) == 3
    copies = {}
    for x in got:
        copies.setdefault((x.stage, x.key), []).append(x.copy)
    for k, t in tier.items():
        want = 0 if k in held else {"gold": 2, "silver": 1, "synthetic": 0}[t] * (3 if int(k[1:]) % 2 else 1)
        assert sorted(copies.get(("a", k), [])) == list(range(1, want + 1))
    assert sum(x.stage == "b" for x in got) == 11 and not held & {x.key for x in got if x.stage != "eval"}


def test_groups_within_a_scope_are_whole(spark):
    rng = random.Random(2)
    rows = [(i, f"a{rng.randrange(60)}" if rng.random() < 0.7 else None, f"b{rng.randrange(90)}" if rng.random() < 0.6 else None) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, x string, y string")
    every = {}
    for x in r.duplicate_groups(df, "id", ["x", "y"]).collect():
        every.setdefault(x.group, set()).add(x.id)
    for scope in ([0, 1], list(range(0, 150, 9)), [], [999]):
        got = {}
        for x in r.groups_within(df, "id", ["x", "y"], spark.createDataFrame([(i,) for i in scope], "id long")).collect():
            got.setdefault(x.group, set()).add(x.id)
        assert got == {g: ids for g, ids in every.items() if ids & set(scope)}
    # A key that a third of all rows hold.
    hot = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i}", None) for i in range(90)], "id long, x string, y string")
    assert r.groups_within(hot, "id", ["x", "y"], hot.where("id = 3")).count() == 30


def test_groups_within_a_scope_over_a_long_chain(spark):
    # Records i and i + 1 share a key, by turns one of x and one of y.
    chain = spark.createDataFrame([(i, f"x{i // 2}", f"y{(i + 1) // 2}") for i in range(300)] + [(1000, "lone", None), (1001, "pair", None), (1002, "pair", None), (None, "x0", None)], "id long, x string, y string")
    got = r.groups_within(chain, "id", ["x", "y"], chain.where("id in (299, 1000)")).collect()
    assert sorted((x.id, x.group) for x in got) == [(i, 0) for i in range(300)]


@pytest.mark.parametrize("block", [1 << 17, 4])
def test_names_are_found_anywhere(spark, block):
    names = ["smith", "van der berg", "li", "o'neil", "ärger", "", "smithson", "no one", "1999", "99"]
    texts = [(1, "Smithson and VAN DER BERG, 1999a"), (1, "Li 199"), (2, "online o'neil ÄRGER"), (3, None), (4, ""), (5, "van  der berg")]
    got = {(x.k, x.phrase) for x in r.held_phrases(spark.createDataFrame(texts, "k int, t string"), "k", "t", spark.createDataFrame([(n.upper(),) for n in names], "phrase string"), block).collect()}
    assert got == {(k, n) for k, t in texts for n in names if n and n in (t or "").lower()}
    targets = spark.createDataFrame([(7, "van der Berg ", 1999), (8, "Li", 99), (9, "smith", None), (1, "smith", 1999), (10, " ", 1999)], "article_id int, author string, year int")
    chunks = spark.createDataFrame(texts, "article_id int, chunk_text string")
    seen = spark.createDataFrame([(1, 8)], "src int, dst int")
    assert {(x.src, x.dst) for x in r.in_text_links(chunks, targets, seen.limit(0)).collect()} == {(1, 7), (1, 8)}
    assert {(x.src, x.dst) for x in r.in_text_links(chunks, targets, seen).collect()} == {(1, 7)}
    assert r.in_text_links(chunks, targets.limit(0), seen).count() == 0


def archive(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in members:
            z.writestr(name, data)


def test_archives(spark, tmp_path, monkeypatch):
    (tmp_path / "sub dir").mkdir()
    archive(tmp_path / "a.zip", [(f"x/{i}.pdf", b"%d" % i * 50) for i in range(25)] + [("x/", b""), ("n.txt", b"1")])
    archive(tmp_path / "sub dir" / "b é.zip", [("../up/c.PDF", b"1"), ("/", b"")])
    archive(tmp_path / "none.zip", [("d.txt", b"2")])
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("good.pdf", b"good")
        z.writestr("torn.pdf", b"torn")
    (tmp_path / "torn.zip").write_bytes(data.getvalue().replace(b"torn.pdftorn", b"torn.pdftOrn"))
    monkeypatch.setattr(a, "RANGE_MEMBERS", 4)
    listing = a.list_archives(spark, str(tmp_path))
    ranges = a.member_ranges(listing).collect()
    assert [(x.first, x.last) for x in sorted((x for x in ranges if x.archive.endswith("a.zip")), key=lambda x: x.first)] == [(k, min(24, k + 3)) for k in range(0, 25, 4)]
    rows = a.read_archive_members(spark, str(tmp_path)).cache()
    got = {(x.archive.rsplit("/", 1)[1], x.member): (x.content and bytes(x.content), x.issue) for x in rows.collect()}
    assert {got["a.zip", f"x/{i}.pdf"] for i in range(25)} == {(b"%d" % i * 50, None) for i in range(25)}
    assert got["b é.zip", "up/c.PDF"] == (b"1", None) and got["none.zip", None] == (None, None) and len(got) == 25 + 1 + 1 + 1 + 2
    assert got["bad.zip", None][1].startswith("archive_unreadable: ") and got["torn.zip", "good.pdf"] == (b"good", None) and got["torn.zip", "torn.pdf"] == (None, "member_unreadable: BadZipFile")
    manifest = spark.createDataFrame(a.manifest_of(rows).collect())
    assert {x.archive.rsplit("/", 1)[1]: x.members for x in manifest.collect()} == {"a.zip": 25, "b é.zip": 1, "none.zip": 0}
    archive(tmp_path / "none.zip", [("new.pdf", b"3"), ("d.txt", b"2")])
    again = a.read_archive_members(spark, str(tmp_path), manifest=manifest)
    assert {(x.archive.rsplit("/", 1)[1], x.member) for x in again.collect()} == {("none.zip", "new.pdf"), ("bad.zip", None), ("torn.zip", "good.pdf"), ("torn.zip", "torn.pdf")}
    assert tuple(a.archive_summary(a.list_archives(spark, str(tmp_path)), again).first()) == (5, 2, 1, 2)
    monkeypatch.setattr(a, "MOST_BYTES", 0)
    assert {x.issue for x in a.read_members(a.member_ranges(listing.where("archive like '%a.zip'"))).collect()} == {"member_too_large"}


def test_an_archive_is_not_held_whole(spark, tmp_path, monkeypatch):
    path = tmp_path / "large.zip"
    archive(path, [(f"{i}.pdf", bytes([i]) * 200_000) for i in range(40)])
    read = []

    class Counted(io.FileIO):
        def readinto(self, b):
            n = super().readinto(b)
            read.append(n)
            return n

        def read(self, size=-1):
            data = super().read(size)
            read.append(len(data))
            return data

    monkeypatch.setattr(a, "opened", lambda p: Counted(p.removeprefix("file:")))
    batch = spark.createDataFrame([(str(path), "s", 3, 4, 0, None)], "archive string, signature string, first long, last long, bytes long, issue string").toArrow().to_batches()
    names = {}
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, f, schema: names.update(f=f) or self)
    a.read_members(spark.range(1).select(F.lit("x").alias("archive"), F.lit(1).alias("first")))
    out = [b.to_pylist()[0] for b in names["f"](iter(batch))]
    assert [x["member"] for x in out] == ["3.pdf", "4.pdf"] and sum(read) < 500_000 < path.stat().st_size / 10


def test_headers_of_missing_files(tmp_path):
    assert not files._starts(str(tmp_path / "none.pdf"), b"%PDF")


def test_jobs_report_and_stop(spark):
    known = jobs.Jobs(spark, "sync", "query")
    assert known.status("sync")["status"] == "idle" and known.stop("sync")["stop_state"] == "noop_idle"
    begun = threading.Event()

    def slow(job):
        job.progress(250, "on its way")
        begun.set()
        return spark.range(8).repartition(8).select(F.expr("java_method('java.lang.Thread', 'sleep', 60000L)")).collect()

    known.start("sync", slow)
    with pytest.raises(RuntimeError):
        known.start("sync", slow)
    known.start("query", lambda job: spark.range(1000).repartition(4).count())
    assert begun.wait(20)
    time.sleep(2)
    assert known.wait("query", 60)["result"] == 1000 and known.status("query")["percent"] == 100.0
    stopped = known.stop("sync")
    assert stopped["stop_state"] == "accepted" and stopped["lifecycle"] == "cancelling" and known.stop("sync")["stop_state"] in ("noop_cancelling", "noop_terminal")
    ended = known.wait("sync", 30)
    assert (ended["status"], ended["lifecycle"], ended["percent"]) == ("cancelled", "cancelled", 100.0) and ended["error"]
    # The tag is gone with the job: later work of the session runs.
    assert known.stop("sync")["stop_state"] == "noop_terminal" and spark.range(10).count() == 10

    def broken(job):
        raise ValueError("nothing here")

    known.start("query", broken)
    assert (known.wait("query", 30)["status"], known.status("query")["error"]) == ("failed", "nothing here")

    def looks(job):
        while True:
            time.sleep(0.05)
            job.check()

    known.start("query", looks)
    known.stop("query")
    assert known.wait("query", 30)["status"] == "cancelled"


def test_a_stopped_job_ends_its_stream(spark, tmp_path):
    known, told = jobs.Jobs(spark, "ingest"), f"file://{tmp_path}/told"
    listener = jobs.ProgressRows(spark, told)
    spark.streams.addListener(listener)
    try:
        source = spark.readStream.format("rate").option("rowsPerSecond", 50).load()
        known.start("ingest", lambda job: job.stream(source.writeStream.queryName("rate").format("noop").option("checkpointLocation", f"file://{tmp_path}/mark").trigger(processingTime="200 milliseconds")).awaitTermination())
        for _ in range(100):
            time.sleep(0.2)
            if spark.streams.active and spark.streams.active[0].lastProgress and spark.streams.active[0].lastProgress["numInputRows"]:
                break
        known.stop("ingest")
        assert known.wait("ingest", 30)["status"] == "cancelled" and not spark.streams.active
        jobs.settle(spark)
    finally:
        spark.streams.removeListener(listener)
    kinds = {x.kind: x for x in jobs.read_progress(spark, told).orderBy("rows").collect()}
    assert set(kinds) == {"started", "progress", "terminated"} and kinds["progress"].rows > 0 and kinds["progress"].name == "rate" and kinds["terminated"].error is None


def test_residual_says_why(spark):
    stored = spark.createDataFrame([(1, "a", "t"), (2, "b", "t"), (3, "c", "u"), (4, "c", None)], "sid int, k string, title string")
    rows = spark.createDataFrame([(10, "a", None), (11, None, "t"), (12, None, None), (13, "zz", "none"), (14, "c", "u"), (15, None, "u")], "id int, k string, title string")
    matched = r.reconcile(rows, stored, ["k", "title"], "sid")
    assert {(x.id, x.matched_by, x.reason, x.holders) for x in r.residual(matched, stored, ["k", "title"], "sid").collect()} == {(11, "ambiguous:title", "ambiguous:title", 2), (12, "none", "no_key", 0), (13, "none", "not_found", 0), (14, "ambiguous:k", "ambiguous:k", 2)}
    assert r.residual(matched.limit(0), stored, ["k", "title"], "sid").count() == 0


def test_prior_work_pairs_are_in_no_shuffle(spark):
    rows = spark.createDataFrame([(i, " Lee" if i % 2 else "ray", 2000 + i % 5) for i in range(60)] + [(60, "lee ", 2009), (61, None, 2009), (62, "lee", None)], "article_id long, author string, year int")
    seen = spark.createDataFrame([(60, 1), (60, 3), (60, 3), (60, 2), (9, 5), (None, 1), (60, None)], "src long, dst long")
    got = r.prior_work_links(rows, seen)
    a = [(x.article_id, x.author.strip().lower(), x.year) for x in rows.collect() if x.author and x.year]
    hidden = {(x.src, x.dst) for x in seen.collect()}
    want = sorted((s, d) for s, n, y in a for d, m, z in a if n == m and y > z and (s, d) not in hidden)
    assert sorted(map(tuple, got.collect())) == want and want
    assert "LeftAnti" not in got._jdf.queryExecution().executedPlan().toString()
