import io
import json
import zipfile

from pyspark.sql import functions as F

from quillgraph.operators.datasets import prf
from quillgraph.sources import archives as ar, bibliography as b, files as f


def test_catalogue_export(spark, tmp_path):
    records = [
        {"_id": "1", "title": "A", "citekey": "k1", "doi": "https://doi.org/10.1/X.", "published": {"year": "2001"}, "author": [{"first": "Ann", "last": "Lee"}, {"formatted": "B. Ray"}], "attachments": [{"filename": "All/Été paper.pdf"}, {"filename": "other.pdf"}]},
        {"_id": "2", "title": "A", "attachments": [{"filename": "x/other.PDF"}]},
        {"_id": "3"},
    ]
    (tmp_path / "c.json").write_text(json.dumps(records))
    rows = b.read_catalogue(spark, str(tmp_path / "c.json"))
    got = {(r.record_id, r.filename): r for r in rows.collect()}
    assert got["1", "other.pdf"].authors == ["Ann Lee", "B. Ray"] and got["1", "other.pdf"].doi == "10.1/x" and got["1", "other.pdf"].year == 2001
    assert {r.name_key: r.record_id for r in b.best_by(rows, "name_key").collect()}["other"] == "1" and ("3", None) in got


def test_catalogue_tables(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "items": make([(1, "P1"), (2, "A1"), (3, "A2"), (4, "A3")], "itemID int, key string"),
        "itemAttachments": make([(2, 1, "storage:x.pdf", None), (3, 1, "storage:y.html", "application/pdf"), (4, None, "z.pdf", None)], "itemID int, parentItemID int, path string, contentType string"),
        "itemData": make([(1, 1, 1), (1, 2, 2)], "itemID int, fieldID int, valueID int"),
        "fields": make([(1, "title"), (2, "date")], "fieldID int, fieldName string"),
        "itemDataValues": make([(1, "T"), (2, "May 2004")], "valueID int, value string"),
        "itemCreators": make([(1, 2, 1), (1, 1, 0)], "itemID int, creatorID int, orderIndex int"),
        "creators": make([(1, "Ann", "Lee"), (2, "", "Ray")], "creatorID int, firstName string, lastName string"),
    }
    got = b.read_catalogue_tables(tables).collect()
    assert [(r.persistent_id, r.attachment_key, r.title, r.year, r.authors) for r in got] == [("1:P1", "A1", "T", 2004, ["Ann Lee", "Ray"])]


def test_json_lines_and_corrections(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2, "b": 3}\n')
    assert sorted(r.a for r in b.read_json_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect()) == [1, 2]
    (tmp_path / "c.csv").write_text("Reference_Key,VALID,Citekey\nR1,,a\nr1,,A\nR2,f,\nR3,,b\nR3,,c\n,,d\n")
    good, invalid, conflicts = b.read_corrections(spark, str(tmp_path / "c.csv"))
    assert [r.reference_key for r in good.collect()] == ["r1"] and [r[0] for r in invalid.collect()] == ["r2"] and [r[0] for r in conflicts.collect()] == ["r3"]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "sub" / "b.pdf").write_bytes(b"nothing")
    listing = f.list_files(spark, str(tmp_path))
    assert {r.stem: r.readable for r in listing.collect()} == {"a": True, "b": False}
    assert f.new_files(listing, listing.where("stem = 'a'")).select("stem").collect()[0].stem == "b"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("../up/c.pdf", b"1")
        z.writestr("d.txt", b"2")
    (tmp_path / "z.zip").write_bytes(data.getvalue())
    (tmp_path / "bad.zip").write_bytes(b"no")
    got = {r.member: (r.content and bytes(r.content), r.issue) for r in ar.read_archive_members(spark, str(tmp_path)).collect()}
    assert got["up/c.pdf"] == (b"1", None) and len(got) == 2 and got[None][1].startswith("archive_unreadable: ")
    assert ar.safe_member("C:\\x\\..\\y.pdf") == "x/y.pdf" and ar.safe_member("../") is None
    (tmp_path / "o.txt").write_text(" one \r\n\n two\n")
    lines = f.read_plain_lines(spark, str(tmp_path / "o.txt")).orderBy("line_no").collect()
    assert [(r.stem, r.page, r.line) for r in lines] == [("o", 1, "one"), ("o", 1, "two")]


def test_set_metrics(spark):
    rows = spark.createDataFrame([(["a", "b"], ["b", "c", "d"]), ([], []), (["a"], [])], "g array<string>, p array<string>")
    got = [(round(r.precision, 3), r.recall, round(r.f1, 3)) for r in prf(rows, "g", "p").collect()]
    assert got == [(0.333, 0.5, 0.4), (1.0, 1.0, 1.0), (0.0, 0.0, 0.0)]
    assert rows.select(F.lit(1)).count() == 3
