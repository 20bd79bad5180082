"""WARC archives: writing captures, reading records back, and assembling them to one nested row per capture.

A capture is a response (or a revisit of one with an equal payload), the request and a metadata record; the latter two name
the first by WARC-Concurrent-To. Archives are gzip files of WARC/1.1 records, written and read by Spark alone, so they may
lie in any store that Spark knows. A reader streams lines that end in CR LF and cuts blocks by Content-Length; it never
holds an archive. gzip files aren't split, so the writer bounds their records.

Assembly joins identifiers only; requests and metadata records are gathered for each capture, which is what its row holds,
and the payload stays with the response.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillgraph.llm._places import placed
from quillgraph.session import fresh_path, stage

RECORDS_PER_FILE = 20_000
PRIMARY = ("response", "revisit", "resource")
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORDS = (
    "file string, record_id string, type string, target_uri string, date string, concurrent_to array<string>, refers_to string,"
    " content_type string, payload_digest string, http_length long, payload_bytes long, computed_digest string, payload binary"
)


def base32(hex_: Column) -> Column:
    """Upper-case base32 of the 40 hexadecimal digits of a SHA-1."""
    parts = []
    for g in range(8):
        value = F.conv(F.substring(hex_, 5 * g + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(_BASE32), F.shiftright(value, 15 - 5 * j).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for j in range(4)]
    return F.concat(*parts)


def _lines(*lines: Column | str) -> Column:
    return F.concat(*[x for line in lines for x in (F.lit(line) if isinstance(line, str) else line, F.lit("\r\n"))])


def _clean(text: Column) -> Column:
    """A header's value: no line ends or other controls."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x1f\x7f]", "_")


def _record(kind: Column, ident: Column, uri: Column, headers: list[Column], body: Column) -> Column:
    head = F.concat(
        _lines("WARC/1.1", F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: <"), ident, F.lit(">")), "WARC-Date: 2024-01-01T00:00:00Z", F.concat(F.lit("WARC-Target-URI: "), uri)),
        *headers,
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n")),
    )
    return F.concat(head.cast("binary"), body)


def write_captures(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", body: str = "html", least: int = 0, per_file: int = RECORDS_PER_FILE) -> None:
    """One capture for each row, as gzip archives under ``path``; payloads are the bodies in UTF-8, null counts as empty.

    Of rows with equal payloads of ``least`` bytes or more, that with the smallest key is a response and the others revisit
    it (null keys come last; of repeated smallest keys one row is the response). Binary bodies are taken as they are.
    """
    source, _ = placed(pages.select(F.col(f"`{key}`"), F.col(f"`{url}`"), F.col(f"`{body}`")))
    rows = source.select(
        F.col("c0").cast("string").alias("key"), F.col("c0").alias("k"), _clean(F.col("c1").cast("string")).alias("uri"),
        F.coalesce(F.col("c2").cast("binary"), F.lit(b"")).alias("payload"),
        F.md5(F.concat_ws(":", "file", F.col("at").cast("string"))).alias("id"),
    ).withColumn("sha", F.sha1("payload"))
    firsts = (
        rows.where(F.octet_length("payload") >= least)
        .groupBy("sha")
        .agg(F.min(F.struct(F.col("k").isNull().alias("null"), "k", "id")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("sha", F.col("first.id").alias("first"))
    )
    # A table of its own: Spark sees its size, and beyond a broadcast can split the rows of a payload that many pages have.
    told = rows.join(stage(firsts, "firsts"), "sha", "left").withColumn("digest", base32(F.col("sha"))).withColumn("again", F.coalesce(F.col("first") != F.col("id"), F.lit(False)) & (F.octet_length("payload") >= least))
    ident = F.concat(F.lit("urn:sha1:"), "id")
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest", F.lit("\r\n"))
    http = F.concat(_lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=UTF-8", F.concat(F.lit("Content-Length: "), F.octet_length("payload").cast("string"))), F.lit("\r\n")).cast("binary")
    main = _record(
        F.when(F.col("again"), "revisit").otherwise("response"), ident, F.col("uri"),
        [
            F.lit("Content-Type: application/http; msgtype=response\r\n"), digest,
            F.when(F.col("again"), F.concat(_lines("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), F.lit("WARC-Refers-To: <urn:sha1:"), "first", F.lit(">\r\n"))).otherwise(F.lit("")),
        ],
        F.when(F.col("again"), http).otherwise(F.concat(http, "payload")),
    )
    joined = F.concat(F.lit("WARC-Concurrent-To: <"), ident, F.lit(">\r\n"))
    request = _record(F.lit("request"), F.concat(ident, F.lit(":request")), F.col("uri"), [F.lit("Content-Type: application/http; msgtype=request\r\n"), joined], F.concat(F.lit("GET "), "uri", F.lit(" HTTP/1.1\r\n\r\n")).cast("binary"))
    metadata = _record(F.lit("metadata"), F.concat(ident, F.lit(":metadata")), F.col("uri"), [F.lit("Content-Type: application/warc-fields\r\n"), joined], F.coalesce(F.concat(F.lit("key: "), "key", F.lit("\r\n")), F.lit("")).cast("binary"))
    gap = F.lit(b"\r\n\r\n")
    # Bytes pass through a text column unchanged; the writer adds the last CR LF.
    text = F.concat(request, gap, main, gap, metadata, F.lit(b"\r\n")).cast("string")
    told.select(text.alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def _blocks(lines: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, list[tuple[str, str]], bytes]]:
    """(file, headers, block) of each record in lines without their CR LF."""
    file, state, headers, parts, need = None, "gap", [], [], 0
    for name, line in lines:
        if name != file:
            if state != "gap":
                raise ValueError(f"{file} ends within a record")
            file = name
        if state == "gap":
            if line.startswith(b"WARC/"):
                state, headers = "head", []
            elif line:
                raise ValueError(f"{file}: no record where one should start")
        elif state == "head":
            if line:
                field, _, value = line.partition(b":")
                headers.append((field.decode("latin-1").strip().lower(), value.strip().decode("utf-8", "replace")))
            else:
                need, parts = int(dict(headers).get("content-length", 0)), []
                state = "block" if need else "gap"
                if not need:
                    yield file, headers, b""
        else:
            if len(line) >= need:
                parts.append(line[:need])
                yield file, headers, b"".join(parts)
                state = "gap"
            else:
                # What is short by one byte ends between CR and LF; the reader left that CR in the line then.
                parts += (line, b"\r\n")
                need -= len(line) + 2
                if need <= 0:
                    yield file, headers, b"".join(parts)[: need or None]
                    state = "gap"
    if state != "gap":
        raise ValueError(f"{file} ends within a record")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in RECORDS.split(",")]
    types = [pa.string()] * 5 + [pa.list_(pa.string())] + [pa.string()] * 3 + [pa.int64()] * 2 + [pa.string(), pa.binary()]

    def lines() -> Iterator[tuple[str, bytes]]:
        for b in batches:
            yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    rows, held = [], 0
    for file, headers, block in _blocks(lines()):
        one = dict(reversed(headers))
        http = one.get("content-type", "").startswith("application/http") or (one.get("warc-type") == "response" and block.startswith(b"HTTP/"))
        payload = block
        length = None
        if http:
            head, _, payload = block.partition(b"\r\n\r\n")
            for line in head.split(b"\r\n")[1:]:
                field, _, value = line.partition(b":")
                if field.strip().lower() == b"content-length" and value.strip().isdigit():
                    length = int(value)
        bare = lambda x: x.strip().removeprefix("<").removesuffix(">")
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        given = one.get("warc-payload-digest")
        rows.append((
            file, bare(one.get("warc-record-id", "")), one.get("warc-type"), one.get("warc-target-uri"), one.get("warc-date"),
            [bare(v) for f, v in headers if f == "warc-concurrent-to"], bare(one["warc-refers-to"]) if "warc-refers-to" in one else None,
            one.get("content-type"), given.removeprefix("sha1:") if given else None, length, len(payload), digest, payload,
        ))
        held += len(payload) + 500
        if held > 1 << 22:
            yield batch(rows)
            rows, held = [], 0
    if rows:
        yield batch(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of gzip WARC archives: see RECORDS. ``payload`` is the HTTP body, or the whole block of other records.

    Digest and size of a payload are computed from what was read. A damaged archive fails the job with its name. An archive
    that isn't compressed could be split within a record; only gzip is read.
    """
    lines = spark.read.option("lineSep", "\r\n").option("pathGlobFilter", "*.gz").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line")).mapInArrow(_parse, RECORDS)


def assemble(records: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per capture: (capture_id, target_uri, main, requests, metadata), the latter two arrays.

    Archives are read once into a table of records without the main payloads, on which all links are joined; payloads of
    main records come in one further pass, and not at all (``main.payload`` is null then) without ``payloads``.

    A request or metadata record belongs to the response, revisit or resource that it names or that names it, or to that of
    another record which it names. What belongs to none makes a row with a null ``main``. Links without a record and
    repeated links change nothing; an empty table gives an empty table.
    """
    is_main = F.coalesce(F.col("type").isin(*PRIMARY), F.lit(False))
    known = stage(records.where(F.col("record_id") != "").withColumn("payload", F.when(~is_main, F.col("payload"))), "records")
    mains = known.where(is_main).select(F.col("record_id").alias("capture"))
    parts = known.where(~is_main & (F.col("type") != "warcinfo"))
    links = known.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b"))
    arcs = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    direct = arcs.join(mains, F.col("b") == F.col("capture")).groupBy(F.col("a").alias("part")).agg(F.min("capture").alias("capture"))
    through = arcs.join(direct, F.col("b") == F.col("part")).groupBy("a").agg(F.min("capture").alias("farther"))
    owned = (
        parts.join(direct, F.col("record_id") == F.col("part"), "left")
        .join(through, F.col("record_id") == F.col("a"), "left")
        .withColumn("owner", F.coalesce("capture", "farther", F.concat(F.lit("alone:"), "record_id")))
    )
    small = F.struct("record_id", "date", "content_type", "payload")
    gathered = owned.groupBy("owner").agg(
        F.first("target_uri", ignorenulls=True).alias("uri"),
        F.collect_list(F.when(F.col("type") == "request", small)).alias("requests"),
        F.collect_list(F.when(F.col("type") == "metadata", small)).alias("metadata"),
    )
    main = known.where(is_main)
    if payloads:
        bodies = records.where(is_main & (F.col("record_id") != "")).select("file", "record_id", "payload")
        main = main.drop("payload").join(bodies, ["file", "record_id"])
    joined = main.join(gathered, F.col("record_id") == F.col("owner"), "full")
    fields = ("record_id", "type", "date", "content_type", "payload_digest", "refers_to", "http_length", "payload_bytes", "computed_digest", "payload")
    empty = F.array().cast("array<struct<record_id:string,date:string,content_type:string,payload:binary>>")
    return joined.select(
        F.coalesce("record_id", F.regexp_replace("owner", "^alone:", "")).alias("capture_id"),
        F.coalesce("target_uri", "uri").alias("target_uri"),
        F.when(F.col("record_id").isNotNull(), F.struct(*fields)).alias("main"),
        F.coalesce("requests", empty).alias("requests"),
        F.coalesce("metadata", empty).alias("metadata"),
    )


def op2_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives, read back and assembled."""
    path = fresh_path(spark, "warc")
    write_captures(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    captures = assemble(read_archives(spark, path), payloads=False)
    revisit = F.col("main.type") == "revisit"
    pages = captures.select(
        F.col("main.record_id").alias("id"),
        F.regexp_extract(F.get("metadata", F.lit(0))["payload"].cast("string"), r"key: (-?[0-9]+)", 1).try_cast("long").alias("page_id"),
        F.when(revisit, F.col("main.http_length")).otherwise(F.col("main.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("main.payload_digest")).otherwise(F.col("main.computed_digest")).alias("payload_digest"),
        F.col("main.type").alias("record_type"),
        F.when(revisit, F.col("main.refers_to")).alias("to"),
    )
    pages = stage(pages, "captures")
    # Responses refer to nothing: they pass by the join, where their null keys would meet in one task.
    whole = pages.where("record_type = 'response'").select(F.col("id").alias("to"), F.col("page_id").alias("refers_to"))
    again = pages.where("to IS NOT NULL").join(whole, "to", "left")
    alone = pages.where("to IS NULL").withColumn("refers_to", F.lit(None).cast("long"))
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return again.select(*columns).unionByName(alone.select(*columns))


_DIGITS = " || ".join(
    f"substr('{_BASE32}', CAST((('0x' || substr(s, {5 * g + 1}, 5))::BIGINT >> {15 - 5 * j}) & 31 AS INTEGER) + 1, 1)" for g in range(8) for j in range(4)
)
QUERIES = {"op2_warc_transactions": op2_warc_transactions}
SQL = {
    "op2_warc_transactions": f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS s FROM pages),
d AS (SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, s, {_DIGITS} AS payload_digest, min(page_id) OVER (PARTITION BY s) AS f FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to
FROM d
"""
}
