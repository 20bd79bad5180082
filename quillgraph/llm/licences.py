"""Whole texts that are known licences, by canonical digest.

A text's canonical form has lower-case letters, no copyright notices, one blank for each run of punctuation or white space,
and one spelling for equivalent words; its SHA-256 is joined to the digests of known licences. Everything is a built-in
expression: one scan, and a hash join whose small side is counted before it is broadcast.

A notice is a paragraph that begins with "copyright", "(c)", a copyright sign or "all rights reserved", up to its end or to the
opening words of a grant. Where lines break within a paragraph changes nothing, so a licence is found at any line width,
and a wrapped line that begins with "copyright notice" stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillgraph.llm._licence_texts import TEXTS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MARKS = r"\x00-\x2f\x3a-\x60\x7b-\x7f“”‘’„«»–—…•·\xa0"
_GAP = f"[{_MARKS}]+"
PUNCTUATION = _GAP
#: The words a grant opens with; a notice before them, in the same paragraph, ends there.
OPENINGS = (
    "permission is hereby granted",
    "permission to use",
    "redistribution and use",
    "this software is provided",
    "licensed under the",
    "everyone is permitted",
    "this is free and unencumbered",
)
#: Each step's pattern and what it becomes; ``{1}`` is the first group. Paragraphs are parted by U+0001 in between.
STEPS = (
    # A title of one line, and a notice right below it, are two paragraphs.
    (rf"^([^\n]{{0,60}}licen[sc]e[^\n]{{0,20}}\n)([{_MARKS}]*(?:copyright|\(c\)|©))", "{1}\n\n{2}"),
    (f"([{_MARKS}])(" + "|".join(o.replace(" ", _GAP) for o in OPENINGS) + ")", "{1}\n\n{2}"),
    (rf"\n[{_MARKS}]*\n", "\x01"),
    (rf"(?:^|\x01)[{_MARKS}]*(?:copyright|\(c\)|©|all rights reserved)[^\x01]*", "\x01"),
)
#: What Java finds faster in the place of a step, with the same result: an opening is looked for by its first letter, and only
#: then the mark before it.
_QUICK = {STEPS[1][0]: (f"(?=[{''.join(sorted({o[0] for o in OPENINGS}))}])(?<=[{_MARKS}])(" + "|".join(o.replace(" ", _GAP) for o in OPENINGS) + ")", "\n\n{1}")}
#: All marks, one by one.
_EACH = "".join(chr(i) for i in range(128) if not chr(i).isdigit() and not "a" <= chr(i) <= "z") + "“”‘’„«»–—…•·\xa0"
#: Texts without any of these have no notice, and skip those steps.
SIGNS = ("copyright", "(c)", "©", "all rights reserved")
#: Spellings that mean the same, as they stand after punctuation has gone. Applied in this order.
SPELLINGS = (
    (" the mit license mit ", " "),
    (" mit license ", " "),
    (" isc license ", " "),
    (" zlib license ", " "),
    (" boost software license version 1 0 august 17th 2003 ", " "),
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"),
    ("copyright owner", "copyright holder"),
    ("merchantibility", "merchantability"),
    ("whilst", "while"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("per cent", "percent"),
    (" https ", " http "),
)


#: Known digests that are broadcast, about 10 MB; beyond, both sides are shuffled by digest.
MOST_BROADCAST = 100_000


def canonical(text: Column) -> Column:
    """The canonical form; null counts as empty."""
    t = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    signed = F.lit(False)
    for sign in SIGNS:
        signed = signed | F.contains(t, F.lit(sign))
    bare = t
    for pattern, new in STEPS:
        pattern, new = _QUICK.get(pattern, (pattern, new))
        bare = F.regexp_replace(bare, pattern, new.replace("{1}", "$1").replace("{2}", "$2"))
    t = F.when(signed, bare).otherwise(t)
    # Runs of punctuation become one blank: each mark a blank by itself, then runs of blanks, of which there are few.
    t = F.concat(F.lit(" "), F.regexp_replace(F.translate(t, _EACH, " " * len(_EACH)), " {2,}", " "), F.lit(" "))
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.trim(t)


def known_licences(spark: SparkSession, texts: dict[str, str] = TEXTS) -> DataFrame:
    """(license_id, digest) of the given texts; where several are alike, the first id."""
    rows = spark.createDataFrame(list(texts.items()), "license_id string, text string")
    return rows.groupBy(F.sha2(canonical(F.col("text")), 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan_licences(docs: DataFrame, licences: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``license_digest`` and ``license_id``, null where the whole text is no known licence.

    Null, empty and punctuation-only texts have the digest of the empty form and no licence. Repeated rows stay repeated;
    columns with the new names are replaced. Empty tables, of either side, are no error.
    """
    names = [c for c in docs.columns if c not in ("license_digest", "license_id")]
    nothing = F.sha2(F.lit(""), 256)
    known = licences.where(F.col("digest") != nothing).groupBy("digest").agg(F.min("license_id").alias("found"))
    if known.count() <= MOST_BROADCAST:
        known = F.broadcast(known)
    marked = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.sha2(canonical(F.col(f"`{text}`")), 256).alias("digest"))
    joined = marked.join(known, "digest", "left")
    return joined.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("digest").alias("license_digest"), F.col("found").alias("license_id"))


def op9_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical digest of every document, and its licence."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licences(docs, known_licences(spark)).select("doc_id", "license_digest", "license_id")


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_canonical(column: str) -> str:
    t = low = f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"
    for pattern, new in STEPS:
        made = new.replace("{1}", "\\1").replace("{2}", "\\2").replace("\n", "' || chr(10) || '").replace("\x01", "' || chr(1) || '")
        t = f"regexp_replace({t}, {_sql_text(pattern)}, '{made}', 'g')"
    t = f"CASE WHEN {' OR '.join(f'contains({low}, {_sql_text(sign)})' for sign in SIGNS)} THEN {t} ELSE {low} END"
    t = f"' ' || regexp_replace({t}, {_sql_text(PUNCTUATION)}, ' ', 'g') || ' '"
    for old, new in SPELLINGS:
        t = f"replace({t}, {_sql_text(old)}, {_sql_text(new)})"
    return f"trim({t})"


def license_copies(spark: SparkSession, sf_dir: str, rows: int = 1024) -> DataFrame:
    """Licences found in texts that hold them: a copy with a notice for each part, every twentieth with a word too many.

    The test tables have no whole licence, so this query plants them by rule. A few bytes of a part become a whole licence,
    so parts are dealt out by ``rows`` for a task; a scan's splits go by bytes and would be one or a few tasks.
    """
    names = sorted(TEXTS)
    texts = spark.createDataFrame([(i, TEXTS[n]) for i, n in enumerate(names)], "i int, licence string")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", (F.col("p_partkey") % len(names)).cast("int").alias("i"))
    parts = parts.repartition(max(1, -(-parts.count() // rows)))
    notice = F.concat(F.lit("Copyright (c) 20"), F.lpad((F.col("p_partkey") % 26).cast("string"), 2, "0"), F.lit(" "), F.col("p_name"), F.lit("\nAll rights reserved.\n\n"))
    extra = F.when(F.col("p_partkey") % 20 == 0, " More.").otherwise("")
    docs = parts.join(F.broadcast(texts), "i").select("p_partkey", F.concat(notice, "licence", extra).alias("text"))
    return scan_licences(docs, known_licences(spark)).select("p_partkey", "license_digest", "license_id")


QUERIES = {"op9_license_digests": op9_license_digests, "license_copies": license_copies}
_KNOWN = f"""
WITH l(license_id, t) AS (VALUES {", ".join(f"({_sql_text(i)}, {_sql_text(t)})" for i, t in TEXTS.items())}),
k AS (SELECT sha256({_sql_canonical("t")}) AS digest, min(license_id) AS license_id FROM l GROUP BY 1),
"""
SQL = {
    "op9_license_digests": f"""{_KNOWN}
d AS (SELECT doc_id, sha256({_sql_canonical("text")}) AS license_digest FROM documents)
SELECT doc_id, license_digest, license_id FROM d LEFT JOIN k ON license_digest = digest AND digest <> sha256('')
""",
    "license_copies": f"""{_KNOWN}
n AS (SELECT t, row_number() OVER (ORDER BY license_id) - 1 AS i FROM l),
c AS (SELECT p_partkey, 'Copyright (c) 20' || lpad(CAST(p_partkey % 26 AS VARCHAR), 2, '0') || ' ' || p_name || chr(10)
  || 'All rights reserved.' || chr(10) || chr(10) || t || CASE WHEN p_partkey % 20 = 0 THEN ' More.' ELSE '' END AS text
  FROM part JOIN n ON p_partkey % {len(TEXTS)} = i),
d AS (SELECT p_partkey, sha256({_sql_canonical("text")}) AS license_digest FROM c)
SELECT p_partkey, license_digest, license_id FROM d LEFT JOIN k ON license_digest = digest AND digest <> sha256('')
""",
}
