"""A Merkle manifest of a dataset: a tree of digests over its rows, a proof for each row, and a check of another copy.

Rows are leaves, ordered by key within their group. A row's rank there is found without a sort of the group: keys are written
in digits, a histogram counts the rows of each prefix, and sums over earlier siblings, level by level, give the rank at which
each prefix starts; only rows of one prefix, few of them, are ordered among themselves. A prefix with many rows is opened
further, behind the longest prefix that its keys share, so a key that very many rows repeat is split by the leaf's digits,
and equal rows by their place in the files.

The ranks' digits to the base of the fan-out key the tree: a node is a prefix of them, and the longest prefixes are reduced
first, each level to a fan-out's part of the one below it. Groups' roots are ranked and reduced in the same way. Paths go
down again from the root, a join a level between tables of nodes; rows are met once, as children of the lowest nodes.
All of it is column expressions. Levels are tables; the driver gets their largest count and the root.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quillgraph.llm._places import placed
from quillgraph.session import stage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 8
#: Hexadecimal digits that a level of the histogram takes: at most 65,536 children.
DIGITS = 4
#: Rows of one prefix that are ordered in one task, at most; prefixes aim at a sixteenth of AIM to AIM rows.
MOST = 1 << 15
AIM = 1 << 10
#: Prefixes with more rows than MOST that are broadcast; beyond, they are joined like any table.
BROADCAST = 1 << 14
_LEAST = -(1 << 63)
_PATH = "array<struct<left:string,right:string>>"


def record_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of values one after the other, each as its bytes' number, a colon and itself, or ``-`` if null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _bytes_key(c: Column) -> Column:
    """Hexadecimal digits in the order of the column's bytes; a text comes before its continuations."""
    return F.concat(F.hex(F.encode(c, "utf-8")), F.lit("!"))


def _by_prefix(rows: DataFrame, key: Column, cut: int) -> tuple[DataFrame, list[DataFrame]]:
    """``rows`` (with ``g``) and ``p``, the prefix of ``key`` that a row is ordered within; and the counted prefixes
    (g, parent, p, n) of each step, the first step's being those of ``cut`` digits."""
    out = rows.withColumn("p", F.substring(key, 1, cut))
    steps = [stage(out.groupBy("g", "p").agg(F.count("*").alias("n")).withColumn("parent", F.lit("")), "prefixes")]
    while many := steps[-1].where(F.col("n") > MOST).count():
        heavy = steps[-1].where(F.col("n") > MOST).select("g", "p")
        heavy = F.broadcast(heavy) if many <= BROADCAST else heavy
        inside = out.join(heavy, ["g", "p"], "left_semi").groupBy("g", "p").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
        # Digits that the first and the last key share; equal keys share all of theirs.
        same = F.aggregate(F.sequence(F.lit(1), F.length("lo")), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substring("lo", i, F.lit(1)) == F.substring("hi", i, F.lit(1))), i).otherwise(n))
        opened = stage(inside.where("lo < hi").select("g", "p", (same + DIGITS).alias("to")), "opened")
        if not opened.limit(1).count():
            break
        opened = F.broadcast(opened) if many <= BROADCAST else opened
        out = out.join(opened, ["g", "p"], "left").withColumn("parent", F.when(F.col("to").isNotNull(), F.col("p")))
        out = out.withColumn("p", F.when(F.col("to").isNotNull(), F.substring(key, F.lit(1), F.col("to"))).otherwise(F.col("p")))
        steps.append(stage(out.where("to is not null").groupBy("g", "parent", "p").agg(F.count("*").alias("n")), "prefixes"))
        out = out.drop("to", "parent")
    return out, steps


def _earlier(*by: str) -> Column:
    order = Window.partitionBy(*by).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n").over(order), F.lit(0))


def _starts(steps: list[DataFrame], cut: int, shared: int) -> DataFrame:
    """(g, p, start, total): the rank at which each prefix starts, and its group's rows. ``shared``: digits at the front that
    split rows into two at most."""
    lengths = [cut]
    while lengths[-1] - shared > DIGITS:
        lengths.append(lengths[-1] - DIGITS)
    tables = [steps[0].select("g", "p", "n")]
    for n in lengths[1:]:
        tables.append(tables[-1].groupBy("g", F.substring("p", 1, n).alias("p")).agg(F.sum("n").alias("n")))
    total = F.sum("n").over(Window.partitionBy("g"))
    out = tables.pop().select("g", "p", "n", _earlier("g").alias("start"), total.alias("total"))
    for n, table in zip(reversed(lengths[1:]), reversed(tables), strict=True):
        above = out.select("g", F.col("p").alias("up"), F.col("start").alias("from"), "total")
        local = table.withColumn("up", F.substring("p", 1, n)).withColumn("before", _earlier("g", "up"))
        out = local.join(above, ["g", "up"]).select("g", "p", "n", (F.col("from") + F.col("before")).alias("start"), "total")
    found = out
    for step in steps[1:]:
        above = found.select("g", F.col("p").alias("parent"), F.col("start").alias("from"), "total")
        inner = step.withColumn("before", _earlier("g", "parent")).join(above, ["g", "parent"])
        inner = inner.select("g", "p", "n", (F.col("from") + F.col("before")).alias("start"), "total")
        found = found.join(step.select("g", F.col("parent").alias("p")).distinct(), ["g", "p"], "left_anti").unionByName(inner)
    return found.drop("n")


def radix_ranks(rows: DataFrame, key: Column, cut: int, shared: int = 0) -> DataFrame:
    """``rows`` (with a group ``g``, not null) and ``rank`` by ``key`` within the group, from 0, and ``total``, its rows.

    ``key`` is text that sorts by its bytes; no two rows of a group should have the same one, since equal keys stay in one
    task. Columns p, start, parent and to are the function's own.
    """
    out, steps = _by_prefix(rows, key, cut)
    order = Window.partitionBy("g", "p").orderBy(key)
    ranked = out.join(_starts(steps, cut, shared), ["g", "p"])
    return ranked.withColumn("rank", F.col("start") + F.row_number().over(order) - 1).drop("p", "start")


def _digest_of(kids: Column) -> Column:
    return F.sha2(F.array_join(kids, ""), 256)


def _count_at(level: int, fanout: int) -> Column:
    """Nodes of a group at a level above its leaves."""
    m = fanout**level
    return F.expr(f"(total + {m - 1}L) div {m}L")


def _lowest(ranked: DataFrame, row: Column, digest, fanout: int) -> DataFrame:
    """Nodes of the first level: (g, total, idx, rows, digest); the digest of a group of one row is the row's."""
    held = ranked.groupBy("g", "total", F.expr(f"rank div {fanout}L").alias("idx")).agg(F.array_sort(F.collect_list(F.struct("rank", row.alias("row")))).alias("rows"))
    own = F.transform("rows", lambda x: digest(x["row"]))
    return stage(held.withColumn("digest", F.when(F.col("total") == 1, F.get(own, F.lit(0))).otherwise(_digest_of(own))), "nodes")


def _reduced(lowest: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels of nodes from the lowest up, and (g, digest) of each group's last node. Those above the lowest have ``kids``."""
    most = lowest.agg(F.max("total")).first()[0]
    levels = [lowest]
    while -(-most // fanout ** len(levels)) > 1:
        n = len(levels)
        open_ = levels[-1].where(_count_at(n, fanout) > 1)
        kids = F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"])
        up = open_.groupBy("g", "total", F.expr(f"idx div {fanout}L").alias("up")).agg(kids.alias("kids"))
        levels.append(stage(up.select("g", "total", F.col("up").alias("idx"), "kids", _digest_of(F.col("kids")).alias("digest")), "nodes"))
    tops = [t.where(_count_at(n, fanout) == 1).select("g", "digest") for n, t in enumerate(levels, 1)]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return levels, out


def _step(digests: Column, i: Column) -> Column:
    """The siblings on both sides of a place."""
    return F.struct(F.array_join(F.slice(digests, F.lit(1), i), "").alias("left"), F.array_join(F.slice(digests, i + 2, F.size(digests)), "").alias("right"))


def _lowest_paths(levels: list[DataFrame], roots: DataFrame, fanout: int) -> DataFrame:
    """The lowest nodes with ``path``, the siblings from their own level up to the root, and ``subroot``."""
    paths = None
    for n in range(len(levels), 0, -1):
        tops = levels[n - 1].where(_count_at(n, fanout) == 1).select("g", "idx").join(roots, "g")
        paths = tops if paths is None else paths.unionByName(tops)
        nodes = levels[n - 1].join(paths, ["g", "idx"])
        if n == 1:
            return nodes
        every = nodes.select("g", "idx", "path", "subroot", "kids", F.posexplode("kids").alias("at", "kid"))
        paths = every.select("g", (F.col("idx") * fanout + F.col("at")).alias("idx"), F.concat(F.array(_step(F.col("kids"), F.col("at"))), F.col("path")).alias("path"), "subroot")
    raise AssertionError


def _rows_of(nodes: DataFrame, digest) -> DataFrame:
    """(row, path, subroot): each row of the lowest nodes with its own siblings in front of the node's path."""
    every = nodes.withColumn("all", F.transform("rows", lambda x: digest(x["row"]))).select("total", "path", "subroot", "all", F.posexplode("rows").alias("at", "one"))
    path = F.when(F.col("total") == 1, F.col("path")).otherwise(F.concat(F.array(_step(F.col("all"), F.col("at"))), F.col("path")))
    return every.select(F.col("one.row").alias("row"), path.alias("path"), "subroot")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(path, leaf, lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings' digests, level by level from the leaf's, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: Sequence[str] = FIELDS, fanout: int = FANOUT, claims: Mapping[str, Column] | None = None) -> DataFrame:
    """(key, leaf, claimed, path, subroot, root) for every row of ``docs``.

    ``leaf`` is the ``record_digest`` of ``fields``. In each group leaves stand in order of ``key``, an integer (nulls first)
    or text by its bytes; of equal keys by leaf, and equal rows by place. Every ``fanout`` of them, the last run being
    shorter, are replaced by the digest of their digests until one is left, the ``subroot``: a lone leaf itself. Groups'
    subroots, null first and then by bytes, give ``root`` in the same way. ``path`` has the siblings to the left and the
    right at each level, from the leaf's up.

    ``claims`` are fields as another copy has them, as expressions over ``docs``; ``claimed`` is the leaf of that copy. A
    null, an empty text and a text of a dash are three different values. Repeated rows are leaves each. Columns other than
    key, group and fields are not read. An empty table gives an empty table.
    """
    names = list(dict.fromkeys([key, group, *fields]))
    given = dict(claims or {})
    claimed = [given.get(f, F.col(f"`{f}`")) for f in fields]
    source, _ = placed(docs.select(*[f"`{c}`" for c in names], record_digest([F.col(f"`{f}`") for f in fields]).alias("_leaf"), record_digest(claimed).alias("_claimed")) if given else docs.select(*[f"`{c}`" for c in names]))
    at = {c: F.col(f"c{i}") for i, c in enumerate(names)}
    leaf, other = (F.col(f"c{len(names)}"), F.col(f"c{len(names) + 1}")) if given else (record_digest([at[f] for f in fields]), None)
    leaves = source.select(
        # A group's name is never null, and sorts by its bytes, null first.
        F.coalesce(F.concat(F.lit("="), at[group].cast("string")), F.lit("-")).alias("g"), at[key].alias("id"), F.unhex(leaf).alias("leaf"),
        (F.when(other != leaf, F.unhex(other)) if given else F.lit(None).cast("binary")).alias("claimed"), F.xxhash64("file").alias("file"), "at",
    )
    leaves = stage(leaves, "leaves")
    whole = dict(docs.select(F.col(f"`{key}`").alias("k")).dtypes)["k"] in ("bigint", "int", "smallint", "tinyint")
    digits = lambda c: F.lpad(F.hex(c), 16, "0")
    if whole:
        lo, hi, n = leaves.agg(F.min("id"), F.max("id"), F.count("*")).first()
        named, cut, shared = digits(F.col("id").cast("long").bitwiseXOR(F.lit(_LEAST))), 1, 1
        if lo is not None:
            ends = [f"{x - _LEAST:016X}" for x in (lo, hi)]
            shared = 1 + next((i for i in range(16) if ends[0][i] != ends[1][i]), 16)
            # As many last digits are left open as leave a prefix about AIM rows.
            spare = next((h for h in range(16, 0, -1) if 16**h * n <= AIM * (hi - lo + 1)), 0)
            cut = max(1, 17 - spare)
    else:
        named, cut, shared = _bytes_key(F.col("id").cast("string")), 1 + DIGITS, 0
    order = F.concat(F.coalesce(F.concat(F.lit("1"), named), F.lit("0")), F.hex("leaf"), digits(F.col("file")), digits(F.col("at")))
    ranked = radix_ranks(leaves, order, cut, min(shared, cut - 1))

    text = lambda b: F.lower(F.hex(b))
    lowest = _lowest(ranked, F.struct("id", "leaf", "claimed"), lambda r: text(r["leaf"]), fanout)
    if not lowest.limit(1).count():
        return docs.select(f"`{key}`").limit(0).select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("leaf", "string"), ("claimed", "string"), ("path", _PATH), ("subroot", "string"), ("root", "string"))])
    levels, tops = _reduced(lowest, fanout)
    # The groups' roots are the leaves of one more tree.
    subroots = stage(tops.select(F.lit("").alias("g"), F.col("g").alias("name"), "digest"), "subroots")
    own = lambda r: r["digest"]
    upper, root = _reduced(_lowest(radix_ranks(subroots, _bytes_key(F.col("name")), 2 + DIGITS), F.struct("name", "digest"), own, fanout), fanout)
    above = docs.sparkSession.range(1).select(F.lit("").alias("g"), F.array().cast(_PATH).alias("path"), F.lit("").alias("subroot"))
    roots = _rows_of(_lowest_paths(upper, above, fanout), own).select(F.col("row.name").alias("g"), "path", F.col("row.digest").alias("subroot"))
    rows = _rows_of(_lowest_paths(levels, stage(roots, "roots"), fanout), lambda r: text(r["leaf"]))
    return rows.select(F.col("row.id").alias(key), text(F.col("row.leaf")).alias("leaf"), text(F.coalesce("row.claimed", "row.leaf")).alias("claimed"), "path", "subroot", F.lit(root.first()["digest"]).alias("root"))


def verify(proofs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of a manifest: whether the claimed rows are its own."""
    folded = proofs.select(key, "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), fold(F.col("claimed"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof, and whether a copy with a third of the texts lower-cased still gives the root."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    return verify(manifest(docs, claims={"text": F.when(tampered, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))}))


def _sql_levels(name: str, n: int) -> str:
    """Levels of a tree over ``{name}0(g, n, idx, digest)``, each by reduction of the one before; single nodes stay."""
    return "".join(
        f"""
{name}{k} AS (SELECT g, n, idx // 8 AS idx, list(digest ORDER BY idx) AS kids,
  CASE WHEN n <= {8 ** (k - 1)} THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY idx)) END AS digest FROM {name}{k - 1} GROUP BY g, n, idx // 8),"""
        for k in range(1, n + 1)
    )


def _sql_folds(name: str, n: int, source: str, group: str, place: str) -> str:
    """Steps ``f{name}1`` and so on: each row with the siblings of one more level in its proof, and folded with them."""
    out = ""
    for k in range(1, n + 1):
        at, below = f"({place} // {8 ** (k - 1)}) % 8", source if k == 1 else f"f{name}{k - 1}"
        out += f"""
f{name}{k} AS (SELECT * EXCLUDE (proof, cur, n, lft, rgt), CASE WHEN n <= {8 ** (k - 1)} THEN proof ELSE proof || lft || rgt END AS proof,
  CASE WHEN n <= {8 ** (k - 1)} THEN cur ELSE sha256(lft || cur || rgt) END AS cur
  FROM (SELECT r.*, t.n, array_to_string(t.kids[1:{at}], '') AS lft, array_to_string(t.kids[{at} + 2:], '') AS rgt
    FROM {below} r JOIN {name}{k} t ON t.g = r.{group} AND t.idx = r.{place} // {8 ** k})),"""
    return out


def _sql_leaf(text: str) -> str:
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    return "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: Trees of up to 8 ** 7 documents of a language, and of 64 languages.
_DEEP, _WIDE = 7, 2
QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
SQL = {
    "op11_merkle_manifest": f"""
WITH crc AS (SELECT list(c ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) x(i))),
coded AS (SELECT d.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS code FROM documents d, crc),
sides AS (SELECT *, {_sql_leaf("text")} AS leaf, coalesce('=' || lang, '-') AS g,
  CASE WHEN code % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM coded),
ranked AS (SELECT doc_id, leaf, {_sql_leaf("other")} AS cur, '' AS proof, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY g) AS n FROM sides),
d0 AS (SELECT g, n, rank AS idx, leaf AS digest FROM ranked),{_sql_levels("d", _DEEP)}
s0 AS (SELECT 1 AS g, count(*) OVER () AS n, row_number() OVER (ORDER BY encode(g)) - 1 AS idx, digest, g AS name FROM d{_DEEP}),
w0 AS (SELECT * EXCLUDE (name) FROM s0),{_sql_levels("w", _WIDE)}
begun AS (SELECT r.* EXCLUDE (n), s.digest AS subroot, s.idx AS place, 1 AS one FROM ranked r JOIN s0 s ON s.name = r.g),{_sql_folds("d", _DEEP, "begun", "g", "rank")}{_sql_folds("w", _WIDE, f"fd{_DEEP}", "one", "place")}
joined AS (SELECT f.*, w.digest AS root FROM fw{_WIDE} f CROSS JOIN w{_WIDE} w)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified FROM joined"""
}
