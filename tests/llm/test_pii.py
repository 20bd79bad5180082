import hashlib
import random
import re

from pyspark.sql import functions as F

from quillgraph.llm import pii

LITERAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    def good(kind, s):
        digits = [int(c) for c in s if c in "0123456789"]
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            return 12 <= len(digits) <= 19 and (sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])) % 10 == 0
        return kind != "phone" or 9 <= len(digits) <= 15

    found = [(k, m.start(), m.end()) for k, p in LITERAL.items() for m in re.finditer(p, text or "") if good(k, m[0])]
    return sorted(found, key=lambda s: (s[1], list(LITERAL).index(s[0])))


def test_base_spans_are_the_literal_patterns(spark, sf):
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect():
        assert pii.base_spans(r.text) == brute(r.text)
    rng = random.Random(5)
    bits = ["4952935900253052", "7536784127813050", " ", "-", ".", "@", "a.b", "x@y.z", "255", "256", "1.2.3.4", "+1 (017) 555-7713", "+", "é", "٣", "00", "0255", "%", "\n", "(", "9", "mail-1.example.com", "--"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == brute(text), text


def test_very_long_runs_stay_linear():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "+1" + "(" * 300_000, "1." * 150_000, "a@" * 150_000, "1 " * 150_000):
        pii.base_spans(text)
        pii.identifiers(text, [])


def planted():
    rows = [(i, f"Lorem ipsum please phone: +1 (212) 555-{1000 + i} or nothing") for i in range(40)]
    rows += [(100 + i, f"Dolor sit please phone: ext-{7000 + i}x today") for i in range(5)]
    rows += [(200 + i, f"there were about {3000 + 7 * i} of them, and of the {19000 + i} others") for i in range(40)]
    rows += [(300, "mixed of the 12345 and x@y.org"), (301, None), (302, ""), (303, " \n"), (303, " \n"), (None, "mail x@y.org")]
    return rows


def test_contexts_find_unseen_identifiers(spark):
    docs = spark.createDataFrame(planted(), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("t", "k1", "c0", "added_spans", "pattern")})
    rows = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    texts = dict(planted())
    for i in range(5):
        spans = rows[100 + i].added_spans
        assert [(s.kind, texts[100 + i][s.start : s.end]) for s in spans] == [("context_phone", f"ext-{7000 + i}x")]
    for k, r in rows.items():
        assert [(s.kind, s.start, s.end) for s in r.base_spans] == brute(texts[k])
        if k is None or k >= 200 or k < 40:
            assert r.added_spans == []
    redacted = {r.doc_id: r.text for r in pii.redact(pii.find_personal_data(docs)).collect()}
    assert redacted[3] == "Lorem ipsum please phone: [phone] or nothing"
    assert redacted[100] == "Dolor sit please phone: [context_phone] today"
    assert redacted[301] is None and redacted[None] == "mail [email]" and redacted[200] == texts[200]
    assert pii.redact(pii.find_personal_data(docs)).columns == [c for c in docs.columns if c != "added_spans"]
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def test_second_generation(spark):
    rows = [(i, f"Lorem ipsum please phone: +1 (212) 555-{1000 + i} or nothing") for i in range(40)]
    rows += [(100 + i, f"Dolor sit please phone: ext-{7000 + i}x today") for i in range(10)]
    rows += [(200 + i, f"try the dial extension ext-{7000 + i}x again") for i in range(10)]
    rows += [(300 + i, f"try the dial extension {88000 + i}y again") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    got = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.added_spans] for r in pii.find_personal_data(docs).collect()}
    assert all(got[200 + i] == [("context_phone", f"ext-{7000 + i}x")] for i in range(10))
    assert all(got[300 + i] == [("context_phone", f"{88000 + i}y")] for i in range(2))


def plain_scores(occurrences, rounds, least_seeds, confidence):
    """The same by dictionaries: generations of scored patterns until none is added."""
    edges = {(p, v) for p, v, _ in occurrences}
    seeds = {}
    for _, v, k in occurrences:
        if k is not None:
            seeds[v] = (max(k, seeds[v][0]) if v in seeds else k, 1.0)
    accepted = {}
    while True:
        left = [(p, v) for p, v in edges if p not in accepted]
        pairs = {(p, k) for p, _ in left for k in pii.KINDS if sum(v in seeds and seeds[v][0] == k for q, v in left if q == p) >= least_seeds}
        near = [(p, v, k) for p, v in left for q, k in pairs if p == q]

        def reliability(v, k, mean):
            return mean if v not in seeds else seeds[v][1] if seeds[v][0] == k else 0.0

        means, trust = dict.fromkeys(((v, k) for _, v, k in near), 0.0), {}
        for _ in range(rounds):
            trust = {}
            for p, k in pairs:
                own = [reliability(v, k, means[v, k]) for q, v, j in near if (q, j) == (p, k)]
                trust[p, k] = sum(own) / (len(own) + 1)
            for v, k in means:
                own = [trust[p, k] for p, w, j in near if (w, j) == (v, k)]
                means[v, k] = sum(own) / len(own)
        new = {}
        for (p, k), c in sorted(trust.items(), key=lambda x: (-x[1], x[0][1])):
            if c >= confidence and p not in new:
                new[p] = (k, c)
        if not new:
            return accepted
        fresh = {}
        for v in {v for p, v, _ in near if p in new and v not in seeds}:
            by = {}
            for p in new:
                if (p, v) in edges:
                    by.setdefault(new[p][0], []).append(new[p][1])
            kind = min(by, key=lambda k: (-sum(by[k]) / len(by[k]), k))
            fresh[v] = (kind, sum(by[kind]) / len(by[kind]))
        seeds |= fresh
        accepted |= new


def test_scores_against_plain_python(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(700):
        p = rng.randint(1, 25)
        v = rng.choice([rng.randint(1, 30), 100 + 10 * p + rng.randint(0, 9), 100 + 10 * (p // 2) + rng.randint(0, 9)])
        rows.append((p, v, None if v % 3 == 0 or p > 18 else pii.KINDS[v % 2] if rng.random() < 0.95 else "ip"))
    # Patterns of many values: a chain that only generations reach.
    rows += [(40 + g, 1000 * g + i, None) for g in range(1, 5) for i in range(30)] + [(41 + g, 1000 * g + i, None) for g in range(1, 4) for i in range(28)]
    rows += [(40, i, "email") for i in range(5000, 5030)] + [(40, 1000 + i, None) for i in range(6)] + [(41, i, "email") for i in range(5000, 5030)]
    want = plain_scores(rows, 3, 3, 0.6)
    got = pii.score_patterns(spark.createDataFrame(rows, "pattern long, value long, kind string"), 3, 3, 0.6).collect()
    assert {r.pattern: r.kind for r in got} == {p: k for p, (k, _) in want.items()} and len(got) == len(want) > 4
    for r in got:
        assert abs(r.confidence - want[r.pattern][1]) < 1e-9
    one = pii.score_patterns(spark.createDataFrame(rows, "pattern long, value long, kind string"), 3, 3, 0.6, generations=1).count()
    assert one < len(got)


def test_query_digests(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = pii.op10_pii(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = brute(texts[r.doc_id])
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
