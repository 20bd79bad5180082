import re
import textwrap

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import licences
from quillgraph.llm._licence_texts import TEXTS


#: Licences with notices of their own inside: those are found by their paragraphs, which must be there.
WHOLE = {n for n, t in TEXTS.items() if "copyright" in re.sub(r"\s+", " ", t).lower() and len(t) > 5000}


def variants(name, text):
    yield text
    yield text.upper()
    yield "Copyright (c) 2020, 2021 Someone\nAll rights reserved.\n\n" + text
    yield "  (c) 1999 Acme, Inc.\n * Copyright: others\n© me\n#\n" + "\n".join("# " + x for x in text.split("\n"))
    if name not in WHOLE:
        yield re.sub(r"\s+", "\n\t ", text).replace('"', "“").replace("sublicense", "sub-licence").replace("NONINFRINGEMENT", "non-infringement")
    if name in ("MIT", "ISC", "BSD-3-Clause"):
        yield "Copyright 2020 Someone and\nothers with a long name " + text
        yield f"The {name} License\nCopyright (c) 2020 Someone\n\n" + text if name == "ISC" else "Copyright Someone\n" + text


def test_variants_are_found(spark):
    rows = [(f"{n} {i}", n, t) for n, text in TEXTS.items() for i, t in enumerate(variants(n, text)) if "The ISC" not in t]
    rows += [(f"{n} more", None, t + "\nMore.") for n, t in TEXTS.items()] + [(f"{n} less", None, t.strip()[:-40]) for n, t in TEXTS.items()]
    rows += [(f"{n} other word", None, re.sub(r"(?i)\bany\b", "some", t, count=1)) for n, t in TEXTS.items()]
    rows += [("titled", "MIT", "MIT License\nCopyright (c) 2020 Someone\n\n" + TEXTS["MIT"]), ("titled 2", "MIT", "MIT License\r\n\r\nCopyright (c) 2020 Someone\r\n\r\n" + TEXTS["MIT"].replace("\n", "\r\n"))]
    got = licences.scan_licences(spark.createDataFrame(rows, "doc_id string, want string, text string"), licences.known_licences(spark)).collect()
    assert [(r.doc_id, r.want, r.license_id) for r in got if r.license_id != r.want] == []


def test_copies_in_a_table(spark, sf):
    got = licences.license_copies(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/part.parquet").count()
    for r in got:
        assert r.license_id == (None if r.p_partkey % 20 == 0 else sorted(TEXTS)[r.p_partkey % len(TEXTS)])


def test_odd_rows(spark):
    rows = [(1, None), (1, None), (None, ""), (2, " .,;\n"), (3, "x" * 500_000), (4, "Copyright me\n" * 50_000), (5, TEXTS["MIT"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("c") for c in ("digest", "license_id", "found", "c0")})
    got = licences.scan_licences(docs, licences.known_licences(spark))
    assert sorted(got.columns) == sorted([*docs.columns, "license_digest"])
    assert sorted(r.license_id or "" for r in got.collect()) == [""] * 6 + ["MIT"]
    assert licences.scan_licences(docs.limit(0), licences.known_licences(spark)).count() == 0
    none = licences.scan_licences(docs, licences.known_licences(spark).limit(0))
    assert none.count() == 7 and none.where("license_id is not null").count() == 0


def test_plan_is_native(spark, sf):
    plan = licences.op9_license_digests(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapIn", plan)


@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_wrapped_texts_are_found(spark, mark):
    rows = []
    for name, text in TEXTS.items():
        for width in (*range(40, 121), 10_000) if name in WHOLE else (*range(14, 121), 10_000):
            wrapped = "\n\n".join(textwrap.fill(part, width, break_long_words=False, break_on_hyphens=width % 2 > 0) for part in re.split(r"\n\s*\n", text))
            rows.append((f"{name} {width}", name, "Copyright (c) 2020 Someone\n\n" + "\n".join(mark + x for x in wrapped.split("\n"))))
    rows.append(("isc as distributed", "ISC", TEXTS["ISC"].replace("above copyright notice and", "above\ncopyright notice and")))
    rows.append(("a holder's notice", "MIT", "Copyright holders: A, B\nCopyright holder 2020 A\nCopyright Someone\n" + TEXTS["MIT"]))
    got = licences.scan_licences(spark.createDataFrame(rows, "doc_id string, want string, text string"), licences.known_licences(spark)).collect()
    assert [(r.doc_id, r.want, r.license_id) for r in got if r.license_id != r.want] == []


def test_licence_copies_are_dealt_to_tasks(spark, sf):
    parts = spark.read.parquet(f"{sf}/part.parquet").count()
    assert licences.license_copies(spark, sf, rows=50).rdd.getNumPartitions() >= parts // 50 > 1


def test_quick_forms_give_what_the_steps_say(spark):
    """The steps as they stand, in Python, on texts made of openings, signs and marks."""
    import random
    import re

    rng = random.Random(3)
    pieces = [*licences.OPENINGS, "copyright", "(c)", "©", "all rights reserved", "\n\n", "\n \n", " ", "  ", "—", "\xa0", "_", "\x00", "\x01", "\x7f", "a", "é", "9", "the mit licence", "licen", "x", ".", "-"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 25))) for _ in range(2000)]

    def plain(t):
        if any(sign in t for sign in licences.SIGNS):
            for pattern, new in licences.STEPS:
                t = re.sub(pattern, new.replace("{1}", "\\1").replace("{2}", "\\2"), t)
        t = f" {re.sub(licences.PUNCTUATION, ' ', t)} "
        for old, new in licences.SPELLINGS:
            t = t.replace(old, new)
        return t.strip(" ")

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", licences.canonical(F.col("t")).alias("c"))
    assert [r.c for r in got.collect()] == [plain(t) for t in texts]
    assert set(licences._QUICK) <= {p for p, _ in licences.STEPS} and set(licences._EACH) == {chr(i) for i in range(0x3000) if re.match(licences.PUNCTUATION, chr(i))}
