import random

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillgraph.llm import token_counts as t

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    count, library = t.Counter(t.ByteVocabulary.read(PATH)), Tokenizer.from_file(PATH)
    return count, lambda text: len(library.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_counts_as_in_the_library(both, text):
    assert both[0](text) == both[1](text)


def test_spaces_marks_and_special_strings(both):
    rng = random.Random(3)
    parts = [*"ab' \t\n\r\x0b\x1c\x1d\x85\xa0 　᠎​sdmt19é!²Ⅷ𝔸𐄀ͅ՘₏", "'ll", "'re", "<|endoftext|>", "<|endoftext", "|>", "  ", "\U000105c0", "\U0001f600", "́"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert both[0](text) == both[1](text), repr(text)


def test_words_of_any_length(both):
    for text in ("a" * 70_001, "abcdefghij" * 3000, "é" * 5000, " " * 9000, "1" * 4097):
        assert both[0](text) == both[1](text)


def test_counts_do_not_depend_on_what_was_kept(both, monkeypatch):
    monkeypatch.setattr(t, "KEPT", 3)
    count = t.Counter(t.ByteVocabulary.read(PATH))
    texts = [f"word{i % 7} other{i % 5} word{i % 7}" for i in range(60)]
    assert [count(x) for x in texts] == [both[1](x) for x in texts] and len(count.counts) <= 3 >= len(count.counts.old)


def test_whole_documents(spark, sf, both):
    got = {r.doc_id: r for r in t.op13_token_counts(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        n = both[1](d.text or "")
        assert (got[d.doc_id].n_bytes, got[d.doc_id].n_tokens, got[d.doc_id].over_limit) == (len((d.text or "").encode()), n, n > 512)


def test_odd_frames(spark, both):
    rows = [(1, None), (1, None), (None, ""), (3, "a b<|endoftext|>c"), (4, "x " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(-1) for c in ("n_bytes", "n_tokens", "over_limit", "c0")})
    got = t.count_tokens(docs, PATH)
    assert got.columns == ["doc_id", "c0", "n_bytes", "n_tokens", "over_limit"]
    found = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect())
    assert found == [(0, 0, 0, False), (1, 0, 0, False), (1, 0, 0, False), (3, 17, both[1](rows[3][1]), False), (4, 400_000, both[1](rows[4][1]), True)]
    assert t.count_tokens(docs.limit(0), PATH).count() == 0


def test_other_kinds_are_refused():
    with pytest.raises(ValueError):
        t.ByteVocabulary.read(public_tokenizers.path("word_bpe_49k.json"))
