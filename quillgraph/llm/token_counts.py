"""Token counts of byte-level BPE vocabularies, without making the tokens' ids.

A text is cut at special strings, each one token, and the rest into words by the vocabulary's pattern. A word starts as its
bytes, a linked list. A heap holds the adjacent pairs that have a rank; the lowest (of ties the leftmost) is popped and
merged, and the pairs with its new neighbours are pushed. A popped pair whose ends have changed meanwhile is passed over. The
word's count is its bytes less its merges. A merge costs the logarithm of the word's length, so a text without blanks needs
no rule of its own.

Counting is one narrow pass: no shuffle, one dictionary of word counts of bounded size in each task. The vocabulary is read
on the driver and broadcast: its size is that of its merges, whatever the input.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from quillgraph.llm._words import slices

LIMIT = 512
MODEL = "byte_bpe_50k.json"
#: Counts of words that a Python worker keeps, twice over: those met since the last change of generation, and those before.
#: Longer words than LONGEST aren't kept.
KEPT = 1 << 18
LONGEST = 64
#: Fixed: how byte-level vocabularies split a text into words; {L}, {N} and {S} stand for letters, numbers and white space.
PATTERN = "'(?:[stmd]|re|ve|ll)| ?(?:[{L}]+|[{N}]+|[^{S}{L}{N}]+)|[{S}]+(?![^{S}])|[{S}]+"
#: Fixed: white space in Unicode.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


#: Fixed: letters and numbers of Unicode 16, which the vocabulary's library follows, that Unicode 15 doesn't have.
LATER = {
    "L": "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b-1138b 1138e-1138e 11390-113b5 "
    "113b7-113b7 113d1-113d1 113d3-113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff-18cff 1e5d0-1e5ed 1e5f0-1e5f0",
    "N": "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa",
}


def _ranges(kind: str, end: int) -> str:
    """Code points below ``end`` of a general category, as ranges of a character class: those of Python's tables (Unicode 15
    at least) and ``LATER``."""
    out: list[list[int]] = []
    for c in range(end):
        if unicodedata.category(chr(c))[0] == kind:
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
    out += [[int(x, 16) for x in r.split("-")] for r in LATER[kind].split()]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out if b < end)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


@dataclass(frozen=True)
class ByteVocabulary:
    """Merges in order of rank as (left, right, merged) ids, each byte's id, strings that are one token each, and the word
    patterns: for texts without code points beyond 0xFFFF, whose classes are fast, and for all."""

    merges: tuple[tuple[int, int, int], ...]
    first: tuple[int, ...]
    special: tuple[str, ...]
    patterns: tuple[str, str]

    @classmethod
    def read(cls, path: str) -> ByteVocabulary:
        """From a ``tokenizers`` file with byte-level BPE; other kinds are refused."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        marked = any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"] or not plain or marked:
            raise ValueError(f"{path} isn't a plain byte-level BPE vocabulary")
        ids = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        patterns = tuple(PATTERN.format(L=_ranges("L", end), N=_ranges("N", end), S=SPACE) for end in (0x10000, 0x110000))
        return cls(tuple((ids[a], ids[b], ids[a + b]) for a, b in pairs), tuple(ids[c] for c in _byte_letters()), tuple(t["content"] for t in spec["added_tokens"]), patterns)


class Counter:
    """Counts tokens of whole texts; keeps the counts of words met lately."""

    def __init__(self, v: ByteVocabulary):
        self.first = v.first
        ranks: dict[int, dict[int, int]] = {}
        for rank, (a, b, _) in enumerate(v.merges):
            ranks.setdefault(a, {})[b] = rank
        none: dict[int, int] = {}
        #: By left id: the rank of the pair with a right id.
        self.rank = [ranks.get(i, none).get for i in range(max(max(v.first), *(max(m) for m in v.merges)) + 1 if v.merges else max(v.first) + 1)]
        self.merged = [m for *_, m in v.merges]
        self.pairs = [self.rank[a](b) for a in v.first for b in v.first]
        self.special = re.compile("|".join(map(re.escape, sorted(v.special, key=len, reverse=True)))) if v.special else None
        self.plain, self.full = map(re.compile, v.patterns)
        self.counts = _Kept(self.word)

    def word(self, word: bytes) -> int:
        """Tokens of one word: its bytes less the merges that the heap of ranked pairs allows."""
        n = len(word)
        bits = n.bit_length()
        heap = [r << bits | i for i, (a, b) in enumerate(zip(word, word[1:])) if (r := self.pairs[a << 8 | b]) is not None]  # noqa: B905
        if not heap:
            return n
        heapq.heapify(heap)
        rank, mask, left = self.rank, (1 << bits) - 1, n
        # A linked list of symbols; -1 marks the end and symbols that are merged into the one before them.
        symbol = [self.first[b] for b in word]
        symbol.append(-1)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        while heap:
            x = heapq.heappop(heap)
            i, r = x & mask, x >> bits
            a, j = symbol[i], after[i]
            if a < 0 or rank[a](symbol[j]) != r:
                continue
            m = symbol[i] = self.merged[r]
            symbol[j] = -1
            left -= 1
            j = after[i] = after[j]
            before[j] = i
            r = rank[m](symbol[j])
            if r is not None:
                heapq.heappush(heap, r << bits | i)
            j = before[i]
            if j >= 0:
                r = rank[symbol[j]](m)
                if r is not None:
                    heapq.heappush(heap, r << bits | j)
        return left

    def __call__(self, text: str, far: bool = True) -> int:
        """``far``: whether a code point may be beyond 0xFFFF."""
        words, count = (self.full if far else self.plain).findall, self.counts.__getitem__
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(sum(map(count, words(x))) for x in parts)
        return sum(map(count, words(text)))


class _Kept(dict):
    """Counts by word: a full dictionary becomes the old one, whose words come back when they are met again."""

    def __init__(self, count):
        super().__init__()
        self.count, self.old = count, {}

    def __missing__(self, word: str) -> int:
        n = self.old.get(word)
        if n is None:
            n = self.count(word.encode())
            if len(word) > LONGEST:
                return n
        if len(self) >= KEPT:
            self.old = dict(self)
            self.clear()
        self[word] = n
        return n


@lru_cache(maxsize=2)
def _counter(v: ByteVocabulary) -> Counter:
    return Counter(v)


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``docs`` without its text, and with n_bytes (UTF-8), n_tokens and over_limit (more tokens than ``limit``).

    Counts are those of the ``tokenizers`` library for the file at ``path`` without added tokens, special strings inside a
    text being one token each, and without truncation. A null text counts as empty: no bytes, no tokens. Any length of text,
    and any length of a word, is counted whole. Repeated rows and keys are rows like any other; no other column is read, and
    ones with the names of the new columns are replaced. An empty table gives an empty table. ``path`` is read on the driver.
    """
    new = [StructField("n_bytes", LongType(), False), StructField("n_tokens", LongType(), False), StructField("over_limit", BooleanType(), False)]
    others = [c for c in docs.columns if c not in {text, *(f.name for f in new)}]
    source = docs.select(*[f"`{c}`" for c in (*others, text)])
    schema = StructType([*source.schema.fields[:-1], *new])
    vocabulary = docs.sparkSession.sparkContext.broadcast(ByteVocabulary.read(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(vocabulary.value)
        for b in batches:
            column, sizes, tokens = b.column(len(others)), [], []
            for lo, hi, data, offsets in slices(column):
                sizes += np.diff(offsets).tolist()
                far = bool((data >= 0xF0).any())
                tokens += [count(x, far) if x else 0 for x in column[lo:hi].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=schema.names)

    return source.mapInArrow(run, schema)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document's whole text by the 50k byte-level vocabulary, and whether they pass 512."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path(MODEL))


QUERIES = {"op13_token_counts": op13_token_counts}
SQL: dict[str, str] = {}
