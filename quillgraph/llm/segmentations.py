"""Sampled SentencePiece segmentations without replacement, and decoding.

All segmentations of a text form a lattice; a segmentation's probability is the product of its pieces' weights to the power
``alpha``, over the sum of all. Gumbel top-k: every segmentation's log-probability gets Gumbel noise, and the k largest are
k draws without replacement. An A-star search finds them without listing the lattice: a node stands for all segmentations
that share a prefix and don't take some pieces next; its priority is the largest perturbed value below it, drawn top-down
as a truncated Gumbel (Kool et al., 2019), which is exact. So each popped node is the next sample, and it leaves a node for
each piece that it could have left otherwise. The inclusion score of a sample is the probability that it is among the k,
given the next largest value.

The lattice falls apart where no piece of the vocabulary spans two neighbouring characters. Such units are built once for
each slice of texts, for all of them at once, as are the free paths through them. A state holds only the pieces that can
come next in it, about two of them in prose. All noise is a hash of seed, row key, sample and place, so a
row's samples depend on nothing else.

A merge-ranked vocabulary has no weights: its pieces get Zipf's, 1 / (rank + 1).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from quillgraph.llm._words import _ranges, mix, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
#: Bytes of text whose lattices are held at once.
SLICE = 3 << 17
_GAP = 0x2581
#: Stands for U+2581 in a text, which must not be taken for a blank.
_OWN_GAP = 0x110000
_B = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD1342543DE82EF95)


@dataclass(frozen=True)
class Vocabulary:
    """A model's pieces as arrays: character classes, prefixes by hash, weights, and bytes for decoding.

    ``prefixes`` ascend; ``near`` has the place of the first one that is not below each value of their 18 leading bits.
    """

    classes: np.ndarray
    spanned: np.ndarray
    prefixes: np.ndarray
    near: np.ndarray
    piece: np.ndarray
    score: np.ndarray
    byte_ids: np.ndarray
    longest: int
    fallback: float
    flat: np.ndarray
    offsets: np.ndarray


@lru_cache(maxsize=4)
def load(model: str) -> Vocabulary:
    """A vocabulary from a model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    raw = np.array([sp.get_score(i) for i in range(n)])
    usual = raw[plain][raw[plain] > -1e8]
    ranked = len(usual) == 0 or bool((usual == np.round(usual)).all())
    score = np.zeros(n)
    if ranked:
        rank = np.where(raw > -1e8, -raw, float(n))
        weight = 1 / (rank[plain] + 1)
        score[plain] = np.log(weight / weight.sum())
    else:
        score[plain] = raw[plain]
    characters = sorted({c for i in plain for c in pieces[i]})
    classes = np.zeros(_OWN_GAP + 1, np.int32)
    classes[[ord(c) for c in characters]] = np.arange(1, len(characters) + 1)
    spanned = np.zeros((len(characters) + 1,) * 2, bool)
    prefixes: dict[int, int] = {}
    for i in plain:
        codes = classes[[ord(c) for c in pieces[i]]].tolist()
        spanned[codes[:-1], codes[1:]] = True
        h = 0
        for k, c in enumerate(codes):
            h = (h * int(_B) + c) & (1 << 64) - 1
            last = k == len(codes) - 1
            prefixes[h] = i if last else prefixes.get(h, -1)
    keys = np.array(list(prefixes), np.uint64) * _SPREAD
    order = np.argsort(keys)
    keys, ids = keys[order], np.array(list(prefixes.values()), np.int32)[order]
    near = np.searchsorted(keys, np.arange(1 << 18, dtype=np.uint64) << np.uint64(46)).astype(np.int32)
    byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
    texts = [bytes([int(pieces[i][3:5], 16)]) if sp.is_byte(i) else pieces[i].replace("▁", " ").encode() if not (sp.is_control(i) or sp.is_unknown(i)) else b"" for i in range(n)]
    return Vocabulary(
        classes, spanned, np.append(keys, ~np.uint64(0)), near, np.append(ids, np.int32(-1)), score, byte_ids, max(len(pieces[i]) for i in plain),
        float(score[plain].min()) - 10, np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]),
    )


@dataclass
class Lattice:
    """Units of a slice. ``first[s]`` to ``first[s + 1]`` are the pieces that may come next in state s, shorter ones first.

    ``share`` has the chance of each, ``sums`` the chances of those up to it (the last is infinite), ``size`` its length and
    ``piece`` its id (-1: by bytes).
    """

    start: np.ndarray
    end: np.ndarray
    code: np.ndarray
    first: np.ndarray
    share: np.ndarray
    sums: np.ndarray
    size: np.ndarray
    piece: np.ndarray


def _known(v: Vocabulary, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of these hashes are prefixes of pieces, and the piece of each of those (-1: a prefix only)."""
    key = h * _SPREAD
    i = v.near[(key >> np.uint64(46)).astype(np.int64)]
    held = v.prefixes[i]
    more = np.flatnonzero(held < key)
    while len(more):
        i[more] += 1
        held[more] = v.prefixes[i[more]]
        more = more[held[more] < key[more]]
    ok = np.flatnonzero(held == key)
    return ok, v.piece[i[ok]]


def build_lattice(v: Vocabulary, codes: np.ndarray, ends: np.ndarray, alpha: float) -> Lattice:
    """Characters of all texts (``ends`` of each) to units, with equal units sharing their states."""
    cls = v.classes[codes]
    n = len(codes)
    first = np.ones(n, bool)
    first[1:] = ~v.spanned[cls[:-1], cls[1:]]
    starts = ends[:-1]
    first[starts[starts < n]] = True
    begin = np.flatnonzero(first)
    stop = np.append(begin[1:], n)
    length = stop - begin
    _, at, of = np.unique(_ranges(mix(codes.astype(np.uint64) + np.uint64(1)), begin, stop, int(_B)), return_index=True, return_inverse=True)
    size = length[at]
    base = np.concatenate([[0], np.cumsum(size + 1)])
    total = int(base[-1])
    # One state more than characters for each unit; the last one ends it and is of no class that a piece holds.
    unit = np.repeat(np.arange(len(at)), size)
    offset = np.arange(len(unit)) - np.repeat(np.cumsum(size) - size, size)
    state, place = base[unit] + offset, begin[at][unit] + offset
    code, kind, left = np.zeros(total, codes.dtype), np.zeros(total, np.uint64), np.zeros(total, np.int64)
    code[state], kind[state], left[state] = codes[place], cls[place], size[unit] - offset
    found = []
    live, h = state, np.zeros(len(state), np.uint64)
    for k in range(v.longest):
        inside = np.flatnonzero(left[live] > k)
        live = live[inside]
        h = h[inside] * _B + kind[live + k]
        ok, i = _known(v, h)
        live, h = live[ok], h[ok]
        whole = np.flatnonzero(i >= 0)
        found.append((live[whole], i[whole], v.score[i[whole]] * alpha))
        if k == 0:
            lone = np.ones(total, bool)
            lone[live[whole]] = False
            lone[base[1:] - 1] = False
            lone = np.flatnonzero(lone)
            by = np.full(len(lone), -1, np.int32)
            single = code[lone] < 128
            by[single] = v.byte_ids[code[lone[single]]]
            found.append((lone, by, np.full(len(lone), v.fallback * alpha)))
        if not len(live):
            break
    count = np.zeros(total, np.int64)
    for states, _, _ in found:
        count[states] += 1
    first = np.concatenate([[0], np.cumsum(count)])
    piece, score, reach = np.zeros(first[-1], np.int32), np.zeros(first[-1]), np.zeros(first[-1], np.int64)
    free = first[:-1].copy()
    # Pieces of one character, characters without one, then pieces of two, three and so on.
    for k, (states, i, x) in enumerate(found):
        e = free[states]
        piece[e], score[e], reach[e] = i, x, max(k, 1)
        free[states] = e + 1
    # The best of each state by what is left of its unit, as the rest comes first.
    order = state[np.argsort(left[state].astype(np.min_scalar_type(int(left.max(initial=0)))), kind="stable")]
    cuts = np.searchsorted(left[order], np.arange(1, int(left.max(initial=0)) + 2))
    many = count[order]
    where = np.concatenate([[0], np.cumsum(many)])
    edge = np.arange(where[-1]) + np.repeat(first[order] - where[:-1], many)
    score, target = score[edge], np.repeat(order, many) + reach[edge]
    best, part = np.zeros(total), np.zeros(len(edge))
    for r in range(1, len(cuts)):
        a, b = cuts[r - 1], cuts[r]
        if a == b:
            continue
        lo, hi = where[a], where[b]
        heads, number = where[a:b] - lo, many[a:b]
        x = score[lo:hi] + best[target[lo:hi]]
        top = np.maximum.reduceat(x, heads)
        x = np.exp(x - np.repeat(top, number))
        whole = np.add.reduceat(x, heads)
        part[lo:hi] = x / np.repeat(whole, number)
        best[order[a:b]] = top + np.log(whole)
    share, sums = np.zeros(len(edge)), np.zeros(len(edge))
    share[edge] = part
    # Sums within a state; rounding may leave the last one off 1, and no piece comes after it.
    live, e = state, first[state]
    sums[e] = share[e]
    for k in range(1, int(count.max(initial=0))):
        live = live[count[live] > k]
        e = first[live] + k
        sums[e] = sums[e - 1] + share[e]
    sums[first[state + 1] - 1] = np.inf
    return Lattice(base[of], base[of] + size[of], code, first, share, sums, reach, piece)


def _hashed(key: np.ndarray, *parts: np.ndarray | int) -> np.ndarray:
    h = key
    for p in parts:
        h = mix(h ^ (np.atleast_1d(p).astype(np.uint64) * _B + np.uint64(0x632BE59BD9B4E019)))
    return h


def _share_of(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _uniform(key: np.ndarray, *parts: np.ndarray | int) -> np.ndarray:
    return _share_of(_hashed(key, *parts))


def _left(lat: Lattice, states: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Chances of the pieces of each state, without those whose bits are set."""
    count = lat.first[states + 1] - lat.first[states]
    k = np.arange(int(count.max(initial=1)))
    there = (k < count[:, None]) & ((out[:, None] >> k) & 1 == 0)
    return np.where(there, lat.share[np.where(there, lat.first[states][:, None] + k, 0)], 0.0)


def _free_paths(lat: Lattice, at: np.ndarray, unit: np.ndarray, own: np.ndarray, key: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From each unit's state to its end by chance: (row of each step, its state, its place among the pieces), by row and step."""
    end, start = lat.end[unit], lat.start[unit]
    # The noise of a step is that of its row, mixed with its place.
    noise = _hashed(key, turn, own[unit])
    paths = []
    size = np.zeros(len(at), np.int64)
    live = np.flatnonzero(at < end)
    s, noise, begin, end = at[live], noise[live], start[live], end[live]
    while len(live):
        u = _share_of(_hashed(noise, s - begin))
        e = lat.first[s]
        more = np.flatnonzero(lat.sums[e] <= u)
        while len(more):
            e[more] += 1
            more = more[lat.sums[e[more]] <= u[more]]
        paths.append((live, s, e))
        size[live] += 1
        s = s + lat.size[e]
        on = np.flatnonzero(s < end)
        live, s, noise, begin, end = live[on], s[on], noise[on], begin[on], end[on]
    head = np.cumsum(size) - size
    states, edges = np.zeros(int(size.sum()), np.int64), np.zeros(int(size.sum()), np.int64)
    for k, (live, s, e) in enumerate(paths):
        i = head[live] + k
        states[i], edges[i] = s, e
    return np.repeat(np.arange(len(at)), size), states, edges


def _truncated(location: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A Gumbel draw at ``location``, given that it is below ``bound``."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        out = location - np.log(np.exp(np.clip(location - bound, None, 700)) - np.log(u))
    return np.where(np.isneginf(location), -np.inf, np.minimum(out, bound))


def sample_texts(v: Vocabulary, texts: list[str], keys: np.ndarray, k: int, alpha: float = 1.0, seed: int = 0) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k distinct segmentations by falling perturbed value: (ids, log-probability, that value, inclusion)."""
    parts = [np.frombuffer((" " + t if t else "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    if not ends[-1]:
        return [[(np.zeros(0, np.int32), 0.0, 0.0, 1.0)] for _ in texts]
    codes = np.concatenate(parts).astype(np.int64)
    codes = np.where(codes == _GAP, _OWN_GAP, np.where(codes == 32, _GAP, codes))
    lat = build_lattice(v, codes, ends, alpha)
    lengths = lat.end - lat.start
    unit_end = np.cumsum(lengths)
    unit_of = np.searchsorted(unit_end - lengths, ends)
    n = len(texts)
    key = mix(keys.astype(np.uint64) + mix(np.array([seed], np.uint64) + _B))
    doc_of_unit = np.repeat(np.arange(n), np.diff(unit_of))
    own = np.arange(len(lat.start)) - unit_of[doc_of_unit]
    root = -np.log(-np.log(_uniform(key, 0, np.full(n, 1 << 40))))
    # Of each text: its samples (unit, state, piece's place, log-probability before each step; perturbed value; log-probability),
    # and its open nodes (value, sample, step, pieces that aren't taken there).
    samples: list[list[tuple]] = [[] for _ in texts]
    nodes: list[list[tuple[float, int, int, int]]] = [[(float(g), -1, -1, 0)] for g in root]
    kappa = np.full(n, -np.inf)
    for turn in range(k + 1):
        jobs = []
        for d in range(n):
            if nodes[d]:
                top = max(nodes[d])
                if turn == k:
                    kappa[d] = top[0]
                else:
                    nodes[d].remove(top)
                    jobs.append((d, *top))
        if turn == k or not jobs:
            break
        docs = np.array([j[0] for j in jobs])
        state, from_unit = np.zeros(len(jobs), np.int64), np.zeros(len(jobs), np.int64)
        taken = np.zeros(len(jobs), np.int64)
        branch = [i for i, j in enumerate(jobs) if j[2] >= 0]
        if branch:
            s = np.array([samples[jobs[i][0]][jobs[i][2]][1][jobs[i][3]] for i in branch])
            out = np.array([jobs[i][4] for i in branch])
            sums = np.cumsum(_left(lat, s, out), axis=1)
            u = _uniform(key[docs[branch]], turn, (1 << 41) + np.array([jobs[i][3] for i in branch]))
            c = lat.first[s] + (sums <= (u * sums[:, -1])[:, None]).sum(axis=1)
            taken[branch], state[branch] = c, s + lat.size[c]
            from_unit[branch] = [samples[jobs[i][0]][jobs[i][2]][0][jobs[i][3]] for i in branch]
        # Units still to be walked: the rest of the branch's own, then all after it.
        begin = unit_of[docs] + from_unit
        count = unit_of[docs + 1] - begin
        job = np.repeat(np.arange(len(jobs)), count)
        unit = np.arange(len(job)) - np.repeat(np.cumsum(count) - count, count) + begin[job]
        at = lat.start[unit].copy()
        heads = (np.cumsum(count) - count)[branch] if branch else np.zeros(0, np.int64)
        at[heads] = state[branch]
        row, states, edges = _free_paths(lat, at, unit, own, key[docs[job]], turn)
        # Each job's new steps: the one it branches by, if any, then those of its free path; all jobs at once.
        job_of = job[row]
        cut = np.searchsorted(job_of, np.arange(len(jobs) + 1))
        where = cut[branch]
        old = np.array([j[2] for j in jobs])
        low = np.where(old >= 0, [j[3] for j in jobs], 0)
        s = np.insert(states, where, [samples[jobs[i][0]][jobs[i][2]][1][jobs[i][3]] for i in branch])
        m = np.insert(edges, where, taken[branch])
        u = np.insert(own[unit[row]], where, from_unit[branch])
        cut = cut + np.concatenate([[0], np.cumsum(old >= 0)])
        size = np.diff(cut)
        job_of = np.repeat(np.arange(len(jobs)), size)
        with np.errstate(divide="ignore", invalid="ignore"):
            share = lat.share[m]
            logs, rest = np.log(share), np.log1p(-np.minimum(share, 1.0))
        sums = np.concatenate([[0.0], np.cumsum(logs)])
        prefix = np.array([samples[d][o][3][e] if o >= 0 else 0.0 for d, _, o, e, _ in jobs])
        before = sums[:-1] - sums[cut[:-1]][job_of] + prefix[job_of]
        bits = np.int64(1) << (m - lat.first[s])
        heads = cut[:-1][branch]
        if branch:
            bits[heads] |= np.array([jobs[i][4] for i in branch])
            free = _left(lat, s[heads], bits[heads]).sum(axis=1)
            with np.errstate(divide="ignore"):
                rest[heads] = np.where(free > 1e-12, np.log(free), -np.inf)
        value = np.array([j[1] for j in jobs])
        at_step = np.arange(len(s)) - cut[:-1][job_of] + low[job_of]
        drawn = _truncated(before + rest, value[job_of], _uniform(_hashed(key[docs], turn)[job_of], (1 << 42) + at_step))
        want = k - turn
        for i, (d, g, o, e, _) in enumerate(jobs):
            a, b = cut[i], cut[i + 1]
            head = samples[d][o] if o >= 0 else None
            total = before[b - 1] + logs[b - 1] if b > a else 0.0
            path = [x[a:b] if head is None else np.concatenate([y[:e], x[a:b]]) for x, y in zip((u, s, m, before), head[:4] if head else (None,) * 4, strict=True)]
            samples[d].append((*path, g, float(total)))
            x = drawn[a:b]
            pick = np.argpartition(-x, want)[:want] if b - a > want else np.arange(b - a)
            nodes[d] += [(float(x[q]), len(samples[d]) - 1, int(low[i] + q), int(bits[a + q])) for q in pick if x[q] > -np.inf]
    result = []
    for d in range(n):
        rows = []
        for _, s, m, _, value, logp in samples[d]:
            ids = lat.piece[m]
            if (ids < 0).any():
                ids = _by_bytes(v, lat, s, ids)
            inclusion = 1.0 if np.isneginf(kappa[d]) else float(-np.expm1(-np.exp(min(700.0, logp - kappa[d]))))
            rows.append((ids, logp, value, inclusion))
        result.append(rows)
    return result


def _by_bytes(v: Vocabulary, lat: Lattice, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out, last = [], 0
    for i in np.flatnonzero(ids < 0).tolist():
        c = int(lat.code[states[i]])
        out += [ids[last:i], v.byte_ids[list(chr(_GAP if c == _OWN_GAP else c).encode("utf-8", "surrogatepass"))]]
        last = i + 1
    return np.concatenate([*out, ids[last:]])


def decode_ids(v: Vocabulary, flat: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Bytes of each run of ids; the blank that encoding puts first is taken off again."""
    size = np.diff(v.offsets)[flat]
    stop = np.cumsum(size)
    place = np.arange(int(stop[-1]) if len(stop) else 0) - np.repeat(stop - size, size) + np.repeat(v.offsets[flat], size)
    data = v.flat[place].tobytes()
    bounds = np.concatenate([[0], stop])[ends].tolist()
    return [data[a + 1 : b] if data[a : a + 1] == b" " and a < b else data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def sample_segmentations(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SAMPLES, alpha: float = 1.0, seed: int = 0, model: str = MODEL, keep_text: bool = False) -> DataFrame:
    """A row for each sample: the columns of ``docs`` but the text, then rank (from 0), ids, log_prob, perturbed, inclusion.

    A text with fewer than k segmentations has one row for each, with inclusion 1. Null and empty texts have one, without
    pieces. Rows with equal key and text have equal samples; a null key is a key like any other. Columns of ``docs`` with
    the names of new ones are replaced. Decoding gives back every text exactly. An empty table gives an empty table.
    """
    new = [StructField("rank", IntegerType()), StructField("ids", ArrayType(IntegerType())), *(StructField(c, DoubleType()) for c in ("log_prob", "perturbed", "inclusion"))]
    taken = {f.name for f in new} | (set() if keep_text else {text})
    others = [c for c in docs.columns if c not in taken]
    source = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.xxhash64(F.col(f"`{key}`"), F.col(f"`{key}`").isNull()).alias("_key"), F.col(f"`{text}`").alias("_text"))
    n = len(others)
    schema = StructType([*(StructField(c, f.dataType) for c, f in zip(others, source.schema.fields, strict=False)), *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(model)
        for b in batches:
            column = b.column(n + 1)
            for lo, hi, _, _ in slices(column, SLICE):
                texts = [x or "" for x in column[lo:hi].to_pylist()]
                found = sample_texts(v, texts, b.column(n)[lo:hi].to_numpy(), k, alpha, seed)
                counts = [len(x) for x in found]
                rows = [r for x in found for r in x]
                ends = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[0] for r in rows]).astype(np.int32)))
                rank = np.concatenate([np.arange(c) for c in counts]).astype(np.int32)
                index = pa.array(np.repeat(np.arange(lo, hi), counts))
                yield pa.RecordBatch.from_arrays([*(c.take(index) for c in b.columns[:n]), pa.array(rank), ids, *(pa.array([r[i] for r in rows], pa.float64()) for i in (1, 2, 3))], names=schema.names)

    return source.mapInArrow(run, schema)


def decode(rows: DataFrame, ids: str = "ids", out: str = "text", model: str = MODEL) -> DataFrame:
    """``rows`` with the text of their ids instead of these. Null ids give a null text; ids out of range fail the job."""
    others = [c for c in rows.columns if c not in (ids, out)]
    source = rows.select(*[f"`{c}`" for c in (*others, ids)])
    schema = StructType([*source.schema.fields[:-1], StructField(out, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(model)
        for b in batches:
            column = b.column(len(others))
            ends, flat = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy(zero_copy_only=False)
            found: list[str] = []
            while len(found) < len(column):
                a = len(found)
                z = max(a + 1, int(np.searchsorted(ends, ends[a] + SLICE, "right")) - 1)
                found += [t.decode("utf-8", "replace") for t in decode_ids(v, flat[ends[a] : ends[z]], ends[a : z + 1] - ends[a])]
            texts = pa.array([None if null else t for t, null in zip(found, column.is_null().to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], texts], names=schema.names)

    return source.mapInArrow(run, schema)


def op4_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document, with the checksum of what they decode to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    sampled = sample_segmentations(docs).withColumns({"n_pieces": F.size("ids"), "ids_hash": F.xxhash64("ids")})
    return decode(sampled).withColumn("text_crc32", F.crc32("text")).drop("text")


QUERIES = {"op4_segmentations": op4_segmentations}
SQL: dict[str, str] = {}
