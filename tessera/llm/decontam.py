"""Benchmark decontamination by the q-gram lemma.

An item of ``m`` characters that occurs in a document with at most ``e`` edits
shares at least ``m - q + 1 - q * e`` of its q-grams with it, all on diagonals
(document position minus item position) that lie within ``e`` of each other.
So shared q-grams are counted in overlapping bands of diagonals; bands that
reach the bound are verified by an alignment limited to the band.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BASE = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 20
#: Hits of q-grams times their places in items that are expanded at a time (but for a window of the least size).
_POSTINGS = 1 << 20


def normalise(text: str | None) -> str:
    """Lower case with single spaces."""
    return " ".join((text or "").lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of each q-gram."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(codes) - q + 1, np.uint64)
    for k in range(q):
        h = h * _BASE + codes[k : len(codes) - q + 1 + k].astype(np.uint64)
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Index:
    """Q-grams of a bounded set of items."""

    ids: tuple[int, ...]
    texts: tuple[str, ...]
    q: int
    budget: np.ndarray  # edits allowed for each item
    bound: np.ndarray  # q-grams that a band must share
    grams: np.ndarray  # distinct, sorted
    starts: np.ndarray  # postings of each gram
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray  # by the leading bits of a gram


_BITS = 22


def build(items: list[tuple[int, str]], q: int, rate: float) -> Index:
    """Items of fewer than ``q`` characters can't be found by q-grams and are left out."""
    kept = [(i, n) for i, t in items if len(n := normalise(t)) >= q]
    sizes = np.array([len(t) for _, t in kept], np.int64)
    budget = np.minimum((sizes * rate).astype(np.int64), np.maximum(0, (sizes - q) // q))
    bound = sizes - q + 1 - q * budget
    parts = [_grams(_codes(t), q) for _, t in kept]
    h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    item = np.repeat(np.arange(len(kept)), [len(p) for p in parts]) if parts else np.zeros(0, np.int64)
    place = np.concatenate([np.arange(len(p)) for p in parts]) if parts else np.zeros(0, np.int64)
    o = np.argsort(h, kind="stable")
    grams, starts = np.unique(h[o], return_index=True)
    seen = np.zeros(1 << _BITS, bool)
    seen[(grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    return Index(tuple(i for i, _ in kept), tuple(t for _, t in kept), q, budget, bound, grams, np.r_[starts, len(h)], item[o], place[o], seen)


def banded_distance(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int]:
    """Fewest edits of ``item`` in ``text`` on diagonals ``low .. high``, and where that match starts and ends; ``most + 1`` if more."""
    width, m = high - low + 1, len(item)
    far = 1 << 20
    cols = np.arange(width)
    at = low + cols  # text position before row 0
    cost = np.where((at >= 0) & (at <= len(text)), 0, far)
    start = at.copy()
    for r in range(m):
        at = low + r + cols
        ok = (at >= 0) & (at < len(text))
        same = np.zeros(width, bool)
        same[ok] = text[at[ok]] == item[r]
        diagonal = np.where(ok, cost + ~same, far)
        deletion = np.r_[cost[1:] + 1, far]
        new = np.minimum(diagonal, deletion)
        begin = np.where(diagonal <= deletion, start, np.r_[start[1:], 0])
        # insertions run along the row
        run = np.minimum.accumulate(new - cols)
        source = np.maximum.accumulate(np.where(new - cols == run, cols, 0))
        cost, start = run + cols, begin[source]
        cost = np.where((at + 1 >= 0) & (at + 1 <= len(text)), cost, far)
        if cost.min() > most:
            return most + 1, -1, -1
    k = int(np.argmin(cost))
    return int(cost[k]), int(start[k]), low + m + k


def scan(index: Index, text: str | None) -> list[tuple[int, int, int, int]]:
    """``(item, start, end, edits)`` of the items found in the whole normalised text: the best match of each.

    Ties go to the earliest start.  Hits are expanded to diagonals in windows of the
    text that overlap by the longest item and its edits, so that every match lies
    whole in one of them; windows shrink where q-grams are common, so the memory
    depends on the index and not on the text.
    """
    norm = normalise(text)
    if not index.ids or len(norm) < index.q:
        return []
    codes = _codes(norm)
    spots, hits = [], []
    for at in range(0, len(codes) - index.q + 1, _CHUNK):  # long texts in bounded memory
        h = _grams(codes[at : at + _CHUNK + index.q - 1], index.q)
        maybe = np.nonzero(index.seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)])[0]
        k = np.minimum(np.searchsorted(index.grams, h[maybe]), len(index.grams) - 1)
        real = index.grams[k] == h[maybe]
        spots.append(maybe[real] + at)
        hits.append(k[real])
    spot, hit = np.concatenate(spots), np.concatenate(hits)
    if len(spot) < index.bound.min():
        return []
    sizes = np.cumsum(index.starts[hit + 1] - index.starts[hit])
    if sizes[-1] <= _POSTINGS:
        best = _matches(index, norm, codes, spot, hit)
    else:
        best: dict[int, tuple[int, int, int]] = {}
        longest = max(map(len, index.texts)) + int(index.budget.max()) + index.q
        at, done = 0, -1
        while at < len(spot) and done < spot[-1]:
            most = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _POSTINGS, "right"))
            done = max(int(spot[min(most, len(spot)) - 1]), int(spot[at]) + 2 * longest)
            end = int(np.searchsorted(spot, done, "right"))
            for k, m in _matches(index, norm, codes, spot[at:end], hit[at:end]).items():
                if k not in best or (m[2], m[0]) < (best[k][2], best[k][0]):
                    best[k] = m
            at = int(np.searchsorted(spot, done - longest, "right"))
    return [(index.ids[k], *m) for k, m in sorted(best.items())]


def _matches(index: Index, norm: str, codes: np.ndarray, spot: np.ndarray, hit: np.ndarray) -> dict[int, tuple[int, int, int]]:
    """The best match of each item, by number, as ``(start, end, edits)``, among q-grams ``hit`` at places ``spot``."""
    n = index.starts[hit + 1] - index.starts[hit]
    posting = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(index.starts[hit], n)
    item = index.item[posting]
    enough = np.bincount(item, minlength=len(index.ids)) >= index.bound
    keep = enough[item]
    if not keep.any():
        return {}
    item = item[keep]
    diagonal = np.repeat(spot, n)[keep] - index.place[posting[keep]]
    width = index.budget[item] + 1
    band = (diagonal + (1 << 30)) // width
    # counts by a hash of item and band are never too small: most bands end here, without sorting
    size = max(10, int(4 * len(item)).bit_length())
    slot = lambda b: ((((item << 34) | b).astype(np.uint64) * _BASE) >> np.uint64(64 - size)).astype(np.int64)
    at = slot(band)
    table = np.bincount(at, minlength=1 << size)
    own, bound = table[at], index.bound[item]
    open_ = (own + table[slot(band + 1)] >= bound) | (own + table[slot(band - 1)] >= bound)
    if not open_.any():
        return {}
    item, band = item[open_], band[open_]
    # each hit counts in its own band and in the one before, which overlaps it
    key = np.concatenate([item << 34 | band, item << 34 | (band - 1)])
    keys, of, counts = np.unique(key, return_inverse=True, return_counts=True)
    owner = keys >> 34
    good = counts >= index.bound[owner]
    if not good.any():
        return {}
    # the bound is on q-grams of the item: one that hits several times in a band counts once
    place = np.tile(index.place[posting[keep][open_]], 2)[good[of]]
    longest = int(place.max()) + 1
    once = np.unique(of[good[of]] * longest + place) // longest
    good = np.bincount(once, minlength=len(keys)) >= index.bound[owner]
    best: dict[int, tuple[int, int, int]] = {}
    for k, b in zip(owner[good].tolist(), (keys[good] & ((1 << 34) - 1)).tolist(), strict=True):
        e, w = int(index.budget[k]), int(index.budget[k]) + 1
        low, high = b * w - (1 << 30) - e, (b + 2) * w - 1 - (1 << 30) + e
        text_k = index.texts[k]
        left, right = max(0, low), min(len(codes), high + len(text_k))
        exact = norm.find(text_k, left, right)
        if exact >= 0:
            best[k] = min(best.get(k, (e + 1, 0, 0)), (0, exact, exact + len(text_k)))
            continue
        if k in best and best[k][0] == 0:
            continue
        edits, s, t = banded_distance(_codes(text_k), codes, low, high, e)
        if edits <= e and (k not in best or (edits, s) < best[k][:2]):
            best[k] = (edits, s, t)
    return {k: (s, t, edits) for k, (edits, s, t) in best.items()}


def _indexes(items: DataFrame, q: int, rate: float, most_chars: int) -> Iterator[Index]:
    """Indexes over parts of the items, each of at most ``most_chars`` characters (but for a longer item alone)."""
    part: list[tuple[int, str]] = []
    size = 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        if part and size + len(r["text"]) > most_chars:
            yield build(part, q, rate)
            part, size = [], 0
        part.append((r["item_id"], r["text"]))
        size += len(r["text"])
    yield build(part, q, rate)


def contaminated(docs: DataFrame, items: DataFrame, q: int = 6, rate: float = 0.125, most_chars: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, start, end, edits)``: items found in documents with at most ``rate`` edits a character.

    Positions are those of the normalised text (lower case, single spaces).
    Items are broadcast in parts of bounded size; a larger benchmark takes one
    more scan of the documents for each ``most_chars`` of it, not more memory
    (benchmarks are small beside a corpus; the driver reads them a row at a time).
    Null or short texts match nothing; texts are scanned whole, long ones in windows;
    null items and those of fewer than ``q`` characters are left out; an item
    or document that is repeated gives a row each; empty tables give none; other
    columns are not read, so their names can't clash.
    """
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    context = docs.sparkSession.sparkContext
    out = None
    for index in _indexes(items, q, rate, most_chars):
        shared = context.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(i, *m) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for m in scan(shared.value, t.as_py())]
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["doc_id", "item_id", "start", "end", "edits"])

        found = text.mapInArrow(run, "doc_id long, item_id long, start long, end long, edits long")
        out = found if out is None else out.union(found)
    return out


def clean(docs: DataFrame, items: DataFrame, q: int = 6, rate: float = 0.125, most_chars: int = 4_000_000) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns, whatever their names; no shuffle.

    Null and empty texts hold no item and stay; repeated rows stay or go together.
    """
    at = docs.columns.index("text")
    for index in _indexes(items, q, rate, most_chars):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not scan(shared.value, t.as_py()) for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
