"""Removal of repeated byte strings by suffix sorting.

Every byte covered by a ``length``-byte string that also starts earlier (in a
smaller document, or before in the same one) is removed.  The suffix array of a
corpus doesn't fit anywhere, so the corpus is first reduced, without loss, to
the places where sorting is needed:

1. *Anchors.*  Each window of ``length`` bytes picks its gram of ``gram`` bytes
   with the smallest hash.  Equal windows pick equal grams at equal offsets, so
   windows need to be compared only below the same anchor; one anchor serves
   about 35 consecutive windows.  Each batch of rows settles its own whole copies of what an
   anchor's windows cover first, by their bytes, so that a passage that every document
   holds sends one row a batch.
2. *Lone anchors* - grams that occur in one place only - can't have a copy and end here.
   Hashes of grams decide this: equal hashes of different grams only cost work.
3. *Suffix sorting.*  The bytes of all other anchors, some 130 each, meet in buckets
   of bounded size.  Equal byte strings become one; a two-stage sort of the
   others orders directly only the suffixes that are smaller than their
   successors; a scan over the buckets of first bytes induces all others.
   Adjacent common prefixes of ``length`` bytes or more are the equal windows.
   A gram in very many places (a common short line) would make an unbounded
   bucket; its windows are dealt out one by one, by a 128-bit hash (BLAKE2b) of their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BASE = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1 << 20  # positions in a chunk take 20 bits
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    size = _CHUNK + 4096
    inverse = pow(_BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up, down = np.full(size, _BASE, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _slide_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    have, n = 1, len(x) - width + 1
    while 2 * have <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have : width - have + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors of the documents in ``data`` (bytes, at most a chunk), which start at ``offsets`` (the end included).

    Arrays: position, first and last window start, hash of the gram, hash of all bytes that the windows cover.
    """
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    starts, ends = offsets[:-1], offsets[1:]
    long = ends - starts >= length
    if not long.any():
        return none
    up, down = _powers()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    n = len(data) - gram + 1
    grams = _scramble((sums[gram:] - sums[:n]) * down[:n])
    packed = (grams & ~np.uint64(_CHUNK - 1)) | np.arange(n, dtype=np.uint64)
    least = (_slide_min(packed, length - gram + 1) & np.uint64(_CHUNK - 1)).astype(np.int64)
    valid = np.zeros(len(least) + 1, np.int32)
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - length + 1, -1)
    at = np.nonzero(np.cumsum(valid[:-1]) > 0)[0]
    of = least[at]
    new = np.r_[True, of[1:] != of[:-1]]
    first = at[new]
    last = at[np.r_[new[1:], True]]
    p = of[new]
    whole = _scramble((sums[last + length] - sums[first]) * down[first] + (p - first).astype(np.uint64))
    return p, first, last, grams[p], whole


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length by byte planes, compressed."""
    n = len(arrays[0])
    planes = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(n, a.itemsize).T).tobytes() for a in arrays)
    return pa.compress(planes, codec="zstd", asbytes=True) if n else b""


def _unpack(data: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    raw = np.frombuffer(pa.decompress(data, decompressed_size=n * sum(sizes), codec="zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    out, at = [], 0
    for k, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).reshape(-1).view(k))
        at += n * size
    return out


def _merge(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the ranges of each document."""
    if not len(doc):
        return doc, start, end
    o = np.lexsort((end, start, doc))
    doc, start, end = doc[o], start[o], end[o]
    new = np.r_[True, doc[1:] != doc[:-1]]
    group = np.cumsum(new) - 1
    span = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * span)  # so far in the document
    fresh = new | np.r_[True, (start[1:] + group[1:] * span) > reach[:-1]]
    at = np.nonzero(fresh)[0]
    return doc[at], start[at], (reach - group * span)[np.r_[at[1:] - 1, len(doc) - 1]]


def _pieces(ids: list[int], texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of whole documents, and overlapping parts of those longer than a chunk: bytes, offsets, document, shift."""
    buffer: list[bytes] = []
    owner: list[int] = []
    shift: list[int] = []
    size = 0

    def out():
        return (
            np.frombuffer(b"".join(buffer), np.uint8),
            np.cumsum([0, *map(len, buffer)]),
            np.array(owner, np.int64),
            np.array(shift, np.int64),
        )

    for i, text in zip(ids, texts, strict=True):
        if len(text) < length:
            continue
        step = _CHUNK - length + 1
        for at in range(0, len(text) - length + 1, step):
            part = text[at : at + _CHUNK]
            if size + len(part) > _CHUNK:
                yield out()
                buffer, owner, shift, size = [], [], [], 0
            buffer.append(part)
            owner.append(i)
            shift.append(at)
            size += len(part)
    if buffer:
        yield out()


def _all_anchors(ids, texts, length, gram):
    """Anchors of many documents: document, position, first and last window start, gram's hash, whole hash; and windows' bytes on demand."""
    found = []
    for data, offsets, owner, shift in _pieces(ids, texts, length):
        p, first, last, h, whole = anchors(data, offsets, length, gram)
        of = np.searchsorted(offsets, p, "right") - 1
        move = shift[of] - offsets[of]
        found.append((owner[of], p + move, first + move, last + move, h, whole))
    if not found:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    return [np.concatenate(x) for x in zip(*found, strict=True)]


_A = ("u8", "i8", "i8", "u1", "u1")  # gram's hash but for the bits that its bucket has, document, anchor, windows before it, windows
_W = ("u8", "u8", "i8", "i8")  # two halves of a window's hash, document, start
_M = ("i8", "i8", "i8")  # document, start, end
_R = ("i8", "i8", "u1", "i8")  # document, first window, windows, bucket: negative if its windows go one by one
_ROW = "bucket long, kind string, n long, data binary"


def _batch(bucket: list, kind: list, n: list, data: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int64()), pa.array(kind, pa.string()), pa.array(n, pa.int64()), pa.array(data, pa.binary())],
        names=["bucket", "kind", "n", "data"],
    )


def _deal(kind: str, bucket: np.ndarray, arrays: list[np.ndarray], out: tuple[list, list, list, list]) -> None:
    """One packed row for each bucket."""
    if not len(bucket):
        return
    o = np.argsort(bucket, kind="stable")
    b = bucket[o]
    edges = np.r_[np.nonzero(np.r_[True, b[1:] != b[:-1]])[0], len(b)]
    arrays = [a[o] for a in arrays]
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        for x, value in zip(out, (int(b[s]), kind, e - s, _pack(*[a[s:e] for a in arrays])), strict=True):
            x.append(value)


def _firsts(keys: list[np.ndarray], doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by key, document and place; in it where a new key begins, and what is a copy from another place."""
    o = np.lexsort((at, doc, *keys[::-1]))
    new = np.zeros(len(o), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[o][1:] != k[o][:-1]
    lead = o[np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))]
    return o, new, (doc[o] != doc[lead]) | (at[o] != at[lead])


def _window_hashes(text: bytes, first: int, last: int, length: int) -> np.ndarray:
    digest = hashlib.blake2b
    raw = b"".join([digest(text[i : i + length], digest_size=16).digest() for i in range(first, last + 1)])
    return np.frombuffer(raw, np.uint64).reshape(-1, 2)


def _one_by_one(texts: list[bytes], of: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Hash (two halves), document and start of each window ``first .. last`` of the texts ``of``, with what is a copy of another of them."""
    hashes = np.concatenate([_window_hashes(texts[r], f, l, length) for r, f, l in zip(of.tolist(), first.tolist(), last.tolist(), strict=True)])
    n = last - first + 1
    d = np.repeat(doc, n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return hashes[:, 0].copy(), hashes[:, 1].copy(), d, at


def _scan(batches, buckets: int, length: int, gram: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Step 1, and what a batch can settle alone."""
    for batch in batches:
        ids, texts = np.array(batch.column(0).to_pylist(), np.int64), [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(1)]
        row, p, first, last, h, whole = _all_anchors(range(len(ids)), texts, length, gram)
        doc = ids[row]
        out: tuple[list, list, list, list] = ([], [], [], [])
        o, new, again = _firsts([h, whole, last - first], doc, first)
        lead = o[np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))]
        piece = lambda k: texts[row[k]][first[k] : last[k] + length]
        places = np.nonzero(again)[0]
        same = np.array([piece(o[k]) == piece(lead[k]) for k in places.tolist()], bool)
        new[places[~same]] = True  # another string with the same hashes
        copies = o[places[same]]
        marks = [(doc[copies], first[copies], last[copies] + length)]
        o = np.sort(o[new])
        common = np.isin(h[o], hot) if len(hot) else np.zeros(len(o), bool)
        own = o[~common]
        _deal(
            "a",
            (h[own] % np.uint64(buckets)).astype(np.int64),
            [h[own] >> np.uint64(16), doc[own], p[own], (p[own] - first[own]).astype(np.uint8), (last[own] - first[own]).astype(np.uint8)],
            out,
        )
        if common.any():
            wide = o[common]
            a, b, d, at = _one_by_one(texts, row[wide], doc[wide], first[wide], last[wide], length)
            o, new, again = _firsts([a, b], d, at)
            copies = o[again]
            marks.append((d[copies], at[copies], at[copies] + length))
            o = np.sort(o[new])
            _deal("w", (a[o] % np.uint64(buckets)).astype(np.int64), [a[o], b[o], d[o], at[o]], out)
        d, s, e = _merge(*[np.concatenate(x) for x in zip(*marks, strict=True)])
        _deal("m", d % buckets, [d, s, e], out)
        if out[0]:
            yield _batch(*out)


def _gather(table: pa.Table, kind: str, kinds: tuple[str, ...]) -> list[np.ndarray]:
    rows = [(n, data) for k, n, data in zip(table["kind"].to_pylist(), table["n"].to_pylist(), table["data"].to_pylist(), strict=True) if k == kind]
    parts = [_unpack(data, n, *kinds) for n, data in rows]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, k) for k in kinds]


def _copies(table: pa.Table, length: int) -> list[np.ndarray]:
    """Marks of the windows that were dealt out one by one."""
    a, b, doc, at = _gather(table, "w", _W)
    o, _, again = _firsts([a, b], doc, at)
    copies = o[again]
    return [doc[copies], at[copies], at[copies] + length]


def _settle(table: pa.Table, length: int, groups: int, most: int) -> pa.Table:
    """Step 2 for one bucket: marks, and requests for the bytes of anchors that aren't alone."""
    h, doc, p, before, wins = _gather(table, "a", _A)
    first = p - before
    o = np.lexsort((p, doc, h))
    lead = np.r_[True, h[o][1:] != h[o][:-1]][: len(o)]
    group = np.cumsum(lead) - 1
    n = np.bincount(group, minlength=1)
    elsewhere = (doc[o] != doc[o][np.maximum.accumulate(np.where(lead, np.arange(len(o)), 0))]) | (p[o] != p[o][np.maximum.accumulate(np.where(lead, np.arange(len(o)), 0))])
    several = np.bincount(group[elsewhere], minlength=len(n)) > 0
    asked = several[group] if len(o) else np.zeros(0, bool)
    goal = (_scramble(h[o]) % np.uint64(groups)).astype(np.int64)
    goal = np.where(n[group] > most, -1, goal) if len(o) else goal
    d, s, e = _merge(*[np.concatenate(x) for x in zip(_gather(table, "m", _M), _copies(table, length), strict=True)])
    out: tuple[list, list, list, list] = ([], [], [], [])
    _deal("m", np.zeros(len(d), np.int64), [d, s, e], out)
    k = o[asked]
    _deal("r", np.zeros(len(k), np.int64), [doc[k], first[k], wins[k], goal[asked]], out)
    return pa.Table.from_batches([_batch(*out)])


def _rows(batches, kind: str, kinds: tuple[str, ...], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, n, data in zip(batch["kind"].to_pylist(), batch["n"].to_pylist(), batch["data"].to_pylist(), strict=True):
            if k == kind:
                arrays = _unpack(data, n, *kinds)
                yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)) for a in arrays], names=names)


def _cut_out(batches, groups: int, length: int) -> Iterator[pa.RecordBatch]:
    """The bytes that requested anchors cover, packed by bucket; of very common ones the windows' hashes."""
    for batch in batches:
        ids, texts = batch["doc_id"].to_pylist(), [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch["text"]]
        asked = batch["asked"]
        of = np.repeat(np.arange(len(ids)), np.diff(asked.offsets.to_numpy()))
        fields = asked.flatten()
        first, wins, goal = (fields.field(c).to_numpy().astype(np.int64) for c in ("first", "wins", "goal"))
        doc = np.array([i or 0 for i in ids], np.int64)[of]  # rows without an id are asked for nothing
        out: tuple[list, list, list, list] = ([], [], [], [])
        wide = np.nonzero(goal < 0)[0]
        if len(wide):
            a, b, d, at = _one_by_one(texts, of[wide], doc[wide], first[wide], first[wide] + wins[wide], length)
            _deal("w", (a % np.uint64(groups)).astype(np.int64), [a, b, d, at], out)
        o = np.argsort(goal, kind="stable")
        o = o[goal[o] >= 0]
        edges = np.r_[np.nonzero(np.r_[True, goal[o][1:] != goal[o][:-1]][: len(o)])[0], len(o)]
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = o[s:e]
            head = _pack(doc[own], first[own], wins[own].astype(np.uint8))
            body = b"".join([texts[r][f : f + w + length] for r, f, w in zip(of[own].tolist(), first[own].tolist(), wins[own].tolist(), strict=True)])
            for x, value in zip(out, (int(goal[own[0]]), "s", e - s, len(head).to_bytes(4, "big") + head + pa.compress(body, codec="zstd", asbytes=True)), strict=True):
                x.append(value)
        if out[0]:
            yield _batch(*out)


def two_stage_order(x: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of ``x`` (bytes) in an order that is right in their first ``depth`` bytes.

    Suffixes smaller than their successors are sorted directly, by words of
    eight bytes and as deep as ties go.  The others follow by induction: going
    through the buckets of first bytes in order, each suffix puts the one before
    it at the next free place of its bucket.
    """
    n = len(x)
    ends = np.r_[np.nonzero(x[1:] != x[:-1])[0], n - 1]  # of runs of one byte
    run = np.searchsorted(ends, np.arange(n))
    after = ends + 1
    rising = np.r_[x[after[:-1]] > x[ends[:-1]], False]
    small = np.nonzero(rising[run])[0]
    padded = np.concatenate([x, np.zeros(depth + 16, np.uint8)])
    words = np.ndarray(n + depth, dtype=">u8", buffer=padded, strides=(1,))
    small = small[np.argsort(words[small].astype(np.uint64), kind="stable")]
    tied = np.arange(len(small))
    group = np.zeros(len(small), np.int64)
    for at in range(0, depth, 8):
        keys = words[small[tied] + at].astype(np.uint64)
        if at:
            o = np.lexsort((keys, group))
            small[tied] = small[tied][o]
            keys = keys[o]
        new = np.r_[True, (keys[1:] != keys[:-1]) | (group[1:] != group[:-1])][: len(keys)]
        group = np.cumsum(new)
        alone = new & np.r_[new[1:], True][: len(new)]
        tied, group = tied[~alone], group[~alone]
        if not len(tied):
            break
    starts = np.searchsorted(x[small], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[x[n - 1]].append(np.array([n - 1]))
    before = np.r_[np.uint8(0), x[:-1]]
    order = []
    for c in range(256):
        waves = [np.concatenate(waiting[c])] if waiting[c] else []
        while waves and len(wave := waves[-1][(before[waves[-1]] == c) & (waves[-1] > 0)] - 1):
            waves.append(wave)
        bucket = np.concatenate([*waves, small[starts[c] : starts[c + 1]]])
        order.append(bucket)
        lead = before[bucket]
        moved = (lead > c) & (bucket > 0)
        lead, moved = lead[moved], bucket[moved] - 1
        o = np.argsort(lead, kind="stable")
        lead, moved = lead[o], moved[o]
        edges = np.r_[np.nonzero(np.r_[True, lead[1:] != lead[:-1]][: len(lead)])[0], len(lead)]
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            waiting[lead[s]].append(moved[s:e])
    return np.concatenate(order)


def repeated_windows(doc: np.ndarray, first: np.ndarray, wins: np.ndarray, body: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows whose bytes also start earlier, as document and start.

    Segment ``k`` covers windows ``first[k] .. first[k] + wins[k]`` of ``doc[k]``; ``body`` has the segments' bytes in order.
    """
    sizes = wins + length
    place = np.cumsum(sizes) - sizes
    rank = np.empty(len(doc), np.int64)
    o = np.lexsort((first, doc))
    rank[o] = np.cumsum(np.r_[False, (doc[o][1:] != doc[o][:-1]) | (first[o][1:] != first[o][:-1])][: len(o)])
    x = np.frombuffer(body, np.uint8)
    order = two_stage_order(x, length + 4)
    segment = np.repeat(np.arange(len(doc)), sizes)
    inside = np.arange(len(x)) - place[segment]
    order = order[inside[order] <= wins[segment[order]]]
    padded = np.concatenate([x, np.zeros(16, np.uint8)])
    words = np.ndarray(len(x) + 8, dtype=">u8", buffer=padded, strides=(1,))
    same = np.ones(max(0, len(order) - 1), bool)
    left, right = order[:-1], order[1:]
    for at in [*range(0, length - 7, 8), length - 8]:
        k = np.nonzero(same)[0]
        same[k] = words[left[k] + at] == words[right[k] + at]
    starts = np.nonzero(np.r_[True, ~same][: len(order)])[0]
    code = rank[segment[order]] * 256 + inside[order]
    least = np.repeat(np.minimum.reduceat(code, starts), np.diff(np.r_[starts, len(order)])) if len(order) else code
    again = order[code != least]
    return doc[segment[again]], first[segment[again]] + inside[again]


def _sort(table: pa.Table, length: int) -> pa.Table:
    """Step 3 for one bucket."""
    parts, bodies = [np.zeros(0, np.int64)] * 3, b""
    packed = [(n, data) for k, n, data in zip(table["kind"].to_pylist(), table["n"].to_pylist(), table["data"].to_pylist(), strict=True) if k == "s"]
    if packed:
        heads, bytes_ = [], []
        for n, data in packed:
            size = int.from_bytes(data[:4], "big")
            heads.append(_unpack(data[4 : 4 + size], n, "i8", "i8", "u1"))
            total = int(heads[-1][2].astype(np.int64).sum()) + n * length
            bytes_.append(pa.decompress(data[4 + size :], decompressed_size=total, codec="zstd", asbytes=True))
        parts, bodies = [np.concatenate(x) for x in zip(*heads, strict=True)], b"".join(bytes_)
    doc, first, wins = parts[0], parts[1], parts[2].astype(np.int64)
    sizes = wins + length
    ends = np.cumsum(sizes)
    # equal strings are one: the earliest stands for them
    order, seen, lead = np.lexsort((first, doc)), {}, np.zeros(len(doc), bool)
    pieces = [bodies[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    for k in order.tolist():
        lead[k] = seen.setdefault(pieces[k], k) == k
    again = np.nonzero(~lead)[0]
    # the same place twice (a repeated row) is no copy
    to = np.array([seen[pieces[k]] for k in again.tolist()], np.int64)
    again = again[(doc[again] != doc[to]) | (first[again] != first[to])] if len(again) else again
    marks = [[doc[again], first[again], first[again] + sizes[again]], _copies(table, length)]
    own = np.nonzero(lead)[0]
    if len(own) > 1:
        d, at = repeated_windows(doc[own], first[own], wins[own], b"".join([pieces[k] for k in own.tolist()]), length)
        marks.append([d, at, at + length])
    d, s, e = _merge(*[np.concatenate(x) for x in zip(*marks, strict=True)])
    return pa.table({"doc_id": pa.array(d), "s": pa.array(s), "e": pa.array(e)})


def _digest(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, text, marks in zip(batch["doc_id"].to_pylist(), batch["text"], batch["marks"].to_pylist(), strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            kept, spans, removed, at = hashlib.sha256(), 0, 0, 0
            reach = -1
            for s, e in sorted((m["s"], m["e"]) for m in marks or ()):
                if s > reach:
                    kept.update(raw[at:s])
                    spans += 1
                    removed += e - s
                    at = reach = e
                elif e > reach:
                    removed += e - reach
                    at = reach = e
            kept.update(raw[at:])
            rows.append((i, len(raw), removed, spans, kept.hexdigest()))
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        kinds = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def common_grams(docs: DataFrame, rows: int, length: int, gram: int, sample: int = 100_000, share: float = 0.0005) -> np.ndarray:
    """Hashes of grams that anchor windows in many documents.

    They only steer how the work is dealt out - any set gives the same result -
    so a bounded sample of documents is enough: it keeps the first step's rows of
    a gram, some 25 bytes each, below ``share`` of the documents.  The second step counts
    exactly and bounds its buckets by a number.
    """
    every = max(1, rows // sample)
    least = max(8, int(share * rows / every))

    def run(batches):
        for batch in batches:
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(1)]
            doc, _, _, _, h, _ = _all_anchors(batch.column(0).to_pylist(), texts, length, gram)
            pairs = np.unique(np.stack([doc.view(np.uint64), h]), axis=1)[1] if len(h) else h
            values, n = np.unique(pairs, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], names=["h", "n"])

    picked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0) if every > 1 else docs
    found = picked.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.array(sorted(r["h"] for r in found.select("h").collect()), np.int64).view(np.uint64)


def remove_repeats(docs: DataFrame, length: int = 100, gram: int = 32, bucket_bytes: int = 3_000_000, most: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` per document: what is left without the repeated bytes.

    Rows with one id and one text are one document: each gives the same row.
    An id with several texts is an error, as nobody could say which of them comes
    first.  Rows without an id are no documents: they come back whole and remove
    nothing.  Null texts count as empty; texts shorter than ``length`` bytes have
    nothing to remove; an empty table gives an empty result; other columns are
    not read.  Among equal strings the one with the smallest
    document, then the smallest start, stays.  The bytes of a gram in more than
    ``most`` places don't meet in one bucket: its windows go one by one.
    """
    from tessera.llm.common import cut

    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = text.where("doc_id is not null")
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    own = named.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.min(hashed).alias("low"), F.max(hashed).alias("high"))
    size = own.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count_if(F.col("low") != F.col("high")).alias("mixed")).first()
    if size["mixed"]:
        raise ValueError(f"{size['mixed']} ids have several texts")
    rows, total = size["n"] or 0, int(size["bytes"] or 0)
    buckets = groups = total // bucket_bytes + 1
    hot = common_grams(named, rows, length, gram)
    dealt = named.mapInArrow(lambda b: _scan(b, buckets, length, gram, hot), _ROW)
    settled = cut(dealt.groupBy("bucket").applyInArrow(lambda t: _settle(t, length, groups, most), _ROW))
    asked = (
        settled.where("kind = 'r'")
        .mapInArrow(lambda b: _rows(b, "r", _R, ["doc_id", "first", "wins", "goal"]), "doc_id long, first long, wins long, goal long")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct(F.col("first").cast("int").alias("first"), F.col("wins").cast("short").alias("wins"), "goal")).alias("asked"))
    )
    # a left join like the last one, so that both share one exchange of the texts
    parts = text.join(asked.hint("shuffle_hash"), "doc_id", "left").mapInArrow(lambda b: _cut_out(b, groups, length), _ROW)
    sorted_marks = parts.groupBy("bucket").applyInArrow(lambda t: _sort(t, length), "doc_id long, s long, e long")
    settled_marks = settled.where("kind = 'm'").mapInArrow(lambda b: _rows(b, "m", _M, ["doc_id", "s", "e"]), "doc_id long, s long, e long")
    marks = settled_marks.union(sorted_marks).groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("marks"))
    return text.join(marks.hint("shuffle_hash"), "doc_id", "left").mapInArrow(
        _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
