"""Near-duplicate embeddings by sorted projection passes.

Each pass draws random hyperplanes, takes the signs of a vector's projections
as the bits of one word, sorts the vectors of a label by that word and
compares every vector with its neighbours in the order.  A pair at a small
angle differs in few bits, but a difference in a leading bit takes it apart;
several passes with fresh planes make that unlikely in all of them.  Pairs are
verified by cosine in double precision and united over the passes.

Windows are bounded, so two things need care as labels grow:

* *Large labels* put more strangers between two neighbours.  The number of
  passes grows with the logarithm of the largest label (:func:`passes_for`).
* *Dense groups* hold more links than windows can show.  They are settled exactly.
  A block that holds a ball - many vectors within half the linking angle of one
  centre - reports it; balls with nearly the same centre are merged, and vectors
  are checked against the centre that they are left with.  Any two members of a ball
  are linked by the triangle inequality, so a ball counts as its size and connects
  as a star: no pairs, however large it is.  Vectors that have many links besides
  those of their ball are *crowded*: they are compared with their whole label,
  block against block, and only counts leave a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, cos, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import components, cut

BITS = 48
BLOCK, WINDOW = 1024, 512
#: In a block, so many links make a vector crowded, and so many vectors a ball.
CROWD = 128
#: Passes that are sorted at a time; more go in several turns.
_TURN = 8
#: Rows of a vector or a label that may be broadcast, some MB; more of them are shuffled.
_BROADCAST_ROWS = 8192
_EPS = 1e-9


def passes_for(largest: int) -> int:
    """Passes that find 0.98 of isolated pairs or more in labels of up to ``largest`` vectors (README has the measured recall)."""
    return 8 + 2 * max(0, ceil(log2(max(1, largest) / 65_536)))


def _planes(seed: int, number: int, size: int) -> np.ndarray:
    return np.random.default_rng([seed, number, size]).standard_normal((size, BITS))


def _packed(vectors: DataFrame, kind: str) -> DataFrame:
    """``(vec_id, label, vector)``: the components as bytes, with one spelling of zero; null if the vector can't link."""
    dtype = np.dtype(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype) + dtype.type(0)  # -0.0 becomes 0.0
            ends = np.cumsum(sizes)
            bad = np.r_[0, np.cumsum(~np.isfinite(values))]
            some = np.r_[0, np.cumsum(values != 0)]
            starts = ends - sizes
            good = (bad[ends] == bad[starts]) & (some[ends] > some[starts])
            out = [values[s:e].tobytes() if g else None for s, e, g in zip(starts.tolist(), ends.tolist(), good.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["vec_id", "label", "vector"])

    return vectors.mapInArrow(run, "vec_id long, label int, vector binary")


def _matrix(column: pd.Series, kind: str) -> np.ndarray:
    """Unit rows in double precision."""
    x = np.frombuffer(b"".join(column), np.dtype(kind)).reshape(len(column), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # no square over- or underflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _blocks(vectors: DataFrame, numbers: range, seed: int, kind: str, block: int, window: int) -> DataFrame:
    """``vectors(label, vec_id, vector, ball)`` with ``pass`` and ``block``: neighbours in the order of a pass share blocks.

    Every vector meets at least the ``window`` next ones of its label.  Ranks come
    from a range partitioning and the counts of its partitions; a block and the
    ``window`` rows after it are one group, so no group is larger than ``block +
    window``, whatever the label's size.
    """

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for size, part in frame.groupby(frame["vector"].map(len)):
                x = np.frombuffer(b"".join(part["vector"]), np.dtype(kind)).reshape(len(part), -1).astype(np.float64)
                for number in numbers:
                    bits = (x @ _planes(seed, number, int(size) // np.dtype(kind).itemsize)) > 0
                    yield part.assign(word=bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)), **{"pass": number})[
                        ["pass", "word", "label", "vec_id", "ball", "vector"]
                    ]

    order = ["pass", "label", "word", "vec_id"]
    keyed = vectors.select("label", "vec_id", "ball", "vector").mapInPandas(keys, "pass int, word long, label int, vec_id long, ball long, vector binary")
    ranked = cut(keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")
    counts = sorted((r["part"], r["n"]) for r in ranked.groupBy(part).agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for k, n in counts:  # one number a partition
        offsets.append((k, total))
        total += n
    rank = (F.col("offset") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank")
    placed = ranked.withColumn("part", part).join(
        F.broadcast(vectors.sparkSession.createDataFrame(offsets, "part long, offset long")), "part"
    ).select("pass", "label", "vec_id", "ball", "vector", rank)
    home = F.floor(F.col("rank") / block).cast("long")
    homes = F.when((F.col("rank") % block < window) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))
    return placed.withColumn("block", F.explode(homes)).drop("rank")


def _links(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of ``x`` and ``y`` have the cosine; those at the threshold are settled one by one, in the order of the components."""
    g = x @ y.T
    link = g >= threshold
    i, j = np.nonzero(np.abs(g - threshold) < _EPS)
    for s in range(0, len(i), 1 << 16):
        a, b = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
        link[a, b] = np.einsum("ij,ij->i", x[a], y[b]) >= threshold
    return link


def _half(threshold: float, parts: int = 2) -> float:
    """Cosine of a part of the linking angle."""
    return cos(acos(threshold) / parts)


def _balls_of(x: np.ndarray, link: np.ndarray, least: int, half: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Centres with the rows within half the angle, ``least`` of them or more."""
    open_ = np.ones(len(x), bool)
    for _ in range(2 * len(x) // least):
        degree = (link & open_).sum(1) * open_
        k = int(degree.argmax())
        if degree[k] < least:
            return
        centre = x[link[k] & open_].mean(0)
        centre /= np.linalg.norm(centre)
        members = (x @ centre >= half + _EPS) & open_
        if members.sum() >= least:
            yield centre, np.nonzero(members)[0]
            open_ &= ~members
        else:
            open_[k] = False


_FOUND = "kind string, a long, b long, label int, centre binary"
_FIELDS = pa.schema([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("label", pa.int32()), ("centre", pa.binary())])


def _said(kind: str, a: np.ndarray, b: np.ndarray | None = None, label: int | None = None, centre: bytes | None = None) -> pa.Table:
    same = lambda x, t: pa.array([x] * len(a), t)
    return pa.table([same(kind, pa.string()), pa.array(a, pa.int64()), same(None, pa.int64()) if b is None else pa.array(b, pa.int64()), same(label, pa.int32()), same(centre, pa.binary())], schema=_FIELDS)


def _compared(vectors: DataFrame, threshold: float, passes: int, block: int, window: int, crowd: int, seed: int, kind: str, seek_balls: bool) -> DataFrame:
    """What the blocks of all passes say: ``kind`` ``pair`` (a, b), ``crowded`` (a), and if sought ``ball`` (key a, b members) and ``cover`` (vector a, ball b).

    Links within a ball that is known already don't count; pairs of crowded vectors are left out.
    """
    half = _half(threshold)

    def compare(turn: int):
        def run(table: pa.Table) -> pa.Table:
            frame, out = table.to_pandas(), [_FIELDS.empty_table()]
            key = (turn << 56) | (int(frame["block"].iloc[0]) << 11)
            for (_, label, _), part in frame.groupby(["pass", "label", frame["vector"].map(len)]):
                if len(part) < 2:
                    continue
                x, ids, ball = _matrix(part["vector"], kind), part["vec_id"].to_numpy(), part["ball"].to_numpy()
                link = _links(x, x, threshold)
                if seek_balls:
                    for centre, members in _balls_of(x, link, crowd, half):
                        out.append(_said("ball", np.array([key]), np.array([len(members)]), int(label), centre.tobytes()))
                        out.append(_said("cover", ids[members], np.full(len(members), key)))
                        key += 1
                link &= (ball[:, None] != ball[None]) | (ball[:, None] < 0)
                np.fill_diagonal(link, False)
                full = link.sum(1) >= crowd
                out.append(_said("crowded", ids[full]))
                link[full] = False
                link[:, full] = False
                i, j = np.nonzero(np.triu(link))
                out.append(_said("pair", np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])))
            return pa.concat_tables(out)

        return run

    found = None
    for turn, first in enumerate(range(0, passes, _TURN)):
        dealt = _blocks(vectors, range(first, min(passes, first + _TURN)), seed, kind, block, window)
        own = cut(dealt.groupBy("block").applyInArrow(compare(turn), _FOUND).distinct())
        found = own if found is None else found.union(own)
    return found


def _merged(balls: DataFrame, threshold: float, block: int, seed: int) -> DataFrame:
    """``(key, leader, weight, centre)``: balls of a label with nearly the same centre get one leader, whose centre counts for all.

    Rounds of a sorted pass over the centres; each block keeps its largest balls
    as leaders of those close to them.  Rounds go on while they merge a
    twentieth or more.
    """
    near = _half(threshold, 16)

    def lead(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in frame.groupby(["label", frame["vector"].map(len)]):
            part = part.sort_values(["ball", "vec_id"], ascending=[False, True])
            x, ids = _matrix(part["vector"], "f8"), part["vec_id"].to_numpy()
            close, leader = x @ x.T >= near, np.full(len(x), -1)
            for k in range(len(x)):
                if leader[k] < 0:
                    leader[close[k] & (leader < 0)] = k
            out.append(pd.DataFrame({"vec_id": ids, "leader": ids[leader]}))
        return pd.concat(out)

    own = balls.select(F.col("a").alias("vec_id"), "label", F.col("b").alias("ball"), F.col("centre").alias("vector"))
    of = own.select("vec_id", F.col("vec_id").alias("leader"))
    left, before, number = own, balls.count(), 0
    while True:
        step = cut(_blocks(left, range(number, number + 1), seed + 1, "f8", block, 0).groupBy("block").applyInPandas(lead, "vec_id long, leader long"))
        of = cut(of.withColumnRenamed("leader", "by").join(step.toDF("by", "leader"), "by").select("vec_id", "leader"))
        left = cut(left.join(step.where("vec_id = leader").select("vec_id"), "vec_id", "left_semi"))
        now, number = left.count(), number + 1
        if now > 0.95 * before:
            break
        before = now
    weight = of.join(own.select("vec_id", "ball"), "vec_id").groupBy("leader").agg(F.sum("ball").alias("weight"))
    leaders = weight.join(left.select(F.col("vec_id").alias("leader"), F.col("vector").alias("centre")), "leader")
    return of.join(leaders, "leader").select(F.col("vec_id").alias("key"), "leader", "weight", "centre")


def _small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast only while it has few rows."""
    return df.hint("broadcast" if df.count() <= _BROADCAST_ROWS else "merge")


def _members(vectors: DataFrame, found: DataFrame, threshold: float, block: int, seed: int, kind: str) -> DataFrame:
    """``(vec_id, ball)`` of the vectors that lie within half the angle of a merged ball's centre."""
    half = _half(threshold)
    balls = cut(_merged(found.where("kind = 'ball'"), threshold, block, seed))
    best = (
        found.where("kind = 'cover'")
        .select(F.col("a").alias("vec_id"), F.col("b").alias("key"))
        .join(balls.select("key", "leader", "weight"), "key")
        .groupBy("vec_id")
        .agg(F.min(F.struct((-F.col("weight")).alias("w"), "leader"))["leader"].alias("ball"))
    )
    centres = cut(balls.where("key = leader").select(F.col("leader").alias("ball"), "centre"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for _, part in frame.groupby(frame["vector"].map(len)):
                x, c = _matrix(part["vector"], kind), _matrix(part["centre"], "f8")
                yield part[np.einsum("ij,ij->i", x, c) >= half + _EPS][["vec_id", "ball"]]

    near = vectors.select("vec_id", "vector").join(best, "vec_id").join(_small(centres), "ball")
    return cut(near.select("vec_id", "ball", "vector", "centre").mapInPandas(check, "vec_id long, ball long"))


def _against_all(crowded: DataFrame, vectors: DataFrame, threshold: float, kind: str, own: int = 2048, other: int = 4096) -> DataFrame:
    """Exact links of crowded vectors: ``(vec_id, n, other)``, a vector's number of links in a block and the smallest of them.

    Each block of some ``own`` crowded vectors meets each of some ``other``
    vectors of its label, in tasks of bounded size; counts leave them, not pairs.
    Links within a ball don't count.  Vectors that aren't crowded get their
    links to crowded ones.
    """
    flagged = vectors.join(crowded.withColumn("crowded", F.lit(True)), "vec_id", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    sizes = flagged.groupBy("label").agg(F.ceil(F.count_if("crowded") / own).cast("long").alias("us"), F.ceil(F.count("*") / other).cast("long").alias("vs")).where("us > 0")
    dealt = cut(flagged.join(_small(cut(sizes)), "label"))
    cell = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ["label", "u", "v", "side", "vec_id", "copies", "ball", "crowded", "vector"]
    left = dealt.where("crowded").withColumns({"u": cell("us", 1), "side": F.lit(True)}).withColumn("v", every("vs")).select(*columns)
    right = dealt.withColumns({"v": cell("vs", 2), "side": F.lit(False)}).withColumn("u", every("us")).select(*columns)

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"vec_id": [], "n": [], "other": []}, dtype="int64")]
        for _, part in frame.groupby(frame["vector"].map(len)):
            a, b = part[part["side"]], part[~part["side"]]
            if not len(a) or not len(b):
                continue
            ids, others = a["vec_id"].to_numpy(), b["vec_id"].to_numpy()
            ball, ball_b = a["ball"].to_numpy(), b["ball"].to_numpy()
            link = _links(_matrix(a["vector"], kind), _matrix(b["vector"], kind), threshold)
            link &= (ids[:, None] != others[None]) & ((ball[:, None] != ball_b[None]) | (ball[:, None] < 0))
            for l, c, who, whom in ((link, b["copies"], ids, others), (link[:, ~b["crowded"].to_numpy()].T, a["copies"], others[~b["crowded"].to_numpy()], ids)):
                some = l.any(1)
                least = np.where(l[some], whom[None], np.iinfo(np.int64).max).min(1) if some.any() else np.zeros(0, np.int64)
                out.append(pd.DataFrame({"vec_id": who[some], "n": l[some] @ c.to_numpy(), "other": least}))
        return pd.concat(out)

    return cut(left.union(right).groupBy("label", "u", "v").applyInPandas(count, "vec_id long, n long, other long"))


def links(
    vectors: DataFrame, threshold: float = 0.93, passes: int | None = None, block: int = BLOCK, window: int = WINDOW, crowd: int = CROWD, seed: int = 7, kind: str = "f4"
) -> tuple[DataFrame, DataFrame]:
    """Links of ``vectors(vec_id, label, vector, copies)``, whose rows are distinct and packed by :func:`_packed`.

    Two frames: ``(vec_id, n)``, whose sums by vector are the numbers of linked
    rows of other vectors, copies included; and edges ``(a, b)``, all of them
    links, whose paths are those of all links found.
    """
    largest = vectors.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    rounds = passes or passes_for(largest)
    options = (threshold, rounds, block, window, crowd, seed, kind)
    alone = vectors.withColumn("ball", F.lit(-1).cast("long"))
    found = _compared(alone, *options, True)
    weights, stars = None, None
    if found.where("kind = 'ball'").limit(1).count():
        members = _members(vectors, found, threshold, block, seed, kind)
        alone = cut(vectors.join(members, "vec_id", "left").withColumn("ball", F.coalesce("ball", F.lit(-1).cast("long"))))
        found = _compared(alone, *options, False)
        inside = alone.where("ball >= 0")
        sums = cut(inside.groupBy("ball").agg(F.sum("copies").alias("all"), F.min("vec_id").alias("first")))
        balled = inside.select("vec_id", "ball", "copies").join(_small(sums), "ball")
        weights = balled.select("vec_id", (F.col("all") - F.col("copies")).alias("n"))
        stars = balled.where("vec_id != first").select(F.col("first").alias("a"), F.col("vec_id").alias("b"))
    pairs = found.where("kind = 'pair'").select("a", "b").distinct()
    crowded = cut(found.where("kind = 'crowded'").select(F.col("a").alias("vec_id")).distinct())
    exact = None
    if crowded.limit(1).count():
        pairs = pairs.join(crowded.toDF("a"), "a", "left_anti").join(crowded.toDF("b"), "b", "left_anti").select("a", "b")
        exact = _against_all(crowded, alone, threshold, kind)
    pairs = cut(pairs)
    both = pairs.union(pairs.select("b", "a")).toDF("vec_id", "other")
    n = both.join(vectors.select(F.col("vec_id").alias("other"), F.col("copies").alias("n")), "other").select("vec_id", "n")
    edges = pairs
    if weights is not None:
        n, edges = n.union(weights), edges.union(stars)
    if exact is not None:
        n, edges = n.union(exact.select("vec_id", "n")), edges.union(exact.select("vec_id", "other"))
    return n, edges


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, **options) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors(vec_id, embedding, label)``.

    Vectors with a null label, and those that are null, empty, zero or hold
    null or non-finite components, link with nothing.  Equal vectors of a label
    are one class, compared once; ``n_links`` counts all its copies.  Vectors of
    different length never link.  Rows are told apart by ``vec_id``, so an id
    has one vector; a repeated row counts as one more copy.  A row without an id counts
    as a copy of an equal vector that has one; a vector that only rows without ids
    have links with nothing but its copies, and their ``component_id`` and ``kept`` are null.
    An empty table gives an empty result; other columns are not read.
    """
    kind = "f8" if isinstance(vectors.schema["embedding"].dataType.elementType, T.DoubleType) else "f4"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), F.col("embedding").cast(f"array<{'double' if kind == 'f8' else 'float'}>"))
    packed = cut(_packed(rows, kind))
    able = packed.where("vector is not null and label is not null")
    classes = cut(able.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    n, edges = links(classes.where("rep is not null").select(F.col("rep").alias("vec_id"), "label", "vector", "copies"), threshold, kind=kind, **options)
    degree = n.groupBy("vec_id").agg(F.sum("n").alias("beyond")).withColumnRenamed("vec_id", "rep")
    roots = components(edges).withColumnsRenamed({"node": "rep"})
    of = (
        classes.join(degree, "rep", "left")
        .join(roots, "rep", "left")
        .select(
            "label",
            F.md5("vector").alias("spelling"),
            (F.coalesce("beyond", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
            F.coalesce("root", "rep").alias("component_id"),
        )
    )
    linked = able.select("vec_id", "label", F.md5("vector").alias("spelling")).join(of, ["label", "spelling"]).select("vec_id", "n_links", "component_id")
    others = packed.where("vector is null or label is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(others).withColumn("kept", F.col("vec_id") == F.col("component_id"))
