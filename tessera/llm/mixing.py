"""Mixing sources to target weights by Pfair scheduling.

DataFrame functions only.  A source of weight ``w`` gets its ``j``-th block
(``j`` from 1) released at slot ``floor((j - 1) / w)`` and due by slot
``ceil(j / w)``; the earliest deadline goes first.  Then each source's number of
blocks in the first ``t`` slots differs from ``t * w`` by less than one, at every
``t`` (Baruah et al., Algorithmica 1996).

Weights are multiples of ``1 / slots``.  At multiples of ``slots`` no source is
ahead or behind, so the schedule repeats: one round of ``slots`` entries, made
once, is a table of fixed size that every block looks its slot up in, whatever
the number of blocks.
"""

from __future__ import annotations

import heapq
from math import ceil, log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut


#: Copies of one row that one task writes at a time.
_PIECE = 10_000


def shares(weights: dict[str, float], slots: int) -> dict[str, int]:
    """Slots of each source in a round: largest remainders, one at least."""
    if len(weights) > slots:
        raise ValueError(f"{len(weights)} sources don't fit into rounds of {slots} slots")
    total = sum(weights.values())
    if total <= 0 or min(weights.values()) < 0:
        raise ValueError("weights must not be negative, and some must be positive")
    exact = {s: w / total * slots for s, w in weights.items() if w > 0}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: max(0, slots - sum(out.values()))]:
        out[s] += 1
    while sum(out.values()) > slots:  # those raised to one slot take it from the largest
        out[max(out, key=lambda s: (out[s], s))] -= 1
    return out


def schedule(share: dict[str, int], slots: int) -> list[tuple[str, int, int, int, int]]:
    """One round: ``(source, ordinal from 0, slot, release, deadline)``, earliest deadline first among the released."""
    jobs = sorted((j * slots // n, -(-(j + 1) * slots // n), s, j) for s, n in share.items() for j in range(n))
    out, ready, at = [], [], 0
    for slot in range(slots):
        while at < len(jobs) and jobs[at][0] <= slot:
            release, due, s, j = jobs[at]
            heapq.heappush(ready, (due, s, j, release))
            at += 1
        due, s, j, release = heapq.heappop(ready)
        if slot >= due:
            raise AssertionError("a deadline was missed")
        out.append((s, j, slot, release, due))
    return out


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    block: int = 64,
    slots: int = 1000,
    temperature: float = 0.5,
    id_col: str = "doc_id",
    source_col: str = "source",
    rows_a_bucket: int = 2_000,
    carry: bool = False,
) -> DataFrame:
    """A place in the mix for every document: ``(doc_id, source, block, slot, release, deadline, position, in_mix)``.

    Documents of a source come in the order of a hash of their id (with
    ``carry``, of their whole row) and fill blocks of ``block``.  ``position`` orders all documents.  A source that runs
    out leaves its slots empty; ``in_mix`` is true for the documents before the
    first slot that its source can't fill with a whole block, where the weights
    hold exactly.  Without ``weights``, a source weighs its number of documents
    to the power ``temperature``.  Documents without a source are a source of
    their own, named ``""``; sources without weight get no place: null slot and
    position, ``in_mix`` false.  Each row has a place of its own: rows with equal
    or null ids are told apart by their other columns if these are carried, and are
    alike if not.  An empty table gives an empty result.  With ``carry``, the other columns of ``docs`` come
    first, but for those with a name of the result's.

    Ranks within a source are counted by buckets of the hash, so a source with
    a third of all rows isn't sorted in one task.
    """
    spark = docs.sparkSession
    place = ["doc_id", "source", "block", "slot", "release", "deadline", "position", "in_mix"]
    others = [c for c in docs.columns if c not in (*place, id_col, source_col)] if carry else []
    rows = docs.select(
        F.struct(F.lit(0), *[F.col(f"`{c}`") for c in others]).alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
    )
    # rows with one id, or without one, must not meet in one bucket: whole rows differ by their other columns;
    # where ids and sources are all there is, equal rows are one with a number
    if carry:
        rows = rows.withColumns({"n": F.lit(1).cast("long"), "salt": F.xxhash64("row").cast("string")})
    else:
        rows = cut(rows.groupBy("source", "doc_id", "row").agg(F.count("*").alias("n")).withColumn("salt", F.lit("")))
    # as many rows as sources; more than slots of them is an error below
    counts = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("n").alias("n")).limit(slots + 1).collect()}
    total = sum(counts.values())
    wanted = {s: counts[s] ** temperature for s in counts} if weights is None else {s: w for s, w in weights.items() if w > 0}
    share = shares(wanted, slots) if wanted else {}
    table = schedule(share, slots) if share else []
    first_gap = {}
    by_source: dict[str, list[int]] = {}
    for s, _, slot, _, _ in table:
        by_source.setdefault(s, []).append(slot)
    for s, own in by_source.items():
        whole = counts.get(s, 0) // block
        first_gap[s] = whole // len(own) * slots + own[whole % len(own)]
    horizon = min(first_gap.values(), default=0)

    digits = max(1, ceil(log(max(2, total / rows_a_bucket), 16)))
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "salt")
    hashed = rows.withColumn("h", F.md5(named.cast("binary"))).withColumn("bucket", F.substring("h", 1, digits))
    sizes = hashed.groupBy("source", "bucket").agg(F.sum("n").alias("n"))
    before = lambda *order: Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("source", "bucket", F.coalesce(F.sum("n").over(before("bucket").partitionBy("source")), F.lit(0)).alias("offset"))
    own = F.coalesce(F.sum("n").over(before("h", "doc_id").partitionBy("source", "bucket")), F.lit(0))
    ranked = hashed.withColumn("k", own).join(offsets, ["source", "bucket"]).withColumn("rank", F.col("offset") + F.col("k"))
    if not carry:  # the copies of a row, in pieces that are dealt out where there are many
        ranked = ranked.withColumn("piece", F.explode(F.sequence(F.col("rank"), F.col("rank") + F.col("n") - 1, F.lit(_PIECE).cast("long"))))
        if (rows.agg(F.max("n")).first()[0] or 0) > _PIECE:
            ranked = ranked.repartition("piece")
        ranked = ranked.withColumn("rank", F.explode(F.sequence(F.col("piece"), F.least(F.col("piece") + _PIECE, F.col("rank") + F.col("n")) - 1)))
    placed = ranked.withColumn("block", F.floor(F.col("rank") / block).cast("long"))
    round_ = spark.createDataFrame(
        [(s, share[s], j, slot, r, d) for s, j, slot, r, d in table], "source string, n_round long, ordinal long, at long, release long, deadline long"
    )
    shares_table = spark.createDataFrame(list(share.items()), "source string, n_round long")
    with_round = placed.join(F.broadcast(shares_table), "source", "left").withColumn("ordinal", F.col("block") % F.col("n_round"))
    turn = F.floor(F.col("block") / F.col("n_round")).cast("long") * slots
    slotted = with_round.join(F.broadcast(round_.drop("n_round")), ["source", "ordinal"], "left").select(
        *[F.col("row")[c].alias(c) for c in others],
        "doc_id",
        "source",
        "block",
        (turn + F.col("at")).alias("slot"),
        (turn + F.col("release")).alias("release"),
        (turn + F.col("deadline")).alias("deadline"),
        ((turn + F.col("at")) * block + F.col("rank") % block).alias("position"),
    )
    return slotted.withColumn("in_mix", F.coalesce(F.col("slot") < horizon, F.lit(False)))
