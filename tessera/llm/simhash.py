"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint is 64 majority votes over the XXH64 of a text's word shingles.
Two fingerprints at 3 or fewer differing bits are linked, and documents get
the smallest ``doc_id`` that links reach.

The search never compares all pairs:

1. *Punctured balls.*  Half the radius of 3 is 1.5.  With balls of radius 1
   around both sides, two fingerprints meet up to distance 2; deleting one of
   three bit blocks absorbs the third bit.  If a block holds two of the
   differing bits, deleting it leaves at most one; otherwise each block holds
   at most one, and deleting block 0 leaves at most two.  So block 0 needs
   radius 1 on both sides, blocks 1 and 2 on one side only (the side whose
   remaining bits have even parity).  That is 88 variants a fingerprint on
   average, each on 42 or 43 bits.
2. *Small groups* (up to ``small`` fingerprints on a variant): pairs are
   verified one by one; two of them are the aggregate's minimum and maximum.
3. *Large groups* would have a quadratic number of pairs.  Their members are
   verified against the smallest one.  In a group that steps 2 and 3 leave in
   several components, only members outside its largest component can add
   links: up to ``outside`` of them are verified against all members.
4. *Groups with more outsiders* emit whole balls over all 64 bits: every member
   radius 1 (near), the outsiders radius 2 (far) as well.  Members of one variant
   at radius 1 are linked to every member at radius 2 by the triangle inequality,
   so a star around the smallest radius-1 member keeps the connectivity with a
   linear number of edges.  A missing link has an outsider, and as two of any
   three bits lie in the same half of the word, only pairs of flips within a
   half are needed.

Steps 2 to 4 give every link of distance 3 or less as a path, and no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import components, cut

RADIUS = 3
_ALL = (1 << 64) - 1
_BLOCKS = (range(0, 22), range(22, 43), range(43, 64))
_CHUNK = 1 << 16
#: Rows of four longs that may be broadcast, some 10 MB; more of them are shuffled.
_BROADCAST_ROWS = 100_000
#: Fingerprints that one task expands to their variants.
_EXPANDED = 20_000


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, width: int = 3) -> int:
    """The fingerprint of one text as an unsigned integer; zero if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) < width:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    votes, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for at in range(0, len(starts), _CHUNK):  # long texts in bounded memory
        part = zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist(), strict=True)
        raw = np.frombuffer(b"".join([digest(joined[s:e], 42) for s, e in part]), np.uint8)
        votes += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(votes * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(doc_id, fp)`` with ``fp`` the fingerprint as a signed long; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [_signed(fingerprint(t.as_py(), width)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, fp long"
    )


def _flips(bits: range) -> Column:
    return F.array(*[F.lit(_signed(1 << b)) for b in bits])


def _ball(centre: Column, flips: Column) -> Column:
    # the lambda has one parameter only: a second would be bound to the index
    return F.transform(flips, lambda x: centre.bitwiseXOR(x))


def _punctured(fp: str = "fp") -> Column:
    """The variants of step 1."""
    out = []
    for k, block in enumerate(_BLOCKS):
        kept = F.col(fp).bitwiseAND(F.lit(_signed(_ALL ^ sum(1 << b for b in block))))
        ball = _ball(kept, _flips([b for b in range(64) if b not in block]))
        if k:
            ball = F.when(F.bit_count(kept) % 2 == 0, ball).otherwise(F.array().cast("array<bigint>"))
        out += [F.array(kept), ball]
    return F.concat(*out)


def _balls(fp: str = "fp", outsider: str = "outsider") -> Column:
    """The variants of step 4 as ``(variant, far)``."""
    col = F.col(fp)
    near = F.transform(F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)) for b in range(64)]), lambda x: F.struct(col.bitwiseXOR(x).alias("variant"), F.lit(False).alias("far")))
    pairs = [(1 << i) | (1 << j) for half in (range(32), range(32, 64)) for i in half for j in half if i < j]
    far = F.transform(
        F.array(*[F.lit(_signed(x)) for x in pairs]),
        lambda x: F.struct(col.bitwiseXOR(x).alias("variant"), F.lit(True).alias("far")),
    )
    return F.when(F.col(outsider), F.concat(near, far)).otherwise(near)


def _close(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS


def _with_centres(keyed: DataFrame, centres: DataFrame) -> DataFrame:
    """``keyed`` with its variant's row of ``centres``, which is broadcast only while it has few rows."""
    return keyed.join(centres.hint("broadcast" if centres.count() <= _BROADCAST_ROWS else "merge"), "variant")


def _ball_stars(open_: DataFrame) -> DataFrame:
    """Step 4 for fingerprints ``(fp, outsider)``."""
    ball = open_.select("fp", F.explode(_balls()).alias("v")).select("fp", "v.variant", "v.far")
    centres = (
        ball.groupBy("variant")
        .agg(F.min(F.when(~F.col("far"), F.col("fp"))).alias("centre"), F.count("*").alias("n"))
        .where("n > 1 and centre is not null")
    )
    return ball.join(centres, "variant").where("fp != centre").select(F.col("fp").alias("a"), F.col("centre").alias("b"))


def links(distinct: DataFrame, small: int = 6, outside: int = 16) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints ``fp``, whose paths are those of all links of distance <= 3."""
    keyed = distinct.select("fp", F.explode(_punctured()).alias("variant"))
    shared = cut(keyed.groupBy("variant").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    two = shared.where((F.col("n") == 2) & _close("a", "b")).select("a", "b")
    centres = cut(shared.where("n > 2").select("variant", "n", F.col("a").alias("centre")))
    found = cut(_with_centres(keyed, centres))
    few = found.where(F.col("n") <= small).select("variant", "fp")
    pairs = (
        few.select("variant", F.col("fp").alias("a"))
        .join(few.select("variant", F.col("fp").alias("b")), "variant")
        .where((F.col("a") < F.col("b")) & _close("a", "b"))
        .select("a", "b")
    )
    many = found.where(F.col("n") > small)
    direct = many.where(_close("fp", "centre") & (F.col("fp") != F.col("centre"))).select(F.col("fp").alias("a"), F.col("centre").alias("b"))
    sure = cut(two.union(pairs).union(direct).distinct())
    roots = components(sure).withColumnsRenamed({"node": "fp"})
    rooted = cut(many.join(roots, "fp", "left").select("variant", "fp", F.coalesce("root", "fp").alias("root")))
    # groups that lie within one component already have nothing to add
    size = F.struct("members", "root")
    mixed = (
        rooted.groupBy("variant", "root")
        .agg(F.count("*").alias("members"))
        .groupBy("variant")
        .agg(F.max(size)["root"].alias("main"), (F.sum("members") - F.max("members")).alias("beyond"))
        .where("beyond > 0")
    )
    open_ = cut(rooted.join(mixed, "variant").withColumn("outsider", F.col("root") != F.col("main")))
    tame = open_.where(F.col("beyond") <= outside)
    checked = (
        tame.where("outsider").select("variant", F.col("fp").alias("a"), F.col("root").alias("of_a"))
        .join(tame.select("variant", F.col("fp").alias("b"), F.col("root").alias("of_b")), "variant")
        .where((F.col("of_a") != F.col("of_b")) & _close("a", "b"))
        .select("a", "b")
    )
    wild = open_.where(F.col("beyond") > outside).groupBy("fp").agg(F.max("outsider").alias("outsider"))
    return sure.union(checked.union(_ball_stars(wild)).distinct())


def _rooted(prints: DataFrame, small: int) -> DataFrame:
    """``(fp, first_id, root)``: each distinct fingerprint of ``prints(doc_id, fp)`` with the smallest one that links reach."""
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    # few bytes become many rows: dealt out by their number
    distinct = classes.select("fp").repartition(classes.count() // _EXPANDED + 1, "fp")
    roots = components(links(distinct, small)).withColumnsRenamed({"node": "fp"})
    return cut(classes.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, small: int = 6
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    Nulls and texts without words have fingerprint zero and are linked like
    any other; rows with the same fingerprint are one class; repeated rows give
    repeated results; other columns are not read, so their names cannot clash;
    an empty table gives an empty result.  Long texts are hashed whole.  Rows
    without an id belong to their component, but don't name it: its id is null
    only where no row has one.
    """
    prints = cut(fingerprints(docs, id_col, text_col, width))
    labelled = _rooted(prints, small)
    firsts = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = labelled.join(firsts, "root").select("fp", "component_id")
    return prints.join(of, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, small: int = 6) -> DataFrame:
    """One row of ``docs``, with all its columns, for each component of near-duplicates.

    It is the row with the smallest id; rows without an id come last.  An id
    with several texts stands for each of them: rows are told apart by id and
    fingerprint, so a text that nobody else has always stays.  Of repeated rows
    one stays.  Fingerprints are computed once more beside the full rows, which
    costs less than to shuffle the texts twice.
    """
    labelled = _rooted(cut(fingerprints(docs, id_col, text_col, width)), small)
    order = F.struct(F.col("first_id").isNull().alias("last"), "first_id", "fp")
    best = labelled.groupBy("root").agg(F.min(order).alias("x")).select(F.col("x.first_id").alias("_kept_id"), F.col("x.fp").alias("_kept_fp"))
    at = docs.columns.index(text_col)
    taken = {n.lower() for n in docs.columns}
    fresh, known, none = [next(n for n in (f"_{x}{k}" for k in range(len(docs.columns) + 1)) if n not in taken) for x in ("fp", "id", "none")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([_signed(fingerprint(t.as_py(), width)) for t in batch.column(at)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, fresh])

    marked = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(fresh, T.LongType())]))
    # the id is spelled out as two columns that are never null, so that one exchange of the texts serves the join and the repeated rows
    spelled = lambda c: (F.coalesce(c, F.lit(0).cast("long")), c.isNull())
    row, kept = spelled(F.col(f"`{id_col}`").cast("long")), spelled(F.col("_kept_id"))
    marked = marked.withColumns({known: row[0], none: row[1]})
    best = best.select(kept[0].alias(known), kept[1].alias(none), F.col("_kept_fp").alias(fresh))
    found = marked.join(best.hint("shuffle_hash"), [known, none, fresh], "left_semi")
    return found.dropDuplicates([id_col, known, none, fresh]).drop(fresh, known, none)
