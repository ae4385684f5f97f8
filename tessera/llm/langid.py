"""Language identification by nearest centroids of TF-IDF n-gram vectors.

Texts become counts of hashed letter 1- to 3-grams, damped, weighted by inverse
document frequency and normalised.  Each language has several centroids from
spherical k-means.  A text takes the language of the centroid with the largest
cosine; one that is too far from all centroids is marked as rejected.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut

BITS = 13
_CHUNK = 1 << 20
_PARTS = 32
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point whether its category is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _counts(codes: np.ndarray, fresh: int) -> np.ndarray:
    """Counts of the 1- to 3-grams of ``codes`` that end at place ``fresh`` or later."""
    c = codes.astype(np.uint64)
    pairs = (c[:-1] << np.uint64(21) | c[1:]) + np.uint64(1 << 50)
    triples = (c[:-2] << np.uint64(42)) ^ (c[1:-1] << np.uint64(21)) ^ c[2:]
    grams = [c[fresh:], pairs[max(0, fresh - 1) :], triples[max(0, fresh - 2) :]]
    hashed = np.concatenate([(g * _MULTIPLIER) >> np.uint64(64 - BITS) for g in grams])
    return np.bincount(hashed.astype(np.int64), minlength=1 << BITS)


def features(text: str | None) -> np.ndarray | None:
    """Damped n-gram counts of the whole text; None if it is null or has no letter.

    What isn't a letter is a space, runs of them are one, and one stands at
    either end.  Long texts are read in chunks, which carry their last two
    characters over, so their counts don't depend on the chunks.
    """
    if not text:
        return None
    letters, total = _letters(), np.zeros(1 << BITS)
    held, seen = np.zeros(0, np.uint32), False
    for at in range(0, len(text), _CHUNK):
        codes = np.frombuffer(text[at : at + _CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = letters[codes]
        codes = np.where(letter, codes, 32)
        if not at:
            codes, letter = np.r_[np.uint32(32), codes], np.r_[False, letter]
        seen = seen or bool(letter.any())
        before = np.r_[bool(len(held)) and held[-1] != 32, letter[:-1]]
        codes = codes[letter | before | (not at) & (np.arange(len(codes)) == 0)]
        joined = np.concatenate([held, codes])
        total += _counts(joined, len(held))
        held = joined[-2:]
    if held[-1] != 32:
        total += _counts(np.r_[held, np.uint32(32)], len(held))
    return np.log1p(total) if seen else None


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    reject_below: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine and whether the text is rejected."""
        v = features(text)
        if v is None or not self.languages:
            return "und", 0.0, True
        v = v.astype(np.float32) * self.idf
        norm = np.linalg.norm(v)
        cosines = self.centroids @ v / norm if norm else np.zeros(len(self.languages))
        k = int(np.argmax(cosines))
        score = float(min(1.0, max(0.0, cosines[k])))
        return self.languages[k], score, score < self.reject_below


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; deterministic."""
    picked = [int(np.argmax(x @ x.mean(0)))]
    while len(picked) < min(k, len(x)):
        picked.append(int(np.argmin((x @ x[picked].T).max(1))))
    c = x[picked]
    for _ in range(rounds):
        of = (x @ c.T).argmax(1)
        c = np.stack([x[of == j].mean(0) if (of == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(
    rows: DataFrame, per_language: int = 300, clusters: int = 4, reject_below: float = 0.08, id_col: str = "doc_id"
) -> Model:
    """Learn from ``rows(doc_id, text, lang)`` with a language.

    The classifier is fitted on a bounded sample: of each language the
    ``per_language`` ids with the smallest hash, one row an id.  Partitions keep their
    own smallest first, so no language meets in one task.  Document frequencies are
    summed and centroids made on the executors, a language's sample in one task; the driver
    gets the sample's ids, the frequencies and the centroids, which are the model.
    Rows without an id or a language teach nothing; an empty table gives a model
    that rejects everything.
    """
    rows = rows.where(F.col("lang").isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    keyed = rows.select("lang", "doc_id", F.xxhash64("doc_id").alias("h"))

    # in two levels, so that the last task reads a bounded number of rows, however many partitions there are;
    # before each exchange, the window's limit leaves a task's own smallest
    first = keyed.withColumn("part", F.spark_partition_id() % _PARTS)
    for level in (["lang", "part"], ["lang"]):
        first = first.withColumn("k", F.dense_rank().over(Window.partitionBy(*level).orderBy("h", "doc_id"))).where(F.col("k") <= per_language).drop("k")
        first = first.dropDuplicates([*level, "doc_id"])
    ids = sorted(tuple(r) for r in first.select("lang", "doc_id").collect())  # per_language for each language
    spark = rows.sparkSession
    chosen = F.broadcast(spark.createDataFrame(ids, "lang string, doc_id long"))
    sample = rows.join(chosen, ["lang", "doc_id"], "left_semi").groupBy("lang", "doc_id").agg(F.min("text").alias("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(n.as_py(), i.as_py(), features(t.as_py())) for n, i, t in zip(*batch.columns, strict=True)]
            found = [(n, i, np.nonzero(v)[0].astype(np.int16), v) for n, i, v in found if v is not None]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.int64()),
                    pa.array([x[2].tobytes() for x in found], pa.binary()),
                    pa.array([x[3][x[2]].astype(np.float32).tobytes() for x in found], pa.binary()),
                ],
                names=["lang", "doc_id", "at", "v"],
            )

    learnt = cut(sample.mapInArrow(vectors, "lang string, doc_id long, at binary, v binary"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for at in batch.column(0).to_pylist():
                total[np.frombuffer(at, np.int16)] += 1
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.arange(1 << BITS), -1]), pa.array(np.r_[total, n])], names=["gram", "n"])

    counts = {r["gram"]: r["n"] for r in learnt.select("at").mapInArrow(frequencies, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    if not counts.get(-1):
        return Model((), np.zeros((0, 1 << BITS)), np.ones(1 << BITS), reject_below)
    idf = np.log((1 + counts[-1]) / (1 + np.array([counts[g] for g in range(1 << BITS)]))) + 1

    def centroids(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id")
        x = np.zeros((len(frame), 1 << BITS))
        for k, (at, v) in enumerate(zip(frame["at"], frame["v"], strict=True)):
            x[k, np.frombuffer(at, np.int16)] = np.frombuffer(v, np.float32)
        x *= idf
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        c = _clusters(x, clusters)
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "k": range(len(c)), "c": [row.astype(np.float32).tobytes() for row in c]})

    got = sorted(tuple(r) for r in learnt.groupBy("lang").applyInPandas(centroids, "lang string, k int, c binary").collect())
    return Model(tuple(r[0] for r in got), np.stack([np.frombuffer(r[2], np.float32) for r in got]), idf.astype(np.float32), reject_below)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from learning: CRC-32 of its id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, rejected)`` for every row of ``docs``, from its text alone.

    A text that is null or has no letter gets ``und``, score 0 and is rejected.
    Ties go to the first centroid in the order of languages.  Texts are read
    whole; repeated rows give repeated results; an empty table an empty one; other
    columns are not read.  The model is broadcast: its size is that of its centroids.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.float64()),
                    pa.array([x[2] for x in found], pa.bool_()),
                ],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, rejected boolean"
    )


def confident(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns, in one scan.

    Rows keep their columns whatever these are called.  Null texts and those
    without a letter are rejected; repeated rows stay or go together.
    """
    at, shared = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [not shared.value.predict(t.as_py())[2] for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
