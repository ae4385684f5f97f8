"""Validation of question/answer pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.qa import parse_verdict, structurally_sound


def structural(pairs: DataFrame, need_details: bool = True) -> DataFrame:
    """Pairs fit to be shown to a model; a filter before the calls, so that none is wasted.

    Pairs of multiple choice have no ``answer`` and fail here, as in the original rules.
    """
    ok = structurally_sound(F.col("question"), F.col("answer"))
    return pairs.where(ok & F.col("source_details").isNotNull() if need_details else ok)


def accepted(response: Column, fail_open: bool = True) -> Column:
    """All four verdicts are positive; a failed call (null) accepts, unless ``fail_open`` is off."""
    v = parse_verdict(response)
    return F.when(response.isNull(), F.lit(fail_open)).otherwise(v["grammar"] & v["answerable"] & v["topic"] & v["ethics"])


def sample(pairs: DataFrame, rate: float, key: str = "id") -> DataFrame:
    """``pairs`` with ``sampled``: ``max(1, floor(n * rate))`` of them, without replacement.

    Those with the smallest MD5 of ``key`` are taken.  Counts by the hash's first
    digits find the bucket in which the last of them lies; only that bucket,
    one in 65,536 rows, is ordered.  A rate of 1 or more takes all without it.
    ``pairs`` is read three times, so a model's output should be stored before.
    """
    if rate >= 1:
        return pairs.withColumn("sampled", F.lit(True))
    h = F.md5(F.col(key).cast("string").cast("binary"))
    place = F.struct(h.alias("h"), F.col(key).alias("k"))
    counts = sorted(tuple(r) for r in pairs.groupBy(F.substring(h, 1, 4).alias("b")).agg(F.count("*").alias("n")).collect())
    left = max(1, int(sum(n for _, n in counts) * rate))
    for bucket, n in counts:
        if left <= n:
            last = pairs.where(F.substring(h, 1, 4) == bucket).select(place.alias("p")).orderBy("p").limit(left).agg(F.max("p").alias("p")).first()["p"]
            bound = F.struct(F.lit(last["h"]).alias("h"), F.lit(last["k"]).alias("k"))
            return pairs.withColumn("sampled", place <= bound)
        left -= n
    return pairs.withColumn("sampled", F.lit(False))


def stats(pairs: DataFrame) -> DataFrame:
    """Rejected by form, submitted, accepted, and the last in per cent of the second, of ``pairs(sound, accepted)``."""
    return pairs.agg(
        F.count_if(~F.col("sound")).alias("rejected"),
        F.count_if("sound").alias("submitted"),
        F.count_if(F.col("sound") & F.col("accepted")).alias("accepted"),
    ).withColumn("accepted_pct", F.round(100.0 * F.col("accepted") / F.nullif(F.col("submitted"), F.lit(0)), 1))
