"""Importance resampling towards a target distribution, over hashed word features.

Features are the runs of 1 to ``longest`` consecutive words; each falls into
one of ``buckets`` by its crc32. Both tables are counted once: a task adds up
its own rows, so at most ``buckets`` totals a task are shuffled. The gains are
a literal array. A document is scored inside its own row: higher-order
functions make the array of its buckets and add up the gains found at them, so
no text is exploded or moved. Gumbel noise from a hash of the id turns the
highest scores into a draw without replacement.

Ranks need no single task: scored rows are sorted by range, each partition
numbers its own, and the sizes of the partitions (as many as there are
partitions) give where each begins.

Defined results: a null or empty text has no words, a weight of 0 and is never
drawn when ``least_words`` is above 0; a null id counts as empty text in the
hash and comes before all others among ties; repeated rows are scored and drawn
each for itself, in any order among themselves; an empty table gives no rows;
an empty target gives gains from the smoothing alone; other columns are
ignored whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
#: Lower-case words: ASCII digits and letters, and all that is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def bucket(feature: Column, buckets: int) -> Column:
    return F.crc32(feature.cast("binary")) % buckets


def features(found: Column, longest: int) -> Column:
    """All runs of 1 to ``longest`` words, joined by one space."""

    def of(w: Column, n: int) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))

    if longest == 1:
        return found
    # The words are bound once: the optimizer would else put their whole expression inside each lambda.
    return F.transform(F.array(found), lambda w: F.concat(w, *(of(w, n) for n in range(2, longest + 1))))[0]


def totals(docs: DataFrame, *, text: str = "text", longest: int = 1, buckets: int = BUCKETS) -> dict[int, int]:
    """How many features of all documents fall into each bucket; at most ``buckets`` rows reach the driver."""
    each = docs.select(F.explode(features(words(docs[text]), longest)).alias("feature"))
    return {r[0]: r[1] for r in each.groupBy(bucket(F.col("feature"), buckets).alias("bucket")).count().collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """floor(1000 ln(target share / source share)) of each bucket, both smoothed by one count a bucket."""
    s_all, t_all = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s_all / ((source.get(b, 0) + 1.0) * t_all))) for b in range(buckets)]


def weigh(docs: DataFrame, gain: list[int], *, doc_id: str = "doc_id", text: str = "text", longest: int = 1, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document; nothing is shuffled."""
    # One literal: the optimizer folds the cast of the split text before any row is read.
    table = f"cast(split('{','.join(map(str, gain))}', ',') as array<bigint>)"
    out = docs.select(docs[doc_id].alias("doc_id"), words(docs[text]).alias("words"))
    out = out.select("doc_id", F.size("words").cast("bigint").alias("n_words"), F.transform(features(F.col("words"), longest), lambda w: bucket(w, len(gain))).alias("buckets"))
    weight = F.expr(f"aggregate(buckets, 0L, (sum, b) -> sum + element_at({table}, cast(b + 1 as int)))")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln(share)))
    out = out.select("doc_id", "n_words", F.size("buckets").cast("bigint").alias("n_features"), weight.alias("weight"), noise.cast("bigint").alias("noise"))
    return out.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + F.col("noise")).alias("score"))


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds ``rank`` to the drawn rows, 1 for the highest score; null to all others."""
    spark = scored.sparkSession
    # Row numbers are part of the written table: rows that are alike in all else stay apart, and a lost task gives them again.
    rows, path = common.write_table(scored.withColumn("row", F.monotonically_increasing_id()), "resampling-scored")
    long_enough = F.col("n_words") >= least_words
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("row")]
    sorted_ = rows.where(long_enough).repartitionByRange(common.partitions(spark), *order).sortWithinPartitions(*order)
    # The number within a partition stands in the lower 33 bits.
    placed, placed_path = common.write_table(sorted_.withColumn("place", F.monotonically_increasing_id()), "resampling-sorted")
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("part")).count().collect())
    begins, n = {}, 0
    for p, size in sizes:
        begins[p], n = n, n + size
    starts = F.expr(f"map({', '.join(f'{p}L, {b}L' for p, b in begins.items())})" if begins else "cast(map() as map<bigint,bigint>)")
    rank = F.element_at(starts, part) + within + 1
    drawn = placed.withColumn("rank", F.when(rank <= percent * n // 100, rank)).drop("place")
    rest = rows.where(~long_enough | F.col("n_words").isNull()).withColumn("rank", F.lit(None).cast("bigint"))
    return drawn.unionByName(rest).drop("row")


def resample(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = 1, buckets: int = BUCKETS,
             percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document; rank is null where it isn't drawn."""
    gain = gains(totals(docs, text=text, longest=longest, buckets=buckets), totals(target, text=target_text, longest=longest, buckets=buckets), buckets)
    return ranked(weigh(docs, gain, doc_id=doc_id, text=text, longest=longest, seed=seed), percent, least_words)
