"""Mixing sources to target weights by thresholds on hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthgrid.llm.common import key_hash, stored
from hearthgrid.session import join_settled

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
HASH_BITS = 60
LEVEL_BITS = 12


def n_words(text: Column) -> Column:
    """Number of words: runs of characters other than space and control characters 9 to 13."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
) -> DataFrame:
    """``source``, ``source_size`` and ``target`` of each source, from a row per source.

    Sources in code-point order, null last, take the weights in turn. Together they get
    ``share`` times all sizes, by weight; none more than ``repeats`` times its own size.
    What exceeds that goes to the others by weight until none is above. So all sources
    below their limit share one level, target / weight. It is found in one pass over the
    sources by limit / weight: the first source whose limit is not below it sets the level, and it is
    the highest of all that later sources would set.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.select(
        "source",
        "source_size",
        F.element_at(
            F.array(*[F.lit(w) for w in weights]),
            ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"),
        ).alias("weight"),
    ).withColumn("limit", F.col("source_size") * repeats)
    order = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    every = W.partitionBy()
    level = (F.sum("source_size").over(every) * share - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum(
        "weight"
    ).over(after)
    levels = ranked.withColumn("level", level).withColumn(
        "level", F.max(F.when(F.col("limit") / F.col("weight") >= F.col("level"), F.col("level"))).over(every)
    )
    bounded = F.when(
        F.col("limit") / F.col("weight") < F.col("level"), F.col("limit").cast("double")
    ).otherwise(F.col("level") * F.col("weight"))
    return levels.select("source", "source_size", bounded.alias("target"))


def _narrow(df: DataFrame, key: str, source: str, text: str, hash_bits: int) -> DataFrame:
    return df.select(
        F.col(key).alias("key"),
        F.col(source).alias("source"),
        n_words(F.col(text)).alias("size"),
        F.shiftright(key_hash(F.col(key)), HASH_BITS - hash_bits).alias("hash"),
    )


def mix_thresholds(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
    hash_bits: int = HASH_BITS,
) -> DataFrame:
    """A row per source: ``source_size``, ``target``, ``whole`` and ``threshold``.

    ``docs`` has ``source``, ``size`` and ``hash`` of each document. A source takes all its
    documents ``whole`` times, and once more those whose hash lies below ``threshold``: the
    one at which the sizes below it come nearest to the rest of the target (the lower one
    of two alike). It is found without sorting documents: sizes are summed by source and
    leading bits of the hash, the running sum names the bucket where the rest is reached,
    and only that bucket is summed again by the next bits, down to single hash values.

    Every step shuffles sums only, so a hot source costs no more than others.
    """
    totals = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, share, repeats)
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    targets = stored(targets.withColumn("whole", whole), "mix-targets")
    # ``prefix``: leading bits of the bucket still open; ``below``: words under it.
    state = targets.select(
        "source",
        (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"),
        F.lit(0).cast("long").alias("prefix"),
        F.lit(0).cast("long").alias("below"),
        F.lit(None).cast("long").alias("inside"),
    )
    left = hash_bits
    while left > 0:
        bits = min(LEVEL_BITS, left)
        inside = join_settled(docs, state.drop("inside"), ["source"]).where(
            F.shiftright("hash", left) == F.col("prefix")
        )
        sums = inside.groupBy("source", F.shiftright("hash", left - bits).alias("bucket")).agg(
            F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("below").alias("base")
        )
        running = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        below = F.col("base") + F.coalesce(F.sum("words").over(running), F.lit(0))
        # The last bucket that has words and begins at or under the rest.
        reached = sums.withColumn("below", below).where((F.col("below") <= F.col("rest")) & (F.col("words") > 0))
        last = F.max_by(F.struct("rest", "bucket", "below", "words"), "bucket").alias("s")
        state = stored(
            reached.groupBy("source").agg(last).select(
                "source", "s.rest", F.col("s.bucket").alias("prefix"), "s.below", F.col("s.words").alias("inside")
            ),
            "mix-state",
        )
        left -= bits
    nearer = F.col("below") + F.col("inside") - F.col("rest") < F.col("rest") - F.col("below")
    thresholds = state.select(
        "source", (F.col("prefix") + F.when(nearer, 1).otherwise(0)).alias("threshold")
    )
    return stored(join_settled(targets, thresholds, ["source"], "left"), "mix-thresholds")


def _copies(repeats: int) -> Column:
    copies = F.col("whole") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)
    return F.least(copies, F.lit(repeats)).cast("long")


def with_mix(
    df: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
    hash_bits: int = HASH_BITS,
) -> DataFrame:
    """``key``, ``source``, ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    The result depends on keys and sizes alone, so reruns agree. Documents without words
    have size 0. Rows that share a key share a hash: they are taken together. A null key or
    source is one like any other. ``hash_bits`` below 60 makes documents share hashes.
    """
    docs = stored(_narrow(df, key, source, text, hash_bits), "mix-sizes")
    thresholds = mix_thresholds(docs, weights, share, repeats, hash_bits)
    copies = _copies(repeats)
    return join_settled(docs, thresholds, ["source"]).select(
        F.col("key").alias(key),
        F.col("source").alias(source),
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (F.col("size") * copies).alias("taken"),
    )


def repeated_by_mix(
    df: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
) -> DataFrame:
    """The rows as often as the mix takes them, so that sources come near their targets.

    A row meets only its source's threshold, a row per source; texts are not shuffled
    unless there are too many sources to broadcast.
    """
    docs = stored(_narrow(df, key, source, text, HASH_BITS).drop("key"), "mix-sizes")
    thresholds = mix_thresholds(docs, weights, share, repeats).select(
        F.col("source").alias("__source"), "whole", "threshold"
    )
    joined = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(source).alias("__own"), key_hash(F.col(key)).alias("hash"))
    taken = joined.join(thresholds, F.col("__own").eqNullSafe(F.col("__source")))
    copies = F.sequence(F.lit(1).cast("long"), _copies(repeats))
    return taken.where(_copies(repeats) > 0).select("row", F.explode(copies)).select("row.*")
