"""Sharding by a permutation-filled lookup table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthgrid.llm.common import key_hash

# Prime, and a hundred times the number of shards at least, so that shards differ by about
# one percent in slots.
TABLE_SIZE = 4099
SHARDS = tuple(f"shard-{i:02d}" for i in range(32))

# Preferences that a turn looks at before it looks at all that are left.
GLANCE = 64

# One turn for each slot. A shard's cursor is its first preference not yet looked at.
FILL = """
aggregate(
  sequence(0, {size} - 1),
  named_struct('owner', array_repeat(-1, {size}), 'cursor', array_repeat(0, {n})),
  (state, turn) -> transform(
    array(coalesce(
      get(filter(
        sequence(state.cursor[turn % {n}], least(state.cursor[turn % {n}] + {glance}, {size} - 1)),
        j -> state.owner[(start[turn % {n}] + j * step[turn % {n}]) % {size}] = -1
      ), 0),
      get(filter(
        sequence(state.cursor[turn % {n}], {size} - 1),
        j -> state.owner[(start[turn % {n}] + j * step[turn % {n}]) % {size}] = -1
      ), 0)
    )),
    place -> named_struct(
      'owner', concat(
        slice(state.owner, 1, cast((start[turn % {n}] + place * step[turn % {n}]) % {size} as int)),
        array(turn % {n}),
        slice(state.owner, cast((start[turn % {n}] + place * step[turn % {n}]) % {size} as int) + 2, {size})
      ),
      'cursor', transform(
        state.cursor, (cursor, shard) -> if(shard = turn % {n}, place + 1, cursor)
      )
    )
  )[0],
  state -> state.owner
)
"""


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def shard_table(
    spark: SparkSession, shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE
) -> DataFrame:
    """The lookup table: ``slot`` 0 to size - 1 and the ``shard`` that owns it.

    Every shard prefers the slots in an order of its own: from a start, in steps, both
    hashes of its name; the prime size makes any step visit all slots. Shards take turns
    in the order given and claim their next free slot until none is left. Shards thus own
    equal shares, give or take one slot, and adding or removing a shard moves few slots.

    The table has ``size`` rows whatever the data. It is filled by one SQL expression, in
    time that grows with the square of ``size``.
    """
    if not is_prime(size):
        raise ValueError(f"{size} is not prime")
    if not 0 < len(set(shards)) == len(shards) <= size:
        raise ValueError("shards need distinct names, and a slot each")
    names = F.array(*[F.lit(s) for s in shards])
    one = (
        spark.range(1, numPartitions=1)
        .withColumn("names", names)
        .withColumn("start", F.transform("names", lambda s: key_hash(F.concat(s, F.lit("#start"))) % size))
        .withColumn("step", F.transform("names", lambda s: key_hash(F.concat(s, F.lit("#step"))) % (size - 1) + 1))
    )
    # The aggregation keeps the optimizer from computing the hashes anew in every turn.
    once = one.groupBy("id").agg(*[F.first(c).alias(c) for c in ("names", "start", "step")])
    filled = once.withColumn("owner", F.expr(FILL.format(size=size, n=len(shards), glance=GLANCE)))
    return filled.select("names", F.posexplode("owner").alias("slot", "number")).select(
        "slot", F.element_at("names", F.col("number") + 1).alias("shard")
    )


def with_shards(
    df: DataFrame, key: str, shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE
) -> DataFrame:
    """Add ``slot`` and ``shard`` of each row, from the hash of its key's text.

    One hash and one lookup in the broadcast table (``size`` rows, a fixed bound): no
    shuffle, and no part in it for other columns, so a hot source spreads like any other.
    Rows with a null key share the slot of the text ``null``; rows that repeat share one.
    Columns of the names ``slot`` and ``shard`` in the input are replaced.
    """
    table = shard_table(df.sparkSession, shards, size)
    plain = df.drop("slot", "shard")
    placed = plain.withColumn("slot", (key_hash(plain[key]) % size).cast("int"))
    return placed.join(F.broadcast(table), "slot").select(*plain.columns, "slot", "shard")
