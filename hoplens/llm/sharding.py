"""Shards by jump consistent hashing."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from hoplens.llm.common import whole_text

#: Bytes added to each row's size for its key and framing.
ROW_OVERHEAD = 16

#: Rows of a shard that one task numbers, about, and bounds of the number of blocks of all shards.
BLOCK_ROWS, LEAST_BLOCKS, MOST_BLOCKS = 50_000, 64, 1_000_000


def _random(key: Column, step: Column) -> Column:
    """The step-th number of the key's own sequence, in (0, 1]."""
    digest = F.md5(F.concat_ws(":", key, step.cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 1) / F.lit(2.0**32)


def jump_hash(key: Column, shards: int) -> tuple[Column, Column]:
    """The key's shard among ``shards`` and among one more.

    The key's random sequence decides at which shard counts the key jumps; its shard is the last jump below the count.
    So the second value differs from the first only by being the new shard. A null key counts as the empty string.
    """
    name = F.coalesce(key.cast("string"), F.lit(""))
    number = lambda value: F.lit(value).cast("int")
    start = F.struct(number(-1).alias("shard"), number(-1).alias("grown"), number(0).alias("jump"))

    def step(state: Column, at: Column) -> Column:
        landed = state["jump"]
        # A jump past both counts is cut there: it is as good as any other.
        far = F.least(F.floor((landed + 1) / _random(name, at)), F.lit(shards + 1)).cast("int")
        moved = F.struct(
            F.when(landed < shards, landed).otherwise(state["shard"]).alias("shard"), landed.alias("grown"), far.alias("jump")
        )
        return F.when(landed <= shards, moved).otherwise(state)

    last = F.aggregate(F.sequence(F.lit(0), F.lit(shards + 1)), start, step)
    return last["shard"], last["grown"]


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """Every row's shard, and its slot in the shard.

    Returns ``key, size, text_crc32, shard, slot, grown_shard``, one row per input row; other columns are not read. Rows of
    one key share a shard. Slots are gapless from 0 in each shard; which row has which slot is settled by the key within
    blocks of a shard, at will between rows that are equal. A null text has 0 bytes and the checksum of no bytes; a null
    key is a key of its own. An empty table gives no rows.
    """
    text = whole_text()
    # Blocks of a shard. All of them are one row each of a table that is sent to every task.
    blocks = max(LEAST_BLOCKS, min(MOST_BLOCKS // shards, -(-docs.count() // (shards * BLOCK_ROWS))))
    # Both numbers come from one walk, so the state is kept as one column.
    shard, grown = jump_hash(F.col(key), shards)
    placed = docs.select(
        key,
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shard.alias("shard"),
        grown.alias("grown_shard"),
        F.pmod(F.xxhash64(F.col(key), text), F.lit(blocks)).cast("int").alias("__block"),
    )
    # At most shards x blocks rows.
    counts = placed.groupBy("shard", "__block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("shard", "__block").orderBy(key, "text_crc32", "size")
    return (
        placed.withColumn("__rank", F.row_number().over(within))
        .join(F.broadcast(offsets), ["shard", "__block"])
        .select(
            key,
            "size",
            "text_crc32",
            "shard",
            (F.col("__before") + F.col("__rank") - 1).cast("long").alias("slot"),
            "grown_shard",
        )
    )
