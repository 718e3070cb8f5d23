"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in DataFrame functions only.

A row's shard depends on its key and the number of shards alone, without a ring table, and
one more shard takes rows only into itself. The key is the 64-bit hash of `key`, so any type
serves.

Defined cases. A null key has the hash of null and so one fixed shard; a null text has no
bytes and crc32 0. Rows with the same key go to the same shard and get slots of their own, in the
order of crc32 and size; of rows that are the same in all of these any order is right. A long text
is one value, read once. Other columns are carried by `assign_shards`, whose own columns replace
any of the same name; `shard_plan` ignores them. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwright.llm.common import cut, read

#: The multiplier of the published algorithm's generator.
MULTIPLIER = 2862933555777941757
ROW_BYTES = 16
#: Rows of a shard that are sorted together, about.
BLOCK_ROWS = 100_000


def _times_plus_one(key: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2**64, in 22-bit limbs, as long products overflow under ANSI."""
    mask = F.lit((1 << 22) - 1).cast("long")
    m = [F.lit(MULTIPLIER >> s & (1 << 22) - 1).cast("long") for s in (0, 22, 44)]
    k = [key.bitwiseAND(mask), F.shiftrightunsigned(key, 22).bitwiseAND(mask), F.shiftrightunsigned(key, 44)]
    low = k[0] * m[0] + F.lit(1).cast("long")
    mid = k[0] * m[1] + k[1] * m[0] + F.shiftright(low, 22)
    high = k[0] * m[2] + k[1] * m[1] + k[2] * m[0] + F.shiftright(mid, 22)
    return low.bitwiseAND(mask).bitwiseOR(F.shiftleft(mid.bitwiseAND(mask), 22)).bitwiseOR(F.shiftleft(high, 44))


def jump_hashes(key: Column, shards: int) -> Column:
    """struct(shard, grown): where a 64-bit key goes among `shards` shards, and among one more.

    One walk gives both, as it is the same up to its last leap. It takes about the logarithm of
    the number of shards in leaps; the few keys that need more than twice as many go on to the end.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    few = 2 * (shards + 1).bit_length() + 2

    def step(at: Column, _: Column) -> Column:
        following = _times_plus_one(at["key"])
        drawn = (F.shiftrightunsigned(following, 33) + F.lit(1).cast("long")).cast("double")
        leap = F.floor((at["next"] + 1).cast("double") * (F.lit(2.0**31) / drawn)).cast("long")
        on = at["next"] <= F.lit(shards)
        return F.struct(
            F.when(at["next"] < F.lit(shards), at["next"]).otherwise(at["shard"]).alias("shard"),
            F.when(on, at["next"]).otherwise(at["grown"]).alias("grown"),
            F.when(on, leap).otherwise(at["next"]).alias("next"),
            F.when(on, following).otherwise(at["key"]).alias("key"),
        )

    none = F.lit(-1).cast("long")
    start = F.struct(none.alias("shard"), none.alias("grown"), F.lit(0).cast("long").alias("next"), key.alias("key"))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(few)), start, step)
    # each leap is by one shard at least, so as many steps as shards end every walk
    ended = lambda at: F.when(at["next"] <= shards, F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), at, step)).otherwise(at)
    return F.get(F.transform(F.transform(F.array(walked), ended), lambda at: F.struct(at["shard"].cast("int").alias("shard"), at["grown"].cast("int").alias("grown"))), F.lit(0))


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """`docs` with `shard`, and `grown_shard` for one more shard. No shuffle."""
    taken = "__jump"
    while taken in docs.columns:
        taken += "_"
    both = docs.withColumn(taken, jump_hashes(F.xxhash64(F.col(key)), shards))
    return both.withColumns({"shard": F.col(f"{taken}.shard"), "grown_shard": F.col(f"{taken}.grown")}).drop(taken)


def with_slots(rows: DataFrame, blocks: int, key: str = "doc_id") -> DataFrame:
    """`rows` with `slot`: gapless from 0 in each shard. `rows` is read twice.

    A shard is dealt over `blocks` blocks by key and text; each block is numbered by itself and
    starts where the blocks before it end, so no task ever holds a whole shard. The starts
    are shards times blocks rows.
    """
    dealt = rows.withColumn("__block", F.pmod(F.xxhash64(F.lit("block"), F.col(key), "text_crc32", "size"), F.lit(blocks)).cast("int"))
    sizes = dealt.groupBy("shard", "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy("shard").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("shard", "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    order = W.partitionBy("shard", "__block").orderBy(F.col(key).asc_nulls_first(), "text_crc32", "size")
    numbered = dealt.withColumn("__in", F.row_number().over(order) - 1)
    return numbered.join(starts, ["shard", "__block"]).withColumn("slot", (F.col("__start") + F.col("__in")).cast("long")).drop("__block", "__start", "__in")


def shard_plan(docs: DataFrame, shards: int = 40, blocks: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard of every row. Texts are read once; what is known of them is written and read back."""
    utf8 = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    sized = docs.select(key, (F.octet_length(utf8) + ROW_BYTES).cast("long").alias("size"), F.crc32(utf8).alias("text_crc32"), F.lit("key").alias("law"))
    rows = cut(assign_shards(sized, shards, key), "shards")
    blocks = blocks or max(64, -(-rows.count() // (shards * BLOCK_ROWS)))
    return with_slots(rows, blocks, key).select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int, key: str = "doc_id") -> None:
    """A folder of Parquet files for each shard; files of a shard come from many tasks."""
    assign_shards(docs, shards, key).drop("grown_shard").write.partitionBy("shard").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_plan(read(spark, sf_dir, "documents"))
