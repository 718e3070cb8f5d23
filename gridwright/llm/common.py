"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, as one run; the only white space that the operators know.
WHITE = r"[\x20\x09-\x0D]+"
WHITE_BYTES = b" \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the given folder, by any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, one of our own on a single machine; on a cluster an error, as no other machine would see it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="gridwright-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The application's own folder in the shared one; all intermediate tables lie there."""
    return f"{shared_dir(spark)}/gridwright-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path for a table in the application's folder."""
    return f"{run_dir(spark)}/{what}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Delete the application's intermediate tables; for when all results that read them are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, what: str) -> DataFrame:
    """`df` written to the shared folder and read back, so that its lineage ends here."""
    path = shared_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame, *columns: Column, keep: list[str]) -> DataFrame:
    """`columns`, those of `keep` as c0, c1, … and all others in a struct `rest`: what operators add can't clash with a user's names."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in keep]
    return docs.select(*columns, *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.struct(F.lit(True).alias("_"), *[c.alias(f"r{i}") for i, c in enumerate(others)]).alias("rest"))


def unpacked(rows: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """The user's columns of packed rows, under their names and in their order."""
    others = [c for c in columns if c not in keep]
    return rows.select(*[(F.col(f"c{keep.index(c)}") if c in keep else F.col(f"rest.r{others.index(c)}")).alias(c) for c in columns])


#: Keys with over a thousandth of all rows, and this many, are hot; there can be no more than a thousand of them.
HOT_SHARE, HOT_ROWS = 1000, 256


def hot_keys(rows: DataFrame, key: str) -> list:
    """The hot values of `key`: at most HOT_SHARE of them come to the driver, whatever the rows."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    return [r[0] for r in counts.where(F.col("n") > max(HOT_ROWS, total // HOT_SHARE)).select(key).collect()]


def join_to_one(rows: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """Inner join of `rows` with `one`, which has one row for each `key`.

    Rows of hot keys stay where they are: their rows of `one`, a thousand at most, are broadcast.
    The others are shuffled by key. `rows` is read twice, so it should be a written table.
    """
    hot = hot_keys(rows, key)
    if not hot:
        return rows.join(one, key)
    is_hot = F.col(key).isin(hot)
    return rows.where(~is_hot).join(one.where(~is_hot), key).unionByName(rows.where(is_hot).join(F.broadcast(one.where(is_hot)), key))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text: str) -> int:
    """UTF-8 bytes of all texts: one pass that only sizes partitions, never limits work."""
    return docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")


def pieces(batch, column: str, most: int = 4 << 20):
    """Slices of an Arrow batch of about `most` bytes of `column`, one row at least; nothing is left out."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def gather(flat, starts, lengths):
    """The runs flat[starts[i]:starts[i] + lengths[i]], one after another."""
    import numpy as np

    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]
