"""Exact dedup by an extendible-hash index on files in the shared folder.

Texts are equal when they are the same bytes after white space is deleted. Three steps:

1. A pass over the documents writes the entry table: for each batch, equal texts are found by
   their bytes and only the first carries the text, with the count and the best row of its
   copies. A group that holds a third of all rows so becomes one entry for each batch.
2. Owner tasks, each with a range of keys, insert their entries into an extendible hash index:
   an overfull bucket splits by the next bit, and the directory doubles when the bucket was as
   deep as it. Entries with one key form a chain, and bytes decide which are equal. Owners grow
   in number with the bytes of the entries' texts, `OWNERS` for each `TASK_BYTES`, and a task holds
   one at a time. Its buckets are written to the shared folder as pages, a row each: the page's number
   and depth, the places of its owner's directory that lead to it, and its records with their
   texts.
3. Lookups go the index's way: a key's owner, the place of the directory that the key's low bits
   name, the page there, and in it the record. Documents that were inserted find theirs by their
   entry, without texts; `lookup` finds those of other documents by comparing bytes.

Of equal texts the row with the most code points stays, then that with the smallest doc_id,
then the first read. Steps 2 and 3 read only committed files, so a lost executor costs its
tasks alone. A key's range can't be split: entries of one key, which are as many as batches of
documents when a text is very common, meet in one owner's task, and their texts are equal.

Defined cases. Null text counts as empty, and all empty texts are equal. A null doc_id comes
last among equals. Repeated rows are rows of their own: one stays. A long text is one value of
one record, compared whole. Other columns are carried by `drop_copies`, whatever their names.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridwright.llm.common import WHITE_BYTES, cut, packed, partitions, read, shared_path, unpacked

#: Bytes of distinct text of a task, about, and the owners among which it is divided.
TASK_BYTES = 32 << 20
OWNERS = 8
#: What the entry table adds to the rows: only heads have the columns from `size` on.
ADDED = "entry long, key long, sha256 string, head boolean, size long, n long, chars long, least_id long, best_uid long"
RECORD = "struct<key: bigint, text: binary, keep_uid: bigint, keep_id: bigint, group_size: bigint, entries: array<bigint>>"
PAGES = f"owner int, page long, depth int, directory_depth int, places array<bigint>, records array<{RECORD}>"


class ExtendibleIndex:
    """Buckets by the low bits of a key; `insert` returns the record of the key's equal text."""

    def __init__(self, capacity: int = 128):
        self.capacity = capacity
        self.depth = 0
        self.directory: list[tuple[int, dict]] = [(0, {})]  # (local depth, {key: chain})

    def slot(self, key: int) -> int:
        return key & (1 << self.depth) - 1

    def insert(self, key: int, text: bytes) -> dict:
        depth, bucket = self.directory[self.slot(key)]
        chain = bucket.get(key)
        if chain is None:
            while len(bucket) >= self.capacity and depth < 64:
                self._split(key)
                depth, bucket = self.directory[self.slot(key)]
            chain = bucket[key] = []
        for record in chain:
            if record["text"] == text:
                return record
        chain.append({"text": text, "key": key, "entries": [], "n": 0, "best": None})
        return chain[-1]

    def _split(self, key: int) -> None:
        depth, bucket = self.directory[self.slot(key)]
        if depth == self.depth:
            self.directory += self.directory
            self.depth += 1
        halves = ((depth + 1, {}), (depth + 1, {}))
        for k, chain in bucket.items():
            halves[k >> depth & 1][1][k] = chain
        for at in range(key & (1 << depth) - 1, 1 << self.depth, 1 << depth):
            self.directory[at] = halves[at >> depth & 1]

    def pages(self):
        """(page, depth, places of the directory, records) of each bucket; its first place is the page's number."""
        for at, (depth, bucket) in enumerate(self.directory):
            if at < 1 << depth:  # the first of the places that share a bucket
                yield at, depth, range(at, 1 << self.depth, 1 << depth), [record for chain in bucket.values() for record in chain]


def _rank(chars: int, doc_id: int | None, uid: int) -> tuple:
    return (-chars, doc_id is None, doc_id or 0, uid)


def bare(text: bytes | None) -> bytes:
    """The text as it is compared."""
    return (text or b"").translate(None, WHITE_BYTES)


def key_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def _entries(batches):
    """The batches with the columns of ADDED: the first of equal texts is the head of an entry."""
    import pyarrow as pa
    import pyarrow.compute as pc

    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [x.split() for x in ADDED.split(", ")]
    for batch in batches:
        chars = pc.fill_null(pc.utf8_length(batch.column("c0")), 0).to_pylist()
        texts = batch.column("c0").cast(pa.binary())
        uids, ids = batch.column("uid").to_pylist(), batch.column("id").to_pylist()
        first: dict[bytes, int] = {}
        rows = []
        for i, value in enumerate(texts):
            content = bare(value.as_py())
            at = first.setdefault(content, i)
            rank = _rank(chars[i], ids[i], uids[i])
            if at == i:
                digest = hashlib.sha256(content)
                rows.append([uids[i], key_of(digest.digest()), digest.hexdigest(), True, len(content), 1, rank])
            else:
                head = rows[at]
                head[5] += 1
                head[6] = min(head[6], rank)
                rows.append([*head[:3], False, None, None, None])
        flat = [(*r[:6], -r[6][0], None if r[6][1] else r[6][2], r[6][3]) if r[3] else (*r[:6], None, None, None) for r in rows]
        added = [pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*flat, strict=True) if flat else [[]] * len(fields), fields, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *(name for name, _ in fields)])


def _owned(capacity: int):
    def run(batches):
        """The pages of each owner's index; its entries come together. Memory: one owner's distinct texts."""
        import pyarrow as pa

        record = pa.struct([("key", pa.int64()), ("text", pa.binary()), ("keep_uid", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("entries", pa.list_(pa.int64()))])
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(record)]
        names = ["owner", "page", "depth", "directory_depth", "places", "records"]
        signed = lambda k: k - (1 << 64) if k >> 63 else k
        of = lambda r: {"key": signed(r["key"]), "text": r["text"], "keep_uid": r["best"][3], "keep_id": None if r["best"][1] else r["best"][2], "group_size": r["n"], "entries": r["entries"]}

        def pages_of(owner, index):
            for page, depth, places, records in index.pages() if owner is not None else ():
                row = [owner, page, depth, index.depth, list(places), [of(r) for r in records]]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        owner, index = None, ExtendibleIndex(capacity)
        for batch in batches:
            for row in batch.to_pylist():
                if row["owner"] != owner:
                    yield from pages_of(owner, index)
                    owner, index = row["owner"], ExtendibleIndex(capacity)
                found = index.insert(row["key"] & (1 << 64) - 1, bare(row["text"]))
                found["entries"].append(row["entry"])
                found["n"] += row["n"]
                rank = _rank(row["chars"], row["least_id"], row["best_uid"])
                found["best"] = min(found["best"] or rank, rank)
        yield from pages_of(owner, index)

    return run


def owner_of(key: Column, owners: int) -> Column:
    """A range of keys for each owner: the leading 32 bits as a number, times the owners."""
    return F.shiftrightunsigned(F.shiftrightunsigned(key, 32) * F.lit(owners).cast("long"), 32).cast("int")


class Index:
    """The pages of an index in the shared folder, and the way to them."""

    def __init__(self, spark: SparkSession, path: str, owners: int):
        self.path, self.owners = path, owners
        self.pages = spark.read.schema(PAGES).parquet(path)

    def directory(self) -> DataFrame:
        """owner, place, page: the directories of all owners."""
        return self.pages.select("owner", F.explode("places").alias("place"), "page")

    def placed(self, rows: DataFrame) -> DataFrame:
        """`rows`, which have a key, with the owner and the page of it."""
        # a row for each owner, some megabytes of text
        depths = self.pages.groupBy("owner").agg(F.max("directory_depth").alias("directory_depth"))
        at = rows.withColumn("owner", owner_of(F.col("key"), self.owners)).join(depths, "owner")
        mask = F.expr("shiftleft(1L, directory_depth) - 1")
        return at.withColumn("place", F.col("key").bitwiseAND(mask)).join(self.directory(), ["owner", "place"]).drop("place", "directory_depth")

    def records(self, *fields: str) -> DataFrame:
        return self.pages.select("owner", "page", F.explode("records").alias("r")).select("owner", "page", *[F.col(f"r.{f}").alias(f) for f in fields])

    def found(self, rows: DataFrame) -> DataFrame:
        """keep_uid, keep_id, group_size of the inserted rows; these have a key and an entry."""
        entered = self.records("entries", "keep_uid", "keep_id", "group_size").select("owner", "page", F.explode("entries").alias("entry"), "keep_uid", "keep_id", "group_size")
        return self.placed(rows).join(entered, ["owner", "page", "entry"])


def build_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = 128, owners: int | None = None) -> tuple[DataFrame, Index]:
    """The entry table (`docs` packed, with the columns of ADDED) and the index, both read from the shared folder."""
    spark = docs.sparkSession
    table, path = shared_path(spark, "exact-entries"), shared_path(spark, "exact-index")
    source = packed(docs, F.monotonically_increasing_id().alias("uid"), F.col(doc_id).cast("long").alias("id"), keep=[text])
    schema = StructType([*source.schema.fields, *StructType.fromDDL(ADDED).fields])
    source.mapInArrow(_entries, schema).write.option("compression", "zstd").parquet(table)
    entries = spark.read.schema(schema).parquet(table)
    heads = entries.where("head")
    tasks = max(partitions(spark), -(-(heads.agg(F.sum("size")).first()[0] or 0) // TASK_BYTES))
    n = owners or OWNERS * tasks
    rows = heads.select("entry", "key", F.col("c0").cast("binary").alias("text"), "n", "chars", "least_id", "best_uid", owner_of(F.col("key"), n).alias("owner"))
    rows.repartition(tasks, "owner").sortWithinPartitions("owner").mapInArrow(_owned(capacity), PAGES).write.option("compression", "zstd").parquet(path)
    return entries, Index(spark, path, n)


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = 128, owners: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of `docs`."""
    entries, index = build_index(docs, text, doc_id, capacity, owners)
    found = index.found(entries.select("uid", "id", "key", "entry", "sha256"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), F.col("sha256").alias("text_sha256"))


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = 128, owners: int | None = None) -> DataFrame:
    """The rows of `docs` that stay, all columns as they are."""
    entries, index = build_index(docs, text, doc_id, capacity, owners)
    # written, so that Spark knows how few they are and doesn't move the texts to meet them
    dropped = cut(index.found(entries.select("uid", "key", "entry")).where("uid <> keep_uid").select("uid"), "exact-dropped")
    return unpacked(entries.join(dropped, "uid", "left_anti"), docs.columns, [text])


def lookup(docs: DataFrame, index: Index, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, keep_id, group_size of other documents: those of the record with an equal text, null where the index has none."""

    def keyed(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [bare(t.as_py()) for t in batch.column("text").cast(pa.binary())]
            keys = [key_of(hashlib.sha256(t).digest()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), pa.array(keys, pa.int64()), pa.array(texts, pa.binary())], names=["uid", "doc_id", "key", "text"])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(keyed, "uid long, doc_id long, key long, text binary")
    path = shared_path(docs.sparkSession, "exact-lookups")
    rows.write.option("compression", "zstd").parquet(path)
    asked = docs.sparkSession.read.schema(rows.schema).parquet(path)
    known = index.records("key", "text", "keep_id", "group_size")
    hits = index.placed(asked).join(known, ["owner", "page", "key", "text"]).select("uid", "keep_id", "group_size")
    return asked.join(hits, "uid", "left").select("doc_id", "keep_id", "group_size")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY bare ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY bare) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY bare ORDER BY chars DESC, doc_id) AS kept,
       sha256(bare) AS text_sha256
FROM d
"""
