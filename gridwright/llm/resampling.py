"""Drawing documents that look like a target: importance weights over hashed runs of words.

A document's features are all runs of 1 to `order` (3) of its words, each in the bucket of its
crc32. A bucket's gain says how much more of the target's features than of the documents' it
holds; a document's weight is the sum of its features' gains, and a draw without replacement
takes the highest weights, each with its own Gumbel noise.

Texts repeat in lines, so lines are the segments: a new line never stands within a word. The
different lines of the whole corpus are found by one grouping, hashed once, and kept with their
buckets: these, times how often a line occurs, are the corpus counts, and the same buckets give
the line its weight. Runs across lines belong to a document and are counted with it: at each
border the runs that start in the line before it. Nothing of the texts is shuffled but one row of
each task for each different line; keys of lines, 16 bytes of hash, lead from documents to lines.
The counts of all buckets, and nothing else, come to the driver: `buckets` bounds them.

crc32 is linear, so that a run's hash follows from those of its words: different words are hashed
once for a slice, and runs are combined by tables as arrays.

Defined cases. Null or empty texts, and those without a word, have no features, weight 0, and a
score, but are never drawn, as all below `least` words. Repeated rows and rows of one doc_id are
documents of their own; they tie, and so do equal scores: the smaller doc_id comes first, null
last. A null doc_id is drawn by the hash of `seed:`. An empty target or table of documents leaves
its counts at 0. A long text is one row and a long line one slice, never cut. Other columns are
carried through `drawn` unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwright.llm.common import cut, join_to_one, packed, partitions, pieces, read, unpacked

BUCKETS, ORDER, SEED = 10_000, 3, 42
#: What is drawn, in percent of the documents of LEAST words or more.
SHARE, LEAST = 5, 20
#: Words of more bytes are hashed one by one behind what precedes them; the tables end there.
TABLED = 64
#: Bytes of lines of a slice, about.
SLICE_BYTES = 4 << 20
#: Tasks that add the counts of all tasks.
SUMS = 8

LINES = "kind int, key binary, n long, buckets binary, counts array<bigint>"
DOCUMENTS = "uid long, n_words long, across array<int>, lines array<binary>"

#: What isn't a digit, a letter or beyond ASCII separates words; A-Z count as a-z.
PLAIN = bytes(b if chr(b).isalnum() or b >= 0x80 or b == 0x0A else 0x20 for b in range(256)).lower()


def lines_of(text: str) -> list[list[bytes]]:
    """The words of each line that has some."""
    return [words for line in text.encode().translate(PLAIN).split(b"\n") if (words := line.split())]


def key_of(line: bytes) -> bytes:
    return hashlib.blake2b(line, digest_size=16).digest()


def runs_across(lines: list[list[bytes]], order: int = ORDER) -> list[bytes]:
    """The runs of at most `order` words that stand in more than one line, each at the last border that its first word's line has before it."""
    out = []
    for i, line in enumerate(lines[:-1]):
        after: list[bytes] = []
        k = i + 1
        while len(after) < order - 1 and k < len(lines):
            after += lines[k][: order - 1 - len(after)]
            k += 1
        for start in range(max(0, len(line) - order + 1), len(line)):
            head = line[start:]
            out += [b" ".join(head + after[:n]) for n in range(1, min(order - len(head), len(after)) + 1)]
    return out


@cache
def shifts():
    """For n up to TABLED bytes, tables that give the crc32 of a text followed by n bytes, but for these bytes' own."""
    import numpy as np

    out = np.zeros((TABLED + 1, 4, 256), np.uint32)
    for n in range(TABLED + 1):
        zeros = bytes(n)
        own = zlib.crc32(zeros)
        for k in range(4):
            bits = [zlib.crc32(zeros, 1 << 8 * k + b) ^ own for b in range(8)]
            for b in range(8):
                out[n, k, 1 << b : 2 << b] = out[n, k, : 1 << b] ^ bits[b]
    return out.reshape(-1)


def run_hashes(lines, order: int = ORDER):
    """(hashes, sizes): crc32 of all runs of up to `order` words of an Arrow array of lines, those of a line one after another."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.split_pattern(lines.cast(pa.large_string()), " ")
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    words = [w.encode() for w in coded.dictionary.to_pylist()]
    which = coded.indices.to_numpy()
    alone = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    behind = np.fromiter((zlib.crc32(b" " + w) for w in words), np.uint32, len(words))
    size = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    end = np.repeat(offsets[1:], np.diff(offsets))
    hashes, there = np.zeros((len(which), order), np.uint32), np.zeros((len(which), order), bool)
    x = alone[which]
    for n in range(order):
        if n:
            follows = which[n:]
            length = size[follows]
            at = np.minimum(length, TABLED) << 10
            x = x[: len(follows)]
            y = behind[follows]
            for k in range(4):
                y = y ^ shifts()[at + (k << 8) + (x >> np.uint32(8 * k) & np.uint32(255)).astype(np.int64)]
            for i in np.flatnonzero(length > TABLED):
                y[i] = zlib.crc32(b" " + words[follows[i]], int(x[i]))
            x = y
        hashes[: len(x), n] = x
        there[: len(x), n] = np.arange(len(x)) + n < end[: len(x)]
    upto = np.concatenate([[0], np.cumsum(there.sum(axis=1))])
    return hashes[there], np.diff(upto[offsets])


def _line_rows(batches):
    """The lines of documents, words joined by one space."""
    import pyarrow as pa

    for batch in batches:
        for piece in pieces(batch, "text", SLICE_BYTES):
            found = [b" ".join(words) for t in piece.column("text").to_pylist() if t for words in lines_of(t)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()).cast(pa.string())], names=["line"])


def _hashed(buckets: int, order: int):
    """A row (kind 0) for each line with its buckets, and of each task that has lines one (kind 1) with the counts of all."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kind = np.uint16 if buckets <= 1 << 16 else np.uint32
        counts = np.zeros(buckets, np.int64)
        names = [x.split()[0] for x in LINES.split(", ")]
        for batch in batches:
            for piece in pieces(batch, "line", SLICE_BYTES):
                lines, n = piece.column("line"), piece.column("n").to_numpy()
                hashes, sizes = run_hashes(lines, order)
                held = (hashes % np.uint32(buckets)).astype(kind)
                counts += np.bincount(held, np.repeat(n, sizes), buckets).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes * held.itemsize)])
                data = pa.Array.from_buffers(pa.binary(), len(lines), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(held.tobytes())])
                none = pa.nulls(len(lines), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(lines), np.int32)), pa.array([key_of(x.encode()) for x in lines.to_pylist()], pa.binary()), pa.array(n), data, none], names=names)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([None], pa.binary()), pa.array([0], pa.int64()), pa.array([None], pa.binary()), pa.array([counts], pa.list_(pa.int64()))], names=names)

    return run


def _document_rows(buckets: int, order: int, keep_text: bool):
    """Documents with the keys of their lines and the buckets of their runs across lines."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            for piece in pieces(batch, "c0", SLICE_BYTES):
                lines = [lines_of(t or "") for t in piece.column("c0").to_pylist()]
                own = [
                    pa.array(range(at, at + len(lines)), pa.int64()), pa.array([sum(map(len, x)) for x in lines], pa.int64()),
                    pa.array([[zlib.crc32(r) % buckets for r in runs_across(x, order)] for x in lines], pa.list_(pa.int32())),
                    pa.array([[key_of(b" ".join(words)) for words in x] for x in lines], pa.list_(pa.binary())),
                ]
                at += len(lines)
                kept = [c for c in piece.schema.names if keep_text or c != "c0"]
                yield pa.RecordBatch.from_arrays([*own, *map(piece.column, kept)], names=[x.split()[0] for x in DOCUMENTS.split(", ")] + kept)

    return run


def hashed_lines(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, order: int = ORDER) -> DataFrame:
    """LINES: the different lines of all documents with their occurrences and buckets, written once."""
    lines = docs.select(F.col(text).alias("text")).mapInArrow(_line_rows, "line string").groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    return cut(lines.mapInArrow(_hashed(buckets, order), LINES), "hashed-lines")


def parsed_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", buckets: int = BUCKETS, order: int = ORDER, keep_text: bool = False) -> DataFrame:
    """DOCUMENTS and the user's columns, packed as c0 (the text, if kept), c1 (doc_id) and rest, written once."""
    rows = packed(docs, keep=[text, doc_id])
    kept = rows if keep_text else rows.drop("c0")
    schema = f"{DOCUMENTS}, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    return cut(rows.mapInArrow(_document_rows(buckets, order, keep_text), schema), "resampling-documents")


def _added(batches):
    """The sum of arrays of counts."""
    import pyarrow as pa

    total = None
    for batch in batches:
        for counts in batch.column("counts"):
            counts = counts.values.to_numpy(zero_copy_only=False)
            total = counts.copy() if total is None else total + counts
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], names=["counts"])


def counted(lines: DataFrame, documents: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Features in each bucket: those of lines, by their occurrences, and those across lines. As many numbers as buckets come to the driver."""
    summed = lines.where("kind = 1").select("counts").repartition(SUMS).mapInArrow(_added, "counts array<bigint>")
    inside = summed.select(F.posexplode("counts").alias("bucket", "n"))
    across = documents.select(F.explode("across").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    out = [0] * buckets
    for r in inside.unionByName(across).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(target: list[int], raw: list[int]) -> list[int]:
    """floor(1000 ln(p / q)) of each bucket, p and q its smoothed shares of the target's and of all documents' features."""
    t, s = (float(sum(x) + len(x)) for x in (target, raw))
    return [math.floor(1000 * math.log((a + 1) * s / ((b + 1) * t))) for a, b in zip(target, raw, strict=True)]


def _weigher(gain: list[int]):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        each, kind = np.array(gain, np.int64), np.uint16 if len(gain) <= 1 << 16 else np.uint32
        for batch in batches:
            for piece in pieces(batch, "buckets", SLICE_BYTES):
                raw = piece.column("buckets").to_pylist()
                upto = np.concatenate([[0], np.cumsum(each[np.frombuffer(b"".join(raw), kind)])])
                ends = np.concatenate([[0], np.cumsum([len(x) // np.dtype(kind).itemsize for x in raw])]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([piece.column("key"), pa.array(np.diff(upto[ends]), pa.int64())], names=["key", "weight"])

    return run


def _across(gain: list[int]):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        each = np.array(gain, np.int64)
        for batch in batches:
            held = batch.column("across")
            upto = np.concatenate([[0], np.cumsum(each[held.flatten().to_numpy(zero_copy_only=False)])])
            ends = held.offsets.to_numpy() - held.offsets[0].as_py()
            kept = [c for c in batch.schema.names if c != "across"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(np.diff(upto[ends]), pa.int64())], names=[*kept, "across"])

    return run


def weighed(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", buckets: int = BUCKETS, order: int = ORDER, seed: int = SEED, keep_text: bool = False) -> DataFrame:
    """uid, n_words, n_features, weight, score and the user's columns, packed: a row for each document, written once."""
    lines, documents = hashed_lines(docs, text, buckets, order), parsed_documents(docs, text, doc_id, buckets, order, keep_text)
    wanted, models = hashed_lines(target, text, buckets, order), parsed_documents(target.select(F.col(text), F.lit(None).cast("long").alias("__id")), text, "__id", buckets, order)
    gain = gains(counted(wanted, models, buckets), counted(lines, documents, buckets))
    weights = lines.where("kind = 0").select("key", "buckets").mapInArrow(_weigher(gain), "key binary, weight long")
    places = documents.select("uid", F.explode("lines").alias("key"))
    sums = join_to_one(places, weights, "key").groupBy("uid").agg(F.sum("weight").alias("inside"))
    own = documents.drop("lines")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.drop("across").schema) + ", across long"
    joined = own.mapInArrow(_across(gain), schema).join(sums, "uid", "left")
    n = F.col("n_words")
    features = sum((F.greatest(n - k, F.lit(0)) for k in range(1, order)), n)
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("c1").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0)))
    told = joined.withColumns({"n_features": features.cast("long"), "weight": F.col("across") + F.coalesce("inside", F.lit(0))}).withColumn("score", F.col("weight") + noise)
    return cut(told.drop("across", "inside"), "weighed")


def ranked(rows: DataFrame, share: int = SHARE, least: int = LEAST) -> DataFrame:
    """Rows of `weighed` with their rank: 1, 2, 3… for the `share` percent of those of `least` words with the highest scores, else null.

    Rows are dealt in ranges of the order and numbered within; a row for each range says how many stand before it.
    """
    fits = F.col("n_words") >= least
    most = rows.where(fits).count() * share // 100
    order = [F.desc("score"), F.asc_nulls_last("c1"), F.asc("uid")]
    ranged = cut(rows.where(fits).repartitionByRange(partitions(rows.sparkSession), *order).withColumn("part", F.spark_partition_id()), "ranges-of-scores")
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(W.partitionBy("part").orderBy(*order))
    numbered = ranged.join(F.broadcast(starts), "part").withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")).cast("long")).drop("part", "before")
    return numbered.unionByName(rows.where(~fits).withColumn("rank", F.lit(None).cast("long")))


def drawn(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", share: int = SHARE, least: int = LEAST, **settings) -> DataFrame:
    """The documents that are drawn, with all their columns."""
    rows = ranked(weighed(docs, target, text, doc_id, keep_text=True, **settings), share, least).where("rank is not null")
    return unpacked(rows, docs.columns, [text, doc_id])


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = ranked(weighed(docs, read(spark, sf_dir, "benchmark")))
    return rows.select(F.col("c1").alias("doc_id"), "n_features", "weight", "score", "rank")
