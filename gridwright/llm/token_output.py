"""Token ids in the fewest bits, in blocks that numpy unpacks as a whole.

A file holds the documents of one range of doc_id in ascending order, as blocks. Block, little
endian: `GWB1`, width (u1), documents (u4), ids (u8); for each document whether its id is known
(u1), its id (i8) and its number of ids (u8); then the ids, 64 at a time in `width` words of 64
bits. The blocks stand as binary values in Parquet, so any store that Spark reaches serves; their
columns `part`, `block`, `first` and `n_ids` are the block offsets, `low` and `high` the least and
the greatest doc_id, so that `read_documents` and `read_range` read the blocks they need and no
others, and of these they unpack only the groups of 64 that they need.

Defined cases. Null text counts as empty: the end id alone. Rows without doc_id come first.
Rows with the same doc_id are written one after the other, ordered by the hash of their text, in
as many files as their number asks for. A long text is a block of its own. Other columns are
ignored, whatever their names. An empty table gives no blocks and an empty result.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwright.llm.common import gather, partitions, pieces, read, shared_path

TOKENIZER = "word_bpe_49k.json"
END = 2
#: Ids of a block, but for a document that is longer by itself.
BLOCK_IDS = 1 << 17
#: Different words of which a worker keeps the ids; it forgets all when there are more.
CACHED_WORDS = 1_000_000

HEAD = struct.Struct("<4sBIQ")
BLOCKS = "part int, block long, first long, n_docs long, n_ids long, low long, high long, data binary"
DECODED = "doc_id long, start long, n_tokens long, ids_crc32 long"


def width_of(vocabulary: int) -> int:
    """Bits that the largest id needs."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids, width: int) -> bytes:
    """Fixed-width packing of ids, 64 in each group of `width` words."""
    import numpy as np

    n = len(ids)
    lanes = np.zeros((-(-n // 64), 64), np.uint64)
    lanes.reshape(-1)[:n] = ids
    words = np.zeros((len(lanes), width), np.uint64)
    for j in range(64):
        at, shift = divmod(j * width, 64)
        words[:, at] |= lanes[:, j] << np.uint64(shift)
        if shift + width > 64:
            words[:, at + 1] |= lanes[:, j] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack(data: bytes, n: int, width: int, offset: int = 0):
    """The n ids packed from `offset` of `data`."""
    import numpy as np

    groups = -(-n // 64)
    words = np.frombuffer(data, "<u8", groups * width, offset).reshape(groups, width)
    lanes = np.empty((groups, 64), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        at, shift = divmod(j * width, 64)
        lane = words[:, at] >> np.uint64(shift)
        if shift + width > 64:
            lane = lane | words[:, at + 1] << np.uint64(64 - shift)
        lanes[:, j] = lane & mask
    return lanes.reshape(-1)[:n].astype(np.uint32)


def unpack_part(data: bytes, start: int, stop: int, width: int, offset: int = 0):
    """The ids from start to stop, without unpacking groups before or behind them."""
    group = start // 64
    return unpack(data, stop - 64 * group, width, offset + 8 * group * width)[start - 64 * group :]


def pack_block(doc_ids: list, lengths, ids, width: int) -> bytes:
    import numpy as np

    known = np.array([x is not None for x in doc_ids], "u1")
    numbers = np.array([x or 0 for x in doc_ids], "<i8")
    return HEAD.pack(b"GWB1", width, len(doc_ids), len(ids)) + known.tobytes() + numbers.tobytes() + np.asarray(lengths, "<u8").tobytes() + pack(ids, width)


def read_head(data: bytes):
    """doc_ids, lengths, width and the offset of the ids of a block."""
    import numpy as np

    magic, width, docs, _ = HEAD.unpack_from(data)
    if magic != b"GWB1":
        raise ValueError("not a block of token ids")
    at = HEAD.size
    known = np.frombuffer(data, "u1", docs, at)
    numbers = np.frombuffer(data, "<i8", docs, at + docs)
    lengths = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
    return [int(x) if k else None for x, k in zip(numbers, known, strict=True)], lengths, width, at + 17 * docs


def unpack_block(data: bytes):
    """doc_ids, lengths and ids of a block."""
    docs, lengths, width, offset = read_head(data)
    return docs, lengths, unpack(data, int(lengths.sum()), width, offset)


#: Words that the normaliser only puts in lower case and that split into letters and marks; the others take the tokenizer's whole way.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*%#$&]*)")


@cache
def encoder_of(path: str, end: int) -> WordEncoder:
    """One cache of words for each Python worker, over all its tasks."""
    return WordEncoder(path, end)


def by_words(config: dict) -> bool:
    """Whether a tokenizer's file says that white space ends every token and that words fall into letters and other marks.

    That holds where the normaliser is NFC, white space to a space, lower case, and the split
    takes runs of letters, digits one by one, and runs of other marks, dropping white space.
    """
    normal = (config.get("normalizer") or {}).get("normalizers", [])
    split = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
    lower = [x.get("type") for x in normal] == ["NFC", "Replace", "Lowercase"] and normal[1]["pattern"] == {"Regex": r"\s+"} and normal[1]["content"] == " "
    words = [x.get("type") for x in split] == ["Split", "ByteLevel"] and not split[1]["add_prefix_space"] and split[0]["behavior"] == "Removed" and split[0]["invert"] is True
    runs = words and split[0]["pattern"] == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
    plain = not any(" " in x["content"] for x in config.get("added_tokens", [])) and config.get("post_processor") is None and config["model"]["type"] == "BPE" and config["model"].get("dropout") is None
    return bool(lower and runs and plain)


class WordEncoder:
    """Ids of texts: by the ids of their words where the tokenizer allows that (`by_words`), else of whole texts."""

    def __init__(self, path: str, end: int):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.by_words = by_words(json.loads(self.tokenizer.to_str()))
        self.model = self.tokenizer.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes_as = {ord(c): level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xC0, 0x100))}
        self.end = end
        self.seen: dict[str, bytes] = {}
        self.letters: dict[str, bytes] = {"": b""}
        self.marks: dict[str, bytes] = {"": b""}

    def learn(self, words: list[str]) -> None:
        """Keep the ids of new words."""
        import numpy as np

        whole = []
        for word in words:
            plain = PLAIN.fullmatch(word)
            if not plain:
                whole.append(word)
                continue
            core, tail = plain[1].lower(), plain[2]
            if core not in self.letters:
                self.letters[core] = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(core.translate(self.bytes_as)))
            if tail not in self.marks:
                self.marks[tail] = np.array(self.tokenizer.encode(tail, add_special_tokens=False).ids, "<u4").tobytes()
            self.seen[word] = self.letters[core] + self.marks[tail]
        for at in range(0, len(whole), 4096):
            part = whole[at : at + 4096]
            self.seen.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(part, self.batch(part, add_special_tokens=False), strict=True))

    def encode(self, texts):
        """(lengths, ids) of an Arrow array of texts, the end id after each."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.by_words:
            found = [[*e.ids, self.end] for e in self.batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.array([*map(len, found)], np.int64), np.array([i for ids in found for i in ids], "<u4")
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        seen = self.seen
        new = [w for w in words if w not in seen]
        if len(seen) + len(new) > CACHED_WORDS:
            for kept in (seen, self.letters, self.marks):
                kept.clear()
            new = words
        self.learn(new)
        found = [seen[w] for w in words]
        flat = np.frombuffer(b"".join(found) + np.array([self.end], "<u4").tobytes(), "<u4")
        lengths = np.array([*map(len, found), 4], np.int64) // 4
        starts = np.cumsum(lengths) - lengths
        which = np.insert(coded.indices.to_numpy(), offsets[1:], len(words))
        taken = lengths[which]
        ends = np.cumsum(taken)[offsets[1:] + np.arange(len(texts))]
        return np.diff(ends, prepend=0), gather(flat, starts[which], taken)


def _writer(path: str, end: int, width: int, block_ids: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, part, block, first = encoder_of(path, end), TaskContext.get().partitionId(), 0, 0
        docs: list = []
        lengths: list = []
        held: list = []

        def flush():
            nonlocal block, first
            ids = np.concatenate(held)
            known = [d for d in docs if d is not None]
            row = [part, block, first, len(docs), len(ids), min(known, default=None), max(known, default=None), pack_block(docs, lengths, ids, width)]
            block, first = block + 1, first + len(ids)
            for x in (docs, lengths, held):
                x.clear()
            kinds = [pa.int32(), *[pa.int64()] * 6, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            for piece in pieces(batch, "text", 6 << 20):
                n, ids = encoder.encode(piece.column("text"))
                docs += piece.column("doc_id").to_pylist()
                lengths += n.tolist()
                held.append(ids)
                if sum(map(len, held)) >= block_ids:
                    yield flush()
        if docs:
            yield flush()

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, end: int = END, width: int | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Encode every text and write the blocks under `path`, in ascending doc_id order."""
    if width is None:
        from tokenizers import Tokenizer

        width = width_of(Tokenizer.from_file(tokenizer).get_vocab_size())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tie = F.xxhash64("text")
    ranged = rows.repartitionByRange(partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    ranged.mapInArrow(_writer(tokenizer, end, width, block_ids), BLOCKS).write.option("compression", "uncompressed").parquet(path)


def _reader(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for row in batch.to_pylist():
            docs, lengths, ids = unpack_block(row["data"])
            ends = np.cumsum(lengths)
            raw = memoryview(ids.astype("<u4").tobytes())
            crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(ends - lengths + row["start"], pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())],
                names=[x.split()[0] for x in DECODED.split(", ")],
            )


def _placed(blocks: DataFrame) -> DataFrame:
    """The blocks with `start`: how many ids all blocks before them have."""
    # a row for each file: the window's one task holds as many rows as the writer had tasks
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return blocks.join(F.broadcast(starts), "part").withColumn("start", F.col("before") + F.col("first"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """DECODED of every document of the files under `path`."""
    return _placed(spark.read.schema(BLOCKS).parquet(path)).select("start", "data").mapInArrow(_reader, DECODED)


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of some documents: only blocks in whose range of doc_id one lies are read, and only their ids unpacked."""
    wanted = sorted(set(doc_ids))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        asked = set(wanted)
        for batch in batches:
            for data in batch.column("data"):
                data = data.as_py()
                docs, lengths, width, offset = read_head(data)
                ends = np.cumsum(lengths)
                hits = [i for i, d in enumerate(docs) if d in asked]
                ids = [unpack_part(data, int(ends[i] - lengths[i]), int(ends[i]), width, offset).astype(np.int64) for i in hits]
                yield pa.RecordBatch.from_arrays([pa.array([docs[i] for i in hits], pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    blocks = spark.read.schema(BLOCKS).parquet(path)
    if not wanted:
        return spark.createDataFrame([], "doc_id long, ids array<bigint>")
    near = F.col("low").isNotNull() & (F.col("low") <= wanted[-1]) & (F.col("high") >= wanted[0])
    held = F.exists(F.array(*[F.lit(i).cast("long") for i in wanted]), lambda i: i.between(F.col("low"), F.col("high")))
    return blocks.where(near & held).select("data").mapInArrow(run, "doc_id long, ids array<bigint>")


def read_range(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """(start, ids) of the ids from place `first` up to `last` of all ids, a row for each block that has some; other blocks' data is not unpacked."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for start, data in zip(batch.column("start").to_pylist(), batch.column("data"), strict=True):
                data = data.as_py()
                _, lengths, width, offset = read_head(data)
                a, b = max(0, first - start), min(int(lengths.sum()), last - start)
                yield pa.RecordBatch.from_arrays([pa.array([start + a], pa.int64()), pa.array([unpack_part(data, a, b, width, offset).astype(np.int64)], pa.list_(pa.int64()))], names=["start", "ids"])

    blocks = spark.read.schema(BLOCKS).parquet(path)
    placed = _placed(blocks.drop("data")).where((F.col("start") < last) & (F.col("start") + F.col("n_ids") > first)).select("part", "block", "start")
    # the blocks of the range, by their places: their data alone is read on
    return blocks.join(placed, ["part", "block"]).select("start", "data").mapInArrow(run, "start long, ids array<bigint>")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_path(spark, "token-ids")
    write_ids(read(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER))
    return read_ids(spark, path)
