"""Substring dedup of bytes by a logarithmic family of suffix arrays.

A 50-byte string of a document that also starts in a document with a smaller doc_id is a
duplicate, and the bytes that such strings cover are removed. `spans.Finder` brings together,
in one bucket, all windows of all documents that may be equal. A bucket takes its segments in
order of doc_id, in batches. Each batch gets a suffix array, in the order of the suffixes' first
50 bytes, which is all that a match of that length needs; it is scanned against the levels of the
family, sorted against sorted, and then becomes a level itself. Two levels of the same rank merge
into one of the next, so a suffix is merged as often as the logarithm of the number of batches.

The scan compares the bytes of suffixes, and so do all other steps that call anything equal, so
results are exact. `byte_spans` judges one table, and its families end with their tasks: of
windows whose hash no other window has none can match, so that these stay out of them.
`SuffixFamily` keeps the levels in a folder: each batch of documents is judged against all that
were added before, and only levels that merge are written again. It keeps the windows of all
documents, about 4 bytes for each of the text before compression.

Defined cases: those of `spans`. Removed bytes may cut a character of UTF-8 in two.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.llm.common import gather, read
from gridwright.llm.spans import BLOB, PACK_BYTES, Finder, pressed, rolled, unpressed

LENGTH = 50
GRAM = 20
#: Windows of which the anchors are sought at once.
SLICE = 1 << 19
#: Suffixes of a batch, about.
BATCH = 1 << 13
DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _tokens(texts: list[bytes]):
    import numpy as np

    return np.array([*map(len, texts)], np.int64), np.frombuffer(b"".join(texts), np.uint8)


def _hashes(buffer, a: int, b: int):
    import numpy as np

    return (buffer[a:b].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)


def _content(buffer, start, stop):
    return gather(buffer, start, stop - start).tobytes(), stop - start


def _digest(ids, removed, sizes, base, buffer):
    import numpy as np
    import pyarrow as pa

    first = removed.copy()
    first[1:] &= ~removed[:-1]
    total = np.concatenate([[0], np.cumsum(removed)])
    spans, hashes = [], []
    for b, n in zip(base.tolist(), sizes.tolist(), strict=True):
        own = removed[b : b + n]
        # a removed run at the start is the document's own, even behind another document's
        spans.append(int(first[b : b + n].sum()) + bool(n and own[0] and not first[b]))
        hashes.append(hashlib.sha256(buffer[b : b + n][~own].tobytes()).hexdigest())
    columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(total[base + sizes] - total[base], pa.int64()), pa.array(spans, pa.int64()), pa.array(hashes, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in DIGESTS.split(", ")])


class Level:
    """Different suffixes in order, and the least doc_id of each. `stored`: the batches of a kept family that it comes from."""

    def __init__(self, keys, docs, rank: int, stored: tuple[int, ...] = ()):
        self.keys, self.docs, self.rank, self.stored = keys, docs, rank, stored

    def merged(self, newer: Level) -> Level:
        import numpy as np

        keys = np.concatenate([self.keys, newer.keys])
        order = np.argsort(keys, kind="stable")  # two sorted runs: a merge
        keys, docs = keys[order], np.concatenate([self.docs, newer.docs])[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        return Level(keys[new], np.minimum.reduceat(docs, np.flatnonzero(new)), max(self.rank, newer.rank) + 1, self.stored + newer.stored)

    def to_bytes(self) -> bytes:
        return len(self.keys).to_bytes(8, "little") + pressed(self.docs.astype("<i8").tobytes() + self.keys.tobytes())

    @staticmethod
    def from_bytes(data: bytes, length: int, rank: int, stored: tuple[int, ...]) -> Level:
        import numpy as np

        n, body = int.from_bytes(data[:8], "little"), unpressed(data[8:])
        return Level(np.frombuffer(body, f"S{length}", n, 8 * n), np.frombuffer(body, "<i8", n), rank, stored)


class Family:
    """Suffix arrays of batches, in levels of falling rank; `scanned` and `merges` count what was done."""

    def __init__(self, levels: list[Level] | None = None):
        self.levels: list[Level] = sorted(levels or [], key=lambda x: -x.rank)
        self.scanned = self.merges = 0

    def add(self, keys, docs):
        """The least doc_id, so far and in this batch, that has each suffix."""
        import numpy as np

        array = np.argsort(keys, kind="stable")
        ordered = keys[array]
        new = np.ones(len(array), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        heads = np.flatnonzero(new)
        batch = Level(ordered[heads], np.minimum.reduceat(docs[array], heads), 0)
        least = batch.docs.copy()
        for level in self.levels:
            at = np.minimum(np.searchsorted(level.keys, batch.keys), len(level.keys) - 1)
            found = level.keys[at] == batch.keys
            least[found] = np.minimum(least[found], level.docs[at[found]])
            self.scanned += 1
        while self.levels and self.levels[-1].rank <= batch.rank:
            batch = self.levels.pop().merged(batch)
            self.merges += 1
        self.levels.append(batch)
        out = np.empty(len(keys), np.int64)
        out[array] = least[np.cumsum(new) - 1]
        return out


def scan(ids, data: bytes, lengths, length: int = LENGTH, batch: int = BATCH, family: Family | None = None):
    """Runs (segment, first window, windows) of duplicate windows among segments of documents `ids`.

    Equal segments, by their bytes, have one set of suffixes, which enters with the least doc_id;
    so those of later documents are duplicates as a whole. With a `family` to grow, all windows of
    the others enter it. Without, those whose hash no other window has needn't, as they can't match.
    """
    import numpy as np

    buffer = np.frombuffer(data, np.uint8)
    starts = np.cumsum(lengths) - lengths
    windows = lengths - length + 1
    by = np.argsort(ids, kind="stable")
    ordered = ids[by]
    seen: dict[bytes, int] = {}
    least = np.array([seen.setdefault(data[s : s + n], d) for s, n, d in zip(starts[by].tolist(), lengths[by].tolist(), ordered.tolist(), strict=True)], np.int64)
    del seen
    again = by[least < ordered]
    out = [(again, np.zeros(len(again), np.int64), windows[again])]
    by = by[least == ordered]
    part_of = np.repeat(by, windows[by])
    offsets = gather(np.arange(int(windows.max(initial=0))), np.zeros(len(by), np.int64), windows[by])
    places = starts[part_of] + offsets
    if family is None:
        family = Family()
        hashes = rolled((buffer.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), length)[places]
        order = np.argsort(hashes)
        same = hashes[order][1:] == hashes[order][:-1]
        likely = np.zeros(len(hashes), bool)
        likely[order[1:]] = same
        likely[order[:-1]] |= same
        del hashes, order, same
        part_of, offsets, places = part_of[likely], offsets[likely], places[likely]
    suffixes = np.ndarray((max(0, len(buffer) - length + 1),), f"S{length}", data, strides=(1,))
    hit = np.zeros(len(places), bool)
    for at in range(0, len(places), batch):
        docs = ids[part_of[at : at + batch]]
        hit[at : at + batch] = family.add(suffixes[places[at : at + batch]], docs) < docs
    part_of, offsets = part_of[hit], offsets[hit]
    if len(part_of):
        new = np.ones(len(part_of), bool)
        new[1:] = (part_of[1:] != part_of[:-1]) | (offsets[1:] != offsets[:-1] + 1)
        heads = np.flatnonzero(new)
        out.append((part_of[heads], offsets[heads], np.diff(np.append(heads, len(part_of)))))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def finder(pack_bytes: int = PACK_BYTES, **more) -> Finder:
    return Finder(LENGTH, GRAM, SLICE, _tokens, _hashes, _content, scan, _digest, DIGESTS, pack_bytes, **more)


def byte_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", pack_bytes: int = PACK_BYTES, **more) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of `docs`."""
    return finder(pack_bytes, **more).find(docs, text, doc_id)


class SuffixFamily:
    """A family of suffix arrays in the folder `path`, in as many parts as `buckets`.

    `adds` has a folder for each batch, written as a whole: what the batch's documents lose, and
    the levels that it made, each with the batches whose levels it replaces. A batch that failed
    can be added again: its folder is overwritten.
    """

    ROWS = BLOB + ", rank int, replaces array<int>"

    def __init__(self, spark: SparkSession, path: str, buckets: int, pack_bytes: int = PACK_BYTES):
        self.spark, self.path, self.buckets, self.finder = spark, path.rstrip("/"), buckets, finder(pack_bytes)

    def levels(self, before: int) -> DataFrame:
        """bucket, born, rank, data of the levels that the batches below `before` have left."""
        if not before:
            return self.spark.createDataFrame([], "bucket int, born int, rank int, data binary")
        paths = [f"{self.path}/adds/batch={b}" for b in range(before)]
        rows = self.spark.read.schema(self.ROWS + ", batch int").option("basePath", f"{self.path}/adds").parquet(*paths).where("rank is not null")
        gone = rows.select("bucket", F.explode("replaces").alias("batch"))
        return rows.join(gone, ["bucket", "batch"], "left_anti").select("bucket", F.col("batch").alias("born"), "rank", "data")

    def add(self, docs: DataFrame, batch: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
        """The digests of batch `batch` (0, 1, …), judged against the batches before it and itself; its suffixes join the family."""
        import pyarrow as pa

        at = self.finder

        def step(key, table, levels):
            bucket = key[0].as_py()
            packs, blobs = table.column("pack").to_pylist(), table.column("data").to_pylist()
            if bucket < 0:
                rows = [(p, bucket, d, None, None) for p, d in zip(packs, blobs, strict=True)]
            elif not blobs:
                rows = []
            else:
                kept = [Level.from_bytes(d, LENGTH, r, (b,)) for b, r, d in zip(*(levels.column(c).to_pylist() for c in ("born", "rank", "data")), strict=True)]
                family = Family(kept)
                ids, starts, places, lengths, origin, data = at.received(packs, blobs)
                found = at.answers(starts, places, origin, *scan(ids, data, lengths, family=family))
                rows = [(p, bucket, d, None, None) for p, d in found]
                # a batch leaves one level: what it made, with the kept levels that this met
                made = [x for x in family.levels if all(x is not y for y in kept)]
                while len(made) > 1:
                    last = made.pop()
                    made[-1] = made[-1].merged(last)
                rows += [(None, bucket, x.to_bytes(), x.rank, list(x.stored)) for x in made]
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.list_(pa.int32())]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["pack", "bucket", "data", "rank", "replaces"])

        packs, _ = at.packs(docs, text, doc_id)
        parts = at.every_segment(packs, self.buckets)
        folder = f"{self.path}/adds/batch={batch}"
        parts.groupBy("bucket").cogroup(self.levels(batch).groupBy("bucket")).applyInArrow(step, self.ROWS).write.mode("overwrite").option("compression", "zstd").parquet(folder)
        ranges = self.spark.read.schema(self.ROWS).parquet(folder).where("pack is not null").select("pack", "bucket", "data")
        return at.reduced(packs, ranges)


def op9_byte_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_spans(read(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS bytes
  FROM (SELECT doc_id, h, unnest(generate_series(0, len(h) // 2 - 50)) AS i FROM d WHERE len(h) >= 100)),
firsts AS (SELECT bytes, min(doc_id) AS first FROM windows GROUP BY bytes HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM windows JOIN firsts USING (bytes) WHERE first < doc_id),
runs AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hits),
spans AS (SELECT doc_id, min(i) AS s, max(i) + 50 AS e FROM runs GROUP BY doc_id, run),
sums AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id),
edges AS (SELECT doc_id, s, e FROM spans UNION ALL SELECT doc_id, len(h) // 2, len(h) // 2 FROM d),
gaps AS (SELECT doc_id, s, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s, e), 0) AS begin FROM edges),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * begin + 1, 2 * (s - begin)), '' ORDER BY s) AS kept FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""
