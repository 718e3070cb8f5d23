"""Duplicate spans of tokens between documents: the frame that substring dedup operators share.

A window is `length` consecutive tokens of one document. It is a duplicate if the same tokens
also start in a document with a smaller doc_id. Finding these among all documents takes four
steps, each on bounded pieces of data:

1. Documents are dealt into packs by a hash of doc_id and text. Every window chooses one of its
   runs of `gram` tokens, the one with the least hash, by its content alone: equal windows in
   any documents choose equal runs, their anchors. A pack sends each different anchor's hash
   once to its bucket, with the number of its places.
2. A bucket tells each pack which of its anchors occur in another document too, and which of
   them are heavy: in so many places that no one bucket should get them all.
3. For those alone, a pack sends segments: the tokens of all windows that chose an anchor, to
   the anchor's bucket; of a heavy anchor, each window by itself, to the window's own bucket.
   Equal segments of a pack, byte for byte, go once, with the least doc_id; those of greater ones
   are duplicates already, and those of the same take what is said of the first. So a passage in a
   third of all documents costs a segment for each pack, and a run of one letter next to nothing.
4. A bucket has all windows with its anchors, from all documents. An operator's own method
   (`matcher`) says which are duplicates; ranges of tokens go back to the packs, where the
   documents lose them.

Hashes only choose where tokens meet; that tokens are equal is decided on their bytes alone.
Only fingerprints, segments and ranges are shuffled, and each document's text once: Spark reuses
that exchange. A pack is hashed twice (steps 1 and 3), so that nothing of it need be kept. Packs
and buckets grow in number with the input, so that each fits one task; `pack_bytes` is theirs.

Defined cases, of both operators. Null text has no tokens. A document shorter than a window
loses nothing. A null doc_id counts as greater than all others. Rows with one doc_id don't
remove each other's tokens, repeated rows included. A long text is one document of one pack,
never cut: that pack's memory grows with it. Other columns are ignored, whatever their names.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import gather, partitions, text_bytes

#: Bytes of text of a pack, about. A pack sends a blob to each bucket at most: raise it with the executors' memory.
PACK_BYTES = 6 << 20
#: Bytes of text for which there is a bucket, about, however many partitions there are: a window takes a hundred times its byte while it is matched.
BUCKET_BYTES = 1 << 20
#: Segments of one anchor, in all packs, from which on it is heavy.
HEAVY = 1 << 15
FACTOR = 0x5851F42D4C957F2D

BLOB = "pack int, bucket int, data binary"
LAST = (1 << 63) - 1
#: The low bits of an anchor's hash on its way: the logarithm of its places, and whether two documents have it.
LOW = 0x7F


def pressed(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def unpressed(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def mixed(x):
    """A bijective scramble of uint64 values."""
    import numpy as np

    x = x ^ x >> np.uint64(31)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(29)


def rolled(tokens, n: int):
    """Hash of each run of n tokens (uint64), by doubling; one for each start."""
    import numpy as np

    if len(tokens) < n:
        return np.empty(0, np.uint64)
    out = None
    done, power, size = 0, tokens, 1
    left = n
    while left:
        if left & 1:
            out = power if out is None else out[: len(tokens) - done - size + 1] * np.uint64(pow(FACTOR, size, 1 << 64)) + power[done : done + len(tokens) - done - size + 1]
            done += size
        left >>= 1
        if left:
            power = power[: len(tokens) - 2 * size + 1] * np.uint64(pow(FACTOR, size, 1 << 64)) + power[size : len(tokens) - size + 1]
            size *= 2
    return mixed(out)


class Anchors:
    """The anchors of documents' windows. Documents are runs of `sizes` tokens, one after another.

    For each anchor: `hash`, `doc` (place of the document), `start` (its first window), `windows`
    (how many windows in a row chose it), `first` and `last` (hashes of the first and the last of
    these). `hashes(a, b)` gives the tokens of a range; ranges of `slice_` windows bound the memory.
    """

    def __init__(self, hashes, sizes, length: int, gram: int, slice_: int):
        import numpy as np

        docs = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        n = len(docs) - length + 1
        found = [part for at in range(0, n, slice_) if (part := self._slice(hashes, docs, at, min(slice_, n - at), length, gram, slice_))]
        none = (np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64))
        self.hash, self.doc, self.start, self.windows, self.first, self.last = (np.concatenate(x) for x in zip(*found, strict=True)) if found else none

    @staticmethod
    def _slice(hashes, docs, at: int, n: int, length: int, gram: int, slice_: int):
        import numpy as np

        within = np.flatnonzero(docs[at : at + n] == docs[at + length - 1 : at + length - 1 + n])
        if not len(within):
            return None
        tokens = hashes(at, at + n + length - 1)
        grams = rolled(tokens, gram)
        # one width for all slices: equal windows compare the same bits wherever they stand
        low = np.uint64((1 << (slice_ + length).bit_length()) - 1)
        # the least hash of a window, the first of equals: the place takes the low bits
        least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        width, size = length - gram + 1, 1
        while 2 * size <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        place = (least[within] & low).astype(np.int64)
        new = np.ones(len(within), bool)
        new[1:] = (place[1:] != place[:-1]) | (within[1:] != within[:-1] + 1)
        heads = np.flatnonzero(new)
        windows = np.diff(np.append(heads, len(within)))
        start = within[heads]
        whole = rolled(tokens, length)
        return grams[place[heads]], docs[at + start], at + start, windows, whole[start], whole[start + windows - 1]


class Finder:
    """The steps for one kind of tokens. `tokens(texts)` gives (sizes, context) of a pack's texts;
    `hashes(context, a, b)` the tokens of a range as uint64; `content(context, starts, stops)` the
    bytes of runs of tokens and their sizes; `matcher(doc_ids, contents, sizes)` the runs of windows
    of segments that are duplicates; `digest(...)` the result's rows from the tokens that stay."""

    def __init__(self, length: int, gram: int, slice_: int, tokens: Callable, hashes: Callable, content: Callable, matcher: Callable, digest: Callable, digests: str, pack_bytes: int = PACK_BYTES, heavy: int = HEAVY):
        self.length, self.gram, self.slice = length, gram, slice_
        self.tokens, self.hashes, self.content, self.matcher, self.digest = tokens, hashes, content, matcher, digest
        self.digests, self.pack_bytes, self.heavy = digests, pack_bytes, heavy

    def _anchors(self, context, sizes):
        return Anchors(lambda a, b: self.hashes(context, a, b), sizes, self.length, self.gram, self.slice)

    def packs(self, docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, int]:
        """The documents with their packs, and the number of buckets."""
        # a pack sends a blob to each bucket, so that neither may be more than tasks or memory ask for; a bucket's method needs segments enough to work on
        least, size = partitions(docs.sparkSession), text_bytes(docs, text)
        dealt = F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(max(2 * least, -(-size // self.pack_bytes)))).cast("int")
        return docs.select(dealt.alias("pack"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")), max(1, -(-size // BUCKET_BYTES))

    def find(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
        """A row of `digests` for each row of `docs`."""
        import pyarrow as pa

        packs, n = self.packs(docs, text, doc_id)
        finder = self  # what the tasks get

        def sent(key, table):
            return pa.Table.from_batches(finder._send_anchors(key[0].as_py(), table, n))

        def shared(key, table):
            return pa.Table.from_batches(finder._share(key[0].as_py(), table))

        def segments(key, table, flags):
            return pa.Table.from_batches(finder._send_segments(key[0].as_py(), table, flags, n))

        def matched(key, table):
            return pa.Table.from_batches(finder._match(key[0].as_py(), table))

        anchors = packs.groupBy("pack").applyInArrow(sent, BLOB)
        flags = anchors.groupBy("bucket").applyInArrow(shared, BLOB)
        parts = packs.groupBy("pack").cogroup(flags.groupBy("pack")).applyInArrow(segments, BLOB)
        ranges = parts.groupBy("bucket").applyInArrow(matched, BLOB)
        return self.reduced(packs, ranges)

    def every_segment(self, packs: DataFrame, n: int) -> DataFrame:
        """The segments of all anchors, also of those that no other document has: what a family that grows must keep."""
        import pyarrow as pa

        finder = self

        def segments(key, table):
            return pa.Table.from_batches(finder._send_segments(key[0].as_py(), table, None, n))

        return packs.groupBy("pack").applyInArrow(segments, BLOB)

    def reduced(self, packs: DataFrame, ranges: DataFrame) -> DataFrame:
        """The digests of the packs' documents without the tokens of `ranges`."""
        import pyarrow as pa

        finder = self

        def reduce(key, table, own):
            return pa.Table.from_batches(finder._reduce(table, own))

        return packs.groupBy("pack").cogroup(ranges.groupBy("pack")).applyInArrow(reduce, self.digests)

    def _read(self, table):
        """(doc_ids, the same as numbers, sizes, context) of a pack, in an order that its rows alone decide."""
        import numpy as np

        rows = sorted(zip(table.column("doc_id").to_pylist(), (t or b"" for t in table.column("text").to_pylist()), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        ids = [i for i, _ in rows]
        sizes, context = self.tokens([t for _, t in rows])
        # a null doc_id is greater than all others, and none is smaller than another
        return ids, np.array([LAST if i is None else i for i in ids], np.int64), sizes, context

    def _unique(self, anchors, ids):
        """Different hashes of a pack, each anchor's place among them, and their low bits: LOW has the number of places, by its logarithm, and whether two documents have them."""
        import numpy as np

        hashes = anchors.hash & ~np.uint64(LOW)
        which, place, count = np.unique(hashes, return_inverse=True, return_counts=True)
        owner = ids[anchors.doc]
        low, high = np.full(len(which), LAST), np.full(len(which), -LAST)
        np.minimum.at(low, place, owner)
        np.maximum.at(high, place, owner)
        told = np.ceil(np.log2(count)).astype(np.uint64) << np.uint64(1) | (low != high)
        return which, place, told

    def _blobs(self, pack: int, items):
        import pyarrow as pa

        rows = [(pack, b, d) for b, d in items]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["pack", "bucket", "data"])

    def _send_anchors(self, pack: int, table, n: int):
        import numpy as np

        _, ids, sizes, context = self._read(table)
        which, _, told = self._unique(self._anchors(context, sizes), ids)
        bucket = self._bucket(which, n)
        order = np.argsort(bucket, kind="stable")
        sent = (which | told)[order]
        found, starts = np.unique(bucket[order], return_index=True)
        yield from self._blobs(pack, [(int(b), part.tobytes()) for b, part in zip(found, np.split(sent, starts[1:]), strict=True)] if len(sent) else [])

    @staticmethod
    def _bucket(hashes, n: int):
        """Anchors have the least hashes around, so these are scrambled again before they are dealt."""
        import numpy as np

        return ((mixed(hashes) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)

    def _share(self, bucket: int, table):
        """To each pack, two bits for each anchor that it sent: whether another document has it, and whether it is heavy."""
        import numpy as np
        import pyarrow as pa

        packs, blobs = table.column("pack").to_pylist(), table.column("data").to_pylist()
        hashes = np.frombuffer(b"".join(blobs), np.uint64)
        _, place = np.unique(hashes & ~np.uint64(LOW), return_inverse=True)
        told = hashes & np.uint64(LOW)
        several = np.bincount(place, 1 + (told & np.uint64(1)).astype(np.int64))[place] > 1 if len(hashes) else np.empty(0, bool)
        heavy = np.bincount(place, np.exp2((told >> np.uint64(1)).astype(float)))[place] >= self.heavy if len(hashes) else np.empty(0, bool)
        cuts = np.cumsum([len(b) // 8 for b in blobs])[:-1]
        out = [np.packbits(np.concatenate([a, b])).tobytes() for a, b in zip(np.split(several, cuts), np.split(heavy, cuts), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(packs, pa.int32()), pa.array([bucket] * len(out), pa.int32()), pa.array(out, pa.binary())], names=["pack", "bucket", "data"])

    def _told(self, bucket, flags):
        """What the buckets say of a pack's different anchors: (in several documents, heavy)."""
        import numpy as np

        said = dict(zip(flags.column("bucket").to_pylist(), flags.column("data").to_pylist(), strict=True))
        several, heavy = np.zeros(len(bucket), bool), np.zeros(len(bucket), bool)
        order = np.argsort(bucket, kind="stable")
        found, starts = np.unique(bucket[order], return_index=True)
        for b, part in zip(found, np.split(order, starts[1:]), strict=True) if len(order) else ():
            bits = np.unpackbits(np.frombuffer(said[int(b)], np.uint8), count=2 * len(part)).view(bool)
            several[part], heavy[part] = bits[: len(part)], bits[len(part) :]
        return several, heavy

    def _windows(self, context, start, windows):
        """Hashes of the windows of some segments, one segment after another."""
        import numpy as np

        out, at = [], 0
        sizes = windows + self.length - 1
        while at < len(start):  # some segments at a time
            end = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), self.slice, side="right")) + at)
            tokens = np.concatenate([self.hashes(context, int(s), int(s + k)) for s, k in zip(start[at:end], sizes[at:end], strict=True)])
            first = np.cumsum(sizes[at:end]) - sizes[at:end]
            out.append(rolled(tokens, self.length)[gather(np.arange(len(tokens)), first, windows[at:end])])
            at = end
        return np.concatenate(out) if out else np.empty(0, np.uint64)

    def _same(self, context, start, stop, head):
        """Whether each run of tokens is, byte for byte, that of its head (places among the same runs)."""
        import numpy as np

        same = np.ones(len(start), bool)
        others = np.flatnonzero(head != np.arange(len(start)))
        for at in range(0, len(others), 1 << 14):
            i = others[at : at + (1 << 14)]
            a, n = self.content(context, start[i], stop[i])
            b, m = self.content(context, start[head[i]], stop[head[i]])
            a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
            alike = np.flatnonzero(n == m)
            ok = np.zeros(len(i), bool)
            if len(alike):
                begin = lambda sizes: (np.cumsum(sizes) - sizes)[alike]
                equal = gather(a, begin(n), n[alike]) == gather(b, begin(m), m[alike])
                ok[alike] = np.logical_and.reduceat(equal, np.cumsum(n[alike]) - n[alike])
            same[i] = ok
        return same

    def _send_segments(self, pack: int, table, flags, n: int):
        """Segments to buckets. A blob of segments: how many (u4), then compressed their doc_ids (i8), starts
        in their document (i8), places of the document in its pack (u4), sizes of content (u4), and contents.
        What a pack tells itself goes to a bucket of its own, below 0, which passes it on: ranges that are
        known already, and which segments are copies of one in a document of the same doc_id (start in
        the pack, that of the first, tokens). Without `flags` all segments go."""
        import numpy as np

        _, ids, sizes, context = self._read(table)
        anchors = self._anchors(context, sizes)
        which, place, _ = self._unique(anchors, ids)
        bucket = self._bucket(which, n)
        several, heavy = self._told(bucket, flags) if flags is not None else (np.ones(len(which), bool), np.zeros(len(which), bool))
        take = np.flatnonzero(several[place]) if len(place) else np.empty(0, np.int64)
        if not len(take):
            yield from self._blobs(pack, [])
            return
        start, windows, doc, goes = anchors.start[take], anchors.windows[take], anchors.doc[take], bucket[place[take]]
        # equal segments have equal first and last windows, as together these hold all its tokens
        key = mixed(anchors.first[take] * np.uint64(3) + mixed(anchors.last[take] + windows.astype(np.uint64)))
        if (apart := heavy[place[take]]).any():
            own = self._windows(context, start[apart], windows[apart])
            each = gather(np.arange(int(windows[apart].max())), np.zeros(int(apart.sum()), np.int64), windows[apart])
            split = lambda kept, part: np.concatenate([kept[~apart], part])
            start, doc = split(start, np.repeat(start[apart], windows[apart]) + each), split(doc, np.repeat(doc[apart], windows[apart]))
            key, goes = split(key, mixed(own + np.uint64(1))), split(goes, self._bucket(own, n))
            windows = split(windows, np.ones(len(own), np.int64))
        stop = start + windows + self.length - 1
        owner = ids[doc]
        by = np.lexsort((start, owner, key))
        start, stop, doc, owner, goes, key = start[by], stop[by], doc[by], owner[by], goes[by], key[by]
        new = np.ones(len(by), bool)
        new[1:] = key[1:] != key[:-1]
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        offset = (np.cumsum(sizes) - sizes)[doc]
        # a later document's segment that is its head's is a duplicate; one of the head's own doc_id fares as the head
        same = self._same(context, start, stop, head)
        again = (owner[head] < owner) & same
        known = np.stack([doc, start - offset, stop - offset])[:, again].astype(np.int64)
        alike = (owner[head] == owner) & same & ~new
        copies = np.stack([start, start[head], stop - start])[:, alike].astype(np.int64)
        send = np.flatnonzero(~again & ~alike)
        send = send[np.argsort(goes[send], kind="stable")]
        out = []
        found, starts = np.unique(goes[send], return_index=True)
        for b, part in zip(found, np.split(send, starts[1:]), strict=True):
            data, lengths = self.content(context, start[part], stop[part])
            body = owner[part].astype("<i8").tobytes() + (start - offset)[part].astype("<i8").tobytes() + doc[part].astype("<u4").tobytes() + lengths.astype("<u4").tobytes() + data
            out.append((int(b), len(part).to_bytes(4, "little") + pressed(body)))
        if known.size:
            out.append((-1 - pack, b"\0" + pressed(np.diff(known, axis=1, prepend=0).tobytes())))  # differences, which repeat where places do
        if copies.size:
            out.append((-1 - pack, b"\1" + pressed(np.diff(copies, axis=1, prepend=0).tobytes())))
        yield from self._blobs(pack, out)

    @staticmethod
    def received(packs, blobs):
        """The segments of blobs: doc_ids, starts, places, sizes of content, packs, and contents."""
        import numpy as np

        ids, starts, places, lengths, data, origin = [], [], [], [], [], []
        for p, blob in zip(packs, blobs, strict=True):
            m = int.from_bytes(blob[:4], "little")
            body = unpressed(blob[4:])
            ids.append(np.frombuffer(body, "<i8", m))
            starts.append(np.frombuffer(body, "<i8", m, 8 * m))
            places.append(np.frombuffer(body, "<u4", m, 16 * m))
            lengths.append(np.frombuffer(body, "<u4", m, 20 * m))
            data.append(body[24 * m :])
            origin.append(np.full(m, p))
        if not blobs:
            return *(np.empty(0, np.int64) for _ in range(5)), b""
        ids, starts, places, lengths, origin = (np.concatenate(x) for x in (ids, starts, places, lengths, origin))
        return ids, starts, places, lengths.astype(np.int64), origin, b"".join(data)

    def answers(self, starts, places, origin, segment, first, count):
        """(pack, blob) of the ranges of tokens that runs of windows (segment, first window, windows) cover."""
        import numpy as np

        begin = starts[segment] + first
        rows = np.stack([places[segment], begin, begin + count + self.length - 1]).astype(np.int64)
        p = origin[segment]
        order = np.argsort(p, kind="stable")
        found, cuts = np.unique(p[order], return_index=True)
        return [(int(x), pressed(np.ascontiguousarray(rows[:, part]).tobytes())) for x, part in zip(found, np.split(order, cuts[1:]), strict=True)] if len(p) else []

    def _match(self, bucket: int, table):
        import pyarrow as pa

        packs, blobs = table.column("pack").to_pylist(), table.column("data").to_pylist()
        if bucket < 0:
            out = list(zip(packs, blobs, strict=True))
        else:
            ids, starts, places, lengths, origin, data = self.received(packs, blobs)
            out = self.answers(starts, places, origin, *self.matcher(ids, data, lengths))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([bucket] * len(out), pa.int32()), pa.array([d for _, d in out], pa.binary())], names=["pack", "bucket", "data"])

    def _reduce(self, table, ranges):
        """Digests of a pack's documents, from the tokens that stay."""
        import numpy as np

        ids, _, sizes, context = self._read(table)
        rows, copies = [], []
        for bucket, data in zip(ranges.column("bucket").to_pylist(), ranges.column("data").to_pylist(), strict=True):
            if bucket < 0:
                (copies if data[0] else rows).append(np.cumsum(np.frombuffer(unpressed(data[1:]), np.int64).reshape(3, -1), axis=1))
            else:
                rows.append(np.frombuffer(unpressed(data), np.int64).reshape(3, -1))
        base = np.cumsum(sizes) - sizes
        starts = np.zeros(int(sizes.sum()) + 1, np.int32)  # windows that are duplicates
        if rows:
            place, begin, end = np.concatenate(rows, axis=1)
            np.add.at(starts, base[place] + begin, 1)
            np.add.at(starts, base[place] + end - self.length + 1, -1)
        hit = np.cumsum(starts[:-1], dtype=np.int32) > 0
        for at, first, tokens in copies:
            windows = tokens - self.length + 1  # a copy's windows fare as the same windows of the first
            for k in range(0, len(at), 1 << 14):
                n = windows[k : k + (1 << 14)]
                each = gather(np.arange(int(n.max())), np.zeros(len(n), np.int64), n)
                told = hit[np.repeat(first[k : k + (1 << 14)], n) + each]
                hit[(np.repeat(at[k : k + (1 << 14)], n) + each)[told]] = True
        covered = np.concatenate([np.zeros(self.length, np.int64), np.cumsum(hit)])
        yield self.digest(ids, covered[self.length :] > covered[: len(hit)], sizes, base, context)
