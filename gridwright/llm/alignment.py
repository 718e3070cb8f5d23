"""Two tokenizers over the same bytes: which tokens of one stand where tokens of the other do.

Both tokenizers cut the same bytes. All tokens of both, sorted by where they start
(`np.lexsort`), with the running maximum of their ends (`np.maximum.accumulate`): where a start
reaches that maximum, no token is open, and a group begins. Within a group, the tokens that share
bytes are expanded to links. A slice of texts is handled at once, as groups never cross texts.

How many documents hold a pair of linked ids is counted over the whole corpus. Texts are encoded
once, in packs of some megabytes; a pack's table has each document's pairs, and the pack's own
pairs with their numbers of documents. Only the latter are summed over the corpus, and each pack
gets back the counts of the pairs that it has, so that no pair is ever shuffled once for each
document, and a pair that all documents hold once for each pack.

Defined cases. A null or empty text has no tokens, nor has one that either tokenizer changes (the
bytes of its tokens aren't those of space + text): zeros and ''. Repeated rows, and rows with one
doc_id or none, are documents of their own. Ties for an id's highest count are all best. A long
text is one row of one slice, never cut: that task's memory grows with it. Other columns are
ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwright.llm.common import gather, pieces, read, shared_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text of a pack and of a slice, about.
PACK_BYTES, SLICE_BYTES = 16 << 20, 2 << 20
#: Different units of text of which a worker keeps the ids, about, none of more characters than LONG.
CACHED, LONG = 400_000, 256
ROWS = "kind int, pack long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<bigint>, times array<int>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def byte_chars() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Encoders:
    """Ids of space + text by both files. Special tokens' strings are plain text; the second adds the space.

    A text is cut before each run of spaces, tabs and new lines, where neither tokenizer can have a
    token across, and units that were seen keep their ids. `breaks` are the characters for which
    that is so: in no piece of B do they stand behind another character, and A's split starts a
    piece there. A text with any other white space is one unit.
    """

    def __init__(self, a: str, b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import numpy as np
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        chars, names = byte_chars(), self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(names.values(), default=0) + 1)
        for name, i in names.items():
            self.a_bytes[i] = bytes(chars[c] for c in name) if all(c in chars for c in name) else name.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.space = self.b.piece_to_id("▁")
        config = json.loads(self.a.to_str())
        split, model = config.get("pre_tokenizer") or {}, config["model"]
        known = config.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex") is True and model["type"] == "BPE" and model.get("dropout") is None
        within = [p.replace("▁", " ") for i, p in enumerate(names) if not self.b.is_byte(i)]
        breaks = [c for c in " \t\n" if known and not any(c in p[1:] and p.strip(c) for p in within)]
        self.cuts = " " in breaks
        self.is_break = np.zeros(256, bool)
        self.is_break[[*map(ord, breaks)]] = True
        self.other = re.compile(f"[^\\S{''.join(breaks)}]")
        # of units: the number of A's ids and whether all bytes are the unit's (the lowest bit), A's ids, B's ids, in the newer and the older generation
        self.seen: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def units(self, texts: list[str]):
        """(units, numbers of units) of texts with their leading spaces: an Arrow array over their bytes."""
        import numpy as np
        import pyarrow as pa

        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([*map(len, raw)], dtype=np.int64)
        breaks = self.is_break[data]
        breaks[1:] &= ~breaks[:-1]
        begins = np.concatenate([[0], ends[:-1]])[: len(raw)]
        for k, t in enumerate(texts):
            if not self.cuts or self.other.search(t):
                breaks[begins[k] : ends[k]] = False
        breaks[begins] = True
        starts = np.flatnonzero(breaks)
        offsets = np.append(starts, len(data)).astype(np.int64)
        return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]), np.diff(np.searchsorted(starts, np.append(begins, len(data))))

    def _b(self, units: list[str]) -> list[list[int]]:
        """A unit's own space is the one that B adds; before any other character B's space is dropped again."""
        found = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        return [(ids or [self.space]) if u[0] == " " else ids[1:] for u, ids in zip(units, found, strict=True)]

    def learn(self, units: list[str]) -> list[bytes]:
        """The ids of new units; what is too long is not kept."""
        a_bytes, b_bytes, out = self.a_bytes.__getitem__, self.b_bytes.__getitem__, []
        for at in range(0, len(units), 4096):
            part = units[at : at + 4096]
            for u, found, b in zip(part, self.a.encode_batch_fast(part, add_special_tokens=False), self._b(part), strict=True):
                a, own = found.ids, u.encode()
                same = b"".join(map(a_bytes, a)) == own == b"".join(map(b_bytes, b))
                out.append(array("I", [2 * len(a) + same, *a, *b]).tobytes())
                if len(u) <= LONG:
                    self.seen[u] = out[-1]
        return out

    def known(self, units: list[str]) -> list[bytes]:
        """The ids of different units. When a generation is full it becomes the older one; what is asked for again moves on to the newer."""
        if len(self.seen) > CACHED // 2:
            self.old, self.seen = self.seen, {}
        found = [*map(self.seen.get, units)]
        away = [i for i, x in enumerate(found) if x is None]
        new = []
        for i in away:
            x = self.old.get(units[i])
            if x is None:
                new.append(i)
            else:
                found[i] = self.seen[units[i]] = x
        for i, x in zip(new, self.learn([units[i] for i in new]), strict=True):
            found[i] = x
        return found

    def encode(self, texts: list[str]):
        """(numbers of ids, ids) by A, the same by B, and whether each text's tokens have its bytes."""
        import numpy as np

        units, n_units = self.units(texts)
        coded = units.dictionary_encode()
        found = self.known(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        heads = np.cumsum(sizes) - sizes
        n_a, same = (flat[heads] >> 1).astype(np.int64), (flat[heads] & 1).astype(bool)
        which = coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(n_units)])
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[which])])[ends])
        a, b = gather(flat, heads[which] + 1, n_a[which]), gather(flat, (heads + 1 + n_a)[which], (sizes - 1 - n_a)[which])
        out = (total(n_a), a), (total(sizes - 1 - n_a), b)
        ok = total(~same) == 0
        for k in np.flatnonzero(~ok):  # a unit's bytes differ: the whole text's decide
            ids = [x[int(n[:k].sum()) :][: n[k]].tolist() for n, x in out]
            ok[k] = all(b"".join(map(own.__getitem__, x)) == texts[k].encode() for own, x in zip((self.a_bytes, self.b_bytes), ids, strict=True))
        return *out, ok


@cache
def encoders_of(a: str, b: str) -> Encoders:
    """One for each Python worker, over all its tasks."""
    return Encoders(a, b)


def grouped(a_start, a_end, b_start, b_end):
    """(order, group) of all tokens, those of A numbered before those of B, by start: a group ends where a start reaches all ends before it."""
    import numpy as np

    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    side = np.repeat(np.array([0, 1], np.int8), [len(a_start), len(b_start)])
    order = np.lexsort((side, start))
    reached = np.maximum.accumulate(end[order]) if len(order) else end
    new = np.ones(len(order), bool)
    new[1:] = start[order][1:] >= reached[:-1]
    return order, np.cumsum(new) - 1


def links(a_start, a_end, b_start, b_end):
    """(places in A, places in B) of all tokens that share bytes. Both sides are sorted, so that a token's partners are a run."""
    import numpy as np

    low = np.searchsorted(b_end, a_start, side="right")
    n = np.maximum(np.searchsorted(b_start, a_end, side="left") - low, 0)
    return np.repeat(np.arange(len(a_start)), n), gather(np.arange(len(b_start)), low, n)


class Aligner:
    """Alignments of slices of texts. `digest` makes what is told of a text's groups from `a1,a2|b1;a3|b2,b3`."""

    def __init__(self, a: str, b: str, digest: str):
        import numpy as np

        self.encoders = encoders_of(a, b)
        self.a_size, self.b_size = (np.array([*map(len, own)], np.int64) for own in (self.encoders.a_bytes, self.encoders.b_bytes))
        self.digest = digest
        # an id with what follows it: a comma within a side, a bar behind A's last, a semicolon behind B's last
        self.most = max(len(self.a_size), len(self.b_size))
        self.written = [f"{i}{mark}" for mark in ",|;" for i in range(self.most)]

    def told(self, text: str) -> str:
        return text if self.digest == "text" else hashlib.sha256(text.encode()).hexdigest()

    def slice(self, texts: list[str | None]):
        """Of each text n_a, n_b, n_groups, n_links and its groups; then the numbers of its different pairs, these, and how often each is linked."""
        import numpy as np

        full = [i for i, t in enumerate(texts) if t]
        (n_a, a), (n_b, b), same = self.encoders.encode([f" {texts[i]}" for i in full])
        a_at, b_at = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        place = np.array(full, np.int64)[same]
        a, b, n_a, n_b = gather(a, a_at[same], n_a[same]), gather(b, b_at[same], n_b[same]), n_a[same], n_b[same]
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        a_start, b_start = a_end - self.a_size[a], b_end - self.b_size[b]
        order, group = grouped(a_start, a_end, b_start, b_end)
        is_b = order >= len(a)
        doc = np.concatenate([np.repeat(np.arange(len(place)), n_a), np.repeat(np.arange(len(place)), n_b)])[order]
        first = np.ones(len(group), bool)
        first[1:] = group[1:] != group[:-1]
        n_groups = np.bincount(doc[first], minlength=len(place))
        by = np.lexsort((is_b, group))
        last = np.ones(len(by), bool)
        run = 2 * group[by] + is_b[by]
        last[:-1] = run[1:] != run[:-1]
        ids = np.concatenate([a, b]).astype(np.int64)[order][by]
        words = [*map(self.written.__getitem__, (ids + self.most * np.where(last, 1 + is_b[by], 0)).tolist())]
        cuts = np.cumsum(n_a + n_b).tolist()
        told = [""] * len(texts)
        for i, x, y in zip(place.tolist(), [0, *cuts], cuts, strict=False):
            told[i] = self.told("".join(words[x:y])[:-1])
        left, right = links(a_start, a_end, b_start, b_end)
        of = np.repeat(np.arange(len(place)), n_a)[left]
        space = len(self.a_size) * len(self.b_size)
        pairs, times = np.unique(of * space + a[left].astype(np.int64) * len(self.b_size) + b[right], return_counts=True)
        wide = lambda x: np.bincount(place, x, len(texts)).astype(np.int64) if len(place) else np.zeros(len(texts), np.int64)
        n_links = np.bincount(of, minlength=len(place))
        return [wide(n_a), wide(n_b), wide(n_groups), wide(n_links)], told, wide(np.bincount(pairs // space, minlength=len(place))), pairs % space, times


def _lists(sizes, values, kind):
    import numpy as np
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def _encoder(a: str, b: str, digest: str, pack_bytes: int):
    """Rows of documents (kind 0), and behind each pack one of its pairs (kind 1) with their numbers of documents."""
    names = [x.split()[0] for x in ROWS.split(", ")]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        aligner, task = Aligner(a, b, digest), TaskContext.get().partitionId()
        pack, held, size = task << 32, [], 0

        def rows(kind, doc_ids, numbers, told, sizes, pairs, times):
            n = len(doc_ids)
            whole = [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, pack, np.int64)), pa.array(doc_ids, pa.int64()), *(pa.array(x, pa.int64()) for x in numbers), pa.array(told, pa.string())]
            return pa.RecordBatch.from_arrays([*whole, _lists(sizes, pairs, pa.int64()), _lists(sizes, times.astype(np.int32), pa.int32())], names=names)

        def closed():
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            return rows(1, [None], [[0]] * 4, [""], [len(pairs)], pairs, n)

        for batch in batches:
            for piece in pieces(batch, "text", min(SLICE_BYTES, pack_bytes)):
                texts = piece.column("text").to_pylist()
                numbers, told, sizes, pairs, times = aligner.slice(texts)
                yield rows(0, piece.column("doc_id").to_pylist(), numbers, told, sizes, pairs, times)
                held.append(pairs)
                size += sum(len(t or "") for t in texts)
                if size >= pack_bytes:
                    yield closed()
                    pack, held, size = pack + 1, [], 0
        if held:
            yield closed()

    return run


def _weigh(docs, counts):
    """The documents of a pack with what the corpus says of their pairs."""
    import numpy as np
    import pyarrow as pa

    names = [x.split()[0] for x in RESULT.split(", ")]
    known = counts.column("keys").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    n = counts.column("counts").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    best = counts.column("best").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    by = np.argsort(known)
    pairs, times = (docs.column(c).combine_chunks() for c in ("pairs", "times"))
    lengths = np.diff(pairs.offsets.to_numpy())
    at = by[np.searchsorted(known, pairs.flatten().to_numpy(zero_copy_only=False), sorter=by)] if len(known) else np.empty(0, np.int64)
    times = times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])
    new = {"n_best": total(times * best[at]), "count_sum": total(times * n[at])}
    return pa.table([pa.array(new[c], pa.int64()) if c in new else docs.column(c) for c in names], names=names)


def align(docs: DataFrame, a: str, b: str, text: str = "text", doc_id: str = "doc_id", groups: str = "text", pack_bytes: int = PACK_BYTES) -> DataFrame:
    """RESULT for each row: its tokens by the files `a` and `b`, groups of them (`groups`: their "text", or its "sha256"), links, and what the corpus says of these.

    n_best counts the links whose pair is in as many documents as any pair of their A id;
    count_sum adds, over all links, the number of documents that hold their pair.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "aligned")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows.mapInArrow(_encoder(a, b, groups, pack_bytes), ROWS).write.option("compression", "zstd").partitionBy("kind").parquet(path)
    table = spark.read.schema(ROWS).parquet(path)
    right = len(encoders_of(a, b).b_bytes)
    held = table.where("kind = 1").select("pack", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("pack", F.col("x.pairs").alias("pair"), F.col("x.times").cast("long").alias("n"))
    # an A id has at most as many pairs as B has ids
    highest = F.max("n").over(W.partitionBy(F.expr(f"pair div {right}")))
    counts = held.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("best", F.col("n") == highest)
    told = held.drop("n").join(counts, "pair").groupBy("pack").agg(F.collect_list(F.struct("pair", "n", "best")).alias("x")).select(F.col("pack").alias("of"), F.col("x.pair").alias("keys"), F.col("x.n").alias("counts"), F.col("x.best").alias("best"))
    own = table.where("kind = 0").drop("kind")
    return own.groupBy("pack").cogroup(told.groupBy("of")).applyInArrow(_weigh, RESULT)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = align(read(spark, sf_dir, "documents"), public_tokenizers.path(A), public_tokenizers.path(B), groups="sha256")
    return found.withColumnRenamed("groups", "groups_sha256")
