"""Unigram encoding and decoding with the pieces of a SentencePiece model.

The pieces stand in a double-array trie over UTF-8 bytes. Viterbi finds the segmentation with
the highest sum of log scores; where scores are equal, the last piece is the longest. A
character that no piece covers costs `penalty` (10 below the lowest score) and becomes its
byte pieces. White space is the
marker U+2581; a text gets one in front, and decoding turns markers to spaces and drops that
one. Text is otherwise not normalised, so decoding gives the text back, but for one that holds
the marker itself.

No piece has a marker behind another character, so the best segmentation of a text is that of
its units (a run of markers and what follows up to the next), one after another. Different units of a
batch are segmented together: each step of the walk through the trie is one numpy operation.

Defined cases. Null and empty texts have no ids and decode to an empty text. Long texts are taken
whole, and long units are cut nowhere: those of over `LONG` bytes are walked one by one, in time
and memory that grow with their length. Repeated rows are encoded each. Other columns are carried
through; the columns added here replace any of the same name. An empty table gives an empty one.
"""

from __future__ import annotations

import re
import zlib
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from gridwright.llm.common import gather, pieces, read

MODEL = "piece_bpe_32k.model"
MARK = "▁"
LONG = 64
#: Different units of which a task keeps the ids; it forgets all when there are more.
CACHED_UNITS = 500_000
#: A line feed is in no piece (`Pieces` makes sure), so it is a unit by itself.
UNITS = re.compile(rf"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")

ADDED = {"ids": "array<int>", "n_tokens": "long", "n_byte_tokens": "long", "ids_crc32": "long", "decoded_same": "boolean"}


class DoubleArray:
    """Transitions base[state] + byte + 1, valid where check has the state; value is a piece's id or -1."""

    def __init__(self, keys: dict[bytes, int]):
        import numpy as np

        root: dict = {}
        for key, value in keys.items():
            node = root
            for b in key:
                node = node.setdefault(b, {})
            node[-1] = value
        size = 1 << 12
        base, check, value = (np.full(size, x, np.int32) for x in (0, -1, -1))
        check[0] = 0
        free = probe = 300  # beyond the largest code, so that no base is negative
        places = np.arange(64)[:, None]
        todo = [(0, root)]
        while todo:
            state, node = todo.pop()
            value[state] = node.pop(-1, -1)
            if not node:
                continue
            codes = np.array(sorted(node), np.int32) + 1
            while check[free] >= 0:
                free += 1
            # one child goes to the first free place; several are tried at 64 places at a time
            at = free - int(codes[0]) if len(codes) == 1 else probe
            while True:
                while at + 600 >= len(check):
                    base, check, value = (np.concatenate([x, np.full(len(x), y, np.int32)]) for x, y in ((base, 0), (check, -1), (value, -1)))
                fits = (check[at + places + codes] < 0).all(axis=1)
                if fits.any():
                    at += int(fits.argmax())
                    break
                at += len(fits)
                probe = max(probe, at)
            base[state] = at
            check[at + codes] = state
            todo += [(at + c, node[c - 1]) for c in codes.tolist()]
        self.base, self.check, self.value = base, check, value

    def step(self, state, byte):
        """The states after a byte, -1 where there is none; arrays or numbers."""
        import numpy as np

        after = self.base[state] + byte + 1
        return np.where(self.check[after] == state, after, -1)


class Pieces:
    """The pieces of a model: ids, scores, byte pieces, and the trie."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str], penalty: float | None = None):
        import numpy as np

        self.score = np.array(scores, np.float64)
        self.penalty = min(s for s, k in zip(scores, kinds, strict=True) if k == "normal") - 10 if penalty is None else penalty
        self.byte_id = np.full(256, kinds.index("unknown"), np.int32)
        self.is_byte = np.array([k == "byte" for k in kinds])
        self.text = []
        for i, (piece, kind) in enumerate(zip(pieces, kinds, strict=True)):
            if kind == "byte":
                self.byte_id[int(piece[3:5], 16)] = i
            self.text.append(bytes([int(piece[3:5], 16)]) if kind == "byte" else piece.replace(MARK, " ").encode() if kind == "normal" else b"")
        keys = {p.encode(): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "normal"}
        if any(MARK in p.decode().lstrip(MARK) for p in keys):
            raise ValueError("a piece has a marker behind another character")
        if any(b"\n" in p for p in keys):
            raise ValueError("a piece has a line feed")
        self.longest = max(map(len, keys))
        self.trie = DoubleArray(keys)
        self.plain = None
        self.flat = np.frombuffer(b"".join(self.text), np.uint8)
        self.lengths = np.array([*map(len, self.text)], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def segment(self, units: list[bytes]) -> list:
        """Ids of each unit."""
        import numpy as np

        out: list = [None] * len(units)
        order = sorted(range(len(units)), key=lambda i: len(units[i]))
        for at in range(0, len(order), 8192):
            group = [i for i in order[at : at + 8192] if len(units[i]) <= LONG]
            if group:
                for i, ids in zip(group, self._together([units[i] for i in group]), strict=True):
                    out[i] = np.array(ids, np.int32)
        for i in order:
            if out[i] is None:
                out[i] = np.array(self._alone(units[i]), np.int32)
        return out

    def _alone(self, unit: bytes) -> list[int]:
        """Viterbi over one unit of any length, in plain steps through the trie."""
        if self.plain is None:
            self.plain = [x.tolist() for x in (self.trie.base, self.trie.check, self.trie.value, self.score)]
        base, check, values, scores = self.plain
        n, none = len(unit), float("-inf")
        best, last, back = [0.0] + [none] * n, [-1] * (n + 1), [0] * (n + 1)
        for s in range(n):
            here = best[s]
            if here == none:
                continue
            lead = unit[s]
            e = s + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            if here + self.penalty > best[e]:
                best[e], last[e], back[e] = here + self.penalty, -2, s
            state = 0
            for e in range(s, n):
                after = base[state] + unit[e] + 1
                if check[after] != state:
                    break
                state = after
                value = values[state]
                if value >= 0 and here + scores[value] > best[e + 1]:
                    best[e + 1], last[e + 1], back[e + 1] = here + scores[value], value, s
        ids: list[int] = []
        e = n
        while e:
            s = back[e]
            ids += [last[e]] if last[e] != -2 else [int(self.byte_id[b]) for b in reversed(unit[s:e])]
            e = s
        return ids[::-1]

    def _together(self, units: list[bytes]) -> list[list[int]]:
        """Viterbi over all units at once, by the start of the last piece."""
        import numpy as np

        n, sizes = len(units), np.array([*map(len, units)], np.int64)
        most = int(sizes.max())
        grid = np.frombuffer(b"".join(u.ljust(most, b"\0") for u in units), np.uint8).reshape(n, most).astype(np.int32)
        best = np.full((n, most + 1), -np.inf)
        best[:, 0] = 0
        last = np.full((n, most + 1), -1, np.int32)  # the last piece, or -2 for a character as bytes
        back = np.zeros((n, most + 1), np.int32)
        for s in range(most):
            rows = np.flatnonzero((best[:, s] > -np.inf) & (sizes > s))
            if not len(rows):
                continue
            lead = grid[rows, s]
            width = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            self._better(best, last, back, rows, s, s + width, best[rows, s] + self.penalty, np.full(len(rows), -2))
            state = np.zeros(len(rows), np.int32)
            for e in range(s, min(s + self.longest, most)):
                state = self.trie.step(state, grid[rows, e])
                live = (state >= 0) & (sizes[rows] > e)
                if not live.any():
                    break
                rows, state = rows[live], state[live]
                value = self.trie.value[state]
                hit = value >= 0
                if hit.any():
                    at = rows[hit]
                    self._better(best, last, back, at, s, np.full(len(at), e + 1), best[at, s] + self.score[value[hit]], value[hit])
        ids: list[list[int]] = [[] for _ in units]
        for i, unit in enumerate(units):
            e, path = len(unit), last[i]
            while e:
                s = int(back[i, e])
                if path[e] == -2:
                    ids[i] += [int(self.byte_id[b]) for b in reversed(unit[s:e])]
                else:
                    ids[i].append(int(path[e]))
                e = s
            ids[i].reverse()
        return ids

    @staticmethod
    def _better(best, last, back, rows, s, ends, score, value) -> None:
        better = score > best[rows, ends]
        rows, ends = rows[better], ends[better]
        best[rows, ends], last[rows, ends], back[rows, ends] = score[better], value[better], s

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_bytes(self, ids) -> bytes:
        import numpy as np

        ids = np.asarray(ids, np.int64)
        return gather(self.flat, self.starts[ids], self.lengths[ids]).tobytes()[1:]


def load(path: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "unknown" if model.is_unknown(i) else "byte" if model.is_byte(i) else "control" if model.is_control(i) else "normal"
    all_ids = range(model.get_piece_size())
    return Pieces([model.id_to_piece(i) for i in all_ids], [model.get_score(i) for i in all_ids], [kind(i) for i in all_ids])


@cache
def loaded(path: str) -> Pieces:
    """One trie for each Python worker, which is used for many tasks."""
    return load(path)


@cache
def encoder_of(path: str) -> Encoder:
    """One cache of units for each Python worker."""
    return Encoder(loaded(path))


class Encoder:
    def __init__(self, table: Pieces):
        self.table = table
        self.seen: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]):
        """(lengths, ids) of texts."""
        import numpy as np

        units: list[str] = []
        ends = []
        for text in texts:
            if text:
                units += UNITS.findall(MARK + text.replace(" ", MARK))
            ends.append(len(units))
        places: dict[str, int] = {}
        which = np.fromiter((places.setdefault(u, len(places)) for u in units), np.int64, len(units))
        new = [u for u in places if u not in self.seen]
        if len(self.seen) + len(new) > CACHED_UNITS:
            self.seen.clear()
            new = list(places)
        self.seen.update((u, ids.tobytes()) for u, ids in zip(new, self.table.segment([u.encode() for u in new]), strict=True))
        found = [self.seen[u] for u in places]
        flat = np.frombuffer(b"".join(found), np.int32)
        lengths = np.array([*map(len, found)], np.int64) // 4
        taken = lengths[which]
        total = np.concatenate([[0], np.cumsum(taken)])[np.array(ends, np.int64)]
        return np.diff(total, prepend=0), gather(flat, (np.cumsum(lengths) - lengths)[which], taken)


def _encoded(path: str, column: str):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        encoder = encoder_of(path)
        table = encoder.table
        for batch in batches:
            for piece in pieces(batch, column, 2 << 20):
                texts = piece.column(column).to_pylist()
                n, ids = encoder.encode(texts)
                ends = np.cumsum(n)
                raw = memoryview(ids.astype("<u4").tobytes())
                spans = list(zip((ends - n).tolist(), ends.tolist(), strict=True))
                same = [table.decode_bytes(ids[s:e]) == (t or "").encode() for (s, e), t in zip(spans, texts, strict=True)]
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                as_bytes = np.concatenate([[0], np.cumsum(table.is_byte[ids])])
                added = [
                    pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.array(n, pa.int64()), pa.array(as_bytes[ends] - as_bytes[ends - n], pa.int64()),
                    pa.array([zlib.crc32(raw[4 * s : 4 * e]) for s, e in spans], pa.int64()), pa.array(same, pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([*piece.columns, *added], names=[*piece.schema.names, *ADDED])

    return run


def encode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """`docs` with the columns of ADDED. No shuffle; memory for a slice of 2 MB of text, or one text."""
    base = docs.drop(*ADDED)
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), *(f"{k} {v}" for k, v in ADDED.items())])
    return base.mapInArrow(_encoded(model, text), kinds)


def _decoded(path: str, column: str, to: str):
    def run(batches):
        import pyarrow as pa

        table = loaded(path)
        for batch in batches:
            texts = [table.decode(ids) if ids else "" for ids in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, to])

    return run


def decode(rows: DataFrame, model: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """`rows` with the text of their ids."""
    base = rows.drop(to)
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), f"`{to}` string"])
    return base.mapInArrow(_decoded(model, ids, to), kinds)


def op3_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(MODEL)).drop("text")
