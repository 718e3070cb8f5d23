"""Quality classifier by compression with dictionaries of good and bad text.

Two zstandard dictionaries are trained on labelled texts, one of each class. A text is cut into
pieces of `PIECE` bytes, since a dictionary helps only the start of what is compressed, and each
piece is compressed with either dictionary, and alone. The difference of the two sizes, as a
share of their sum, is the evidence; a logistic curve, fitted on labelled texts that the
dictionaries have not seen, makes it a probability. Junk that repeats itself compresses alike
with either, so the curve also takes the share of its bytes that a piece compresses to.

The model is fitted on a bounded sample: of each class the `MOST` labelled documents with the
least hashes of their doc_id, with their whole texts. No other bound holds: their number is what
limits what comes to the driver. Scoring takes every whole text, piece by piece, so a long one
costs no more memory.

Defined cases. Null and empty texts have no pieces and get the share of label 1 among the
fitted texts. Without labels of both classes every score is that share, or 0.5. Equal label rows
count once; a document labelled both ways teaches nothing, nor do labels without a document or a
doc_id. Of rows that share a labelled doc_id the one teaches whose text has the least hash, so that
the bound holds, and each row is scored by itself. Scores depend on the text alone, so equal texts tie. Other columns are ignored,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.llm.common import read

PIECE = 512
LEVEL = 3
DICTIONARY_BYTES = 256 << 10
#: The bound of the sample: so many labelled documents of each class.
MOST = 2000
CUT = 0.3
FOLDS = 5


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: list[float]
    prior: float


class Sizes:
    """Compressed sizes of a text's pieces with each dictionary and without one."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        make = lambda d: zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(d) if d else None)
        self.with_good, self.with_bad, self.alone = make(good), make(bad), make(b"")

    def features(self, text: bytes) -> tuple[float, float] | None:
        """(difference, share) of a text: means over its pieces, weighted by their sizes."""
        if not text:
            return None
        g = b = a = 0
        for at in range(0, len(text), PIECE):
            piece = text[at : at + PIECE]
            g += len(self.with_good.compress(piece))
            b += len(self.with_bad.compress(piece))
            a += len(self.alone.compress(piece))
        return (b - g) / (b + g), a / len(text)


def _terms(x: tuple[float, float]) -> list[float]:
    d, share = x
    return [1.0, 10 * d, 4 * share, 10 * d * share, 16 * min(share, 1.0) ** 2]


def _logistic(rows: list[list[float]], labels: list[int], ridge: float = 1e-3, steps: int = 100) -> list[float]:
    """Newton's method, each step halved until the loss falls; both classes weigh as they come."""
    import numpy as np

    x, y = np.array(rows), np.array(labels, float)

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - y @ z + ridge / 2 * w @ w

    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = np.exp(-np.logaddexp(0, -(x @ w)))
        gradient = x.T @ (p - y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        while abs(step).max() > 1e-9 and not loss(w - step) < loss(w):
            step /= 2
        if abs(step).max() <= 1e-9:
            break
        w -= step
    return w.tolist()


def _dictionary(texts: list[bytes]) -> bytes:
    import xxhash
    import zstandard

    parts = sorted({t[at : at + PIECE] for t in texts for at in range(0, len(t), PIECE)}, key=lambda p: (xxhash.xxh64_intdigest(p), p))
    total = sum(map(len, parts))
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, total // 8)), parts, k=128, d=8).as_bytes()
    except zstandard.ZstdError:  # too few or too short texts to train on: their own bytes serve
        return b"".join(parts)[-DICTIONARY_BYTES:]


def fit(rows: list[tuple[int, str | None, int]]) -> Model:
    """A model from (doc_id, text, label). Half of the texts make dictionaries, the others the curve."""
    from zlib import crc32

    known = sorted((d, (t or "").encode(), int(q)) for d, t, q in rows if q is not None and d is not None)
    prior = sum(q for _, _, q in known) / len(known) if known else 0.5
    learn = {q: [t for d, t, y in known if y == q and t and crc32(f"half {d}".encode()) % 2 == 0] for q in (0, 1)}
    if not learn[0] or not learn[1]:
        return Model(b"", b"", [], prior)
    good, bad = _dictionary(learn[1]), _dictionary(learn[0])
    sizes = Sizes(good, bad)
    held = [(x, q) for d, t, q in known if crc32(f"half {d}".encode()) % 2 and (x := sizes.features(t))]
    if len({q for _, q in held}) < 2:
        return Model(b"", b"", [], prior)
    return Model(good, bad, _logistic([_terms(x) for x, _ in held], [q for _, q in held]), prior)


def _scores(model: Model):
    def run(batches):
        import pyarrow as pa

        sizes = Sizes(model.good, model.bad)
        for batch in batches:
            scores = []
            for text in batch.column("text").cast(pa.binary()):
                x = sizes.features(text.as_py() or b"") if model.weights else None
                z = sum(w * t for w, t in zip(model.weights, _terms(x), strict=True)) if x else None
                scores.append(model.prior if z is None else 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            at = batch.schema.get_field_index("text")
            yield batch.remove_column(at).append_column("score", pa.array(scores, pa.float64()))

    return run


def held_out(doc_id, folds: int = FOLDS):
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == 0


def fit_on(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Model:
    """A model from the labelled rows that are not held out; at most `most` documents of each class."""
    given = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = given.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where(F.col("quality") == 0).orderBy(*order).limit(most).unionByName(known.where(F.col("quality") != 0).orderBy(*order).limit(most))
    # twice `most` ids at most are broadcast, and one text of each comes back
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = found.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "text", "quality")
    return fit([tuple(r) for r in rows.collect()])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """doc_id and score of every whole text. No shuffle."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_scores(model), "doc_id long, score double")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, fit_on(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
