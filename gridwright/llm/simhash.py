"""Near-dedup by SimHash with pigeonhole blocks.

A text's words in lower case (A-Z only) make shingles of `SHINGLE` words, repeats included;
each is hashed by XXH64 with seed 42, and a bit of the fingerprint is 1 if it is set in over
half of the hashes. Fingerprints link at `DISTANCE` or fewer differing bits, and the least
doc_id that links reach names the component.

Fingerprints are split into DISTANCE + 3 blocks, so a close pair shares 3 at least: each
fingerprint is keyed by every choice of 3 blocks (27 bits or more), which keeps unlike
fingerprints apart as their number grows. The rows of a key meet in one task, where small
groups give each close pair once (in the first choice of blocks that it shares), and large ones
a tree of links by breadth-first search, never all pairs. Equal fingerprints are one row
before that, so copies cost nothing more.

Rows of one fingerprint and fingerprints of one component may be a third of all: they are joined
to their class without meeting in one task (`common.join_to_one`).

Defined cases. Null, empty and wordless texts have fingerprint zero, linked like any other.
Fewer words than a shingle are one shingle; a long text is hashed whole, 64 K shingles at a time.
Of a component the row with the least doc_id stays, then the first read; a null doc_id comes
after all others. Repeated rows are rows of their own. Other columns are ignored, and carried by
`drop_near_copies`, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.llm.common import cut, join_to_one, packed, partitions, read, unpacked
from gridwright.llm.components import components

SHINGLE = 4
DISTANCE = 4
SEED = 42
SHARED = 3
#: Groups of more fingerprints than this give a tree of links.
SMALL = 32
#: Keyed fingerprints that a task holds at once, about.
TASK_ROWS = 2_000_000


def blocks(distance: int = DISTANCE, shared: int = SHARED) -> list[int]:
    """Masks of distance + shared blocks that cover 64 bits."""
    n = distance + shared
    cuts = [64 * i // n for i in range(n + 1)]
    return [(1 << e) - (1 << s) for s, e in zip(cuts, cuts[1:], strict=False)]


def choices(distance: int = DISTANCE, shared: int = SHARED) -> list[int]:
    """Masks of each choice of `shared` blocks, in order."""
    return [sum(c) for c in combinations(blocks(distance, shared), shared)]


def shingle_hashes(text: bytes, shingle: int = SHINGLE):
    """XXH64 of each shingle in order, repeats included; none for a wordless text."""
    import numpy as np
    import xxhash

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[:-shingle].tolist()]
        stops = (ends[shingle - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, stops, strict=True)]
    return np.array(hashes, np.uint64)


def fingerprint_of(array) -> int:
    """The fingerprint of shingle hashes; zero for none."""
    import numpy as np

    count = np.zeros(64, np.int64)
    for at in range(0, len(array), 1 << 16):
        part = array[at : at + (1 << 16)]
        count += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = 2 * count > len(array)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    return fingerprint_of(shingle_hashes(text, shingle))


def _fingerprints(shingle: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = [fingerprint(t.as_py() or b"", shingle) for t in batch.column("text").cast(pa.binary())]
            at = batch.schema.get_field_index("text")
            yield batch.remove_column(at).append_column("fp", pa.array(np.array(found, np.uint64).view(np.int64)))

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """uid, doc_id, fp of rows with uid, doc_id and text. No shuffle."""
    return docs.select("uid", "doc_id", "text").mapInArrow(_fingerprints(shingle), "uid long, doc_id long, fp long")


def tree_of_links(fps, distance: int):
    """Links (parents, children) that join what is within `distance`, by breadth-first search over uint64 fingerprints."""
    import numpy as np

    parents, children = [], []
    left = fps
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                found = left[near]
                parents.append(np.full(len(found), x, np.uint64))
                children.append(found)
                queue.extend(found)
                left = left[~near]
    join = lambda x: np.concatenate(x) if x else np.empty(0, np.uint64)
    return join(parents), join(children)


def links_in(keys, choice, fps, distance: int, shared: int):
    """Links among rows with equal (choice, key); arrays of uint64 and small ints."""
    import numpy as np

    order = np.lexsort((fps, keys, choice))
    keys, choice, fps = keys[order], choice[order], fps[order]
    new = np.ones(len(fps), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (choice[1:] != choice[:-1])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(fps)))
    masks = np.array(choices(distance, shared), np.uint64)
    out = []
    left = np.repeat(np.arange(len(starts)), sizes)
    ends = (starts + sizes)[left]
    small = np.flatnonzero((sizes <= SMALL)[left])
    for d in range(1, SMALL):
        small = small[small + d < ends[small]]
        if not len(small):
            break
        a, b = fps[small], fps[small + d]
        close = np.bitwise_count(a ^ b) <= distance
        a, b, c = a[close], b[close], choice[small][close]
        if len(a):
            first = ((a ^ b)[:, None] & masks[None, :] == 0).argmax(axis=1)
            out.append((a[first == c], b[first == c]))
    for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        out.append(tree_of_links(fps[s : s + n], distance))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.uint64)] * 2


def _links(distance: int, shared: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        got = [(b.column("key").to_numpy(), b.column("choice").to_numpy(), b.column("fp").to_numpy()) for b in batches]
        if got:
            keys, choice, fps = (np.concatenate(x) for x in zip(*got, strict=True))
            a, b = links_in(keys, choice, fps.view(np.uint64), distance, shared)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

    return run


def links(fps: DataFrame, distance: int = DISTANCE, shared: int = SHARED) -> DataFrame:
    """Links (a, b) of different fingerprints whose components are those of all close pairs. `fps` is read from files."""
    signed = [m - (1 << 64) if m >> 63 else m for m in choices(distance, shared)]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("choice", "key"))
    n = max(partitions(fps.sparkSession), -(-fps.count() * len(signed) // TASK_ROWS))
    return keyed.repartition(n, "choice", "key").mapInArrow(_links(distance, shared), "a long, b long")


def with_uid(docs: DataFrame) -> DataFrame:
    """`docs` with `uid`. Number rows once and read the numbers back: they belong to one run."""
    return docs.withColumn("uid", F.monotonically_increasing_id())


def _classes(rows: DataFrame, distance: int) -> DataFrame:
    """uid, doc_id, fp, component_id, keep_uid of `rows` (uid, doc_id, fp), which are read from files."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first")
    known = cut(rows.groupBy("fp").agg(least), "distinct-fingerprints")
    roots = components(links(known.select("fp"), distance))
    rooted = cut(known.join(roots, known["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"), "rooted-fingerprints")
    named = rooted.groupBy("root").agg(F.min("first").alias("best"))
    classes = join_to_one(rooted.select("fp", "root"), named, "root").select("fp", F.col("best.doc_id").alias("component_id"), F.col("best.uid").alias("keep_uid"))
    return join_to_one(rows, cut(classes, "fingerprint-classes"), "fp")


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint, component_id of every row, and kept: true for one row of each component."""
    numbered = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = _classes(cut(fingerprints(numbered, shingle), "fingerprints"), distance)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", (F.col("uid") == F.col("keep_uid")).alias("kept"))


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows of `docs` that stay, all columns as they are."""
    numbered = cut(packed(docs, F.monotonically_increasing_id().alias("uid"), F.col(doc_id).cast("long").alias("doc_id"), keep=[text]), "near-input")
    rows = cut(fingerprints(numbered.withColumnRenamed("c0", "text"), shingle), "fingerprints")
    # written, so that Spark knows how few they are and doesn't move the texts to meet them
    dropped = cut(_classes(rows, distance).where("uid <> keep_uid").select("uid"), "near-dropped")
    return unpacked(numbered.join(dropped, "uid", "left_anti"), docs.columns, [text])


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
