"""Near-dedup by SimHash with pigeonhole blocks, wide enough for a similarity of 0.8: blocks find pairs, shingles decide.

A text's words in lower case (A-Z only) make a set of shingles of `SHINGLE` words; fewer words
are one shingle. Two texts link if their sets have a Jaccard similarity of `LEAST` or more,
counted on the shingles themselves, and one row of each component of links stays.

At 0.8 two fingerprints differ in 15 of 100 bits, and 64 bits have no room for so many blocks. So
the fingerprint has `WORDS` words of 64 bits, of which the first is that of `simhash`, and is cut
into blocks of `BLOCK` bits, 32 in all. Fingerprints within 31 bits share a block, whatever the
bits; at 78, which is usual at 0.8, nine pairs of ten do, and more of closer ones. Pairs that share
a block are candidates if they lie within `RADIUS` on the first `FILTER` words, where unlike texts
differ in half of the bits. Groups of more than `SMALL` are joined by each row's `NEXT` closest
among `SPAN` rows, never by all pairs; where the exact check follows, groups of more than `NEXT`
give a tree, of each row and the closest before it. Each row's closest candidate is verified first,
then all pairs that the links found so far leave apart: no candidate goes unseen.

An exact check then finds what the blocks and trees leave apart, by prefixes: in one order of all
shingles, two sets of similarity `LEAST` share one of the first n - ceil(LEAST n) + 1. Rows that
share such a shingle, but for those that are joined already, and whose sizes and places allow it,
are verified. So no link is missed. Any order will do. Those that a sample shows to be frequent come
last, and those whose hashes lie in the first `COUNTED` part come first: every row sends all that it
has of these, so that their rows are counted, and the rarest go before the others.

Defined cases. Equal sets are one node, so copies cost nothing more; wordless texts are equal.
Of a component the row with the least doc_id stays, then the first read; null comes last.
Repeated rows are rows of their own. A long text is hashed whole. Other columns are carried,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwright.llm.common import HOT_SHARE, cut, join_to_one, packed, partitions, unpacked
from gridwright.llm.components import components
from gridwright.llm.simhash import SEED, SMALL, fingerprint_of, shingle_hashes

SHINGLE = 5
LEAST = 0.8
WORDS = 8
BLOCK = 16
FILTER = 2
RADIUS = 38
NEXT = 5
SPAN = 4096
#: Keys of rows that a task holds, about.
TASK_ROWS = 1 << 20
#: Part of all hashes, under a half, whose shingles are counted over all rows and come first in the order of prefixes, the rarest first. Results don't depend on it.
COUNTED = 0.25
#: Rows whose shingles are counted for the order of the others, and the most shingles that go last in it. Results don't depend on them.
ORDER_ROWS, ORDER_MOST, ORDER_LEAST = 1 << 14, 1 << 16, 3
NOT_COUNTED = 1 << 63
#: Shingles before one in a prefix that are looked at, to meet a pair once. Results don't depend on it.
BEFORE = 4


def _odd(n: int):
    """Fixed odd multipliers."""
    import numpy as np

    return np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def wide_fingerprint(hashes):
    """The words of a set's fingerprint, from its distinct hashes: a bit is 1 if it is set in over half of them. The first word is `simhash.fingerprint_of`."""
    import numpy as np

    out = np.zeros(WORDS, np.uint64)
    if not len(hashes):
        return out
    odd = _odd_of[0] if _odd_of else _odd_of.append(_odd(2 * WORDS)) or _odd_of[0]
    out[0] = fingerprint_of(hashes)
    count = np.zeros(64 * (WORDS - 1), np.int64)
    for at in range(0, len(hashes), 255):  # sums of bytes
        part = hashes[at : at + 255, None]
        mixed = (part ^ (part >> np.uint64(32))) * odd[None, 1:WORDS]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * odd[None, WORDS + 1 :]
        mixed ^= mixed >> np.uint64(32)
        bits = np.unpackbits(np.ascontiguousarray(mixed.astype("<u8")).view(np.uint8).reshape(len(mixed), -1), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.uint8)
    out[1:] = np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")
    return out


_odd_of: list = []


def block_keys(fingerprint):
    """A key for each block: its place and its bits."""
    import numpy as np

    bits = fingerprint.astype("<u8").view(f"<u{BLOCK // 8}").astype(np.int64)
    return (np.arange(len(bits), dtype=np.int64) << BLOCK) | bits


def prefix_of(hashes, last, places, least: float):
    """Of a set's sorted hashes all that are counted, and more up to n - ceil(least n) + 1, in the order of all sets: hashes in `last` (sorted) come last, by their `places`.

    The highest bit is 0 for the counted ones: those in the first part of all hashes, but for `last`.
    """
    import numpy as np

    n = len(hashes)
    if not n:
        return hashes
    most = n - int(np.ceil(least * n - 1e-9)) + 1
    rank = np.zeros(n, np.int64)
    if len(last):
        at = np.searchsorted(last, hashes)
        at[at == len(last)] = 0
        rank = np.where(last[at] == hashes, places[at] + 1, 0)
    counted = (rank == 0) & (hashes < np.uint64(COUNTED * 2**64))
    first = np.argsort(rank, kind="stable")[: max(int(counted.sum()), most)]
    return np.where(counted[first], hashes[first], hashes[first] | np.uint64(NOT_COUNTED))


def _sketches(shingle: int, least: float, last, places):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        def lists(x):
            flat = np.concatenate([np.empty(0, np.int64), *x])
            return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]).astype(np.int32)), pa.array(flat))

        for batch in batches:
            sets, sizes, fps, keys, prefixes = [], [], [], [], []
            for t in batch.column("text").cast(pa.binary()):
                hashes = np.unique(shingle_hashes(t.as_py() or b"", shingle))
                sets.append(xxhash.xxh128_digest(hashes.astype("<u8").tobytes()))
                sizes.append(len(hashes))
                wide = wide_fingerprint(hashes)
                fps.append(wide[:FILTER].view(np.int64))
                keys.append(block_keys(wide) if len(hashes) else np.empty(0, np.int64))
                prefixes.append(prefix_of(hashes, last, places, least).view(np.int64))
            fps = np.array(fps, np.int64).reshape(-1, FILTER)
            columns = [pa.array(sets, pa.binary()), pa.array(sizes, pa.int64()), *[pa.array(np.ascontiguousarray(fps[:, i])) for i in range(FILTER)], lists(keys), lists(prefixes)]
            rest = batch.remove_column(batch.schema.get_field_index("text"))
            yield pa.RecordBatch.from_arrays([*rest.columns, *columns], names=[*rest.schema.names, "set", "size", *FPS, "keys", "prefix"])

    return run


FPS = [f"fp{i}" for i in range(FILTER)]


def _hashed(shingle: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py() or b"", shingle)) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64))], names=["h"])

    return run


def frequent(rows: DataFrame, n: int, shingle: int):
    """Hashes of frequent shingles, sorted, the places of each, the rarest first, and the most frequent: ORDER_MOST at most, counted over about ORDER_ROWS of the `n` rows.

    They only order the prefixes: with any other set the result is the same, and the join longer.
    """
    import numpy as np

    some = rows.where(F.pmod(F.xxhash64("uid"), F.lit(max(1, n // ORDER_ROWS))) == 0)
    counts = some.select("text").mapInArrow(_hashed(shingle), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= ORDER_LEAST)
    found = counts.orderBy(F.desc("df"), "h").limit(ORDER_MOST).select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], (len(found) - 1 - order).astype(np.int64), (found[:HOT_SHARE] | np.uint64(NOT_COUNTED)).view(np.int64).tolist()


def pairs_in(keys, nodes, fps, radius: int | None = None, trees: bool = False):
    """Pairs (a, b) of rows with one key whose fingerprints (rows of words) lie within `radius`, and their distance. `trees`: of groups of more than NEXT, only each row with the closest before it."""
    import numpy as np

    radius = RADIUS if radius is None else radius
    small = NEXT if trees else SMALL
    turn = (keys >> np.uint64(BLOCK)) * np.uint64(7) & np.uint64(63)
    turned = (fps[:, 0] << turn) | (fps[:, 0] >> ((np.uint64(64) - turn) & np.uint64(63)))
    order = np.lexsort((nodes, turned, keys))
    keys, nodes, fps = keys[order], nodes[order], fps[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(keys)))
    ends = np.repeat(starts + sizes, sizes)
    out = []

    def add(i, j):
        apart = np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1, dtype=np.int32)
        near = apart <= radius
        a, b = nodes[i[near]], nodes[j[near]]
        out.append((np.minimum(a, b), np.maximum(a, b), apart[near]))

    left = np.flatnonzero(np.repeat(sizes <= small, sizes))
    for d in range(1, small):
        left = left[left + d < ends[left]]
        if not len(left):
            break
        add(left, left + d)
    for s, n in zip(starts[sizes > small], sizes[sizes > small], strict=True):
        for lo in range(s, s + n, SPAN):
            # a last span is as long as the others, where the group allows
            lo, hi = max(s, min(lo, s + n - SPAN)), min(lo + SPAN, s + n)
            for at in range(lo, hi, 256):
                rows = np.arange(at, min(at + 256, hi))
                if trees:
                    apart = sum(np.bitwise_count(fps[rows, None, w] ^ fps[None, lo : rows[-1] + 1, w]) for w in range(fps.shape[1]))
                    apart[np.arange(lo, rows[-1] + 1) >= rows[:, None]] = 255
                    has = rows > lo  # the first has none before it
                    add(lo + apart.argmin(axis=1)[has], rows[has])
                    continue
                apart = sum(np.bitwise_count(fps[rows, None, w] ^ fps[None, lo:hi, w]) for w in range(fps.shape[1]))
                apart[np.arange(len(rows)), rows - lo] = 255
                add(np.repeat(rows, NEXT), lo + np.argpartition(apart, NEXT, axis=1)[:, :NEXT].ravel())
    if not out:
        return [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)]
    a, b, apart = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((b, a))  # rows that are each other's closest, or meet by several keys
    a, b, apart = a[order], b[order], apart[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return [a[new], b[new], apart[new]]


def _pairs(trees: bool):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        got = [[b.column(c).to_numpy() for c in ("key", "node", *FPS)] for b in batches]
        if got:
            keys, nodes, *fps = (np.concatenate(x) for x in zip(*got, strict=True))
            found = pairs_in(keys.view(np.uint64), nodes, np.stack(fps, axis=1).view(np.uint64), trees=trees)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b", "apart"])

    return run


def shingles(text: bytes, shingle: int = SHINGLE) -> set:
    """The set itself, as bytes."""
    words = text.lower().split()
    return {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def similar(a: set, b: set, least: float = LEAST) -> bool:
    """True for a Jaccard similarity of `least` or more."""
    both = len(a & b)
    return both >= least * (len(a) + len(b) - both)


def _verified(shingle: int, least: float):
    def run(batches):
        import pyarrow as pa

        of, last = None, None
        for batch in batches:
            keep = []
            for a, b, ta, tb in zip(batch.column("a").to_pylist(), batch.column("b"), batch.column("ta").cast(pa.binary()), batch.column("tb").cast(pa.binary()), strict=True):
                if a != last:
                    of, last = shingles(ta.as_py() or b"", shingle), a
                keep.append(similar(of, shingles(tb.as_py() or b"", shingle), least))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def similar_links(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """Those of `pairs` (a, b) whose texts are similar. `texts`: node, text."""
    with_a = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    return cut(both.mapInArrow(_verified(shingle, least), "a long, b long"), "similar-links")


def candidates(nodes: DataFrame, trees: bool = False) -> DataFrame:
    """a, b, apart of every candidate pair once; with `trees` as many as rows in groups of more than NEXT, at most. `nodes`: node, fp0, fp1, keys."""
    keyed = nodes.select("node", *FPS, F.explode("keys").alias("key"))
    large = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPAN), "similar-large")
    if large.head(1):
        # a group of more than a span is dealt in spans; its block stays in the key
        salt = F.coalesce(F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("n") / SPAN)), F.lit(0))
        keyed = keyed.join(large, "key", "left").select("node", *FPS, (F.shiftleft(salt, 32) + F.col("key")).alias("key"))
    tasks = max(partitions(nodes.sparkSession), -(-nodes.count() * 64 * WORDS // BLOCK // TASK_ROWS))
    found = keyed.repartition(tasks, "key").mapInArrow(_pairs(trees), "a long, b long, apart int")
    return cut(found.distinct(), "similar-candidates")


def _shared(batches):
    """The rows whose h another row has too, and how many have it."""
    import numpy as np
    import pyarrow as pa

    got = [[b.column(c).to_numpy() for c in ("node", "place", "h")] for b in batches]
    if got:
        nodes, places, h = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.argsort(h, kind="stable")
        runs = np.diff(np.flatnonzero(np.concatenate([[True], h[order[1:]] != h[order[:-1]], [True]]))) if len(h) else np.empty(0, np.int64)
        df = np.repeat(runs, runs)
        keep, df = order[df > 1], df[df > 1]
        for at in range(0, len(keep), 1 << 16):
            some = keep[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (nodes[some], places[some], h[some], df[at : at + (1 << 16)])], names=["node", "place", "h", "df"])


def prefixes(nodes: DataFrame, sizes: DataFrame, hot: list, least: float = LEAST) -> DataFrame:
    """node, place, h of the prefixes' shingles that more than one row has, with their places from 1 among all of the row's. Those of `hot` stay where they are. `sizes`: node, size, counted.

    Of the counted shingles those that no other row has come first, then the others, the rarest
    first; what lies behind the prefix then is left out.
    """
    is_counted = F.col("h") >= 0
    each = nodes.select("node", F.posexplode("prefix").alias("place", "h")).select("node", F.when(is_counted, 0).otherwise(F.col("place") + 1).cast("long").alias("place"), "h")
    tasks = max(partitions(nodes.sparkSession), -(-(nodes.agg(F.sum(F.size("prefix"))).first()[0] or 0) // TASK_ROWS))
    is_hot = F.col("h").isin(hot) if hot else F.lit(False)
    found = each.where(~is_hot).repartition(tasks, "h").mapInArrow(_shared, "node long, place long, h long, df long")
    if hot:
        found = found.unionByName(each.where(is_hot).withColumn("df", F.lit(None).cast("long")))
    shared = cut(found, "similar-counted").join(sizes, "node")
    by = W.partitionBy("node")
    alone = F.col("counted") - F.sum(is_counted.cast("long")).over(by)
    ranked = shared.withColumns({"alone": alone, "rank": F.row_number().over(by.orderBy(~is_counted, "place", "df", "h"))})
    placed = ranked.withColumn("place", F.when(is_counted, F.col("alone") + F.col("rank")).otherwise(F.col("place")))
    return cut(placed.where(F.col("place") <= F.col("size") - F.ceil(least * F.col("size") - 1e-9) + 1).select("node", "place", "h"), "similar-prefixes")


def apart_by_prefix(held: DataFrame, sizes: DataFrame, roots: DataFrame, least: float = LEAST) -> DataFrame:
    """Pairs (a, b) of different components that share a shingle of their prefixes (`held`) and may be similar by their sizes and its places.

    At the first shingle that two rows share, what follows it in either has to be enough for the
    overlap that `least` asks for; so a pair is met there, and needn't be at later ones: it isn't
    where one of the `BEFORE` shingles before is shared too.

    Of a shingle's rows the most frequent component needn't be held against itself, so its rows
    stand on one side only; that side is dealt in spans, and the few others go to all of them.
    """
    rooted = cut(sizes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "similar-rooted")
    named = cut(held.join(rooted, "node"), "similar-named-prefixes")
    shared = named.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("rows")).where("x <> y")
    held = cut(join_to_one(named, cut(shared.select("h", "rows"), "similar-shared"), "h"), "similar-apart")
    counts = held.groupBy("h", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("h").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    before = F.collect_list("h").over(W.partitionBy("node").orderBy("place").rowsBetween(-BEFORE, -1))
    mixed = cut(join_to_one(held, cut(counts, "similar-main"), "h").withColumn("before", before), "similar-mixed")
    spans = F.ceil(F.col("rows") / SPAN).cast("long")
    right = mixed.select("h", F.pmod(F.xxhash64("node"), spans).alias("span"), F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("place").alias("place_b"), F.col("root").alias("root_b"), F.col("before").alias("before_b"), "main")
    left = mixed.where("root <> main").select("h", F.explode(F.sequence(F.lit(0).cast("long"), spans - 1)).alias("span"), F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("place").alias("place_a"), F.col("root").alias("root_a"), F.col("before").alias("before_a"))
    once = (F.col("root_b") == F.col("main")) | (F.col("a") < F.col("b"))
    near = (F.col("size_a") >= least * F.col("size_b") - 1e-9) & (F.col("size_b") >= least * F.col("size_a") - 1e-9)
    behind = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b")) + 1
    enough = behind >= least / (1 + least) * (F.col("size_a") + F.col("size_b")) - 1e-9
    first = ~F.arrays_overlap("before_a", "before_b")
    return left.join(right, ["h", "span"]).where((F.col("root_a") != F.col("root_b")) & once & near & enough & first).select("a", "b").distinct()


def enough_shared(pairs: DataFrame, nodes: DataFrame, least: float = LEAST) -> DataFrame:
    """Those of `pairs` (a, b) whose prefixes share enough shingles for a similarity of `least`. `nodes`: node, size, prefix.

    What two sets share lies in both prefixes, or behind the one that ends first, in the order that
    `prefix_of` keeps; so only pairs that may be similar need their texts.
    """
    named = cut(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), "similar-by-prefix-named")
    held = cut(nodes.join(named, "node", "left_semi").select("node", "size", "prefix"), "similar-by-prefix-held")
    both = pairs.join(held.toDF("a", "size_a", "prefix_a"), "a").join(held.toDF("b", "size_b", "prefix_b"), "b")
    behind = F.greatest(F.col("size_a") - F.size("prefix_a"), F.col("size_b") - F.size("prefix_b"))
    shared = F.size(F.array_intersect("prefix_a", "prefix_b"))
    return both.where(shared + behind >= least / (1 + least) * (F.col("size_a") + F.col("size_b")) - 1e-9).select("a", "b")


def similar_groups(rows: DataFrame, shingle: int = SHINGLE, least: float = LEAST, exact: bool = True) -> DataFrame:
    """uid, keep_uid of every row. `rows` has uid, doc_id and text, and is read from files. Without `exact` only pairs that share a block are found."""
    last, places, hot = frequent(rows, rows.count(), shingle)
    schema = f"uid long, doc_id long, set binary, size long, {' long, '.join(FPS)} long, keys array<bigint>, prefix array<bigint>"
    sketched = cut(rows.mapInArrow(_sketches(shingle, least, last, places), schema), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first")
    sets = cut(sketched.groupBy("set").agg(first).select("set", "first", F.col("first.uid").alias("node")), "sets")
    # most rows are nodes, so the others are taken away where `sketched` is read, and it isn't copied
    others = cut(sketched.select("uid").join(sets.select(F.col("node").alias("uid")), "uid", "left_anti"), "similar-others")
    nodes = sketched.join(others, "uid", "left_anti").select(F.col("uid").alias("node"), "size", *FPS, "keys", "prefix")
    pairs = candidates(nodes, trees=exact)
    texts = _texts(rows, pairs)

    closest = pairs.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")
    links = similar_links(closest, texts, shingle, least)
    roots = components(links)
    at = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    apart = pairs.join(at("a"), "a", "left").join(at("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    rest = apart.select("a", "b").join(closest, ["a", "b"], "left_anti")
    links = links.unionByName(similar_links(rest, texts, shingle, least))
    roots = cut(components(links), "similar-roots")
    if exact:
        counted = F.size(F.filter("prefix", lambda h: h >= 0)).cast("long")
        sizes = cut(nodes.select("node", "size", counted.alias("counted")), "similar-sizes")
        met = cut(apart_by_prefix(prefixes(nodes, sizes, hot, least), sizes.select("node", "size"), roots, least), "similar-by-prefix")
        more = cut(enough_shared(met, nodes, least), "similar-enough-shared")
        if more.head(1):
            more = similar_links(more, _texts(rows, more), shingle, least)
            roots = components(links.unionByName(more)) if more.head(1) else roots

    rooted = cut(sets.join(roots, "node", "left").select("set", "first", F.coalesce("root", "node").alias("root")), "rooted-sets")
    best = rooted.groupBy("root").agg(F.min("first").alias("best"))
    classes = join_to_one(rooted.select("set", "root"), best, "root").select("set", F.col("best.uid").alias("keep_uid"))
    return join_to_one(sketched.select("uid", "set"), cut(classes, "set-classes"), "set").select("uid", "keep_uid")


def _texts(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """node and text of the rows that `pairs` (a, b) name."""
    named = cut(pairs.select(F.col("a").alias("uid")).union(pairs.select(F.col("b").alias("uid"))).distinct(), "similar-named")
    return cut(rows.join(named, "uid", "left_semi").select(F.col("uid").alias("node"), "text"), "similar-texts")


def drop_similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, least: float = LEAST, exact: bool = True) -> DataFrame:
    """The rows of `docs` that stay, all columns as they are. Without `exact` only pairs that share a block are found."""
    numbered = cut(packed(docs, F.monotonically_increasing_id().alias("uid"), F.col(doc_id).cast("long").alias("doc_id"), keep=[text]), "near-input")
    # written, so that Spark knows how few they are and doesn't move the texts to meet them
    dropped = cut(similar_groups(numbered.select("uid", "doc_id", F.col("c0").alias("text")), shingle, least, exact).where("uid <> keep_uid").select("uid"), "similar-dropped")
    return unpacked(numbered.join(dropped, "uid", "left_anti"), docs.columns, [text])
