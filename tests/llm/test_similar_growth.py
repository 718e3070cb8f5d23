"""What the near stage joins grows with the rows of a group, not with their square, and no link is lost."""

import random


def test_a_large_group_of_blocks_gives_a_tree():
    import numpy as np

    from gridwright.llm.similar import pairs_in

    rng = np.random.default_rng(1)
    n = 300
    fps = np.full((n, 2), 12345, np.uint64) ^ (np.uint64(1) << rng.integers(0, 64, (n, 2), dtype=np.uint64))
    a, b, apart = pairs_in(np.full(n, 7, np.uint64), np.arange(n), fps, trees=True)
    root = list(range(n))
    for x, y in zip(a, b, strict=True):
        old, new = root[y], root[x]
        root = [new if r == old else r for r in root]
    assert len(a) == n - 1 and len(set(root)) == 1 and max(apart) <= 4


def test_common_passages_make_few_pairs(spark, monkeypatch):
    """Documents that share a passage too rare for the sample: their own shingles fill the prefixes, so none is met."""
    from gridwright.llm import similar
    from gridwright.llm.common import cut

    monkeypatch.setattr(similar, "ORDER_MOST", 0)
    rng = random.Random(5)
    passage = [f"p{k}" for k in range(40)]
    texts = [" ".join(passage + [f"w{i}-{k}" for k in range(rng.randint(500, 600))]) for i in range(120)]
    rows = cut(spark.createDataFrame(list(enumerate(texts)), "uid long, text string").withColumn("doc_id", similar.F.col("uid")).repartition(3), "rows")
    last, places, hot = similar.frequent(rows, len(texts), 5)
    schema = "uid long, doc_id long, set binary, size long, fp0 long, fp1 long, keys array<bigint>, prefix array<bigint>"
    nodes = cut(rows.select("uid", "doc_id", "text").mapInArrow(similar._sketches(5, 0.8, last, places), schema).withColumnRenamed("uid", "node"), "nodes")
    sizes = nodes.selectExpr("node", "size", "cast(size(filter(prefix, h -> h >= 0)) as bigint) counted")
    assert similar.prefixes(nodes, sizes, hot).count() < len(texts)
    assert similar.drop_similar(rows.select("doc_id", "text")).count() == len(texts)


def test_each_pair_is_met_at_its_first_shingle(spark):
    """Rows that share a run of shingles are met at the first, and each pair of rows is met, whatever the places."""
    from gridwright.llm import similar
    from gridwright.llm.common import cut

    rows = [(n, k + 1, 100 + k) for n in (1, 2, 3) for k in range(5)] + [(4, 1, 104)]
    held = cut(spark.createDataFrame(rows, "node long, place long, h long"), "held")
    sizes = spark.createDataFrame([(n, 60) for n in (1, 2, 3, 4)], "node long, size long")
    roots = spark.createDataFrame([(9, 8)], "node long, root long")
    met = similar.apart_by_prefix(held, sizes, roots)
    assert sorted(sorted(r) for r in met.collect()) == [[a, b] for a in (1, 2, 3, 4) for b in range(a + 1, 5)]
