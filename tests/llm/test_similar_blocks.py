"""The near stage finds its candidates by blocks of SimHash fingerprints, and what they leave apart by an exact check."""

import random


def simhash(hashes):
    """A plain fingerprint of 512 bits: eight words, each the majority of its own mix of the hashes."""
    from gridwright.llm.similar import WORDS, _odd

    odd, m = [int(x) for x in _odd(2 * WORDS)], (1 << 64) - 1
    words = []
    for w in range(WORDS):
        mixed = []
        for h in hashes:
            x = h
            if w:
                x = (x ^ (x >> 32)) * odd[w] & m
                x = (x ^ (x >> 29)) * odd[WORDS + w] & m
                x ^= x >> 32
            mixed.append(x)
        words.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in mixed) > len(mixed)))
    return words


def edited(rng, base, edits):
    words = base[:]
    for k in rng.sample(range(len(words)), edits):
        words[k] = f"x{rng.random()}"
    return words


def test_candidates_are_pairs_that_share_a_block(spark):
    import xxhash

    from gridwright.llm import similar
    from gridwright.llm.common import cut

    rng = random.Random(2)
    texts = [""]
    for i in range(30):
        base = [f"w{i}-{k}" for k in range(rng.choice([3, 40, 300]))]
        texts += [" ".join(base), " ".join(edited(rng, base, len(base) // 40)), " ".join(edited(rng, base, len(base) // 10))]
    want, rows = {}, []
    for i, t in enumerate(texts):
        fp = simhash([xxhash.xxh64_intdigest(s, 42) for s in similar.shingles(t.encode())])
        blocks = [b << 16 | (fp[b // 4] >> 16 * (b % 4)) & 0xFFFF for b in range(32)] if t else []
        rows.append((i, fp, blocks))
        for j, old, theirs in rows[:i]:
            apart = sum((x ^ y).bit_count() for x, y in zip(fp[:2], old[:2], strict=True))
            if apart <= similar.RADIUS and set(blocks) & set(theirs):
                want[j, i] = apart
    docs = cut(spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "uid long, doc_id long, text string").repartition(3), "rows")
    last, places, _ = similar.frequent(docs, len(texts), 5)
    schema = "uid long, doc_id long, set binary, size long, fp0 long, fp1 long, keys array<bigint>, prefix array<bigint>"
    sketched = docs.mapInArrow(similar._sketches(5, 0.8, last, places), schema)
    assert {r.uid: list(r["keys"]) for r in sketched.collect()} == {i: b for i, _, b in rows}
    found = similar.candidates(cut(sketched.withColumnRenamed("uid", "node"), "nodes"))
    assert {(r.a, r.b): r.apart for r in found.collect()} == want and len(want) > 30


def test_blocks_and_what_they_leave_apart(spark):
    """Pairs just at 0.8, of which the blocks miss some: the stage links all of them, and none below."""
    import corpus_pipeline
    from gridwright.llm.similar import drop_similar, shingles, similar

    rng = random.Random(4)
    texts, alike = [], 0
    for i in range(400):
        base = [f"w{i}-{k}" for k in range(100)]
        # an edit within the text changes five shingles of 96: two give 0.81, three 0.73
        near = base[:]
        for k in rng.choice([(20, 60), (20, 60), (20, 60), (10, 40, 70)]):
            near[k] = f"x{i}-{k}"
        texts += [" ".join(base), " ".join(near)]
        alike += similar(shingles(texts[-1].encode()), shingles(texts[-2].encode()))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    by_blocks = len(texts) - drop_similar(docs, exact=False).count()
    assert 0.8 * alike <= by_blocks < alike
    assert len(texts) - corpus_pipeline.near(spark, docs, "").count() == alike


def test_order_of_prefixes_changes_no_result(spark, monkeypatch):
    from gridwright.llm import similar

    rng = random.Random(8)
    common = [f"c{i}" for i in range(60)]
    texts = [" ".join(common[:30] + [f"w{i}-{k}" for k in range(rng.randint(1, 60))]) for i in range(80)]
    for i in range(160):
        texts.append(" ".join(edited(rng, common, rng.randint(0, 4))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = sorted(r.doc_id for r in similar.drop_similar(docs).select("doc_id").collect())
    for most in (0, 7):
        monkeypatch.setattr(similar, "ORDER_MOST", most)
        assert sorted(r.doc_id for r in similar.drop_similar(docs).select("doc_id").collect()) == kept
    assert len(kept) < len(texts) - 50
