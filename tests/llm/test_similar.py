"""The pipeline's near-dedup against all pairs."""

import random


def test_near_stage_links_at_similarity(spark, tmp_path):
    import corpus_pipeline
    from gridwright.llm.simhash import drop_near_copies

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = [None, "", " \n", "one two", "One  two", "one two three"]
    for edits in [1, 2, 3, 4, 5, 6, 8] * 6 + [2] * 60:
        if edits != 2 or len(texts) < 80:
            base = [word() for _ in range(200)]
            texts.append(" ".join(base))
        copy = list(base)
        for _ in range(edits):
            copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    texts += texts[10:14]
    rows = [(i if i != 12 else None, t, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(5)

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    group = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (a == b or len(a & b) >= 0.8 * len(a | b)) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    want = {min((i for i, g in enumerate(group) if g == x), key=lambda i: (rows[i][0] is None, i)) for x in group}
    got = corpus_pipeline.near(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted(r.n_chars for r in got.collect()) == sorted(want)
    assert drop_near_copies(docs).count() > len(want)
    assert corpus_pipeline.near(spark, docs.where("false"), "").count() == 0


def chain(n: int, step: int, size: int, tag: str) -> list[str]:
    """Texts of `size` words, each `step` words on along one sequence: neighbours are similar, and those further apart are not."""
    return [" ".join(f"{tag}{i * step + k}" for k in range(size)) for i in range(n)]


def plain_groups(texts, least=0.8):
    from gridwright.llm.similar import shingles, similar

    sets = [shingles((t or "").encode()) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for h in s:
            where.setdefault(h, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for h in s for j in where[h] if j < i} if s else ():
            if find(i) != find(j) and similar(sets[i], sets[j], least):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return len({find(i) for i in range(len(texts))})


def test_exact_against_all_pairs(spark):
    """Chains whose every link counts, under keys that all share: a miss would leave a group in two."""
    from gridwright.llm.similar import drop_similar

    rng = random.Random(6)
    common = [f"c{i}" for i in range(120)]
    texts = chain(60, 4, 60, "a") + chain(40, 9, 60, "b") + chain(30, 14, 60, "d")
    for i in range(300):  # near copies of one text, of which many are similar and many just not
        words = common[:]
        for k in rng.sample(range(120), rng.randint(0, 5)):
            words[k] = f"x{i}-{k}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert drop_similar(docs, exact=True).count() == plain_groups(texts)


def test_a_group_of_ten_thousand(spark, monkeypatch):
    """Ten thousand rows of one key, and a span of some hundreds: rows that the spans leave apart are joined by their prefixes."""
    from gridwright.llm import similar

    monkeypatch.setattr(similar, "SPAN", 512)
    monkeypatch.setattr(similar, "NEXT", 1)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(10_000):
        words = base[:]
        for k in rng.sample(range(60), rng.choice([1, 1, 1, 2, 3])):
            words[k] = f"{rng.randrange(12)}-{k}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets = list({t: None for t in texts})
    assert similar.drop_similar(docs).count() == plain_groups(sets)
