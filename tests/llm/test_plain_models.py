"""The classifier and the mixture against plain versions."""

import math
import random
from collections import defaultdict
from zlib import crc32


def test_classifier_against_a_plain_loop(spark):
    import zstandard
    from gridwright.llm.quality_classifier import LEVEL, PIECE, fit_on, score

    rng = random.Random(2)
    good, bad = [f"word{i}" for i in range(60)], ["BUY", "now", "click", "cheap", "$$$", "win"]
    text = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(good if i % 2 else bad, rng.randint(5, 400))) for i in range(300)] + [(5, "again"), (300, None), (301, ""), (302, text(good, 60_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(303)] + [(3, 1), (4, 1), (999, 0), (None, 1), (7, None)], "doc_id long, quality int")
    model = fit_on(docs, labels)
    assert model.weights
    sizes = [zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(d) if d else None) for d in (model.good, model.bad, b"")]
    want = []
    for d, t in rows:
        raw = (t or "").encode()
        if not raw:
            want.append((d, model.prior))
            continue
        g, b, a = (sum(len(c.compress(raw[k : k + PIECE])) for k in range(0, len(raw), PIECE)) for c in sizes)
        x, share = (b - g) / (b + g), a / len(raw)
        z = sum(w * v for w, v in zip(model.weights, [1, 10 * x, 4 * share, 10 * x * share, 16 * min(share, 1) ** 2], strict=True))
        want.append((d, 1 / (1 + math.exp(-max(-30, min(30, z))))))
    got = [tuple(r) for r in score(docs, model).collect()]
    assert sorted((d, round(s, 9)) for d, s in got) == sorted((d, round(s, 9)) for d, s in want)
    # what taught: labels of one kind, not held out, and of these the share of good ones
    taught = [(d, d % 2) for d in {d for d, _ in rows} if crc32(str(d).encode()) % 5 and d not in (4,)]
    assert abs(model.prior - sum(q for _, q in taught) / len(taught)) < 1e-12
    # what is held out or has no label of its own does not matter
    other = labels.where("crc32(cast(doc_id as string)) % 5 <> 0 and doc_id <> 4")
    assert fit_on(docs, other) == model
    bounded = fit_on(docs, labels, most=20)
    assert bounded != model and bounded.weights


def test_separable_labels_fit():
    from gridwright.llm.quality_classifier import _logistic

    w = _logistic([[1.0, float(x)] for x in range(-50, 50)], [int(x > 3) for x in range(-50, 50)])
    assert all(math.isfinite(v) for v in w) and w[1] > 0
    assert all((w[0] + w[1] * x > 0) == (x > 3) for x in range(-50, 50))


def test_chosen_rows_are_the_plain_prefix(spark):
    from pyspark.sql import functions as F

    from gridwright.llm.common import cut
    from gridwright.llm.mixing import SEED, budgets, leaves_of, mix
    from gridwright.llm.simhash import with_uid

    rng = random.Random(6)
    rows = [(i if i % 50 else None, " ".join(["w"] * rng.choice([0, 1, 3, 40, 400])), rng.choice(["en", "fr"]), rng.choice(["web1", "web2", "src1"])) for i in range(600)]
    rows += rows[100:110]
    docs = cut(with_uid(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)), "mix-test")
    for total, epochs in ((20_000, 2), (3_000, 4), (50_000, 3)):
        leaf = {(r.domain, r.lang, r.source): (r.held, r.budget) for r in budgets(leaves_of(docs), total=total, epochs=epochs).collect()}
        hashed = leaves_of(docs)
        whole = {k: min(epochs, b // h) if h else epochs for k, (h, b) in leaf.items()}
        plan = spark.createDataFrame([(*k, w) for k, w in whole.items()], "domain string, lang string, source string, whole long")
        placed = hashed.join(plan, ["domain", "lang", "source"]).withColumn("hash", F.xxhash64(F.lit(SEED), F.col("whole"), F.col("doc_id"))).collect()
        want = {}
        groups = defaultdict(list)
        for r in placed:
            groups[r.domain, r.lang, r.source].append(r)
        for k, group in groups.items():
            left = leaf[k][1] - whole[k] * leaf[k][0]
            for r in sorted(group, key=lambda r: (r.hash % (1 << 64), r.doc_id is not None, r.doc_id or 0, r.uid)):
                left -= r.tokens
                want[r.uid] = min(epochs, whole[k] + (left >= 0))
        got = {r.uid: r.copies for r in mix(docs, total=total, epochs=epochs).collect()}
        assert got == {u: c for u, c in want.items() if c}


def test_the_sample_is_bounded_by_rows(spark, monkeypatch):
    """A labelled doc_id with 5,000 rows teaches by one of them, whatever their order."""
    from gridwright.llm import quality_classifier as q

    taken = []
    monkeypatch.setattr(q, "fit", lambda rows: taken.append(sorted(rows)))
    rows = [(1, f"text {i}") for i in range(5000)] + [(2, "other"), (2, "other"), (3, None)]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    for n in (2, 7):
        q.fit_on(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), labels, most=2)
    assert taken[0] == taken[1] and len(taken[0]) <= 3 and len({d for d, _, _ in taken[0]}) == len(taken[0])
