"""Importance resampling against plain loops over whole texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from test_llm import SCHEMA, awkward

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, order=3):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)]


def plain(rows, target, buckets=10_000, share=5, least=20):
    count = lambda texts: Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in runs(t)[1])
    s, t = count(r[1] for r in rows), count(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for r in rows:
        n, found = runs(r[1])
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found)
        h = int(hashlib.sha256(f"42:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append([r[0], len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= least])
    best = sorted((x for x in out if x[5]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for i, x in enumerate(best[: len(best) * share // 100]):
        x[4] = i + 1
    return [tuple(x[:5]) for x in out]


def odd():
    rng = random.Random(8)
    words = ["a", "Bb", "ccc", "x" * 63, "y" * 64, "z" * 65, "é" * 40, "٣", "ſ", "K", "10"]
    texts = ["\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 4))) + rng.choice(["", ".", "!\t", "\x7f"]) for _ in range(rng.randint(1, 40))) for _ in range(40)]
    return [*texts, "one\ntwo\nthree\nfour", "one two\n\n \nthree", "\n", "a-b_c:d@e[f`g{h~i\x7fj", "l " * 30000, "same line here\n" * 50]


def rows_of():
    return awkward() + [(2000 + i, t, "en", "s", 0, None, None) for i, t in enumerate(odd())] + [(7, "tie " * 30, "en", "s", 0, None, None)] * 2


def test_against_plain_loops(spark):
    from gridwright.llm import resampling

    rows = rows_of()
    target = [t for t in odd()[:6]] + ["the cat and the house", None, ""]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    models = spark.createDataFrame([(t,) for t in target], "text string")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    for share in (5, 60):
        got = resampling.ranked(resampling.weighed(docs, models), share).selectExpr("c1 as doc_id", "n_features", "weight", "score", "rank")
        assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows, target, share=share), key=key)
    stay = resampling.drawn(docs, models, share=60).collect()
    want = Counter(r[0] for r in plain(rows, target, share=60) if r[4])
    assert Counter(r.doc_id for r in stay) == want and stay[0].asDict().keys() == set(docs.columns)
    assert {r.text for r in stay} <= {r[1] for r in rows}


def test_small_tables(spark):
    from gridwright.llm import resampling

    empty = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, None, None, None, 0, None, None), (None, "a b", None, None, 0, None, None)], SCHEMA)
    assert resampling.ranked(resampling.weighed(empty, one)).count() == 0
    got = resampling.ranked(resampling.weighed(one, empty)).collect()
    assert sorted((r.n_features, r["rank"]) for r in got) == [(0, None), (3, None)]


def test_runs_of_lines():
    """Runs within lines and across them are all runs of the text, each once."""
    import pyarrow as pa

    from gridwright.llm import resampling

    for order in (1, 2, 3, 4):
        for text in odd():
            lines = resampling.lines_of(text)
            across = [zlib.crc32(r) for r in resampling.runs_across(lines, order)]
            hashes, sizes = resampling.run_hashes(pa.array([b" ".join(x).decode() for x in lines], pa.string()), order)
            assert len(sizes) == len(lines) and sizes.sum() == len(hashes)
            assert Counter(across) + Counter(hashes.tolist()) == Counter(zlib.crc32(f.encode()) for f in runs(text, order)[1])
