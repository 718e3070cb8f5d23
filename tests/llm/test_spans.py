"""Substring dedup: what hashes may not decide, the methods themselves, and families that grow."""

import hashlib
import random
from collections import defaultdict

import numpy as np

SCHEMA = "doc_id long, text string"


def thue_morse(n: int) -> tuple[str, str]:
    word = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def bytes_left(rows, before=()):
    """Brute force over all windows of 50 bytes: (doc_id, n_bytes, n_removed, sha256); `before` are rows judged earlier."""
    first = {}
    rank = lambda d: (d is None, d or 0)
    for d, t in [*before, *rows]:
        raw = (t or "").encode()
        for k in range(len(raw) - 49):
            first[raw[k : k + 50]] = min(first.get(raw[k : k + 50], (True, 1 << 62)), rank(d))
    for d, t in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for k in range(len(raw) - 49):
            if first[raw[k : k + 50]] < rank(d):
                gone[k : k + 50] = [True] * 50
        yield str(d), len(raw), sum(gone), hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()


def words_left(rows, length=13):
    """What word_spans leaves, by all windows of all documents."""
    import re

    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    key = lambda d: (d is None, d or 0)
    first = {}
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - length + 1):
            x = tuple(w[i : i + length])
            first[x] = min(first.get(x, key(d)), key(d))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = {i + k for i in range(len(w) - length + 1) if first[tuple(w[i : i + length])] < key(d) for k in range(length)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(d), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def documents(seed: int, n: int, first_id: int = 0):
    rng = random.Random(seed)
    common = random.Random(1)
    passages = ["".join(common.choice("abcdefg ") for _ in range(200)) for _ in range(6)]
    own = lambda: "".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.randint(0, 300)))
    rows = [(first_id + i, own() + rng.choice(passages)[: rng.randint(40, 200)] + own() if i % 3 else own()) for i in range(n)]
    return rows + [(None, passages[0]), (first_id, passages[1]), (first_id, passages[1])]


def test_words_whose_hashes_collide_stay(spark):
    from gridwright.llm.word_spans import hash_words, word_spans

    x, y = thue_morse(1024)
    buffer = np.frombuffer(f"{x} {y} ".encode(), np.uint8)
    assert len(set(hash_words(buffer, np.array([0, 1025]), np.array([1024, 2049])).tolist())) == 1
    lead = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{lead} {x}"), (2, f"{lead} {y}"), (3, f"{lead} {x} end")]
    got = {r.doc_id: r.n_removed for r in word_spans(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


def test_segments_of_equal_hashes_are_compared_by_bytes(spark, monkeypatch):
    """With a hash that takes all runs for equal, the pack's own step still says nothing untrue."""
    from gridwright.llm import byte_spans, spans

    import pyarrow as pa

    f = byte_spans.finder()
    table = pa.table({"pack": [0] * 3, "doc_id": [1, 2, 3], "text": [b"a" * 25 + b"x" * 30, b"a" * 25 + b"y" * 30, b"a" * 25 + b"x" * 30]})
    _, ids, sizes, context = f._read(table)
    start, stop = np.array([0, 55, 110]), np.array([55, 110, 165])
    assert f._same(context, start, stop, np.array([0, 0, 0])).tolist() == [True, False, True]
    assert f._same(context, start, np.array([55, 109, 165]), np.array([0, 0, 0])).tolist() == [True, False, True]


def test_longest_earlier_match_against_all_pairs():
    from gridwright.llm.word_spans import longest_earlier

    rng = random.Random(4)
    for letters in ("ab", "abcdefgh", "a"):
        lengths = [rng.randint(1, 25) for _ in range(25)]
        doc = np.repeat(sorted(rng.randrange(9) for _ in lengths), lengths)
        end = np.repeat(np.cumsum(lengths), lengths)
        numbers = np.array([ord(rng.choice(letters)) for _ in doc])
        want = []
        for i in range(len(doc)):
            best = 0
            for j in np.flatnonzero(doc < doc[i]):
                k = 0
                while i + k < end[i] and j + k < end[j] and numbers[i + k] == numbers[j + k]:
                    k += 1
                best = max(best, k)
            want.append(best)
        assert longest_earlier(numbers, doc, end).tolist() == want


def test_family_scans_and_merges_levels():
    from gridwright.llm.byte_spans import Family, scan

    rng = random.Random(8)
    passage = bytes(rng.choice(b"abcdefgh") for _ in range(400))
    raw = [passage[a : a + rng.randint(60, 120)] if i % 2 else bytes(rng.choice(b"xyz") for _ in range(70)) for i, a in enumerate(rng.randrange(280) for _ in range(120))]
    ids = np.array([rng.randrange(60) for _ in raw], np.int64)
    family = Family()
    found = scan(ids, b"".join(raw), np.array([*map(len, raw)], np.int64), batch=256, family=family)
    assert family.merges >= 4 and family.scanned > family.merges and max(x.rank for x in family.levels) >= 3
    for level in family.levels:
        assert (level.keys[1:] > level.keys[:-1]).all()
    owners = defaultdict(lambda: 99)
    for d, r in zip(ids, raw, strict=True):
        for k in range(len(r) - 49):
            owners[r[k : k + 50]] = min(owners[r[k : k + 50]], d)
    got = {(s, f + k) for s, f, c in zip(*(x.tolist() for x in found), strict=True) for k in range(c)}
    assert got == {(i, k) for i, r in enumerate(raw) for k in range(len(r) - 49) if owners[r[k : k + 50]] < ids[i]}


def test_levels_are_scanned_on_whole_documents():
    """The windows of sf0.01's documents that may match, in batches of the production size: several levels are met."""
    import duckdb

    from gridwright.llm.byte_spans import BATCH, Family, scan

    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet' WHERE strlen(text) BETWEEN 50 AND 400 ORDER BY doc_id").fetchall()
    family = Family()
    raw = [t.encode() for _, t in rows]
    scan(np.array([d for d, _ in rows], np.int64), b"".join(raw), np.array([*map(len, raw)], np.int64), batch=BATCH // 8, family=family)
    assert family.scanned > 0 and family.merges > 0


def test_family_in_a_folder_grows(spark, tmp_path):
    from gridwright.llm.byte_spans import SuffixFamily

    family = SuffixFamily(spark, str(tmp_path / "family"), buckets=3)
    before, born = [], []
    for batch in range(4):
        rows = documents(batch, 12, 100 * (3 - batch) if batch == 2 else 100 * batch)
        got = family.add(spark.createDataFrame(rows, SCHEMA), batch)
        want = sorted(bytes_left(rows, before))
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256) for r in got.collect()) == want
        before += rows
        levels = family.levels(batch + 1).collect()
        born.append({(r.bucket, r.born, r["rank"]) for r in levels})
    assert any(r["rank"] >= 2 for r in levels)
    # of four batches with one level each, all have merged into fewer than four
    assert all(sum(r.bucket == b for r in levels) < 4 for b in range(3))
    assert family.add(spark.createDataFrame([], SCHEMA), 4).count() == 0
    # a batch added again gives the same
    again = family.add(spark.createDataFrame(rows, SCHEMA), 3)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256) for r in again.collect()) == want


def test_heavy_anchors_are_dealt_by_window(spark):
    from gridwright.llm.byte_spans import byte_spans
    from gridwright.llm.word_spans import word_spans

    rows = documents(5, 40)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = sorted(bytes_left(rows))
    for more in ({"heavy": 1}, {"heavy": 8}, {"pack_bytes": 500}):
        got = byte_spans(docs, **more)
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256) for r in got.collect()) == want
        plain, dealt = word_spans(docs).collect(), word_spans(docs, **more).collect()
        assert sorted(map(str, plain)) == sorted(map(str, dealt))


def test_spans_of_awkward_tables(spark):
    from gridwright.llm.byte_spans import byte_spans
    from gridwright.llm.word_spans import word_spans

    long = " ".join(f"word{i % 5000}" for i in range(40_000))
    rows = [(7, long), (8, long[10_000:200_000]), (8, long[10_000:200_000]), (None, long[:500]), (None, None), (9, "")]
    docs = spark.createDataFrame([(*r, "mine", "p", 3) for r in rows], SCHEMA + ", pack string, data string, bucket int")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in byte_spans(docs).collect())
    assert got == sorted([("7", len(long), 0), ("8", 190_000, 190_000), ("8", 190_000, 190_000), ("None", 500, 500), ("None", 0, 0), ("9", 0, 0)])
    got = {(str(r.doc_id), r.n_words): r.n_removed for r in word_spans(docs).collect()}
    assert got["7", 40_000] == 0 and all(n - 2 <= got[d, n] <= n for d, n in got if d in ("8", "None") and n)


def test_a_run_of_one_letter_is_sent_once():
    """Equal segments of a document go to a bucket once, however often they stand there."""
    import pyarrow as pa

    from gridwright.llm.byte_spans import finder
    from gridwright.llm.spans import unpressed

    at = finder()
    texts = [b"a" * 1000, b"a" * 200_000, b"ab" * 30_000]
    table = pa.table({"doc_id": pa.array([1, 2, 3], pa.int64()), "text": pa.array(texts, pa.binary())})
    sent = pa.Table.from_batches(at._send_segments(0, table, None, 1))
    assert 2 * sum(map(len, sent.column("data").to_pylist())) < sum(map(len, texts))
    bodies = [unpressed(d[4:]) for b, d in zip(sent.column("bucket").to_pylist(), sent.column("data").to_pylist(), strict=True) if b >= 0]
    assert sum(map(len, bodies)) < sum(map(len, texts))


def test_runs_of_equal_tokens(spark):
    """Documents that repeat themselves, alone and in one another, in one pack and in several."""
    from gridwright.llm.byte_spans import byte_spans
    from gridwright.llm.word_spans import word_spans

    texts = ["a" * 700, "a" * 300 + "b" * 120, "ab" * 200, "x" + "a" * 60 + "y" + "ab" * 60, "b" * 500, "b" * 49 + "a" * 49, "one two " * 90, "two one " * 40 + "one " * 40, "one " * 200]
    rows = [(i, t) for i, t in enumerate(texts)] + [(20 + i, t) for i, t in enumerate(texts[::-1])] + [(20, texts[2]), (None, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for more in ({}, {"heavy": 1}, {"pack_bytes": 300}):
        got = byte_spans(docs, **more)
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256) for r in got.collect()) == sorted(bytes_left(rows))
        found = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in word_spans(docs, **more).collect())
        assert found == sorted(words_left(rows))


def test_slices_of_any_length_choose_alike(monkeypatch):
    """Equal windows choose equal anchors where hashes tie in their upper bits, in slices of different lengths."""
    from gridwright.llm import spans
    from gridwright.llm.spans import Anchors

    rng = np.random.default_rng(4)
    whole = spans.rolled
    # hashes that agree in most of their bits, so that what is masked off decides
    monkeypatch.setattr(spans, "rolled", lambda tokens, n: whole(tokens, n) & np.uint64(0x3FFFF))
    passages = [rng.integers(0, 4, 50).astype(np.uint64) * np.uint64(7919) for _ in range(60)]
    short, long = passages[:30], [x for p in passages for x in (p, rng.integers(0, 4, 200).astype(np.uint64))]
    chosen = []
    for parts in (short, long):
        tokens, sizes = np.concatenate(parts), np.array([*map(len, parts)], np.int64)
        found = Anchors(lambda a, b, t=tokens: t[a:b], sizes, 50, 16, 1 << 14)
        starts = np.cumsum(sizes) - sizes
        chosen.append({int(s): int(h) for s, h in zip(found.start, found.hash, strict=True) if s in starts})
    for i in range(30):
        assert chosen[0][50 * i] == chosen[1][250 * i]
