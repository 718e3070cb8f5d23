"""Packed ids: single documents and ranges, tokenizers of other kinds, many rows of one doc_id."""

import numpy as np


def test_documents_and_ranges_are_read_alone(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    from gridwright.llm.token_output import END, read_documents, read_ids, read_range, write_ids

    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        tokenizer = Tokenizer.from_file(path)
        rows = [(i, f"Document  number {i}\n" + "some words, more words! " * (i % 7), "x") for i in range(300)] + [(None, "none", "x"), (5, "again and again", "y"), (42, None, "z")]
        out = str(tmp_path / name)
        write_ids(spark.createDataFrame(rows, "doc_id long, text string, data string").repartition(5), out, path, block_ids=200)
        ids = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, END]  # noqa: B023, E731
        want = {}
        for d, t, _ in rows:
            want.setdefault(d, []).append(ids(t))
        got = {}
        for r in read_documents(spark, out, [5, 42, 299, 1000, 5]).collect():
            got.setdefault(r.doc_id, []).append(r.ids)
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(want[k]) for k in (5, 42, 299)}
        assert read_documents(spark, out, []).count() == 0
        order = sorted(read_ids(spark, out).collect(), key=lambda r: r.start)
        total = order[-1].start + order[-1].n_tokens
        whole = [i for r in sorted(read_range(spark, out, 0, total).collect(), key=lambda r: r.start) for i in r.ids]
        assert len(whole) == total
        for r in order:
            assert whole[r.start : r.start + r.n_tokens] in want[r.doc_id]
        for a, b in ((0, 1), (63, 65), (500, 1500), (total - 3, total + 9), (7, 7)):
            part = [i for r in sorted(read_range(spark, out, a, b).collect(), key=lambda r: r.start) for i in r.ids]
            assert part == whole[a:b]


def test_rows_of_one_doc_id_use_several_files(spark, tmp_path):
    import public_tokenizers

    from gridwright.llm.token_output import BLOCKS, TOKENIZER, read_ids, write_ids

    docs = spark.range(2000).selectExpr("7L AS doc_id", "concat('text ', id) AS text")
    write_ids(docs, str(tmp_path / "one"), public_tokenizers.path(TOKENIZER), block_ids=100)
    assert spark.read.schema(BLOCKS).parquet(str(tmp_path / "one")).select("part").distinct().count() > 1
    rows = sorted(read_ids(spark, str(tmp_path / "one")).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()


def test_unpack_part():
    from gridwright.llm.token_output import pack, unpack_part

    ids = np.random.default_rng(1).integers(0, 5000, 700).astype(np.uint32)
    data = b"head" + pack(ids, 13)
    for a, b in ((0, 0), (0, 700), (1, 64), (64, 65), (130, 699), (700, 700)):
        assert (unpack_part(data, a, b, 13, 4) == ids[a:b]).all()


def test_long_units_walk_alone():
    import time

    from gridwright.llm.sentencepieces import Encoder, Pieces

    names = ["<unk>", *(f"<0x{b:02X}>" for b in range(256)), "▁", "a", "b", "ab", "▁ab", "abab", "é"]
    table = Pieces(names, [0.0] * 257 + [-5.0, -2.0, -2.0, -3.0, -4.5, -9.0, -1.0], ["unknown"] + ["byte"] * 256 + ["normal"] * 7)
    units = ["▁" + "ab" * 40 + "éü", "b" * 100, "▁abé" * 30]
    assert table.segment([u.encode() for u in units]) is not None
    for u in units:
        assert table._alone(u.encode()) == table._together([u.encode()])[0]
    began = time.time()
    Encoder(table).encode(["日" * 100_000])
    assert time.time() - began < 20
    try:
        Pieces([*names, "a\nb"], [0.0] * 257 + [-1.0] * 8, ["unknown"] + ["byte"] * 256 + ["normal"] * 8)
        raise AssertionError
    except ValueError:
        pass
