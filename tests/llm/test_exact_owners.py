"""The exact index on files: owners, pages, directories and lookups."""


def test_exact_index_has_a_directory_for_each_owner(spark):
    from gridwright.llm.exact_dedup import build_index, lookup

    docs = spark.createDataFrame([(i, f"text {i % 700}") for i in range(1000)], "doc_id long, text string")
    index = build_index(docs, capacity=4, owners=40)[1]
    pages = index.pages.collect()
    assert len({r.owner for r in pages}) == 40
    places = {}
    for r in pages:
        assert len(r.records) <= 4 and r.depth <= r.directory_depth
        for place in r.places:
            assert place & (1 << r.depth) - 1 == r.page
            assert places.setdefault((r.owner, place), r.page) == r.page
        for record in r.records:
            key = record.key & (1 << 64) - 1
            assert r.owner == (key >> 32) * 40 >> 32 and r.page == key & (1 << r.depth) - 1
    # the directory of an owner has a page for each place
    for owner in range(40):
        depth = {r.directory_depth for r in pages if r.owner == owner}
        assert len(depth) == 1 and {p for o, p in places if o == owner} == set(range(1 << depth.pop()))
    asked = spark.createDataFrame([(1, "te xt3"), (2, "text 700"), (3, "text 10"), (4, None), (3, "text 10")], "doc_id long, text string")
    got = sorted((r.doc_id, r.keep_id, r.group_size) for r in lookup(asked, index).collect())
    assert got == [(1, 3, 2), (2, None, None), (3, 10, 2), (3, 10, 2), (4, None, None)]


def test_keys_that_collide_are_told_apart_by_bytes(spark, monkeypatch):
    from gridwright.llm import exact_dedup

    batches = lambda rows: __import__("pyarrow").RecordBatch.from_pylist([dict(zip(("entry", "key", "text", "n", "chars", "least_id", "best_uid", "owner"), r, strict=True)) for r in rows])
    rows = [(1, 5, b"a", 1, 1, 1, 1, 0), (2, 5, b"b", 2, 1, 2, 2, 0), (3, 5, b"a ", 1, 2, 3, 3, 0), (4, -7, b"c", 1, 1, 4, 4, 0)]
    pages = [p for b in exact_dedup._owned(1)([batches(rows)]) for p in b.to_pylist()]
    found = {(r["key"], r["text"]): (r["keep_uid"], r["group_size"], r["entries"]) for p in pages for r in p["records"]}
    assert found == {(5, b"a"): (3, 2, [1, 3]), (5, b"b"): (2, 2, [2]), (-7, b"c"): (4, 1, [4])}
