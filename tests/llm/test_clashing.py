"""Users' columns keep their values, whatever they are called."""

from collections import Counter

NAMES = ["uid", "copies", "kept", "n_words", "n_lines", "ids", "fp", "root", "entry", "key", "rest", "c0", "r0", "cleaned", "id", "epoch", "block", "hash", "set", "node", "domain", "tokens", "pack", "__uid"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)


def table(spark):
    prose = lambda k: " ".join(f"w{k}x{i}" for i in range(70)) + "."
    rows = [(i, prose(i % 9), "en", f"src{i % 2}", 1) for i in range(20)] + [(None, prose(0), None, None, 2), (3, None, "en", "src0", 0), (4, "", "en", "src1", 0)]
    return spark.createDataFrame([(*r, *(f"{n} of {k}" for n in NAMES)) for k, r in enumerate(rows)], SCHEMA).repartition(4)


def values(df):
    return Counter(tuple(r[n] for n in NAMES) for r in df.collect())


def test_operators_carry_users_columns(spark):
    from gridwright.llm.exact_dedup import drop_copies
    from gridwright.llm.mixing import mixed_documents
    from gridwright.llm.simhash import drop_near_copies
    from gridwright.llm.similar import drop_similar

    docs = table(spark)
    known = values(docs)
    for drop in (drop_copies, drop_near_copies, drop_similar):
        out = drop(docs)
        assert out.columns == docs.columns
        assert values(out) <= known and out.count() == 10, drop
    out = mixed_documents(docs, total=10**9, epochs=3)
    assert out.columns == docs.columns and values(out) == Counter({k: 3 for k in known})


def test_pipeline_stages_carry_users_columns(spark, tmp_path):
    import corpus_pipeline

    docs = table(spark)
    known = values(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.schema == docs.schema, name
        assert set(values(out)) <= set(known) and out.count(), name
        assert stage(spark, docs.where("false"), "").count() == 0
    kept = corpus_pipeline.rules(spark, docs, "")
    assert kept.count() == 21 and all(r.n_chars == len(r.text) for r in kept.collect())
    coded = corpus_pipeline.encode(spark, docs, "")
    assert {"ids", "n_tokens", "decoded_same", *NAMES} <= set(coded.columns) and coded.schema["ids"].dataType.simpleString() == "array<int>"
    assert corpus_pipeline.encode(spark, docs.where("false"), "").count() == 0


def test_tables_without_other_columns(spark):
    from gridwright.llm.exact_dedup import drop_copies
    from gridwright.llm.simhash import drop_near_copies

    docs = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, None)], "doc_id long, text string")
    assert drop_copies(docs).count() == 2 and drop_near_copies(docs).count() == 3


def test_shared_folder(spark):
    from gridwright.llm.common import clean_up, cut, run_dir

    import os

    cut(spark.range(3), "some")
    folder = run_dir(spark)
    assert os.path.isdir(folder)
    clean_up(spark)
    assert not os.path.exists(folder)
    clean_up(spark)


def test_hot_keys_join_where_they_are(spark):
    from gridwright.llm.common import cut, hot_keys, join_to_one

    rows = cut(spark.range(4000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 WHEN id = 1 THEN NULL ELSE id END AS k"), "rows")
    one = spark.range(0, 4000).selectExpr("id AS k", "id * 2 AS twice")
    assert hot_keys(rows, "k") == [7]
    got = join_to_one(rows, one, "k")
    assert got.columns == ["k", "id", "twice"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(one, "k").collect()))


def test_added_columns_leave_users_columns_alone(spark):
    """Names that operators use for themselves on their way."""
    from gridwright.llm.license_scan import scanned
    from gridwright.llm.quality_rules import quality_rules
    from gridwright.llm.resampling import drawn

    inner = ["__t", "__w", "__n", "__k", "x", "w", "i", "at", "h", "c0", "rest", "part", "line", "uid", "weight", "score_", "template", "a.b"]
    text = " ".join(f"w{i}" for i in range(60)) + "."
    docs = spark.createDataFrame([(i, text, *(f"{n} of {i}" for n in inner)) for i in range(4)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in inner))
    for out in (quality_rules(docs), scanned(docs), drawn(docs, docs.select("text"), share=100)):
        rows = out.collect()
        assert len(rows) == 4 and all(r[n] == f"{n} of {r.doc_id}" for r in rows for n in inner) and all(r.text == text for r in rows)
