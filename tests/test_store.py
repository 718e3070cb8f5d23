"""Versions: a batch is stored whole or not at all."""

import pytest
from pyspark.sql import functions as F

from gridwright.sources.store import Conflict, Store


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    frame = lambda rows: spark.createDataFrame(rows, "id string, n int")
    assert store.version() == 0
    with pytest.raises(KeyError):
        store.latest("a", ["id"])
    assert store.write({"a": frame([("x", 1), ("y", 1)]), "b": frame([("x", 7)])}) == 1
    # a writer that fails on its way leaves the version before it, in both tables
    bad = frame([("x", 2), ("z", 2)]).withColumn("n", F.when(F.col("id") == "z", F.raise_error(F.lit("no"))).otherwise(F.col("n")).cast("int"))
    with pytest.raises(Exception, match="no"):
        store.write({"b": frame([("x", 8)]), "a": bad})
    assert store.version() == 1 and values(store.latest("b", ["id"]), "id", "n") == [("x", 7)]
    assert store.upsert("a", ["id"], frame([("x", 3)])) == 2
    assert store.delete("a", ["id"], frame([("y", 0)])) == 3
    assert values(store.latest("a", ["id"]), "id", "n") == [("x", 3)]
    assert values(store.latest("a", ["id"], 2), "id", "n") == [("x", 3), ("y", 1)]
    assert values(store.latest("a", ["id"], 1), "id", "n") == [("x", 1), ("y", 1)]
    # two writers of one version: the file is there, so the later one takes the next
    with pytest.raises(Conflict):
        store._commit(3, {})
    (tmp_path / "store/commits/000000000004.json").write_text('{"txn": "half')
    assert store.version() == 3
    (tmp_path / "store/commits/000000000004.json").unlink()
    (tmp_path / "store/commits/.000000000004.json.crc").unlink(missing_ok=True)
    assert store.compacted("a", ["id"]) == 4
    store.upsert("a", ["id"], frame([("w", 5)]))
    assert values(store.latest("a", ["id"]), "id", "n") == [("w", 5), ("x", 3)]
    assert store.history("a").count() == 2 and values(store.latest("a", ["id"], 2), "id", "n") == [("x", 3), ("y", 1)]


def test_decisions_and_cascade(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    findings = spark.createDataFrame([("f1",), ("f2",)], "finding_id string")
    decisions = lambda *ids: spark.createDataFrame([(i, "flagged") for i in ids], "finding_id string, decision string")
    with pytest.raises(ValueError, match="f9"):
        store.decide(decisions("f1", "f9"), findings)
    assert store.version() == 0
    store.decide(decisions("f1", "f2"), findings)
    assert store.latest("decisions", ["finding_id"]).count() == 2
    assert values(Store.surviving(store.latest("decisions", ["finding_id"]), findings.where("finding_id = 'f2'")), "finding_id") == [("f2",)]
    analyses = spark.createDataFrame([("a", 5), ("b", 6)], "analysis_id string, uploaded_at int")
    store.write({"analyses": analyses, "published": analyses})
    store.cascade(analyses.where("analysis_id = 'a'"), ["published"])
    for table in ("analyses", "published"):
        assert values(store.latest(table, ["analysis_id"]), "analysis_id") == [("b",)]


def test_listing_and_counts(spark):
    analyses = spark.createDataFrame([("a", 5, 9), ("b", 6, None), ("c", 6, 2)], "analysis_id string, uploaded_at int, last_decided_at int")
    published = spark.createDataFrame([("a", 7, 1), ("c", 3, 2)], "analysis_id string, published_at int, version int")
    got = [(r.analysis_id, r.stale, r.version) for r in Store.listing(analyses, published).collect()]
    assert got == [("b", False, None), ("c", False, 2), ("a", True, 1)]
    ids = lambda *c: spark.createDataFrame([(x,) for x in c], "client_id string")
    counts = Store.client_counts(ids("p", "q"), ids("p", "p"), ids("q"))
    assert values(counts, "client_id", "n_users", "n_deliverables") == [("p", 2, 0), ("q", 0, 1)]
