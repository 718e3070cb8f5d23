"""Page furniture in prose."""


def test_page_furniture_in_prose_stays_in_the_pipeline(spark):
    import corpus_pipeline

    prose = " ".join(f"word{i} plain{i}" for i in range(40))
    kept = [f"{prose} they design in teams.", f"{prose} the catalog in print.", f"{prose} and she ate one cookie.", f"{prose}\nThe catalog in print is long."]
    kept = [t.replace("\n", ".\n") for t in kept]
    furniture = ["Sign in here.", "Accept all cookies.", "function() { return; }", "Read more, click here, subscribe. " * 12]
    rows = [(i, t) for i, t in enumerate(kept)] + [(10 + i, f"{prose}.\n{f}\nSome other end.") for i, f in enumerate(furniture[:3])] + [(20, furniture[3])]
    got = {r.doc_id: r.text for r in corpus_pipeline.rules(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert got == {**dict(enumerate(kept)), **{10 + i: f"{prose}.\nSome other end." for i in range(3)}}
