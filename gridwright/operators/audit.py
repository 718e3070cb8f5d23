"""Relations between columns, found from values and not from names, and the rows that break them.

Candidates that the columns' bounds allow are counted by plain aggregates, dozens in one pass.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwright.functions import vocabulary as V
from gridwright.functions.cells import FOLD, close, short_hash
from gridwright.operators import scans
from gridwright.sources.scratch import written

#: Candidates that one pass over a table counts.
CANDIDATES = 60


def _flag(c: Column) -> Column:
    return F.sum(F.coalesce(c, F.lit(False)).cast("int"))


def _value(columns: list[str], name: Column) -> Column:
    """The value of the column of a name."""
    found = F.lit(None).cast("double")
    for c in columns:
        found = F.when(name == c, F.col(c).cast("double")).otherwise(found)
    return found


def _counted(df: DataFrame, candidates: list[tuple[str, str, str]], v: dict[str, Column]) -> DataFrame:
    """i, n_checked, n_matched, n_real of each candidate: plain counts, as many in one pass as CANDIDATES, so that a row makes no row."""
    out = None
    for at in range(0, len(candidates), CANDIDATES):
        part = candidates[at : at + CANDIDATES]
        counts = []
        for i, (t, a, b) in enumerate(part):
            hit = close(v[a] * v[b], v[t])
            counts += [F.count_if(v[t].isNotNull() & v[a].isNotNull() & v[b].isNotNull()).alias(f"s{i}"), F.count_if(hit).alias(f"h{i}"), F.count_if(hit & (v[t] != 0)).alias(f"r{i}")]
        each = F.array(*[F.struct(F.lit(at + i).alias("i"), F.col(f"s{i}").alias("n_checked"), F.col(f"h{i}").alias("n_matched"), F.col(f"r{i}").alias("n_real")) for i in range(len(part))])
        found = df.agg(*counts).select(F.explode(each).alias("x")).select("x.*")
        out = found if out is None else out.unionByName(found)
    return out


def products(df: DataFrame, columns: list[str]) -> DataFrame:
    """Relations target = a x b that hold in most rows: (target, a, b, n_checked, n_matched).

    Of more than PRODUCT_COLUMNS columns only the first so many are tried, as a report shows no
    more; `products_left_out` says which aren't. `df` is read twice at least, and once more for
    each CANDIDATES of candidates: it should be a table.
    """
    columns = columns[: V.PRODUCT_COLUMNS]
    v = {c: F.col(c).cast("double") for c in columns}
    plain = df.agg(*[F.struct(F.min(F.coalesce(v[c].isin(0.0, 1.0), F.lit(True))).alias("plain"), F.min(F.abs(v[c])).alias("low"), F.max(F.abs(v[c])).alias("high")).alias(c) for c in columns]).first()
    usable = [c for c in columns if plain[c]["plain"] is False]

    def possible(t: str, a: str, b: str) -> bool:
        """Whether any value of t can be a product of values of a and b, by their bounds."""
        low, high = plain[a]["low"] * plain[b]["low"], plain[a]["high"] * plain[b]["high"]
        slack = 1 + 2 * V.TOLERANCE
        return low <= plain[t]["high"] * slack + V.TOLERANCE and plain[t]["low"] <= high * slack + V.TOLERANCE

    candidates = [(t, a, b) for t in columns if plain[t]["low"] is not None for a, b in combinations(usable, 2) if t not in (a, b) and possible(t, a, b)]
    schema = "target string, a string, b string, n_checked long, n_matched long"
    if not candidates:
        return df.sparkSession.createDataFrame([], schema)

    if len(candidates) > CANDIDATES:
        # a third of the rows ends those that they contradict in more rows than a relation may miss of all
        n, third = df.count(), df.where(F.pmod(F.xxhash64(*columns), F.lit(3)) == 0)
        missed = {r["i"] for r in _counted(third, candidates, v).where(F.col("n_checked") - F.col("n_matched") > (1 - V.SUPPORT_SHARE) * n).select("i").collect()}
        candidates = [c for i, c in enumerate(candidates) if i not in missed]
        if not candidates:
            return df.sparkSession.createDataFrame([], schema)
    counts = _counted(df, candidates, v)
    names = F.array(*[F.struct(F.lit(t).alias("target"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(columns.index(t)).alias("t"), F.array_sort(F.array(*map(F.lit, (t, a, b)))).alias("set")) for t, a, b in candidates])
    held = counts.where((F.col("n_checked") >= V.SUPPORT_ROWS) & (F.col("n_matched") >= F.greatest(F.lit(V.PRODUCT_HITS), V.SUPPORT_SHARE * F.col("n_checked"))) & (F.col("n_real") >= V.PRODUCT_HITS))
    named = held.withColumn("c", F.get(names, F.col("i")))
    best = named.withColumn("k", F.row_number().over(W.partitionBy("c.target").orderBy(F.desc("n_matched"), "i"))).where("k = 1")
    one = best.withColumn("k", F.row_number().over(W.partitionBy("c.set").orderBy(F.desc("n_matched"), "c.t"))).where("k = 1")
    return one.select("c.target", "c.a", "c.b", F.col("n_checked").cast("long").alias("n_checked"), F.col("n_matched").cast("long").alias("n_matched"))


def products_left_out(columns: list[str]) -> list[str]:
    """The columns that `products` doesn't try."""
    return columns[V.PRODUCT_COLUMNS :]


def product_mismatches(df: DataFrame, key: str, columns: list[str], relations: DataFrame) -> DataFrame:
    """The rows that break a relation, by the size of the difference. Relations are as few as columns at most."""
    joined = df.join(F.broadcast(relations.select("target", "a", "b")))
    valued = joined.select(F.col(key).alias("row_key"), "target", "a", "b", (_value(columns, F.col("a")) * _value(columns, F.col("b"))).alias("expected"), _value(columns, F.col("target")).alias("actual"))
    return valued.where(~close(F.col("expected"), F.col("actual"))).withColumn("delta", F.col("actual") - F.col("expected"))


def runs(columns: list[str], numeric: list[bool], least: int = V.SUPPORT_ROWS) -> list[list[str]]:
    """Neighbouring numeric columns, three at least."""
    found: list[list[str]] = [[]]
    for c, n in zip(columns, numeric, strict=True):
        if n:
            found[-1].append(c)
        elif found[-1]:
            found.append([])
    return [r for r in found if len(r) >= least]


def row_sums(df: DataFrame, columns: list[str], numeric: list[bool], totals: Column | None = None) -> DataFrame:
    """Relations target = sum of a run of columns: (target, parts, n_checked, n_matched). Blank parts count as 0."""
    totals = F.lit(False) if totals is None else totals
    is_number = [c for c, n in zip(columns, numeric, strict=True) if n]
    candidates = []
    for run in runs(columns, numeric):
        candidates += [(t, run) for t in is_number if t not in run]
        if len(run) >= 4:
            candidates += [(run[0], run[1:]), (run[-1], run[:-1])]
    schema = "target string, parts string, n_checked long, n_matched long"
    if not candidates:
        return df.sparkSession.createDataFrame([], schema)
    counts = None
    for at in range(0, len(candidates), CANDIDATES):
        aggregates, structs = [], []
        for i, (t, parts) in enumerate(candidates[at : at + CANDIDATES]):
            total = sum((F.coalesce(F.col(p).cast("double"), F.lit(0.0)) for p in parts), F.lit(0.0))
            target = F.col(t).cast("double")
            support = target.isNotNull() & ~totals & F.coalesce(*[F.col(p).cast("double") for p in parts]).isNotNull()
            hit = support & close(total, target)
            aggregates += [F.count_if(support).alias(f"s{i}"), F.count_if(hit).alias(f"h{i}"), F.count_if(hit & (target != 0)).alias(f"r{i}")]
            structs.append(F.struct(F.lit(t).alias("target"), F.lit("+".join(parts)).alias("parts"), F.col(f"s{i}").alias("n_checked"), F.col(f"h{i}").alias("n_matched"), F.col(f"r{i}").alias("n_real")))
        found = df.agg(*aggregates).select(F.explode(F.array(*structs)).alias("x")).select("x.*")
        counts = found if counts is None else counts.unionByName(found)
    held = (F.col("n_checked") >= V.SUPPORT_ROWS) & (F.col("n_matched") >= F.greatest(F.lit(V.SUPPORT_ROWS), V.SUPPORT_SHARE * F.col("n_checked"))) & (F.col("n_real") >= V.SUPPORT_ROWS)
    return counts.where(held).select("target", "parts", F.col("n_checked").cast("long").alias("n_checked"), F.col("n_matched").cast("long").alias("n_matched"))


def row_sum_mismatches(df: DataFrame, key: str, target: str, parts: list[str]) -> DataFrame:
    total = sum((F.coalesce(F.col(p).cast("double"), F.lit(0.0)) for p in parts), F.lit(0.0))
    rows = df.select(F.col(key).alias("row_key"), F.round(total, 2).alias("expected"), F.col(target).cast("double").alias("actual"))
    return rows.where(~close(F.col("expected"), F.col("actual"))).withColumn("delta", F.round(F.col("actual") - F.col("expected"), 2))


def totals_rows(facts: DataFrame) -> DataFrame:
    """Rows that total the rows above them: (region, rec, base, column, expected, actual).

    `facts`: region, rec, column, num, label. A row is held against the sums of its section, which
    begins behind the last row of totals, and of all rows above but those of totals; so what is
    decided at a row changes what the next are held against. All rows are decided at once under a
    guess of which are totals, and decided again under the outcome until nothing changes: the first
    row that a round decides wrongly stands behind one that the round before did, so the outcome is
    that of a walk from the top. The guess is right where labels or sums say so, and then two rounds
    do. No task holds a region: all sums are `scans` over ranges of rows.

    Rows without a number aren't rows. Equal columns of one row are for the caller to name apart.
    """
    held = facts.where(F.col("num").isNotNull() & ~F.isnan(F.col("num").cast("double")))
    label = F.coalesce(F.max(F.coalesce(is_total_label(F.col("label")), F.lit(False))), F.lit(False))
    values = F.array_sort(F.collect_list(F.struct(F.col("column").alias("c"), F.col("num").cast("double").alias("v"))))
    rows = scans.ranged(held.groupBy("region", "rec").agg(label.alias("labelled"), values.alias("values")), ["region"], ["rec"], "totals-rows")
    table = written(scans.placed(rows, ["region"], ["rec"], "place"), "totals-places")
    totals = written(_likely_totals(table), "totals-guess")
    while True:
        decided = written(_decided(table, totals), "totals-decided")
        found = written(decided.where("base is not null").select("region", "rec").distinct(), "totals-found")
        if not totals.join(found, ["region", "rec"], "left_anti").head(1) and not found.join(totals, ["region", "rec"], "left_anti").head(1):
            return decided.where("base is not null").select("region", "rec", "base", "column", F.when(F.col("base") == "section", F.col("section_sum")).otherwise(F.col("grand_sum")).alias("expected"), F.col("v").alias("actual"))
        totals = found


def _cents(c: Column) -> Column:
    return c.cast("decimal(28,6)")


def _likely_totals(table: DataFrame) -> DataFrame:
    """(region, rec) of rows whose label says so, and of those whose values are what the rows since some earlier row add up to.

    With running sums over all rows, totals included, the latter is an equality of two of them: up to
    the earlier row, and up to this one less its value.
    """
    long = table.select("region", "rec", "place", scans.PART, F.explode("values").alias("x")).select("region", "rec", "place", scans.PART, F.col("x.c").alias("column"), F.col("x.v").alias("v"))
    upto = scans.running(long, ["region", "column"], ["rec"], _cents(F.col("v")), "before")
    cents = lambda c: F.round(c, 2).cast("decimal(28,2)")
    ends = upto.groupBy("region", "column", cents(F.col("before") + _cents(F.col("v"))).alias("at")).agg(F.min("place").alias("from"))
    asked = upto.withColumn("at", cents(F.col("before") - _cents(F.col("v")))).where("v <> 0")
    hits = asked.join(ends, ["region", "column", "at"], "left").where((F.col("from") < F.col("place") - 1) | (F.col("at") == 0) & (F.col("place") > 1))
    by_sum = hits.groupBy("region", "rec").agg(F.count(F.lit(1)).alias("n")).join(table.select("region", "rec", F.size("values").alias("size")), ["region", "rec"]).where((F.col("n") >= V.TOTAL_HITS) & (F.col("n") >= V.TOTAL_COVERAGE * F.col("size")))
    return table.where("labelled").select("region", "rec").unionByName(by_sum.select("region", "rec")).distinct()


def _decided(table: DataFrame, totals: DataFrame) -> DataFrame:
    """A row for each value, with the sums that it is held against if `totals` are the rows of totals, and the base of its row; null where that is none."""
    flagged = table.join(totals.withColumn("total", F.lit(True)), ["region", "rec"], "left").withColumn("total", F.coalesce("total", F.lit(False)))
    last = scans.carried(flagged, ["region"], ["rec"], F.when(F.col("total"), F.col("place")), "last", above=True).withColumn("last", F.coalesce("last", F.lit(-1)))
    counted = scans.running(last, ["region"], ["rec"], (~F.col("total")).cast("long"), "grand_rows").withColumn("section_rows", F.col("place") - F.col("last") - 1)
    # a row of totals ends its section, so its own values add to nothing that follows in it
    own = ["region", "rec", "total", "labelled", "last", "grand_rows", "section_rows", scans.PART]
    long = counted.select(*own, F.explode("values").alias("x")).select(*own, F.col("x.c").alias("column"), F.col("x.v").alias("v"))
    summed = scans.running(long, ["region", "column", "last"], ["rec"], _cents(F.col("v")), "section_sum")
    summed = scans.running(summed, ["region", "column"], ["rec"], _cents(F.when(~F.col("total"), F.col("v"))), "grand_sum")
    summed = summed.withColumns({c: F.col(c).cast("double") for c in ("section_sum", "grand_sum")})
    row = W.partitionBy("region", "rec")
    n = F.count(F.lit(1)).over(row)
    agree = {b: close(F.col(f"{b}_sum"), F.col("v")) for b in ("section", "grand")}
    matched = {b: F.count_if(hit).over(row) for b, hit in agree.items()}
    real = {b: F.count_if(hit & (F.col("v") != 0)).over(row) for b, hit in agree.items()}
    by_value = lambda b: (F.col(f"{b}_rows") >= 2) & (real[b] >= V.TOTAL_HITS) & (matched[b] >= V.TOTAL_COVERAGE * n)
    by_label = lambda b: F.col("labelled") & (F.col(f"{b}_rows") >= 1)
    base = (
        F.when(by_value("section"), "section").when(by_value("grand"), "grand")
        .when(by_label("section") & (matched["section"] >= matched["grand"]), "section").when(by_label("grand"), "grand")
    )
    return summed.select("region", "rec", "column", "v", "section_sum", "grand_sum", base.alias("base"))


def column_sum_check(totals: DataFrame) -> DataFrame:
    """A verdict for each row of totals: ok, mismatch, or unverified where too little of it agrees."""
    hit = close(F.col("expected"), F.col("actual"))
    counted = totals.groupBy("region", "rec").agg(F.count(F.lit(1)).alias("n_checked"), _flag(hit).alias("n_matched"), _flag(hit & (F.col("actual") != 0)).alias("n_real"), F.round(F.sum(F.when(~hit, F.abs(F.col("actual") - F.col("expected"))).otherwise(0.0)), 2).alias("delta_total"))
    doubt = (F.col("n_matched") < F.col("n_checked")) & ((F.col("n_matched") * 2 < F.col("n_checked")) | (F.col("n_real") == 0))
    return counted.select("region", "rec", "n_checked", "n_matched", F.when(doubt, "unverified").when(F.col("n_matched") == F.col("n_checked"), "ok").otherwise("mismatch").alias("status"), F.when(doubt, 0.0).otherwise(F.col("delta_total")).alias("delta_total"))


def findings(mismatches: DataFrame, relations: DataFrame) -> DataFrame:
    """A finding for each relation, with its largest mismatches. Both have `relation`."""
    order = W.partitionBy("relation").orderBy(F.desc(F.abs("delta")), "row_key")
    # the limit on the rank goes below the shuffle, so a task sends the largest of what it holds
    largest = mismatches.withColumn("k", F.row_number().over(order)).where(F.col("k") <= V.LISTED).groupBy("relation").agg(F.array_sort(F.collect_list("row_key")).alias("listed"))
    sums = mismatches.groupBy("relation").agg(F.count(F.lit(1)).alias("n_mismatched"), F.round(F.sum(F.abs(F.col("delta").cast("decimal(18,4)"))).cast("double"), 2).alias("delta_total"))
    bad = sums.join(largest, "relation")
    joined = relations.join(bad, "relation", "left").withColumns({"n_mismatched": F.coalesce("n_mismatched", F.lit(0)), "delta_total": F.coalesce("delta_total", F.lit(0.0))})
    return joined.withColumns({
        "status": F.when(F.col("n_mismatched") == 0, "ok").otherwise("mismatch"),
        "confidence": F.when(F.col("n_matched") >= V.FIX_SHARE * F.col("n_checked"), "high").otherwise("review"),
    })


def cross_examine(broken: DataFrame, confirmed: DataFrame) -> DataFrame:
    """`broken` (relation, column, row_key) with `suggest`: false where a row breaks twice or another relation confirms the cell."""
    twice = F.count(F.lit(1)).over(W.partitionBy("row_key"))
    ok = confirmed.select(F.col("relation").alias("other"), F.col("column").alias("c"), F.col("row_key").alias("r"))
    vetoed = broken.join(ok, (F.col("column") == F.col("c")) & (F.col("row_key") == F.col("r")) & (F.col("relation") != F.col("other")), "left_semi").select("relation", "column", "row_key").distinct().withColumn("vetoed", F.lit(True))
    return broken.withColumn("n_breaking", twice).join(vetoed, ["relation", "column", "row_key"], "left").withColumn("suggest", ~((F.col("n_breaking") >= 2) | F.coalesce("vetoed", F.lit(False)))).drop("vetoed")


def finding_ids(found: DataFrame, parts: list[str]) -> DataFrame:
    """Stable ids; equal ones get -2, -3, … in the order of all parts."""
    hashed = found.withColumn("base_id", short_hash(12, *[F.col(c).cast("string") for c in parts]))
    k = F.row_number().over(W.partitionBy("base_id").orderBy(*found.columns))
    return hashed.withColumn("k", k).withColumn("finding_id", F.when(F.col("k") == 1, F.col("base_id")).otherwise(F.concat_ws("-", "base_id", "k"))).drop("k", "base_id")


def is_total_label(label: Column) -> Column:
    return label.rlike(FOLD + V.TOTAL_LABEL)


def rollup(found: DataFrame, decisions: DataFrame) -> DataFrame:
    """Open and settled findings, and what is at stake in the open ones."""
    joined = found.join(decisions, "finding_id", "left").withColumn("decision", F.coalesce("decision", F.lit("open")))
    bad = F.col("status") == "mismatch"
    return joined.agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(~bad).alias("n_ok"), F.count_if(bad & (F.col("decision") == "open")).alias("n_open"),
        F.round(F.coalesce(F.sum(F.when(bad & (F.col("decision") == "open"), F.col("delta_total"))), F.lit(0.0)), 2).alias("at_stake"), F.max("decided_at").alias("last_decided"),
    )


def run_checks(df: DataFrame, key: str, columns: list[str], numeric: list[bool], totals: Column | None = None) -> DataFrame:
    """All relations of one table and what breaks them, those that don't hold first, by the size of what is wrong.

    (relation, rule, target, n_checked, n_matched, n_mismatched, delta_total, listed, status, confidence)
    """
    numbers = [c for c, n in zip(columns, numeric, strict=True) if n]
    data = df if totals is None else df.where(~totals)
    found = products(data, numbers)
    named = F.concat(F.col("target"), F.lit("="), F.col("a"), F.lit("*"), F.col("b"))
    broken = product_mismatches(data, key, numbers, found).select(named.alias("relation"), "row_key", "delta")
    relations = found.select(named.alias("relation"), F.lit("product").alias("rule"), "target", "n_checked", "n_matched")
    sums = row_sums(df, columns, numeric, totals)
    for r in sums.collect():  # as many as the columns of a table at most
        relation = f"{r.target}={r.parts}"
        bad = row_sum_mismatches(data, key, r.target, r.parts.split("+")).select(F.lit(relation).alias("relation"), "row_key", "delta")
        broken = broken.unionByName(bad)
    summed = F.concat(F.col("target"), F.lit("="), F.col("parts"))
    relations = relations.unionByName(sums.select(summed.alias("relation"), F.lit("row sum").alias("rule"), "target", "n_checked", "n_matched"))
    out = findings(broken.withColumn("delta", F.round("delta", 4)), relations)
    return out.orderBy((F.col("status") == "ok").cast("int"), F.desc("delta_total"), "relation")


def with_decisions(found: DataFrame, decisions: DataFrame) -> DataFrame:
    """Findings with their stable ids, the decision on each (open where there is none) and their bucket.

    `found`: sheet, panel, target, formula, status, delta_total. `decisions`: finding_id, decision.
    """
    keyed = found.withColumns({"__panel": F.coalesce(F.col("panel").cast("string"), F.lit("-"))})
    ids = finding_ids(keyed, ["sheet", "__panel", "target", "formula"]).drop("__panel")
    bucket = F.when(F.col("status").isin("mismatch", "ok"), F.col("status")).otherwise("unverified")
    return ids.join(decisions, "finding_id", "left").withColumns({"decision": F.coalesce("decision", F.lit("open")), "bucket": bucket})


def open_findings(decided: DataFrame) -> DataFrame:
    """How many findings still need an eye: those that don't hold, or are unverified, and aren't decided."""
    return decided.agg(F.count_if((F.col("bucket") != "ok") & (F.col("decision") == "open")).alias("n_open"))


def deliverable_status(decided: DataFrame) -> DataFrame:
    """None where nothing was checked, flagged where a decision says so, else reconciled."""
    n = F.count(F.lit(1))
    return decided.agg(F.when(n == 0, None).when(F.count_if(F.col("decision") == "flagged") > 0, "flagged").otherwise("reconciled").alias("status"))
