"""Rules over cash journals: (j, seq, d, code, label, inC, outC, bal, inU, outU).

Where there is a `path`, it names the workbook, and every rule holds within one: rows, glossaries
and months of different books never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwright.functions import vocabulary as V
from gridwright.functions.cells import FOLD, short_hash
from gridwright.operators import scans
from gridwright.sources.scratch import written

AMOUNTS = ["inC", "outC", "inU", "outU"]


def book(*frames: DataFrame) -> list[str]:
    """The column that names the workbook, where all frames have it."""
    return ["path"] if all("path" in f.columns for f in frames) else []


def zero_rows(rows: DataFrame) -> DataFrame:
    return rows.where(" and ".join(f"coalesce({a}, 0) = 0" for a in AMOUNTS))


def transfers_as_spend(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("code").isin(V.NEUTRAL_CODES) & (F.coalesce("outU", F.lit(0.0)) > 0))


def unknown_codes(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Codes that the glossary doesn't have, whatever their case: (code, n, out_usd)."""
    own = book(rows, codes)
    known = codes.select(*own, F.lower("code").alias("k")).distinct()
    lost = rows.where(F.col("code").isNotNull()).withColumn("k", F.lower("code")).join(known, [*own, "k"], "left_anti")
    return lost.groupBy(*own, F.col("k").alias("code")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("outU").cast("decimal(18,2)")).cast("double").alias("out_usd"))


def _with_previous(rows: DataFrame, columns: list[str]) -> DataFrame:
    """`rows` with `previous`, a struct of the columns of the row before it in its journal, which may be a third of all rows."""
    by = [*book(rows), "j"]
    return scans.previous(scans.ranged(rows, by, ["seq"], "journal-ranges"), by, ["seq"], F.struct(*columns), "previous").drop(scans.PART)


def out_of_order(rows: DataFrame) -> DataFrame:
    found = _with_previous(rows, ["d"]).where(F.col("d") < F.col("previous.d"))
    return found.withColumn("previous", F.col("previous.d"))


def balance_breaks(rows: DataFrame, into: str = "inC", out: str = "outC", balance: str = "bal", most: float = 1.0) -> DataFrame:
    """Rows whose balance isn't the one before plus what came in less what went out."""
    expected = F.col(f"previous.{balance}") + F.col(into) - F.col(out)
    found = _with_previous(rows, [balance]).withColumn("expected", expected).where(F.abs(F.col(balance) - F.col("expected")) > most)
    return found.withColumn("expected", F.round("expected", 2)).drop("previous")


def duplicates(rows: DataFrame, *parts: Column) -> DataFrame:
    """All but the first of rows with the same content; rows of zeros don't count."""
    hashed = rows.where(~F.expr(" and ".join(f"coalesce({a}, 0) = 0" for a in AMOUNTS))).withColumn("row_hash", short_hash(16, *parts))
    return hashed.withColumn("k", F.row_number().over(W.partitionBy(*book(rows), "row_hash").orderBy("d", "j", "seq"))).where("k > 1").drop("k")


def glossary(cells: DataFrame) -> DataFrame:
    """(code, label, section, kind) from (row, label, code) of a sheet of each book: rows without a code head sections; a code's first row counts."""
    own = book(cells)
    head = F.when(F.col("code").isNull() | (F.trim("code") == ""), F.col("label"))
    rows = scans.carried(scans.ranged(cells, own, ["row"], "glossary"), own, ["row"], head, "section").where("trim(code) <> ''")
    kind = F.lit("other")
    for name, pattern in reversed(V.SECTIONS):
        kind = F.when(F.col("section").rlike(FOLD + pattern), name).otherwise(kind)
    first = rows.groupBy(*own, "code").agg(F.min_by(F.struct("label", "section"), "row").alias("x"))
    return first.select(*own, "code", "x.label", "x.section").withColumn("kind", kind)


def pivot_rate(cells: DataFrame) -> DataFrame:
    """The first number from 500 to 20 000 in the first six rows, row by row, of each book: (row, col, num)."""
    return cells.where("row < 6 and num between 500 and 20000").groupBy(*book(cells)).agg(F.min_by("num", F.struct("row", "col")).alias("rate"))


def code_months(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Spend of every code in every month, 0 where there is none, and of UNMAPPED for the codes that aren't known."""
    own = book(rows, codes)
    dated = rows.withColumn("month", F.date_format("d", "yyyy-MM"))
    named = dated.join(codes.select(*own, "code", F.lit(True).alias("known")).distinct(), [*own, "code"], "left").withColumn("code", F.when(F.col("known"), F.col("code")).otherwise(V.UNMAPPED))
    sums = named.groupBy(*own, "code", "month").agg(F.sum(F.col("outU").cast("decimal(18,2)")).cast("double").alias("out_usd"))
    # codes and months are a glossary's and a calendar's: a book's grid is as small
    known, months = codes.select(*own, "code").distinct(), dated.select(*own, "month").distinct()
    grid = known.join(months, own) if own else known.join(months)
    every = grid.join(sums, [*own, "code", "month"], "left").select(*own, "code", "month", F.coalesce("out_usd", F.lit(0.0)).alias("out_usd"))
    return every.unionByName(sums.where(F.col("code") == V.UNMAPPED).select(*own, "code", "month", "out_usd"))


def tie_out(rows: DataFrame, table: DataFrame, most: float = 1.0) -> DataFrame:
    """Whether the journal's spend is what the table of codes and months holds, by book."""
    own = book(rows, table)
    total = lambda df, c, name: df.groupBy(*own).agg(F.sum(F.col(c).cast("decimal(18,2)")).cast("double").alias(name))
    a, b = total(rows, "outU", "journal"), total(table, "out_usd", "aggregated")
    return (a.join(b, own) if own else a.join(b)).withColumn("ok", F.abs(F.col("journal") - F.col("aggregated")) <= most)


#: Rows of the site's journal that a month may have before it is cut into bands of so many: what one task holds in plain arrays.
BAND_ROWS = 8_000_000


def orphans(head: DataFrame, site: DataFrame, rate: float, band_rows: int = BAND_ROWS) -> DataFrame:
    """Rows of the head office's journal that no row of the site's matches, one to one within a month of a book.

    In order of date, journal and place each row takes the first free row that is near enough in
    either currency, so that which row is used up decides what the next can match. A month is
    walked in one task, where each row costs the logarithm of the number of amounts.

    A month of more than `band_rows` rows of the site is cut into bands of amounts, as only rows of
    near amounts compete: a band holds the site's rows that any of its own can match, and is walked
    by itself. A row of the site that stands in two bands may be taken in both; then the earlier of
    the two keeps it, all bands are told, and they are walked again, until nothing changes. The
    first row that is decided wrongly stands behind one that was so a round before, so the outcome
    is that of a walk of the whole. Rounds are many where amounts are dense (91 with six bands of a
    month of 540,000 rows), so bands are for what a task can't hold. Rows of one amount are never
    parted. Rows without a date match nothing.
    """
    own = book(head, site)
    keys = [*own, "month"]
    amount = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    shaped = lambda df, is_left, cdf: df.select(*own, F.date_format("d", "yyyy-MM").alias("month"), "d", "j", F.col("seq").cast("long").alias("seq"), F.lit(is_left).alias("is_left"), amount("outU").alias("usd"), cdf.alias("cdf"))
    both = shaped(head.where(F.coalesce("outU", F.lit(0.0)) > 0), True, F.lit(0.0)).unionByName(shaped(site.where("d is not null"), False, amount("outC")))
    parts = scans.ranged(both, keys, ["d", "j", "seq"], "orphans-rows")
    rows = scans.placed(parts, keys, ["d", "j", "seq"], "n").select(*keys, "is_left", "n", "usd", "cdf", *[F.when(F.col("is_left"), F.col(c)).alias(c) for c in ("j", "seq")])

    schema = ", ".join(f"{c} string" for c in keys) + ", band long, n long, taken long, j string, seq long, usd double"
    if parts.where("not is_left").groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > band_rows).head(1):
        walked = _walked_in_bands(written(rows, "orphans-placed"), keys, rate, band_rows, schema)
    else:
        whole = rows.withColumns({"band": F.lit(0).cast("long"), "is_shared": F.lit(False)})
        walk = _walker(keys, rate)
        walked = whole.groupBy(*keys).applyInArrow(lambda rows: walk(rows, None), schema)
    return walked.where("taken is null").select(*keys, "j", "seq", F.col("usd").alias("out_usd"))


def _walked_in_bands(placed: DataFrame, keys: list[str], rate: float, band_rows: int, schema: str) -> DataFrame:
    """Rows without a match, and the matches of rows that several bands have, after as many rounds as it takes."""
    reach = max(V.MATCH_USD, V.MATCH_CDF / rate)
    left, right = placed.where("is_left"), placed.where("not is_left")
    # cells of amounts as wide as what may match, numbered into bands by running counts
    cell = lambda c: F.floor(c / F.lit(2 * reach))
    sums = placed.groupBy(*keys, cell(F.col("usd")).alias("cell")).agg(F.count_if(~F.col("is_left")).alias("rows"))
    before = scans.running(scans.ranged(sums, keys, ["cell"], "orphans-cells"), keys, ["cell"], F.col("rows"), "before")
    bands = written(before.select(*keys, "cell", F.floor(F.col("before") / band_rows).alias("band")), "orphans-bands")
    # a month that isn't known has no band, and nothing that matches
    banded = left.withColumn("cell", cell(F.col("usd"))).join(bands, [*keys, "cell"], "left").withColumns({"band": F.coalesce("band", F.lit(0).cast("long")), "is_shared": F.lit(False)}).drop("cell")
    # a row of the site goes to the bands of all cells that its amounts reach
    reached = F.array_distinct(F.flatten(F.array(*[F.array(*[cell(x + d * F.lit(reach)) for d in (-1, 0, 1)]) for x in (F.col("usd"), F.col("cdf") / rate)])))
    met = right.withColumn("cell", F.explode(reached)).join(bands, [*keys, "cell"]).groupBy(*keys, "n").agg(F.collect_set("band").alias("bands"), *[F.first(c).alias(c) for c in ("is_left", "usd", "cdf", "j", "seq")])
    dealt = met.withColumn("is_shared", F.size("bands") > 1).withColumn("band", F.explode("bands")).drop("bands")
    rows = written(banded.unionByName(dealt), "orphans-bands-rows")
    shared = rows.where("is_shared").select(*keys, "band", F.col("n").alias("taken"))

    claims = written(placed.sparkSession.createDataFrame([], schema), "orphans-claims")
    while True:
        # what a row of the site is to its bands: who else takes it first
        told = claims.select(*keys, F.col("band").alias("of"), "taken", F.col("n").alias("by"))
        outside = shared.join(told, [*keys, "taken"]).where("band <> of").groupBy(*keys, "band", "taken").agg(F.min("by").alias("by"))
        outside = outside.select(*[F.col(c).alias(f"of_{c}") for c in (*keys, "band")], "taken", "by")
        walked = written(rows.groupBy(*keys, "band").cogroup(outside.groupBy(*[f"of_{c}" for c in (*keys, "band")])).applyInArrow(_walker(keys, rate), schema), "orphans-walked")
        now = walked.where("taken is not null")
        if not now.exceptAll(claims).head(1) and not claims.exceptAll(now).head(1):
            return walked
        claims = now


def _walker(keys: list[str], rate: float):
    """The walk of a band: its rows without a match, and its matches with rows that other bands have too."""
    import numpy as np
    import pyarrow as pa

    class Free:
        """Free rows by one amount: a queue for each different one, and a tree of the queues' first rows."""

        def __init__(self, amounts: np.ndarray, gone: bytearray):
            self.different, of = np.unique(amounts, return_inverse=True)
            queued = np.argsort(of, kind="stable")
            starts = np.searchsorted(of[queued], np.arange(len(self.different) + 1))
            self.none, self.gone = len(amounts), gone
            self.leaves = 1 << (len(self.different) - 1).bit_length()
            tree = np.full(2 * self.leaves, self.none, np.int64)
            tree[self.leaves : self.leaves + len(self.different)] = queued[starts[:-1]]
            at = self.leaves
            while at > 1:
                tree[at // 2 : at] = tree[at : 2 * at].reshape(-1, 2).min(axis=1)
                at //= 2
            # plain arrays: an item of theirs costs less than numpy's
            self.tree, self.queued, self.next, self.ends, self.of = (memoryview(np.ascontiguousarray(x, np.int64)) for x in (tree, queued, starts[:-1], starts[1:], of))

        def bounds(self, wanted: np.ndarray, most: float) -> tuple[list[int], list[int]]:
            """The leaves with abs(amount - wanted) < most, as that is computed, from and to."""
            held = np.concatenate([[np.nan], self.different, [np.nan]])
            near = lambda i: np.abs(held[i + 1] - wanted) < most
            low, high = np.searchsorted(self.different, wanted - most), np.searchsorted(self.different, wanted + most, side="right")
            with np.errstate(invalid="ignore"):
                while (k := near(low - 1)).any():
                    low = low - k
                while (k := (low < high) & ~near(low)).any():
                    low = low + k
                while (k := near(high)).any():
                    high = high + k
                while (k := (low < high) & ~near(high - 1)).any():
                    high = high - k
            return (low + self.leaves).tolist(), (high + self.leaves).tolist()

        def first(self, low: int, high: int) -> int:
            tree, found = self.tree, self.none
            while low < high:
                if low & 1:
                    found = min(found, tree[low])
                    low += 1
                if high & 1:
                    high -= 1
                    found = min(found, tree[high])
                low >>= 1
                high >>= 1
            return found

        def drop(self, row: int) -> None:
            """Make the next free row of its amount the first, where `row` is that."""
            tree, leaf = self.tree, self.of[row]
            at = leaf + self.leaves
            if tree[at] != row:
                return
            k, end = self.next[leaf], self.ends[leaf]
            while k < end and self.gone[self.queued[k]]:
                k += 1
            self.next[leaf] = k
            tree[at] = self.queued[k] if k < end else self.none
            at >>= 1
            while at:
                least = min(tree[2 * at], tree[2 * at + 1])
                if tree[at] == least:
                    return
                tree[at] = least
                at >>= 1

    def walk(rows: pa.Table, outside: pa.Table | None) -> pa.Table:
        column = lambda t, c: t.column(c).to_numpy()
        is_left, n = column(rows, "is_left").astype(bool), column(rows, "n")
        order = np.argsort(n)
        left, right = order[is_left[order]], order[~is_left[order]]
        hits = np.full(len(left), -1)
        if len(left) and len(right):
            usd, cdf, places = column(rows, "usd"), column(rows, "cdf"), n[right]
            gone = bytearray(len(right))
            free = [Free(usd[right], gone), Free(cdf[right], gone)]
            bounds = [x for f, wanted, most in zip(free, (usd[left], usd[left] * rate), (V.MATCH_USD, V.MATCH_CDF), strict=True) for x in f.bounds(wanted, most)]

            def drop(row: int) -> None:
                gone[row] = 1
                for f in free:
                    f.drop(row)

            lost = []
            if outside is not None and len(outside):
                by, taken = column(outside, "by"), column(outside, "taken")
                lost = sorted(zip(by.tolist(), np.searchsorted(places, taken).tolist(), strict=True), reverse=True)
            for i, (place, *within) in enumerate(zip(n[left].tolist(), *bounds, strict=True)):
                # what others take before this row isn't free for it, nor for those behind it
                while lost and lost[-1][0] < place:
                    row = lost.pop()[1]
                    if not gone[row]:
                        drop(row)
                hit = min(free[0].first(within[0], within[1]), free[1].first(within[2], within[3]))
                if hit < len(right):
                    hits[i] = hit
                    drop(hit)
        is_shared = column(rows, "is_shared").astype(bool)[right]
        told = np.array([h < 0 or is_shared[h] for h in hits], bool)
        out = rows.take(pa.array(left[told]))
        taken = pa.array(n[right][hits[told]] if len(right) else hits[told], pa.int64(), mask=hits[told] < 0)
        names = [*keys, "band", "n", "taken", "j", "seq", "usd"]
        return pa.table([taken if c == "taken" else out.column(c) for c in names], names=names)

    return walk


# Fixed: the sheets of a workbook of journals, the row of their header, and their columns.
SITE_SHEET, HEAD_SHEET, HEADER_ROW = "JC Consolidé", "JC DGO", 9
COLUMNS = {"Libellés": "label", "Code Interne": "code", "Entrées CDF": "inC", "Sorties CDF": "outC", "Entrées USD": "inU", "Sorties USD": "outU", "Solde CDF": "balC", "Solde USD": "balU"}
SEVERITIES = ["BLOCKER", "HIGH", "MED", "LOW"]


def matches_contract(cells: DataFrame) -> DataFrame:
    """(path, is_journal): whether a workbook has both journals."""
    return cells.groupBy("path").agg((F.count_distinct(F.when(F.trim("sheet").isin(SITE_SHEET, HEAD_SHEET), F.trim("sheet"))) == 2).alias("is_journal"))


def parsed(cells: DataFrame) -> DataFrame:
    """(path, j, seq, d, month, code, label, inC, outC, inU, outU, balC, balU) from the cells of both journals of each book.

    The header's names say what a column is; a row counts if its date can be read, and `seq` is
    its place among the rows below the header.
    """
    from gridwright.functions.cells import coerce_date, journal_number, journal_text

    tag = F.when(F.trim("sheet") == SITE_SHEET, "site").when(F.trim("sheet") == HEAD_SHEET, "dgo")
    own = cells.withColumn("j", tag).where("j is not null")
    by = [*book(cells), "j"]
    # a header is as wide as a sheet; headers are as many as books
    names = own.where(F.col("row") == HEADER_ROW).select(*by, "col", F.trim("raw").alias("name"))
    body = own.where(F.col("row") > HEADER_ROW).join(names, [*by, "col"])
    value = lambda name: F.max(F.when(F.col("name") == name, F.col("raw")))
    rows = body.groupBy(*by, "row").agg(value("Dates").alias("date"), *[value(n).alias(c) for n, c in COLUMNS.items()])
    shaped = {c: journal_text(F.col(c)) if c in ("label", "code") else journal_number(F.col(c)) for c in COLUMNS.values()}
    dated = rows.withColumn("d", coerce_date(F.col("date"))).where("d is not null")
    return dated.select(*by, (F.col("row") - HEADER_ROW - 1).alias("seq"), "d", F.date_format("d", "yyyy-MM").alias("month"), *[v.alias(c) for c, v in shaped.items()])


def destinations(spend: DataFrame, head_out: DataFrame) -> DataFrame:
    """(kind, usd, pct) of all that was paid out: by kind of code, and by the head office's own journal, the largest first.

    `spend`: kind, usd. `head_out`: usd.
    """
    own = book(spend, head_out)
    kinds = spend.groupBy(*own, "kind").agg(F.sum(F.col("usd").cast("decimal(18,2)")).alias("usd"))
    every = kinds.unionByName(head_out.groupBy(*own).agg(F.lit("dgo").alias("kind"), F.sum(F.col("usd").cast("decimal(18,2)")).alias("usd"))).where("usd <> 0")
    # a row for each kind
    total = F.sum("usd").over(W.partitionBy(*own, F.lit(0).alias("all")))
    shares = every.withColumn("pct", F.round((100 * F.col("usd") / total).cast("double"), 1))
    return shares.select(*own, "kind", F.col("usd").cast("double").alias("usd"), "pct").orderBy(*own, F.desc("usd"), "kind")


def exceptions(found: DataFrame) -> DataFrame:
    """(n, n_high, at_stake_usd) of findings with `severity` and `usd`, by book."""
    return found.groupBy(*book(found)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity").isin("HIGH", "BLOCKER")).alias("n_high"), F.coalesce(F.sum(F.abs(F.col("usd").cast("decimal(18,2)"))), F.lit(0)).cast("double").alias("at_stake_usd"))


def gravest_first(found: DataFrame, most: int = 200) -> DataFrame:
    """The `most` gravest findings of each book, by severity and then by what is at stake."""
    own = book(found)
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    order = [F.when(rank == 0, len(SEVERITIES) + 1).otherwise(rank), F.desc(F.abs("usd")), F.col("subject")]
    if not own:
        return found.orderBy(*order).limit(most)
    # the limit on the rank goes below the shuffle
    return found.withColumn("k", F.row_number().over(W.partitionBy(*own).orderBy(*order))).where(F.col("k") <= most).drop("k")
