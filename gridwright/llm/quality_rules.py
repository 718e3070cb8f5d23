"""Line-first quality rules, in DataFrame functions only.

Every line is judged by itself: final punctuation, navigation, boilerplate, symbol noise and
shouting. Failing lines are removed, and a document that loses more than `max_lost` of its
word characters is rejected, as is one that fails the base rules (too few words, or too many
of its words inside repeated three-word windows).

Defined cases. Null text counts as empty: no words, base rules failed, rejected, cleaned text
null. Lines without a word are neither judged nor counted, and stay. Repeated rows are judged
one by one. A long text is one row, judged whole; equal texts tie, as nothing but the text counts.
Other columns are carried through with their values, whatever their names; the columns added here
replace any of the same name. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.llm.common import WHITE, packed, read, unpacked, words_of

#: Characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"
HAS_WORD = r"[^\x20\x09-\x0D]"
#: Fixed rules: what a line of prose may end with, what separates the items of a menu, and phrases of page furniture, in lower case.
FINAL = [".", "!", "?", "…", ":", ";", ",", ")", "]", '"', "'", "”", "’", "»", "。", "！", "？"]
SEPARATORS = "[|›»•·]"
BOILERPLATE = [
    "lorem ipsum", "javascript", "cookie", "terms of use", "terms of service", "privacy policy", "all rights reserved",
    "sign in", "sign up", "log in", "click here", "read more", "share this", "subscribe", "{", "}",
]
#: The phrases as whole words, or with a plural's s; braces anywhere.
WHOLE = r"(?<![\p{L}\p{N}_])(?:" + "|".join(p for p in BOILERPLATE if p not in "{}") + r")s?(?![\p{L}\p{N}_])|[{}]"
#: For whole phrases: a line of so many words is short, and so many percent of its characters are a fair share.
SHORT = 20
SHARE = 20
#: A window's place takes so many low bits of its sort key; its hash has the others.
PLACE_BITS = 30

ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_lines_removed", "lost_chars", "base_failed", "kept", "cleaned"]


def _phrases(c: Column) -> Column:
    found = F.lit(False)
    for phrase in BOILERPLATE:
        found = found | F.contains(c, F.lit(phrase))
    return found


def _mostly_phrases(c: Column) -> Column:
    """Phrases as whole words, in a line of few words or as a fair share of its characters."""
    left = F.length(F.regexp_replace(c, WHOLE, ""))
    return (left < F.length(c)) & ((F.size(words_of(c)) <= SHORT) | ((F.length(c) - left) * 100 >= F.length(c) * SHARE))


def line_fails(line: Column, marks: Column, boilerplate: Column, min_words_punctuated: int = 4, whole_phrases: bool = False) -> Column:
    """True for a line to remove. `marks` (symbols or separators) and `boilerplate`: false where the whole text has none, so that its lines need no look.

    Lines of fewer words than `min_words_punctuated` need no final punctuation. One phrase anywhere
    fails a line, as in the SQL; with `whole_phrases` only as `_mostly_phrases` says.
    """
    bare = F.regexp_replace(line, r"[\x20\x09-\x0D]+$", "")
    n_words = F.size(words_of(line))
    separators = F.regexp_count(line, F.lit(SEPARATORS))
    return (
        (~F.substring(bare, -1, 1).isin(FINAL) & (n_words >= min_words_punctuated))
        | (marks & ((separators >= 3) & (separators * 4 >= n_words) | (F.regexp_count(line, F.lit(SYMBOLS)) * 10 > F.length(line))))
        | (boilerplate & _phrases(F.lower(line)) & (_mostly_phrases(F.lower(line)) if whole_phrases else F.lit(True)))
        | (F.regexp_count(line, F.lit(r"\p{Lu}")) * 5 > F.length(line) * 2)
    )


def _beside(of: str, x: Column, i: Column, same: Callable[[Column, Column], Column]) -> Column:
    """True where the element after or before is the same."""
    return F.coalesce(same(x, F.get(of, i + 1)), F.lit(False)) | F.coalesce(same(x, F.get(of, i - 1)), F.lit(False))


def quality_rules(docs: DataFrame, text: str = "text", min_words: int = 50, max_repeat: int = 50, max_lost: int = 50, whole_phrases: bool = False) -> DataFrame:
    """`docs` with the columns of ADDED; a row for each row, kept or not. `max_repeat` and `max_lost` are percentages.

    Nothing is shuffled: a row is judged from its own text. Repeated windows are found by
    sorting a text's windows, as 34 bits of hash and their place in one long. Those beside an
    equal hash, which are few, are then sorted by their words, so the count is exact.
    """
    nothing = F.array().cast("array<string>")
    users = [c for c in docs.columns if c not in ADDED]
    base = packed(docs.select(*[F.col(f"`{c}`") for c in users]), keep=[text]).withColumn("__t", F.coalesce("c0", F.lit("")))
    split = base.withColumns({
        "__w": F.array_remove(F.split("__t", WHITE, -1), ""),
        "__n": F.split("__t", "\n", -1),
        "n_symbols": F.regexp_count("__t", F.lit(SYMBOLS)).cast("long"),
        "__b": _phrases(F.lower("__t")),
        "__m": F.col("__t").rlike(f"{SYMBOLS[:-1]}{SEPARATORS[1:]}"),
    })
    window = F.transform(
        F.slice("__w", F.lit(1), F.greatest(F.size("__w") - 2, F.lit(0))),
        lambda w, i: F.shiftleft(F.xxhash64(w, F.get("__w", i + 1), F.get("__w", i + 2)), PLACE_BITS).bitwiseOR(i.cast("long")),
    )
    placed = split.withColumns({
        "__s": F.sort_array(window),
        "__l": F.filter("__n", lambda x: x.rlike(HAS_WORD)),
        "__k": F.filter("__n", lambda x: ~x.rlike(HAS_WORD) | ~line_fails(x, F.col("__m"), F.col("__b"), whole_phrases=whole_phrases)),
    })
    near = F.filter("__s", lambda x, i: _beside("__s", x, i, lambda a, b: F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS)))
    place = F.lit((1 << PLACE_BITS) - 1).cast("long")

    def words_at(x: Column) -> Column:
        i = x.bitwiseAND(place).cast("int")
        return F.struct(F.concat_ws(" ", F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)).alias("words"), i.alias("i"))

    likely = placed.withColumn("__e", F.array_sort(F.transform(near, words_at)))
    exact = F.filter("__e", lambda x, i: _beside("__e", x, i, lambda a, b: a["words"] == b["words"]))
    found = likely.withColumn("__r", F.array_sort(F.transform(exact, lambda x: x["i"])))
    covered = F.when(F.size("__r") == 0, 0).otherwise(
        3 + F.aggregate(F.transform("__r", lambda x, i: F.when(i == 0, 0).otherwise(F.least(F.lit(3), x - F.get("__r", i - 1)))), F.lit(0), lambda a, x: a + x)
    )
    counted = found.withColumns({
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "n_repeat_words": covered.cast("long"),
        "n_lines": F.size("__l").cast("long"),
        "n_lines_removed": (F.size("__n") - F.size("__k")).cast("long"),
    })
    judged = counted.withColumns({
        "lost_chars": F.when(F.col("n_lines_removed") == 0, 0).otherwise(F.col("word_chars") - F.length(F.array_join(F.array_remove(F.split(F.array_join("__k", " "), WHITE, -1), ""), ""))).cast("long"),
        "base_failed": (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words")),
    })
    results = [F.col(c) for c in ADDED[:-2]] + [
        (~F.col("base_failed") & (100 * F.col("lost_chars") <= max_lost * F.col("word_chars"))).alias("kept"),
        F.when(F.col("c0").isNotNull(), F.array_join(F.coalesce("__k", nothing), "\n")).alias("cleaned"),
    ]
    # an array of one struct, exploded, gives each row once: a filter on the verdict stays above it, instead of being
    # pushed below, where each mention of a column is replaced by all that it is made of
    rows = judged.select("c0", "rest", F.explode(F.array(F.struct(*results))).alias("x"))
    others = [c for c in users if c != text]
    return rows.select(*[(F.col("c0") if c == text else F.col(f"rest.r{others.index(c)}")).alias(c) for c in users], "x.*")


def cleaned_documents(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", **settings) -> DataFrame:
    """The documents that are kept, their text without the lines that fail, all other columns as they are.

    `n_chars`, where there is such a column, becomes the number of the characters left.
    """
    kept = quality_rules(packed(docs, keep=[text]), "c0", **settings).where("kept").select(F.col("cleaned").alias("c0"), "rest")
    out = unpacked(kept, docs.columns, [text])
    return out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType)) if n_chars in docs.columns else out


#: What op7 returns.
COUNTS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_removed", "lost_chars"]


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents")).select(*COUNTS)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
tri AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS words
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 3)),
again AS (SELECT doc_id, words FROM tri GROUP BY ALL HAVING count(*) > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM tri JOIN again USING (doc_id, words), generate_series(0, 2) AS g(k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
seen AS (
  SELECT doc_id, line, len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n, lower(line) AS low,
         length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS bare, right(regexp_replace(line, '[\x20\x09-\x0D]+$', ''), 1) AS final,
         len(regexp_extract_all(line, '[|›»•·]')) AS separators, len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols, len(regexp_extract_all(line, '\p{Lu}')) AS upper
  FROM lines),
judged AS (
  SELECT *, n > 0 AND ((n >= 4 AND final NOT IN ('.', '!', '?', '…', ':', ';', ',', ')', ']', '"', '''', '”', '’', '»', '。', '！', '？'))
    OR (separators >= 3 AND separators * 4 >= n) OR symbols * 10 > length(line) OR upper * 5 > length(line) * 2
    OR len(list_filter(['lorem ipsum', 'javascript', 'cookie', 'terms of use', 'terms of service', 'privacy policy', 'all rights reserved', 'sign in', 'sign up', 'log in',
                        'click here', 'read more', 'share this', 'subscribe', '{', '}'], lambda p: contains(low, p))) > 0) AS fails
  FROM seen),
found AS (
  SELECT doc_id, sum(bare)::BIGINT AS word_chars, sum(symbols)::BIGINT AS n_symbols, count(*) FILTER (n > 0) AS n_lines, count(DISTINCT line) FILTER (n > 0) AS n_different,
         count(*) FILTER (fails) AS n_lines_removed, coalesce(sum(bare) FILTER (fails), 0)::BIGINT AS lost_chars
  FROM judged GROUP BY doc_id),
counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, word_chars, n_symbols, n_lines - n_different AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, n_lines, n_lines_removed, lost_chars
  FROM d JOIN found USING (doc_id) LEFT JOIN repeated USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_chars <= 50 * word_chars AS kept
FROM counted
"""
