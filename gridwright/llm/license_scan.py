"""Licences in texts, in DataFrame functions only: phrases, and notices found by votes of diagonals.

One pass explodes each text's words. A place is kept where a base phrase stands, or where the hash
of `GRAM` words is that of a run of a template's words, which the words themselves then confirm. A
place in a text less its place in the template is a diagonal: what stands in order votes for one.
Diagonals with enough votes are merged with neighbours, up to `SLACK` words off, as words put in or
left out shift what follows. A span is verified by its words: so large a share of the template's
has to stand in it, and they have to make up half of it; or one diagonal alone has that share.

Templates are a list on the driver, so the table of their runs is as large as that list says; up to
BROADCAST rows it is broadcast, beyond that it is joined by a shuffle. Only kept places are
shuffled. A phrase or passage in a third of all documents gives a row for each of its places.

Defined cases. A null or empty text has no words: zeros, nulls, '' and score 0. Only A-Z are put in
lower case. Repeated rows are rows of their own. Ties: labels are sorted, and one label found
twice counts once. A long text's places are spread over tasks like any others; its words are one
row, never cut. Other columns are carried through `scanned` with their values, whatever their names;
those of ADDED replace columns of the same name. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwright.llm.common import cut, read

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed: the phrases that are always looked for, with their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Public notices as their licences give them, without names and years.
TEMPLATES = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source
code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,
either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software
Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
https://mozilla.org/MPL/2.0/."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
]
#: Words of a run; how far neighbouring diagonals may be apart; votes that a diagonal needs, in percent of the template's runs.
GRAM, SLACK, VOTES = 3, 12, 5
#: Percent of a template's words that a span has to hold, and percent of the span that they have to make up.
SHARE, DENSE = 80, 50
#: Rows of runs of templates that are broadcast.
BROADCAST = 200_000
#: What a base phrase alone says.
PHRASE_SCORE = 0.5

ADDED = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]


def words_of(text: Column) -> Column:
    """Words, A-Z in lower case. Of what else `lower` changes only the Kelvin sign would become a letter of a-z, so it is replaced by another sign first."""
    return F.array_remove(F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("Ω"))), SEPARATORS, -1), "")


def plain_words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", text.lower())


def runs(templates: list[tuple[str, str]], gram: int = GRAM) -> list[tuple[int, str, int, int, list[str]]]:
    """(template, label, words, place, run) of all runs of templates; one shorter than a run gives none."""
    out = []
    for t, (label, text) in enumerate(templates):
        words = plain_words(text)
        out += [(t, label, len(words), p, words[p : p + gram]) for p in range(len(words) - gram + 1)]
    return out


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)


def places(rows: DataFrame, templates: list[tuple[str, str]], phrases: dict[str, str], gram: int) -> DataFrame:
    """Of `rows` (rest, w, uid) a row for each text (i = -1) with its number of words n, and one for each place of a phrase or of a template's run; written once."""
    table = rows.sparkSession.createDataFrame(runs(templates, gram), "template int, label string, size int, p int, run array<string>")
    keyed = table.withColumn("h", F.xxhash64(*[F.col("run")[j] for j in range(gram)]))
    keyed = F.broadcast(keyed) if keyed.count() <= BROADCAST else keyed
    at = rows.withColumn("i", F.explode(F.sequence(F.lit(-1), F.size("w") - 1)))
    word = lambda j: F.get("w", F.col("i") + j)
    inside = F.col("i") >= 0
    stands = [(label, _all([inside, *(word(j) == x for j, x in enumerate(phrase.split()))])) for phrase, label in phrases.items()]
    same = [inside, F.xxhash64(*map(word, range(gram))) == F.col("h"), *(word(j) == F.col("run")[j] for j in range(gram))]
    base = F.array_compact(F.array(*[F.when(test, F.lit(label)) for label, test in stands])) if stands else F.array().cast("array<string>")
    some = reduce(lambda a, b: a | b, [~inside, F.col("template").isNotNull(), *(test for _, test in stands)])
    found = at.join(keyed, _all(same), "left").where(some)
    return cut(found.select("uid", "i", F.when(~inside, F.col("rest")).alias("rest"), F.when(~inside, F.size("w")).cast("long").alias("n"), base.alias("base"), "template", "label", "size", "p"), "license-places")


def _covered(sorted_places: str, gram: int) -> Column:
    """Words that runs at these places cover."""
    steps = F.transform(sorted_places, lambda x, j: F.when(j == 0, gram).otherwise(F.least(F.lit(gram), x - F.get(sorted_places, j - 1))))
    return F.aggregate(steps, F.lit(0), lambda a, x: a + x)


def spans(found: DataFrame, gram: int = GRAM, slack: int = SLACK, votes: int = VOTES, share: int = SHARE, dense: int = DENSE) -> DataFrame:
    """(uid, label, template, first, last, share) of verified spans, from the places of templates' runs: first and last word, and the share of the template."""
    diagonals = found.where("template is not null").groupBy("uid", "template", "label", "size", (F.col("i") - F.col("p")).alias("d")).agg(
        F.min("i").alias("low"), F.max("i").alias("high"), F.array_sort(F.collect_set("p")).alias("ps")
    )
    strong = diagonals.where(F.size("ps") * 100 >= votes * (F.col("size") - gram + 1)).withColumn("alone", _covered("ps", gram))
    by = W.partitionBy("uid", "template").orderBy("d")
    marked = strong.withColumn("new", F.coalesce(F.col("d") - F.lag("d").over(by) > slack, F.lit(True)).cast("int"))
    merged = marked.withColumn("g", F.sum("new").over(by)).groupBy("uid", "template", "label", "size", "g").agg(
        F.min("low").alias("low"), (F.max("high") + gram - 1).alias("high"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ps")))).alias("ps"),
        F.max_by(F.struct("alone", "low", (F.col("high") + gram - 1).alias("high")), F.struct("alone", -F.col("low"))).alias("best"),
    )
    told = merged.withColumn("all", _covered("ps", gram))
    tight = F.col("all") * 100 >= dense * (F.col("high") - F.col("low") + 1)
    whole = tight & (F.col("all") >= F.col("best.alone"))
    chosen = told.select("uid", "label", "template", "size", F.when(whole, F.col("low")).otherwise(F.col("best.low")).alias("first"), F.when(whole, F.col("high")).otherwise(F.col("best.high")).alias("last"), F.when(whole, F.col("all")).otherwise(F.col("best.alone")).alias("held"))
    return chosen.where(F.col("held") * 100 >= share * F.col("size")).select("uid", "label", "template", "first", "last", (F.col("held") / F.col("size")).alias("share"))


def scanned(docs: DataFrame, text: str = "text", columns: list[str] | None = None, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, gram: int = GRAM, **settings) -> DataFrame:
    """The user's `columns` (all, if None) with those of ADDED. `spans`: first and last word, label and share of each verified span, in order.

    score: the largest share of a template that a verified span holds; PHRASE_SCORE at least where a base phrase stands.
    """
    kept = [c for c in (docs.columns if columns is None else columns) if c not in ADDED]
    rows = docs.select(F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`").alias(f"r{j}") for j, c in enumerate(kept)]).alias("rest"), words_of(F.col(f"`{text}`")).alias("w"), F.monotonically_increasing_id().alias("uid"))
    found = places(rows, templates, phrases, gram)
    # a place that starts several runs of templates is several rows, of which one tells of its phrases
    standing = found.where("i >= 0 and size(base) > 0").dropDuplicates(["uid", "i"]).select("uid", "i", F.explode("base").alias("base"))
    by_phrase = standing.groupBy("uid").agg(F.count("i").alias("n_base"), F.min("i").cast("long").alias("first_word"), F.max("i").cast("long").alias("last_word"), F.collect_set("base").alias("bases"))
    by_span = spans(found, gram, **settings).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("first", "last", "label", "share"))).alias("spans"))
    told = by_phrase.join(by_span, "uid", "full")
    joined = found.where("i = -1").select("uid", "rest", F.col("n").alias("n_words")).join(told, "uid", "left")
    bases, own = F.coalesce("bases", F.array().cast("array<string>")), F.coalesce("spans", F.array().cast("array<struct<first:int,last:int,label:string,share:double>>"))
    names = lambda c: F.array_join(F.array_sort(c), ",")
    shaped = joined.withColumns({
        "n_base": F.coalesce("n_base", F.lit(0)), "base_labels": names(bases), "labels": names(F.array_union(bases, F.transform(own, lambda s: s["label"]))), "spans": own,
        "score": F.greatest(F.coalesce(F.array_max(F.transform(own, lambda s: s["share"])), F.lit(0.0)), F.when(F.size(bases) > 0, PHRASE_SCORE).otherwise(0.0)),
    })
    return shaped.select(*[F.col(f"rest.r{j}").alias(c) for j, c in enumerate(kept)], *ADDED)


#: What op13 returns.
DIGEST = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(read(spark, sf_dir, "documents"), columns=["doc_id"]).select(*DIGEST)


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle() -> str:
    """DuckDB SQL of the query, from the same phrases and templates."""
    phrases = ", ".join(f"({_sql_text(p)}, {_sql_text(label)}, {len(p.split())})" for p, label in PHRASES.items())
    templates = ", ".join(f"({t}, {_sql_text(label)}, {_sql_text(' '.join(plain_words(text)))})" for t, (label, text) in enumerate(TEMPLATES))
    run = " || ' ' || ".join(f"w[i + {j}]" if j else "w[i]" for j in range(GRAM))
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id, list_filter(string_split_regex(lower(replace(coalesce(text, ''), 'K', 'Ω')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
places AS (SELECT uid, w, unnest(generate_series(1, len(w))) AS i FROM d),
phrases(phrase, label, n) AS (VALUES {phrases}),
standing AS (
  SELECT uid, i - 1 AS i, label FROM places, phrases WHERE starts_with(phrase, w[i]) AND array_to_string(w[i:i + n - 1], ' ') = phrase),
by_phrase AS (SELECT uid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS bases FROM standing GROUP BY uid),
templates(template, label, words) AS (VALUES {templates}),
tw AS (SELECT template, label, string_split(words, ' ') AS w FROM templates),
runs AS (SELECT template, label, len(w) AS size, i - 1 AS p, {run} AS run FROM (SELECT *, unnest(generate_series(1, len(w) - {GRAM - 1})) AS i FROM tw)),
texts AS (SELECT uid, i - 1 AS i, {run} AS run FROM places WHERE i + {GRAM - 1} <= len(w)),
diagonals AS (
  SELECT uid, template, label, size, i - p AS d, min(i) AS low, max(i) AS high, list_sort(list(DISTINCT p)) AS ps FROM texts JOIN runs USING (run) GROUP BY ALL),
strong AS (
  SELECT *, {GRAM} + coalesce(list_sum(list_transform(range(2, len(ps) + 1), lambda j: least({GRAM}, ps[j] - ps[j - 1]))), 0) AS alone FROM diagonals WHERE len(ps) * 100 >= {VOTES} * (size - {GRAM - 1})),
marked AS (SELECT *, coalesce(d - lag(d) OVER (PARTITION BY uid, template ORDER BY d) > {SLACK}, true)::INT AS new FROM strong),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY uid, template ORDER BY d) AS g FROM marked),
merged AS (
  SELECT uid, template, label, size, g, min(low) AS low, max(high) + {GRAM - 1} AS high, list_sort(list_distinct(flatten(list(ps)))) AS ps, max(alone) AS best FROM grouped GROUP BY ALL),
told AS (SELECT *, {GRAM} + coalesce(list_sum(list_transform(range(2, len(ps) + 1), lambda j: least({GRAM}, ps[j] - ps[j - 1]))), 0) AS held FROM merged),
verified AS (
  SELECT uid, label, (CASE WHEN held * 100 >= {DENSE} * (high - low + 1) AND held >= best THEN held ELSE best END)::DOUBLE / size AS share FROM told
  WHERE (CASE WHEN held * 100 >= {DENSE} * (high - low + 1) AND held >= best THEN held ELSE best END) * 100 >= {SHARE} * size),
by_span AS (SELECT uid, list(DISTINCT label) AS found, max(share) AS share FROM verified GROUP BY uid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(bases, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(bases, []), coalesce(found, [])))), ',') AS labels,
       greatest(coalesce(share, 0), CASE WHEN n_base > 0 THEN {PHRASE_SCORE} ELSE 0 END)::DOUBLE AS score
FROM d LEFT JOIN by_phrase USING (uid) LEFT JOIN by_span USING (uid)
"""


ORACLE_SQL = oracle()
