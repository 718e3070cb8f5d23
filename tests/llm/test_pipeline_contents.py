"""What each stage of the pipeline returns, row by row, against plain versions."""

import random
import re
from collections import Counter

WHITE = re.compile(r"[\x20\x09-\x0D]+")


def documents():
    """Prose, exact copies but for white space, near copies, junk, short texts and nulls, in leaves of unlike sizes."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(3, 8)))
    rows = []
    for i in range(60):
        words = [word() for _ in range(rng.randint(60, 150))]
        text = " ".join(words) + "."
        rows.append(text)
        if i % 5 == 0:
            rows += [text, text.replace(" ", "  ", 4)]
        if i % 7 == 0:
            changed = list(words)
            changed[rng.randrange(len(words))] = word()
            rows.append(" ".join(changed) + ".")
        if i % 9 == 0:
            rows.append(text + "\nSign in | Log in | Sign up | Read more\n" + " ".join(word() for _ in range(20)) + ".")
    rows += [None, "", "too short.", "SHOUTING WORDS " * 60, "same again " * 80]
    return [(i, t, rng.choice(["en", "fr"]), rng.choice(["web1", "web1", "web1", "src2"]), len(t or "")) for i, t in enumerate(rows)]


def test_stages_row_by_row(spark):
    import corpus_pipeline
    import public_tokenizers
    from pyspark.sql import functions as F

    from gridwright.llm import sentencepieces
    from gridwright.llm.common import cut
    from gridwright.llm.mixing import mix
    from gridwright.llm.quality_rules import quality_rules
    from gridwright.llm.simhash import with_uid

    stages = dict(corpus_pipeline.STAGES)
    docs = cut(spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3), "documents")
    judged = {r.doc_id: r for r in quality_rules(docs, whole_phrases=True).collect()}
    kept = cut(stages["quality rules"](spark, docs, ""), "stage")
    assert {r.doc_id: (r.text, r.n_chars) for r in kept.collect()} == {d: (r.cleaned, len(r.cleaned)) for d, r in judged.items() if r.kept}
    assert 50 < kept.count() < docs.count() and any(r.cleaned != r.text for r in judged.values() if r.kept)

    bare = lambda t: WHITE.sub("", t)
    best = {}
    for r in kept.collect():
        k = bare(r.text)
        best[k] = min(best.get(k, (0, 1 << 60)), (-len(r.text), r.doc_id))
    single = cut(stages["exact dedup"](spark, kept, ""), "stage")
    assert sorted(r.doc_id for r in single.collect()) == sorted(d for _, d in best.values())

    rows = sorted(single.collect(), key=lambda r: r.doc_id)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (r.text.lower().split() for r in rows)]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    near = cut(stages["simhash near-dedup"](spark, single, ""), "stage")
    assert sorted(r.doc_id for r in near.collect()) == sorted(rows[x].doc_id for x in set(root))
    assert near.count() < single.count()

    mixed = cut(stages["mixing"](spark, near, ""), "stage")
    copies = {r.doc_id: r.copies for r in mix(cut(with_uid(near), "numbered")).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(copies)
    by_id = {r.doc_id: r for r in near.collect()}
    assert all(r == by_id[r.doc_id] for r in mixed.collect()) and max(copies.values()) > 1

    coded = stages["sentencepiece"](spark, mixed, "")
    table = sentencepieces.load(public_tokenizers.path(sentencepieces.MODEL))
    assert coded.count() == mixed.count()
    for r in coded.select("doc_id", "text", "ids", "n_tokens", "decoded_same").where(F.col("doc_id") % 4 == 0).collect():
        unit = ("▁" + r.text.replace(" ", "▁")).encode()
        assert r.ids == table._alone(unit) and r.n_tokens == len(r.ids) and r.decoded_same
        assert table.decode(r.ids) == r.text
