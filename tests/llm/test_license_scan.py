"""Licence scans against plain loops, and notices that are changed, cut or mixed into prose."""

import random
import re
from collections import defaultdict

from test_llm import SCHEMA, awkward

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def covered(places, gram=3):
    return len({p + k for p in places for k in range(gram)})


def plain(text, templates, phrases, gram=3, slack=12, votes=5, share=80, dense=50):
    w = low(text)
    standing = [(i, label) for i in range(len(w)) for p, label in phrases.items() if w[i : i + len(p.split())] == p.split()]
    found = []
    for label, body in templates:
        t = low(body)
        diagonals = defaultdict(list)
        for i in range(len(w) - gram + 1):
            for p in range(len(t) - gram + 1):
                if w[i : i + gram] == t[p : p + gram]:
                    diagonals[i - p].append((i, p))
        strong = sorted(d for d, x in diagonals.items() if len(x) * 100 >= votes * (len(t) - gram + 1))
        groups = []
        for d in strong:
            if groups and d - groups[-1][-1] <= slack:
                groups[-1].append(d)
            else:
                groups.append([d])
        for g in groups:
            every = [x for d in g for x in diagonals[d]]
            held = covered(p for _, p in every)
            first, last = min(i for i, _ in every), max(i for i, _ in every) + gram - 1
            best = max(g, key=lambda d: (covered(p for _, p in diagonals[d]), -min(diagonals[d])[0]))
            alone = covered(p for _, p in diagonals[best])
            if not (held * 100 >= dense * (last - first + 1) and held >= alone):
                held, first, last = alone, min(diagonals[best])[0], max(diagonals[best])[0] + gram - 1
            if held * 100 >= share * len(t):
                found.append((first, last, label, held / len(t)))
    bases = {label for _, label in standing}
    places = [i for i, _ in standing]
    score = max([0.0, *(f[3] for f in found), *([0.5] if bases else [])])
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(bases)), ",".join(sorted(bases | {f[2] for f in found})), score, sorted(found)


def texts():
    from gridwright.llm.license_scan import TEMPLATES

    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(["the", "software", "of", "license", "river", "and", "mit", "cc", "by"]) for _ in range(n))
    out = []
    for _, body in TEMPLATES:
        w = body.split()
        changed = [x if rng.random() > 0.04 else "changed" for x in w]
        longer = [y for x in w for y in ([x, "extra"] if rng.random() < 0.03 else [x])]
        out += [body, f"{prose(40)}. {body.upper()} {prose(30)}", " ".join(changed), f"// {' '.join(longer)}", " ".join(w[: len(w) // 2]), f"{body}\n{prose(20)}\n{body}"]
    out += ["MIT License, mit-license; CC BY and CC\nBY", "mİt license K MIT  \x7fLICENSE", "gnu general public", "apache license " * 300, "permission notice " * 200 + TEMPLATES[0][1], "licensed under cc by " * 50]
    return out


def test_against_plain_loops(spark):
    from gridwright.llm.license_scan import ADDED, PHRASES, TEMPLATES, scanned

    rows = awkward() + [(3000 + i, t, None, "s", 0, None, None) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumnRenamed("uid", "score").withColumnRenamed("lang", "i")
    got = scanned(docs)
    assert got.columns == ["doc_id", "text", "i", "source", "n_chars", "kept", *ADDED]
    want = defaultdict(list)
    for r in rows:
        want[r[1]].append((r[0], plain(r[1], TEMPLATES, PHRASES)))
    seen = defaultdict(list)
    for r in got.collect():
        found = tuple(r[c] for c in ADDED[:-1]), [tuple(s) for s in r.spans]
        seen[r.text].append((r.doc_id, (*found[0], found[1])))
    key = lambda x: (x[0] is None, x[0] or 0)
    assert {t: sorted(x, key=key) for t, x in seen.items()} == {t: sorted(x, key=key) for t, x in want.items()}


def test_notices_are_found():
    """Whole and changed notices by their labels; half of one, or words of one without order, by none."""
    from gridwright.llm.license_scan import PHRASES, TEMPLATES

    for label, body in TEMPLATES:
        assert label in plain(body, TEMPLATES, PHRASES)[5].split(",")
    half = " ".join(TEMPLATES[0][1].split()[:40])
    assert plain(half, TEMPLATES, PHRASES)[5] == ""


def test_small_tables_and_settings(spark, monkeypatch):
    from gridwright.llm import license_scan

    assert license_scan.scanned(spark.createDataFrame([], SCHEMA)).count() == 0
    own = [("own", "this text is ours alone")]
    docs = spark.createDataFrame([(1, "say: this text is ours alone", None, None, 0, None, None), (2, None, None, None, 0, None, None)], SCHEMA)
    monkeypatch.setattr(license_scan, "BROADCAST", 0)
    got = {r.doc_id: r for r in license_scan.scanned(docs, templates=own, phrases={}).collect()}
    assert got[1].labels == "own" and [tuple(s) for s in got[1].spans] == [(1, 5, "own", 1.0)] and got[1].n_base == 0
    assert got[2].labels == "" and got[2].first_word is None and got[2].score == 0.0
    assert license_scan.scanned(docs, templates=[("none", "too short")], phrases={"ours alone": "a"}).where("labels = 'a'").count() == 1
