"""Alignments of two tokenizers against a plain walk over all pairs of tokens."""

import base64
import hashlib
from collections import Counter, defaultdict

import public_tokenizers as P

from test_llm import SCHEMA, awkward



def plain(rows):
    """By the tokenizers themselves, whole texts at a time, all pairs of tokens compared."""
    import sentencepiece
    from gridwright.llm import alignment
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(P.path(alignment.A))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=P.path(alignment.B))
    ranks = [base64.b64decode(line.split()[0]) for line in open(P.path("byte_bpe_50k.tiktoken"), "rb")]

    def b_bytes(i):
        piece = b_side.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_side.is_byte(i) else piece.replace("▁", " ").encode()

    found, held = [], Counter()
    for r in rows:
        doc_id, text = r[0], r[1]
        if not text:
            found.append((doc_id, None))
            continue
        whole = f" {text}".encode()
        a = [(i, ranks[i]) for i in a_side.encode(f" {text}", add_special_tokens=False).ids]
        b = [(i, b_bytes(i)) for i in b_side.encode(text)]
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            found.append((doc_id, None))
            continue
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        cuts = {s[2] for s in spans[0]} & {s[2] for s in spans[1]}
        groups = defaultdict(lambda: ([], []))
        order = sorted(cuts)
        for side in (0, 1):
            k = 0
            for i, _, end in spans[side]:
                groups[k][side].append(str(i))
                k += end == order[k]
        text_of = ";".join("|".join(",".join(ids) for ids in groups[k]) for k in sorted(groups))
        pairs = Counter()
        low = 0
        for i, s, e in spans[0]:
            while spans[1][low][2] <= s:
                low += 1
            k = low
            while k < len(spans[1]) and spans[1][k][1] < e:
                pairs[i, spans[1][k][0]] += 1
                k += 1
        held.update(pairs.keys())
        found.append((doc_id, (len(a), len(b), len(groups), pairs, text_of)))
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    out = []
    for doc_id, x in found:
        if x is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, n, pairs, text_of = x
            out.append((doc_id, n_a, n_b, n, sum(pairs.values()), sum(k for p, k in pairs.items() if held[p] == best[p[0]]), sum(k * held[p] for p, k in pairs.items()), text_of))
    return out


ODD = ["▁ a▁b", "a\xa0  b\x0b c\x1c d\x85e", "tab\tand\r\nreturn;\r end", "\n\n  two\n \n", " lead  and trail ", "don't it's <|endoftext|> </s> <unk> <0x41>", "ʼn ﬁ é é 日本語🙂🙂", "x" * 700, "\x00 nul", "1234567 12,5 %&", "   ", "\t", "\n", "İ" * 40]


def test_against_plain_walk(spark):
    from gridwright.llm import alignment

    rows = awkward() + [(1000 + i, t, None, None, 0, None, None) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = sorted(plain(rows), key=key)
    assert sum(not r[1] for r in want) >= 4 and sum(r[3] < r[1] for r in want) > 20
    for pack_bytes in (alignment.PACK_BYTES, 500):
        got = alignment.align(docs, P.path(alignment.A), P.path(alignment.B), pack_bytes=pack_bytes)
        assert sorted(map(tuple, got.collect()), key=key) == want
    told = alignment.align(docs, P.path(alignment.A), P.path(alignment.B), groups="sha256")
    assert {r.groups for r in told.collect()} == {hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "" for r in want}


def test_small_tables(spark):
    from gridwright.llm import alignment

    for rows in ([], [(1, None, "en", "s", 0, True, "u"), (1, "", None, None, None, None, None)]):
        got = alignment.align(spark.createDataFrame(rows, SCHEMA), P.path(alignment.A), P.path(alignment.B)).collect()
        assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "")] * len(rows)


def test_units_forget(monkeypatch):
    """A worker's table of units may be far smaller than a slice."""
    from gridwright.llm import alignment

    whole = alignment.Encoders(P.path(alignment.A), P.path(alignment.B))
    texts = [f" {r[1]}" for r in awkward() if r[1]]
    want = [[x.tolist() for x in side] for side in whole.encode(texts)[:2]]
    monkeypatch.setattr(alignment, "CACHED", 50)
    small = alignment.Encoders(P.path(alignment.A), P.path(alignment.B))
    for _ in range(2):
        assert [[x.tolist() for x in side] for side in small.encode(texts)[:2]] == want


def test_groups_where_nothing_is_common():
    """One token of A over many of B, and the other way round."""
    import numpy as np

    from gridwright.llm.alignment import grouped, links

    a, b = np.array([0, 8, 9]), np.array([0, 2, 4, 6, 8])
    a_end, b_end = np.array([8, 9, 12]), np.array([2, 4, 6, 8, 12])
    order, group = grouped(a, a_end, b, b_end)
    assert group.max() == 1 and sorted(order[group == 0].tolist()) == [0, 3, 4, 5, 6]
    left, right = links(a, a_end, b, b_end)
    assert list(zip(left.tolist(), right.tolist(), strict=True)) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 4), (2, 4)]
