"""Substring dedup of words by relative Lempel-Ziv parsing.

A window of `LENGTH` words whose words also start in a document with a smaller doc_id is a
duplicate, and the words that such windows cover are removed. `spans.Finder` brings together,
in one bucket, all windows of all documents that may be equal: the bucket's segments are its
reference block. Its words are numbered by their bytes, and a suffix array over these numbers
indexes the block. For every place it gives the longest match with an earlier document: of all
suffixes of such documents, the closest before it and the closest behind it in the order of the
array share the most words with it.

Each segment is then factored greedily: from a place on, the longest match is a factor. A factor
of `LENGTH` words or more is a duplicate span, and the parse goes on from the first window that
crosses its end, so that a window across two factors is found too. A shorter factor has no
window, and the parse goes on with the next word.

Words are compared by their bytes; hashes only choose which segments meet.

Defined cases: those of `spans`. Repeated words overlap freely; windows are judged on the input.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from gridwright.llm.common import gather, read
from gridwright.llm.spans import FACTOR, PACK_BYTES, Finder, mixed

LENGTH = 13
GRAM = 5
DIGESTS = "doc_id long, n_words long, n_removed long, kept_sha256 string"


#: Windows of which the anchors are sought at once.
SLICE = 1 << 17


def hash_words(buffer, starts, ends):
    """A hash of each word buffer[start:end]; words stand in order."""
    import numpy as np

    if not len(starts):
        return np.empty(0, np.uint64)
    base = int(starts[0])
    part = buffer[base : int(ends[-1])]
    starts, ends = starts - base, ends - base
    n = len(part)
    power = np.full(n, FACTOR, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
    back = np.full(n, pow(FACTOR, -1, 1 << 64), np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    return mixed((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def places_in(buffer):
    """(starts, ends) of words that a space follows each."""
    import numpy as np

    ends = np.flatnonzero(buffer == 32)
    starts = np.empty_like(ends)
    starts[:1], starts[1:] = 0, ends[:-1] + 1
    return starts, ends


def _tokens(texts: list[bytes]):
    import numpy as np

    parts = [b" ".join(w) + b" " if (w := t.split()) else b"" for t in texts]
    buffer = np.frombuffer(b"".join(parts), np.uint8)
    starts, ends = places_in(buffer)
    return np.diff(np.searchsorted(ends, np.cumsum([0, *map(len, parts)]))), (buffer, starts, ends)


def _hashes(context, a: int, b: int):
    buffer, starts, ends = context
    return hash_words(buffer, starts[a:b], ends[a:b])


def _content(context, start, stop):
    buffer, starts, ends = context
    sizes = ends[stop - 1] + 1 - starts[start]
    return gather(buffer, starts[start], sizes).tobytes(), sizes


def _digest(ids, removed, sizes, base, context):
    import numpy as np
    import pyarrow as pa

    buffer, starts, ends = context
    total = np.concatenate([[0], np.cumsum(removed)])
    hashes = []
    for b, n in zip(base.tolist(), sizes.tolist(), strict=True):
        kept = b + np.flatnonzero(~removed[b : b + n])
        hashes.append(hashlib.sha256(gather(buffer, starts[kept], ends[kept] + 1 - starts[kept]).tobytes()[:-1]).hexdigest())
    columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(total[base + sizes] - total[base], pa.int64()), pa.array(hashes, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in DIGESTS.split(", ")])


def ranks_of(numbers, end):
    """Ranks of the first 1, 2, 4, … words of each suffix, and their order; a suffix stops at its `end`.

    Prefix doubling: the order of twice as many words is that of pairs of ranks. Equal ranks mean
    equal words, or equal suffixes that stop.
    """
    import numpy as np

    n = len(numbers)
    most = int((end - np.arange(n)).max(initial=1))
    ranks, size = [numbers.astype(np.int64) + 1], 1
    while size < most:
        behind = np.arange(n) + size
        low = np.where(behind < end, ranks[-1][np.minimum(behind, n - 1)], 0)
        _, rank = np.unique(ranks[-1] * np.int64(n + 1) + low, return_inverse=True)
        ranks.append(rank.astype(np.int64) + 1)
        size *= 2
    return ranks


def _closest(order, doc, step: int):
    """For each place of the array the closest one before (step -1) or behind (1) it with a smaller document, -1 if there is none."""
    import numpy as np

    n = len(order)
    owner = doc[order]
    at = np.arange(n) + step
    open_ = np.flatnonzero((at >= 0) & (at < n))
    open_ = open_[owner[at[open_]] >= owner[open_]]
    while len(open_):  # what a place jumped over has no smaller document either, so jumps add up
        at[open_] = at[at[open_]]
        inside = (at[open_] >= 0) & (at[open_] < n)
        open_ = open_[inside]
        open_ = open_[owner[at[open_]] >= owner[open_]]
    return np.where((at >= 0) & (at < n), at, -1)


def longest_earlier(numbers, doc, end):
    """How many words each suffix shares with that of an earlier document that shares the most."""
    import numpy as np

    n = len(numbers)
    if not n:
        return np.empty(0, np.int64)
    ranks = ranks_of(numbers, end)
    order = np.lexsort((doc, ranks[-1]))
    most = np.zeros(n, np.int64)
    for step in (-1, 1):
        found = _closest(order, doc, step)
        has = found >= 0
        a, b = order[has], order[found[has]]
        left, size = np.minimum(end[a] - a, end[b] - b), np.zeros(len(a), np.int64)
        for level in range(len(ranks) - 1, -1, -1):  # the largest power of two first
            rank = ranks[level]
            on = size < left
            i, j = np.minimum(a + size, n - 1), np.minimum(b + size, n - 1)
            same = on & (rank[i] == rank[j])
            size = np.where(same, np.minimum(size + (1 << level), left), size)
        most[a] = np.maximum(most[a], size)
    return most


def parse(ids, data: bytes, lengths, length: int = LENGTH):
    """Runs (segment, first window, windows) of duplicate windows among segments of documents `ids`."""
    import numpy as np
    import pyarrow as pa

    by = np.argsort(ids, kind="stable")
    block = gather(np.frombuffer(data, np.uint8), (np.cumsum(lengths) - lengths)[by], lengths[by])
    _, ends = places_in(block)
    bounds = np.searchsorted(ends, np.concatenate([[0], np.cumsum(lengths[by])]))
    begin, end, doc = bounds[:-1], bounds[1:], ids[by]
    sizes = end - begin
    # different words by their bytes
    numbers = pa.array(block.tobytes().split(b" ")[:-1], pa.large_binary()).dictionary_encode().indices.to_numpy()
    most = longest_earlier(numbers, np.repeat(doc, sizes), np.repeat(end, sizes))
    out = []
    active, cursor = np.flatnonzero(sizes >= length), begin.copy()
    while len(active):
        at = cursor[active]
        size = most[at]
        factor = size >= length
        count = np.where(factor, size - length + 1, 1)
        out.append((by[active[factor]], (at - begin[active])[factor], count[factor]))
        cursor[active] = at + count
        active = active[cursor[active] + length <= end[active]]
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3


def word_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", pack_bytes: int = PACK_BYTES, **more) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of `docs`."""
    return Finder(LENGTH, GRAM, SLICE, _tokens, _hashes, _content, parse, _digest, DIGESTS, pack_bytes, **more).find(docs, text, doc_id)


def op2_word_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_spans(read(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS words
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
firsts AS (SELECT words, min(doc_id) AS first FROM windows GROUP BY words HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, i + k AS i
  FROM windows JOIN firsts USING (words), generate_series(0, 12) AS g(k) WHERE first < doc_id),
each AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS words
  FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
