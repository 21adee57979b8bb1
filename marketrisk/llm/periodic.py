"""Periodic runs of words in texts, and texts with their repetitions collapsed.

A run is a stretch of words with smallest period q (words q apart are identical), at least twice q long, that no
neighbouring word extends.  The suffixes of a text are sorted, and the links between neighbours in that order taken
by falling length of their common prefix.  Each link unites two classes of positions (union-find; every class keeps
its positions in order, the smaller goes into the larger).  When two positions become neighbours within a class, at a
distance of at most the common length, the text between them repeats there: they seed a run, of which the first such
pair gives start, length and smallest period at once.  (Were a position between them in the class, a smaller period
would hold; were the word before both equal, an earlier pair would have been the start.)

A run of at least twelve words has a common prefix of at least six, so only positions whose six words occur again in
the text are sorted; most texts have none.  Texts do not meet: the operator is a map without a shuffle.

Defined cases: null and empty texts have no words, no runs and an empty collapsed text; repeated rows are rows like
others; a text may be of any length, one text is work for one task; other columns are kept, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketrisk.llm.shared import free_name

#: Words a run has at least, and the common prefix that follows from it.
LEAST_RUN, LEAST_PREFIX = 12, 6
FOUND = "n_words long, runs array<struct<start long, length long, period long>>, text string"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words, equal numbers."""
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def repeated(numbers: np.ndarray, width: int = LEAST_PREFIX) -> np.ndarray:
    """Positions whose ``width`` numbers may occur again elsewhere (all that do, and few others)."""
    n = len(numbers) - width + 1
    if n < 2:
        return np.empty(0, np.int64)
    hashes = np.zeros(n, np.uint64)
    for k in range(width):
        hashes = hashes * _FACTOR + numbers[k : k + n].astype(np.uint64)
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.empty(0, np.int64)
    places = np.searchsorted(twice, hashes)
    return np.flatnonzero(twice[np.minimum(places, len(twice) - 1)] == hashes)


def suffix_links(numbers: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions ``at`` in the order of their suffixes, common prefix of each with the one before; 0 for the first).

    Ranks by the first 1, 2, 4, ... words; a position whose rank is its own is not looked at again.  A common prefix
    is the sum of the powers of two at which ranks agree, from the greatest down.
    """
    n = len(numbers)
    levels, width = [numbers], 1
    while width < LEAST_PREFIX:
        follow = np.concatenate([levels[-1][width:] + 1, np.zeros(min(width, n), np.int64)])
        levels.append(np.unique(levels[-1] * (n + 2) + follow, return_inverse=True)[1].astype(np.int64))
        width *= 2
    # From here a rank is the number of suffixes with a lower one, so that the members of a rank can share its room.
    size = np.bincount(levels[-1])
    levels[-1] = (np.cumsum(size) - size)[levels[-1]]
    active = at[np.bincount(levels[-1], minlength=n)[levels[-1][at]] > 1]
    while len(active):
        old = levels[-1][active]
        follow = np.where(active + width < n, levels[-1][np.minimum(active + width, n - 1)] + 1, 0)
        key = old * (n + 2) + follow
        order = np.argsort(key, kind="stable")
        active, key, old = active[order], key[order], old[order]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        place = np.arange(len(active))
        begin = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), place, 0))
        rank = levels[-1].copy()
        rank[active] = old + np.maximum.accumulate(np.where(fresh, place, 0)) - begin
        levels.append(rank)
        width *= 2
        group = np.cumsum(fresh) - 1
        active = active[np.bincount(group)[group] > 1]
    order = at[np.argsort(levels[-1][at], kind="stable")]
    left, right = order[:-1].copy(), order[1:].copy()
    common = np.zeros(len(left), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (left < n) & (right < n)
        same = inside & (levels[k][np.minimum(left, n - 1)] == levels[k][np.minimum(right, n - 1)])
        step = same.astype(np.int64) << k
        common, left, right = common + step, left + step, right + step
    return order, np.concatenate([[0], common])


def runs(numbers: np.ndarray, least: int = LEAST_RUN) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``least`` words (twelve or more), by start, then period."""
    at = repeated(numbers)
    if not len(at):
        return []
    order, common = suffix_links(numbers, at)
    links = np.flatnonzero(common >= LEAST_PREFIX)
    links = links[np.argsort(-common[links], kind="stable")]
    word, parent, members, found = numbers.tolist(), {}, {}, []

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    firsts, seconds, lengths = order[links - 1].tolist(), order[links].tolist(), common[links].tolist()
    for a, b, length in zip(firsts, seconds, lengths, strict=True):
        a, b = root(a), root(b)
        small, large = members.pop(a, None) or [a], members.pop(b, None) or [b]
        if len(small) > len(large):
            a, b, small, large = b, a, large, small
        parent[a] = b
        nearest = []  # new neighbours: a position and the next one of the other class
        low = 0
        for k, x in enumerate(small):
            low = bisect_left(large, x, low)
            if low and (not k or small[k - 1] < large[low - 1]):
                nearest.append((large[low - 1], x))
            if low < len(large) and (k + 1 == len(small) or small[k + 1] > large[low]):
                nearest.append((x, large[low]))
        for i, j in nearest:
            period = j - i
            if period <= length and period + length >= least and (not i or word[i - 1] != word[j - 1]):
                found.append((i, period + length, period))
        if large[-1] < small[0]:
            large += small
        elif 8 * len(small) < len(large):
            for x in small:
                large.insert(bisect_left(large, x), x)
        else:
            large = sorted(large + small)
        members[b] = large
    return sorted(found, key=lambda run: (run[0], run[2]))


def kept_words(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run contains after its first period."""
    if not found:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [w for w, covered in zip(words, np.cumsum(edges[:-1]).tolist(), strict=True) if not covered]


def collapsed(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """(``docs`` with a column of structs, that column's name).

    The struct holds ``n_words``, ``runs`` (start, length and period in words, by start, then period) and ``text``,
    the words that are kept joined by one space.
    """
    name = free_name(docs, "_periodic")
    schema = T.StructType([*docs.schema.fields]).add(name, T.StructType.fromDDL(FOUND))
    place = docs.columns.index(text)
    run_fields = [pa.field(f, pa.int64()) for f in ("start", "length", "period")]

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sizes, flat, texts = [], [0], [], []
            for value in batch.column(place):
                words = (value.as_py() or "").encode().split()
                found = runs(word_numbers(words)) if len(words) >= LEAST_RUN else []
                counts.append(len(words))
                flat += found
                sizes.append(len(flat))
                texts.append(b" ".join(kept_words(words, found)))
            numbers = np.array(flat, np.int64).reshape(-1, 3)
            structs = pa.StructArray.from_arrays([pa.array(numbers[:, k]) for k in range(3)], fields=run_fields)
            listed = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), structs)
            result = pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), listed, pa.array(texts, pa.binary()).cast(pa.string())],
                names=["n_words", "runs", "text"],
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, result], names=schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns]).mapInArrow(collapse, schema), name
