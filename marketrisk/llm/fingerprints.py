"""Document fingerprints from improbable features.

Every window of 32 bytes has an entropy; the rarer its entropy is among windows of prose, the better the feature.
A window that is the rarest of at least eight of the runs of 32 neighbouring windows around it is selected.  Selected
features set five bits each in a Bloom filter of 2,048 bits; after 160 features the next filter of the
chain begins.  Two fingerprints are compared filter by filter by their common bits, between what chance gives
(0) and the most their bit counts allow (1).

Rarity is a fixed rule: the squared distance of the entropy from that of prose in its standard deviations.  So a
fingerprint depends on its text alone, and equal texts have equal fingerprints everywhere.

Defined cases: a null or empty text has the empty fingerprint, at likeness 1 to another empty one and 0 to all others.
A text with no selected window (short or monotonous) has its distinct windows of eight bytes as features.  Null ids
come last in the order of ids; rows of one id, or without one, are ordered by the hash of their text.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketrisk.llm.shared import materialised, text_or_empty
from marketrisk.llm.textbytes import CHUNK_BYTES, mix

WINDOW, NEIGHBOURS, POPULAR = 32, 32, 8
FILTER_BITS, PER_FILTER, PER_FEATURE = 2048, 160, 5
#: Entropy of windows of prose, in bits: mean, standard deviation, and the least of a telling window.
PROSE_MEAN, PROSE_SPREAD, LEAST_ENTROPY = 3.7, 0.25, 1.5
_SCALE = 1 << 12
_U = np.uint64


def _rarity() -> tuple[np.ndarray, np.ndarray]:
    """(gain of the sum of n log2 n when a count of k grows by one, rarity by the scaled sum); -1 marks weak windows."""
    n = np.arange(WINDOW + 1, dtype=float)
    total = n * np.log2(np.maximum(n, 1))
    gains = np.round(np.diff(total) * _SCALE).astype(np.int32)
    entropy = np.log2(WINDOW) - np.arange(int(gains.sum()) + 1) / _SCALE / WINDOW
    rarity = np.minimum(np.round(((entropy - PROSE_MEAN) / PROSE_SPREAD) ** 2 * 100), 60_000).astype(np.int64)
    rarity[entropy < LEAST_ENTROPY] = -1
    return gains, rarity


_GAINS, _RARITY = _rarity()


def window_rarity(data: np.ndarray) -> np.ndarray:
    """Rarity of the window that starts at each byte; the last ``WINDOW - 1`` starts are left out.

    The sum of n log2 n over a window's byte counts changes, from one window to the next, by the gain of the entering byte's
    count and the loss of the leaving one's, both of which are counts of equal bytes at distances below the window.
    """
    before = np.zeros(len(data), np.uint8)
    after = np.zeros(len(data), np.uint8)
    for d in range(1, WINDOW):
        same = (data[d:] == data[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    change = _GAINS[before]
    change[WINDOW:] -= _GAINS[after[:-WINDOW]]
    return _RARITY[np.cumsum(change)[WINDOW - 1 :]]


def selected(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the selected windows of a chunk of texts that lie behind one another in ``data``."""
    if len(data) < WINDOW + NEIGHBOURS - 1:
        return np.empty(0, np.int64)
    rarity = window_rarity(data)
    least = ((np.int64(1 << 20) - rarity) << 32) | np.arange(len(rarity))
    width = 1
    while width < NEIGHBOURS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    # a run of neighbours counts if its last window still ends inside the text of its first
    begins = np.arange(len(least))
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    inside = begins + NEIGHBOURS - 1 + WINDOW <= ends
    rarest = (least[inside] & np.int64(0xFFFFFFFF)).astype(np.int64)
    votes = np.bincount(rarest, minlength=len(rarity))
    return np.flatnonzero((votes >= POPULAR) & (rarity >= 0))


def short_features(text: bytes) -> np.ndarray:
    """Distinct windows of eight bytes by first place; the whole text if it is shorter."""
    if len(text) < 8:
        text = text.ljust(8, b"\0")
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), 8)
    found, first = np.unique(np.ascontiguousarray(windows).view(np.uint64).ravel(), return_index=True)
    return mix(found[np.argsort(first)])


def fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    """Filters of each text, a matrix of 0 and 1 of ``FILTER_BITS`` columns; no row for an empty text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    starts = selected(data, offsets)
    owner = np.searchsorted(offsets, starts, "right") - 1
    if len(starts):
        words = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[starts].view(np.uint64)
        hashes = np.zeros(len(starts), np.uint64)
        for k in range(words.shape[1]):
            hashes = mix(hashes * _U(31) + words[:, k])
    else:
        hashes = np.empty(0, np.uint64)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for k, text in enumerate(texts):
        own = hashes[bounds[k] : bounds[k + 1]]
        if not len(own) and text:
            own = short_features(text)
        filters = np.zeros((-(-len(own) // PER_FILTER), FILTER_BITS), np.uint8)
        chain = np.arange(len(own)) // PER_FILTER
        for j in range(PER_FEATURE):
            filters[chain, ((own >> _U(11 * j)) % _U(FILTER_BITS)).astype(np.int64)] = 1
        out.append(filters)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Mean, over the filters of the shorter chain, of the best match among the other's, weighted by bit counts."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    x, y = a.astype(np.float32), b.astype(np.float32)
    own, other = x.sum(axis=1), y.sum(axis=1)
    common = x @ y.T
    chance = np.outer(own, other) / FILTER_BITS
    most = np.minimum.outer(own, other)
    room = np.maximum(most - chance, 1e-9)
    score = np.where(common >= np.maximum.outer(own, other), 1.0, np.clip((common - chance) / room, 0, 1))
    return float(np.average(score.max(axis=1), weights=own))


def written(filters: np.ndarray) -> str:
    """Lowercase hex of the filters, one after another."""
    return np.packbits(filters, axis=1).tobytes().hex()


def edited(text: str, following: str) -> str:
    """The text with its last third of code points replaced by as many first ones of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def in_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """Rows with ``_block`` and ``_tail``: blocks of neighbours by falling id and text hash; each ends with a copy of the next one's first row.

    The blocks' bounds and first rows' keys are one row per block, not per row; texts are shuffled once.  An id that many rows share
    is many bounds at once: its rows, like those without an id, are spread over as many blocks along their hashes.
    """
    levels = [k / blocks for k in range(1, blocks)]
    bounds = docs.agg(F.percentile_approx("doc_id", levels or [0.5], max(10_000, 20 * blocks)).alias("_bounds"))
    step = max(1, int(blocks**0.5))

    def bounds_with(test: Callable[[Column], Column]) -> Column:
        """How many bounds pass: first among every step-th one, then among the step that follows."""
        coarse = F.size(F.filter("_coarse", test))
        fine = F.filter(F.slice("_bounds", F.greatest((coarse - 1) * step + 1, F.lit(1)), step), test)
        return F.coalesce(F.when(coarse == 0, 0).otherwise((coarse - 1) * step + F.size(fine)), F.lit(0))

    def along_hash(count: Column) -> Column:
        """0 to count - 1, rising with the hash."""
        return F.shiftright((F.shiftright("_hash", 40) + F.lit(1 << 23)) * count, 24)

    bounds = bounds.select("_bounds", F.filter("_bounds", lambda x, i: i % step == 0).alias("_coarse"))
    upto, under = bounds_with(lambda x: x <= F.col("doc_id")), bounds_with(lambda x: x < F.col("doc_id"))
    placed = docs.withColumn("_hash", F.xxhash64("text")).join(F.broadcast(bounds))
    placed = placed.withColumns({"_upto": upto, "_under": under})
    with_id = blocks - F.col("_upto") + along_hash(F.greatest(F.col("_upto") - F.col("_under"), F.lit(1)))
    block = F.when(F.col("doc_id").isNull(), blocks + 1 + along_hash(F.lit(blocks))).otherwise(with_id)
    placed = placed.withColumn("_block", block.cast("int")).drop("_bounds", "_coarse", "_upto", "_under")
    # the greatest id and, among equal ones, the least hash
    firsts = placed.groupBy("_block").agg(F.max(F.struct("doc_id", F.bitwise_not("_hash").alias("not"))).alias("_first"))
    along = Window.orderBy("_block")
    end = F.max("_block").over(Window.partitionBy())
    tails = firsts.select(
        F.col("_first.doc_id").alias("_first_id"),
        F.bitwise_not("_first.not").alias("_first_hash"),
        F.coalesce(F.lag("_block").over(along), end).alias("_of"),
    )
    is_first = F.col("doc_id").eqNullSafe(F.col("_first_id")) & (F.col("_hash") == F.col("_first_hash"))
    marked = placed.join(F.broadcast(materialised(tails)), is_first, "left")
    own = F.struct(F.col("_block").alias("block"), F.lit(False).alias("tail"))
    copy = F.struct(F.col("_of").alias("block"), F.lit(True).alias("tail"))
    both = F.when(F.col("_of").isNull(), F.array(own)).otherwise(F.array(own, copy))
    return marked.select("doc_id", "text", F.explode(both).alias("_at")).select(
        "doc_id", "text", F.col("_at.block").alias("_block"), F.col("_at.tail").alias("_tail")
    )


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited text, and their likeness to each other and to the next text."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    order = ["_block", "_tail", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text"]
    ordered = in_blocks(plain, 4 * partitions).repartition(partitions, "_block").sortWithinPartitions(*order)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        size, block = 0, None

        def finish(following: str) -> pa.RecordBatch:
            texts = [t for _, t in held] + [following]
            changed = [edited(t, n) for t, n in zip(texts, texts[1:], strict=False)]
            raw = [t.encode() for t in changed]
            prints = fingerprints([t.encode() for t in texts])
            changed_prints = fingerprints(raw)
            columns = [
                pa.array([i for i, _ in held], pa.int64()),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in raw]),
                pa.array([written(p) for p in prints[:-1]], pa.string()),
                pa.array([written(p) for p in changed_prints], pa.string()),
                pa.array([likeness(p, q) for p, q in zip(prints, changed_prints, strict=False)], pa.float64()),
                pa.array([likeness(p, q) for p, q in zip(prints, prints[1:], strict=False)], pa.float64()),
            ]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=NAMES)

        for batch in batches:
            ids, texts, at, tail = (batch.column(k) for k in range(4))
            for k in range(batch.num_rows):
                text = texts[k].as_py()
                if tail[k].as_py():
                    # only the first of the copied rows follows the block's last row
                    if held and at[k].as_py() == block:
                        yield finish(text)
                        size = 0
                    continue
                block = at[k].as_py()
                if size >= CHUNK_BYTES:
                    yield finish(text)
                    size = 0
                held.append((ids[k].as_py(), text))
                size += len(text)

    return ordered.mapInArrow(compare, SCHEMA)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
