"""Language-model scores from a log-frequency Bloom filter.

Training counts words and word pairs.  A pair seen c times enters the filter at the levels 1 to 1 + floor(log2 c);
membership probes of rising levels, until one fails, give its count back to within a factor of two.  A pair's probability
interpolates that count over its first word's with the word's own smoothed share; the text's probability is an even
mixture of several interpolation weights, so a text without known pairs loses at most the mixture's constant
against single words.  Word counts are exact.

The filter and the word counts lie in segments by hash, one per few megabytes of training text, built by one shuffle.
If all segments together are at most ``max_broadcast`` bytes, they are broadcast to the workers.  Beyond that, the distinct keys of
each chunk of documents travel to their segments and the answers travel back; both ways give the same scores.

Defined cases: a null or empty text is the end token alone.  A null id belongs to the training part.  Repeated rows
count and are scored each.  An empty table gives an empty table; with no training text at all every word is unknown.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketrisk.llm.shared import materialised, text_or_empty
from marketrisk.llm.textbytes import chunks, mix, pair_hashes, utf8, word_hashes

FOLDS, HELD_OUT = 7, 2
BITS_PER_ENTRY, PROBES = 14, 10
SEGMENT_TEXT = 4 << 20
MAX_BROADCAST = 512 << 20
FLUSH_WORDS = 1_000_000
#: Interpolation weights of the pair model, evenly mixed over whole texts.
WEIGHTS = (0.0, 0.1, 0.4, 0.7, 0.95)
_U = np.uint64
START, END = mix(np.array([1001, 1002], np.uint64))


def held_out(doc_id: Column) -> Column:
    remainder = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS
    return doc_id.isNotNull() & (remainder == HELD_OUT)


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    """Segment by the keys' top bits: rising with the key, so sorted keys are sorted by segment."""
    return ((keys >> _U(32)) * _U(segments) >> _U(32)).astype(np.int64)


def levels(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 count)."""
    return np.frexp(counts.astype(np.float64))[1]


def _probe_base(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    first = mix(keys + _U(level * 0x9E3779B97F4A7C15 % 2**64))
    return first, mix(first) | _U(1)


def build_bits(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bloom bits of one segment, packed; sized by its entries over all levels."""
    top = levels(counts)
    size = max(64, -(-int(top.sum()) * BITS_PER_ENTRY // 64) * 64)
    bits = np.zeros(size, bool)
    for level in range(1, int(top.max(initial=0)) + 1):
        at, stride = _probe_base(keys[top >= level], level)
        for _ in range(PROBES):
            bits[(at % _U(size)).astype(np.int64)] = True
            at += stride
    return np.packbits(bits)


@dataclass
class Segments:
    """Word counts and filter bits of consecutive segments; ``starts`` gives where each segment's bits begin."""

    segments: int
    first: int
    words: np.ndarray
    counts: np.ndarray  # up to 254 in a byte; 255 points to the few large ones
    large_at: np.ndarray
    large: np.ndarray
    bits: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, rows: Iterable[tuple], sizes: list[tuple[int, int, int]], segments: int, first: int, last: int) -> Segments:
        """From rows of (segment, words, counts, bits) in any order, one at a time; ``sizes`` holds each segment's
        number of words and bytes of bits.  Absent segments are empty."""
        n_words, n_bytes = np.zeros(last - first, np.int64), np.full(last - first, 8, np.int64)
        for segment, words, length in sizes:
            n_words[segment - first], n_bytes[segment - first] = words, length
        word_at, starts = (np.concatenate([[0], np.cumsum(n)]) for n in (n_words, n_bytes))
        words, small = np.empty(word_at[-1], np.uint64), np.empty(word_at[-1], np.uint8)
        bits = np.zeros(starts[-1], np.uint8)
        large = []
        for segment, some_words, counts, some_bits in rows:
            k = segment - first
            own = np.frombuffer(counts, np.int64)
            words[word_at[k] : word_at[k + 1]] = np.frombuffer(some_words, np.uint64)
            small[word_at[k] : word_at[k + 1]] = np.minimum(own, 255)
            bits[starts[k] : starts[k + 1]] = np.frombuffer(some_bits, np.uint8)
            over = np.flatnonzero(own >= 255)
            large.append((word_at[k] + over, own[over]))
        large.sort(key=lambda pair: pair[0][0] if len(pair[0]) else -1)
        none = np.empty(0, np.int64)
        large_at, large_counts = (np.concatenate([none, *[pair[j] for pair in large]]) for j in (0, 1))
        return cls(segments, first, words, small, large_at, large_counts, bits, starts)

    def word_counts(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.words, keys), len(self.words) - 1)
        found = np.where(self.words[at] == keys, self.counts[at], 0).astype(np.int64)
        over = np.flatnonzero(found == 255)
        found[over] = self.large[np.searchsorted(self.large_at, at[over])]
        return found

    def pair_levels(self, keys: np.ndarray) -> np.ndarray:
        """The highest level up to which every level's probes succeed."""
        found = np.zeros(len(keys), np.int8)
        segment = segment_of(keys, self.segments) - self.first
        base = self.starts[segment].astype(np.uint64) * _U(8)
        size = (self.starts[segment + 1] - self.starts[segment]).astype(np.uint64) * _U(8)
        alive = np.arange(len(keys))
        level = 0
        while len(alive):
            level += 1
            at, stride = _probe_base(keys[alive], level)
            for _ in range(PROBES):
                bit = base[alive] + at % size[alive]
                hit = (self.bits[(bit >> _U(3)).astype(np.int64)] >> (7 - (bit & _U(7)).astype(np.uint8))) & 1 == 1
                alive, at, stride = alive[hit], at[hit] + stride[hit], stride[hit]
                if not len(alive):
                    break
            found[alive] = level
        return found


@dataclass
class Chunk:
    """Tokens of a chunk of texts: each text's words and an end; the context of the first is the start."""

    tokens: np.ndarray
    contexts: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Chunk:
        words, before = word_hashes(data, offsets)
        docs = len(before) - 1
        tokens = np.insert(words, before[1:], END)
        contexts = np.insert(words, before[:-1], START)
        return cls(tokens, contexts, before[:-1] + np.arange(docs))


def score_chunk(chunk: Chunk, total: int, types: int, word_counts, pair_levels) -> dict[str, np.ndarray]:
    """Per text: tokens, known tokens, base and model log10 probability; lookups are functions of distinct keys."""
    keys, where = np.unique(chunk.tokens, return_inverse=True)
    known = word_counts(keys)
    c = known[where]
    # the context of a token is the token before it; the start is as frequent as the end
    before = np.empty_like(c)
    before[1:] = c[:-1]
    before[chunk.first] = word_counts(np.array([END]))[0]
    single = (c + 1) / (total + types + 1)
    share = np.zeros(len(c))
    seen = np.flatnonzero((c > 0) & (before > 0))
    pairs, back = np.unique(pair_hashes(chunk.contexts[seen], chunk.tokens[seen]), return_inverse=True)
    level = pair_levels(pairs)[back]
    count = np.where(level > 0, np.exp2(level.astype(np.float64) - 1), 0.0)
    share[seen] = np.minimum(count, np.minimum(c[seen], before[seen])) / before[seen]
    sums = [np.add.reduceat(np.log10(w * share + (1 - w) * single), chunk.first) for w in WEIGHTS]
    logs = np.stack(sums)
    top = logs.max(axis=0)
    ends = np.append(chunk.first[1:], len(c))
    return {
        "n_tokens": ends - chunk.first,
        "n_known": np.add.reduceat((c > 0).astype(np.int64), chunk.first),
        "base_score": np.add.reduceat(np.log10(single), chunk.first),
        "score": top + np.log10(np.mean(10 ** (logs - top), axis=0)),
    }


def _counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with summed counts."""
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    all_keys, all_counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(all_keys)
    all_keys, all_counts = all_keys[order], all_counts[order]
    first = np.flatnonzero(np.append(True, all_keys[1:] != all_keys[:-1]))
    return all_keys[first], np.add.reduceat(all_counts, first)


def trained(docs: DataFrame) -> DataFrame:
    """Written table of segments from the column ``text``: words, counts, bits (packed), n_types, n_tokens."""
    text = text_or_empty()
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    segments = 1 + size // SEGMENT_TEXT

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {"word": [], "pair": []}
        waiting = 0

        def flush() -> pa.RecordBatch:
            rows = []
            for kind, found in held.items():
                keys, counts = _counted([k for k, _ in found], [n for _, n in found])
                bounds = np.searchsorted(segment_of(keys, segments), np.arange(segments + 1))
                for s in np.flatnonzero(np.diff(bounds)):
                    own = slice(bounds[s], bounds[s + 1])
                    rows.append((int(s), kind, keys[own].tobytes(), counts[own].astype(np.uint32).tobytes()))
                found.clear()
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.binary(), pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, names=["segment", "kind", "keys", "counts"])

        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for a, b in chunks(offsets):
                chunk = Chunk.of(data, offsets[a : b + 1])
                for kind, keys in (("word", chunk.tokens), ("pair", pair_hashes(chunk.contexts, chunk.tokens))):
                    held[kind].append(np.unique(keys, return_counts=True))
                waiting += len(chunk.tokens)
                if waiting >= FLUSH_WORDS:
                    waiting = 0
                    yield flush()
        yield flush()

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        def of(kind: str) -> tuple[np.ndarray, np.ndarray]:
            own = rows[rows["kind"] == kind]
            return _counted(
                [np.frombuffer(k, np.uint64) for k in own["keys"]],
                [np.frombuffer(n, np.uint32).astype(np.int64) for n in own["counts"]],
            )

        words, counts = of("word")
        bits = build_bits(*of("pair"))
        return pd.DataFrame(
            {
                "segment": [key[0]],
                "words": [words.tobytes()],
                "counts": [counts.tobytes()],
                "bits": [bits.tobytes()],
                "n_types": [len(words)],
                "n_tokens": [int(counts.sum())],
            }
        )

    parts = docs.select(text.alias("text")).mapInArrow(gather, "segment long, kind string, keys binary, counts binary")
    table = parts.groupBy("segment").applyInPandas(
        build, "segment long, words binary, counts binary, bits binary, n_types long, n_tokens long"
    )
    return materialised(table.withColumn("segments", F.lit(segments)))


def _plain(known: Segments) -> tuple:
    """Numbers and arrays only: workers unpickle them without this library."""
    return tuple(getattr(known, f.name) for f in fields(Segments))


OUTPUTS = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
SCORES = "n_tokens long, n_known long, base_score double, score double"


def scored(docs: DataFrame, model: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The columns of ``docs`` other than ``text``, with n_tokens, n_known, train_tokens, base_score and score added or replaced."""
    total, types, size, segments = model.agg(
        F.coalesce(F.sum("n_tokens"), F.lit(0)),
        F.coalesce(F.sum("n_types"), F.lit(0)),
        F.coalesce(F.sum(F.octet_length("words") + F.octet_length("counts") + F.octet_length("bits")), F.lit(0)),
        F.coalesce(F.max("segments"), F.lit(1)),
    ).first()
    way = _by_broadcast if size <= max_broadcast else _by_exchange
    docs = docs.drop(*OUTPUTS)
    return way(docs, model, total, types, segments).withColumn("train_tokens", F.lit(total).cast("long"))


def _by_broadcast(docs: DataFrame, model: DataFrame, total: int, types: int, segments: int) -> DataFrame:
    sizes = [tuple(r) for r in model.select("segment", "n_types", F.octet_length("bits")).collect()]
    rows = (tuple(r) for r in model.select("segment", "words", "counts", "bits").toLocalIterator())
    shared = docs.sparkSession.sparkContext.broadcast(_plain(Segments.of(rows, sizes, segments, 0, segments)))
    others = [c for c in docs.columns if c != "text"]
    ordered = docs.select(*[F.col(f"`{c}`") for c in others], text_or_empty().alias("text"))
    schema = ordered.drop("text").schema
    for name in ("n_tokens", "n_known"):
        schema = schema.add(name, "long")
    schema = schema.add("base_score", "double").add("score", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Segments(*shared.value)
        for batch in batches:
            data, offsets = utf8(batch.column(len(others)))
            for a, b in chunks(offsets):
                chunk = Chunk.of(data, offsets[a : b + 1])
                values = score_chunk(chunk, total, types, known.word_counts, known.pair_levels)
                kept = batch.slice(a, b - a).columns[: len(others)]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(v) for v in values.values()]], names=schema.names)

    return ordered.mapInArrow(score, schema)


def _by_exchange(docs: DataFrame, model: DataFrame, total: int, types: int, segments: int) -> DataFrame:
    """Requests of each chunk of documents go to the segments, answers come back; nothing is broadcast."""
    others = [c for c in docs.columns if c != "text"]
    text = text_or_empty()
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in others], text), F.lit(1 + size // SEGMENT_TEXT))
    chunked = docs.select(*[F.col(f"`{c}`") for c in others], text.alias("text"), spread.alias("_chunk"))

    def whole(texts: pd.Series) -> Chunk:
        return Chunk.of(*utf8(pa.array(texts, pa.large_string())))

    def keys_of(chunk: Chunk) -> dict[str, np.ndarray]:
        tokens = np.unique(np.append(chunk.tokens, END))
        return {"word": tokens, "pair": np.unique(pair_hashes(chunk.contexts, chunk.tokens))}

    def ask(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind, keys in keys_of(whole(rows["text"])).items():
            bounds = np.searchsorted(segment_of(keys, segments), np.arange(segments + 1))
            out += [
                (int(s), key[0], kind, keys[bounds[s] : bounds[s + 1]].tobytes()) for s in np.flatnonzero(np.diff(bounds))
            ]
        return pd.DataFrame(out, columns=["segment", "_chunk", "kind", "keys"])

    def answer(key: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        rows = list(held[["segment", "words", "counts", "bits"]].itertuples(index=False, name=None))
        sizes = [(s, len(words) // 8, len(bits)) for s, words, _, bits in rows]
        own = Segments.of(rows, sizes, segments, key[0], key[0] + 1)
        told = [
            (own.word_counts(k) if kind == "word" else own.pair_levels(k).astype(np.int64)).tobytes()
            for kind, k in zip(asked["kind"], [np.frombuffer(k, np.uint64) for k in asked["keys"]], strict=True)
        ]
        return asked.assign(told=told)

    def finish(key: tuple, rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        told = told.sort_values("segment")

        def lookup(kind: str):
            own = told[told["kind"] == kind]
            keys = np.frombuffer(b"".join(own["keys"]), np.uint64)
            values = np.frombuffer(b"".join(own["told"]), np.int64)
            return lambda wanted: values[np.searchsorted(keys, wanted)] if len(wanted) else np.empty(0, np.int64)

        values = score_chunk(whole(rows["text"]), total, types, lookup("word"), lookup("pair"))
        return rows[others].assign(**values)

    asked = chunked.groupBy("_chunk").applyInPandas(ask, "segment long, _chunk long, kind string, keys binary")
    told = (
        asked.groupBy("segment")
        .cogroup(model.groupBy("segment"))
        .applyInPandas(answer, "segment long, _chunk long, kind string, keys binary, told binary")
    )
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in chunked.select(*others).schema] + [SCORES])
    return chunked.groupBy("_chunk").cogroup(told.groupBy("_chunk")).applyInPandas(finish, schema)
