"""Near duplicates by b-bit MinHash.

A document's distinct word shingles give 128 minima.  Bands of four minima propose candidates; of every minimum
only two bits are kept, packed into four longs, and the bits that differ between two packed signatures,
corrected for chance collisions, estimate their similarity.  What the estimate cannot rule out is confirmed on the full
shingle sets, so every link is exact.

A second sketch rules pairs out for certain: every shingle flips one of 1,024 bits, so two sets differ in at least
as many shingles as their flips differ in bits, and may differ in no more than a ninth of their sizes' sum.

Documents of equal shingle sets are one class.  A bucket of a band, which may hold any share of all classes,
is never expanded into all its pairs:

1. every class is compared with the nearest of its buckets' leaders; leaders differ from band to band;
2. twice, every class outside its buckets' largest components is compared with the nearest of a few members of these;
3. what pairs between different components then remain possible are all confirmed.

A pair inside one component needs no confirmation, as it cannot change the result.  A pair at similarity
0.8 shares no band with probability (1 - 0.8^4)^32 = 5e-8; the estimate's margin is 4.5 of its standard deviations.

Defined cases: null and empty texts and texts without words have an empty set and are linked with nothing.  Repeated
rows and repeated or null ids are rows like others: nodes are rows, not ids.  An empty table gives an
empty table.  Other columns pass through ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketrisk.llm.components import merged
from marketrisk.llm.shared import materialised, scratch
from marketrisk.llm.textbytes import chunks, mix, pair_hashes, utf8, word_hashes

BANDS, ROWS, BITS = 32, 4, 2
MINIMA = BANDS * ROWS
#: Links: 100 * intersection >= SIMILAR * union.
SIMILAR = 80
#: Standard deviations below the threshold at which an estimate rules a pair out.
MARGIN = 4.5
#: Most rows of ids that are broadcast (eight bytes each); beyond it the join is shuffled.
BROADCAST_ROWS = 4_000_000
#: Bits of the flip sketch; members of its largest component that a bucket offers in a round, and rounds.
FLIP_BITS = 1024
PIVOTS, PIVOT_ROUNDS = 4, 2
#: Half of the buckets propose in the first steps; the last step takes all of them.
PROPOSING = "pmod(bucket, 2) = 0"
SEED = 5
SKETCH = [*[f"s{k}" for k in range(MINIMA * BITS // 64)], *[f"f{k}" for k in range(FLIP_BITS // 64)]]
_U = np.uint64


def shingles(words: np.ndarray, before: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the distinct shingles of a chunk of texts, ordered by text, then hash.

    A text of fewer words than ``size`` has its whole word sequence as one shingle.
    """
    counts = np.diff(before)
    text_of = np.repeat(np.arange(len(counts)), counts)
    keys, owners = [], []
    rolled = words
    for k in range(1, size + 1):
        if k > 1:
            rolled = pair_hashes(rolled[:-1], words[k - 1 :])
        starts = np.arange(len(rolled))
        owner = text_of[: len(rolled)]
        if k < size:  # whole sequences of k words
            own = starts[(counts[owner] == k) & (before[owner] == starts)] if len(rolled) else starts
        else:
            own = starts[before[owner + 1] - starts >= size] if len(rolled) else starts
        keys.append(rolled[own])
        owners.append(owner[own])
        if not len(rolled):
            break
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    first = np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])) if len(key) else np.empty(0, bool)
    return key[first], owner[first]


def signatures(keys: np.ndarray, owners: np.ndarray, texts: int) -> tuple[np.ndarray, ...]:
    """(set size, two hashes of the set, packed two-bit signature and flips, band keys) per text; zeros without shingles."""
    sizes = np.bincount(owners, minlength=texts)
    some = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[some]
    hashes = np.zeros((2, texts), np.uint64)
    packed = np.zeros((len(SKETCH), texts), np.uint64)
    bands = np.zeros((texts, BANDS), np.uint64)
    if len(some):
        rng = np.random.default_rng(SEED)
        factors = rng.integers(0, 2**63, MINIMA, dtype=np.uint64) * _U(2) + _U(1)
        shifts = rng.integers(0, 2**63, MINIMA, dtype=np.uint64)
        for row, salt in enumerate((0x1B873593, 0x2545F491)):
            hashes[row, some] = np.add.reduceat(mix(keys ^ _U(salt)), starts)
        flips = mix(keys ^ _U(0x7F4A7C15)) % _U(FLIP_BITS)
        odd = np.bincount(owners * FLIP_BITS + flips.astype(np.int64), minlength=texts * FLIP_BITS).astype(np.uint8) & 1
        words = np.packbits(odd.reshape(texts, FLIP_BITS), axis=1, bitorder="little").view(np.uint64)
        packed[MINIMA * BITS // 64 :] = words.T
        per = 64 // BITS
        held = np.empty(len(keys), np.uint64)
        for j in range(MINIMA):
            np.multiply(keys, factors[j], out=held)
            held += shifts[j]
            least = np.minimum.reduceat(held, starts)
            packed[j // per, some] |= ((least >> _U(32)) & _U(2**BITS - 1)) << _U(j % per * BITS)
            band = j // ROWS
            bands[some, band] = pair_hashes(bands[some, band] if j % ROWS else np.full(len(some), band, np.uint64), least)
    return sizes, hashes, packed, bands


def sketched(docs: DataFrame, shingle_words: int) -> DataFrame:
    """Written table of row (a struct of all columns but the text), text, _uid, n, two set hashes, packed signature, band keys."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    source = docs.select(row, "text")
    schema = T.StructType([*source.schema.fields]).add("_uid", "long").add("n", "long").add("h0", "long").add("h1", "long")
    for name in SKETCH:
        schema = schema.add(name, "long")
    schema = schema.add("bands", T.ArrayType(T.LongType()))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in chunks(offsets):
                words, before = word_hashes(data, offsets[a : b + 1])
                keys, owners = shingles(words, before, shingle_words)
                sizes, hashes, packed, bands = signatures(keys, owners, b - a)
                numbers = [np.arange(uid, uid + b - a), sizes, *hashes.view(np.int64), *packed.view(np.int64)]
                uid += b - a
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, (b - a + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(bands.view(np.int64).ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(a, b - a).columns, *[pa.array(x) for x in numbers], lists], names=schema.names
                )

    return materialised(source.mapInArrow(sketch, schema))


def estimate(side_a: str, side_b: str) -> Column:
    """Similarity of two packed signatures: share of equal minima, corrected for two-bit collisions."""
    differing = F.lit(0)
    low = F.lit(0x5555555555555555)
    for k in range(MINIMA * BITS // 64):
        x = F.col(f"{side_a}.s{k}").bitwiseXOR(F.col(f"{side_b}.s{k}"))
        either = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(low)
        differing = differing + F.bit_count(either)
    chance = 1 / 2**BITS
    return (1 - differing / MINIMA - chance) / (1 - chance)


def least_estimate(similar: int = SIMILAR) -> float:
    """The estimate below which a pair of the given similarity (in percent) practically never falls."""
    j, chance = similar / 100, 1 / 2**BITS
    match = j + (1 - j) * chance
    return j - MARGIN * (match * (1 - match) / MINIMA) ** 0.5 / (1 - chance)


def flipped(side_a: str, side_b: str) -> Column:
    """At least so many shingles are in one of the two sets only."""
    bits = F.lit(0)
    for k in range(FLIP_BITS // 64):
        bits = bits + F.bit_count(F.col(f"{side_a}.f{k}").bitwiseXOR(F.col(f"{side_b}.f{k}")))
    return bits


def possible(side_a: str, side_b: str) -> Column:
    """Neither the set sizes nor the two sketches rule the pair out."""
    n, m = F.col(f"{side_a}.n"), F.col(f"{side_b}.n")
    # shared >= s * union means: only in one <= (1 - s) / (1 + s) * (n + m)
    apart = (100 + SIMILAR) * flipped(side_a, side_b) <= (100 - SIMILAR) * (n + m)
    return (100 * F.least(n, m) >= SIMILAR * F.greatest(n, m)) & apart & (estimate(side_a, side_b) >= least_estimate())


def confirmed(pairs: DataFrame, texts: DataFrame, shingle_words: int) -> DataFrame:
    """The pairs (a, b) of classes whose full shingle sets are similar enough, and all tested pairs: (a, b, linked)."""
    texts_a = texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a"))
    texts_b = texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(texts_a, "a").join(texts_b, "b").select("a", "b", "text_a", "text_b")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = []
                for column in (2, 3):
                    keys, owners = shingles(*word_hashes(*utf8(part.column(column))), shingle_words)
                    sets.append((keys, owners))
                key = np.concatenate([k for k, _ in sets])
                owner = np.concatenate([o for _, o in sets])
                order = np.lexsort((key, owner))
                key, owner = key[order], owner[order]
                shared = np.bincount(owner[1:][(key[1:] == key[:-1]) & (owner[1:] == owner[:-1])], minlength=part.num_rows)
                union = np.bincount(owner, minlength=part.num_rows) - shared
                linked = (100 * shared >= SIMILAR * union) & (union > 0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(linked)], names=["a", "b", "linked"])

    return materialised(both.mapInArrow(test, "a long, b long, linked boolean"))


def grouped(docs: DataFrame, shingle_words: int = 2) -> DataFrame:
    """Per row of ``docs``: row (a struct of all columns but the text), text, _uid, n_shingles, component_id, and keeper:
    the _uid of its group's first row by doc_id."""
    rows = sketched(docs, shingle_words)
    with scratch(docs.sparkSession):
        per_class = materialised(classes_of(rows, shingle_words), lasting=True)
    joined = rows.select("row", "text", "_uid", "n", "h0", "h1").join(per_class, ["h0", "h1"], "left")
    linked_row = F.col("n") > 0
    return joined.select(
        "row",
        "text",
        "_uid",
        F.col("n").alias("n_shingles"),
        F.when(linked_row, F.col("whole.doc_id")).otherwise(F.col("row.doc_id")).alias("component_id"),
        F.when(linked_row, F.col("whole._uid")).otherwise(F.col("_uid")).alias("keeper"),
    )


def classes_of(rows: DataFrame, shingle_words: int) -> DataFrame:
    """h0, h1 and whole, the first row of its group, of every shingle set."""
    first = F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("doc_id"), F.col("_uid"))
    classes = (
        rows.filter("n > 0")
        .groupBy("h0", "h1")
        .agg(
            F.min(first).alias("first"),
            F.min(F.struct("_uid", "n", *SKETCH, "bands")).alias("of"),
        )
        .select("h0", "h1", "first", F.col("of._uid").alias("cls"), *[f"of.{c}" for c in ("n", *SKETCH, "bands")])
    )
    classes = materialised(classes)
    labels = linked(classes, rows, shingle_words)
    labelled = classes.select("h0", "h1", "cls", "first").join(labels, "cls", "left")
    labelled = labelled.select("h0", "h1", "first", F.coalesce("comp", "cls").alias("comp"))
    groups = labelled.groupBy("comp").agg(F.min("first").alias("whole"))
    return labelled.join(groups, "comp").select("h0", "h1", "whole")


def linked(classes: DataFrame, rows: DataFrame, shingle_words: int) -> DataFrame:
    """(cls, comp) of every class that shares a bucket with another."""
    banded = classes.select("cls", F.explode("bands").alias("bucket"))
    # leaders differ from bucket to bucket: the smallest hash of class and bucket
    leaders = (
        banded.groupBy("bucket")
        .agg(F.min(F.struct(F.xxhash64("bucket", "cls").alias("order"), F.col("cls").alias("cls"))).alias("lead"), F.count(F.lit(1)).alias("m"))
        .filter("m > 1")
        .select("bucket", F.col("lead.cls").alias("leader"))
    )
    members = materialised(banded.join(leaders, "bucket"))
    involved = materialised(members.select("cls").distinct())
    n_involved = involved.count()
    ids = F.broadcast(involved) if n_involved <= BROADCAST_ROWS else involved
    texts = materialised(rows.select(F.col("_uid").alias("cls"), "text").join(ids, "cls", "left_semi"))
    sketches = materialised(classes.select("cls", "n", *SKETCH).join(ids, "cls", "left_semi"))
    labels = involved.withColumn("comp", F.col("cls"))

    # 1: the nearest leader of each class
    led = members.filter("cls <> leader").filter(PROPOSING).select(F.col("cls").alias("a"), F.col("leader").alias("b")).distinct()
    tested = confirmed(nearest(led, sketches), texts, shingle_words)
    labels = merged(labels, tested.filter("linked"))

    # 2: the nearest of a few members of its buckets' largest components
    for turn in range(PIVOT_ROUNDS):
        offered = nearest(untested(pivoted(members, labels, turn), tested), sketches)
        found = confirmed(offered, texts, shingle_words)
        labels = merged(labels, found.filter("linked"))
        tested = tested.union(found)

    # 3: all that is left between components
    left = untested(crossing(members, labels, sketches), tested)
    return merged(labels, confirmed(left, texts, shingle_words).filter("linked"))


def nearest(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """For every a, the possible b whose flips differ least for their sizes."""
    share = flipped("x", "y") / (F.col("x.n") + F.col("y.n"))
    scored = (
        pairs.join(sketches.alias("x"), F.col("a") == F.col("x.cls"))
        .join(sketches.alias("y"), F.col("b") == F.col("y.cls"))
        .filter(possible("x", "y"))
        .select("a", "b", share.alias("share"))
    )
    return materialised(scored.groupBy("a").agg(F.min_by("b", F.struct("share", "b")).alias("b")))


def untested(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    """The distinct pairs that were not confirmed or refuted in either order."""
    known = tested.select("a", "b").union(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.select("a", "b").distinct().join(known, ["a", "b"], "left_anti")


def in_mixed_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, cls, comp and main, the bucket's largest component, of all buckets with more than one."""
    placed = members.select("bucket", "cls").join(labels, "cls")
    shares = placed.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("m"))
    mixed = (
        shares.groupBy("bucket")
        .agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.count(F.lit(1)).alias("comps"))
        .filter("comps > 1")
        .select("bucket", "main")
    )
    return materialised(placed.join(mixed, "bucket"))


def pivoted(members: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b): a class outside its bucket's largest component with each of a few members of that, by hashes."""
    inside = in_mixed_buckets(members.filter(PROPOSING), labels)
    chosen = [
        F.min(F.struct(F.xxhash64(F.lit(turn * PIVOTS + k), "bucket", "cls").alias("order"), F.col("cls")))["cls"]
        for k in range(PIVOTS)
    ]
    pivots = inside.filter("comp = main").groupBy("bucket").agg(F.array_distinct(F.array(*chosen)).alias("pivots"))
    outside = inside.filter("comp <> main").select("bucket", F.col("cls").alias("a"))
    return outside.join(pivots, "bucket").select("a", F.explode("pivots").alias("b"))


def crossing(members: DataFrame, labels: DataFrame, sketches: DataFrame) -> DataFrame:
    """Possible pairs (a, b) between components that meet in a bucket; a is outside its bucket's largest component."""
    inside = materialised(in_mixed_buckets(members, labels).join(sketches, "cls"))
    of_two = (F.col("y.comp") == F.col("y.main")) | (F.col("x.cls") < F.col("y.cls"))
    meet = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.comp") != F.col("y.comp")) & of_two & possible("x", "y")
    return (
        inside.filter("comp <> main")
        .alias("x")
        .join(inside.alias("y"), meet)
        .select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b"))
    )


def deduplicated(docs: DataFrame, shingle_words: int = 5) -> DataFrame:
    """The rows of ``docs`` that are the first, by doc_id, of their group."""
    kept = grouped(docs, shingle_words).filter(F.col("_uid") == F.col("keeper"))
    return kept.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
