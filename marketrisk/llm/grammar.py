"""Token ids in grammar-compressed shards: Re-Pair with random-access decoding.

Documents are range-sorted by id and their token ids cut into shards of about a million ids, whole documents each.
In a shard, pairs of neighbouring symbols that occur at least ``LEAST`` times are replaced by new symbols, more
frequent pairs first, and again in what is left, until a round saves less than ``GAIN`` of the symbols.  A shard's row
of the written table holds the rules (left and right symbol), the length each rule expands to, the remaining
symbols, the ids before every ``ANCHOR``-th symbol, and where its documents end: any range of ids is decoded from the few
symbols that cover it.

One round finds its pairs in a hash table of one place per hash, so a pair that loses its place waits for the next
round and its other hash.  Where frequent pairs overlap the more frequent one is replaced; of a run of one symbol,
every second.

Shards are rows of a Parquet table below the shared folder, written and read back by Spark, so any lost task is run
again.  The table of ids before each partition has one row per partition.  A document is never cut, so a longer one
makes a longer shard.

Defined cases: a null or empty text is the end id alone; null ids come first; equal ids are ordered by a hash of
their texts, so only equal rows can change places; an empty table gives no shard and no row; other columns are not
looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketrisk.llm.shared import materialised
from marketrisk.llm.tokens import Encoder

END_ID = 2
#: Ids of a shard, at least (but for a partition's last one).
SHARD_IDS = 1 << 20
#: First nonterminal; ids of the vocabulary lie below.
FIRST = 1 << 16
LEAST, GAIN, ANCHOR = 16, 0.005, 256
_HASH_BITS = 18
_U = np.uint64


@dataclass
class Grammar:
    """A compressed sequence: symbol FIRST + k stands for left[k], right[k] and expands to lengths[k] ids."""

    left: np.ndarray
    right: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray
    anchors: np.ndarray

    def expanded(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for."""
        while True:
            rule = symbols >= FIRST
            if not rule.any():
                return symbols
            ends = np.cumsum(rule + np.int64(1))
            wider = np.empty(int(ends[-1]), np.uint32)
            wider[ends - 1] = symbols
            which = symbols[rule] - FIRST
            wider[ends[rule] - 2] = self.left[which]
            wider[ends[rule] - 1] = self.right[which]
            symbols = wider

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        """Ids that each symbol expands to."""
        size = np.ones(len(symbols), np.int64)
        rule = symbols >= FIRST
        size[rule] = self.lengths[symbols[rule] - FIRST]
        return size

    def between(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the sequence, from the symbols between the anchors around them."""
        first = max(int(np.searchsorted(self.anchors, start, "right")) - 1, 0)
        last = int(np.searchsorted(self.anchors, stop, "left"))
        symbols = self.symbols[first * ANCHOR : last * ANCHOR]
        before = int(self.anchors[first]) + np.concatenate([[0], np.cumsum(self.sizes(symbols))])
        low = int(np.searchsorted(before, start, "right")) - 1
        high = int(np.searchsorted(before, stop, "left"))
        return self.expanded(symbols[low:high])[start - before[low] : stop - before[low]]


def _apart(at: np.ndarray, priority: np.ndarray) -> np.ndarray:
    """Rising positions without neighbours, those of greater priority first; a few may be left for a later round."""
    same = (np.diff(at) == 1) & (priority[1:] == priority[:-1])
    if same.any():  # a run of one symbol: every second place
        index = np.arange(len(at))
        begin = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), index, 0))
        even = (index - begin) % 2 == 0
        at, priority = at[even], priority[even]
    chosen = []
    for _ in range(3):
        near = np.diff(at) == 1
        beaten = np.zeros(len(at), bool)
        beaten[1:] |= near & (priority[:-1] > priority[1:])
        beaten[:-1] |= near & (priority[1:] > priority[:-1])
        chosen.append(at[~beaten])
        touched = ~beaten
        touched[1:] |= near & ~beaten[:-1]
        touched[:-1] |= near & ~beaten[1:]
        at, priority = at[~touched], priority[~touched]
        if not len(at):
            break
    return np.sort(np.concatenate(chosen))


def compressed(ids: np.ndarray, least: int = LEAST, gain: float = GAIN) -> Grammar:
    """Re-Pair over one sequence of ids."""
    places = 1 << _HASH_BITS
    symbols, rules, lengths, turn = ids.astype(np.uint32), [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    top = FIRST
    while len(symbols) > 1:
        pair = (symbols[:-1].astype(np.uint64) << _U(32)) | symbols[1:]
        factor = (0x9E3779B97F4A7C15 + turn * 0x2545F4914F6CDD1E) % 2**64 | 1
        place = ((pair * _U(factor)) >> _U(64 - _HASH_BITS)).astype(np.int64)
        holder = np.zeros(places, np.uint64)
        holder[place] = pair
        own = holder[place] == pair
        count = np.bincount(place[own], minlength=places)
        at = np.flatnonzero(own & (count >= least)[place])
        if not len(at):
            break
        at = _apart(at, (count[place[at]] << _HASH_BITS) | place[at])
        useful = np.bincount(place[at], minlength=places) >= max(2, least // 2)
        at = at[useful[place[at]]]
        if len(at) < max(1, gain * len(symbols)):
            break
        new = np.flatnonzero(useful)
        name = np.zeros(places, np.uint32)
        name[new] = top + np.arange(len(new))
        rules.append(holder[new])
        known = np.concatenate([np.ones(FIRST, np.int64), *lengths])
        lengths.append(known[holder[new] >> _U(32)] + known[holder[new] & _U(0xFFFFFFFF)])
        symbols[at] = name[place[at]]
        kept = np.ones(len(symbols), bool)
        kept[at + 1] = False
        symbols = symbols[kept]
        top += len(new)
        turn += 1
    rule, length = np.concatenate(rules), np.concatenate(lengths)
    grammar = Grammar((rule >> _U(32)).astype(np.uint32), rule.astype(np.uint32), length, symbols, np.empty(0, np.int64))
    ends = np.cumsum(grammar.sizes(symbols))
    grammar.anchors = np.concatenate([[0], ends[ANCHOR - 1 : -1 : ANCHOR]]) if len(ends) else np.zeros(1, np.int64)
    return grammar


def _shard_type(id_type: T.DataType) -> T.StructType:
    shard = T.StructType([T.StructField("doc_ids", T.ArrayType(id_type))])
    shard = shard.add("part", "integer").add("first", "long").add("n", "long").add("ends", T.ArrayType(T.LongType()))
    for name in ("left", "right", "lengths", "symbols", "anchors"):
        shard = shard.add(name, "binary")
    return shard


def _listed(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def written(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """The shards, in a table below the shared folder.

    ``doc_ids``, ``part`` and ``first`` (the partition and the ids before the shard in it), ``n`` ids, ``ends`` (of the
    documents, in ids of the shard), and the grammar as little-endian numbers: 32-bit ``left``, ``right``, ``symbols``,
    64-bit ``lengths``, ``anchors``.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    order = ["doc_id", "_hash", "_uid"]
    ordered = (
        named.withColumns({"_hash": F.xxhash64("text"), "_uid": F.monotonically_increasing_id()})
        .repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )
    schema = _shard_type(named.schema["doc_id"].dataType)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, first = Encoder(), TaskContext.get().partitionId(), 0
        names, ids, counts = None, np.empty(0, np.uint32), np.empty(0, np.int64)

        def shard(docs: int, n: int) -> pa.RecordBatch:
            grammar = compressed(ids[:n])
            numbers = [grammar.left, grammar.right, grammar.lengths, grammar.symbols, grammar.anchors]
            columns = [
                _listed(names[:docs]),
                pa.array([part], pa.int32()),
                pa.array([first], pa.int64()),
                pa.array([n], pa.int64()),
                _listed(pa.array(np.cumsum(counts[:docs]))),
                *[pa.array([x.astype(x.dtype.newbyteorder("<")).tobytes()], pa.binary()) for x in numbers],
            ]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            fresh, n = encoder.encode(batch.column(1))
            fresh = np.insert(fresh, np.cumsum(n), end_id)
            names = batch.column(0) if names is None else pa.concat_arrays([names, batch.column(0)])
            ids, counts = np.concatenate([ids, fresh]), np.concatenate([counts, n + 1])
            while len(ids) >= SHARD_IDS:
                upto = np.cumsum(counts)
                docs = int(np.searchsorted(upto, SHARD_IDS)) + 1
                size = int(upto[docs - 1])
                yield shard(docs, size)
                first += size
                names, ids, counts = names[docs:], ids[size:], counts[docs:]
        if len(ids):
            yield shard(len(counts), len(ids))

    return materialised(ordered.mapInArrow(shards, schema), lasting=True)


def read(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian 32-bit) of every document."""
    totals = shards.groupBy("part").agg(F.sum("n").alias("_n"))
    # One row per partition, whatever the data.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    placed = shards.join(F.broadcast(bases), "part").withColumn("first", F.col("_base") + F.col("first"))
    columns = ["doc_ids", "first", "ends", "left", "right", "lengths", "symbols", "anchors"]
    schema = T.StructType([T.StructField("doc_id", shards.schema["doc_ids"].dataType.elementType)])
    schema = schema.add("start", "long").add("n_tokens", "long").add("ids", "binary")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = [batch.column(c) for c in range(len(columns))]
                names, ends = row[0][k].values, row[2][k].values.to_numpy()
                kinds = ("<u4", "<u4", "<i8", "<u4", "<i8")
                numbers = [np.frombuffer(row[3 + c][k].as_py(), kind) for c, kind in enumerate(kinds)]
                grammar = Grammar(*numbers)
                ids = grammar.expanded(grammar.symbols).astype("<u4")
                begins = np.concatenate([[0], ends[:-1]])
                blobs = pa.BinaryArray.from_buffers(
                    pa.binary(), len(ends), [None, pa.py_buffer((np.append(begins, ends[-1]) * 4).astype(np.int32)), pa.py_buffer(ids)]
                )
                columns_out = [names, pa.array(row[1][k].as_py() + begins), pa.array(ends - begins), blobs]
                yield pa.RecordBatch.from_arrays(columns_out, names=schema.names)

    return placed.select(*columns).mapInArrow(documents, schema)
