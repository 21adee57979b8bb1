"""Packing along a space-filling curve: documents of like content share sequences.

Every document is tokenized, its token ids are hashed into a count vector, the vector is projected to a few
dimensions, and the documents are range-sorted by the Hilbert index of the projections' quantile codes.  Along that
order all tokens form one stream that is cut every 1,024 tokens: only the last sequence has padding.

Tokens are written once to the shared folder.  Sorting and offsets use narrow rows (an id, a key, a count); the
token ids themselves are shuffled once, to meet their offsets.

Defined cases: a null or empty text is the end id alone; repeated rows and null ids are documents like others;
an empty table gives no piece; a special token's string is that token, as in the tokenizers library at its defaults.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketrisk.llm.ordering import hilbert_index, quantile_codes, running_offsets
from marketrisk.llm.shared import materialised
from marketrisk.llm.textbytes import mix
from marketrisk.llm.tokens import Encoder

SEQUENCE = 1024
END_ID = 0
BUCKETS, DIMENSIONS, BITS, SEED = 256, 4, 6, 11


def projections() -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((BUCKETS, DIMENSIONS))


def document_vectors(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Projected, length-normalised hashed count vectors, one row per document; no document is empty."""
    bucket = (mix(ids.astype(np.uint64) + np.uint64(SEED)) % np.uint64(BUCKETS)).astype(np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    counts = np.bincount(rows * BUCKETS + bucket, minlength=len(lengths) * BUCKETS).reshape(len(lengths), BUCKETS)
    vectors = np.sqrt(counts)
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ projections()


def tokenized(docs: DataFrame, text: str = "text") -> DataFrame:
    """_uid, n and ids (little-endian 16-bit, end id included), projections and all columns but the text."""
    others = [c for c in docs.columns if c != text]
    schema = docs.select(*[f"`{c}`" for c in others]).schema
    wanted = docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`"))
    full = schema.add("_uid", "long").add("_n", "long").add("_ids", "binary")
    for k in range(DIMENSIONS):
        full = full.add(f"_x{k}", "double")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        uid = TaskContext.get().partitionId() << 33
        for whole in batches:
            every, counts = encoder.encode(whole.column(len(others)))
            every = np.insert(every, np.cumsum(counts), END_ID).astype("<u2")
            begins = np.concatenate([[0], np.cumsum(counts + 1)])
            for first in range(0, whole.num_rows, 256):
                batch, n = whole.slice(first, 256), counts[first : first + 256] + 1
                ids = every[begins[first] : begins[first] + n.sum()]
                x = document_vectors(ids, n)
                ends = np.concatenate([[0], 2 * np.cumsum(n)])
                blobs = [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)]
                columns = [
                    *batch.columns[: len(others)],
                    pa.array(np.arange(uid, uid + len(n))),
                    pa.array(n),
                    pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), blobs).cast(pa.binary()),
                    *[pa.array(x[:, k]) for k in range(DIMENSIONS)],
                ]
                uid += len(n)
                yield pa.RecordBatch.from_arrays(columns, names=full.names)

    return wanted.mapInArrow(encode, full)


@F.pandas_udf(T.LongType())
def _curve(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series(hilbert_index(np.stack([a, b, c, d], axis=1), BITS))


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""
    named = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    tokens = materialised(tokenized(named))
    dims = {f"_c{k}": F.col(f"_x{k}") for k in range(DIMENSIONS)}
    keyed = quantile_codes(tokens.drop("_ids"), dims, BITS).select("_uid", "doc_id", "_n", _curve(*dims).alias("_curve"))
    placed = running_offsets(keyed, [F.col("_curve"), F.col("doc_id"), F.col("_uid")], F.col("_n"), "_before")
    joined = tokens.select("_uid", "doc_id", "_ids").join(placed.select("_uid", "_before"), "_uid")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, blob, before in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "_ids", "_before")], strict=True):
                ids = np.frombuffer(blob, "<u2")
                at = 0
                while at < len(ids):
                    row, offset = divmod(before + at, sequence)
                    length = min(len(ids) - at, sequence - offset)
                    rows.append((name, at, length, ids[at : at + length].astype("<u4").tobytes(), len(ids), row, offset))
                    at += length
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names
            )

    id_type = docs.schema[doc_id].dataType
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
    if id_type.simpleString() == "string":
        kinds[0] = pa.string()
    schema = f"doc_id {id_type.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return joined.select("doc_id", "_ids", "_before").mapInArrow(cut, schema)
