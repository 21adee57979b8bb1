import binascii

import numpy as np
from pyspark.sql import functions as F

from marketrisk.llm import packing
from marketrisk.llm.tokens import library_encoder


def ids_of(texts):
    t = library_encoder()
    return [e.ids + [packing.END_ID] for e in t.encode_batch(texts, add_special_tokens=False)]


def test_special_tokens_strings_are_that_token(spark):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    (row,) = packing.pieces(docs).collect()
    assert np.frombuffer(row["ids"], "<u4").tolist() == [64, 220, 50256, 275, 0] == ids_of(["a <|endoftext|> b"])[0]


def test_pieces_cover_every_id_once(spark, odd):
    rows = packing.pieces(odd).collect()
    total = sum(r["length"] for r in rows)
    by_sequence, stream = {}, []
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and r["length"] > 0
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert sorted(by_sequence) == list(range(-(-total // 1024)))
    for s in range(len(by_sequence)):
        at = 0
        for r in sorted(by_sequence[s], key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
            stream.append(r)
        assert at == 1024 or s == len(by_sequence) - 1
    # pieces of one document follow one another in the stream, so joined ids are those of the texts
    texts = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    want = sorted((str(i), np.array(x, "<u4").tobytes()) for (i, _), x in zip(texts, ids_of([t for _, t in texts]), strict=True))
    got, now = [], b""
    for r in stream:
        assert r["start"] * 4 == len(now)
        now += bytes(r["ids"])
        if len(now) == 4 * r["doc_tokens"]:
            got.append((str(r["doc_id"]), now))
            now = b""
    assert now == b"" and sorted(got) == want


def test_crc_is_of_little_endian_ids(spark, odd):
    for r in packing.pieces(odd).select("ids", F.crc32("ids").alias("crc")).collect():
        assert binascii.crc32(bytes(r["ids"])) == r["crc"]


def test_like_documents_are_neighbours(spark):
    a, b = "alpha beta gamma delta epsilon " * 20, "un deux trois quatre cinq six " * 20
    docs = spark.createDataFrame([(k, a if k % 2 else b) for k in range(60)], "doc_id long, text string")
    rows = sorted(packing.pieces(docs).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    kinds = [r["doc_id"] % 2 for r in rows]
    assert sum(x != y for x, y in zip(kinds, kinds[1:], strict=False)) <= 3


def test_empty_table(nothing):
    assert packing.pieces(nothing).count() == 0
