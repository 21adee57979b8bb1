import binascii

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketrisk.llm import grammar, queries, tokens
from tests.llm.conftest import make

SPECIAL = "<|endoftext|>"
TEXTS = ["", "a", " \n\t x", "Ünï 日本語 \U0001f600 x", SPECIAL, f"a {SPECIAL} b", f"x{SPECIAL}  {SPECIAL}y", "a" * 3000, " " * 3000]
TEXTS += ["don't we'll 12345 !?  x", "\x00\x01 a", None, "  a　 b  c d\u0085 e", "é à ü  x   y 's 'll", " x 'S it's", "tab\t x\n y \r\n z"]


def library_ids(texts):
    encoder = tokens.library_encoder()
    return [e.ids for e in encoder.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_ids_equal_the_tokenizers_library_at_its_defaults(monkeypatch):
    rng = np.random.default_rng(1)
    alphabet = [*"ab' \t\n 　é日1!<|> \u0085\x1c​", SPECIAL]
    texts = TEXTS + ["".join(rng.choice(alphabet, size=int(rng.integers(0, 40)))) for _ in range(5000)]
    for size in (tokens.TOGETHER, 1000):
        monkeypatch.setattr(tokens, "TOGETHER", size)
        ids, n = tokens.Encoder().encode(pa.array(texts)[3:])
        got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == library_ids(texts[3:])


def test_one_text_at_a_time():
    encoder = tokens.Encoder()
    for text, want in zip(TEXTS, library_ids(TEXTS), strict=True):
        assert encoder.encode(pa.array([text], pa.string()))[0].tolist() == want


def sequences():
    rng = np.random.default_rng(6)
    yield np.empty(0, np.uint32)
    yield np.array([7], np.uint32)
    yield np.full(5001, 9, np.uint32)
    yield np.arange(3000, dtype=np.uint32)
    yield np.tile(np.arange(50, dtype=np.uint32), 200)
    yield rng.zipf(1.3, 30_000).clip(0, 50_000).astype(np.uint32)
    yield np.concatenate([rng.integers(0, 5, 3000), np.repeat(3, 400), rng.integers(0, 50_000, 100)]).astype(np.uint32)


@pytest.mark.parametrize("ids", list(sequences()), ids=lambda x: str(len(x)))
@pytest.mark.parametrize("least", [2, 16])
def test_round_trip_and_random_access(ids, least):
    g = grammar.compressed(ids, least, 0)
    assert g.expanded(g.symbols).tolist() == ids.tolist()
    assert g.sizes(g.symbols).sum() == len(ids)
    for k in range(len(g.left)):  # a rule's length is that of its two sides
        rule = np.array([grammar.FIRST + k], np.uint32)
        assert g.lengths[k] == len(g.expanded(rule)) and g.left[k] < grammar.FIRST + k > g.right[k]
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = sorted(rng.integers(0, len(ids) + 1, 2))
        assert g.between(int(a), int(b)).tolist() == ids[a:b].tolist()


def test_frequent_pairs_are_gone_and_repetition_shrinks():
    ids = np.tile(np.arange(50, dtype=np.uint32), 200)
    assert len(grammar.compressed(ids).symbols) < len(ids) / 40
    for ids in sequences():
        s = grammar.compressed(ids, 16, 0).symbols
        pairs, n = np.unique(s[:-1].astype(np.int64) << 32 | s[1:], return_counts=True)
        unlike = (pairs >> 32) != (pairs & 0xFFFFFFFF)
        assert not len(n) or n[unlike].max(initial=0) < 32


def rows_of(texts, ids=None):
    order = sorted(range(len(texts)), key=lambda k: ids[k] if ids else k)
    at, rows = 0, []
    for k, found in zip(order, library_ids([texts[k] for k in order]), strict=True):
        found = [*found, grammar.END_ID]
        rows.append((ids[k] if ids else k, at, len(found), binascii.crc32(np.array(found, "<u4").tobytes())))
        at += len(found)
    return rows


def result(df):
    shards = grammar.written(df)
    found = grammar.read(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("crc"))
    return shards, [tuple(r) for r in found.orderBy("start").collect()]


def test_files_hold_every_document_in_order(spark, monkeypatch):
    rng = np.random.default_rng(9)
    texts = TEXTS + [" ".join(f"w{x}" for x in rng.integers(0, 30, 200)) for _ in range(60)]
    monkeypatch.setattr(grammar, "SHARD_IDS", 700)
    shards, got = result(make(spark, texts).repartition(5))
    assert got == rows_of(texts)
    assert shards.count() > 10 and shards.filter(F.size("doc_ids") > 1).count() > 0
    per_part = shards.orderBy("part", "first").collect()
    for a, b in zip(per_part, per_part[1:], strict=False):
        assert b["first"] == (a["first"] + a["n"] if a["part"] == b["part"] else 0)


def test_nulls_repeated_rows_and_clashing_names(spark, odd):
    _, got = result(odd)
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert [r[0] for r in got] == sorted([i for i, _ in texts], key=lambda x: (x is not None, x))
    want = sorted((str(i), len(x) + 1) for (i, _), x in zip(texts, library_ids([t for _, t in texts]), strict=True))
    assert sorted((str(r[0]), r[2]) for r in got) == want
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:], strict=False))


def test_text_ids_and_one_id_for_many_rows(spark):
    rows = [("same" if k % 3 else f"d{k}", "one two three " * (k % 5)) for k in range(90)]
    _, got = result(spark.createDataFrame(rows, "doc_id string, text string"))
    assert len(got) == 90 and [r[0] for r in got] == sorted(r[0] for r in rows)


def test_empty_table(spark, nothing, tmp_path):
    _, got = result(nothing)
    assert got == []
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.grammar_shards(spark, str(tmp_path)).collect() == []
