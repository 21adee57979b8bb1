import binascii

import numpy as np

from marketrisk.llm import sharding
from marketrisk.llm.ordering import hilbert_index, running_offsets
from pyspark.sql import functions as F


def test_curve_is_a_walk_over_the_whole_cube():
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side, indexing="ij"), axis=-1).reshape(-1, 3)
    index = hilbert_index(cells, 3)
    assert sorted(index) == list(range(512))
    steps = np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_running_offsets_equal_a_plain_sum(spark):
    df = spark.range(1000).select("id", (F.col("id") * 7 % 13).alias("w"), (F.col("id") * 31 % 17).alias("k")).repartition(5)
    got = {r["id"]: r["before"] for r in running_offsets(df, [F.col("k"), F.col("id")], F.col("w"), "before").collect()}
    before = 0
    for i in sorted(range(1000), key=lambda i: (i * 31 % 17, i)):
        assert got[i] == before
        before += i * 7 % 13


def test_rows_law(spark, odd):
    rows = sharding.assigned(odd).collect()
    assert len(rows) == odd.count()
    for n in (odd.count(),):
        counts = [sum(r["shard"] == s for r in rows) for s in range(8)]
        assert max(counts) - min(counts) <= 1 and sum(counts) == n
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    texts = {(r["doc_id"], len((r["text"] or "").encode()) + 1, binascii.crc32((r["text"] or "").encode())) for r in odd.collect()}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == texts


def test_shards_are_boxes(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.concat("id", F.repeat(F.lit("x"), (F.col("id") * 37 % 500).cast("int"))).alias("text"),
        F.concat(F.lit("host"), F.col("id") % 16).alias("source"), F.lit("en").alias("lang"),
    )
    plan = sharding.assigned(docs).join(docs, "doc_id").toPandas()
    shares = plan.groupby("shard")["source"].value_counts(normalize=True)
    effective = (1 / (shares**2).groupby("shard").sum()).mean()  # sources per shard, were they evenly spread
    assert effective < 16 * 0.75


def test_sources_that_begin_alike_have_codes_of_their_own(spark):
    docs = spark.range(800).select(F.concat(F.lit("https://www.host"), F.col("id") % 8).alias("source"))
    coded = sharding.with_rank_code(docs, "source").distinct().collect()
    assert {r["source"][-1]: r["source_code"] for r in coded} == {str(k): 4 * k + 2 for k in range(8)}
    odd = spark.createDataFrame([(None,), (None,), ("",), ("b",)], "source string")
    assert {r["source"]: r["source_code"] for r in sharding.with_rank_code(odd, "source").collect()} == {None: 8, "": 20, "b": 28}


def test_equal_texts_are_neighbours_whatever_their_ids_and_sources(spark):
    docs = spark.range(2000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.col("id") * 7 % 90).alias("text"),
        F.concat(F.lit("host"), F.col("id") % 16).alias("source"), F.lit("en").alias("lang"),
    )
    rows = sorted(sharding.assigned(docs).collect(), key=lambda r: (r["shard"], r["slot"]))
    changes = sum(a["text_crc32"] != b["text_crc32"] for a, b in zip(rows, rows[1:], strict=False))
    assert changes == 89  # every group is one run


def test_order_follows_the_curve_of_the_codes(spark):
    """The curve index of every row is that of its codes, found again by counting."""
    docs = spark.range(300).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("ab"), (F.col("id") * 11 % 300).cast("int")).alias("text"),
        F.concat(F.lit("https://s"), F.col("id") % 3).alias("source"), F.when(F.col("id") % 4 == 0, "de").otherwise("en").alias("lang"),
    )
    got = {r["doc_id"]: r for r in sharding.assigned(docs).collect()}
    rows = docs.collect()
    n = len(rows)

    def middle(column, value):
        before = sum(r[column] < value for r in rows)
        return int((before + sum(r[column] == value for r in rows) / 2) * 32 // n)

    edges = lambda values: sorted({sorted(values)[-(-k * n // 32) - 1] for k in range(1, 32)})
    sizes = edges([2 * (i * 11 % 300) + 1 for i in range(n)])
    ids = edges(range(n))
    cells = [
        [middle("source", r["source"]), middle("lang", r["lang"]), sum(e <= len(r["text"]) + 1 for e in sizes), sum(e <= r["doc_id"] for e in ids)]
        for r in rows
    ]
    want = hilbert_index(np.array(cells), sharding.BITS)
    assert [got[r["doc_id"]]["curve"] for r in rows] == want.tolist()
    placed = sorted(got.values(), key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in placed] == sorted(want)


def test_written_files_and_empty_table(spark, nothing, tmp_path):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("s").alias("source"), F.lit("l").alias("lang"))
    sharding.write_shards(docs, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 8
    assert sharding.assigned(nothing).count() == 0
