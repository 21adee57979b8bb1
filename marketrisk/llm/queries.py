"""The queries of this subpackage and, where SQL can express them, the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketrisk.llm import (
    fingerprints,
    grammar,
    licenses,
    lm,
    mixing,
    neardup,
    packing,
    pages,
    periodic,
    quality,
    secretscan,
    sharding,
    whitening,
)
from marketrisk.llm.shared import documents, text_or_empty, words
from marketrisk.llm.sql import ORACLE  # noqa: F401


def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text")


def language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", lm.held_out(F.col("doc_id")).alias("held_out"), "text")
    model = lm.trained(docs.filter(~F.col("held_out")))
    return lm.scored(docs, model)


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = neardup.grouped(documents(spark, sf_dir).select("doc_id", "text"))
    doc_id = F.col("row.doc_id")
    kept = F.coalesce(doc_id == F.col("component_id"), F.lit(False))
    return groups.select(doc_id.alias("doc_id"), "n_shingles", "component_id", kept.alias("kept"))


def rare_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(documents(spark, sf_dir).select("doc_id", "text"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, m = quality.judged(documents(spark, sf_dir).select("doc_id", "text", "source"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return table.select("doc_id", *[F.col(m)[c].alias(c) for c in names])


def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = sharding.assigned(documents(spark, sf_dir))
    return plan.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, m = secretscan.found(documents(spark, sf_dir).select("doc_id", "text"))
    spans = F.col(m)
    base = F.filter(spans, lambda s: s["kind"] < 3)

    def count(kind: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{secretscan.KINDS[kind]}")

    return table.select(
        "doc_id",
        *[count(kind) for kind in range(3)],
        F.sha2(secretscan.written(base), 256).alias("base_sha256"),
        secretscan.written(spans).alias("spans"),
        count(3),
    )


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, m = mixing.planned(documents(spark, sf_dir).select("doc_id", "source", "text"))
    taken = (F.col(m)["size"] * F.col(m)["copies"]).alias("taken")
    return table.select("doc_id", *[F.col(m)[c].alias(c) for c in ("size", "source_size", "target")], taken)


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, m = licenses.detected(documents(spark, sf_dir).select("doc_id", "text"))
    found = F.col(m)
    starts = F.transform(found["base"], lambda s: s["start"].cast("long"))
    base = licenses.base_labels(found)
    return table.select(
        "doc_id",
        found["n_words"].alias("n_words"),
        F.size(found["base"]).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        licenses.joined(base).alias("base_labels"),
        licenses.joined(F.concat(base, licenses.own_labels(found))).alias("labels"),
        licenses.confidence(found).alias("score"),
    )


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pieces(documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    model = whitening.fitted(vectors)
    rows = whitening.whitened(vectors, model).select(
        "vec_id", "deviation", F.posexplode("whitened").alias("_place", "whitened")
    )
    explained = [F.lit(x).cast("double") for x in (model.explained() if model else [])]
    share = F.get(F.array(*explained) if explained else F.lit(None).cast("array<double>"), F.col("_place"))
    return rows.select(
        "vec_id",
        (F.col("_place") + 1).alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        F.col("deviation").try_cast("long").alias("deviation"),
        "whitened",
        share.alias("explained"),
        F.lit(model.identity_error if model else None).cast("double").alias("identity_error"),
        F.col("deviation").alias("deviation_exact"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Some texts go on, from a word on, with the words from there repeated; a null id's text stays."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    w = words(text_or_empty())
    n = F.size(w)
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    times = (F.floor((n - a) / p) + 1).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), times)), F.lit(1), n - a)
    planted = F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " ")
    chosen = F.coalesce(h % 10 == 0, F.lit(False)) & (n > 0)
    return docs.select("doc_id", F.when(chosen, planted).otherwise(F.col("text")).alias("text"))


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, m = periodic.collapsed(with_planted_runs(documents(spark, sf_dir)))
    found = F.col(m)["runs"]
    lines = F.transform(found, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    longest = F.array_max(
        F.transform(
            found,
            lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")),
        )
    )
    return table.select(
        "doc_id",
        F.size(found).cast("long").alias("n_runs"),
        (-longest["start"]).alias("start"),
        longest["length"].alias("length"),
        (-longest["period"]).alias("period"),
        F.floor(1000 * longest["length"] / -longest["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col(m)["text"], 256).alias("collapsed_sha256"),
    )


def grammar_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = grammar.written(documents(spark, sf_dir).select("doc_id", "text"))
    return grammar.read(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {
    "op1_html_text": visible_text,
    "op2_bloom_lm": language_model,
    "op3_minhash_dedup": near_duplicates,
    "op4_rare_features": rare_features,
    "op5_quality_rules": quality_rules,
    "op6_hilbert_shards": sharded,
    "op7_secret_scan": secret_scan,
    "op8_source_mix": mixture,
    "op9_license_scan": license_scan,
    "op10_curve_packing": packed,
    "op11_polar_whitening": whitened_embeddings,
    "op12_periodic_runs": periodic_runs,
    "op13_grammar_shards": grammar_shards,
}
