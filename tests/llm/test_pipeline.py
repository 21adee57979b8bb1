import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marketrisk.llm import quality
from tests.llm.conftest import make
from tests.llm.test_neardup import brute as brute_groups
from tests.llm.test_packing import ids_of
from tests.llm.test_quality import brute as brute_measures
from tests.llm.test_secrets import brute as brute_secrets

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input of every stage and the last one's rows, each stage read back from Parquet."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    planted = spark.createDataFrame(
        [(9000 + k, f"{'fresh words for a clean text with a secret token in it ' * 1}{k} token=abcdefgh{k} " + " ".join(f"u{k}v{j}" for j in range(30)), "en", "src1", 1) for k in range(5)],
        docs.schema,
    )
    states = [docs.union(planted)]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, states[-1], SMALL).write.parquet(path)
        states.append(spark.read.parquet(path))
    return states


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_all_but_the_last_stage_keep_the_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality_rules(stages):
    before, after = rows(stages[0]), {r["doc_id"] for r in rows(stages[1])}
    table, m = quality.judged(stages[0])
    bad = {r["host"] for r in quality.host_verdicts(table, "source", m).filter("rejected").collect()}
    for r in before:
        n_words, *_, repeats = brute_measures(r["text"])
        assert (r["doc_id"] in after) == (n_words >= 10 and 100 * repeats <= 20 * n_words and r["source"] not in bad)


def test_one_of_each_group_stays(stages):
    before = sorted(rows(stages[1]), key=lambda r: r["doc_id"])
    groups = brute_groups([r["text"] for r in before], 5)
    want = {before[k]["doc_id"] for k, (n, label) in enumerate(groups) if label == k}
    assert sorted(r["doc_id"] for r in rows(stages[2])) == sorted(want)


def test_secrets_are_gone_and_clean_documents_unchanged(stages):
    before, after = rows(stages[2]), {r["doc_id"]: r for r in rows(stages[3])}
    assert len(before) == len(after)
    assert any(brute_secrets(r["text"]) for r in before)
    for r in before:
        out = after[r["doc_id"]]
        assert not brute_secrets(out["text"])
        if not brute_secrets(r["text"]) and "[random]" not in out["text"]:
            assert out == r


def test_mix(stages):
    before, after = rows(stages[3]), Counter(r["doc_id"] for r in rows(stages[4]))
    size, taken = defaultdict(int), defaultdict(int)
    for r in before:
        n = brute_measures(r["text"])[0]
        size[r["source"]] += n
        taken[r["source"]] += n * after[r["doc_id"]]
        assert after[r["doc_id"]] <= 2
    assert sum(taken.values()) == pytest.approx(1.5 * sum(size.values()), rel=0.03)


def test_packing(stages):
    before, after = rows(stages[4]), rows(stages[5])
    want = Counter(r["doc_id"] for r in before)
    total = sum(len(x) for x in ids_of([r["text"] for r in before]))
    assert sum(r["length"] for r in after) == total
    assert max(r["sequence_id"] for r in after) + 1 == math.ceil(total / 1024)
    assert Counter(r["doc_id"] for r in after if r["start"] == 0) == want


def test_run_gives_the_last_stage(spark, stages):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == stages[5].columns and out.count() > 0


def test_stages_take_odd_and_empty_tables(spark, odd, nothing):
    for docs in (odd.drop("_rules_text", "shard", "n", "row"), nothing, make(spark, [None, ""])):
        count = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            found = out.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
            assert found == 0 if not count else found > 0 or name in ("quality rules", "source mix"), name
            if name == "secret scans":
                assert found == count
