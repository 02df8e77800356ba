import corpus_pipeline as pipeline
import pytest
from brute import components, contamination, secrets

from granary.llm import common
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before and after each stage."""
    docs = common.table(spark, SMALL, "documents")
    out = [docs.collect()]
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, docs, SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def pairs(rows):
    return [(r.doc_id, r.text) for r in rows]


def test_near_duplicates_stage(stages):
    expected = sorted(d for d, _, c in components(pairs(stages[1]), 5) if c == d)
    assert sorted(r.doc_id for r in stages[2]) == expected


def test_benchmark_stage(spark, stages):
    items = [(r.item_id, r.text) for r in common.table(spark, SMALL, "benchmark").collect()]
    bad = {x[0] for x in contamination(pairs(stages[2]), items) if x[-1]}
    assert sorted(pairs(stages[3])) == sorted(x for x in pairs(stages[2]) if x[0] not in bad) and bad


def test_secrets_stage(stages):
    before, after = dict(pairs(stages[3])), dict(pairs(stages[4]))
    assert before.keys() == after.keys()
    for d, text in before.items():
        assert not secrets(after[d]) and (secrets(text) or after[d] == text)


def test_columns_and_counts(spark, stages):
    assert all(list(r[0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars"] for r in stages[:5])
    assert len(stages[1]) >= 0.99 * len(stages[0]) and len(stages[5]) == len(stages[4])
    assert sorted((r.doc_id, r.ids_sha256) for r in pipeline.run(spark, SMALL).collect()) == sorted((r.doc_id, r.ids_sha256) for r in stages[5])


NAMES = ["block", "bucket", "class", "label", "tile", "mate", "part", "pairs", "cluster", "print", "n", "h", "its_id", "its_print", "its_row", "bad_id", "bad_key", "text_key", "words", "redacted", "held_out", "a.b", "stays"]


def test_stages_with_clashing_names_repeated_rows_and_nulls(spark):
    docs = common.table(spark, SMALL, "documents").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(docs.limit(9)).unionByName(odd).cache()
    wide = docs.withColumns({k: F.lit("x") for k in NAMES})
    n = None
    for name, stage in pipeline.STAGES:
        got, plain = stage(spark, wide, SMALL), stage(spark, docs, SMALL)
        if name != "tokens":
            assert got.columns == wide.columns
        assert sorted((str(r.doc_id), str(r[1])) for r in got.collect()) == sorted((str(r.doc_id), str(r[1])) for r in plain.collect())
        n = stage(spark, docs.limit(0), SMALL).count()
        assert n == 0
    docs.unpersist()
