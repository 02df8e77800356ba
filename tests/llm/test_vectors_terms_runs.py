import random

import numpy as np
import pytest
from brute_new import divergence, periods, vector_links
from pyspark.sql import functions as F

from granary.llm import common
from granary.llm import divergence as terms
from granary.llm import periods as runs
from granary.llm import vectors
from granary.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
VECTORS = "embedding array<float>, vec_id long, label int, class string, n int, cell int"


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) if names else tuple(r) for r in df.collect()), key=str)


def some_vectors(seed=0, labels=3, groups=12, copies=6, width=16, single=60):
    r = np.random.RandomState(seed)
    out = []
    for k in range(groups):
        centre = r.randn(width)
        out += [(k % labels, centre + r.randn(width) * 0.15 * np.linalg.norm(centre) / np.sqrt(width) * (1 + c % 3)) for c in range(copies)]
    out += [(int(r.randint(labels)), r.randn(width)) for _ in range(single)]
    return [(i * 3 - 20, k, [float(np.float32(x)) for x in v]) for i, (k, v) in enumerate(out)]


def vector_frame(spark, data):
    return spark.createDataFrame([(v, i, k, "x", 1, 2) for i, k, v in data], VECTORS)


@pytest.mark.parametrize("cell,tile,recall", [(10_000, 2048, 0.999), (4, 2048, 1.0), (4, 3, 1.0), (4, 2048, 0.999)])
def test_vector_links(spark, monkeypatch, cell, tile, recall):
    monkeypatch.setattr(vectors, "CELL", cell)
    monkeypatch.setattr(vectors, "TILE", tile)
    data = some_vectors()
    odd = [(900, None, data[0][2]), (901, 0, None), (902, 0, [0.0] * 16), (903, 0, [None] + data[0][2][1:]), (904, 0, [float("nan")] * 16), (905, 0, [float("inf")] * 16), (906, 0, []), (907, data[0][1], [2 * x for x in data[0][2]]), (908, 1, [1.0, 2.0]), (909, 1, [2.0, 4.0]), (910, data[0][1], data[0][2])]
    found = rows(vectors.vector_links(vector_frame(spark, data + odd), recall=recall), "vec_id", "n_links", "component_id", "kept")
    assert found == sorted(((*x, x[0] == x[2]) for x in vector_links(data + odd)), key=str)


def test_repeated_vectors_and_null_ids(spark):
    v = some_vectors(groups=1, copies=1, single=0)[0][2]
    found = rows(vectors.vector_links(vector_frame(spark, [(7, 1, v), (7, 1, v), (None, 1, v), (9, 2, v), (None, 3, v)])))
    assert found == sorted([(7, 2, 7, True), (7, 2, 7, True), (None, 2, 7, False), (9, 0, 9, True), (None, 0, None, True)], key=str)


def test_no_vectors(spark):
    assert vectors.vector_links(vector_frame(spark, [])).collect() == []


def test_recall_of_the_index(spark, monkeypatch):
    """Of all links that brute force finds among 2000 vectors of two labels, in a grid of 7 by 7 cells."""
    monkeypatch.setattr(vectors, "CELL", 24)
    data = some_vectors(3, labels=2, groups=150, copies=8, width=32, single=800)
    by_id = {r.vec_id: r.n_links for r in vectors.vector_links(vector_frame(spark, data)).collect()}
    x = np.array([v for _, _, v in data])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([k for _, k, _ in data])
    true = ((x @ x.T >= 0.93) & (label[:, None] == label)).sum() - len(data)
    assert true > 3000
    assert sum(by_id.values()) >= 0.99 * true


def test_vectors_of_the_small_table(spark):
    data = [(r.vec_id, r.label, r.embedding) for r in common.table(spark, SMALL, "embeddings").collect()]
    assert rows(QUERIES["op11_vector_links"](spark, SMALL), "vec_id", "n_links", "component_id") == sorted(vector_links(data), key=str)


TEXTS = [
    ("The the THE cat é日本 cat", "en", "a"), ("cat the dog", "en", "b"), ("the éa cat dog é日本", "en", "a"), ("dog the é日本 zebra", "en", "c"), (None, "en", "d"), ("", None, None),
    ("cat " * 40 + "the dog", "en", "b"), ("eins zwei", "de", "a"), ("eins", "de", "b"), ("12 34 _", "de", "c"), ("x y z x", "fr", "a"), ("x x y", "fr", "a"), ("x y", "fr", "b"), ("x y", "fr", "b"), ("a@b [c] {d}", "", "a"),
]


def text_frame(spark, data):
    return spark.createDataFrame([(i, *x, 1, 2) for i, x in enumerate(data)], "doc_id long, text string, lang string, source string, prefix int, n int")


@pytest.mark.parametrize("leaves,counters", [(2_000_000, 1_500_000), (3, 4)])
def test_divergence(spark, monkeypatch, leaves, counters):
    monkeypatch.setattr(terms, "RANGE_LEAVES", leaves)
    monkeypatch.setattr(terms, "MOST_COUNTERS", counters)
    monkeypatch.setattr(terms, "BLOCK", 8)
    names = ("lang", "source", "part", "item", "value", "rank")
    assert rows(terms.divergence(text_frame(spark, TEXTS)), *names) == sorted(divergence(TEXTS), key=str)
    r = random.Random(4)
    much = [(" ".join("th%s" % "".join(r.choice("aeéz") for _ in range(r.randrange(1, 5))) for _ in range(60)), r.choice(["en", "de"]), r.choice("abcde")) for _ in range(80)]
    assert rows(terms.divergence(text_frame(spark, much), top=7), *names) == sorted(divergence(much, top=7), key=str)


def test_divergence_of_nothing(spark):
    assert terms.divergence(text_frame(spark, [])).collect() == []


def test_divergence_of_a_long_text_and_repeated_rows(spark):
    long = " ".join("w" + "".join(chr(97 + int(c)) for c in str(i % 5000)) for i in range(200_000))
    data = [(long, "en", "a")] * 3 + [("wa wb", "en", "b"), ("é" * 300_000, "en", "b")]
    names = ("lang", "source", "part", "item", "value", "rank")
    assert rows(terms.divergence(text_frame(spark, data)), *names) == sorted(divergence(data), key=str)


def test_shares_are_exact():
    total = np.array([9_000_000_000_000_001, 10**12 + 7, 3])
    count = np.array([8_999_999_999_999_999, 123_456_789_012, 2])
    assert terms.shares(count, total, 10**9).tolist() == [1 + 10**9 * (c + 1) // t for c, t in zip(count.tolist(), total.tolist())]


RUN_COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
PATTERNS = [
    None, "", " \n ", "a", "a a a a a", "a a a a a a", "a a a a a a a b", "a b a b a b a", "a b a b a b a b", "x a b a b a b a b a y", "a a b a a b a a b a a b a", "a b c " * 6 + "d " * 9 + "a b c " * 4,
    "é\x85a é\x85a é\x85a é\x85a", "a a a a a a b a a a a a a b a a a a a a b a a a a a a b", "a\ta\na\x0ba\x0ca\ra",
]


def run_data(seed, n=60):
    r = random.Random(seed)
    made = [" ".join(r.choice("ab" if r.random() < 0.5 else "abcd") for _ in range(r.randrange(0, 70))) for _ in range(n)]
    return [(None if i % 17 == 3 else i * 7, t) for i, t in enumerate(PATTERNS + made)]


@pytest.mark.parametrize("comparisons", [4_000_000_000, 60])
def test_periodic_runs(spark, monkeypatch, comparisons):
    monkeypatch.setattr(runs, "COMPARISONS", comparisons)
    data = run_data(1)
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in data + data[:5]], "doc_id long, text string, part string, parts int")
    for places in (None, runs.planted):
        assert rows(runs.periodic_runs(frame, places=places), *RUN_COLUMNS) == sorted(periods(data + data[:5], places is not None), key=str)
    assert runs.periodic_runs(frame.limit(0)).collect() == []


def test_periodic_runs_of_the_small_table(spark):
    data = [(r.doc_id, r.text) for r in common.table(spark, SMALL, "documents").collect() if len(r.text or "") < 8000]
    docs = common.table(spark, SMALL, "documents").filter(F.length(F.coalesce("text", F.lit(""))) < 8000)
    assert rows(runs.periodic_runs(docs, places=runs.planted), *RUN_COLUMNS) == sorted(periods(data), key=str)


def test_a_very_long_text_is_shared_out(spark, monkeypatch):
    """A megabyte of words with a run whose period is 20,000 words, in many ranges of lags."""
    monkeypatch.setattr(runs, "COMPARISONS", 400_000_000)
    r = random.Random(5)
    part = ["w%d" % r.randrange(10**6) for _ in range(20_000)]
    text = " ".join(["a"] * 9 + part * 4 + part[:7] + ["end"])
    out = runs.periodic_runs(spark.createDataFrame([(4, text)], "doc_id long, text string"), keep=True).first()
    assert [(x.start, x.length, x.period) for x in out.runs] == [(0, 9, 1), (9, 80_007, 20_000)]
    assert out.collapsed == " ".join(["a"] + part + ["end"])
