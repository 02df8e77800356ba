"""Quality classification by hierarchical empirical Bayes: a document's own evidence with that of its host and path.

A linear classifier (linear.Model over character and word features) gives each document's probability of good
quality. Sums of them by host and by path below it give posterior means: a path's mean shrinks to its host's, a host's to the
global mean, by prior strengths that moments of the groups' rates give. The document's log odds then shift by what its
path's mean differs from the global one, without the document's own share in it. A second linear classifier, over the presence of
those (hashed) words that toxic rows have significantly more often, counted over all labelled rows, marks toxic documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import letters
from .common import BYTE_VALUES, MOST_BROADCAST, Fingerprints, code_points, in_small_batches, mix, shared_dir, shared_table, table, text_bytes, words_of
from .language import held_out
from .linear import WIDTH, Model, Sparse, document_frequencies, features, gram_counts, groups, idf, least, softmax, sparse

#: Labelled rows of each class that the quality and the toxicity classifier learn from, about.
SAMPLE, TOXIC_SAMPLE = 600, 1500
#: log2 of the number of hashed words of the toxicity classifier, and its L1 penalty.
WORDS, TOXIC_L1 = 20, 0.5
#: A word tells if toxic rows have it more often by so many standard deviations, and by this log of a factor.
DEVIATIONS, LIFT = 5.0, 1.5
#: Sums of probabilities are sums of whole numbers of this unit, so that the order of tasks changes no digit.
UNIT = 1e-9
#: Bounds of the prior strengths, in documents, and of single probabilities.
WEAKEST, STRONGEST, EDGE = 2.0, 1000.0, 1e-4


def word_counts(part: pa.RecordBatch) -> np.ndarray:
    raw, off = text_bytes(part.column("text"))
    starts, ends, doc = words_of(raw, off)
    at = (Fingerprints(BYTE_VALUES[raw]).of(starts, ends) >> np.uint64(64 - WIDTH)).astype(np.int64)
    return np.bincount(at + (doc << WIDTH), minlength=part.num_rows << WIDTH).reshape(part.num_rows, 1 << WIDTH).astype(np.float32)


def counts(part: pa.RecordBatch) -> np.ndarray:
    """Case-sensitive character n-grams and words."""
    return np.hstack([gram_counts(part, lower=False), word_counts(part)])


def presence(part: pa.RecordBatch) -> list[Sparse]:
    """For each document which hashed words (runs of letters, in lower case) it has."""
    raw, off = text_bytes(pc.utf8_lower(part.column("text")))
    points, ends, _ = code_points(raw, off)
    letter = letters()[points]
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    cuts = ends[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(points))]
    first[cuts], last[cuts - 1] = letter[cuts], letter[cuts - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    words = (Fingerprints(mix(points.astype(np.uint64) + np.uint64(1))).of(starts, stops) >> np.uint64(64 - WORDS)).astype(np.int64)
    bounds = np.searchsorted(starts, ends)
    found = [np.unique(words[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    return [(at, np.ones(len(at), np.float32)) for at in found]


def telling(rows: DataFrame) -> np.ndarray:
    """Whether each hashed word tells toxic rows (columns text and toxic, 0 or 1) from others. Tasks send sums, one for each hashed word at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, (1 << WORDS) + 1), np.int64)
        for batch in batches:
            for part in groups(batch):
                for toxic, (at, _) in zip(part.column("toxic").to_pylist(), presence(part)):
                    seen[toxic, at] += 1
                    seen[toxic, -1] += 1  # rows
        at = np.flatnonzero(seen.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0, at]), pa.array(seen[1, at])], ["word", "good", "bad"])

    sums = in_small_batches(rows).select("text", F.col("toxic").cast("int")).mapInArrow(count, "word long, good long, bad long").groupBy("word").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    counts_ = shared_table(sums, f"{shared_dir(rows.sparkSession)}/words")
    whole = counts_.filter(F.col("word") == 1 << WORDS).first()
    out = np.zeros(1 << WORDS, bool)
    if not whole or not whole.good or not whole.bad:
        return out
    rate = whole.bad / (whole.good + whole.bad)
    expected = (F.col("good") + F.col("bad")) * rate
    lift = F.log((F.col("bad") + 0.5) / (whole.bad + 1.0)) - F.log((F.col("good") + 0.5) / (whole.good + 1.0))
    tells = (F.col("bad") - expected > DEVIATIONS * F.sqrt(expected * (1 - rate))) & (lift > LIFT)
    out[[r.word for r in counts_.filter((F.col("word") < 1 << WORDS) & tells).select("word").collect()]] = True
    return out


class Classifiers:
    """A quality and a toxicity classifier; either is None if the labelled rows don't have both values."""

    def __init__(self, docs: DataFrame, labels: DataFrame):
        docs = docs.filter(F.col("text").isNotNull()).select("doc_id", "text")
        labels = labels.select("doc_id", "quality", "toxic").filter(~held_out())
        ids = labels.select("doc_id").distinct()
        df, total = document_frequencies(docs.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids, "doc_id", "left_semi"), counts, WIDTH + 1)
        self.idf, self.quality, self.toxic = idf(df, total), None, None
        few = self._rows(self._sample(docs, labels, "quality", SAMPLE), "quality")
        if len(set(few.column("quality").to_pylist())) == 2:
            x = [row for part in groups(few) for row in sparse(features(counts(part), self.idf))]
            self.quality = Model([0, 1]).fit(x, np.array(few.column("quality").to_pylist()), len(self.idf))
        few = self._rows(self._sample(docs, labels, "toxic", TOXIC_SAMPLE), "toxic")
        if len(set(few.column("toxic").to_pylist())) == 2:
            marks = labels.filter("toxic in (0, 1)").select("doc_id", "toxic").distinct()
            self.words = telling(docs.join(F.broadcast(marks) if marks.count() <= MOST_BROADCAST else marks, "doc_id"))
            x = [self._telling(at) for part in groups(few) for at, _ in presence(part)]
            self.toxic = Model([0, 1], l1=TOXIC_L1).fit(x, np.array(few.column("toxic").to_pylist()), 1 << WORDS)

    @staticmethod
    def _sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
        """The texts of about so many labelled ids of each value, by a hash of the id. The ids are chosen first, so no text is shuffled."""
        ids = least(labels.filter(F.col(label).isin(0, 1)).select("doc_id", label).distinct(), label, most, F.xxhash64("doc_id"))
        return docs.join(F.broadcast(ids), "doc_id").select("text", label)

    @staticmethod
    def _rows(few: DataFrame, label: str) -> pa.RecordBatch:
        """The bounded sample in an order that depends on its rows alone."""
        t = few.toArrow().sort_by([(label, "ascending"), ("text", "ascending")])
        t = t.take(pa.array(np.random.default_rng(5).permutation(t.num_rows))).combine_chunks()
        return t.to_batches()[0] if t.num_rows else pa.RecordBatch.from_pylist([], schema=t.schema)

    def _telling(self, at: np.ndarray) -> Sparse:
        at = at[self.words[at]]
        return at, np.ones(len(at), np.float32)

    def probabilities(self, batch: pa.RecordBatch) -> list[np.ndarray]:
        """Of good quality and of toxicity, for rows with text."""
        p, toxic = np.full(batch.num_rows, 0.5), np.zeros(batch.num_rows)
        if self.quality and batch.num_rows:
            p = np.concatenate([self.quality.probabilities(features(counts(part), self.idf))[:, 1] for part in groups(batch)])
        if self.toxic and batch.num_rows:
            w, b, t = self.toxic.weights, self.toxic.bias, self.toxic.temperature
            logits = np.array([w[at[self.words[at]]].sum(axis=0) + b for part in groups(batch) for at, _ in presence(part)], np.float64)
            toxic = softmax(logits / t)[:, 1]
        return [p, toxic]


def log_odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))
    return F.log(p / (1 - p))


def strength(rates: DataFrame, centre: Column) -> float:
    """Prior strength by moments: the groups' rates vary around their centre by chance and by a between-group variance."""
    row = rates.filter("n > 1").agg(
        F.sum(F.col("n") * (F.col("s") / F.col("n") - centre) ** 2).alias("spread"), F.sum("n").alias("n"), F.count("*").alias("groups"), F.sum(F.col("n") * centre * (1 - centre)).alias("chance")
    ).first()
    if not row.groups or row.groups < 2 or not row.chance:
        return STRONGEST
    between = (row.spread - row.chance * row.groups / row.n) / row.n
    within = row.chance / row.n
    return float(min(STRONGEST, max(WEAKEST, within / between - 1))) if between > 0 else STRONGEST


SCHEMA = "doc_id long, host string, path string, p_doc double, p_toxic double"


def quality(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None) -> DataFrame:
    """doc_id, p_doc, p_host, p_path, score, p_toxic, toxic and kept (score of 0.5 or more and not toxic) of every row.

    host is the column source and path the section lang of it, unless given; a null in either is a group of its own. A
    null text counts as empty. Without labels of both values the document's own evidence is 0.5, and nothing is toxic. Repeated rows give
    repeated rows, an empty table none. Learns when called.
    """
    models = Classifiers(docs, labels)
    work = shared_dir(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, toxic = models.probabilities(batch)
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in ("doc_id", "host", "path")] + [pa.array(p, pa.float64()), pa.array(toxic, pa.float64())], ["doc_id", "host", "path", "p_doc", "p_toxic"])

    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    keys = [F.coalesce(x.cast("string"), F.lit("")).alias(n) for x, n in ((host, "host"), (path, "path"))]
    own = shared_table(in_small_batches(docs).select("doc_id", *keys, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, SCHEMA), f"{work}/own")
    by_path = shared_table(own.groupBy("host", "path").agg(F.count("*").alias("n"), (F.sum(F.round(F.col("p_doc") / UNIT).cast("long")) * UNIT).alias("s")), f"{work}/paths")
    whole = by_path.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    centre = whole.s / whole.n if whole.n else 0.5
    by_host = by_path.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    k_host = strength(by_host, F.lit(centre))
    hosts = by_host.select("host", ((F.col("s") + k_host * centre) / (F.col("n") + k_host)).alias("p_host"))
    paths = by_path.join(hosts, "host")
    k_path = strength(paths, F.col("p_host"))
    rest_s, rest_n = F.col("s") - F.col("p_doc"), F.col("n") - 1
    out = own.join(paths, ["host", "path"]).withColumn("p_path", (rest_s + k_path * F.col("p_host")) / (rest_n + k_path))
    score = 1 / (1 + F.exp(-(log_odds(F.col("p_doc")) + log_odds(F.col("p_path")) - float(np.log(max(centre, EDGE) / max(1 - centre, EDGE))))))
    out = out.withColumn("score", score).withColumn("toxic", F.col("p_toxic") >= 0.5)
    return out.select("doc_id", "p_doc", "p_host", "p_path", "score", "p_toxic", "toxic", ((F.col("score") >= 0.5) & ~F.col("toxic")).alias("kept"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
