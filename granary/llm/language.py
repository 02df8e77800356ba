"""Language identification: TF-IDF character n-grams (1 to 3), FTRL multinomial logistic regression, calibrated by temperature.

Document frequencies come from all training rows; the weights from about SAMPLE of them for each language, or fewer where more than
ROWS rows of all languages would come together. Every language of the training rows is a class. The language, source
and id of a document are never inputs of its prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, giving_back, table
from .linear import Model, document_frequencies, features, gram_counts, groups, idf, sample, sparse

#: Training rows for each language, about; and of all languages together, but LEAST_SAMPLE of each.
SAMPLE, ROWS, LEAST_SAMPLE = 400, 20_000, 20
UNKNOWN = "und"
#: In filtering, documents whose best language is less certain than this are rejected.
LEAST_SCORE = 0.5


def held_out() -> Column:
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


class Languages:
    """A trained model; classes is empty if no row could be learned from."""

    def __init__(self, train: DataFrame):
        """train: text and lang; rows with a null in either are left out."""
        train = train.select("text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
        self.classes = sorted(r.lang for r in train.select("lang").distinct().collect())
        if not self.classes:
            return
        df, total = document_frequencies(train)
        self.idf = idf(df, total)
        most = min(SAMPLE, max(LEAST_SAMPLE, ROWS // len(self.classes)))
        few = sample(train, "lang", most).toArrow().sort_by([("lang", "ascending"), ("text", "ascending")])
        order = np.random.default_rng(3).permutation(few.num_rows)
        few = few.take(pa.array(order)).combine_chunks().to_batches()[0]
        x = [row for part in groups(few) for row in sparse(features(gram_counts(part), self.idf))]
        number = {c: k for k, c in enumerate(self.classes)}
        self.model = Model(self.classes).fit(x, np.array([number[v] for v in few.column("lang").to_pylist()]), len(self.idf))

    def predict(self, batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
        """The language and its probability for each row of a column text without nulls."""
        names, scores = [], []
        for part in groups(batch):
            if self.classes:
                p = self.model.probabilities(features(gram_counts(part), self.idf))
                best, score = p.argmax(axis=1), p.max(axis=1)
            for k, text in enumerate(part.column("text").to_pylist()):
                known = bool(self.classes) and any(map(str.isalpha, text))
                names.append(self.classes[best[k]] if known else UNKNOWN)
                scores.append(float(score[k]) if known else 0.0)
        return names, np.array(scores)


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def identify(docs: DataFrame) -> DataFrame:
    """lang_pred and score of every row, by a model of the rows that aren't held out.

    A null or letterless text is "und" with score 0, as is every text if no language could be learned. Of languages that tie, the
    first in their order is predicted. Repeated rows give repeated rows and are learned from once, an empty table gives none, and other columns
    are not read. Learns when called.
    """
    model = Languages(docs.filter(~held_out()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = model.predict(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(giving_back(run), SCHEMA)


def in_known_language(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows (all columns) whose text has a letter and a language of at least that score.

    A null or empty text goes; so do all rows where no language could be learned. Repeated rows have the same fate, and an empty table
    stays empty. Only texts are sent to Python, whatever other columns there are. Learns when called.
    """
    model = Languages(docs.filter(~held_out()))

    @F.arrow_udf("boolean")
    def known(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for column in texts:
                names, scores = model.predict(pa.RecordBatch.from_arrays([column.fill_null("")], ["text"]))
                yield pa.array((np.array(names, object) != UNKNOWN) & (scores >= least), pa.bool_())
        finally:
            give_back()

    return docs.filter(known(F.col("text")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
