"""Benchmark decontamination by a prefix-filtered containment join, in DataFrame operations only.

Each benchmark item gives windows of SIZE consecutive words (a shorter item is one window). A document contains a window
only if it contains the window's rarest word, so that one word is the necessary prefix. Rarity is the number of
occurrences in the whole corpus. Joining the documents' words with these prefix words gives candidates; the window's length and the
word's place in it say where the window would have to start, which must lie inside the document; and the words
there are compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, shared_dir, shared_table, table, without
from .urls import LOWER, UPPER

SIZE = 10
#: Windows whose prefixes are broadcast at once (some 200 bytes each); more of them take more passes over the documents.
MOST_WINDOWS = 100_000

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z became a-z; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SPLIT), "")


def windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """The distinct windows: words, and the items (as strings) that have them."""
    w = F.col("words")
    starts = F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1)))
    return (
        benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("words"))
        .filter(F.size("words") > 0)
        .select("item", "words", F.explode(starts).alias("at"))
        .groupBy(F.slice(w, F.col("at"), size).alias("window"))
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )


def prefixes(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Each window with its rarest word in the corpus (ties: the least word) and that word's first place in it."""
    vocabulary = found.select(F.explode("window").alias("word")).distinct()
    small = vocabulary.count() <= MOST_WINDOWS
    said = docs.select(F.explode(words(F.col("text"))).alias("word"))
    counts = said.join(F.broadcast(vocabulary) if small else vocabulary, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    each = found.select("window", "items", F.posexplode("window").alias("place", "word")).join(counts, "word")
    # A window with a word that no document has can't occur; the inner join leaves that word out, so compare the numbers of words.
    best = each.groupBy("window").agg(F.min(F.struct("n", "word", "place")).alias("rarest"), F.first("items").alias("items"), F.count("*").alias("known"))
    return best.filter(F.col("known") == F.size("window")).select(F.col("rarest.word").alias("word"), F.col("rarest.place").alias("place"), "window", "items")


def occurrences(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """For each document one row without a window (n_words), and one for each place where a window occurs (start, length, items).

    A blank stands for "every document" among the words: no word has one, so its row passes the join once for each document.
    """
    work = shared_dir(docs.sparkSession)
    table_ = shared_table(prefixes(windows(benchmark, size), docs), f"{work}/prefixes")
    passes = max(1, -(-table_.count() // MOST_WINDOWS))
    every = table_.sparkSession.range(1).select(F.lit(" ").alias("word"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("array<string>").alias("window"), F.lit(None).cast("array<string>").alias("items"))
    base = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.array_append(words(F.col("text")), F.lit(" ")).alias("words"))
    said = base.select("doc_id", "text_key", "words", F.posexplode("words").alias("at", "word"))
    out = None
    for k in range(passes):
        part = table_.filter(F.pmod(F.xxhash64("window"), F.lit(passes)) == k)
        part = part.unionByName(every) if k == 0 else part
        start, length = F.col("at") - F.col("place"), F.size("window")
        inside = (start >= 0) & (start + length <= F.size("words") - 1)
        # place is null for the row that each document has
        hits = said.join(F.broadcast(part), "word").filter(F.col("place").isNull() | (inside & (F.slice(F.col("words"), F.when(inside, start + 1).otherwise(1), length) == F.col("window"))))
        hits = hits.select("doc_id", "text_key", F.when(F.col("place").isNull(), F.size("words") - 1).alias("n_words"), start.alias("start"), length.alias("length"), "items")
        out = hits if out is None else out.unionByName(hits)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_hit (words inside occurrences), n_items, items_sha256 and contaminated, for every row.

    A null or wordless text has no words and hits nothing; a null item_id counts as an empty string; equal rows
    give equal results as often as they are repeated. An empty benchmark leaves every document clean, and an empty table gives no rows. Of
    words that are equally rare the least is the prefix, which changes no row. Other columns are not read.
    """
    rows = occurrences(docs, benchmark, size)
    end = F.col("start") + F.col("length")
    before = Window.partitionBy("doc_id", "text_key").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("covered", F.greatest(end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0))), F.lit(0)))
    items = F.array_distinct(F.flatten(F.collect_set("items")))
    copies = F.count("n_words")
    done = rows.groupBy("doc_id", "text_key").agg(F.max("n_words").cast("long").alias("n_words"), F.coalesce(F.sum("covered"), F.lit(0)).cast("long").alias("n_hit"), items.alias("items"), copies.alias("copies"))
    done = done.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return done.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """The documents (all columns, whatever their names) without those that contain a window.

    A null or wordless text stays, and so does everything where the benchmark is empty; repeated rows and rows with equal id and text have the
    same fate, those of one id with different texts each their own; a null id is an id like others. An empty table stays empty.
    """
    bad_id, bad_key = fresh(docs, "bad_id", "bad_key")
    bad = occurrences(docs, benchmark, size).filter(F.col("length").isNotNull()).select(F.col("doc_id").alias(bad_id), F.col("text_key").alias(bad_key)).distinct()
    return without(docs, bad, F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.xxhash64("text") == F.col(bad_key)), shared_dir(docs.sparkSession))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP3_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT item_id, least(len(w), {SIZE}) AS size, unnest(generate_series(1, greatest(len(w) - {SIZE - 1}, 1))) AS pos, w FROM b WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, size, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS s FROM bw),
sizes AS (SELECT DISTINCT size FROM bs),
dw AS (
  SELECT doc_id, size, unnest(generate_series(1, len(w) - size + 1)) AS pos, w FROM d, sizes WHERE len(w) >= size),
hits AS (
  SELECT doc_id, dw.size AS size, pos, item_id FROM dw JOIN bs ON bs.size = dw.size AND bs.s = array_to_string(list_slice(w, pos, pos + dw.size - 1), ' ')),
words AS (
  SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(generate_series(pos, pos + size - 1)) AS pos FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""
