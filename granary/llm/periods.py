"""Periodic runs of words: every document against itself at every lag.

A run of period q shows as a stretch of places whose words equal the words q places on. The word ids of many documents lie in one
array, longest document first, so the documents that a lag still concerns are a prefix of it, and one comparison of that
prefix with its shift serves them all. An id is one of its document, so no stretch crosses into the next one. A lag goes up to
n / min_exponent. A stretch that can be part of a run is at least so long that it covers a place out of every so many: a lag none of whose
such places agree has no run, and is compared no further.

Comparisons grow with the square of a document's words. Where they are more than COMPARISONS, Spark deals the document's lags in ranges
to several tasks, and the stretches that they find meet again by document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, giving_back, in_small_batches, slices, table, text_bytes, text_column, words_of

#: Comparisons of words that one task makes for one document; more are dealt to several tasks by lag.
COMPARISONS = 4_000_000_000

#: Gives, for the ids of documents and the offsets of their words, the number of the word that stands in each place.
Places = Callable[[list, np.ndarray], np.ndarray]


class Words:
    """The words of some documents, in their places: ids (equal words have equal ones), and the documents' offsets in them."""

    def __init__(self, doc_ids: list, texts: pa.Array, places: Places | None):
        raw, off = text_bytes(texts)
        starts, ends, doc = words_of(raw, off)
        inner, size = raw[~WHITE[raw]], ends - starts
        bounds = np.concatenate([[0], np.cumsum(size)])
        words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(inner)])
        coded = words.dictionary_encode()
        self.kinds = max(1, len(coded.dictionary))
        self.bounds = np.searchsorted(doc, np.arange(len(off)))
        self.at = np.arange(len(size)) if places is None else places(doc_ids, self.bounds)
        self.ids = coded.indices.to_numpy()[self.at].astype(np.int64)
        # each word with a space after it
        spaced = np.full(len(inner) + len(size), 0x20, np.uint8)
        spaced[np.arange(len(inner)) + np.repeat(np.arange(len(size)), size)] = inner
        self.spaced = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(bounds + np.arange(len(bounds))), pa.py_buffer(spaced)])

    def joined(self, kept: np.ndarray) -> list[bytes]:
        """The kept words of each document, joined by one space."""
        data, ends = text_bytes(self.spaced.take(pa.array(self.at[kept])))
        cuts = ends[np.concatenate([[0], np.cumsum(kept)])[self.bounds]]
        return [data[a : max(a, b - 1)].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]


#: document, start, length and period, each an array.
Runs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def least_periods(doc: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> Runs:
    """Of equal stretches the one of the least period, by document, start and period.

    A stretch of a multiple of its least period has the same ends as that of the least period, as it is four times as long.
    """
    order = np.lexsort((period, length, start, doc))
    doc, start, length, period = (x[order] for x in (doc, start, length, period))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    order = np.flatnonzero(new)
    order = order[np.lexsort((period[order], start[order], doc[order]))]
    return doc[order], start[order], length[order], period[order]


def stretches(words: Words, min_exponent: int, least: int, part: int = 0, parts: int = 1) -> Runs:
    """Runs of all documents with lags in one of so many even ranges of each document's lags."""
    n = np.diff(words.bounds)
    order = np.argsort(-n, kind="stable")
    n = n[order]
    ends = np.concatenate([[0], np.cumsum(n)])
    shift = words.bounds[:-1][order] - ends[:-1]
    doc = np.repeat(np.arange(len(n)), n)
    ids = words.ids[np.arange(ends[-1]) + shift[doc]] + doc * words.kinds
    lags = int(n[0]) // min_exponent if len(n) else 0
    found: list[list[np.ndarray]] = []
    for q in range(1 + part * lags // parts, 1 + (part + 1) * lags // parts):
        some = ids[: ends[np.searchsorted(-n, -min_exponent * q, side="right")]]
        need = max(least - q, (min_exponent - 1) * q)
        if not (some[q::need] == some[:-q:need]).any():
            continue
        same = np.flatnonzero(some[q:] == some[:-q])
        breaks = np.flatnonzero(np.diff(same) != 1)
        first, last = same[np.append(0, breaks + 1)], same[np.append(breaks, len(same) - 1)]
        long = last - first + 1 >= need
        if long.any():
            first, last = first[long], last[long]
            found.append([doc[first], first - ends[doc[first]], last - first + 1 + q, np.full(len(first), q)])
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    d, *rest = (np.concatenate(x) for x in zip(*found))
    return least_periods(order[d], *rest)


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def told(ids: pa.Array, words: Words, runs: Runs, keep: bool) -> pa.RecordBatch:
    doc, start, length, period = runs
    total = words.bounds[-1]
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, words.bounds[doc] + start + period, 1)
    np.add.at(edge, words.bounds[doc] + start + length, -1)
    texts = words.joined(np.cumsum(edge)[:-1] == 0)
    cuts = np.searchsorted(doc, np.arange(len(words.bounds)))
    lines = [b"%d,%d,%d\n" % x for x in zip(start.tolist(), length.tolist(), period.tolist())]
    best = np.full(len(cuts) - 1, -1)
    order = np.lexsort((period, start, -length, doc))
    some = np.flatnonzero(np.diff(cuts))
    best[some] = order[cuts[some]]
    none = best < 0
    chosen = np.maximum(best, 0)
    of = lambda x: pa.array(x[chosen] if len(x) else np.zeros(len(best), np.int64), pa.int64(), mask=none)
    columns = [ids, pa.array(np.diff(cuts), pa.int64()), of(start), of(length), of(period), of(1000 * length // np.maximum(period, 1))]
    columns += [pa.array([hashlib.sha256(b"".join(lines[a:b])).hexdigest() for a, b in zip(cuts[:-1], cuts[1:])], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    if keep:
        columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])))
        columns.append(pa.array([x.decode() for x in texts], pa.string()))
        names += ["runs", "collapsed"]
    return pa.RecordBatch.from_arrays(columns, names)


def periodic_runs(docs: DataFrame, min_exponent: int = 4, least: int = 6, places: Places | None = None, keep: bool = False) -> DataFrame:
    """Runs of repeated word sequences in each text, and the text with only the first period of each left.

    A run is a stretch of words of the least period q that is at least min_exponent * q and least words long and as long as it can
    be; the start, length and period of the longest (ties: least start, then least period) are columns, null where there is none.
    keep adds all runs (array of start, length, period, by start and period) and the collapsed text. places puts
    other words of a document into its places before it is looked at.

    A null text is empty; an empty or wordless one has no runs and the digest of nothing. A null doc_id stays null; repeated rows give
    repeated rows; columns other than doc_id and text play no part, whatever their names; an empty table gives an empty one. A very long
    text is held whole in each task that has a range of its lags, at some 50 bytes a word, and its comparisons are shared out.
    min_exponent is 2 or more.
    """
    schema = SCHEMA + (", runs array<struct<start:long,length:long,period:long>>, collapsed string" if keep else "")
    # a text has at most one word for two bytes; of those that may be too long for one task the words are counted
    words = F.length(F.regexp_replace(F.regexp_replace("text", r"[^\x20\x09-\x0D]+", "x"), r"[\x20\x09-\x0D]+", "")).cast("double")
    limit = 2 * (min_exponent * COMPARISONS) ** 0.5
    parts = F.when(F.octet_length("text") < limit, 1).otherwise(F.greatest(F.lit(1), F.ceil(words * words / (min_exponent * COMPARISONS)))).cast("int")
    rows = docs.select(F.col("doc_id").cast("long"), text_column())

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = Words(part.column("doc_id").to_pylist(), part.column("text"), places)
                yield told(part.column("doc_id"), w, stretches(w, min_exponent, least), keep)

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row in enumerate(batch.select(["part", "parts"]).to_pylist()):
                one = batch.slice(k, 1)
                w = Words(one.column("doc_id").to_pylist(), one.column("text"), places)
                found = stretches(w, min_exponent, least, row["part"], row["parts"])[1:]
                yield pa.RecordBatch.from_arrays([one.column("doc_id"), one.column("print"), *(pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in found)], ["doc_id", "print", "start", "length", "period"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                found = [np.concatenate([np.zeros(0, np.int64)] + [np.frombuffer(x[name], "<i8") for x in one.column("found")[0].as_py() or []]) for name in ("start", "length", "period")]
                w = Words(one.column("doc_id").to_pylist(), one.column("text"), places)
                yield told(one.column("doc_id"), w, least_periods(np.zeros(len(found[0]), np.int64), *found), keep)

    sized = in_small_batches(rows).withColumn("parts", parts)
    short = sized.filter("parts = 1").select("doc_id", "text").mapInArrow(giving_back(whole), schema)
    long = sized.filter("parts > 1").withColumn("print", F.sha2("text", 256))
    different = long.groupBy("doc_id", "print").agg(F.first("text").alias("text"), F.first("parts").alias("parts"))
    ranges = different.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).repartition("doc_id", "print", "part")
    found = ranges.mapInArrow(giving_back(ranged), "doc_id long, print string, start binary, length binary, period binary")
    found = found.groupBy(F.col("doc_id").alias("its_id"), F.col("print").alias("its_print")).agg(F.collect_list(F.struct("start", "length", "period")).alias("found"))
    both = long.join(found, F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("print") == F.col("its_print")), "left").select("doc_id", "text", "found")
    return short.unionByName(both.mapInArrow(giving_back(gathered), schema))


def planted(doc_ids: list, bounds: np.ndarray) -> np.ndarray:
    """From some place on, a tenth of the documents (by CRC-32 of the id) repeat the words from there."""
    at = np.arange(bounds[-1])
    for d, lo, n in zip(doc_ids, bounds[:-1].tolist(), np.diff(bounds).tolist()):
        h = 1 if d is None else zlib.crc32(b"%d" % d)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            at[lo + a : lo + n] = lo + a + np.arange(n - a) % p
    return at


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), places=planted)
