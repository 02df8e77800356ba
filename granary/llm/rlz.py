"""Substring deduplication by relative Lempel-Ziv parsing against all blocks of documents with smaller ids.

1. Seeds. Each window of WORDS words has a seed, the least of the fingerprints of the runs of SEED words in it, so equal
   windows have equal seeds. An exchange of seeds tells which of them several documents have; windows of other seeds are literals.
2. Index. The remaining windows are looked up in the index of all reference blocks (dealt by fingerprint): the answer is the
   reference, the first place of the window in the document of the least id that has it.
3. Parsing. A document is read from left to right. Where a window has a reference in a document with a smaller id, a factor begins; it grows as
   long as the next window's reference is the next place of the same document. Windows across the boundary of two factors have been
   looked up like all others and begin a factor of their own, so no duplicate window is lost there. A factor has WORDS words at least; factors are
   the duplicate spans, all else is literal and stays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import BYTE_VALUES, Fingerprints, shared_dir, shared_table, shuffles_removed, table, text_bytes, words_of
from .grams import Items, blocks, bucket_count, check_bits, distinct, exchange, heard, in_order, sending, sent, shared

WORDS, SEED = 13, 7


class Parsed:
    """The words of a block's documents, and its windows: first word, document and seed."""

    def __init__(self, group: pa.Table, size: int):
        group = in_order(group)
        self.id_column = group.column("doc_id")
        self.raw, self.off = text_bytes(group.column("text"))
        self.starts, self.ends, self.doc = words_of(self.raw, self.off)
        self.words = Fingerprints(BYTE_VALUES[self.raw]).of(self.starts, self.ends)
        self.size, n = size, len(self.words) - size + 1
        self.at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :]) if n > 0 else np.zeros(0, np.int64)
        self.known = self.id_column.is_valid().to_numpy()[self.doc[self.at]]
        self.ids = self.id_column.fill_null(0).to_numpy()
        self.first = np.searchsorted(self.doc, np.arange(len(self.off) - 1))

    def seeds(self) -> np.ndarray:
        """Of all windows."""
        short = min(SEED, self.size)
        runs = Fingerprints(self.words, 0x2545F4914F6CDD1D).windows(short)
        out = runs[self.at]
        for k in range(1, self.size - short + 1):
            np.minimum(out, runs[self.at + k], out=out)
        return out

    def distinct_seeds(self) -> Items:
        """Those of documents with an id, and whether several documents of the block have them."""
        prints, doc = self.seeds()[self.known], self.doc[self.at[self.known]]
        order = np.argsort(prints, kind="stable")  # documents stay in order
        x, d = prints[order], doc[order]
        new = np.append(True, x[1:] != x[:-1])[: len(x)]
        last = np.append(new[1:], True)[: len(x)]
        return {"prints": x[new], "twice": (d[last] != d[new]).astype(np.int64)}

    def prints(self, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray | None]:
        """Fingerprints of the windows that begin at some words, with so many check bits."""
        prints = Fingerprints(self.words, 0x9E6C63D0876A9A95).of(at, at + self.size)
        if not width:
            return prints, None
        words = Fingerprints(BYTE_VALUES[self.raw], 0xD1342543DE82EF95).of(self.starts, self.ends)
        return prints, Fingerprints(words, 0xAEF17502108EF2D9).of(at, at + self.size) >> np.uint64(64 - width)


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n places lie in a span of that size from one of the starts."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + size, -1)
    return np.cumsum(step[:n], dtype=np.int32) > 0


def first_places(items: Items, row: np.ndarray) -> tuple[np.ndarray, Items]:
    """Settles where each window is first: of each, the least id and the least place in it, for the blocks that have it later."""
    _, number = distinct(items["prints"].view(np.uint64), items.get("check"))
    order = np.lexsort((items["place"], items["id"], number))
    begins = np.append(True, np.diff(number[order]) > 0)[: len(order)]
    first = order[begins][number] if len(order) else order
    ref, at = items["id"][first], items["place"][first]
    return (ref < items["id"]) | ((ref == items["id"]) & (at < items["place"])), {"id": ref, "place": at}


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
FACTORS = "array<struct<at:long,words:long,reference:long,reference_at:long>>"


def factored(docs: DataFrame, size: int = WORDS, keep: bool = False) -> DataFrame:
    """Each document without the words of factors found in documents with a smaller id.

    keep adds the text that is left and the factors: place and number of words, the id of the reference and the place there.
    Windows are judged on the input. A null or wordless text has no words. Documents of the same id are not each other's
    references. A document with a null id is no reference, and nothing is removed from it. Of references that tie, the least
    place counts. Repeated rows give repeated rows, an empty table none, and other columns are not read. Runs the exchange of seeds when called.
    """
    rows, volume = blocks(docs)
    work, n = shared_dir(docs.sparkSession), volume // 6
    seed_buckets, buckets, width = bucket_count(n // 4), bucket_count(n // 3), check_bits(n)
    columns = ["prints", "id", "place", *(["check"] if width else [])]

    def send_seeds(group: pa.Table) -> pa.Table:
        return sent(group.column("block")[0].as_py(), Parsed(group, size).distinct_seeds(), ["prints", "twice"], seed_buckets)

    def indexed(p: Parsed, seeds: pa.Table) -> tuple[np.ndarray, np.ndarray, Items]:
        """The windows with a shared seed; the number of each among the different ones; and of these what is sent, by their first places."""
        own = p.distinct_seeds()["prints"]
        at, _ = heard(own, seeds, [], seed_buckets)
        live = p.at[np.isin(p.seeds(), own[at]) & p.known]
        prints, check = p.prints(live, width)
        first, number = distinct(prints, check)
        in_text = np.argsort(first)  # sent as they stand in the texts, where ids and places pack well
        place = np.empty(len(first), np.int64)
        place[in_text] = np.arange(len(first))
        first = first[in_text]
        word = live[first]
        items = {"prints": prints[first], "id": p.ids[p.doc[word]], "place": word - p.first[p.doc[word]]}
        return live, place[number], items | ({"check": check[first]} if width else {})

    def send(group: pa.Table, seeds: pa.Table) -> pa.Table:
        return sent(group.column("block")[0].as_py(), indexed(Parsed(group, size), seeds)[2], columns, buckets) if group.num_rows else sent(0, {k: np.zeros(0, np.uint64) for k in columns}, columns, buckets)

    def finish(group: pa.Table, seeds: pa.Table, answers: pa.Table) -> pa.Table:
        p = Parsed(group, size)
        live, number, items = indexed(p, seeds)
        ref, at = items["id"].copy(), items["place"].copy()
        told, values = heard(items["prints"], answers, ["id", "place"], buckets)
        ref[told], at[told] = values["id"], values["place"]
        ref, at = ref[number], at[number]
        found = ref < p.ids[p.doc[live]]
        return result(p, live[found], ref[found], at[found], keep)

    with shuffles_removed(docs.sparkSession):
        known = shared_table(exchange(rows.groupBy("block").applyInArrow(send_seeds, sending(["prints", "twice"])), ["prints", "twice"], shared, []), f"{work}/seeds")
    sends = rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(send, sending(columns))
    answers = exchange(sends, columns, first_places, ["id", "place"])
    return both(rows, known, answers, ["id", "place"], finish, SCHEMA + (f", kept string, factors {FACTORS}" if keep else ""))


def both(rows: DataFrame, early: DataFrame, late: DataFrame, values: list[str], finish, schema: str) -> DataFrame:
    """finish(rows, early answers, late answers) of each block."""
    from pyspark.sql import functions as F

    early = early.select("block", "bucket", "hits", *(F.lit(None).cast("binary").alias(k) for k in values), F.lit(False).alias("late"))
    every = early.unionByName(late.withColumn("late", F.lit(True)))

    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        late = answers.column("late").to_numpy()
        return finish(group, answers.filter(pa.array(~late)), answers.filter(pa.array(late)))

    return rows.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(run, schema)


def result(p: Parsed, at: np.ndarray, ref: np.ndarray, ref_at: np.ndarray, keep: bool) -> pa.Table:
    """Counts and the kept words, joined by one space: bytes of kept words and of one byte after each but a document's last."""
    gone = covered(at, p.size, len(p.starts))
    kept = np.flatnonzero(~gone)
    last = np.append(p.doc[kept][1:] != p.doc[kept][:-1], True) if len(kept) else np.zeros(0, bool)
    data = np.append(p.raw, np.uint8(0x20))
    ends = p.ends[kept]
    data[ends[~last]] = 0x20
    stop = ends + ~last
    step = np.zeros(len(data) + 1, np.int32)
    step[p.starts[kept]] += 1
    step[stop] -= 1
    inside = np.cumsum(step[: len(data)], dtype=np.int32) > 0
    out = data[inside].tobytes()
    sizes = np.concatenate([[0], np.cumsum(inside)])[p.off]
    n = len(p.off) - 1
    texts = [out[a:b] for a, b in zip(sizes[:-1], sizes[1:])]
    columns = {
        "doc_id": p.id_column, "n_words": pa.array(np.bincount(p.doc, minlength=n).astype(np.int64)), "n_removed": pa.array(np.bincount(p.doc[gone], minlength=n).astype(np.int64)),
        "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
    }
    if keep:
        columns["kept"] = pa.array([t.decode() for t in texts], pa.string())
        columns["factors"] = factors(p, at, ref, ref_at)
    return pa.table(columns)


def factors(p: Parsed, at: np.ndarray, ref: np.ndarray, ref_at: np.ndarray) -> pa.Array:
    """Each document's factors from its windows with a reference. What a factor shares with the one before is cut off its beginning."""
    doc = p.doc[at]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(ref_at) != 1) | (np.diff(ref) != 0) | (np.diff(doc) != 0)
    begin = np.flatnonzero(new)
    stop = at[np.append(begin[1:], len(at))[: len(begin)] - 1] + p.size
    start, doc = at[begin], doc[begin]
    cut = np.zeros(len(begin), np.int64)
    cut[1:] = np.where(doc[1:] == doc[:-1], np.maximum(stop[:-1] - start[1:], 0), 0)
    fields = {"at": start + cut - p.first[doc], "words": stop - start - cut, "reference": ref[begin], "reference_at": ref_at[begin] + cut}
    each = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in fields.values()], list(fields))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(p.off))), pa.int32()), each)


def op1_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factored(table(spark, sf_dir, "documents"))


OP1_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, pos, array_to_string(list_slice(w, pos, pos + {WORDS - 1}), ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {WORDS - 1})) AS pos FROM d WHERE len(w) >= {WORDS})),
f AS (SELECT s, min(doc_id) AS first_id FROM g GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(pos, pos + {WORDS - 1})) AS pos FROM g JOIN f ON f.s = g.s WHERE first_id < doc_id),
kept AS (
  SELECT w.doc_id AS doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY w.pos) AS text FROM (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS pos FROM d) w
  LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.pos = w.pos WHERE gone.pos IS NULL GROUP BY w.doc_id)
SELECT d.doc_id AS doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
