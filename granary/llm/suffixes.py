"""Suffix-array deduplication by difference-cover blockwise construction.

Two suffixes tie if their first LENGTH bytes are equal; bytes under a tie are duplicates. Sorting all suffixes at once would
take many times the text, so the work is cut by a difference cover and by buckets:

1. Cover sample. Of each document the suffixes at places whose remainder modulo PERIOD is in COVER are sampled. For any two
   suffixes some shift below PERIOD brings both to sampled places, so a tie of LENGTH bytes holds a tie of two sampled
   suffixes over LENGTH - PERIOD + 1 bytes. Sorting the samples bucket by bucket gives their ranks, of which only one
   thing is needed later: whether a sample's rank is shared.
2. Suffix buckets. A suffix without a shared rank among the samples of its first PERIOD places ties with nothing and is left out.
   The others are sorted one bucket at a time by their first LENGTH bytes; those that share a place in the order are ties.

Suffixes are bucketed and sorted by fingerprints of these bytes (64 bits and the check bits that the corpus needs), not by the bytes: equality
is all that matters here, the buckets are even for any text, and a bucket holds a bounded number of packed numbers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import BYTE_VALUES, Fingerprints, shared_dir, shared_table, shuffles_removed, table, text_bytes
from .grams import Items, blocks, bucket_count, check_bits, distinct, exchange, heard, in_order, sending, sent, shared
from .rlz import both, covered

LENGTH = 200
#: Bytes of text in a block, about; a task needs some 40 bytes for each.
BLOCK_BYTES = 3 << 20


def difference_cover(q: int = 11) -> tuple[int, list[int]]:
    """A perfect difference set of q + 1 residues modulo q*q + q + 1, for a prime q: every difference is that of two of them.

    These are the exponents of the powers of a generator of the field with q**3 elements that lie in a plane (Singer).
    """
    v = q * q + q + 1

    def times_x(a: tuple[int, int, int], c: tuple[int, int, int]) -> tuple[int, int, int]:
        return (a[2] * c[0] % q, (a[0] + a[2] * c[1]) % q, (a[1] + a[2] * c[2]) % q)

    for code in range(q**3):
        c = (code % q, code // q % q, code // q**2)  # x**3 = c0 + c1 x + c2 x**2
        seen, a = [], (1, 0, 0)
        for i in range(v):
            if a[2] == 0:
                seen.append(i)
            a = times_x(a, c)
        if len(seen) == q + 1 and len({(x - y) % v for x in seen for y in seen}) == v:
            return v, seen
    raise ValueError(q)


PERIOD, COVER = difference_cover()


class Sampled:
    """A block's bytes, and the sampled places; at is a place in the block, all arrays are of 32 bits where they are as long as the text."""

    def __init__(self, group: pa.Table, length: int):
        group = in_order(group)
        self.id_column, self.length = group.column("doc_id"), length
        self.raw, self.off = text_bytes(group.column("text"))
        n = len(self.raw)
        sizes = np.diff(self.off)
        narrow = np.int32 if n < 1 << 31 else np.int64
        place = np.arange(n, dtype=narrow)
        place -= np.repeat(self.off[:-1].astype(narrow), sizes)
        self.begins = self.off[:-1][sizes > 0]  # where documents begin
        self.left = np.repeat(sizes.astype(narrow), sizes)  # bytes up to the document's end
        self.left -= place
        place %= PERIOD
        chosen = np.zeros(PERIOD, bool)
        chosen[COVER] = True
        self.places = np.flatnonzero(chosen[place] & (self.left >= length - PERIOD + 1))

    def prints(self, at: np.ndarray, size: int, base: int = Fingerprints.BASE) -> np.ndarray:
        return Fingerprints(BYTE_VALUES[self.raw], base).of(at, at + size)

    def samples(self) -> np.ndarray:
        return self.prints(self.places, self.length - PERIOD + 1)

    def live(self, shared: np.ndarray) -> np.ndarray:
        """The suffixes with a shared rank among the samples of their first PERIOD places, and as many bytes as a tie has."""
        n = len(self.raw)
        return np.flatnonzero(covered(np.maximum(self.places[shared] - PERIOD + 1, 0), PERIOD, n + PERIOD)[:n] & (self.left >= self.length)) if n else np.zeros(0, np.int64)


def once(prints: np.ndarray, check: np.ndarray | None = None) -> tuple[Items, np.ndarray]:
    """What a block sends: its different fingerprints in order and which of them it has more than once; and the number of each."""
    first, number = distinct(prints, check)
    items = {"prints": prints[first], "twice": (np.bincount(number, minlength=len(first)) > 1).astype(np.int64)}
    return items | ({"check": check[first]} if check is not None else {}), number


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def without_repeats(docs: DataFrame, length: int = LENGTH, keep: bool = False) -> DataFrame:
    """Each document without the bytes of strings of that length that also start elsewhere, its own text included.

    A null text is empty. Strings are judged on the input and overlap; n_spans counts the maximal removed runs. Repeated rows, and
    rows with a null or equal doc_id, are documents of their own; an empty table gives no rows, and other columns are not read. keep adds the
    bytes that are left. Runs the jobs of the cover sample when called; their answers are written to the shared folder.
    """
    rows, volume = blocks(docs, BLOCK_BYTES)
    work = shared_dir(docs.sparkSession)
    sample_buckets, buckets, width = bucket_count(volume * len(COVER) // PERIOD), bucket_count(volume // 5), check_bits(volume)
    columns = ["prints", "twice", *(["check"] if width else [])]

    def send_samples(group: pa.Table) -> pa.Table:
        return sent(group.column("block")[0].as_py(), once(Sampled(group, length).samples())[0], ["prints", "twice"], sample_buckets)

    def suffixes(s: Sampled, ranks: pa.Table) -> tuple[np.ndarray, Items, np.ndarray]:
        own, number = once(s.samples())
        shared_ = np.zeros(len(own["prints"]), bool)
        shared_[heard(own["prints"], ranks, [], sample_buckets)[0]] = True
        at = s.live(shared_[number])
        check = s.prints(at, length, 0xD1342543DE82EF95) >> np.uint64(64 - width) if width else None
        return at, *once(s.prints(at, length), check)

    def send(group: pa.Table, ranks: pa.Table) -> pa.Table:
        return sent(group.column("block")[0].as_py(), suffixes(Sampled(group, length), ranks)[1], columns, buckets) if group.num_rows else sent(0, {k: np.zeros(0, np.uint64) for k in columns}, columns, buckets)

    def finish(group: pa.Table, ranks: pa.Table, ties: pa.Table) -> pa.Table:
        s = Sampled(group, length)
        at, items, number = suffixes(s, ranks)
        tied = np.zeros(len(items["prints"]), bool)
        tied[heard(items["prints"], ties, [], buckets)[0]] = True
        gone = covered(at[tied[number]], length, len(s.raw))
        total = np.concatenate([[0], np.cumsum(gone)])[s.off]
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        first[s.begins] = gone[s.begins]
        spans = np.concatenate([[0], np.cumsum(first)])[s.off]
        left = s.raw[~gone].tobytes()
        ends = s.off - total
        texts = [left[a:b] for a, b in zip(ends[:-1], ends[1:])]
        columns = {
            "doc_id": s.id_column, "n_bytes": pa.array(np.diff(s.off)), "n_removed": pa.array(np.diff(total).astype(np.int64)), "n_spans": pa.array(np.diff(spans).astype(np.int64)),
            "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
        }
        if keep:
            columns["kept"] = pa.array(texts, pa.binary())
        return pa.table(columns)

    with shuffles_removed(docs.sparkSession):
        ranks = shared_table(exchange(rows.groupBy("block").applyInArrow(send_samples, sending(["prints", "twice"])), ["prints", "twice"], shared, []), f"{work}/ranks")
    sends = rows.groupBy("block").cogroup(ranks.groupBy("block")).applyInArrow(send, sending(columns))
    return both(rows, ranks, exchange(sends, columns, shared, []), [], finish, SCHEMA + (", kept binary" if keep else ""))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
