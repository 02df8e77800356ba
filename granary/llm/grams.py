"""Which windows of a corpus occur elsewhere, and where first: an exchange of packed fingerprints.

Documents are gathered in blocks of about equally many bytes. A block sends its fingerprints to buckets of the fingerprint space, each
bucket's as one row of packed arrays, so it sends as many rows as it has fingerprints at most, and its work is in proportion to its text.
A bucket is sorted by itself, in one task, and answers each block by the places of its fingerprints there. The block makes its
fingerprints again and reads the answers. What repeats inside a block is sent once.

Beside the 64 bits that are sorted, a fingerprint has as many check bits as the corpus needs for an expected number of
false matches below FALSE_MATCHES in all of it, at any size.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, shared_table, text_column

#: Bytes of text in a block, about.
BLOCK_BYTES = 4 << 20
#: Fingerprints in a bucket, about.
BUCKET_SIZE = 2_000_000
FALSE_MATCHES = 0.01

Items = dict[str, np.ndarray]
#: Columns of items that are packed as they are.
PLAIN = ("check", "twice")


def pack(x: np.ndarray, differences: bool = True) -> bytes:
    """Whole numbers as compressed byte planes, of their differences or (for small numbers in no order) of themselves."""
    d = np.ascontiguousarray(x, "<i8").view("<u8")
    d = np.diff(d, prepend=np.uint64(0)) if differences else d
    return bytes([differences]) + len(d).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(pa.decompress(data[9:], decompressed_size=8 * n, codec="zstd"), np.uint8).reshape(8, n)
    x = np.ascontiguousarray(planes.T).view("<u8")[:, 0]
    return (np.cumsum(x, dtype=np.uint64) if data[0] else x).view(np.int64)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and salt: a number that equal rows differ in, the same in every job, whatever task reads a row.

    It is a hash of the row's file and place in it. Rows that aren't read from Parquet files as they are (a frame made in memory, a join)
    are first written to the shared folder.
    """
    text = [F.col("doc_id").cast("long"), text_column()]
    try:
        return docs.select(*text, F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("salt"))
    except AnalysisException:
        return identified(shared_table(docs.select(*text), f"{shared_dir(docs.sparkSession)}/rows"))


def blocks(docs: DataFrame, block_bytes: int | None = None) -> tuple[DataFrame, int]:
    """doc_id, text (null as empty) and block; and the corpus's bytes of text.

    A row's block is a hash of its id, text and place in the input: blocks are even whatever the ids are, equal rows are dealt to all of
    them, and a job that is planned anew, with other partitions, gives each block the same rows.
    """
    rows = identified(docs)
    size = rows.agg(F.sum(F.octet_length("text")).alias("size")).first().size or 0
    count = max(1, -(-size // (block_bytes or BLOCK_BYTES)))
    return rows.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text", "salt"), F.lit(count)).alias("block")), size


def in_order(group: pa.Table) -> pa.Table:
    """A block's rows in an order that no shuffle changes."""
    return group.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()


def bucket_count(fingerprints: int) -> int:
    """A power of two."""
    return 1 << max(0, (max(1, fingerprints) // BUCKET_SIZE).bit_length())


def check_bits(fingerprints: int) -> int:
    """How many bits beside 64 keep the expected false matches, one for 2**bits of the n**2 / 2 pairs, below FALSE_MATCHES."""
    return max(0, ceil(2 * log2(max(2, fingerprints)) - 65 - log2(FALSE_MATCHES)))


def distinct(prints: np.ndarray, check: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each different fingerprint, in their order, and for each fingerprint its number among them."""
    order = np.argsort(prints, kind="stable") if check is None else np.lexsort((check, prints))
    p, c = prints[order], None if check is None else check[order]
    new = np.ones(len(p), bool)
    new[1:] = p[1:] != p[:-1]
    if c is not None:
        new[1:] |= c[1:] != c[:-1]
    number = np.empty(len(p), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def dealt(prints: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints by bucket: their order, the buckets that have some, and where each of these begins (and the end)."""
    which = (prints >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64) if buckets > 1 else np.zeros(len(prints), np.int64)
    order = np.argsort(which, kind="stable")
    which = which[order]
    first = np.flatnonzero(np.diff(which, prepend=-1))
    return order, which[first], np.append(first, len(which))


def exchange(sends: DataFrame, columns: list[str], settle: Callable[[Items, np.ndarray], tuple[np.ndarray, Items]], answers: list[str]) -> DataFrame:
    """For each row sent: block, bucket, the places (hits) in it that settle() marks, and settle()'s values for these.

    settle gets a bucket's items and the number of the row that each came in.
    """

    def answer(rows: pa.Table) -> pa.Table:
        parts = {k: [unpack(x) for x in rows.column(k).to_pylist()] for k in columns}
        ends = np.concatenate([[0], np.cumsum([len(x) for x in parts[columns[0]]])])
        items = {k: np.concatenate(v) for k, v in parts.items()}
        del parts
        hit, values = settle(items, np.repeat(np.arange(rows.num_rows), np.diff(ends)))
        at = np.flatnonzero(hit)
        cuts = np.searchsorted(at, ends)
        every = {"hits": at - np.repeat(ends[:-1], np.diff(cuts)), **{k: values[k][at] for k in answers}}
        return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), **{k: pa.array([pack(v[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()) for k, v in every.items()}})

    return sends.groupBy("bucket").applyInArrow(answer, "block long, bucket int" + "".join(f", {k} binary" for k in ["hits", *answers]))


def sent(block: int, items: Items, columns: list[str], buckets: int) -> pa.Table:
    """What a block sends: a row for each bucket with some of its items, in the items' order."""
    order, which, ends = dealt(items["prints"], buckets)
    packed = {k: pa.array([pack(items[k][order[a:b]].view(np.int64), k not in PLAIN) for a, b in zip(ends[:-1], ends[1:])], pa.binary()) for k in columns}
    return pa.table({"bucket": pa.array(which, pa.int32()), "block": pa.array(np.full(len(which), block), pa.int64()), **packed})


def sending(columns: list[str]) -> str:
    return "bucket int, block long" + "".join(f", {k} binary" for k in columns)


def heard(prints: np.ndarray, answers: pa.Table, names: list[str], buckets: int) -> tuple[np.ndarray, Items]:
    """Which of the fingerprints that a block sent are answered, and the values of the answers."""
    order, which, ends = dealt(prints, buckets)
    begins = dict(zip(which.tolist(), ends.tolist()))
    none = [np.zeros(0, np.int64)]
    at = [order[begins[b] + unpack(h)] for b, h in zip(answers.column("bucket").to_pylist(), answers.column("hits").to_pylist())]
    return np.concatenate(none + at), {k: np.concatenate(none + [unpack(x) for x in answers.column(k).to_pylist()]) for k in names}


def shared(items: Items, row: np.ndarray) -> tuple[np.ndarray, Items]:
    """Settles which fingerprints another block sent too, or the same block has more than once (column twice)."""
    _, number = distinct(items["prints"].view(np.uint64), items.get("check"))
    return (np.bincount(number)[number] > 1) | (items["twice"] > 0), {}
