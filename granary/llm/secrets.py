"""Secret scans: fixed patterns, and strings that a battery of randomness tests can't tell from random ones.

A candidate is a run of at least LEAST characters from [A-Za-z0-9+/_-] with a letter and a digit. Its encoding (decimal-free
hex, base 32, base 36 of either case, or base 64) gives its alphabet. Three tests ask whether its symbols are
uniform and independent: chi-squared over classes of the alphabet (as many as the length supports), runs above and below the middle of
the alphabet, and serial correlation at lag 1. The least of the three p-values times three is the candidate's p-value.
Ordinary long words fail these tests. Two rules decide over all candidates of the corpus, separately for each encoding and length
class, as the tests' power grows with length. The Benjamini-Hochberg step says which failures to believe. What it leaves is reported from
the p-value on at which the false discoveries among the reports are few: random strings have even p-values, so those above
RATE tell how many random ones are in all, and the surplus below is of ordinary text. What is reported are spans of kind "random".
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, give_back, giving_back, in_small_batches, slices, table, text_bytes, text_column

# The base patterns, as bytes (each class is ASCII only).
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "random")

LEAST = 20
ENCODINGS = (("hex", b"0123456789abcdef"), ("HEX", b"0123456789ABCDEF"), ("base32", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), ("base36", b"0123456789abcdefghijklmnopqrstuvwxyz"), ("BASE36", b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("base64", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"))
#: False-discovery rate of the rejections and of the reports, and the classes of p-values on which they are decided: so many for each factor of 10, down to the least double.
RATE, TENTHS, DECADES = 0.05, 40, 324


def member(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


HEX = member(b"0123456789abcdef")
CANDIDATE = member(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")


def runs(mask: np.ndarray, off: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of true values inside one document, of at least so many."""
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(mask))]
    first[cuts], last[cuts - 1] = mask[cuts], mask[cuts - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    keep = b - a >= least
    return list(zip(a[keep].tolist(), b[keep].tolist()))


def places(raw: bytes, word: bytes) -> Iterator[int]:
    at = raw.find(word)
    while at >= 0:
        yield at
        at = raw.find(word, at + 1)


def base_spans(raw: bytes, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int]]:
    """Byte start, byte end and kind of the spans of the fixed patterns; a match never crosses documents."""
    out = []
    lower = raw.lower()
    ends = off[1:]
    for kind, pattern, starts, group, least in ((0, ASSIGN, {p for w in ASSIGN_WORDS for p in places(lower, w)}, 1, 8), (1, ACCESS, set(places(raw, b"AKIA")), 0, 16)):
        done = 0
        for p in sorted(starts):
            if p < done:
                continue  # inside an earlier match, kept or not
            m = pattern.match(raw, p, int(ends[np.searchsorted(ends, p, side="right")]))
            if m:
                done = m.end()
                if len(m[group]) >= least:
                    out.append((p, done, kind))
    return out + [(a, b, 2) for a, b in runs(HEX[data], off, 32)]


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(token: bytes) -> tuple[int, float] | None:
    """The encoding's place in ENCODINGS and the p-value of "its symbols are random"; None for what is no candidate."""
    body = token
    if len(body) < LEAST or not re.search(rb"[0-9]", body) or not re.search(rb"[A-Za-z]", body):
        return None
    which = next((k for k, (_, chars) in enumerate(ENCODINGS) if not body.translate(None, chars)), None)
    if which is None:
        return None
    size = len(ENCODINGS[which][1])
    symbols = np.array([ENCODINGS[which][1].index(c) for c in body], np.float64)
    n = len(symbols)
    classes = max(k for k in (2, 4, 8, 16) if k == 2 or n >= 4 * k and k <= size)
    seen = np.bincount((symbols * classes // size).astype(int), minlength=classes)
    share = np.bincount((np.arange(size) * classes // size), minlength=classes) / size
    chi = float(((seen - n * share) ** 2 / (n * share)).sum())
    free = classes - 1
    p_chi = 0.5 * math.erfc(((chi / free) ** (1 / 3) - 1 + 2 / (9 * free)) / math.sqrt(2 / (9 * free)) / math.sqrt(2))
    high = symbols >= size / 2
    up = int(high.sum())
    down = n - up
    p_runs = 0.0
    if up and down:
        expected = 1 + 2 * up * down / n
        spread = (expected - 1) * (expected - 2) / (n - 1)
        p_runs = two_sided((1 + int((high[1:] != high[:-1]).sum()) - expected) / math.sqrt(spread)) if spread > 0 else 1.0
    centred = symbols - symbols.mean()
    power = float((centred**2).sum())
    p_serial = two_sided((float((centred[1:] * centred[:-1]).sum()) / power + 1 / n) * math.sqrt(n)) if power else 0.0
    return which, min(1.0, 3 * min(p_chi, p_runs, p_serial))


def stratum(which: int, token: bytes) -> int:
    """Encoding and length class: 20, 28, 40, 56, ... characters, each 1.4 times the one before."""
    return which * 64 + min(63, int(2 * math.log2(len(token) / LEAST)))


def candidates(raw: bytes, data: np.ndarray, off: np.ndarray, known: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, float]]:
    """Start, end, stratum and p-value of the candidates that no fixed pattern has found."""
    taken = sorted((a, b) for a, b, _ in known)
    starts = np.array([a for a, _ in taken], np.int64)
    reach = np.maximum.accumulate(np.array([b for _, b in taken], np.int64)) if taken else starts
    for a, b in runs(CANDIDATE[data], off, LEAST):
        k = int(np.searchsorted(starts, b)) - 1
        if k >= 0 and reach[k] > a:
            continue
        if found := battery(raw[a:b]):
            yield a, b, stratum(found[0], raw[a:b]), found[1]


def p_class(p: float) -> int:
    return max(0, int(TENTHS * (math.log10(p) + DECADES))) if p > 0 else 0


def thresholds(docs: DataFrame) -> dict[int, int]:
    """For each stratum the p-value class up to which candidates aren't reported, from the counts of all documents.

    A class is rejected if the step holds for its largest p-value, so the last one rejected is at most 6 % below that of the step on all
    p-values. The driver gets at most one row for each encoding and length class, whatever the input's size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[int, int], tuple[int, float]] = {}
            for part in slices(batch):
                data, off = text_bytes(part.column("text"))
                raw = data.tobytes()
                for *_, s, p in candidates(raw, data, off, base_spans(raw, data, off)):
                    n, most = seen.get((s, p_class(p)), (0, 0.0))
                    seen[s, p_class(p)] = n + 1, max(p, most)
            columns = [pa.array([k[0] for k in seen], pa.int32()), pa.array([k[1] for k in seen], pa.int32()), pa.array([n for n, _ in seen.values()], pa.int64()), pa.array([p for _, p in seen.values()], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["stratum", "p_class", "n", "p"])

    counts = in_small_batches(docs).select(text_column()).mapInArrow(giving_back(count), "stratum int, p_class int, n long, p double").groupBy("stratum", "p_class").agg(F.sum("n").alias("n"), F.max("p").alias("p"))
    whole = Window.partitionBy("stratum")
    upto = counts.select("stratum", "p_class", "p", "n", F.sum("n").over(whole.orderBy("p_class")).alias("upto"), F.sum("n").over(whole).alias("total"))
    upto = upto.withColumn("random", F.sum(F.when(F.col("p_class") > p_class(RATE), F.col("n")).otherwise(0)).over(whole) / (1 - RATE))
    above = F.col("total") - F.col("upto")
    rejected = F.max(F.when(F.col("p") <= RATE * F.col("upto") / F.col("total"), F.col("p_class")))
    few_false = F.min(F.when((above > 0) & (above - F.col("random") * (1 - F.col("p")) <= RATE * above), F.col("p_class")))
    # where all may be reported, the second rule sets no bound; where no bound is good enough, nothing is reported
    second = F.when(F.max(F.col("total") - F.col("random")) <= RATE * F.max("total"), -1).otherwise(F.coalesce(few_false, F.max("p_class")))
    return {r.stratum: r.last for r in upto.groupBy("stratum").agg(F.greatest(F.coalesce(rejected, F.lit(-1)), second).alias("last")).collect()}


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


def _digest(part: pa.RecordBatch, limit: dict[int, int]) -> list[list[tuple[int, int, int]]]:
    """For each document its spans (start, end, kind) in code points, by start, then kind."""
    data, off = text_bytes(part.column("text"))
    raw = data.tobytes()
    spans = base_spans(raw, data, off)
    spans += [(a, b, 3) for a, b, s, p in candidates(raw, data, off, spans) if p_class(p) > limit.get(s, -1)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(part.num_rows)]
    if spans:
        at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        for a, b, kind in sorted(spans, key=lambda x: (x[0], x[2])):
            d = int(np.searchsorted(off, a, side="right")) - 1
            out[d].append((int(at[a] - at[off[d]]), int(at[b] - at[off[d]]), kind))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """Secrets of each whole text: counts, the digest of the base spans and all spans as kind:start:end.

    A null text is empty and has none; a null doc_id stays null; repeated rows give repeated rows and count as often as they are there. An empty
    table gives no rows. Spans that begin together are listed by kind. Other columns are not read. Runs one small job for the corpus-wide
    thresholds first.
    """
    import hashlib

    limit = thresholds(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = _digest(part, limit)
                join = lambda x: ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in x)
                counts = [pa.array([sum(k == kind for *_, k in x) for x in found], pa.int64()) for kind in range(4)]
                base = pa.array([hashlib.sha256(join([y for y in x if y[2] < 3]).encode()).hexdigest() for x in found])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts[:3], base, pa.array([join(x) for x in found], pa.string()), counts[3]], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", text_column()).mapInArrow(giving_back(run), SCHEMA)


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The same rows with each span (overlapping ones as one) replaced by a mark; other texts stay as they are, null and empty ones included.

    Only text changes, and n_chars with it where the table has that column; other columns, whatever their names, aren't sent to Python. Repeated
    rows stay repeated, and an empty table stays empty. Runs one small job first.
    """
    limit = thresholds(docs)

    @F.arrow_udf("string")
    def redacted(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for column in columns:
                out = []
                for part in slices(pa.RecordBatch.from_arrays([column.fill_null("")], ["text"])):
                    texts = part.column("text")
                    for k, spans in enumerate(_digest(part, limit)):
                        out.append(replaced(texts[k].as_py(), spans, mark) if spans else None)
                # None where nothing was found: that text stays as it is
                yield pa.array(out, pa.string())
        finally:
            give_back()

    name, *_ = fresh(docs, "redacted")
    out = docs.withColumn(name, redacted(F.col("text"))).withColumn("text", F.coalesce(F.col(name), F.col("text"))).drop(name)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def replaced(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    merged: list[list[int]] = []
    for a, b, _ in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    ends = [0, *(b for _, b in merged)]
    starts = [*(a for a, _ in merged), len(text)]
    return mark.join(text[a:b] for a, b in zip(ends, starts))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
