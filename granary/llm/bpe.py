"""Byte-level BPE by a hierarchical-bitmap rank queue, over whole texts, with exact decoding.

Texts are split into pre-tokens with numpy: character classes of all code points of a slice at once. Each distinct
pre-token of a slice is encoded once, and an encoder in each Python worker remembers a bounded number of them. Encoding keeps
the symbols of the pre-tokens in a linked list and the mergeable pairs in a queue: one bucket of list positions for each
merge rank, and a three-level bitmap of the ranks whose bucket is not empty. Find-first-set picks the next rank; positions whose
pair has changed since are stale and skipped. A pre-token of any length takes time in proportion to its merges.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import code_points, giving_back, in_small_batches, slices, table, text_bytes, text_column

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0

# The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: Pre-tokens that an encoder remembers, in two generations; those of a slice may come on top of each.
REMEMBERED = 100_000
#: Positions of a rank from which on they are merged together.
LEAST_TOGETHER = 80
#: Bytes of text that are encoded at once: their pre-tokens and ids are Python objects.
PART_BYTES = 1 << 20


def classes() -> np.ndarray:
    """Letter, number, white space or other, for each code point."""
    out = np.zeros(0x110000, np.uint8)
    kind = {"L": LETTER, "N": NUMBER}
    for i in range(0x110000):
        out[i] = kind.get(unicodedata.category(chr(i))[0], OTHER)
    out[WHITE_SPACE] = SPACE
    return out


_CLASSES: list[np.ndarray] = []


def known_classes() -> np.ndarray:
    if not _CLASSES:
        _CLASSES.append(classes())
    return _CLASSES[0]


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return known_classes() == LETTER


def pretoken_starts(points: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each code point, whether a match of the split pattern starts there; docs has the documents' offsets.

    The pattern: contractions, then letters, numbers or other signs with one blank before them, then white space
    without its last character where something follows it.
    """
    n = len(points)
    kind = known_classes()[points]
    cut = np.zeros(n + 1, bool)
    cut[docs] = True
    start = cut[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # White space before something else in the same document gives up its last character; a blank goes to what follows.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~cut[1:n]) if n else np.zeros(0, np.int64)
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    # 's 't 'm 'd 're 've 'll: where an apostrophe starts a match and letters of the same document follow.
    at = np.flatnonzero((points == 0x27) & start)
    at = at[at + 1 < n]
    at = at[~cut[at + 1] & (kind[at + 1] == LETTER)]
    one, two = points[at + 1], np.where((at + 2 < n) & ~cut[np.minimum(at + 2, n)], points[np.minimum(at + 2, n - 1)], 0)
    short = np.isin(one, [ord(x) for x in "stmd"])
    long = ~short & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    start[at[short | long] + 1] = False
    rest = np.concatenate([at[short] + 2, at[long] + 3])
    start[rest[rest < n]] = True
    return start


class RankQueue:
    """Positions by merge rank; the least rank that has any is found through three levels of 64-bit words."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        have = self.buckets.get(rank)
        if have is not None:
            have.append(position)
            return
        self.buckets[rank] = [position]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def fill(self, rank: int, positions: list[int]) -> None:
        """push, for some positions of a rank."""
        self.push(rank, positions[0])
        self.buckets[rank] += positions[1:]

    def pop(self) -> tuple[int, list[int]]:
        a = (self.top & -self.top).bit_length() - 1
        x = self.mid[a]
        b = (a << 6) + (x & -x).bit_length() - 1
        y = self.low[b]
        bit = y & -y
        rank = (b << 6) + bit.bit_length() - 1
        self.low[b] = y ^ bit
        if y == bit:
            self.mid[a] = x = x ^ (1 << (b & 63))
            if not x:
                self.top ^= 1 << a
        return rank, self.buckets.pop(rank)


class Partners:
    """By id, which other ids merge with it on one side, in order, and to what."""

    def __init__(self, mine: np.ndarray, other: np.ndarray, ranks: np.ndarray, ids: int):
        order = np.lexsort((other, mine))
        self.other, self.rank = other[order], ranks[order]
        self.starts = np.searchsorted(mine[order], np.arange(ids + 1)).tolist()

    def ranks(self, mine: int, others: np.ndarray) -> np.ndarray | None:
        """The ranks of the merges with others, -1 for those that don't merge; none if mine merges with nothing."""
        a, b = self.starts[mine : mine + 2]
        if a == b:
            return None
        have = self.other[a:b]
        k = np.minimum(np.searchsorted(have, others), b - a - 1)
        return np.where(have[k] == others, self.rank[a:b][k], -1)


class Encoder:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.pairs: dict[int, int] = {}  # left id and right id to the rank (also the id) of what they merge to
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                left, right = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)])
        self.byte_pairs = np.array([[self.pairs.get(a << 32 | b, -1) for b in self.byte_ids.tolist()] for a in self.byte_ids.tolist()])
        pairs, ranks = (np.fromiter(x, np.int64, len(self.pairs)) for x in (self.pairs.keys(), self.pairs.values()))
        self.rights, self.lefts = (Partners(a, b, ranks, max(self.tokens) + 1) for a, b in ((pairs >> 32, pairs & 0xFFFFFFFF), (pairs & 0xFFFFFFFF, pairs >> 32)))
        self.queue = RankQueue(max(self.tokens) + 1)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        every = [self.tokens.get(i, b"") for i in range(max(self.tokens) + 1)]
        self.decoded = pa.array(every, pa.large_binary())
        self.written = pa.array([b"%d " % i for i in range(len(every))], pa.large_binary())

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens, one after another, and where those of each end: all of them in one linked list and one queue.

        In each pre-token the pair of least rank merges first, the leftmost of equal ones. If a merge makes a pair of lower
        rank in its pre-token, what that pre-token has left at this rank waits until the lower one is done. Pre-tokens that have
        one pair of a rank merge it together, as they don't touch each other.
        """
        get, queue, push, bucket = self.pairs.get, self.queue, self.queue.push, self.queue.buckets.get
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        n, sizes = len(raw), np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        heads = ends - sizes
        ids, link, back, first = self.byte_ids[raw].astype(np.int64), np.arange(1, n + 1), np.arange(-1, n - 1), np.full(n, -1, np.int64)
        first[:-1] = self.byte_pairs[raw[:-1], raw[1:]]
        link[ends - 1], back[heads], first[ends - 1] = n, -1, -1
        owner, alive = np.repeat(np.arange(len(pieces)), sizes), np.ones(n, bool)
        id_at, after, before, pair, piece_of, lives = map(memoryview, (ids, link, back, first, owner, alive))
        # Pairs of bytes, which are most of all pairs, are dealt to their buckets together.
        at = np.flatnonzero(first >= 0)
        at = at[np.argsort(first[at], kind="stable")]
        ranks, starts = np.unique(first[at], return_index=True)
        for rank, places in zip(ranks.tolist(), np.split(at, starts[1:])):
            queue.fill(rank, places.tolist())

        def paired(at: np.ndarray, found: np.ndarray | None) -> None:
            """Set the pairs at some positions, and queue those that merge."""
            if found is None:
                first[at] = -1
                return
            first[at] = found
            good = found >= 0
            for r, i in zip(found[good].tolist(), at[good].tolist()):
                have = bucket(r)
                if have is None:
                    push(r, i)
                else:
                    have.append(i)

        while queue.top:
            rank, places = queue.pop()
            if len(places) >= LEAST_TOGETHER:
                at = np.array(places)
                at = at[first[at] == rank]
                at.sort()
                whose = owner[at]
                alone = np.ones(len(at), bool)
                alone[1:] = whose[1:] != whose[:-1]
                alone[:-1] &= alone[1:]
                places, at = at[~alone].tolist(), at[alone]
                ids[at] = rank
                gone = link[at]
                first[gone], alive[gone] = -1, False
                link[at] = follow = link[gone]
                first[at] = -1
                some = follow < n
                i, j = at[some], follow[some]
                back[j] = i
                paired(i, self.rights.ranks(rank, ids[j]))
                j = back[at]
                j = j[j >= 0]
                paired(j, self.lefts.ranks(rank, ids[j]))
            places.sort()
            waits: set[int] = set()
            for i in places:
                if pair[i] != rank:
                    continue  # stale
                if waits and piece_of[i] in waits:
                    push(rank, i)
                    continue
                id_at[i] = rank
                gone = after[i]
                pair[gone] = -1
                lives[gone] = False
                j = after[i] = after[gone]
                if j < n:
                    before[j] = i
                    r = get(rank << 32 | id_at[j], -1)
                    pair[i] = r
                    if r >= 0:
                        have = bucket(r)
                        if have is None:
                            push(r, i)
                        else:
                            have.append(i)
                        if r < rank:
                            waits.add(piece_of[i])
                else:
                    pair[i] = -1
                j = before[i]
                if j >= 0:
                    r = get(id_at[j] << 32 | rank, -1)
                    pair[j] = r
                    if r >= 0:
                        have = bucket(r)
                        if have is None:
                            push(r, j)
                        else:
                            have.append(j)
                        if r < rank:
                            waits.add(piece_of[i])
        return ids[alive], np.cumsum(np.bincount(owner[alive], minlength=len(pieces)))

    def entries(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token as 32-bit numbers.

        Those of the generation before are taken over when they are met again, so that frequent pre-tokens are never encoded anew.
        """
        if len(self.known) > REMEMBERED // 3:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = [x for x in pieces if x not in known]
        found = {x: older[x] for x in new if x in older}
        if older:
            new = [x for x in new if x not in found]
        found.update((x, struct.pack("<i", self.ranks[x])) for x in new if x in self.ranks)
        other = [x for x in new if x not in found]
        if other:
            ids, ends = self.encode(other)
            data, ends = ids.astype("<i4").tobytes(), (4 * ends).tolist()
            found.update((x, data[a:b]) for x, a, b in zip(other, [0, *ends], ends))
        out = [known.get(x) or found[x] for x in pieces]
        known.update((k, v) for k, v in found.items() if len(k) <= 256)
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_bpe(docs: DataFrame, ranks: str | None = None, keep: bool = False) -> DataFrame:
    """Encode whole texts and decode the ids again.

    ranks names a file of base64 tokens and ranks that every executor can open. keep adds the ids (array of int)
    and the decoded text. A null text is empty and has no ids; repeated rows give repeated rows.
    """
    ranks = ranks or default_ranks()
    schema = SCHEMA + (", ids array<int>, decoded string" if keep else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        for batch in batches:
            for part in slices(batch, budget=PART_BYTES):
                yield encoded(part, enc, keep)

    return in_small_batches(docs).select("doc_id", text_column()).mapInArrow(giving_back(run), schema)


def encoded(part: pa.RecordBatch, enc: Encoder, keep: bool) -> pa.RecordBatch:
    raw, off = text_bytes(part.column("text"))
    points, docs, at = code_points(raw, off)
    first = np.flatnonzero(pretoken_starts(points, docs))
    cuts = np.append(at[first], len(raw)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(cuts), pa.py_buffer(raw)]).dictionary_encode()
    per_doc = np.searchsorted(cuts[:-1], off)  # the documents' offsets in pre-tokens
    data, ends = text_bytes(pc.take(pa.array(enc.entries(pieces.dictionary.to_pylist()), pa.large_binary()), pieces.indices))
    flat, per_doc = pa.array(data.view("<i4")), ends[per_doc] // 4  # all ids, and the documents' offsets in them
    texts = []
    for table_ in (enc.written, enc.decoded):
        data, ends = text_bytes(table_.take(flat))
        ends = ends[per_doc]
        texts.append([data[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])])
    ids = [x[:-1] for x in texts[0]]
    sha = lambda x: hashlib.sha256(x).hexdigest()
    columns = [part.column("doc_id"), pa.array(np.diff(per_doc)), pa.array([sha(x) for x in ids]), pa.array([sha(x) for x in texts[1]])]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    if keep:
        columns += [pa.ListArray.from_arrays(pa.array(per_doc, pa.int32()), flat), pa.array([x.decode("utf-8", "replace") for x in texts[1]])]
        names += ["ids", "decoded"]
    return pa.RecordBatch.from_arrays(columns, names)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(table(spark, sf_dir, "documents"))
