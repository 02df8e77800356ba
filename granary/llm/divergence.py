"""How the sources of a language differ in their terms: mergeable radix tries over the terms' bytes.

1. Each task counts its documents' terms in tries, one a language, whose leaves have a counter of occurrences and one of
   documents for each source. A trie lies in preorder: leaf k shares its first shared[k] bytes with leaf k - 1 and has the rest
   of its own, so bytes that terms share are there once, and a range of prefixes is a range of leaves.
2. Tries are cut at the first bytes of their terms; what has too many leaves for one task is cut a byte further on, until nothing is.
   Each range of prefixes is merged by one task: counters of equal leaves add up, and terms of too few documents go.
3. Each merged range is traversed in the order of UTF-8. With the totals of its language's sources it gives its part of each pair's sum and
   the best terms of each source; both are kept in the task until its end and then added up or ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, giving_back, giving_back_each, in_small_batches, shared_dir, shared_table, slices, table, text_bytes, text_column, words_of

#: Counters (term, language, source) that a counting task holds before it compacts or sends them.
MOST_COUNTERS = 1_500_000
#: Leaves, of all tasks together, in a range of prefixes that one task merges.
RANGE_LEAVES = 2_000_000
#: Bytes of the first prefixes.
FIRST_BYTES = 2
#: Numbers in a block of a traversal, and sums of pairs that a traversing task holds.
BLOCK, MOST_SUMS = 1 << 20, 1 << 22

#: A-Z lower-cased, a-z and all bytes of other characters as they are, the rest a space.
LETTERS = np.full(256, 0x20, np.uint8)
LETTERS[0x80:] = np.arange(0x80, 0x100)
LETTERS[0x61:0x7B] = LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)

TRIE = "lang string, prefix binary, leaves long, shared binary, own binary, tails binary, counters binary, source binary, n binary, docs binary, names array<string>"
COUNTERS = pa.schema([("lang", pa.int32()), ("source", pa.int32()), ("term", pa.large_binary()), ("n", pa.int64()), ("docs", pa.int64())])


class Names:
    """Numbers for texts, in the order they come in."""

    def __init__(self):
        self.number: dict[str, int] = {}

    def of(self, column: pa.Array) -> np.ndarray:
        coded = column.dictionary_encode()
        known = np.array([self.number.setdefault(x, len(self.number)) for x in coded.dictionary.to_pylist()], np.int64)
        return known[coded.indices.to_numpy()]


def counted(part: pa.RecordBatch, langs: Names, sources: Names) -> pa.Table:
    """Occurrences and documents of each term by language and source, of a slice of documents."""
    raw, off = text_bytes(part.column("text"))
    raw = LETTERS[raw]
    starts, ends, doc = words_of(raw, off)
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    terms = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(raw[raw != 0x20])]).dictionary_encode()
    kinds = max(1, len(terms.dictionary))
    pairs, times = np.unique(doc * kinds + terms.indices.to_numpy(), return_counts=True)
    doc, term = np.divmod(pairs, kinds)
    lang, source = langs.of(part.column("lang"))[doc], sources.of(part.column("source"))[doc]
    width = len(sources.number)
    keys, number = np.unique((lang * width + source) * kinds + term, return_inverse=True)
    group, term = np.divmod(keys, kinds)
    n = np.bincount(number, weights=times, minlength=len(keys)).astype(np.int64)  # a slice has fewer terms than a float counts exactly
    return pa.table([pa.array(group // width, pa.int32()), pa.array(group % width, pa.int32()), terms.dictionary.take(pa.array(term)), pa.array(n), pa.array(np.bincount(number, minlength=len(keys)))], schema=COUNTERS)


def compacted(tables: list[pa.Table]) -> pa.Table:
    both = pa.concat_tables(tables).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return both.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select(COUNTERS.names)


def sorted_terms(terms: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different terms in the order of their bytes, and the number of each of terms among them."""
    coded = terms.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return coded.dictionary.take(order), rank[coded.indices.to_numpy()]


def shared_bytes(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many first bytes each of some sorted terms shares with the term before it."""
    size = np.diff(ends)
    out = np.zeros(len(size), np.int64)
    alive = np.arange(1, len(size))
    depth = 0
    while len(alive):
        alive = alive[(size[alive] > depth) & (size[alive - 1] > depth)]
        alive = alive[data[ends[alive] + depth] == data[ends[alive - 1] + depth]]
        depth += 1
        out[alive] = depth
    return out


def packed(lang: str, prefix: bytes, terms: pa.Array, leaf: np.ndarray, source: np.ndarray, n: np.ndarray, docs: np.ndarray, names: list[str]) -> tuple:
    """A row of TRIE: sorted terms, and counters by leaf (ascending) and source."""
    data, ends = text_bytes(terms)
    shared = shared_bytes(data, ends)
    own = np.diff(ends) - shared
    tails = data[np.repeat(ends[:-1] + shared - np.concatenate([[0], np.cumsum(own)[:-1]]), own) + np.arange(own.sum())]
    used, code = np.unique(source, return_inverse=True)
    counters = np.bincount(leaf, minlength=len(own))
    raw = lambda x, kind="<i8": x.astype(kind).tobytes()
    return (lang, prefix, len(own), raw(shared, "<i4"), raw(own, "<i4"), tails.tobytes(), raw(counters, "<i4"), raw(code, "<i4"), raw(n), raw(docs), [names[i] for i in used.tolist()])


def unpacked(row: dict) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """terms, and for each counter its leaf, source (a number in the last), n and docs."""
    read = lambda k, kind="<i8": np.frombuffer(row[k], kind).astype(np.int64)
    shared, own, tails = read("shared", "<i4"), read("own", "<i4"), np.frombuffer(row["tails"], np.uint8)
    size = shared + own
    ends, begin = np.concatenate([[0], np.cumsum(size)]), np.concatenate([[0], np.cumsum(own)])[:-1]
    data = np.empty(ends[-1], np.uint8)
    alive, depth = np.arange(len(size)), 0
    while len(alive):
        alive = alive[size[alive] > depth]
        # a byte is from the last leaf whose own bytes reach so far up
        giver = alive[np.maximum.accumulate(np.where(shared[alive] <= depth, np.arange(len(alive)), 0))] if len(alive) else alive
        data[ends[alive] + depth] = tails[begin[giver] + depth - shared[giver]]
        depth += 1
    terms = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return terms, np.repeat(np.arange(len(size)), read("counters", "<i4")), read("source", "<i4"), read("n"), read("docs"), row["names"]


def trie_batches(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.binary(), pa.int64(), *[pa.binary()] * 7, pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)], [x.split()[0] for x in TRIE.split(", ")])


def cut(lang: str, terms: pa.Array, leaf: np.ndarray, source: np.ndarray, n: np.ndarray, docs: np.ndarray, names: list[str], depth: int) -> Iterator[tuple]:
    """Rows of TRIE, one for each different beginning of so many bytes. terms are sorted, counters by leaf."""
    firsts = pc.binary_slice(terms, 0, depth).dictionary_encode()
    begins = np.flatnonzero(np.diff(firsts.indices.to_numpy(), prepend=-1))
    at = np.append(begins, len(terms))
    place = np.searchsorted(leaf, at)
    for k, prefix in enumerate(firsts.dictionary.to_pylist()):
        a, b, i, j = at[k], at[k + 1], place[k], place[k + 1]
        yield packed(lang, prefix, terms.slice(a, b - a), leaf[i:j] - a, source[i:j], n[i:j], docs[i:j], names)


def tries(docs: DataFrame) -> DataFrame:
    """The tries that each task counts, cut into prefixes of FIRST_BYTES. docs: lang, source and text, without nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, sources = Names(), Names()
        pending: list[pa.Table] = []

        def sent() -> Iterator[pa.RecordBatch]:
            full = compacted(pending)
            pending.clear()
            names, spelt = list(langs.number), list(sources.number)
            lang = full.column("lang").to_numpy()
            for code in np.unique(lang).tolist():
                some = full.filter(pa.array(lang == code))
                terms, leaf = sorted_terms(some.column("term").combine_chunks())
                order = np.lexsort((some.column("source").to_numpy(), leaf))
                rows = []
                for row in cut(names[code], terms, leaf[order], *(some.column(k).to_numpy()[order] for k in ("source", "n", "docs")), spelt, FIRST_BYTES):
                    rows.append(row)
                    if len(rows) == 256:
                        yield trie_batches(rows)
                        rows = []
                if rows:
                    yield trie_batches(rows)

        for batch in batches:
            for part in slices(batch):
                pending.append(counted(part, langs, sources))
                if sum(x.num_rows for x in pending) > MOST_COUNTERS:
                    pending[:] = [compacted(pending)]
                    if pending[0].num_rows > MOST_COUNTERS // 2:
                        yield from sent()
        if pending:
            yield from sent()

    return in_small_batches(docs).select("lang", "source", "text").mapInArrow(giving_back(run), TRIE)


def recut(rows: DataFrame, depth: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield trie_batches(list(cut(row["lang"], *unpacked(row), depth)))

    return rows.mapInArrow(giving_back(run), TRIE)


def in_ranges(rows: DataFrame, work: str) -> DataFrame:
    """The same leaves, cut further wherever a prefix has more than RANGE_LEAVES of them."""
    done, depth = [], FIRST_BYTES
    while True:
        size = rows.groupBy("lang", "prefix").agg(F.sum("leaves").alias("all"))
        # a term shorter than a prefix is a range of its own
        heavy = shared_table(size.filter(F.col("all") > RANGE_LEAVES).filter(F.octet_length("prefix") == depth).select("lang", "prefix"), f"{work}/heavy{depth}")
        if heavy.isEmpty():
            for more in done:
                rows = rows.unionByName(more)
            return rows
        done.append(rows.join(heavy, ["lang", "prefix"], "left_anti"))
        depth += 1
        rows = shared_table(recut(rows.join(heavy, ["lang", "prefix"], "left_semi").select(*rows.columns), depth), f"{work}/cut{depth}")


MERGED = TRIE + ", sums array<long>"


def merging(least_docs: int):
    def merge(group: pa.Table) -> pa.Table:
        names, parts = Names(), []
        for row in group.to_pylist():
            terms, leaf, source, n, docs, spelt = unpacked(row)
            parts.append((terms.take(pa.array(leaf)), names.of(pa.array(spelt, pa.string()))[source], n, docs))
        terms, leaf = sorted_terms(pa.concat_arrays([x[0] for x in parts]))
        source, n, docs = (np.concatenate([x[k] for x in parts]) for k in (1, 2, 3))
        width = max(1, len(names.number))
        keys, number = np.unique(leaf * width + source, return_inverse=True)
        order = np.argsort(number, kind="stable")
        first = np.flatnonzero(np.diff(number[order], prepend=-1))
        n, docs = (np.add.reduceat(x[order], first) if len(x) else x for x in (n, docs))
        leaf, source = keys // width, keys % width
        kept = np.zeros(len(terms), np.int64)
        np.add.at(kept, leaf, docs)
        kept = kept >= least_docs
        some = kept[leaf]
        leaf, source, n, docs = (np.cumsum(kept) - 1)[leaf[some]], source[some], n[some], docs[some]
        row = packed(group.column("lang")[0].as_py(), group.column("prefix")[0].as_py(), terms.filter(pa.array(kept)), leaf, source, n, docs, list(names.number))
        _, code = np.unique(source, return_inverse=True)
        sums = np.zeros(len(row[-1]), np.int64)
        np.add.at(sums, code, n)
        out = trie_batches([row])
        return pa.Table.from_batches([out.append_column("sums", pa.array([sums.tolist()], pa.list_(pa.int64())))])

    return merge


def shares(count: np.ndarray, total: np.ndarray, scale: int) -> np.ndarray:
    """1 + floor(scale * (count + 1) / total), exact while total is below 2**63 / 1000; scale is a power of 1000 and count < total."""
    rest, out = count + 1, np.zeros_like(count)
    while scale > 1:
        more, rest = np.divmod(rest * 1000, total)
        out, scale = out * 1000 + more, scale // 1000
    return out + 1


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


FOUND = "part string, lang string, source string, item string, value long"


def traversal(top: int, scale: int):
    """Gives sums of pairs and the best terms of the merged ranges that a task has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        sides: dict[str, list[str]] = {}
        best: dict[tuple[str, str], list[tuple[int, bytes]]] = {}

        def pruned(terms: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
            return sorted(terms)[:top]

        def of_pairs() -> Iterator[pa.RecordBatch]:
            for lang, m in sums.items():
                g, s = np.divmod(np.flatnonzero(~np.eye(len(m), dtype=bool).ravel()), len(m)) if len(m) else (np.zeros(0, int),) * 2
                spelt = pa.array(sides[lang], pa.string())
                fixed = [pa.array(np.full(len(g), x, object), pa.string()) for x in ("pair", lang)]
                yield pa.RecordBatch.from_arrays([*fixed, spelt.take(pa.array(g)), spelt.take(pa.array(s)), pa.array(m[g, s], pa.int64())], [x.split()[0] for x in FOUND.split(", ")])
            sums.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if not row["leaves"]:
                    continue
                lang, sources, totals = row["lang"], [x["source"] for x in row["sides"]], np.array([x["n"] for x in row["sides"]], np.int64)
                sides[lang] = sources
                terms, leaf, code, n, _, spelt = unpacked(row)
                at = {s: i for i, s in enumerate(sources)}
                code = np.array([at[s] for s in spelt], np.int64)[code]
                m = sums.setdefault(lang, np.zeros((len(sources), len(sources)), np.int64))
                step = max(1, BLOCK // len(sources))
                for lo in range(0, len(terms), step):
                    hi = min(lo + step, len(terms))
                    a, b = np.searchsorted(leaf, [lo, hi])
                    count = np.zeros((len(sources), hi - lo), np.int64)
                    count[code[a:b], leaf[a:b] - lo] = n[a:b]
                    p = shares(count, (totals + row["kept"])[:, None], scale)
                    q = shares(count.sum(axis=0), np.int64(totals.sum() + row["kept"]), scale)
                    for g in range(len(sources)):
                        m[g] += excess(p[g], p).sum(axis=1)
                    g, t = np.nonzero((count > 0) & (p > q))
                    spelling = terms.slice(lo, hi - lo).take(pa.array(t)).to_pylist()
                    value = excess(p[g, t], q[t])
                    cuts = np.searchsorted(g, np.arange(len(sources) + 1)).tolist()
                    for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
                        if x < y:
                            # in traversal order, so a stable order by value has ties in the order of UTF-8
                            order = np.argsort(-value[x:y], kind="stable")[:top]
                            mine = best.setdefault((lang, sources[i]), [])
                            mine.extend((-int(value[x + k]), spelling[x + k]) for k in order.tolist())
                            if len(mine) > 20 * top:
                                mine[:] = pruned(mine)
                if sum(x.size for x in sums.values()) > MOST_SUMS:
                    yield from of_pairs()
        yield from of_pairs()
        for (lang, source), terms in best.items():
            terms = pruned(terms)
            columns = [["term"] * len(terms), [lang] * len(terms), [source] * len(terms), [t.decode() for _, t in terms]]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in columns), pa.array([-v for v, _ in terms], pa.int64())], [x.split()[0] for x in FOUND.split(", ")])

    return run


def divergence(docs: DataFrame, least_docs: int = 3, top: int = 200, scale: int = 1_000_000_000) -> DataFrame:
    """How each source's terms differ from those of each other source of its language, and which terms set it apart.

    Terms are runs of letters and of characters beyond ASCII, A-Z lower-cased. Of each language count those in at least least_docs of its
    documents. With p = 1 + floor(scale * (occurrences + 1) / (all occurrences + terms)), the value of two such shares is
    floor((p - q)**2 / q). Rows of part pair: every other source of the language, with the sum of its values over all terms; of part
    term: terms more frequent in the source than in the language, the best top of them. rank counts by value (descending) and item (bytes).

    Null lang, source and text are empty; a source without terms has its pairs; a language without kept terms has pairs of
    value 0; a row is a document, repeated or not; other columns play no part; an empty table gives an empty one. Sources of one language
    and one range of prefixes (RANGE_LEAVES leaves, or one term) are each held in one task, as is one document. A task's own slice of a very
    long text is the whole text. Runs its jobs when called.
    """
    work = shared_dir(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), text_column())
    ranges = in_ranges(shared_table(tries(rows), f"{work}/tries"), work)
    merged = shared_table(ranges.groupBy("lang", "prefix").applyInArrow(giving_back_each(merging(least_docs)), MERGED), f"{work}/merged")
    groups = rows.groupBy("lang", "source").agg(F.lit(0).cast("long").alias("n"))
    counts = merged.select("lang", F.explode(F.arrays_zip(F.col("names").alias("source"), F.col("sums").alias("n"))).alias("x")).select("lang", "x.*")
    groups = shared_table(groups.unionByName(counts).groupBy("lang", "source").agg(F.sum("n").alias("n")), f"{work}/groups")
    kept = merged.groupBy("lang").agg(F.sum("leaves").alias("kept"))
    sides = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("sides")).join(kept, "lang")
    small = groups.count() <= MOST_BROADCAST
    told = merged.filter("leaves > 0").join(F.broadcast(sides) if small else sides, "lang").mapInArrow(giving_back(traversal(top, scale)), FOUND)
    told = shared_table(told, f"{work}/told")
    names = groups.select("lang", "source")
    pairs = names.join(names.select("lang", F.col("source").alias("item")), "lang").filter("source != item")
    sums = told.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = told.filter("part = 'term'").select("lang", "source", "part", "item", "value").withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(by)).unionByName(terms)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
tok AS (SELECT doc, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM tok GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM tok JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
tot AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // CAST(coalesce(tot.total, 0) + v.v AS HUGEINT) AS HUGEINT) AS p
  FROM g JOIN kept ON kept.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN tot ON tot.lang = g.lang AND tot.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
q AS (SELECT lang, term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 1)) // CAST(total + v AS HUGEINT) AS HUGEINT) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term) JOIN (SELECT lang, sum(total) AS total FROM tot GROUP BY lang) USING (lang) JOIN v USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST(((p.p - q.q) * (p.p - q.q)) // q.q AS BIGINT) AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
