"""MinHash near-deduplication with an LSH forest, and exact links.

1. Sketch. Each document's set of distinct word shingles gives its size, a fingerprint of the whole set and a signature of
   TREES * ROWS minima. Documents with equal sets are one class from here on.
2. Forest. Each tree sorts the classes by its own minima of the signature; a region is what agrees in the first DEPTH of them. All
   pairs of a region whose signatures agree enough are candidates; what candidates connect is a cluster. The depth adapts to the region:
   in a crowded one, neighbours with the longest common prefix are joined first, and only rows that no deeper prefix has joined are compared
   with the others, tile by tile, so that near copies cost no pairs. Which other classes are in a region makes no difference to a pair.
   A region gives one edge for each class, to the least class that it is connected with there.
3. Exact links. Each cluster's full sets are compared by counting common shingles (a matrix product over tiles of a bounded
   size), so no link inside it is lost, whether its ends were neighbours or not. Of a cluster with several tiles, each tile is
   compared with itself and with the first; what is not in the cluster's largest component by then is compared with the whole cluster.
   The links' connected components are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_VALUES, MOST_BROADCAST, Fingerprints, every_column, fresh, giving_back, giving_back_each, in_small_batches, mix, shared_dir, shared_table, slices, table, text_bytes, text_column, without, words_of

TREES, ROWS, DEPTH = 24, 4, 3
#: The share of minima that a candidate pair must agree in: for pairs at the threshold it is below that by chance once in 10**9.
LEAST_AGREEMENT = 0.55
#: A region of more classes is compared in pairs of tiles of about so many.
REGION_TILE = 16384
#: A tile has about so many classes and shingles; rows of a matrix that are compared at once.
TILE_CLASSES, TILE_SHINGLES, STRIP = 1024, 1_000_000, 256
GROUP_BYTES = 6 << 20

SEEDS = mix(np.arange(1, TREES * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class Shingles:
    """Of a column of texts, the sorted distinct shingle fingerprints, end to end, by document."""

    def __init__(self, column: pa.Array, size: int):
        raw, off = text_bytes(pc.ascii_lower(column))
        starts, ends, doc = words_of(raw, off)
        words = Fingerprints(Fingerprints(BYTE_VALUES[raw]).of(starts, ends), 0x2545F4914F6CDD1D)
        cuts = np.searchsorted(doc, np.arange(len(off)))
        n_words = np.diff(cuts)
        first = np.repeat(cuts[:-1], np.where(n_words > 0, np.maximum(n_words - size + 1, 1), 0))
        counts = np.where(n_words > 0, np.maximum(n_words - size + 1, 1), 0)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        at = first + np.arange(len(first)) - np.repeat(bounds[:-1], counts)
        self.values = words.of(at, np.minimum(at + size, np.repeat(cuts[1:], counts)))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            self.values[a:b].sort()
        distinct = np.append(True, self.values[1:] != self.values[:-1]) if len(self.values) else np.zeros(0, bool)
        distinct[bounds[:-1][counts > 0]] = True
        self.values = self.values[distinct]
        self.bounds = np.concatenate([[0], np.cumsum(distinct)])[bounds]
        self.sizes = np.diff(self.bounds)

    def reduced(self, values: np.ndarray, how: np.ufunc) -> np.ndarray:
        """How applied to each document's values; 0 for documents without any."""
        out = np.zeros(len(self.sizes), values.dtype)
        some = self.sizes > 0
        if some.any():
            out[some] = how.reduceat(values, self.bounds[:-1][some])
        return out

    def keys(self) -> np.ndarray:
        """A fingerprint of each whole set."""
        return mix(self.reduced(mix(self.values), np.add) + self.sizes.astype(np.uint64)).view(np.int64)

    def signatures(self) -> np.ndarray:
        """For each document TREES * ROWS minima, folded to 16 bits."""
        out = np.empty((len(self.sizes), len(SEEDS)), np.uint16)
        for j, seed in enumerate(SEEDS):
            least = self.reduced((self.values * seed) >> np.uint64(24), np.minimum)
            out[:, j] = (mix(least + seed) >> np.uint64(48)).astype(np.uint16)
        return out


SKETCH = "doc_id long, print long, n_shingles long, class long, signature binary"


def print_of() -> Column:
    """A fingerprint of a row's text."""
    return F.xxhash64(text_column())


def sketches(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                s = Shingles(part.column("text"), size)
                none = s.sizes == 0
                signature = pa.array([x.tobytes() for x in s.signatures()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("print"), pa.array(s.sizes), pa.array(s.keys(), mask=none), signature], ["doc_id", "print", "n_shingles", "class", "signature"])

    return in_small_batches(docs).select(F.col("doc_id").cast("long"), text_column(), print_of().alias("print")).mapInArrow(giving_back(run), SKETCH)


def forest(classes: DataFrame) -> DataFrame:
    """tree, key (its DEPTH minima) and class, for each class and tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, _ = text_bytes(batch.column("signature"))
            s = raw.view(np.uint16).reshape(-1, TREES * ROWS).astype(np.int64)
            for t in range(TREES):
                key = sum(s[:, t * ROWS + k] << (16 * k) for k in range(DEPTH))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), t, np.int32)), pa.array(key), batch.column("class")], ["tree", "key", "class"])

    return classes.select("class", "signature").mapInArrow(giving_back(run), "tree int, key long, class long")


def agreements(many: np.ndarray, one: np.ndarray) -> np.ndarray:
    """In how many minima each of many signatures agrees with one."""
    eights = (many == one).view(np.uint64)
    return (eights.sum(axis=1) * np.uint64(0x0101010101010101)) >> np.uint64(56)  # sums of bytes, none above 96


def reached(signatures: np.ndarray) -> np.ndarray:
    """For each row the first row of those that pairs, each agreeing enough, connect it with.

    A row that has been reached is never compared with another one that has, so near copies of each other take one comparison each.
    """
    n = len(signatures)
    out = np.arange(n)
    if n == 2:
        if agreements(signatures[1:], signatures[0])[0] >= LEAST_AGREEMENT * signatures.shape[1]:
            out[1] = 0
        return out
    left, rest = np.arange(1, n), signatures[1:]
    todo, root = [0], 0
    while len(left):
        if not todo:
            root, left, rest = int(left[0]), left[1:], rest[1:]
            todo = [root]
        hit = agreements(rest, signatures[todo.pop()]) >= LEAST_AGREEMENT * signatures.shape[1]
        if hit.any():
            out[left[hit]] = root
            todo.extend(left[hit].tolist())
            left, rest = left[~hit], rest[~hit]
    return out


def connected(signatures: np.ndarray) -> np.ndarray:
    """reached(), after rows with equal signatures, the deepest prefix of all, have been joined."""
    if len(signatures) <= 2:
        return reached(signatures)
    _, first, number = np.unique(signatures.view([("", signatures.dtype)] * signatures.shape[1])[:, 0], return_index=True, return_inverse=True)
    order = np.argsort(first)  # the different signatures as they first come
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    kept = first[order]
    return kept[reached(np.ascontiguousarray(signatures[kept]))][place[number]]


def candidates(classes: DataFrame, work: str) -> DataFrame:
    """Edges (a, b) that connect all classes that pairs with a common region and enough equal minima connect."""
    sizes = shared_table(forest(classes).groupBy("tree", "key").agg(F.count("*").alias("n")).filter("n > 1"), f"{work}/sizes")
    regions = shared_table(forest(classes).join(F.broadcast(sizes) if sizes.count() <= MOST_BROADCAST else sizes, ["tree", "key"]), f"{work}/regions")

    def connect(group: pa.Table) -> pa.Table:
        group = group.sort_by([("tree", "ascending"), ("key", "ascending"), ("class", "ascending")]).combine_chunks()
        tree, key, cls = (group.column(k).to_numpy() for k in ("tree", "key", "class"))
        s = np.ascontiguousarray(text_bytes(group.column("signature"))[0].view(np.uint16).reshape(-1, TREES * ROWS))
        ends = np.append(np.flatnonzero(np.append(True, (tree[1:] != tree[:-1]) | (key[1:] != key[:-1]))), len(cls)).tolist()
        root = np.concatenate([lo + connected(s[lo:hi]) for lo, hi in zip(ends[:-1], ends[1:])])
        moved = root != np.arange(len(root))
        return pa.table({"a": cls[moved], "b": cls[root[moved]]})

    tiles = F.ceil(F.col("n") / REGION_TILE)
    parts = max(4 * int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-regions.count() * 250 // GROUP_BYTES))
    whole = F.col("n") <= REGION_TILE
    dealt = regions.join(classes.select("class", "signature"), "class").withColumn("tile", F.pmod(F.xxhash64("class"), tiles)).withColumn("mate", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
    part = F.when(whole, F.pmod(F.xxhash64("tree", "key"), F.lit(parts))).otherwise(F.xxhash64("tree", "key"))
    x, y = (F.when(whole, -1).otherwise(f("tile", "mate")) for f in (F.least, F.greatest))
    return contracted(dealt.select("tree", "key", "class", "signature", part.alias("part"), x.alias("x"), y.alias("y")).groupBy("part", "x", "y").applyInArrow(giving_back_each(connect), "a long, b long"))


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the same nodes: each node with the least of its b, and once each pair of such a least and another b.

    A node has a b for each tree and pair of tiles at most; of nodes with the same b there remains one edge each.
    """
    least = edges.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("bs")).select(F.explode(F.array_append(F.slice("bs", 2, 1 << 30), F.col("a"))).alias("a"), F.col("bs")[0].alias("b"))
    return least.filter("a != b").distinct()


def components(edges: DataFrame, work: str) -> DataFrame:
    """node and label (the least node reachable) for every node of the edges (a, b).

    Labels spread to neighbours and then jump to the label's label, so the number of rounds grows with the logarithm of a
    component's width. Each round is written to the shared folder.
    """
    both = shared_table(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{work}/edges")
    labels = shared_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), f"{work}/labels0")
    turn = 0
    while True:
        turn += 1
        heard = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        spread = labels.join(heard, "node").select("node", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = shared_table(spread.join(jump, "label").select("node", "was", F.least("label", "further").alias("label")), f"{work}/labels{turn}")
        if new.filter("was != label").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each pair of sets has in common."""
    n = len(sets)
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(counts > 1) - 1
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    keep = counts[inverse] > 1
    owner, column = owner[keep], shared[inverse[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n), np.float32)
    columns = int(column[-1]) + 1 if len(column) else 0
    width = min(columns, max(64, (16 << 20) // (4 * n)))
    for lo in range(0, columns, max(width, 1)):
        a, b = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((n, width), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        out += m @ m.T
    return out


def linked_pairs(both: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sets of sizes n link, by the sizes of their intersections; strip by strip."""
    out = np.empty(both.shape, bool)
    for lo in range(0, len(n), STRIP):
        part = both[lo : lo + STRIP].astype(np.int64)
        out[lo : lo + STRIP] = (100 + percent) * part >= percent * (n[lo : lo + STRIP, None] + n[None, :])
    return out


def spanning(keys: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each row to the least key of its component; keys ascend."""
    label = np.arange(len(keys), dtype=np.int32)
    while True:
        new = np.concatenate([np.where(linked[lo : lo + STRIP], label[None, :], len(keys)).min(axis=1) for lo in range(0, len(keys), STRIP)])
        new = np.minimum(label, new.astype(np.int32))
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(keys))
    return keys[moved], keys[label[moved]]


def links(members: DataFrame, size: int, percent: int) -> DataFrame:
    """Edges (a, b) that span the links of each cluster. members: class, cluster, part, x, y and text."""

    def verify(group: pa.Table) -> pa.Table:
        group = group.sort_by([("cluster", "ascending"), ("class", "ascending")]).combine_chunks()
        cluster, wanted = group.column("cluster").to_numpy(), group.column("class").to_numpy()
        ends = np.append(np.flatnonzero(np.append(True, cluster[1:] != cluster[:-1])), len(cluster))
        a, b = [], []
        for lo, hi in zip(ends[:-1], ends[1:]):
            s = Shingles(group.column("text").slice(lo, hi - lo), size)
            ok = s.keys() == wanted[lo:hi]  # another text of the same id drops out
            ok[1:] &= ~((wanted[lo + 1 : hi] == wanted[lo : hi - 1]) & ok[:-1])
            sets = [s.values[s.bounds[i] : s.bounds[i + 1]] for i in np.flatnonzero(ok)]
            if len(sets) < 2:
                continue
            both = common_counts(sets)
            n = np.array([len(x) for x in sets])
            child, root = spanning(wanted[lo:hi][ok], linked_pairs(both, n, percent))
            a.append(child)
            b.append(root)
        return pa.table({"a": np.concatenate(a) if a else np.zeros(0, np.int64), "b": np.concatenate(b) if b else np.zeros(0, np.int64)})

    return contracted(members.groupBy("part", "x", "y").applyInArrow(giving_back_each(verify), "a long, b long"))


#: A row that has a class: that of the least id and print, and how many rows are equal to it.
FIRST = ("first_id", "first_print", "copies")


def exact_edges(docs: DataFrame, inside: DataFrame, size: int, percent: int, work: str) -> DataFrame:
    """Edges that span the links of each cluster. inside: class, cluster, tiles, n_shingles and a row that has the class: first_id, first_print and how many rows are equal to it (copies)."""
    total = inside.agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"), F.max("tiles").alias("tiles")).first()
    parts = max(1, -(-6 * (total.s or 0) // GROUP_BYTES))
    text = docs.select(F.col("doc_id").cast("long").alias("first_id"), print_of().alias("first_print"), "text")
    tile, whole, zero = F.pmod(F.xxhash64("class"), F.col("tiles")), F.col("tiles") == 1, F.lit(0).cast("long")

    def told(members: DataFrame, name: str) -> DataFrame:
        """members: class, first_id, first_print, copies, cluster, part, and the pairs (x, y) of tiles that each takes part in."""
        keys = shared_table(members, f"{work}/{name}-members")
        joined = text.join(F.broadcast(keys) if total.n <= MOST_BROADCAST else keys.hint("shuffle_hash"), ["first_id", "first_print"])
        # of equal rows each task passes on one
        once = joined.filter("copies > 1").groupBy("class").agg(*[F.first(c).alias(c) for c in joined.columns if c != "class"])
        joined = joined.filter("copies = 1").unionByName(once)
        dealt = joined.select("class", "cluster", "part", "text", F.explode("pairs").alias("pair")).select("class", "cluster", "part", "text", "pair.x", "pair.y")
        return shared_table(links(dealt, size, percent), f"{work}/{name}")

    pair = lambda x, y: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    every = lambda n: F.sequence(zero, n - 1)
    first = F.when(whole, F.array(pair(F.lit(-1), F.lit(-1)))).when(tile == 0, F.transform(every(F.col("tiles")), lambda t: pair(zero, t))).otherwise(F.array(pair(zero, tile)))  # there a tile is compared with itself, too
    edges = told(inside.select("class", *FIRST, "cluster", F.when(whole, F.pmod(F.xxhash64("cluster"), F.lit(parts))).otherwise(F.col("cluster")).alias("part"), first.alias("pairs")), "first")
    if not total.n or total.tiles == 1:
        return edges
    label = components(edges, f"{work}/first-components").withColumnRenamed("node", "class")
    large = inside.filter("tiles > 1").join(label, "class", "left").withColumn("label", F.coalesce("label", "class"))
    counts = large.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    rest = counts.groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.ceil((F.sum("n") - F.max("n")) / TILE_CLASSES).alias("rests")).filter("rests > 0")
    large = shared_table(large.join(rest, "cluster"), f"{work}/second-large")
    if large.isEmpty():
        return edges
    own = F.transform(every(F.col("rests")), lambda r: pair(r, tile))
    others = F.transform(every(F.col("tiles")), lambda t: pair(F.pmod(F.xxhash64("class", F.lit(1)), F.col("rests")), t))
    pairs = F.when(F.col("label") == F.col("most"), own).otherwise(F.array_union(own, others))
    return edges.unionByName(told(large.select("class", *FIRST, "cluster", F.col("cluster").alias("part"), pairs.alias("pairs")), "second"))


def linked(docs: DataFrame, size: int, percent: int, work: str) -> tuple[DataFrame, DataFrame]:
    """The rows' sketches; and for each class the label of its component and the least doc_id in it."""
    sketch = shared_table(sketches(docs, size), f"{work}/sketch")
    rows = sketch.filter("class is not null").groupBy("class", "doc_id", "print").agg(F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "print", "copies")))
    classes = rows.groupBy("class").agg(first.alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = shared_table(classes.select("class", *[F.col(f"first.{c}").alias(n) for c, n in zip(("doc_id", "print", "copies"), FIRST)], "n_shingles", "signature"), f"{work}/classes")
    clusters = components(candidates(classes, work), f"{work}/clusters")
    inside = classes.select("class", *FIRST, "n_shingles").join(clusters.withColumnRenamed("node", "class"), "class").filter("first_id is not null")
    sizes = inside.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / TILE_CLASSES), F.ceil(F.sum("n_shingles") / TILE_SHINGLES)).alias("tiles"))
    inside = shared_table(inside.join(sizes, "label").select("class", *FIRST, F.col("label").alias("cluster"), "tiles", "n_shingles"), f"{work}/members")
    found = components(exact_edges(docs, inside, size, percent, work), f"{work}/components")
    named = classes.select("class", "first_id").join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    least = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return sketch, shared_table(named.join(least, "label").select("class", "label", "component_id"), f"{work}/named")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links) and kept, for every row.

    Two documents link if their sets of shingles (size consecutive words, a shorter text's whole sequence) have a similarity
    of percent or more. A null or wordless text has no set and links with nothing. A document with a null id links only with its
    exact copies and never names a component; alone it has a null component and is kept. Repeated rows and rows of one
    id are documents of their own with that id. Runs its jobs when called.
    """
    sketch, named = linked(docs, size, percent, shared_dir(docs.sparkSession))
    out = sketch.select("doc_id", "n_shingles", "class").join(named, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row (all columns, whatever their names) of each component of near_duplicates, one of the least id; each row counts as a document.

    Rows without a set of shingles (a null or wordless text) link with nothing and all stay; a null id comes after all others. Which of several
    rows with the representative's id and text stays is left open. An empty table stays empty. Runs its jobs when called.
    """
    work = shared_dir(docs.sparkSession)
    its_id, its_print, its_row = fresh(docs, "its_id", "its_print", "its_row")
    sketch, named = linked(docs, size, percent, work)
    texts = sketch.filter("class is not null").groupBy("doc_id", "print", "class").agg(F.count("*").alias("n"))
    texts = shared_table(texts.join(named.select("class", "label"), "class"), f"{work}/texts")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "class", "print")  # rows without an id come last
    best = texts.groupBy("label").agg(F.min(place).alias("best"))
    texts = texts.join(best, "label").select(F.col("doc_id").alias(its_id), F.col("print").alias(its_print), "n", (place == F.col("best")).alias("stays"))
    texts = shared_table(texts.filter("not stays or n > 1"), f"{work}/decided")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(its_id)) & (print_of() == F.col(its_print))
    out = without(docs, texts.select(its_id, its_print), same, work)
    repeated = texts.filter("stays").select(its_id, its_print)
    n = repeated.count()
    if not n:
        return out
    # aggregated before the shuffle, so that of a much-repeated row each task sends one
    some = docs.join(F.broadcast(repeated) if n <= MOST_BROADCAST else repeated, same)
    one = some.groupBy(its_id, its_print).agg(F.first(F.struct(*every_column(docs))).alias(its_row))
    return out.unionByName(one.select(f"{its_row}.*"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4)


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, pos, pos + 3), ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS pos FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.y FROM reach JOIN links ON reach.b = links.x),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN least ON a = d.doc_id
"""
