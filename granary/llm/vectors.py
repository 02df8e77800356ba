"""Near-duplicate vectors by an inverted multi-index.

Vectors of one label that are equal are one class, of length 1 from here on. The two halves of a vector each have a codebook; the
product of both codebooks is a grid, and a class lies in the cell of its nearest codewords. From each class a traversal goes over
both sequences of codewords, nearest first, and visits the cells whose distance is within reach. The distance of a cell is a lower bound,
from the planes halfway between codewords: no vector of the cell is nearer. Two unit vectors with cosine c are sqrt(2 - 2 * c) apart, so that
reach finds every pair; most pairs need far less. The reach is the one within which the target share of the true pairs of a sample of
classes, compared with all classes, are found (all of them, with a margin, as the share is rounded up); without true pairs in the sample, or
with a target of 1, it is the full one. A pair is met in the cell of the higher number only.

Cells are compared by matrix products in double precision, large ones in tiles, so candidates are verified before they link.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, giving_back, giving_back_each, in_small_batches, shared_dir, shared_table, table
from .near import components, contracted, spanning

#: Classes of the largest label in a cell, about; and the most codewords of a half.
CELL, MOST_WORDS = 256, 1024
#: Classes that the codebooks are fitted to at most, and those of them that the reach is measured with.
SAMPLE, QUERIES = 20_000, 256
#: Steps in which the reach is measured, and its margin.
STEPS, MARGIN = 256, 1.25
#: Classes in a tile of a cell.
TILE = 2048
#: Bytes of vectors in a group of small cells, about.
GROUP_BYTES = 8 << 20
STRIP = 512


def unit(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column of so many numbers each, in double precision and of length 1."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def widths(column: pa.Array) -> np.ndarray:
    return column.value_lengths().to_numpy(zero_copy_only=False)


class Grid:
    """Codebooks of both halves of vectors of one width."""

    def __init__(self, sample: np.ndarray, words: int, rounds: int = 10):
        self.width = sample.shape[1]
        self.half = self.width // 2
        self.books = [self.fitted(x, words, rounds) for x in (sample[:, : self.half], sample[:, self.half :])]
        self.gaps = [2 * np.sqrt(np.maximum(self.squares(b, b), 0)) for b in self.books]

    @staticmethod
    def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
        return (x * x).sum(axis=1)[:, None] - 2 * x @ book.T + (book * book).sum(axis=1)

    def fitted(self, x: np.ndarray, words: int, rounds: int) -> np.ndarray:
        """Means of nearest points, from the first points of the sample on."""
        book = x[:words].copy()
        for _ in range(rounds):
            near = self.squares(x, book).argmin(axis=1)
            n = np.bincount(near, minlength=len(book))
            sums = np.zeros_like(book)
            np.add.at(sums, near, x)
            book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
        return book

    def bounds(self, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """For both halves the square of a lower bound of the distance from each codeword's cell; and the vectors' own cells."""
        out, cell = [], np.zeros(len(x), np.int64)
        for part, book, gaps in zip((x[:, : self.half], x[:, self.half :]), self.books, self.gaps):
            d = self.squares(part, book)
            own = d.argmin(axis=1)
            further = d - d[np.arange(len(x)), own][:, None]
            gap = gaps[own]
            out.append(np.where(gap > 0, further / np.where(gap > 0, gap, 1), 0) ** 2)
            cell = cell * len(book) + own
        return out, cell

    def visits(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each vector's own cell; and vector and cell of each visit to a cell of a higher number, nearest codewords first."""
        (first, second), own = self.bounds(x)
        order = [np.argsort(b, axis=1, kind="stable") for b in (first, second)]
        first, second = (np.take_along_axis(b, o, axis=1) for b, o in zip((first, second), order))
        who, where = [], []
        for a in range(first.shape[1]):
            some = np.flatnonzero(first[:, a] <= reach)
            if not len(some):
                break
            n = (second[some] <= (reach - first[some, a])[:, None]).sum(axis=1)
            row = np.repeat(some, n)
            b = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            cell = order[0][row, a] * second.shape[1] + order[1][row, b]
            up = cell > own[row]
            who.append(row[up])
            where.append(cell[up])
        none = [np.zeros(0, np.int64)]
        return own, np.concatenate(none + who), np.concatenate(none + where)


def classes_of(rows: DataFrame) -> DataFrame:
    return rows.filter("class is not null").groupBy("class").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("n"), F.min("vec_id").alias("first_id"))


def measured_reach(classes: DataFrame, grid: Grid, sample: pa.Table, cosine: float, recall: float) -> float:
    """The reach that finds so large a share of the links between some classes of the sample and all classes."""
    limit = 2 - 2 * cosine
    queries = sample.slice(0, QUERIES)
    q, names, labels = unit(queries.column("embedding").combine_chunks(), grid.width), queries.column("class").to_numpy(), queries.column("label").to_numpy()
    q_bounds, q_cell = grid.bounds(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = np.zeros(STEPS + 1, np.int64)
        for batch in batches:
            batch = batch.filter(pa.array(widths(batch.column("embedding")) == grid.width))
            if not batch.num_rows:
                continue
            x = unit(batch.column("embedding"), grid.width)
            near = (x @ q.T >= cosine) & (batch.column("label").to_numpy(zero_copy_only=False)[:, None] == labels) & (batch.column("class").to_numpy(zero_copy_only=False)[:, None] != names)
            i, j = np.nonzero(near)
            bounds, cell = grid.bounds(x)
            words = len(grid.books[1])
            up = cell[i] < q_cell[j]  # from the lower cell to the higher one
            to = np.where(up, q_cell[j], cell[i])
            need = sum(np.where(up, mine[i, k], theirs[j, k]) for mine, theirs, k in zip(bounds, q_bounds, (to // words, to % words)))
            need[cell[i] == q_cell[j]] = 0
            steps += np.bincount(np.minimum(np.ceil(need / limit * STEPS), STEPS).astype(np.int64), minlength=STEPS + 1)
        some = np.flatnonzero(steps)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(steps[some])], ["step", "n"])

    found = classes.select("class", "label", "embedding").mapInArrow(giving_back(run), "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).collect()  # STEPS + 1 rows at most
    n = np.zeros(STEPS + 1)
    for r in found:
        n[r["step"]] = r["n"]
    if not n.sum():
        return limit
    step = int(np.searchsorted(np.cumsum(n), recall * n.sum()))
    return min(limit, MARGIN * (step + 1) / STEPS * limit)


def dealt(classes: DataFrame, grid: Grid | None, reach: float, kind: str) -> DataFrame:
    """Each class in its own cell (member), and as a visitor in those that it visits. Vectors of another width than the grid's have cell 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = widths(batch.column("embedding"))
            own = np.zeros(batch.num_rows, np.int64)
            who, where = np.zeros(0, np.int64), np.zeros(0, np.int64)
            fits = np.flatnonzero(width == grid.width) if grid is not None else who
            if len(fits):
                own[fits], who, where = grid.visits(unit(batch.column("embedding").take(pa.array(fits)), grid.width), reach)
                who = fits[who]
            row = np.concatenate([np.arange(batch.num_rows), who])
            out = batch.take(pa.array(row))
            columns = [pa.array(width[row], pa.int32()), pa.array(np.concatenate([own, where])), pa.array(np.arange(len(row)) < batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*out.columns, *columns], [*out.schema.names, "width", "cell", "member"])

    return classes.select("class", "label", "n", "embedding").mapInArrow(giving_back(run), f"class string, label string, n long, embedding {kind}, width int, cell long, member boolean")


def verifying(cosine: float):
    def verify(group: pa.Table) -> pa.Table:
        group = group.sort_by([(k, "ascending") for k in ("label", "width", "cell", "class")]).combine_chunks()
        label = group.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        width, cell, member, tile = (group.column(k).to_numpy() for k in ("width", "cell", "member", "tile"))
        new = np.append(True, (label[1:] != label[:-1]) | (width[1:] != width[:-1]) | (cell[1:] != cell[:-1]))
        ends = np.append(np.flatnonzero(new), len(label)).tolist()
        child, root, counted, links = [], [], [], []
        across = group.column("x")[0].as_py() != group.column("y")[0].as_py()
        weight = group.column("n").to_numpy()
        for lo, hi in zip(ends[:-1], ends[1:]):
            if hi - lo < 2:
                continue
            x = unit(group.column("embedding").slice(lo, hi - lo).combine_chunks(), int(width[lo]))
            m, t, w = member[lo:hi], tile[lo:hi], weight[lo:hi]
            linked = np.empty((hi - lo, hi - lo), bool)
            total = np.empty(hi - lo, np.int64)
            for a in range(0, hi - lo, STRIP):
                strip = x[a : a + STRIP] @ x.T >= cosine
                strip &= m[a : a + STRIP, None] | m[None, :]  # visitors don't meet each other here
                if across:
                    strip &= t[a : a + STRIP, None] != t[None, :]  # a tile with itself is a group of its own
                strip[np.arange(len(strip)), a + np.arange(len(strip))] = False
                linked[a : a + STRIP] = strip
                total[a : a + STRIP] = strip @ w
            some = np.flatnonzero(total)
            if len(some):
                linked |= linked.T
                c, r = spanning(np.arange(hi - lo), linked)
                child.append(lo + c)
                root.append(lo + r)
                counted.append(lo + some)
                links.append(total[some])
        none = [np.zeros(0, np.int64)]
        child, root, counted, links = (np.concatenate(none + x) for x in (child, root, counted, links))
        name = group.column("class").combine_chunks()
        a = pa.concat_arrays([name.take(pa.array(child)), name.take(pa.array(counted))])
        b = pa.concat_arrays([name.take(pa.array(root)), pa.nulls(len(counted), pa.string())])
        return pa.table({"a": a, "b": b, "links": np.concatenate([np.zeros(len(child), np.int64), links])})

    return verify


def vector_links(vectors: DataFrame, cosine: float = 0.93, recall: float = 0.999) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (least vec_id reachable over links) and kept, for every row.

    Vectors link if their labels are equal and not null and their cosine, in double precision, is at least cosine; candidates
    are found by the index, about recall of them at least (all of them with recall 1 and where a label has CELL classes at most).
    A vector that is null, empty, zero or has null or non-finite components, or one with a null label, links with nothing; one of
    another number of components links with its like only. Each row is a vector of its own, so repeated rows link with each other. A null
    vec_id never names a component, and alone has a null one. Labels and ids of any type that casts to string and long; other columns play no
    part; an empty table gives an empty one. A vector is held whole in a task, as are TILE vectors and their comparisons. A group of n near
    copies costs n**2 / TILE shipped vectors and n**2 comparisons, equal copies nothing. Runs its jobs when called.
    """
    spark, work = vectors.sparkSession, shared_dir(vectors.sparkSession)
    kind = vectors.schema["embedding"].dataType.simpleString()
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = F.coalesce(F.forall("embedding", number) & F.exists("embedding", lambda x: x != 0), F.lit(False)) & F.col("label").isNotNull()
    label = F.col("label").cast("string")
    name = F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(seed), label, "embedding")), 16, "0") for seed in (0, 1)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), "embedding", F.when(whole, name).alias("class"))
    classes = shared_table(classes_of(rows), f"{work}/classes")
    sizes = classes.groupBy("label", F.size("embedding").alias("width")).agg(F.count("*").alias("n")).groupBy("width").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    largest = sizes.orderBy(F.desc("n"), "width").first()
    words = min(MOST_WORDS, ceil(sqrt(largest.most / CELL))) if largest else 1
    grid, reach = None, 0.0
    if words > 1 and largest.width > 1:
        some = classes.filter(F.size("embedding") == largest.width).select("class", "label", "embedding").orderBy("class").limit(SAMPLE).toArrow()
        grid = Grid(unit(some.column("embedding").combine_chunks(), largest.width), words)
        reach = 2 - 2 * cosine if recall >= 1 else measured_reach(in_small_batches(classes), grid, some, cosine, recall)
    sent = dealt(in_small_batches(classes), grid, reach, kind)
    cells = shared_table(sent.groupBy("label", "width", "cell").agg(F.count("*").alias("size"), F.ceil(F.count("*") / TILE).alias("tiles")).filter("size > 1"), f"{work}/cells")
    total = cells.agg(F.count("*").alias("cells"), F.sum(F.col("size") * F.col("width")).alias("numbers")).first()
    parts = max(1, -(-8 * (total.numbers or 0) // GROUP_BYTES))
    one, tiles = F.col("tiles") == 1, F.col("tiles")
    joined = sent.join(F.broadcast(cells) if total.cells <= MOST_BROADCAST else cells, ["label", "width", "cell"])
    joined = joined.withColumn("tile", F.pmod(F.xxhash64("class"), tiles)).withColumn("mate", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
    part = F.when(one, F.pmod(F.xxhash64("label", "width", "cell"), F.lit(parts))).otherwise(F.xxhash64("label", "width", "cell"))
    x, y = (F.when(one, -1).otherwise(f("tile", "mate")) for f in (F.least, F.greatest))
    groups = joined.select("class", "label", "n", "embedding", "width", "cell", "member", "tile", part.alias("part"), x.alias("x"), y.alias("y")).groupBy("part", "x", "y")
    found = shared_table(groups.applyInArrow(giving_back_each(verifying(cosine)), "a string, b string, links long"), f"{work}/found")
    labels = components(contracted(found.filter("b is not null").select("a", "b")), work).select(F.col("node").alias("class"), F.col("label").alias("root"))
    links = found.filter("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    named = classes.select("class", "n", "first_id").join(labels, "class", "left").join(links, "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = shared_table(named.join(least, "root").select("class", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component_id"), f"{work}/named")
    out = rows.select("vec_id", "class").join(named, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op11_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(table(spark, sf_dir, "embeddings"))


OP11_SQL = r"""
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (SELECT * FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT reach.a, links.y FROM reach JOIN links ON reach.b = links.x),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, component_id, e.vec_id = component_id AS kept FROM e LEFT JOIN n ON n.x = e.vec_id JOIN least ON a = e.vec_id
"""
