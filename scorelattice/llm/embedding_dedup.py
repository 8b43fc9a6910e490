"""Near-duplicate vectors by an inverted multi-index.

Vectors are scaled to length one and cut into halves; each half has a codebook, and the product of
the two codebooks is a grid of cells in which every vector has its home. A query visits cells
in the order of a multi-sequence traversal, by the sum of its two halves' squared distances to the
cells' centres, and stops where that sum exceeds its own cell's by a slack. The slack is fitted so
that 99.9% of links with the least cosine allowed, the hardest ones, are met; closer ones are met more
often. What the visited cells hold is verified by the cosine in double precision.

Vectors that are equal in every component are one class with a weight. Cells are cut into tiles, so a
cell of any size is shared out among tasks; tasks hand on counts and spanning forests, never pairs.

The codebooks have sqrt(n / 512) centres, so that a cell holds about 512 vectors at any size, up to 4,096
centres (8.6 billion vectors); they are fitted on a sample of 8,192 to 65,536 rows (CENTRE_ROWS a centre).
No table of all cells is made: a cell's distance is the sum of two entries of the halves' tables.

Edge cases: labels are compared in their own type; vectors that are null, empty, zero or hold null or non-finite components, and rows with a
null label, link with nothing and are their own component; vectors of different lengths never link;
rows that repeat a vec_id and its vector link with each other, rows that share a vec_id only are one
node (with the sum of the links); every row gives a row; a null vec_id is ordered after all others; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelattice.llm.common import NO_ID, map_batches, written
from scorelattice.llm.components import components, local_forest
from scorelattice.llm.simhash import Forest

LEAST_COSINE = 0.93
#: Share of the hardest links (cosine of exactly LEAST_COSINE) that the traversal must meet.
RECALL = 0.999
#: Codebooks: so many rows a centre are fitted on, and so many in all at least and at most.
CENTRE_ROWS, TRAIN_ROWS, MOST_TRAIN_ROWS = 16, 8192, 65_536
TILE = 1024
#: Numbers of a table of distances that is held at a time.
HELD = 1 << 22


def codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k-means centres of bounded training rows."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(np.unique(x, axis=0))))
    centres = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    part = max(1, HELD // k)
    for _ in range(rounds):
        near = np.concatenate([nearest(x[at : at + part], centres)[0] for at in range(0, len(x), part)])
        n, sums = np.bincount(near, minlength=k), np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centre, squared distances to all centres)."""
    d = np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)[None], 0)
    return d.argmin(axis=1), d


@dataclass(frozen=True)
class Grid:
    """Two codebooks, and how much farther than its own cell a query goes."""

    books: tuple[np.ndarray, np.ndarray]
    slack: float

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of both halves of each row to the codebooks' centres."""
        half = x.shape[1] // 2
        return nearest(x[:, :half], self.books[0])[1], nearest(x[:, half:], self.books[1])[1]

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centre of each half of each row."""
        first, second = self.halves(x)
        return first.argmin(axis=1), second.argmin(axis=1)

    def beyond(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How much farther than the row's own each centre of each half is; a cell is as much farther as both."""
        first, second = self.halves(x)
        return first - first.min(axis=1, keepdims=True), second - second.min(axis=1, keepdims=True)

    def rows_at_a_time(self) -> int:
        return max(1, HELD // max(len(b) for b in self.books))


def visits(first: np.ndarray, second: np.ndarray, most: float) -> list[int]:
    """Cells by growing sum of two rows of distances, up to `most`: the multi-sequence traversal.

    A cell of the sorted grid enters the queue once its neighbours towards the corner are out of it.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    da, db = first[a].tolist(), second[b].tolist()
    out, queue, reached = [], [(da[0] + db[0], 0, 0)], [0] * len(da)
    while queue:
        d, i, j = heappop(queue)
        if d > most:
            break
        out.append(int(a[i]) * len(db) + int(b[j]))
        reached[i] = j + 1
        if i + 1 < len(da) and reached[i + 1] == j:
            heappush(queue, (da[i + 1] + db[j], i + 1, j))
        if j + 1 < len(db) and (i == 0 or reached[i - 1] > j + 1):
            heappush(queue, (da[i] + db[j + 1], i, j + 1))
    return out


def fit(x: np.ndarray, codes: int, least: float, recall: float = RECALL, seed: int = 5) -> Grid:
    """Codebooks of unit rows, and the slack at which `recall` of the hardest links are met.

    The hardest links have a cosine of exactly `least`: they are made up from the rows by turning each
    towards a random direction. A link is met if either end visits the other's home.
    """
    half = x.shape[1] // 2
    grid = Grid(tuple(codebook(p, codes) if p.shape[1] else np.zeros((1, 0)) for p in (x[:, :half], x[:, half:])), 0.0)
    rng = np.random.default_rng(seed)
    u = x[rng.integers(0, len(x), 4000)]
    turn = rng.normal(size=u.shape)
    turn -= (turn * u).sum(axis=1, keepdims=True) * u
    turn /= np.maximum(np.sqrt((turn**2).sum(axis=1, keepdims=True)), 1e-12)
    v = least * u + np.sqrt(1 - least**2) * turn
    v /= np.sqrt((v**2).sum(axis=1, keepdims=True))
    needed, part = [], grid.rows_at_a_time()
    for s in range(0, len(u), part):
        ends, away = (u[s : s + part], v[s : s + part]), []
        for a, b in (ends, ends[::-1]):
            (first, second), (i, j), row = grid.beyond(a), grid.homes(b), np.arange(len(a))
            away.append(first[row, i] + second[row, j])
        needed.append(np.minimum(*away))
    needed = np.concatenate(needed)
    return Grid(grid.books, float(np.quantile(needed, recall)) + 1e-9)


def _unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows of length one, which rows of the column they are); all of one length."""
    rows = [np.frombuffer(v, np.float64) for v in column.to_pylist()]
    x = np.array(rows)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def _router(grid: Grid):
    """For each class a row for every visited cell; the first is its home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = min(4096, grid.rows_at_a_time())
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                first, second = grid.beyond(_unit(part.column(3)))
                cells = [visits(f, s, grid.slack) for f, s in zip(first, second, strict=True)]
                n = np.array([len(c) for c in cells])
                home = np.zeros(n.sum(), bool)
                home[np.cumsum(n) - n] = True
                rows = part.take(pa.array(np.repeat(np.arange(len(n)), n)))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([x for c in cells for x in c], pa.int32()), pa.array(home)], [*part.schema.names, "cell", "home"])

    return run


def _tile_links(grid: Grid, least: float):
    """Verifies a tile of home vectors against a tile of visitors: counts and a spanning forest.

    A visitor counts the home vectors that it links with. A home vector that doesn't visit the
    visitor's own cell won't meet it there, and counts it here.
    """

    def run(table: pa.Table) -> pa.Table:
        is_home = table.column("is_home").to_numpy(zero_copy_only=False)
        ids, weights = table.column("id").to_numpy(), table.column("weight").to_numpy()
        h, v = np.flatnonzero(is_home), np.flatnonzero(~is_home)
        names, empty = ("id", "links", "a", "b"), np.zeros(0, np.int64)
        if not len(h) or not len(v):
            return pa.table({k: pa.array(empty, pa.int64()) for k in names})
        x = _unit(table.column("vec"))
        forest, counts = Forest(len(ids)), np.zeros(len(ids), np.int64)
        first, second = grid.beyond(x[h])  # by halves: the table of all cells isn't made
        i_home, j_home = grid.homes(x[v])
        for s in range(0, len(v), 512):
            own = v[s : s + 512]
            linked = (x[own] @ x[h].T >= least) & (ids[own][:, None] != ids[h][None])
            i, j = np.nonzero(linked)
            np.add.at(counts, own[i], weights[h[j]])
            missed = first[j, i_home[s + i]] + second[j, j_home[s + i]] > grid.slack
            np.add.at(counts, h[j[missed]], weights[own[i[missed]]])
            forest.add(own[i], h[j])
        some = np.flatnonzero(counts)
        a, b = forest.edges()
        pad = lambda n: pa.nulls(n, pa.int64())
        return pa.table([pa.chunked_array([pa.array(c), pad(len(a))]) if k < 2 else pa.chunked_array([pad(len(some)), pa.array(c)]) for k, c in enumerate((ids[some], counts[some], ids[a], ids[b]))], list(names))

    return run


def near_duplicates(vectors: DataFrame, least: float = LEAST_COSINE, codes: int | None = None, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    values = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(values, lambda v: v != 0)
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vid"), "label", F.when(F.coalesce(fine, F.lit(False)), F.transform(values, lambda v: v + 0.0)).alias("values"))
    rows = written(rows, "vectors")
    # equal vectors of a label are one class: its id is the smallest vec_id
    classes = rows.where("values is not null").groupBy("label", "values").agg(F.min("vid").alias("id"), F.count("*").alias("weight"))
    classes = written(classes.withColumn("dims", F.size("values")), "vector-classes")
    # repeated vec_ids: classes are told apart by a number of their own
    lengths = [r["dims"] for r in classes.select("dims").distinct().orderBy("dims").collect()]
    parts = [_links_of_length(classes.where(F.col("dims") == d), d, least, codes, tile) for d in lengths]
    links = parts[0] if parts else None
    for more in parts[1:]:
        links = links.unionByName(more)
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    if links is None:
        return rows.select(real("vid").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), real("vid").alias("component_id"), F.lit(True).alias("kept"))
    links = written(links, "vector-links")
    counts = links.where("id is not null").groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(local_forest(links.where("a is not null").select("a", "b")))
    named = classes.join(counts, "id", "left").join(groups, F.col("id") == F.col("node"), "left")
    named = named.select(F.col("label").alias("class_label"), F.col("values").alias("class_values"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    out = rows.join(written(named, "vector-named"), (F.col("label") == F.col("class_label")) & (F.col("values") == F.col("class_values")), "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "vid"))
    return out.select(real("vid").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), real("component_id").alias("component_id"), (F.col("vid") == F.col("component_id")).alias("kept"))


def _pack(values):
    """The doubles of an array as bytes, in one Arrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(3)
            x = flat.flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in x], pa.binary())], ["id", "label", "weight", "vec"])

    return map_batches(values.select("id", "label", "weight", "values"), run, f"id long, label {values.schema['label'].dataType.simpleString()}, weight long, vec binary")


def _links_of_length(classes: DataFrame, dims: int, least: float, codes: int | None, tile: int) -> DataFrame:
    """Rows (id, links) of visitors' counts and (a, b) of forests, for vectors of one length."""
    packed = written(_pack(classes), "vector-packed")
    n = packed.count()
    codes = codes or int(min(MOST_TRAIN_ROWS // CENTRE_ROWS, max(4, (n / 512) ** 0.5)))
    train = max(TRAIN_ROWS, CENTRE_ROWS * codes)
    share = min(1.0, train / n)
    draw = packed.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 40)) < int(share * (1 << 40))) if share < 1 else packed
    x = _unit(pa.array([r["vec"] for r in draw.orderBy("id", "vec").limit(2 * train).select("vec").collect()], pa.binary()))
    grid = fit(x, codes, least)
    routed = map_batches(packed, _router(grid), f"id long, label {packed.schema['label'].dataType.simpleString()}, weight long, vec binary, cell int, home boolean")
    routed = written(routed, "vector-cells")
    # tiles of a cell: visitors meet each home tile, home rows each visitor tile
    sizes = routed.groupBy("label", "cell").agg(F.ceil(F.sum(F.col("home").cast("int")) / tile).cast("int").alias("home_tiles"), F.ceil(F.count("*") / tile).cast("int").alias("visitor_tiles")).where("home_tiles > 0")
    sizes = written(sizes, "vector-sizes")
    sized = routed.join(sizes, ["label", "cell"])
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    own = lambda c: F.array(F.pmod(F.xxhash64("id", F.lit(c)), F.col(c)).cast("int"))
    as_home = sized.where("home").select("id", "label", "weight", "vec", "cell", own("home_tiles").alias("h"), every("visitor_tiles").alias("v"), F.lit(True).alias("is_home"))
    as_visitor = sized.select("id", "label", "weight", "vec", "cell", every("home_tiles").alias("h"), own("visitor_tiles").alias("v"), F.lit(False).alias("is_home"))
    tiles = as_home.unionByName(as_visitor).withColumn("h", F.explode("h")).withColumn("v", F.explode("v"))
    return tiles.groupBy("label", "cell", "h", "v").applyInArrow(_tile_links(grid, least), "id long, links long, a long, b long")
