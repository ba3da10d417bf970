"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells.

A vector lives in the cell of its nearest centroid and is a guest in every other cell that
can hold a vector at the threshold from it, by two bounds: such a vector can be no further
across the border between two cells than the chord of the threshold, and no further from
the centroid than the cell's radius and the threshold's angle together. So no pair is lost
to a border. Equal vectors are one, with a weight, before any product is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.common import components, mapped
from firmlens.llm.vectors import matrix, usable
from firmlens.sources.sinks import materialize


@dataclass(frozen=True)
class EmbedConfig:
    """cosine: least similarity of a link. cell_rows: vectors per cell aimed at.

    max_cells bounds the centroids; sample_rows the vectors that k-means is fitted on, while
    all are assigned and compared. block: rows of one side of a tile.
    """

    cosine: float = 0.95
    cell_rows: int = 8192
    max_cells: int = 1024
    sample_rows: int = 20_000
    rounds: int = 8
    block: int = 4096


#: Slack for single precision products; pairs that close to the threshold are recomputed.
BAND = 3e-5


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """k unit centroids; rows are unit vectors in an order that does not depend on their values."""
    centroids = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        cell = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, x)
        norm = np.linalg.norm(sums, axis=1)
        centroids[norm > 1e-9] = sums[norm > 1e-9] / norm[norm > 1e-9, None]
    return centroids


class Cells:
    """Centroids, the angle of each cell's farthest member, and who may meet whom."""

    def __init__(self, centroids: np.ndarray, cosine: float):
        self.centroids = centroids
        self.angle = np.arccos(cosine)
        self.chord = np.sqrt(2.0 - 2.0 * cosine)
        apart = np.linalg.norm(centroids[:, None, :] - centroids[None, :, :], axis=2)
        self.reach = self.chord * apart + 1e-9
        self.radius = np.full(len(centroids), np.pi)

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = x @ self.centroids.T
        cell = near.argmax(axis=1)
        return cell, np.arccos(np.clip(near[np.arange(len(x)), cell], -1.0, 1.0))

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and cells to bring together, and whether the cell is the row's home."""
        near = x @ self.centroids.T
        home = near.argmax(axis=1)
        best = near[np.arange(len(x)), home]
        across = best[:, None] - near <= self.reach[home]
        inside = np.arccos(np.clip(near, -1.0, 1.0)) <= self.radius + self.angle + 1e-9
        at, cell = np.nonzero(across & inside | (np.arange(near.shape[1]) == home[:, None]))
        return at, cell, cell == home[at]


def near_duplicates(
    vectors: DataFrame,
    cfg: EmbedConfig | None = None,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    n_links counts the other rows with a cosine of at least the threshold, in double
    precision. component_id is the smallest vec_id reachable by links and kept says that it is
    the row's own. Rows with a NULL id and vectors that are NULL, empty, zero or hold NULL or
    non-finite components have no links; vectors link only to those of their own length. Repeated
    rows link to each other; of one id with several vectors each row has its own links and group.
    A cosine of exactly the threshold links. An empty table gives no rows; other columns are not
    looked at.
    """
    cfg = cfg or EmbedConfig()
    rows = usable(vectors, id_column, vector_column)
    classes = materialize(
        rows.groupBy("v")
        .agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"))
        .withColumn("rep", F.monotonically_increasing_id())  # an id may have several vectors
        .withColumn("dim", F.size("v")),
        "vector_classes",
    )
    dims = [r.dim for r in classes.select("dim").distinct().collect()]
    tiles = [_tiles(classes.where(F.col("dim") == d), d, cfg) for d in dims]
    out = vectors.select(F.col(id_column).alias("vec_id"), F.col(vector_column).alias("v"))
    if not tiles:
        alone = F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
        return out.select("vec_id", *alone, F.col("vec_id").isNotNull().alias("kept"))
    found = tiles[0]
    for more in tiles[1:]:
        found = found.unionByName(more)
    links = found.where("root IS NULL").groupBy("rep").agg(F.sum("links").alias("others"))
    groups = components(found.where("root IS NOT NULL").selectExpr("rep AS src", "root AS dst"))
    grouped = (
        classes.join(links, "rep", "left")
        .join(groups, F.col("rep") == F.col("node"), "left")
        .selectExpr(
            "v",
            "vec_id AS first",
            "coalesce(others, 0L) + weight - 1 AS links",
            "coalesce(component, rep) AS group",
        )
    )
    smallest = grouped.groupBy("group").agg(F.min("first").alias("component"))
    linked = grouped.join(smallest, "group").select("v", "links", "component")
    return out.join(
        linked.withColumnRenamed("v", "_v"), F.expr("vec_id IS NOT NULL AND v = _v"), "left"
    ).selectExpr(
        "vec_id",
        "coalesce(links, 0L) AS n_links",
        "coalesce(component, vec_id) AS component_id",
        "coalesce(vec_id = coalesce(component, vec_id), false) AS kept",
    )


def _tiles(classes: DataFrame, dim: int, cfg: EmbedConfig) -> DataFrame:
    """Written rows (rep, links, root): link counts per tile, and a spanning forest of its links."""
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("v")).limit(cfg.sample_rows).select("v").toArrow()
    k = max(1, min(-(-n // cfg.cell_rows), cfg.max_cells, sample.num_rows))
    cells = Cells(spherical_kmeans(unit(matrix(sample["v"])), k, cfg.rounds), cfg.cosine)

    def homes(batch: pa.RecordBatch) -> Iterator[dict]:
        cell, angle = cells.home(unit(matrix(batch.column("v"))))
        size = np.bincount(cell, minlength=k)
        widest = np.zeros(k)
        np.maximum.at(widest, cell, angle)
        yield {"cell": np.arange(k), "n": size, "angle": widest}

    home = mapped(classes.select("v"), "cell int, n long, angle double", homes, rows=8192)
    at_home = dict.fromkeys(range(k), 0)
    for r in home.groupBy("cell").agg(F.sum("n").alias("n"), F.max("angle").alias("angle")).collect():
        cells.radius[r.cell], at_home[r.cell] = r.angle, r.n

    def counts(batch: pa.RecordBatch) -> Iterator[dict]:
        cell = cells.visits(unit(matrix(batch.column("v"))))[1]
        yield {"cell": np.arange(k), "n": np.bincount(cell, minlength=k)}

    met = mapped(classes.select("v"), "cell int, n long", counts, rows=8192)
    in_cell = dict.fromkeys(range(k), 0) | dict(
        map(tuple, met.groupBy("cell").agg(F.sum("n")).collect())  # at most max_cells rows
    )

    def sent(at: np.ndarray, cell: np.ndarray, batch: pa.RecordBatch) -> dict:
        return {"cell": cell} | dict(zip(batch.schema.names, batch.take(pa.array(at)).columns))

    def at_home_only(batch: pa.RecordBatch) -> Iterator[dict]:
        cell, _ = cells.home(unit(matrix(batch.column("v"))))
        yield sent(np.arange(len(cell)), cell, batch)

    def everywhere(batch: pa.RecordBatch) -> Iterator[dict]:
        at, cell, _ = cells.visits(unit(matrix(batch.column("v"))))
        yield sent(at, cell, batch)

    schema = f"cell int, rep long, weight long, v {classes.schema['v'].dataType.simpleString()}"
    vectors = classes.select("rep", "weight", "v")
    own = mapped(vectors, schema, at_home_only, rows=2048)
    guests = mapped(vectors, schema, everywhere, rows=2048)

    def blocks(of: dict[int, int]) -> F.Column:
        counts = F.array(*(F.lit(max(1, -(-of[c] // cfg.block))) for c in range(k)))
        return F.element_at(counts, F.col("cell") + 1)

    place = F.xxhash64("rep")
    left = own.select(
        "cell",
        F.pmod(place, blocks(at_home)).cast("int").alias("a"),
        F.explode(F.sequence(F.lit(0), blocks(in_cell) - 1)).alias("b"),
        "rep",
        "v",
    )
    right = guests.select(
        "cell",
        F.explode(F.sequence(F.lit(0), blocks(at_home) - 1)).alias("a"),
        F.pmod(place, blocks(in_cell)).cast("int").alias("b"),
        "rep",
        "weight",
        "v",
    )
    cosine = cfg.cosine
    tiles = (
        left.groupBy("cell", "a", "b")
        .cogroup(right.groupBy("cell", "a", "b"))
        .applyInArrow(lambda x, y: _tile(x, y, cosine), "rep long, links long, root long")
    )
    return materialize(tiles, f"vector_links{dim}")


def _tile(homes: pa.Table, others: pa.Table, cosine: float) -> pa.Table:
    kinds = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
    if not homes.num_rows or not others.num_rows:
        return kinds.empty_table()
    a, b = homes["rep"].to_numpy(), others["rep"].to_numpy()
    x, y = unit(matrix(homes["v"])), unit(matrix(others["v"]))
    links = np.zeros(len(a), np.int64)
    weight = others["weight"].to_numpy()
    # Vectors are nodes by number, so that one on both sides is one node.
    nodes = np.unique(np.concatenate([a, b]))
    of_a, of_b = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    low = np.arange(len(nodes))
    x32, y32 = x.astype(np.float32), y.astype(np.float32)
    for start in range(0, len(a), 512):
        own = slice(start, min(start + 512, len(a)))
        near = x32[own] @ y32.T
        i, j = np.nonzero(near >= cosine - BAND)
        unsure = near[i, j] < cosine + BAND
        sure = ~unsure
        sure[unsure] = (x[own][i[unsure]] * y[j[unsure]]).sum(axis=1) >= cosine
        sure &= of_a[own][i] != of_b[j]
        i, j = i[sure], j[sure]
        links[own] += np.bincount(i, weights=weight[j], minlength=own.stop - own.start).astype(np.int64)
        low = _joined(low, of_a[own][i], of_b[j])
    child = np.flatnonzero(low != np.arange(len(nodes)))
    counted = np.flatnonzero(links)
    return pa.table(
        {
            "rep": np.concatenate([a[counted], nodes[child]]),
            "links": pa.array([*links[counted].tolist(), *[None] * len(child)], pa.int64()),
            "root": pa.array([*[None] * len(counted), *nodes[low[child]].tolist()], pa.int64()),
        }
    )


def _joined(low: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of each node's group after joining a[i] with b[i]."""
    while True:
        p, q = low[a], low[b]
        apart = p != q
        if not apart.any():
            return low
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(low, np.maximum(p, q), np.minimum(p, q))
        while (low[low] != low).any():
            low = low[low]
