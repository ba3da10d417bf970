"""Nearest neighbours by a block matrix join of int8 products with error bounds.

Queries and candidates are dealt to blocks, and each pair of blocks is one tile. A tile
multiplies the quantised vectors; the norms of what rounding took away bound the error of
each product, so that only pairs whose upper bound reaches the k-th lower bound are
computed in double precision. The tiles' short lists of a query are merged by a heap. No
candidate is left out on an estimate: the result is that of comparing all pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.vectors import matrix, usable


@dataclass(frozen=True)
class SearchConfig:
    """k: neighbours per query. Blocks: rows of a tile.

    A merge task reads the lists of about merge_queries queries from at most merge_blocks
    candidate blocks; more blocks are merged in levels.
    """

    k: int = 20
    query_block: int = 16_384
    candidate_block: int = 32_768
    merge_queries: int = 256
    merge_blocks: int = 64


LISTS = "vec_id long, code long, times long, block int, ids array<long>, scores array<double>"
FOUND = "query_id long, times long, rank int, vec_id long, score double"


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (as numbers), scales, norms of the coded vectors and norms of the errors."""
    scale = np.abs(x).max(axis=1) / 127.0
    codes = np.rint(x / scale[:, None])
    coded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(coded, axis=1), np.linalg.norm(x - coded, axis=1)


def nearest_in_tile(
    queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, keep: int
) -> tuple[np.ndarray, np.ndarray]:
    """The `keep` rows of largest inner product per query, ties to smaller ids; missing: -inf."""
    n, dim = queries.shape
    kind = np.float32 if dim * 127**2 < 2**24 else np.float64  # products of codes stay exact
    q_codes, q_scale, q_coded, q_error = quantised(queries)
    c_codes, c_scale, _, c_error = quantised(rows)
    c_norm = np.linalg.norm(rows, axis=1)
    q_codes, c_codes = q_codes.astype(kind), c_codes.astype(kind)
    best = np.full((n, keep), -np.inf)
    best_ids = np.full((n, keep), np.iinfo(np.int64).max)
    for a in range(0, n, 256):
        own = slice(a, min(a + 256, n))
        for b in range(0, len(rows), 4096):
            of = slice(b, min(b + 4096, len(rows)))
            near = (q_codes[own] @ c_codes[of].T).astype(np.float64)
            near *= q_scale[own, None] * c_scale[None, of]
            # <q, c> differs from the product of the coded vectors by at most this much
            error = q_error[own, None] * c_norm[None, of] + q_coded[own, None] * c_error[None, of]
            error += 1e-12 * (np.abs(near) + 1.0)
            least = best[own, -1]
            if near.shape[1] >= keep:
                kth = np.partition(near - error, near.shape[1] - keep, axis=1)[:, -keep]
                least = np.maximum(least, kth)
            at, of_row = np.nonzero(near + error >= least[:, None])
            exact = (queries[own][at] * rows[of][of_row]).sum(axis=1)
            best[own], best_ids[own] = _merged(
                best[own], best_ids[own], at, exact, ids[of][of_row], keep
            )
    return best, best_ids


def _merged(best, best_ids, at, scores, ids, keep):
    """The `keep` best of the lists so far and new (query, score, id) entries."""
    n = len(best)
    query = np.concatenate([np.repeat(np.arange(n), keep), at])
    score = np.concatenate([best.ravel(), scores])
    number = np.concatenate([best_ids.ravel(), ids])
    order = np.lexsort((number, -score, query))
    first = np.searchsorted(query[order], np.arange(n))
    chosen = order[first[:, None] + np.arange(keep)]
    return score[chosen], number[chosen]


def _tile(queries: pa.Table, rows: pa.Table, keep: int) -> pa.Table:
    found, ids = [], []
    if queries.num_rows and rows.num_rows:
        best, best_ids = nearest_in_tile(
            matrix(queries["v"]), matrix(rows["v"]), rows["vec_id"].to_numpy(), keep
        )
        for one, own in zip(best, best_ids):
            n = int(np.isfinite(one).sum())
            found.append(one[:n].tolist())
            ids.append(own[:n].tolist())
    else:
        queries = queries.slice(0, 0)
    return pa.table(
        {
            "vec_id": queries["vec_id"],
            "code": queries["code"],
            "times": queries["times"],
            "block": queries["c_block"],
            "ids": pa.array(ids, pa.list_(pa.int64())),
            "scores": pa.array(found, pa.list_(pa.float64())),
        }
    )


def _combined(lists: pa.Table, keep: int) -> pa.Table:
    """One list per query with the `keep` best entries of its lists."""
    own: dict[tuple, list] = {}
    for r in lists.drop_columns("part").to_pylist():
        own.setdefault((r["vec_id"], r["code"]), []).append(r)
    best = []
    for parts in own.values():
        merged = heapq.merge(*([(-s, i) for s, i in zip(r["scores"], r["ids"])] for r in parts))
        top = list(islice(merged, keep))
        best.append(parts[0] | {"ids": [i for _, i in top], "scores": [-s for s, _ in top]})
    return pa.Table.from_pylist(best, lists.drop_columns("part").schema)


def _merge(lists: pa.Table, k: int) -> pa.Table:
    """Merge the sorted lists of each query by a heap and take out the query's own row."""
    own = {(r["vec_id"], r["code"]): [] for r in lists.select(["vec_id", "code"]).to_pylist()}
    for r in lists.to_pylist():
        own[r["vec_id"], r["code"]].append(
            (r["times"], r["self"], [(-s, i) for s, i in zip(r["scores"], r["ids"])])
        )
    out: dict[str, list] = {c.split()[0]: [] for c in FOUND.split(", ")}
    for (query, _), parts in own.items():
        times, itself, _ = parts[0]
        merged = list(islice(heapq.merge(*(p[2] for p in parts)), k + 1))
        mine = [n for n, (s, i) in enumerate(merged) if i == query and -s == itself]
        if mine:
            del merged[mine[0]]
        for rank, (score, number) in enumerate(merged[:k], start=1):
            for name, value in zip(out, (query, times, rank, number, -score)):
                out[name].append(value)
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64())
    return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds)})


def search(
    vectors: DataFrame,
    is_query: F.Column,
    cfg: SearchConfig | None = None,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: for rows with `is_query`, the k rows of largest inner product.

    `is_query` is an expression on vec_id. A query's own row is no candidate, but a further
    row with its id is. Rows with a NULL id and vectors that are NULL, empty, zero or hold NULL
    or non-finite components take no part; vectors meet those of their own length only.
    A query row that is repeated has its list repeated. Ties go to the smaller vec_id; a product
    beyond the range of a double is left out. An empty table gives no rows; other columns are not
    looked at.
    """
    cfg = cfg or SearchConfig()
    keep, k = cfg.k + 1, cfg.k
    rows = usable(vectors, id_column, vector_column)
    n_rows, n_queries = rows.agg(F.count("*"), F.count_if(is_query)).first()
    row_blocks = max(1, -(-n_rows // cfg.candidate_block))
    query_blocks = max(1, -(-n_queries // cfg.query_block))
    queries = (
        rows.where(is_query)
        .groupBy("vec_id", "v")
        .agg(F.count("*").alias("times"))
        .withColumn("code", F.xxhash64("v"))
        .withColumn("dim", F.size("v"))
    )

    def dealt(df: DataFrame, mine: str, blocks: int, other: str, times: int) -> DataFrame:
        block = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias(mine)
        repeat = F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias(other)
        return df.select("*", block, repeat)

    left = dealt(queries, "q_block", query_blocks, "c_block", row_blocks)
    # Columns of its own, since Spark confuses the sides of a cogroup that share columns.
    candidates = rows.select(*(F.col(c).alias(c) for c in ("vec_id", "v")), F.size("v").alias("dim"))
    right = dealt(candidates, "c_block", row_blocks, "q_block", query_blocks)
    tile = ("dim", "q_block", "c_block")
    lists = (
        left.groupBy(*tile)
        .cogroup(right.groupBy(*tile))
        .applyInArrow(lambda a, b: _tile(a, b, keep), LISTS)
    )
    merges = max(1, -(-n_queries // cfg.merge_queries))
    part = F.pmod(F.xxhash64("vec_id", "code"), F.lit(merges)).alias("part")
    blocks = row_blocks
    while blocks > cfg.merge_blocks:
        group = F.expr(f"cast(block div {cfg.merge_blocks} AS int) AS block")
        lists = (
            lists.select(part, "vec_id", "code", "times", group, "ids", "scores")
            .groupBy("part", "block")
            .applyInArrow(lambda t: _combined(t, keep), LISTS)
        )
        blocks = -(-blocks // cfg.merge_blocks)
    itself = queries.select("vec_id", "code", "v")
    # A query's score with itself, summed as the tiles sum it.
    selves = itself.mapInArrow(_selves, "vec_id long, code long, self double")
    found = (
        lists.join(selves, ["vec_id", "code"])
        .withColumn("part", part)
        .groupBy("part")
        .applyInArrow(lambda t: _merge(t, k), FOUND)
    )
    return found.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select(
        "query_id", "rank", "vec_id", "score"
    )


def _selves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, ids, scores = batch.column("code"), batch.column("vec_id"), []
        for _, own in groupby(range(batch.num_rows), key=lambda i: len(batch.column("v")[i])):
            own = list(own)
            x = matrix(batch.column("v").slice(own[0], len(own)))
            scores += (x * x).sum(axis=1).tolist()
        yield pa.RecordBatch.from_arrays(
            [ids, codes, pa.array(scores, pa.float64())], names=["vec_id", "code", "self"]
        )
