"""Sharding by extendible hashing: a directory of hash prefixes, split only where too large.

A bucket is a prefix of a document's hash bits. Its bytes fall as the prefix grows, so the
shard of a document is its shortest prefix whose bytes fit the limit: what is reached by
splitting oversized buckets one bit at a time. Sums per 12-bit prefix give 12 splits in
one pass; the next 12 bits are looked at only inside buckets that are still too large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firmlens.llm.common import key_bits
from firmlens.sources.sinks import materialize, release

#: Bytes of text a shard may hold.
LIMIT = 64 * 2**20
STEP, DEPTH = 12, 120


def assign_shards(
    docs: DataFrame,
    limit: int = LIMIT,
    id_column: str = "doc_id",
    text_column: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: doc_id, n_bytes, shard (its hash bits), depth, shard_bytes, shard_docs.

    The first 60 bits come from the id. Rows with one id would stay together, so that a
    further 60 bits come from the row's place in the written table; they are used only where
    one id exceeds the limit. A document above the limit is a shard of its own. NULL or empty
    texts have 0 bytes. While everything fits there is one shard, the empty prefix. An empty
    table gives no rows. Other columns are not looked at; those named in `carry` come along in
    the struct `row`.
    """
    row = [F.struct(*carry).alias("row")] if carry else []
    place = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit(2**60 - 1))
    rows = materialize(
        docs.select(
            F.col(id_column).alias("doc_id"),
            F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long").alias("n_bytes"),
            key_bits(id_column).alias("key"),
            place.alias("place"),
            *row,
        ),
        "shard_rows",
    ).withColumn("bits", F.concat(*(F.lpad(F.bin(c), 60, "0") for c in ("key", "place"))))
    levels = []
    for depth in range(STEP, DEPTH + STEP, STEP):
        inside = rows
        if levels:
            opened = levels[-1].where("open").selectExpr(f"bucket AS _b{depth - STEP}")
            inside = rows.join(
                opened, F.expr(f"substring(bits, 1, {depth - STEP}) = _b{depth - STEP}")
            )
        level = materialize(_split(inside, depth, limit), f"shard_level{depth}")
        levels.append(level)
        if depth == DEPTH or level.where("open").isEmpty():
            break
    placed = rows.withColumn("shard", F.lit(None).cast("string"))
    for n, level in enumerate(levels, start=1):
        leaves = level.where("NOT open").selectExpr(f"bucket AS _b{n}", f"leaf AS _l{n}")
        placed = placed.join(leaves, F.expr(f"substring(bits, 1, {n * STEP}) = _b{n}"), "left")
    placed = placed.withColumn("shard", F.coalesce(*(f"_l{n + 1}" for n in range(len(levels)))))
    shards = placed.groupBy("shard").agg(
        F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_docs")
    )
    return (
        placed.drop("key", "place", "bits")
        .join(shards, "shard")
        .selectExpr(
            "doc_id",
            "n_bytes",
            "shard",
            "length(shard) AS depth",
            "shard_bytes",
            "shard_docs",
            *(["row"] if carry else []),
        )
    )


def _split(rows: DataFrame, depth: int, limit: int) -> DataFrame:
    """Per bucket of `depth` bits: its leaf, the shortest prefix that fits, or open."""
    first = depth - STEP
    sums = rows.groupBy(F.substring("bits", 1, depth).alias("bucket")).agg(
        F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs")
    )
    # A root of no bits is tried too; deeper levels start below a bucket known to be too large.
    tried = sums.withColumn("d", F.explode(F.sequence(F.lit(first + (first > 0)), F.lit(depth))))
    prefix = Window.partitionBy("prefix")
    fits = (
        tried.withColumn("prefix", F.expr("substring(bucket, 1, d)"))
        .withColumn("prefix_bytes", F.sum("bytes").over(prefix))
        .withColumn("prefix_docs", F.sum("docs").over(prefix))
        .where(f"prefix_bytes <= {limit} OR prefix_docs = 1 OR d = {DEPTH}")
        .groupBy("bucket")
        .agg(F.min(F.struct("d", "prefix")).alias("leaf"))
    )
    return (
        sums.select("bucket")
        .join(fits, "bucket", "left")
        .selectExpr("bucket", "leaf.prefix AS leaf", "leaf IS NULL AS open")
    )


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, id_column: str = "doc_id") -> None:
    """Write the documents with one folder and one file per shard, under shard=s<bits>.

    A shard fits its byte limit, so that a task holds one shard at most.
    """
    placed = assign_shards(docs, limit, id_column, carry=tuple(docs.columns))
    named = placed.select("row.*", F.concat(F.lit("s"), "shard").alias("shard"))
    named.repartition("shard").write.partitionBy("shard").parquet(path)
