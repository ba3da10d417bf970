"""Prefix trie of conversations, with subtree totals by the Euler-tour technique.

Rebuilt conversations that share their first d turns meet in one node. Each node has an enter
and an exit arc; the arcs form one list, the tour. List ranking by rulers gives sums along
the tour at every arc, and a subtree's leaves and savings are the difference of the sums at its
two arcs.

Turns travel as digests, not as texts. Where rows need their neighbours or the row of their group (turns of
a conversation, children of a node), they are numbered by a range sort and split into runs of
numbers, so that neither a very long conversation nor a node with very many children is in
one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firmlens.sources.sinks import materialize, release


@dataclass(frozen=True)
class TrieConfig:
    """stride, heads: conversation c starts like c - c % stride, by its first crc32(c) % heads turns.

    run: numbered rows that are handled together. gap: mean distance of rulers in a list. rest: length of a
    list that the driver ranks, as four numbers an arc.
    """

    stride: int = 100
    heads: int = 6
    run: int = 1024
    gap: int = 16
    rest: int = 20_000


# Numbering


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """`df`, written, with `number` from 0 without gaps in this order; all of `order` ascending.

    Equal rows are spread by a last key. Only the number of rows of each partition reaches the driver.
    """
    keys = [*order, "_tie"]
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys)
    ranged = ranged.sortWithinPartitions(*keys).drop("_tie")
    ranged = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.max("_at").alias("_last")).orderBy("_part")
    first, starts = 0, []
    for row in sizes.collect():
        starts.append((row["_part"], first))
        first += (row["_last"] & (2**33 - 1)) + 1
    spark = df.sparkSession
    starts = spark.createDataFrame(starts, "_part long, _start long")
    done = ranged.withColumn("_part", part).join(F.broadcast(starts), "_part")  # one row a partition
    number = F.col("_start") + F.col("_at").bitwiseAND(2**33 - 1)
    done = done.withColumn("number", number).drop("_part", "_start", "_at")
    done._written_path = ranged._written_path
    return done


def runs(first: str, last: str, cfg: TrieConfig) -> F.Column:
    """The runs that numbers from `first` to `last` fall in, one row each."""
    return F.expr(f"explode(sequence({first} div {cfg.run}, {last} div {cfg.run}))")


# Conversations


def turns_in_order(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, digest, size, number): turns as digests, numbered by conversation and turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.unhex(F.md5(whole)).alias("digest"),
        F.length(text).cast("long").alias("size"),
    )
    return numbered(rows, "conv_id", "turn", "digest")


def hashed(place: str) -> list[F.Column]:
    """128 bits of a turn at a place, as two longs. Those of a prefix are the XOR of its turns'."""
    at = F.col(place).cast("long")
    return [
        F.xxhash64("digest", at).alias("a"),
        F.xxhash64(at, F.lit("second"), "digest").alias("b"),
    ]


def rebuilt(turns: DataFrame, cfg: TrieConfig) -> tuple[DataFrame, DataFrame]:
    """Prefixes of rebuilt conversations, and the conversations.

    Prefixes: (conv_id, depth, a, b, up_a, up_b, size), where a and b name the prefix and
    up_a and up_b the one before it. Conversations: (conv_id, length, a, b), of the whole one.
    """
    convs = turns.groupBy("conv_id").agg(
        F.min("number").alias("first"), F.max("number").alias("last"), F.count("*").alias("own")
    )
    head = F.crc32(F.col("conv_id").cast("string")) % cfg.heads
    base = F.col("conv_id") - F.col("conv_id") % cfg.stride
    convs = written = materialize(convs.withColumns({"head": head, "base": base}), "conversations")
    pieces = convs.select("conv_id", "first", "head", runs("first", "last", cfg).alias("run"))
    turns = turns.withColumn("run", F.expr(f"number div {cfg.run}"))
    placed = turns.join(pieces, ["conv_id", "run"]).withColumn("place", F.expr("number - first + 1"))
    placed = materialize(placed.select("conv_id", "run", "head", "place", "digest", "size"), "placed")

    # The prefixes that other conversations start with: at most heads - 1 turns of each base.
    opening = placed.where(f"conv_id % {cfg.stride} = 0 AND place < {cfg.heads}")
    opening = opening.select("conv_id", "place", "size", *hashed("place")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "size", "a", "b"))).alias("turns")
    )
    opening = opening.select(F.col("conv_id").alias("base"), "turns")
    convs = convs.join(opening, "base", "left").withColumn(
        "turns", F.expr("slice(coalesce(turns, array()), 1, cast(head AS int))")
    )
    xor = "aggregate(slice(turns, 1, {n}), 0L, (x, t) -> x ^ t.{c})"
    convs = convs.select(
        "conv_id",
        "own",
        "head",
        "turns",
        F.size("turns").cast("long").alias("shared"),
        *(F.expr(xor.format(n="size(turns)", c=c)).alias(f"start_{c}") for c in "ab"),
        F.col("first"),
        F.col("last"),
    )
    convs = materialize(convs, "openings")
    release(written)
    shared = convs.select("conv_id", "turns", F.posexplode("turns").alias("_at", "t")).select(
        "conv_id",
        F.expr("_at + 1L").alias("depth"),
        *(F.expr(xor.format(n="_at + 1", c=c)).alias(c) for c in "ab"),
        *(F.expr(xor.format(n="_at", c=c)).alias(f"up_{c}") for c in "ab"),
        F.col("t.size").alias("size"),
    )

    # Own turns after the head: XOR inside a run, and of the runs before it.
    info = convs.where("own > head").select(
        "conv_id", "shared", "start_a", "start_b", runs("first", "last", cfg).alias("run")
    )
    own = placed.where("place > head").join(info, ["conv_id", "run"])
    own = own.withColumn("depth", F.expr("shared + place - head"))
    own = own.select("conv_id", "run", "depth", "size", "start_a", "start_b", *hashed("depth"))
    inner = Window.partitionBy("conv_id", "run").orderBy("depth")
    own = own.withColumns({f"in_{c}": F.expr(f"bit_xor({c})").over(inner) for c in "ab"})
    own = materialize(own, "own_turns")
    of_runs = own.groupBy("conv_id", "run").agg(*(F.expr(f"bit_xor({c})").alias(f"run_{c}") for c in "ab"))
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    of_runs = of_runs.select(
        "conv_id",
        "run",
        *(F.coalesce(F.expr(f"bit_xor(run_{c})").over(before), F.lit(0)).alias(f"before_{c}") for c in "ab"),
    )
    summed = own.join(of_runs, ["conv_id", "run"]).select(
        "conv_id",
        "depth",
        *(F.expr(f"start_{c} ^ before_{c} ^ in_{c}").alias(c) for c in "ab"),
        *(F.expr(f"start_{c} ^ before_{c} ^ in_{c} ^ {c}").alias(f"up_{c}") for c in "ab"),
        "size",
    )
    prefixes = materialize(shared.unionByName(summed), "prefixes")
    release(placed, turns, own)
    length = F.expr("shared + greatest(own - head, 0)")
    return prefixes, convs.select("conv_id", length.alias("length"))


# Digests of the conversations that end at a node


def end_digests(ends: DataFrame, cfg: TrieConfig) -> DataFrame:
    """(depth, a, b, ends_sha256) of (depth, a, b, conv_id) rows.

    SHA-256 reads its input in order, so one task goes over the ids of a node; they come as
    joined pieces of a bounded number of ids, and are read as a stream.
    """
    keys = ["depth", "a", "b"]
    ordered = ends.repartitionByRange(*keys, "conv_id").sortWithinPartitions(*keys, "conv_id")
    ordered = ordered.withColumn("piece", F.expr(f"monotonically_increasing_id() div {cfg.run}"))
    joined = "array_join(transform(sort_array(collect_list(conv_id)), c -> cast(c AS string)), ',')"
    pieces = ordered.groupBy(*keys, "piece").agg(F.expr(joined).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            out = []
            for *key, ids in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if key == at:
                    digest.update(b",")
                else:
                    if at is not None:
                        out.append((*at, digest.hexdigest()))
                    at, digest = key, hashlib.sha256()
                digest.update(ids.encode())
            yield _batch(out)
        if at is not None:
            yield _batch([(*at, digest.hexdigest())])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, names=[*keys, "ends_sha256"])

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    in_order = pieces.repartition(*keys).sortWithinPartitions(*keys, "piece").select(*keys, "ids")
    return in_order.mapInArrow(run, "depth long, a long, b long, ends_sha256 string")


# List ranking


def list_sums(arcs: DataFrame, cfg: TrieConfig, names: list[str]) -> DataFrame:
    """(arc, *names): for each element of a list the sums of `names` from it to the end.

    `arcs`: (arc, next, *names), next -1 at the end. One in `gap` elements is a ruler, chosen by
    hash. Pointers double until each one points at a ruler, which takes about log2(gap log n)
    rounds; the rulers are a shorter list of the same kind. A pointer is the only one to its
    target until it reaches a ruler, so no join has a hot key.
    """
    levels = []
    while True:
        n = arcs.count()
        if n <= cfg.rest:
            done = _ranked(arcs, names)
            break
        arcs = _to_rulers(arcs, cfg, names, len(levels))
        levels.append(arcs)
        arcs = arcs.where("ruler").select("arc", "next", *names)
    for level in reversed(levels):
        ahead = done.select(F.col("arc").alias("next"), *(F.col(c).alias(f"_{c}") for c in names))
        rest = level.where("NOT ruler").join(ahead, "next", "left")
        rest = rest.select("arc", *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in names))
        done = materialize(done.unionByName(rest), "list_sums")
        release(level)
    return done


def _to_rulers(arcs: DataFrame, cfg: TrieConfig, names: list[str], level: int) -> DataFrame:
    """(arc, next, *names, ruler): each element's next ruler (or -1), and the sums up to it."""

    def ruler(c: str) -> F.Column:
        return F.pmod(F.xxhash64(c, F.lit(level)), F.lit(cfg.gap)) == 0

    state = arcs.select("arc", "next", *names, ruler("arc").alias("ruler"))
    state = state.withColumn("there", (F.col("next") == -1) | ruler("next"))
    state = materialize(state, "pointers")
    while not state.where("NOT there").isEmpty():
        ahead = state.select(
            F.col("arc").alias("next"),
            F.col("next").alias("_next"),
            F.col("there").alias("_there"),
            *(F.col(c).alias(f"_{c}") for c in names),
        )
        moved = state.where("NOT there").join(ahead, "next").select(
            "arc",
            F.col("_next").alias("next"),
            *((F.col(c) + F.col(f"_{c}")).alias(c) for c in names),
            "ruler",
            F.col("_there").alias("there"),
        )
        before, state = state, materialize(state.where("there").unionByName(moved), "pointers")
        release(before)
    return state


def _ranked(arcs: DataFrame, names: list[str]) -> DataFrame:
    """The sums of a list of at most `rest` elements, by doubling in memory."""
    table = arcs.select("arc", "next", *names).toArrow()
    arc, after = (table[c].to_numpy() for c in ("arc", "next"))
    order = np.argsort(arc)
    n = len(arc)
    jump = np.full(n + 1, n)
    inside = after != -1
    jump[:n][inside] = order[np.searchsorted(arc, after[inside], sorter=order)]
    sums = [np.append(table[c].to_numpy(), 0) for c in names]
    while (jump[:n] != n).any():
        sums = [s + s[jump] for s in sums]
        jump = jump[jump]
    columns = dict(zip(["arc", *names], [arc, *(s[:n] for s in sums)]))
    schema = ", ".join(f"{c} long" for c in columns)
    return arcs.sparkSession.createDataFrame(pa.table(columns), schema)


# The trie


def trie(
    conversations: DataFrame,
    cfg: TrieConfig | None = None,
    conv_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    A conversation's turns are ordered by turn, NULL first; turns with the same number by
    a digest of role and text, so that reruns agree, and repeated rows are turns of their own.
    NULL role or text counts as empty, texts are taken whole. Rows with a NULL conv_id belong to no
    conversation and are left out. A prefix is told apart from others by 128 bits of hashes
    of its turns and their places. An empty table has no nodes, not even the root. Other columns
    are not looked at. The result reads tables written to the shared folder.
    """
    cfg = cfg or TrieConfig()
    turns = turns_in_order(conversations, conv_column, turn_column, role_column, text_column)
    prefixes, convs = rebuilt(turns, cfg)
    inner = prefixes.groupBy("depth", "a", "b").agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        *(F.first(c).alias(c) for c in ("up_a", "up_b", "size")),
    )
    # The root is the parent of nothing at depth 0 and comes first.
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select("*", *(zero.alias(c) for c in ("depth", "a", "b", "up_a", "up_b", "size")))
    nodes = found = numbered(inner.unionByName(root), "depth", "up_a", "up_b", "conv_id")

    # Children of a node have consecutive numbers.
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), "up_a", "up_b").agg(
        F.min("number").alias("first"), F.max("number").alias("last")
    )
    kids = kids.withColumnsRenamed({"up_a": "a", "up_b": "b"})
    nodes = nodes.join(kids, ["depth", "a", "b"], "left")
    nodes = materialize(nodes.withColumn("n_children", F.expr("coalesce(last - first + 1, 0L)")), "nodes")
    parents = nodes.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"),
        F.col("a").alias("up_a"),
        F.col("b").alias("up_b"),
        F.col("number").alias("parent"),
        F.col("conv_id").alias("parent_conv_id"),
        F.col("last").alias("last_sibling"),
        runs("first", "last", cfg).alias("run"),
    )
    placed = nodes.withColumn("run", F.expr(f"number div {cfg.run}"))
    placed = placed.join(parents, ["depth", "up_a", "up_b", "run"], "left")
    placed = materialize(placed.drop("run", "up_a", "up_b"), "placed_nodes")
    release(found, nodes)

    # Arc 2n enters node n, arc 2n + 1 leaves it.
    enter = placed.selectExpr(
        "2 * number AS arc",
        "coalesce(2 * first, 2 * number + 1) AS next",
        "IF(n_children = 0, 1L, 0L) AS leaves",
        "(n_convs - 1) * size AS saved",
    )
    leave = placed.selectExpr(
        "2 * number + 1 AS arc",
        """CASE WHEN parent IS NULL THEN -1L WHEN number = last_sibling THEN 2 * parent + 1
          ELSE 2 * (number + 1) END AS next""",
        "0L AS leaves",
        "0L AS saved",
    )
    sums = list_sums(enter.unionByName(leave), cfg, ["leaves", "saved"])
    # What lies between a node's arcs: the sums from its enter arc on, less those from its exit arc on.
    totals = sums.groupBy(F.expr("arc div 2").alias("number")).agg(
        F.sum(F.expr("IF(arc % 2 = 0, leaves, -leaves)")).alias("n_leaves"),
        F.sum(F.expr("IF(arc % 2 = 0, saved, -saved)")).alias("saved_tokens"),
    )

    whole = convs.withColumnRenamed("length", "depth")
    ends = prefixes.join(whole, ["conv_id", "depth"], "left_semi").select("depth", "a", "b", "conv_id")
    no_turns = whole.where("depth = 0").select("depth", zero.alias("a"), zero.alias("b"), "conv_id")
    digests = end_digests(ends.unionByName(no_turns), cfg)
    nothing = F.lit(hashlib.sha256().hexdigest())
    return (
        placed.join(totals, "number")
        .join(digests, ["depth", "a", "b"], "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
        )
    )
