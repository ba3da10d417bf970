"""MinHash near-duplicates by a multi-index Hamming join.

A document is the set of its word shingles, and its signature the minimum of each of 80
hash functions, cut to 16 bits. Signatures are split into chunks of five positions. Two that
differ in at most `max_distance` positions differ in at most one position of some chunk
(pigeonhole), so that every way to leave out one position of every chunk gives a key, and
such pairs share one. Pairs that share a key are confirmed on their full sets.

Only components are wanted, so a key's members are compared with one of them first, the one
that shares its keys with most others. What then still lies in different components is
compared in tiles of sets, except where the sizes or the overlaps with that pivot rule a
link out: outside the pivot, two sets share at most what the one has there that has less.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.common import components, fresh, mapped, word_hashes, words
from firmlens.sources.sinks import materialize, release


@dataclass(frozen=True)
class JoinConfig:
    """shingle: words. percent: least Jaccard similarity. positions and chunk lay out the signature.

    max_distance is the largest number of differing positions that keys are guaranteed to
    catch: 31 of 80. At a similarity of 0.8 a pair is further apart once in 30,000.
    """

    shingle: int = 5
    percent: int = 80
    positions: int = 80
    chunk: int = 5
    seed: int = 11
    #: Shingles that meet in one task of the confirmation.
    task_shingles: int = 1_000_000

    @property
    def max_distance(self) -> int:
        return 2 * (self.positions // self.chunk) - 1


#: What a class counts for besides its shingles, so that tiles of tiny sets stay small too.
CLASS_WEIGHT = 500

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a shorter text is one shingle, a blank one none."""
    own = word_hashes(words(text))
    if not len(own):
        return own
    n = max(len(own) - size + 1, 1)
    out = np.full(n, len(own) if len(own) < size else size, np.uint64)
    for step in range(min(size, len(own))):
        out = _mixed(out * _MIX + own[step : step + n])
    return np.unique(out)


class Signer:
    def __init__(self, cfg: JoinConfig):
        rng = np.random.default_rng(cfg.seed)
        self.cfg = cfg
        self.factor = rng.integers(0, 2**32, cfg.positions, dtype=np.uint32) | np.uint32(1)
        self.offset = rng.integers(0, 2**32, cfg.positions, dtype=np.uint32)
        chunks = cfg.positions // cfg.chunk
        self.salt = rng.integers(0, 2**63, (chunks, cfg.chunk)).astype(np.uint64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(self.cfg.positions, 2**32 - 1, np.uint32)
        short = (shingles >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(short), 2048):
            part = short[None, at : at + 2048] * self.factor[:, None] + self.offset[:, None]
            np.minimum(low, part.min(axis=1), out=low)
        return (_mixed(low.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint64)

    def keys(self, signature: np.ndarray) -> np.ndarray:
        """One key per position: the other positions of its chunk."""
        chunk = signature.reshape(-1, self.cfg.chunk)
        out = np.empty(chunk.shape, np.uint64)
        for left_out in range(self.cfg.chunk):
            key = self.salt[:, left_out].copy()
            for at in range(self.cfg.chunk):
                if at != left_out:
                    key = _mixed(key * _MIX + chunk[:, at])
            out[:, left_out] = key
        return out.ravel().view(np.int64)


def signed(docs: DataFrame, cfg: JoinConfig, id_column: str, text_column: str) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest of the set, and its keys."""
    signer = Signer(cfg)

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        sizes, digests, keys = [], [], []
        for text in batch.column(2).to_pylist():
            own = shingle_set(text, cfg.shingle)
            sizes.append(len(own))
            digests.append(xxhash.xxh3_128_digest(own.tobytes()))
            keys.append(signer.keys(signer.signature(own)) if len(own) else None)
        yield {
            "doc_id": batch.column(0),
            "text_hash": batch.column(1),
            "n_shingles": sizes,
            "digest": digests,
            "keys": keys,
        }

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash long, n_shingles long, digest binary, keys array<long>"
    rows = docs.select(F.col(id_column), F.xxhash64(text_column), F.col(text_column))
    return mapped(rows, schema, work, rows=256)


def near_duplicates(
    docs: DataFrame,
    cfg: JoinConfig | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, component_id, kept.

    component_id is the smallest doc_id reachable by links of the similarity, kept says that it
    is the row's own. Texts without words have no shingles and no links. Every row is there,
    repeated ones too; a NULL id is never the smallest, but its row links like any other. An
    empty table gives no rows; other columns are not looked at. text_hash is xxhash64(text).
    """
    found = _grouped_rows(docs, cfg or JoinConfig(), id_column, text_column)
    return found.withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    ).select("doc_id", "text_hash", "n_shingles", "component_id", "kept")


def _grouped_rows(docs: DataFrame, cfg: JoinConfig, id_column: str, text_column: str) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and group, which no id is needed for.

    group is the number of a component, and NULL where a text has no words.
    """
    rows = materialize(signed(docs, cfg, id_column, text_column), "signed")
    # Documents of equal sets are one class, so that a group of copies is compared once.
    classes = materialize(
        rows.where("n_shingles > 0")
        .groupBy("digest")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("row"),
            F.first("n_shingles").alias("n"),
            F.min("keys").alias("keys"),
        )
        .select("digest", "row.doc_id", "row.text_hash", "n", "keys")
        .withColumn("class", F.monotonically_increasing_id()),
        "set_classes",
    )
    entries = classes.select(F.explode("keys").alias("key"), "class", "n")
    shared = entries.groupBy("key").agg(F.count("*").alias("times")).where("times > 1")
    members = materialize(_with_pivots(entries.join(shared, "key")), "key_members")
    sets = materialize(_sets_of(docs, rows, classes, members, cfg, id_column, text_column), "sets")
    together = materialize(members.select("pivot", "class", "n").distinct(), "together")
    release(members)
    first = _confirmed(together.where("class <> pivot").select("pivot", "class"), sets, cfg)
    first = materialize(first, "confirmed")
    links = first.where("linked").selectExpr("pivot AS src", "class AS dst")
    groups = materialize(components(links), "components")
    more = _cross_links(together, first, groups, sets, cfg)
    joined = materialize(links.unionByName(more), "links")
    release(together, sets, groups, first)
    reached = components(joined)
    grouped = (
        classes.select("class", "digest", "doc_id")
        .join(reached, F.col("class") == F.col("node"), "left")
        .withColumn("group", F.coalesce("component", "class"))
    )
    smallest = grouped.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    ids = grouped.select("digest", "group").join(smallest, "group").select(
        "digest", "group", "component_id"
    )
    own = F.expr("IF(n_shingles > 0, component_id, doc_id)")
    return (
        rows.drop("keys")
        .join(ids, "digest", "left")
        .withColumn("component_id", own)
        .select("doc_id", "text_hash", "n_shingles", "component_id", "group")
    )


def _with_pivots(members: DataFrame) -> DataFrame:
    """(key, class, n, pivot): pivot is the member that meets most others over all its keys."""
    members = materialize(members, "shared_keys")
    met = members.groupBy("class").agg(F.sum("times").alias("met"))
    central = F.max(F.struct("met", "class"))
    pivots = members.join(met, "class").groupBy("key").agg(central.alias("pivot"))
    return members.drop("times").join(pivots.selectExpr("key", "pivot.class AS pivot"), "key")


def _sets_of(docs, rows, classes, members, cfg, id_column, text_column) -> DataFrame:
    """(class, n, shingles) of the classes that share a key, from the text of one document each.

    The text is found by the id, which may be NULL, and the hash of one row. Texts of one hash are
    told apart by the digest. Rows that repeat both give one set.
    """
    wanted = members.select("class").distinct().join(classes, "class")
    wanted = wanted.select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "class", "digest"
    )
    texts = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("text"))
    texts = texts.withColumn("_hash", F.xxhash64("text"))
    # With the hash, NULL ids are as many keys as they have texts.
    here = (texts["_hash"] == wanted["_hash"]) & texts["_id"].eqNullSafe(wanted["_id"])
    chosen = texts.join(wanted, here).select("class", "digest", "text")
    often = rows.where("n_shingles > 0").groupBy("doc_id", "text_hash", "digest").count()
    often = often.where("count > 1").select("digest").distinct()

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        own, sizes, sets = [], [], []
        columns = (batch.column(c).to_pylist() for c in range(3))
        for number, digest, text in zip(*columns):
            shingles = shingle_set(text, cfg.shingle)
            raw = shingles.tobytes()
            if xxhash.xxh3_128_digest(raw) == digest:
                own.append(number)
                sizes.append(len(shingles))
                sets.append(raw)
        yield {"class": own, "n": sizes, "shingles": sets}

    schema = "class long, n long, shingles binary"
    if often.isEmpty():
        return mapped(chosen, schema, work, rows=256)
    once = chosen.join(often, "digest", "left_anti").select("class", "digest", "text")
    more = chosen.join(often, "digest", "left_semi").select("class", "digest", "text")
    more = mapped(more, schema, work, rows=256).dropDuplicates(["class"])
    return mapped(once, schema, work, rows=256).unionByName(more)


def _confirmed(pairs: DataFrame, sets: DataFrame, cfg: JoinConfig) -> DataFrame:
    """(pivot, class, overlap, linked) of pairs, from their full sets.

    A pivot's set meets its partners' sets in one task, or in several if they are many: the
    partners of a pivot are split by their number of shingles. A pair whose sizes rule
    a link out is not sent; its overlap is unknown.
    """
    budget = cfg.task_shingles
    sizes = sets.select("class", "n").distinct()
    sized = (
        pairs.join(sizes, "class")
        .join(sizes.selectExpr("class AS pivot", "n AS pivot_n"), "pivot")
        .where(f"100 * least(n, pivot_n) >= {cfg.percent} * greatest(n, pivot_n)")
    )
    sized = materialize(sized, "pairs")
    total = sized.agg(F.sum("n")).first()[0] or 0
    tasks = max(1, -(-2 * total // budget))
    splits = sized.groupBy("pivot").agg(F.expr(f"cast(ceil(sum(n) / {budget}) AS int)").alias("splits"))
    sent = sized.join(splits, "pivot").select(
        "class", "pivot", F.expr("cast(pmod(xxhash64(class), splits) AS int)").alias("split"), F.lit(False).alias("own")
    )
    own = splits.select(
        F.col("pivot").alias("class"), "pivot", F.expr("explode(sequence(0, splits - 1))").alias("split"), F.lit(True).alias("own")
    )
    dealt = (
        sets.join(sent.unionByName(own), "class")
        .withColumn("task", F.pmod(F.xxhash64("pivot", "split"), F.lit(tasks)))
        .select("task", "pivot", "split", "own", "class", "shingles")
    )
    percent = cfg.percent
    return dealt.groupBy("task").applyInArrow(
        lambda t: _compared(t, percent), "pivot long, class long, overlap long, linked boolean"
    )


def _compared(task: pa.Table, percent: int) -> pa.Table:
    own, partners = {}, {}
    where = zip(*(task.column(c).to_pylist() for c in ("pivot", "split", "own", "class")))
    for at, (pivot, split, is_pivot, number) in enumerate(where):
        if is_pivot:
            own[pivot, split] = at
        else:
            partners.setdefault((pivot, split), {})[number] = at
    raw = task.column("shingles").combine_chunks()
    out = {"pivot": [], "class": [], "overlap": [], "linked": []}
    for key, others in partners.items():
        a = np.frombuffer(raw[own[key]].as_buffer(), np.uint64)
        for number, at in others.items():
            b = np.frombuffer(raw[at].as_buffer(), np.uint64)
            place = np.minimum(np.searchsorted(a, b), len(a) - 1)
            both = int((a[place] == b).sum())
            union = len(a) + len(b) - both
            values = (key[0], number, both, 100 * both >= percent * union)
            for name, value in zip(out, values):
                out[name].append(value)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    return pa.table({n: pa.array(v, k) for (n, v), k in zip(out.items(), kinds)})


def _cross_links(
    together: DataFrame, first: DataFrame, groups: DataFrame, sets: DataFrame, cfg: JoinConfig
) -> DataFrame:
    """(src, dst): links between components, among classes that share a pivot.

    Whatever shares a key shares its pivot. Of the classes of one pivot, those outside its
    largest component are compared with all, in tiles of bounded size; a tile returns
    one link for a class and another component, however many there are.
    """
    own = together.join(first.select("pivot", "class", "overlap"), ["pivot", "class"], "left")
    own = own.join(groups.withColumnRenamed("node", "class"), "class", "left").select(
        "pivot",
        "class",
        "n",
        F.coalesce("component", "class").alias("group"),
        F.expr("IF(class = pivot, n, coalesce(overlap, -1L))").alias("inside"),
    )
    weight = F.col("n") + CLASS_WEIGHT
    parts = own.groupBy("pivot", "group").agg(F.count("*").alias("times"), F.sum(weight).alias("part"))
    mixed = parts.groupBy("pivot").agg(
        F.max(F.struct("times", "group", "part")).alias("major"),
        F.sum("part").alias("all"),
        F.count("*").alias("parts"),
    )
    budget = cfg.task_shingles
    mixed = mixed.where("parts > 1").selectExpr(
        "pivot",
        "major.group AS major",
        f"cast(ceil(5 * (all - major.part) / {budget}) AS int) AS a_blocks",
        f"cast(ceil(2 * all / {budget}) AS int) AS b_blocks",
    )
    own = materialize(own.join(mixed, "pivot"), "mixed")
    block = "cast(pmod(xxhash64(class), {0}) AS int) AS {1}"
    every = "explode(sequence(0, {0} - 1)) AS {1}"
    columns = ["pivot", "class", "n", "group", "inside"]
    minor = own.where("group <> major").selectExpr(
        *columns, "true AS minor", block.format("a_blocks", "a"), every.format("b_blocks", "b")
    )
    other = own.selectExpr(
        *columns, "false AS minor", every.format("a_blocks", "a"), block.format("b_blocks", "b")
    )
    dealt = minor.unionByName(other)
    total = dealt.agg(F.sum(weight)).first()[0] or 0
    task = F.pmod(F.xxhash64("pivot", "a", "b"), F.lit(max(1, -(-total // budget))))
    met = dealt.join(sets.select("class", "shingles"), "class").withColumn("task", task)
    percent = cfg.percent
    return met.groupBy("task").applyInArrow(lambda t: _crossed(t, percent), "src long, dst long")


def _crossed(task: pa.Table, percent: int) -> pa.Table:
    raw = task.column("shingles").combine_chunks()
    number, n, group, inside, minor = (
        task.column(c).to_numpy() for c in ("class", "n", "group", "inside", "minor")
    )
    tiles: dict[tuple, list[int]] = {}
    for at, key in enumerate(zip(*(task.column(c).to_pylist() for c in ("pivot", "a", "b")))):
        tiles.setdefault(key, []).append(at)
    links: list[tuple[int, int]] = []
    for rows in tiles.values():
        rows = np.array(rows)
        mine, others = rows[minor[rows]], rows[~minor[rows]]
        # A link needs this share of both sizes as overlap.
        need = percent / (100 + percent) * (n[mine][:, None] + n[others][None, :]) - 1e-6
        extra = np.minimum((n - inside)[mine][:, None], (n - inside)[others][None, :])
        most = np.minimum(inside[mine][:, None], inside[others][None, :]) + extra
        unknown = (inside[mine] < 0)[:, None] | (inside[others] < 0)[None, :]
        may = (np.minimum(n[mine][:, None], n[others][None, :]) >= need) & (unknown | (most >= need))
        may &= group[mine][:, None] != group[others][None, :]
        mine, may = mine[may.any(axis=1)], may[may.any(axis=1)]
        others, may = others[may.any(axis=0)], may[:, may.any(axis=0)]
        if not len(mine):
            continue
        sets = [np.frombuffer(raw[at].as_buffer(), np.uint64) for at in mine]
        universe = np.unique(np.concatenate(sets))
        theirs = [np.frombuffer(raw[at].as_buffer(), np.uint64) for at in others]
        flat = np.concatenate(theirs)
        place = np.minimum(np.searchsorted(universe, flat), len(universe) - 1)
        known = universe[place] == flat
        place, owner = place[known], np.repeat(np.arange(len(others)), list(map(len, theirs)))[known]
        flags = np.zeros(len(universe), bool)
        for at, shingles, allowed in zip(mine, sets, may):
            here = np.searchsorted(universe, shingles)
            flags[here] = True
            both = np.bincount(owner[flags[place]], minlength=len(others))
            flags[here] = False
            linked = allowed & (100 * both >= percent * (n[at] + n[others] - both))
            found = others[linked]
            for one in np.unique(group[found], return_index=True)[1]:
                links.append((int(number[at]), int(number[found[one]])))
    return pa.table(
        {c: pa.array([link[k] for link in links], pa.int64()) for k, c in enumerate(("src", "dst"))}
    )


def keep_one(docs: DataFrame, cfg: JoinConfig | None = None) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each group, the one with the smallest id.

    NULL ids come last, and of one id the text with the smallest hash stays. Rows are found
    again by id and text; where one id repeats that text, one of the rows stays. Texts without
    words all stay.
    """
    found = _grouped_rows(docs, cfg or JoinConfig(), "doc_id", "text")
    found = found.groupBy("group", "doc_id", "text_hash").agg(
        F.max("n_shingles").alias("words"), F.count("*").alias("times")
    )
    found = materialize(found, "group_rows")
    no_id = F.col("doc_id").isNull().alias("no_id")
    first = found.where("words > 0").groupBy("group").agg(
        F.min(F.struct(no_id, "doc_id", "text_hash", "words", "times")).alias("row")
    )
    columns = ["doc_id", "text_hash", "words", "times"]
    blank = found.where("words = 0").select(columns)
    stay = materialize(first.select("row.*").select(columns).unionByName(blank), "kept")
    number, text = fresh(docs, "kept_id"), fresh(docs, "kept_text")
    chosen = stay.select(
        F.col("doc_id").alias(number), F.col("text_hash").alias(text), "words", "times"
    )
    here = docs["doc_id"].eqNullSafe(chosen[number]) & (F.xxhash64(docs["text"]) == chosen[text])
    kept = docs.join(chosen.drop("words", "times"), here, "left_semi")
    if stay.where("times > 1 AND words > 0").isEmpty():
        return kept
    once = chosen.where("times > 1 AND words > 0").drop("words", "times")
    repeated = kept.join(once, here, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(once, here, "left_anti").unionByName(repeated)
