"""Best-fit packing of documents into token sequences, with certified bin counts.

Documents become pieces of at most one sequence. Pieces that fill a sequence are one; the
others are dealt to groups that one task holds, each packed by best-fit decreasing. Lower
bounds from dual-feasible functions certify a group's number of sequences. Groups above
their bound exchange the documents of their unfilled sequences and pack these again, in
ever fewer groups, until all is certified, one group is left, or two rounds in a row gain nothing.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from firmlens.llm.common import mapped
from firmlens.sources.sinks import materialize, release


@dataclass(frozen=True)
class PackConfig:
    """capacity: tokens of a sequence. end_id closes each document. group_pieces: pieces of a group.

    growth: times that number that a group may hold in a later round. shrink: share of the groups
    that a round keeps at most.
    """

    capacity: int = 1024
    end_id: int = 2
    tokenizer: str = field(default_factory=lambda: public_tokenizers.path("byte_bpe_50k.json"))
    group_pieces: int = 100_000
    growth: int = 8
    shrink: float = 0.75


# Tokens

#: Segments whose ids a worker keeps, and as many of those that it used before them.
KEPT_SEGMENTS = 400_000
_ODD = re.compile(r" (?:\s|$)")
_CUT = re.compile(r" (?=\S)")


class Encoder:
    """Token ids of whole texts as little-endian bytes, by segments that repeat a lot.

    The byte-level pre-tokenizer starts a new piece at every space that stands before a
    visible character, and nothing is merged across pieces. So the ids of a text are those
    of its segments between such spaces, and a segment is encoded once. New segments are
    encoded together: each opens with a token that begins with a space.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        #: Whether a token begins with a space.
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self.kept: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            if not text:
                yield b""
            elif any(s in text for s in self.specials):
                yield self._ids([text])[0]
            else:
                first, *rest = (_CUT.split if _ODD.search(text) else _spaces)(text)
                yield b"".join([*self._ids([first]), *self._spaced(rest)])

    def _spaced(self, parts: list[str]) -> Iterator[bytes]:
        new = set(parts).difference(self.kept)
        if not new:
            return map(self.kept.__getitem__, parts)
        known = self.kept
        if len(known) + len(new) > KEPT_SEGMENTS:
            known = {p: known[p] for p in set(parts).difference(new)}
            self.kept, self.before = known, self.kept
        again = [p for p in new if p in self.before]
        known.update(zip(again, map(self.before.__getitem__, again)))
        new = list(new.difference(again))
        if new:
            known.update(zip(new, self._new(new)))
        if len(known) > KEPT_SEGMENTS:  # of one very long text
            self.kept = {}
        return map(known.__getitem__, parts)

    def _new(self, parts: list[str]) -> list[bytes]:
        ids = self._ids([" " + " ".join(parts)])[0]
        at = np.flatnonzero(self.opens[np.frombuffer(ids, "<u4")])
        if len(at) != len(parts):  # some hold further spaces
            return self._ids([" " + p for p in parts])
        ends = [*(4 * at).tolist(), len(ids)]
        return [ids[a:b] for a, b in zip(ends, ends[1:])]

    def _ids(self, segments: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(segments, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]


def _spaces(text: str) -> list[str]:
    return text.split(" ")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(
    docs: DataFrame,
    cfg: PackConfig,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids, if asked for).

    A document that fits is one piece. Of a longer one the first piece takes what is left
    over, so that all others fill a sequence. NULL text counts as empty: only the end id.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    schema = schema.replace("long", docs.schema[id_column].dataType.simpleString(), 1)
    end = np.array([cfg.end_id], "<u4").tobytes()

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        source, columns = [], {k: [] for k in ("piece", "start", "length", "ids_crc32", "ids")}
        for at, ids in enumerate(encoder(cfg.tokenizer).encode(texts)):
            ids = memoryview(ids + end)
            n = len(ids) // 4
            cuts = [0, *range(n % cfg.capacity or cfg.capacity, n + 1, cfg.capacity)]
            for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                own = ids[4 * a : 4 * b]
                source.append(at)
                for k, v in zip(columns, (piece, a, b - a, zlib.crc32(own))):
                    columns[k].append(v)
                if with_ids:
                    columns["ids"].append(bytes(own))
        yield columns | {"doc_id": batch.column(0).take(pa.array(source, pa.int64()))}

    out = schema + (", ids binary" if with_ids else "")
    return mapped(docs.select(id_column, text_column), out, work, rows=256)


# Packing


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, by best-fit decreasing; ties go to the earlier piece."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free space
    has, made = 0, 0  # has: bit r is set if some bin has r free
    for at in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[at])
        fits = has >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            bin_ = free[room].pop()
            if not free[room]:
                has ^= 1 << room
        else:
            room, bin_, made = capacity, made, made + 1
        bins[at], offsets[at] = bin_, capacity - room
        room -= size
        free[room].append(bin_)
        has |= 1 << room
    return bins, offsets


def lower_bound(counts: np.ndarray) -> int:
    """Bins that pieces need at least; counts[x] pieces have length x, the last index is the capacity.

    Two families of dual-feasible functions, each of which maps any packing to one of no
    larger size: large pieces count as whole bins while small ones are left out, and the
    rounding of Fekete and Schepers (2001).
    """
    capacity = len(counts) - 1
    x = np.arange(capacity + 1)
    count_from = np.cumsum(counts[::-1])[::-1]
    size_from = np.cumsum((counts * x)[::-1])[::-1]
    best = 0
    for cut in range(capacity // 2 + 1):  # lengths under `cut` count 0, above capacity - cut a bin
        above = capacity - cut + 1
        whole = int(count_from[above]) if above <= capacity else 0
        inner = int(size_from[cut]) - (int(size_from[above]) if above <= capacity else 0)
        best = max(best, whole - (-inner // capacity))
    for k in range(1, 33):
        exact = (k + 1) * x % capacity == 0
        # k times the value of the function, in units of a bin's capacity
        value = np.where(exact, k * x, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def _pack_group(group: pa.Table, capacity: int) -> pa.Table:
    group = group.sort_by([("length", "descending"), ("id", "ascending")])
    lengths = group.column("length").to_numpy()
    bins, offsets = best_fit(lengths, capacity)
    fill = np.bincount(bins, weights=lengths).astype(np.int64)
    bound = lower_bound(np.bincount(lengths, minlength=capacity + 1))
    n = len(lengths)
    return pa.table(
        {
            "id": group.column("id"),
            "length": lengths,
            "part": group.column("part"),
            "bin": bins,
            "place": offsets,
            "fill": fill[bins],
            "gap": np.full(n, len(fill) - bound),
        }
    )


PLACED = "id long, length long, part long, bin long, place long, fill long, gap long"


def _pack_round(items: DataFrame, parts: int, turn: int, cfg: PackConfig) -> DataFrame:
    capacity = cfg.capacity
    dealt = items.select("id", "length", F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(parts)).alias("part"))
    packed = dealt.groupBy("part").applyInArrow(lambda t: _pack_group(t, capacity), PLACED)
    return materialize(packed.withColumn("turn", F.lit(turn)), f"packed{turn}")


def _bins(placed: DataFrame) -> int:
    return placed.select("part", "bin", "turn").distinct().count()


def pack(
    docs: DataFrame,
    cfg: PackConfig | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row is packed, repeated ones too; NULL and empty texts are the end id alone. An
    empty table gives no rows. Other columns are not looked at.
    """
    cfg = cfg or PackConfig()
    cut = pieces(docs, cfg, id_column, text_column, with_ids)
    cut = materialize(cut.withColumn("id", F.monotonically_increasing_id()), "pieces")
    placed = place(cut.where(F.col("length") < cfg.capacity).select("id", "length"), cfg)
    number = F.expr("turn * 72057594037927936 + part * 4294967296 + bin")
    placed = placed.select("id", number.alias("sequence_id"), F.col("place").alias("offset"))
    return (
        cut.join(placed, "id", "left")
        .withColumn("sequence_id", F.coalesce("sequence_id", -1 - F.col("id")))
        .withColumn("offset", F.coalesce("offset", F.lit(0)).cast("long"))
        .drop("id")
    )


def place(items: DataFrame, cfg: PackConfig) -> DataFrame:
    """(id, length) pieces below the capacity, with part, bin, place and turn.

    A group's number of pieces is bounded in every round, so the last rounds may have several
    groups; they end when two deals in a row save no sequence.
    """
    parts = max(1, -(-items.count() // cfg.group_pieces))
    placed, done = _pack_round(items, parts, 0, cfg), []
    turn = idle = 0
    while parts > 1 and idle < 2:
        # Only unfilled sequences of groups above their bound can be saved.
        pool = placed.where(f"gap > 0 AND fill < {cfg.capacity}")
        n = pool.count()
        if not n:
            break
        turn += 1
        fewer = min(-(-n // cfg.group_pieces), int(np.ceil(parts * cfg.shrink)))
        parts = max(1, -(-n // (cfg.growth * cfg.group_pieces)), fewer)
        again = _pack_round(pool, parts, turn, cfg)
        if _bins(again) < _bins(pool):
            done.append(placed.where(f"NOT (gap > 0 AND fill < {cfg.capacity})"))
            placed, idle = again, 0
        else:
            release(again)
            idle += 1
    for rest in done:
        placed = placed.unionByName(rest)
    return placed


def certificate(packed: DataFrame, cfg: PackConfig | None = None) -> DataFrame:
    """One row: sequences of a packing, and how many its pieces need at least, whatever the packing.

    The bound holds for all pieces together: it looks at their lengths only, counted in one pass, of which
    there are at most as many as tokens in a sequence.
    """
    cfg = cfg or PackConfig()
    counts = np.zeros(cfg.capacity + 1, np.int64)
    for row in packed.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    return packed.agg(F.count_distinct("sequence_id").alias("sequences")).withColumn(
        "bound", F.lit(lower_bound(counts)).cast("long")
    )


def sequences(packed: DataFrame) -> DataFrame:
    """Per sequence: sequence_id and its ids as binary, of pieces packed with their ids.

    A group here is one sequence, so that it has at most `capacity` tokens.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
