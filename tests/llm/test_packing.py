import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from firmlens.llm import packing
from firmlens.llm.packing import PackConfig

CFG = PackConfig(capacity=16, group_pieces=40)


TOKENIZER = Tokenizer.from_file(CFG.tokenizer)


def plain_ids(text, cfg=CFG):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, cfg.end_id]


def check(packed, texts, cfg):
    """All documents are there token by token, sequences are gapless and within the capacity."""
    by_doc, by_sequence = {}, {}
    for r in packed:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, text in texts.items():
        ids = np.array(plain_ids(text, cfg), "<u4")
        at = 0
        for n, r in enumerate(sorted(by_doc[doc], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert n == 0 or r.length == cfg.capacity
            at += r.length
        assert at == len(ids)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= cfg.capacity
    return len(by_sequence)


def test_documents_come_back_whole(make_docs):
    texts = {i: "word éa " * (i % 13) + "x" * (i % 5) for i in range(300)}
    packed = packing.pack(make_docs(list(texts.items())), CFG).collect()
    used = check(packed, texts, CFG)
    total = sum(len(plain_ids(t)) for t in texts.values())
    assert used <= 1.1 * total / CFG.capacity


def test_groups_exchange_until_certified(make_docs):
    texts = {i: "a " * (5 + i % 6) for i in range(400)}
    many = check(packing.pack(make_docs(list(texts.items())), CFG).collect(), texts, CFG)
    one = PackConfig(capacity=16, group_pieces=10**6)
    best = check(packing.pack(make_docs(list(texts.items())), one).collect(), texts, one)
    assert best <= many <= 1.03 * best


def test_lower_bound_holds_and_is_tight_where_halves_do_not_pair():
    counts = np.bincount([9, 9, 9, 3], minlength=17)
    assert packing.lower_bound(counts) == 3
    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = rng.integers(1, 17, 30)
        bins, _ = packing.best_fit(lengths, 16)
        assert packing.lower_bound(np.bincount(lengths, minlength=17)) <= bins.max() + 1


def test_bounds_against_exhaustive_search():
    def fewest(sizes, rooms=()):
        if not sizes:
            return len(rooms)
        first, rest = sizes[0], sizes[1:]
        options = [fewest(rest, (*rooms, 8 - first))]
        for at, room in enumerate(rooms):
            if room >= first:
                options.append(fewest(rest, (*rooms[:at], room - first, *rooms[at + 1 :])))
        return min(options)

    rng = np.random.default_rng(2)
    for _ in range(40):
        sizes = sorted(map(int, rng.integers(1, 9, 6)), reverse=True)
        bins, _ = packing.best_fit(np.array(sizes), 8)
        assert packing.lower_bound(np.bincount(sizes, minlength=9)) <= fewest(sizes) <= bins.max() + 1


def test_nulls_empty_repeated_rows_and_clashing_columns(make_docs):
    docs = make_docs([(None, None), (1, ""), (2, "a b"), (2, "a b")])
    out = packing.pack(docs.selectExpr("*", "1 AS id", "2 AS piece", "3 AS length"), CFG).collect()
    assert sorted(r.length for r in out) == [1, 1, 3, 3]
    assert len({r.sequence_id for r in out}) == 1 and sorted(r.offset for r in out) == [0, 3, 6, 7]
    assert packing.pack(make_docs([]), CFG).count() == 0


def test_sequences_hold_the_ids(make_docs):
    texts = {i: "one two three " * (i % 9) for i in range(40)}
    packed = packing.pack(make_docs(list(texts.items())), CFG, with_ids=True)
    made = packing.sequences(packed).collect()
    total = sum(len(r.ids) // 4 for r in made)
    assert total == sum(len(plain_ids(t)) for t in texts.values())
    assert max(len(r.ids) for r in made) <= 64


@pytest.mark.parametrize(
    "text",
    ["", " ", "  a", "a  ", "a\n b", "a   b\t c", "x<|endoftext|>  y", "  <|endoftext|>", "don't I'll", " é ́ x", "a\x1c b"],
)
def test_segments_give_the_ids_of_the_whole_text(text):
    ids = next(iter(packing.encoder(CFG.tokenizer).encode([text])))
    assert [*np.frombuffer(ids, "<u4").tolist(), 2] == plain_ids(text)


@pytest.mark.parametrize("group_pieces, growth", [(12, 4), (60, 1)])
def test_rounds_end_certified_or_without_gain(spark, monkeypatch, group_pieces, growth):
    lengths = np.random.default_rng(1).integers(20, 46, 1500)
    items = spark.createDataFrame([(i, int(x)) for i, x in enumerate(lengths)], "id long, length long")
    cfg = PackConfig(capacity=100, group_pieces=group_pieces, growth=growth)
    turns, plain = [], packing._pack_round

    def seen(items, parts, turn, cfg):
        turns.append((parts, items.count()))
        return plain(items, parts, turn, cfg)

    monkeypatch.setattr(packing, "_pack_round", seen)
    rows = packing.place(items, cfg).collect()
    assert sorted(r.id for r in rows) == list(range(1500))
    bins = {}
    for r in rows:
        bins.setdefault((r.turn, r.part, r.bin), []).append((r.place, r.length))
    for pieces in bins.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert ends[-1] <= 100 and [p for p, _ in sorted(pieces)] == [0, *ends[:-1]]
    open_bins = any(r.gap > 0 and sum(n for _, n in bins[r.turn, r.part, r.bin]) < 100 for r in rows)
    assert len(turns) > 1 and all(n <= growth * group_pieces * parts for parts, n in turns)
    assert not open_bins or turns[-1][0] == 1 or turns[-1][1] == turns[-2][1]
    assert packing.lower_bound(np.bincount(lengths, minlength=101)) <= len(bins)


def test_certificate_bounds_all_pieces_together(make_docs):
    texts = {i: "a " * (i % 40) for i in range(200)}
    packed = packing.pack(make_docs(list(texts.items())), CFG)
    row = packing.certificate(packed, CFG).first()
    assert row.sequences == check(packed.collect(), texts, CFG)
    lengths = [r.length for r in packed.collect()]
    assert -(-sum(lengths) // 16) <= row.bound <= row.sequences
    assert tuple(packing.certificate(packing.pack(make_docs([]), CFG), CFG).first()) == (0, 0)


def test_segments_that_leave_the_cache_give_the_same_ids(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_SEGMENTS", 7)
    encoder = packing.Encoder(CFG.tokenizer)
    texts = [" ".join(f"w{(i * k) % 23}" for k in range(n)) for i, n in enumerate([3, 5, 4, 30, 2, 6, 6, 3, 9, 1])] * 2
    for text, ids in zip(texts, encoder.encode(texts)):
        assert [*np.frombuffer(ids, "<u4").tolist(), 2] == plain_ids(text)
        assert len(encoder.kept) <= 7 and len(encoder.before) <= 7
