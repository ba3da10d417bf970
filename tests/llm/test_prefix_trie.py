import hashlib
import random
import zlib

import pytest

from firmlens.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SMALL = prefix_trie.TrieConfig(run=4, gap=4, rest=20)


def plain(rows, stride=100, heads=6):
    """Nodes by walking every prefix of every rebuilt conversation."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    convs = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (c % stride if c >= 0 else -(-c % stride))
        convs[c] = turns.get(base, [])[:h] + t[h:]
    members, ends = {}, {}
    for c, t in sorted(convs.items()):
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
        ends.setdefault(tuple(t), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    totals = {}
    for p in sorted(members, key=len, reverse=True):
        leaves, saved = 0 if p in kids else 1, (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        for k in kids.get(p, []):
            leaves, saved = leaves + totals[k][0], saved + totals[k][1]
        totals[p] = leaves, saved
    return sorted(
        (
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), *totals[p],
            hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest(),
        )
        for p, m in members.items()
    )


def found(spark, rows, cfg=None):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, prefix_trie.trie(df, cfg).select(*COLUMNS).collect()))


def chats(seed, n, words, most):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "bot"]), rng.choice(words)) for c in rng.sample(range(-250, 900), n)
            for t in range(rng.randint(1, most))]
    rng.shuffle(rows)
    return rows


def test_equals_walking_all_prefixes(spark):
    rows = chats(1, 300, ["a", "bb", "", "élan 🙂"], 9)
    assert found(spark, rows, SMALL) == plain(rows)


def test_the_given_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, prefix_trie.trie(df).select(*COLUMNS).collect()))
    assert got == plain(rows)


def test_a_very_long_conversation_and_a_node_with_many_children(spark):
    rows = [(7, t, "user", str(t % 3)) for t in range(900)] + [(107, t, "user", str(t % 3)) for t in range(901)]
    rows += [(c, 0, "user", f"text {c}") for c in range(1000, 1400)]
    assert found(spark, rows, SMALL) == plain(rows)


def test_many_equal_conversations(spark):
    rows = [(c, t, "user", "same text") for c in range(500, 900) for t in range(3)]
    assert found(spark, rows, SMALL) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "x"), (1, None, None, None), (1, 0, "user", "b"), (1, 1, "", "ab"), (2, 0, "a", "b"),
        (3, 0, "", "ab"), (4, 5, "user", "x" * 200_000), (100, 0, "user", "b"), (100, 1, "user", "b"),
        (101, 0, "user", "q"), (199, 0, "user", "b"), (-5, 1, "user", "b"), (-100, 1, "user", "c"),
        (5, 1, "user", "t"), (5, 1, "user", "t"), (6, 1, "a", "bc"), (8, 1, "ab", "c"),
    ]
    assert found(spark, rows, SMALL) == plain(rows)
    ties = spark.createDataFrame([(1, 0, "a", "x"), (1, 0, "a", "y"), (1, 0, "a", "x")], SCHEMA)
    first, again = (sorted(prefix_trie.trie(ties.repartition(n)).collect()) for n in (1, 3))
    assert first == again and len(first) == len({tuple(r) for r in first})


def test_empty_tables_and_extra_columns(spark):
    assert found(spark, []) == [] and found(spark, [(None, 1, "user", "x")]) == []
    rows = chats(2, 40, ["a", "b"], 5)
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.selectExpr("*", "1 AS digest", "2 AS number", "3 AS run", "4 AS a", "5 AS depth", "6 AS `next`")
    got = sorted(map(tuple, prefix_trie.trie(df, SMALL).select(*COLUMNS).collect()))
    assert got == plain(rows)


@pytest.mark.parametrize("n", [1, 2, 21, 700])
def test_list_ranking_equals_sums_from_the_end(spark, n):
    rng = random.Random(n)
    order = rng.sample(range(10 * n), n)
    weight = [rng.randint(0, 9) for _ in order]
    rows = [(a, b, w) for a, b, w in zip(order, [*order[1:], -1], weight)]
    rng.shuffle(rows)
    arcs = spark.createDataFrame(rows, "arc long, next long, w long")
    got = dict(map(tuple, prefix_trie.list_sums(arcs, SMALL, ["w"]).collect()))
    assert got == {a: sum(weight[k:]) for k, a in enumerate(order)}
