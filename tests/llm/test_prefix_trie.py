"""The prefix trie against a plain count of all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pairloom.llm import prefix_trie

COLUMNS = "conv_id long, turn long, role string, text string, key string, tokens string, n long"


def table(spark, rows):
    """Conversations with columns whose names the operator uses inside."""
    return spark.createDataFrame([(*r, "k", "t", 0) for r in rows], COLUMNS)


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = [*own.get(c - c % 5, [])[:h], *t[h:]]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
        ends[tuple(whole)].append(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, held in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(held) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(
        (
            min(held), len(p), min(members[p[:-1]]) if p else None, len(held), len(kids[p]), leaves[p], saved[p],
            hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest(),
        )
        for p, held in members.items()
    )


def made(spark, rows):
    out = prefix_trie.trie(prefix_trie.rebuilt(table(spark, rows))).collect()
    return sorted(tuple(r) for r in out)


def order(rows):
    return sorted(rows, key=str)


@pytest.fixture
def many_partitions(spark):
    """So that paths are merged over borders, though the tables are small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_trie_against_all_prefixes(spark, many_partitions):
    for seed in range(3):
        rng = random.Random(seed)
        rows = [
            (c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "ää", ""]))
            for c in range(90)
            for t in range(rng.randrange(1, 14))
        ]
        # a third of all conversations begins alike, many are the same, one is long
        rows += [(c, t, "user", "same") for c in range(100, 160) for t in range(3)]
        rows += [(c, t, "user", "deep" if t < 20 else rng.choice("xy")) for c in range(200, 230) for t in range(25)]
        assert order(made(spark, rows)) == order(plain(rows))


def test_trie_nulls_ties_and_repeated_rows(spark, many_partitions):
    rows = [
        (0, None, "user", "first"), (0, 0, None, None), (0, 0, "user", "b"), (0, 0, "user", "a"), (0, 0, "user", "a"),
        (None, 1, "user", "lost"), (3, 5, "user", "x" * 200_000), (7, 0, "user", "alone"), (25, 1, "assistant", "n"),
    ]
    assert order(made(spark, rows)) == order(plain(rows))


def test_trie_of_nothing(spark):
    assert made(spark, []) == []


def test_long_lists_of_ids_are_hashed_piece_by_piece(spark, monkeypatch):
    rows = [(5 * c, 0, "user", "hi") for c in range(9000)]
    out = {r.depth: r for r in prefix_trie.trie(prefix_trie.turns(table(spark, rows))).collect()}
    assert out[1].ends_sha256 == hashlib.sha256(",".join(str(5 * c) for c in range(9000)).encode()).hexdigest()
    assert (out[1].n_convs, out[0].saved_tokens) == (9000, 8999 * 2)


def test_lcp_forest_in_descending_depth():
    paths = [["a"], ["a", "b", "c"], ["a", "b", "d"], ["a", "e"], ["f"]]
    depth, parent, low, high = prefix_trie.forest(paths)
    assert [depth[v] for v in range(5, len(depth))] == [2, 0]
    assert (parent[0], parent[1], parent[2], parent[3], parent[4]) == (6, 5, 5, 0, 6)
    assert (low[0], high[0]) == (0, 3)


def test_turns_share_one_row_format(spark):
    one = prefix_trie.turns(table(spark, [(1, 0, "u", "ä")])).select(F.col("turns")[0]["bytes"]).first()[0]
    assert one == 2
