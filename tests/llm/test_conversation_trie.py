"""The conversation trie, its running sums and its ranked list, against slow versions."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from tarmac.llm import conversation_trie, scans

SCHEMA = "conv_id long, turn long, role string, text string, depth string, node string, k1 string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def slow(rows):
    held, members, ends, children = (defaultdict(list) for _ in range(4))
    for c, turn, role, text in rows:
        if c is not None:
            held[c].append(((turn is not None, turn or 0), role or "", text or ""))
    for turns in held.values():
        turns.sort(key=lambda x: x[0])
    for c in sorted(held):
        h = zlib.crc32(str(c).encode()) % 6
        whole = tuple(x[1:] for x in held.get(c - c % 100, [])[:h] + held[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(str(c))
    for key in members:
        if key:
            children[key[:-1]].append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        own = (len(members[key]) - 1) * len(key[-1][1]) if key else 0
        leaves[key] = sum(leaves[x] for x in children[key]) or 1
        saved[key] = own + sum(saved[x] for x in children[key])
    digest = lambda key: hashlib.sha256(",".join(ends[key]).encode()).hexdigest()
    return {(min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(children[k]), leaves[k], saved[k], digest(k)) for k in members}


def conversations():
    """Shared beginnings, a block without its first, nulls, turnless ones, repeated turns, a very long conversation."""
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 260), *range(301, 340), 5000, 123456789012]:
        n = 40 if c == 200 else rng.choice([1, 1, 2, 3, 8])
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["hello", "é, ü", "", None, "a question of some length", f"own {c}"])) for t in range(n)]
    rows += [(7, None, "system", "first of all"), (None, 0, "user", "of nobody"), (11, 50, "user", "x" * 100_000), (300, 0, "user", None)]
    rows += [(5000, t, "user", f"turn {t}") for t in range(1, 3000)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA).repartition(3)


def test_trie(spark):
    rows = conversations()
    got = [tuple(r) for r in conversation_trie.grafted_trie(table(spark, rows)).select(COLUMNS).collect()]
    assert len(got) == len(set(got)) and set(got) == slow(rows)


def test_no_conversations(spark):
    assert conversation_trie.grafted_trie(table(spark, [])).count() == 0
    assert conversation_trie.grafted_trie(table(spark, [(None, 1, "user", "x")])).count() == 0


def test_turns_of_one_number_and_repeated_rows(spark):
    """The order of equal turn numbers does not depend on how rows are dealt, and every repeated row counts."""
    rows = [(1, 5, "user", x) for x in "abcabc"]
    first, second = (conversation_trie.grafted_trie(table(spark, x)).select(COLUMNS).collect() for x in (rows, rows[::-1]))
    assert sorted(first) == sorted(second) and len(first) == max(r.depth for r in first) + 1 == 7 - zlib.crc32(b"1") % 6


@pytest.mark.parametrize("block", [8, 1 << 18])
def test_list_positions(spark, block):
    """Against the numbers of arcs, and shuffled, with blocks so small that many levels are needed."""
    rng = random.Random(1)
    arcs = list(range(0, 400, 2))
    for order in (arcs[::-1], rng.sample(arcs, len(arcs))):
        links = spark.createDataFrame(list(zip(order, [*order[1:], -1])), "arc long, next long").repartition(5)
        got = dict(scans.list_positions(links, block).collect())
        assert got == {a: i for i, a in enumerate(order)}


def test_running_sums_of_groups_over_many_partitions(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, 3, 9]), i, rng.randint(-5, 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g long, i long, v long").repartition(5)
    want, run = {}, defaultdict(int)
    for g, i, v in sorted(rows):
        run[g] += v
        want[g, i] = run[g]
    assert {(r.g, r.i): r.run_v for r in scans.running_sums(df, ["g"], ["i"], ["v"]).collect()} == want
    total, whole = 0, {}
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        total += v
        whole[g, i] = total
    assert {(r.g, r.i): r.run_v for r in scans.running_sums(df, [], ["i"], ["v"]).collect()} == whole
