"""Buckets larger than what is compared pair by pair: all similar nodes end in one group, in whatever round they meet."""

import random

import pytest

from tarmac.llm import simhash
from tarmac.operators.graph import connected_components


def groups(nodes, pairs):
    label = {n: n for n in nodes}

    def find(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def linked(spark, sets, **how):
    """Groups by ``link_similar`` where all nodes share one bucket, and by brute force."""
    rows = spark.createDataFrame([(0, 0, n, True) for n in sets], "view int, value long, node long, probes boolean")
    arrays = spark.createDataFrame([(n, sorted(x)) for n, x in sets.items()], "node long, shingles array<int>")
    links = simhash.link_similar(rows, lambda asked: arrays.join(asked, "node", "left_semi"), 0.8, **how)
    found = {r.node: r.component for r in connected_components(links).collect()}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    return {n: found.get(n, n) for n in sets}, groups(sets, pairs)


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_families_in_one_bucket(spark, monkeypatch, rounds):
    """Families of versions that have a passage in common, more of them than later rounds compare pair by pair."""
    monkeypatch.setattr(simhash, "SIMILAR_PAIRS_UP_TO", 4)
    monkeypatch.setattr(simhash, "FURTHER_PAIRS_UP_TO", 6)
    rng = random.Random(rounds)
    passage, sets = set(range(30)), {}
    for family in range(12):
        base = passage | {1000 * (family + 1) + k for k in range(40)} | ({500 + k for k in range(20)} if family % 2 else set())
        for _ in range(6):
            gone = set(rng.sample(sorted(base), rng.randint(0, 9)))
            sets[rng.randrange(1 << 40)] = base - gone | {10**6 + rng.randrange(10**6) for _ in range(rng.randint(0, 5))}
    got, want = linked(spark, sets, rounds=rounds)
    assert got == want and 12 <= len(set(want.values())) < len(sets)


def test_texts_that_a_longer_leader_contains(spark, monkeypatch):
    """All that two similar nodes share may stand in a leader that is similar to neither."""
    monkeypatch.setattr(simhash, "SIMILAR_PAIRS_UP_TO", 3)
    for leader in range(8):  # whichever node leads
        sets = {n: set(range(50)) | {100 + n} if n % 2 else set(range(60, 110)) | {300 + n} for n in range(7)}
        sets[7] = set(range(200))
        order = list(sets)
        random.Random(leader).shuffle(order)
        sets = {1000 + k * 7919 + leader * 31: sets[n] for k, n in enumerate(order)}
        got, want = linked(spark, sets)
        assert got == want and len(set(want.values())) == 3


def test_blocks_of_what_is_left(spark, monkeypatch):
    """Pairs across the groups of a bucket meet once, whatever the number of blocks; joined ones and closed ones do not."""
    monkeypatch.setattr(simhash, "FURTHER_PAIRS_UP_TO", 4)
    rng = random.Random(9)
    rows = [(0, v, n, 30, rng.random() < 0.7, n % 5 if n < 20 else n, 10, [1] * 8) for v in (1, 2) for n in range(30)]
    frame = spark.createDataFrame(rows, "view int, value long, node long, n long, open boolean, joined long, size int, bits array<long>")
    got = sorted(map(tuple, simhash._across(frame.where("value = 1"), 0.8).collect()))
    own = {r[2]: r for r in rows if r[1] == 1}
    assert got == [(a, b) for a in range(30) for b in range(a + 1, 30) if (own[a][4] or own[b][4]) and own[a][5] != own[b][5]]
    assert simhash._across(frame, 0.8).distinct().count() >= len(got)
