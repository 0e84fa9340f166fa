"""Cover-tree Lloyd against plain Lloyd, and what the trees promise."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from tarmac.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, part string, points string"


def slow(rows, parts=8, entries=16, rounds=6):
    """Rows (vec_id, vector, label) as (vec_id, label, code, error), in the whole numbers of Python."""
    kept = [(i, [math.floor(4096 * float(x)) for x in v], c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    width = len(kept[0][1]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for _, v, _ in kept] for p in range(parts)]
    books = [list(own[:entries]) for own in cut]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda p: [min(range(len(books[p])), key=lambda k: (far(v, books[p][k]), k)) for v in cut[p]]
    for _ in range(rounds):
        for p in range(parts):
            of = defaultdict(list)
            for v, k in zip(cut[p], nearest(p)):
                of[k].append(v)
            books[p] = [tuple(sum(x) // len(of[k]) for x in zip(*of[k])) if k in of else books[p][k] for k in range(len(books[p]))]
    codes = [nearest(p) for p in range(parts)]
    out = [(r[0], r[2], "".join(f"{codes[p][n]:02x}" for p in range(parts)), sum(far(cut[p][n], books[p][codes[p][n]]) for p in range(parts))) for n, r in enumerate(kept)]
    return Counter(out), hashlib.sha256(",".join(str(x) for own in books for e in own for x in e).encode()).hexdigest()


def vectors(n=400, clusters=5, seed=4):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(16)] for _ in range(clusters)]
    rows = [(k * 3, [x + rng.gauss(0, 0.02) for x in rng.choice(middles)], rng.choice([1, 1, 1, 2, None])) for k in range(n)]
    nan, inf = float("nan"), float("inf")
    rows += [(1, None, 1), (2, [*rows[0][1][:15], None], 1), (4, [nan, *rows[0][1][1:]], 2), (5, [-inf, *rows[0][1][1:]], 2)]
    rows += [(None, rows[3][1], None), rows[7], rows[7], (7, rows[7][1], 9), (8, [0.0] * 16, 1), (10, [-0.5 / 4096] * 16, 1)] + [(2000 + k, rows[5][1], 3) for k in range(60)]
    return [(i, v and [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in rows]


def table(spark, rows):
    return spark.createDataFrame([(*r, "c", "e", "p", "q") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("n", "clusters"), [(400, 5), (300, 300), (8, 2)])
def test_codes(spark, n, clusters):
    """Clustered, scattered and few vectors, with nulls, ties, copies and repeated rows."""
    rows = vectors(n, clusters)
    coded, books = vector_codes.encode_vectors(table(spark, rows))
    want, digest = slow(rows)
    assert Counter(map(tuple, coded.collect())) == want and vector_codes.books_digest(books) == digest
    sums = defaultdict(int)
    for (_, label, _, error), times in want.items():
        sums[label] += error * times
    got = vector_codes.with_label_error(coded).collect()
    assert len(got) == sum(want.values()) and all(r.label_error == sums[r.label] for r in got)


def test_fewer_vectors_than_entries_and_none(spark):
    rows = [(k, [k / 7.0 - 1] * 8, None) for k in range(5)]
    coded, books = vector_codes.encode_vectors(table(spark, rows))
    assert Counter(map(tuple, coded.collect())) == slow(rows)[0] and books.shape == (8, 5, 1)
    for rows in ([], [(1, None, 2), (2, [float("nan")] * 8, 1)]):
        coded, books = vector_codes.encode_vectors(table(spark, rows))
        assert vector_codes.with_label_error(coded).count() == 0 and not books.size


def test_other_lengths_and_sizes_are_refused(spark):
    with pytest.raises(ValueError):
        vector_codes.encode_vectors(table(spark, [(1, [0.5] * 9, 1)]))
    for odd in ([0.5] * 16, [1e30] * 8):
        with pytest.raises(Exception, match="components"):
            vector_codes.encode_vectors(table(spark, [(k, [0.5] * 8, 1) for k in range(20)] + [(99, odd, 1)]))


def test_trees_keep_their_promises_and_settle_whole_nodes():
    rng = np.random.default_rng(2)
    block = np.concatenate([rng.integers(-9, 9, (500, 8)) + c for c in rng.integers(-4000, 4000, (6, 8))] + [np.zeros((50, 8), np.int64)])
    forest = vector_codes.Forest.grown(block, 2)
    n = len(block)
    for p in range(2):
        own = forest.points[p * n : (p + 1) * n]
        assert (own == block[forest.vector[p * n : (p + 1) * n]][:, 4 * p : 4 * p + 4]).all()
    for (low, high, child, count), radius in zip(forest.nodes, forest.radius):
        inside = np.sqrt(((forest.points[low:high] - forest.points[low]) ** 2).sum(1))
        assert inside.max() == radius
        if count:
            heads = forest.nodes[child : child + count, 0]
            assert forest.nodes[child, 0] == low and forest.nodes[child + count - 1, 1] == high
            assert (forest.nodes[child + 1 : child + count, 0] == forest.nodes[child : child + count - 1, 1]).all()
            assert (forest.radius[child : child + count] <= radius / 2).all()
            apart = np.sqrt(((forest.points[heads][:, None] - forest.points[heads]) ** 2).sum(2))
            assert (apart[~np.eye(count, dtype=bool)] > radius / 2).all()
    books = np.stack([block[::400, :4], block[::400, 4:]])
    seen, stretches = np.zeros(len(forest.points), int), 0
    for part, low, high, best in forest.assigned(books):
        for p, a, b, k in zip(part, low, high, best):
            seen[a:b] += 1
            stretches += 1
            assert (((forest.points[a:b, None] - books[p]) ** 2).sum(2).argmin(1) == k).all()
    assert (seen == 1).all() and stretches < len(seen) / 2
