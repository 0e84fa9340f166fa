"""Removal of repeated word passages against a slow version."""

import random
import re
from collections import Counter

import pytest
from tarmac.llm import passage_dedup

SCHEMA = "doc_id long, text string, part string, number string, n_words string, kind string"


def slow(rows, width):
    least, out = {}, []
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    rank = lambda d: (d is not None, d)
    for d, words in split:
        for i in range(len(words) - width + 1):
            key = tuple(words[i : i + width])
            least[key] = min(least.get(key, d), d, key=rank)
    for d, words in split:
        gone = set()
        for i in range(len(words) - width + 1):
            if rank(least[tuple(words[i : i + width])]) < rank(d):
                gone.update(range(i, i + width))
        runs = [i for i in sorted(gone) if i - 1 not in gone]
        spans = tuple((i, next(k for k in range(i, len(words) + 1) if k not in gone) - i) for i in runs)
        out.append((d, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone), spans))
    return Counter(out)


def documents():
    """Passages at every offset of a block, abutting and nested ones, copies, hot passages, nulls and awkward spaces."""
    rng = random.Random(6)
    word = lambda: rng.choice(["the", "of", "Road", "é", "ü!", "x" * 9, "and", "###", "a\xa0b", "　", "42"])
    passages = [[f"{k}.{i}" if rng.random() < 0.5 else word() for i in range(rng.choice([12, 13, 14, 19, 26, 40]))] for k in range(12)]
    rows = []
    for d in range(150):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += [word() for _ in range(rng.randint(0, 9))]
            passage = rng.choice(passages)
            words += passage[rng.randint(0, 3) : len(passage) - rng.randint(0, 3)]
        rows.append((d * 7 % 151, rng.choice([" ", "\n", " \t ", "\x0b"]).join(words)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, rows[5][1]), (None, rows[6][1]), (None, "no id " * 3), (204, "word " * 60), (205, "word " * 90)]
    return rows + [rows[5], rows[5], (rows[8][0], rows[9][1]), (206, " ".join(str(i % 977) for i in range(60_000))), (207, "new " + " ".join(str(i % 977) for i in range(500, 40_000)))]


def found(df, width):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.text, tuple(map(tuple, r.removed))) for r in passage_dedup.remove_passages(df, width).collect())


@pytest.mark.parametrize(("width", "size"), [(13, 1 << 12), (5, 4 << 20)])
def test_passages(spark, monkeypatch, width, size):
    """With parts of few documents, and with all in one."""
    monkeypatch.setattr(passage_dedup, "PART_BYTES", size)
    monkeypatch.setattr(passage_dedup, "BUCKET_BYTES", 2 * size)
    rows = documents()
    df = spark.createDataFrame([(*r, "p", "n", "w", "k") for r in rows], SCHEMA).repartition(3)
    assert found(df, width) == slow(rows, width)


def test_empty_table_and_text_ids(spark):
    assert passage_dedup.remove_passages(spark.createDataFrame([], SCHEMA)).count() == 0
    some = " ".join(map(str, range(20)))
    rows = [("b", some), ("a", "x " + some), (None, some + " y"), ("c", "z")]
    got = passage_dedup.remove_passages(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {(r.doc_id, r.text) for r in got} == {(None, some + " y"), ("a", "x"), ("b", ""), ("c", "z")}
    with pytest.raises(ValueError):
        passage_dedup.remove_passages(spark.createDataFrame(rows, "doc_id string, text string"), 12)
