"""Each stage of the pipeline against a slow version, on its own input, over a table with all the awkward cases."""

import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from test_text_operators import ids_of, shingles_of, similar_groups, texts, varied

import corpus_pipeline
from tarmac.llm import decontamination, quality_classifier

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"
ITEM = "seven quiet rivers cross the old stone market at noon in the winter light"


def rows():
    """Awkward texts, rows without own ids, near copies, good and bad prose, test items in long and short documents."""
    rng = random.Random(11)
    some = ["river", "hill", "stone", "cloud", "winter", "light", "road", "bridge", "quiet", "market", "garden", "letter"]
    line = lambda: " ".join(rng.choice(some) + rng.choice(["", "s", "ly", "er"]) for _ in range(rng.randint(6, 12))).capitalize() + rng.choice([".", ", and so on."])
    good = ["\n".join(line() for _ in range(rng.randint(3, 9))) for _ in range(260)]
    bad = [rng.choice([lambda x: x.replace(" ", "### "), lambda x: x.upper().replace(" ", "!! "), lambda x: x.replace(" ", " | ")])("\n".join(line() for _ in range(4))) for _ in range(90)]
    out = [(i, t) for i, t in texts()] + list(enumerate(good, 1000)) + list(enumerate(bad, 2000)) + list(enumerate(varied(rng, 6, 5), 3000))
    out += [(None, good[0] + "\nits own end"), (None, "a text without an id, but with words of its own"), (5000, good[1]), (5000, good[2] + " more"), out[20], (4000, "\n".join(line() for _ in range(7)) + "\n" + ITEM), (4001, ITEM.upper() + "!"), (4002, "\n".join(good[4:60]) + f"\n{ITEM}\n" + "\n".join(good[60:120]))]
    return [(i, t, "en", "s", None if t is None else len(t), "own") for i, t in out]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    marks = [(i, int(i < 2000), 0) for i in (*range(1000, 1260), *range(2000, 2090))] + [(None, 1, 0), (1000, 1, 0), (2001, None, 0)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, ITEM), (1, None), (2, ""), (3, "no such item stands in any of the documents here")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, folder):
    """name: (rows before, rows after) of each stage, written and read again as the pipeline does."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out[name] = docs.collect(), after.collect()
        if name != "windows":
            assert after.columns == docs.columns
        docs = after
    return out


def key(r):
    return repr((r.doc_id, r.text))


def plain_features(text):
    """The features of one text, in plain Python."""
    data = text.encode()
    n = max(len(data), 1)
    words = data.translate(bytes(c + 32 if 65 <= c < 91 else c for c in range(256))).split()
    some = max(len(words), 1)
    among = lambda chars: sum(c in chars for c in data)
    upper, lower = among(range(65, 91)), among(range(97, 123))
    marks = among([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
    return [
        math.log1p(len(words)), (len(data) - among(b" \t\n\r\x0b\x0c")) / some, upper / max(upper + lower, 1), marks / n, among(b"#*$%&<>") / n, among(b"!") / n, among(b"|") / n, among(range(48, 58)) / n, among(range(128, 256)) / n,
        len(set(words)) / some, sum(a == b for a, b in zip(words, words[1:])) / some, among(b"\n") / some, among(b".,;:?") / some, max((words.count(w) for w in set(words)), default=0) / some,
    ]


def plain_score(model, x):
    """A score by looking up one bin after another."""
    at = [sum(e <= v for e in edges) for v, edges in zip(x, model.edges)]
    total = model.intercept + sum(float(t[b]) for t, b in zip(model.single, at)) + sum(float(t[at[f], at[g]]) for f, g, t in model.pairs)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def test_quality(spark, folder, stages):
    before, after = stages["quality"]
    model = quality_classifier.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    scores = {key(r): plain_score(model, plain_features(r.text or "")) for r in before}
    got = quality_classifier.score_documents(spark.read.parquet(f"{folder}/documents.parquet"), model).select("doc_id", "text", "score").collect()
    assert all(r.score == pytest.approx(scores[key(r)], abs=1e-9) for r in got)
    assert sorted(map(key, after)) == sorted(key(r) for r in before if scores[key(r)] >= 0.3)
    assert all(r.score == "own" for r in after)  # a column of the input, not the model's
    assert {r.doc_id for r in after} >= set(range(1000, 1260)) and len({r.doc_id for r in after} & set(range(2000, 2090))) <= 3


def test_lines(stages):
    before, after = stages["lines"]
    strip = lambda x: x.encode().strip(b" \t\n\x0b\x0c\r").lower().decode()
    seen = {}
    for r in before:
        for x in (r.text or "").split("\n"):
            seen.setdefault(strip(x), set()).add(r.doc_id)
    order = lambda d: (d is not None, d or 0)
    want = []
    for r in before:
        gone = lambda x: len(strip(x)) >= 20 and len(seen[strip(x)]) >= 3 and max(seen[strip(x)], key=order) != r.doc_id  # noqa: B023, E731
        text = "\n".join(x for x in (r.text or "").split("\n") if not gone(x))
        want.append((r.doc_id, text, len(text), r.score))
    assert sorted(((r.doc_id, r.text, r.n_chars, r.score) for r in after), key=repr) == sorted(want, key=repr)


def test_near_copies(stages):
    before, after = stages["near_copies"]
    groups = {}
    for r, g in zip(before, similar_groups([(r.doc_id, r.text) for r in before])):
        groups.setdefault(g, []).append(r)
    order = lambda r: (r.doc_id is None, r.doc_id or 0, np.uint64(xxhash.xxh64_intdigest(r.text.encode(), 42)).astype(np.int64))
    want = sorted(key(min(g, key=order)) for g in groups.values())
    assert sorted(map(key, after)) == want and len(after) < len(before)


def test_benchmark(stages):
    before, after = stages["benchmark"]
    item = decontamination.shingle_set(ITEM, 5)
    want = [r for r in before if len(item & decontamination.shingle_set(r.text, 5)) < 0.8 * len(item)]
    assert sorted(map(key, after)) == sorted(map(key, want)) and {4000, 4002} <= {r.doc_id for r in before} - {r.doc_id for r in after}


def test_windows(stages):
    before, after = stages["windows"]
    pieces = {}
    for r in after:
        assert r.length * 4 == len(r.ids) and r.ids_crc32 == zlib.crc32(r.ids)
        pieces.setdefault(r.doc_id, []).append(r)
    several = [r.doc_id for r in before if sum(x.doc_id == r.doc_id for x in before) > 1]
    for r in before:
        if r.doc_id not in several:
            want = np.append(ids_of(r.text), 0).astype("<u4").tobytes()
            assert b"".join(bytes(p.ids) for p in sorted(pieces[r.doc_id], key=lambda p: p.start)) == want
    assert sum(r.length for r in after) == sum(len(ids_of(r.text)) + 1 for r in before)


def test_run(spark, folder, stages):
    got = corpus_pipeline.run(spark, folder).select("doc_id", "start", "length", "ids_crc32").count()
    assert got == len(stages["windows"][1])
    assert shingles_of("") == frozenset()


def test_stages_of_empty_tables(spark, folder):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
