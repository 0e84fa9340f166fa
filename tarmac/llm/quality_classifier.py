"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins, and so has each of a few pairs of features. The tables are learnt by
cyclic boosting: in every round each feature in turn gets a shallow tree fitted to the present residuals, and the
tree's leaves are added to the feature's table; pairs follow when single features are done. A score is the sigmoid of
the sum of one bin from each table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.common import raw_bytes, steps, text_column
from tarmac.llm.shingles import words

#: Labelled documents that a model is fitted on, about: the bound of what reaches the driver (numbers only).
FIT_ROWS = 20_000
FEATURES = ("words", "word_bytes", "upper", "marks", "symbols", "exclamations", "bars", "digits", "beyond_ascii", "distinct_words", "same_as_before", "lines_a_word", "stops", "top_word")
_SYMBOLS, _STOPS = b"#*$%&<>", b".,;:?"


def features(texts: pa.Array) -> np.ndarray:
    """The features of each text of a column without nulls, a row for each; all are 0 for an empty text."""
    data, offsets = raw_bytes(texts)
    n = len(texts)
    counts = np.zeros((n, 256))
    for i in range(n):
        if offsets[i] < offsets[i + 1]:
            counts[i] = np.bincount(data[offsets[i] : offsets[i + 1]], minlength=256)
    word, doc = words(data, offsets, False)
    n_words = np.bincount(doc, minlength=n)
    order = np.lexsort((word, doc))
    w, d = word[order], doc[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
    runs = np.diff(np.append(np.flatnonzero(new), len(w)))
    top = np.zeros(n)
    np.maximum.at(top, d[new], runs)
    again = np.bincount(doc[1:][(word[1:] == word[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
    of = lambda chars: counts[:, list(chars)].sum(1)
    upper, lower = counts[:, 65:91].sum(1), counts[:, 97:123].sum(1)
    marks = counts[:, 33:48].sum(1) + counts[:, 58:65].sum(1) + counts[:, 91:97].sum(1) + counts[:, 123:127].sum(1)
    total, some = np.maximum(counts.sum(1), 1), np.maximum(n_words, 1)
    spaces = counts[:, 9:14].sum(1) + counts[:, 32]
    return np.column_stack([
        np.log1p(n_words), (counts.sum(1) - spaces) / some, upper / np.maximum(upper + lower, 1), marks / total, of(_SYMBOLS) / total,
        of(b"!") / total, of(b"|") / total, counts[:, 48:58].sum(1) / total, counts[:, 128:].sum(1) / total,
        np.bincount(d[new], minlength=n) / some, again / some, counts[:, 10] / some, of(_STOPS) / some, top / some,
    ])


@dataclass
class Model:
    """Lookup tables over bins. ``score`` adds one bin of each."""

    edges: list[np.ndarray]
    intercept: float
    single: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]
        total = np.full(len(x), self.intercept)
        for table, b in zip(self.single, bins):
            total += table[b]
        for f, g, table in self.pairs:
            total += table[bins[f], bins[g]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _leaf(g: np.ndarray | float, h: np.ndarray | float):
    return g / (h + 1.0)


def _gain(g, h):
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of three leaves over ordered bins with residual sums g and weights h: the value of each bin."""

    def split(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
        all_g, all_h = g[a:b].sum(), h[a:b].sum()
        won = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
        return float(won.max()), a + 1 + int(won.argmax())

    _, cut = split(0, len(g))
    (won_left, cut_left), (won_right, cut_right) = split(0, cut), split(cut, len(g))
    ends = sorted({0, cut, cut_left if won_left > won_right else cut_right, len(g)})
    out = np.zeros(len(g))
    for a, b in zip(ends, ends[1:]):
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree of one cut on each axis over a grid of bins: its gain and the value of each cell."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(G.shape) < 2:
        return 0.0, np.zeros(G.shape)
    a, b, right, below = G[:-1, :-1], H[:-1, :-1], G[:-1, -1:], G[-1:, :-1]
    quarters = [(a, b), (right - a, H[:-1, -1:] - b), (below - a, H[-1:, :-1] - b), (G[-1, -1] - right - below + a, H[-1, -1] - H[:-1, -1:] - H[-1:, :-1] + b)]
    won = sum(_gain(x, y) for x, y in quarters)
    i, j = np.unravel_index(won.argmax(), won.shape)
    out = np.empty(G.shape)
    for (x, y), cells in zip(quarters, ((slice(None, i + 1), slice(None, j + 1)), (slice(None, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(None, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        out[cells] = _leaf(x[i, j], y[i, j])
    return float(won[i, j] - _gain(G[-1, -1], H[-1, -1])), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, rate: float = 0.1, n_pairs: int = 6, pair_rounds: int = 40) -> Model:
    """Tables for features ``x`` and labels ``y`` (0 or 1). Without rows every score is 0.5."""
    prior = (y.sum() + 1) / (len(y) + 2)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0) for f in range(x.shape[1])]
    at = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(cuts)]
    single = [np.zeros(len(e) + 1) for e in cuts]
    model = Model(cuts, float(np.log(prior / (1 - prior))), single, [])
    total = np.full(len(y), model.intercept)

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    if len(np.unique(y)) < 2:
        return model
    for _ in range(rounds):
        for f, b in enumerate(at):
            g, h = residuals()
            step = rate * _tree(np.bincount(b, g, len(single[f])), np.bincount(b, h, len(single[f])))
            single[f] += step
            total += step[b]
    grids = {(f, g): (len(single[f]), len(single[g])) for f, g in combinations(range(len(single)), 2)}

    def grid(pair: tuple[int, int], value: np.ndarray) -> np.ndarray:
        shape = grids[pair]
        return np.bincount(at[pair[0]] * shape[1] + at[pair[1]], value, shape[0] * shape[1]).reshape(shape)

    g, h = residuals()
    best = sorted(grids, key=lambda pair: -_quadrants(grid(pair, g), grid(pair, h))[0])[:n_pairs]
    tables = {pair: np.zeros(grids[pair]) for pair in best}
    for _ in range(pair_rounds):
        for pair, table in tables.items():
            g, h = residuals()
            step = rate * _quadrants(grid(pair, g), grid(pair, h))[1]
            table += step
            total += step[at[pair[0]], at[pair[1]]]
    model.pairs = [(f, g, table) for (f, g), table in tables.items()]
    return model


def held_out(doc_id: str = "doc_id"):
    """Whether a document is never learnt from: CRC-32 of its id as text is 0 modulo 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of about ``fit_rows`` labelled documents at most, spread evenly by a hash of their ids.

    Held-out documents, null ids and null labels are left out; of several labels of a document the least holds.
    """
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    share = min(1.0, fit_rows / max(known.count(), 1))
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # fit_rows ids
    schema = T.StructType([T.StructField("quality", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _with_features(batches):
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], ["quality", "x"])

    got = rows.mapInArrow(run, schema).toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = np.array(got.column("quality").to_pylist(), float)
    order = np.lexsort((*x.T, y))  # the order in which tasks ended is of no account
    return x[order], y[order]


def _with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        texts = text_column(whole)
        for start, stop in steps(np.asarray(pc.binary_length(texts), np.int64)):
            yield whole.slice(start, stop - start), features(texts.slice(start, stop - start))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model of ``labels.quality`` learnt from ``docs``."""
    return fit(*training_rows(docs, labels, fit_rows))


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` with its columns, ``score`` (0 to 1, higher: good quality is likelier) and ``predicted`` (1 from the
    threshold on).

    Whole texts are scored, in one map without a shuffle; only the text is an input of the score. A null text is scored
    as an empty one; repeated rows score alike. An empty table gives no rows. Columns of the input with these two names
    are replaced.
    """
    held = docs.drop("score", "predicted")
    schema = T.StructType([*held.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _with_features(batches):
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], schema.names)

    return held.mapInArrow(run, schema)
