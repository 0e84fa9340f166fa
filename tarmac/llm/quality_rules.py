"""Quality rules as weak supervision, in DataFrame functions alone.

Each rule votes good (1), bad (-1) or abstains (0), and rules overlap: most kinds of junk offend against two or three.
Expectation-maximisation over the table of distinct vote patterns, whose size is bounded by the number of rules and not
by the number of documents, estimates how often each rule votes what on good and on bad documents. So the data tell how
much a rule's vote is worth: a rule that also accuses documents which all others praise is overruled by them, and one
that accuses along with others counts. The posterior probability of good quality decides in place of "all must pass".
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import cut_lineage

WINDOW = 8
SYMBOLS = "[#*$%&|<>]+"
BLANK = "[\\x20\\x09-\\x0D]+"
#: A word of letters alone, with a stop after it at most.
PLAIN = "(?<![^\\x20\\x09-\\x0D])\\p{L}+[.,;:?!]?(?![^\\x20\\x09-\\x0D])"

#: name: (bad if, good if) over the counts; else the rule abstains.
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words < 50", "n_words >= 150"),
    "word_length": ("word_chars < 4 * n_words or word_chars > 7 * n_words", "word_chars between 4.5 * n_words and 6.5 * n_words"),
    "symbols": ("20 * n_symbols > n_words", "n_symbols = 0"),
    "plain": ("10 * n_plain_chars < 7 * word_chars", "10 * n_plain_chars >= 9 * word_chars"),
    "capitals": ("4 * n_capital > word_chars", "10 * n_capital <= word_chars"),
    "stops": ("25 * n_stops < n_words", "n_words between 3 * n_stops and 12 * n_stops"),
    "repeated_words": ("10 * n_repeat_words > n_words", "n_repeat_words = 0"),
    "repeated_lines": ("n_dup_lines > 0", "n_dup_lines = 0 and n_lines >= 4"),
    "distinct_words": ("10 * n_distinct < 4 * n_words", "10 * n_distinct >= 6 * n_words"),
}

#: vote: how often any rule is believed to give it on good and on bad documents before votes are seen. That good votes
#: are commoner on good documents tells the two kinds apart; the figures themselves are estimated.
START = {-1: (0.1, 0.4), 0: (0.3, 0.3), 1: (0.6, 0.3)}
#: Documents of either kind that this belief counts as.
STRENGTH = 5
PRIOR = 0.8


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once: a lambda's variable is not expanded where it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def _word_counts(words: Column) -> Column:
    """How many words lie in a window of WINDOW words that is found twice or more in the array, and distinct words."""

    def repeated(hashes: Column) -> Column:
        for step in (1, 2, 4):
            hashes = _let(hashes, _joined(step))
        return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(_let(hashes, _covered))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.struct(repeated(h).cast("long").alias("repeat"), F.size(F.array_distinct(h)).cast("long").alias("distinct")))


def _joined(step: int):
    """From hashes of windows of ``step`` words to those of twice as many: the hash of the two halves."""
    left = lambda h: F.greatest(F.size(h) - step, F.lit(0))
    return lambda h: F.zip_with(F.slice(h, 1, left(h)), F.slice(h, step + 1, left(h)), lambda a, b: F.xxhash64(a, b))


def _covered(hashes: Column) -> Column:
    """Words under the windows whose hash occurs more than once; most texts have none and end at the first test."""
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(ordered, _covered_words))


def _covered_words(ordered: Column) -> Column:
    """Sorted by hash, equal windows are neighbours; those that have one cover words, in order of place."""
    met = lambda k, x: F.coalesce(F.get(ordered, k)["h"] == x["h"], F.lit(False))
    twice = F.transform(ordered, lambda x, k: F.when(met(k - 1, x) | met(k + 1, x), x["i"]))
    # A window adds as many words as lie beyond the one before.
    return F.aggregate(
        F.array_sort(F.filter(twice, lambda i: i.isNotNull())),
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )


def base_counts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and counts of every whole text, by string and array functions in one pass without a shuffle.

    Words are runs of characters other than ``[\\x20\\x09-\\x0D]``; a null text has none. ``word_chars`` counts code
    points in words, ``n_symbols`` characters of ``[#*$%&|<>]``, ``n_dup_lines`` lines with a word that equal an earlier
    line, ``n_repeat_words`` words under windows of eight words found twice or more.
    """
    text = F.coalesce("text", F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    split = docs.select("doc_id", text.alias("text"), F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK)).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    counted = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - _number(BLANK)).alias("word_chars"),
        _number(SYMBOLS).alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("all"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("again"))).alias("lines"),
        _word_counts(F.col("words")).alias("of_words"),
        _number(PLAIN).alias("n_plain_chars"),
        _number("[A-Z]+").alias("n_capital"),
        _number("[.?,;:]+").alias("n_stops"),
    )
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", F.col("lines.again").alias("n_dup_lines"), F.col("of_words.repeat").alias("n_repeat_words"),
        F.col("lines.all").alias("n_lines"), F.col("of_words.distinct").alias("n_distinct"), "n_plain_chars", "n_capital", "n_stops",
    )


def _number(runs: str) -> Column:
    """Characters of the text in runs of a kind."""
    return (F.length("text") - F.length(F.regexp_replace("text", runs, ""))).cast("long")


def votes(counts: DataFrame, rules: dict[str, tuple[str, str]] = RULES) -> DataFrame:
    return counts.withColumns({f"vote_{k}": F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0) for k, (bad, good) in rules.items()})


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _posterior(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds))


def _round(patterns: Column, n_rules: int):
    """From a model (the prior's log odds, and each rule's log ratios for the votes -1, 0 and 1) to the next."""

    def of(model: Column) -> Column:
        odds = lambda p: model["prior"] + _sum(F.zip_with(p["votes"], model["rules"], lambda v, t: F.get(t, v + 1)))
        weighed = F.transform(patterns, lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), (p["n"] * _posterior(odds(p))).alias("g")))
        return _let(weighed, maximised)

    def maximised(weighed: Column) -> Column:
        all_good, every = _sum(F.transform(weighed, lambda p: p["g"])), _sum(F.transform(weighed, lambda p: p["n"]))
        return _let(F.struct(all_good.alias("g"), (every - all_good).alias("b")), lambda total: F.struct(
            F.log((total["g"] + 5 * PRIOR) / (total["b"] + 5 * (1 - PRIOR))).alias("prior"),
            F.transform(F.sequence(F.lit(0), F.lit(n_rules - 1)), lambda k: F.array(*(ratio(weighed, total, k, v) for v in START))).alias("rules"),
        ))

    def ratio(weighed: Column, total: Column, k: Column, v: int) -> Column:
        """The log ratio of a rule's shares of a vote on good and on bad documents."""
        voted = F.filter(weighed, lambda p: F.get(p["votes"], k) == v)
        return _let(voted, lambda x: F.log((_sum(F.transform(x, lambda p: p["g"])) + STRENGTH * START[v][0]) / (total["g"] + STRENGTH)) - F.log((_sum(F.transform(x, lambda p: p["n"] - p["g"])) + STRENGTH * START[v][1]) / (total["b"] + STRENGTH)))

    return of


def label_model(voted: DataFrame, names: list[str], rounds: int = 40) -> tuple[dict[str, dict[int, float]], float]:
    """Expectation-maximisation: for each rule the log of P(vote | good) / P(vote | bad) for each vote, and the log odds
    of good documents among all.

    Votes are counted by pattern first, so one row of at most 3 ** len(names) patterns is left, and all rounds run over
    this row in a single expression of one query. An empty table leaves what is believed at the start.
    """
    patterns = voted.groupBy(*names).agg(F.count("*").cast("double").alias("n"))
    row = patterns.agg(F.collect_list(F.struct(F.array(*names).alias("votes"), "n")).alias("patterns"))
    start = F.struct(F.lit(math.log(PRIOR / (1 - PRIOR))).alias("prior"), F.array(*[F.array(*(F.lit(math.log(g / b)) for g, b in START.values()))] * len(names)).alias("rules"))
    step = _round(F.col("patterns"), len(names))
    found = row.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda model, _: step(model)).alias("m")).first()["m"]
    return {k: dict(zip(START, t)) for k, t in zip(names, found["rules"])}, found["prior"]


def _log_odds(table: dict[str, dict[int, float]], prior: float) -> Column:
    total = F.lit(prior)
    for k, t in table.items():
        total = total + F.when(F.col(k) == 1, t[1]).when(F.col(k) == -1, t[-1]).otherwise(t[0])
    return total


def judge_documents(docs: DataFrame, rules: dict[str, tuple[str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id``, the base counts, ``base_failed`` (fewer than 20 words, or more than 30
    of 100 words repeated), ``posterior`` of good quality and ``kept`` (false if base_failed, else posterior >= threshold).

    Null and empty texts have counts of 0 and fail the base. Repeated rows are judged alike. An empty table gives no rows.
    Columns other than doc_id and text are left out.
    """
    names = [f"vote_{k}" for k in rules]
    voted = cut_lineage(votes(base_counts(docs), rules))  # a few numbers a document, so that texts are read once
    table, prior = label_model(voted, names)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = voted.withColumn("base_failed", failed).withColumn("posterior", _posterior(_log_odds(table, prior)))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
