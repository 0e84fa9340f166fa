"""Near copies of one text, more than a bucket compares pair by pair: no link is lost."""

import random
from collections import Counter

import numpy as np

from tarmac.llm import simhash, url_rules


def test_versions_of_one_text(spark):
    rng = random.Random(1)
    base = [f"w{rng.randint(0, 3000)}" for _ in range(120)]
    rows = []
    for k in range(160):
        words = list(base)
        for i in rng.sample(range(120), rng.randint(0, 5)):
            words[i] = f"v{rng.randint(0, 10**6)}"
        rows.append((k, " ".join(words)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for _, t in rows]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs = [(i, j) for i in range(160) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    label = list(range(160))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in pairs:
        a, b = find(i), find(j)
        label[max(a, b)] = min(a, b)
    assert len(pairs) > 1500 and got == {i: find(i) for i in range(160)}


def test_lines_stage_keeps_the_columns_of_its_input(spark):
    import corpus_pipeline

    rows = [(k, "This line stands in many documents\nown text " + str(k), 77, 88, 5) for k in range(4)]
    got = corpus_pipeline.lines(spark, spark.createDataFrame(rows, "doc_id long, text string, n_lines long, n_dropped long, n_chars long"), "").collect()
    assert {(r.doc_id, r.n_lines, r.n_dropped) for r in got} == {(k, 77, 88) for k in range(4)}
    assert all(r.n_chars == len(r.text) for r in got) and sum("many" in r.text for r in got) == 1


def test_rules_of_many_shapes(spark):
    """Rules of a thousand shapes are one join; a rule given twice with both verdicts blocks; no pages, no rows."""
    rng = random.Random(2)
    host = lambda: ".".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
    path = lambda: "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 120)))
    rules = [(rng.choice(["allow", "block"]), host() + path()) for _ in range(1500)]
    rules += [("allow", "twice.org/p"), ("block", "twice.org/p")]
    pages = [(k, f"http://{'' if k % 3 else host() + '.'}{r.replace('/', '/', 1)}{rng.choice(['', 'more', '?q'])}") for k, (_, r) in enumerate(rules)] + [(9001, None), (9002, "no host")]
    table = url_rules.rule_table(spark, rules)
    df = spark.createDataFrame(pages, "page_id long, url string")
    verdict = {}
    for v, r in rules:
        verdict[r] = max(verdict.get(r, v), v)
    split = [(r.split("/")[0], r[len(r.split("/")[0]) :], r) for r in verdict]

    def judged(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        h = rest.split("/")[0].split("?")[0].lower()
        p = rest[len(h) :].split("?")[0]
        fits = [(len(r), r) for a, b, r in split if h and (h == a or h.endswith("." + a)) and p.startswith(b)]
        return (max(fits)[1], verdict[max(fits)[1]]) if fits else (None, "allow")

    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge_pages(df, table).collect()}
    assert got == {k: judged(u) for k, u in pages} and got[1501] == ("twice.org/p", "block")
    assert url_rules.judge_pages(df.where("false"), table).count() == 0


def test_thresholds_of_wide_fingerprints(spark):
    """Each text leaves out the partitions that crowd it most, and texts that share enough partitions meet all the same."""
    rng = random.Random(7)
    common = [f"c{k}" for k in range(60)]
    rows = []
    for k in range(300):
        own = [f"w{rng.randint(0, 10**6)}" for _ in range(70)]
        for _ in range(1 + k % 2):
            rows.append((len(rows), " ".join([*common, *own])))
            own[rng.randrange(70)] = "changed"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = simhash._wide(docs, ("doc_id",), 5)
    values, probed = {}, {}
    for r in simhash.probe_rows(nodes).collect():
        values.setdefault(r.node, {})[r.view] = r.value
        if r.probes:
            probed.setdefault(r.node, set()).add(r.view)
    cells = {n: {v: (v, int(simhash._cells(np.array([x]).astype(np.int64).view(np.uint64), simhash.WIDE_CELLS)[0])) for v, x in own.items()} for n, own in values.items()}
    seen = Counter(c for own in cells.values() for c in own.values())
    views = set(range(simhash.VIEWS))
    assert len(values) == len(rows)
    for n, own in cells.items():
        assert set(own) == views and len(probed[n]) == simhash.VIEWS - simhash.SHARED + 1
        assert max(seen[own[v]] for v in probed[n]) <= min(seen[own[v]] for v in views - probed[n])
    assert max(seen.values()) > 20 * sum(seen.values()) / len(seen)  # the common passage crowds some buckets
    nodes = sorted(values)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            shared = {v for v in views if values[a][v] == values[b][v]}
            if len(shared) >= simhash.SHARED:
                assert shared & probed[a] and shared & probed[b]
    groups = Counter(r.component_id for r in simhash.similar_documents(docs).collect())
    assert Counter(groups.values()) == {1: 150, 2: 150}


def test_draws_are_grouped_by_correlation():
    triples = [(k, k + 17, k + 34) for k in range(17)]
    related = np.eye(simhash.DRAWS)
    for t in triples:
        related[np.ix_(t, t)] = 0.5
    assert sorted(map(tuple, simhash.group_bits(related, simhash.VIEWS))) == triples
