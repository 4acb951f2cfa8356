"""Runs of words: all runs by brute force, the grammar's round trip, defined cases."""

import random

from queuelens.llm import word_runs


def brute_runs(x):
    found = {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j - i >= max(q, word_runs.MIN_RUN - q):
                found.setdefault((i, j + q), q)
            i = j + (j == i)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def sequences(n, seed):
    rnd = random.Random(seed)
    for _ in range(n):
        k = rnd.choice([1, 2, 2, 3, 4, 8])
        x = [rnd.randrange(k) for _ in range(rnd.randint(0, 100))]
        while rnd.random() < 0.6:
            at, period = rnd.randint(0, len(x)), [rnd.randrange(k) for _ in range(rnd.randint(1, 15))]
            x[at:at] = (period * 10)[:rnd.randint(1, 60)]
        yield k, x + x[rnd.randint(0, len(x)):] + x if rnd.random() < 0.3 else x


def test_all_runs_by_brute_force():
    total = 0
    for k, x in sequences(1500, 1):
        want = brute_runs(x)
        total += len(want)
        assert sorted(word_runs.runs_of(x, k)) == want
    assert total > 1000


def test_small_portions_give_the_same(monkeypatch):
    cases = list(sequences(60, 2))
    whole = [word_runs.runs_of(x, k) for k, x in cases]
    monkeypatch.setattr(word_runs, "PORTION", 7)
    assert [word_runs.runs_of(x, k) for k, x in cases] == whole


def test_grammar_derives_the_text():
    for k, x in sequences(300, 3):
        starts, symbols, rules = word_runs.repair(x, k)
        derived = {s: [s] for s in range(k)}
        for r, (a, b) in enumerate(rules):
            derived[k + r] = derived[a] + derived[b]
        parts = [derived[s] for s in symbols]
        assert sum(parts, []) == x
        assert starts == [sum(map(len, parts[:i])) for i in range(len(parts))]
        left = list(zip(symbols, symbols[1:]))
        # No pair is left at two places that do not overlap.
        assert all(left.count(p) == 1 or (p[0] == p[1] and left.count(p) == 2) for p in left)


def test_shallow_rules_on_a_repeated_text():
    x = list(range(20_000)) * 2
    _, _, rules = word_runs.repair(x, 20_000)
    depth = [0] * 20_000
    for a, b in rules:
        depth.append(1 + max(depth[a], depth[b]))
    assert max(depth) <= 40
    assert word_runs.runs_of(x, 20_000) == [(0, 40_000, 20_000)]


def test_defined_cases(spark):
    words = " ".join(f"w{i}" for i in range(40))
    once = "a b c d e f"
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "x " * 11), (5, "x\n" * 12), (6, f"{words} {once} {once} {once} end"),
            (6, f"{once}\t{once}"), (6, f"{once}\t{once}"), (None, "y " * 30), (7, "z " * 200_000), (8, "é  " * 12)]
    docs = spark.createDataFrame([(i, t, 1, "q", 2) for i, t in rows],
                                 "doc_id long, text string, runs int, collapsed string, start int").repartition(3)
    found = word_runs.find_runs(docs)
    assert found.columns == ["doc_id", "runs", "collapsed"]
    got = sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found.collect()), key=str)
    want = [(1, [], ""), (2, [], ""), (3, [], ""), (4, [], " ".join("x" * 11)), (5, [(0, 12, 1)], "x"),
            (6, [(40, 18, 6)], f"{words} {once} end"), (6, [(0, 12, 6)], once), (6, [(0, 12, 6)], once),
            (None, [(0, 30, 1)], "y"), (7, [(0, 200_000, 1)], "z"), (8, [(0, 12, 1)], "é ")]
    assert got == sorted(want, key=str)
    assert word_runs.find_runs(docs.limit(0)).count() == 0


def test_runs_with_a_shared_middle(spark):
    """A word that two runs hold goes when either has it after its first period."""
    words = b"a b a b a b a b a b a b c a b c a b c a b c a b c".split()
    runs = word_runs.text_runs(words)
    assert runs == [(0, 12, 2), (10, 15, 3)]
    assert word_runs.without_repeats(words, runs) == b"a b c".split()
