"""Manifest against a plain tree, bitmaps against sorted lists, defined cases."""

import collections
import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from queuelens.llm import merkle


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain(rows):
    """root and {(doc_id, leaf): [(subroot, proof)]} of (doc_id, source, lang, n_chars, text) rows."""
    def climb(level, paths):
        """paths: {name: index} below ``level``; gives the root and the siblings of each name."""
        proof = {k: [] for k in paths}
        while len(level) > 1:
            for k, i in paths.items():
                run = i // 8 * 8
                proof[k] += level[run:i] + level[i + 1:run + 8]
            paths = {k: i // 8 for k, i in paths.items()}
            level = [sha("".join(level[i:i + 8])) for i in range(0, len(level), 8)]
        return level[0], proof

    by_lang = collections.defaultdict(list)
    for r in rows:
        by_lang[r[2]].append((r[0] is not None, r[0] or 0, leaf_of(r), r[0]))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: climb([e[2] for e in sorted(by_lang[x])], dict(enumerate(range(len(by_lang[x]))))) for x in langs}
    root, above = climb([own[x][0] for x in langs], {x: i for i, x in enumerate(langs)})
    out = collections.defaultdict(list)
    for x in langs:
        for i, e in enumerate(sorted(by_lang[x])):
            out[e[3], e[2]].append((own[x][0], own[x][1][i] + above[x]))
    return root, out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, chunk int, grp string, n long, node string"


def some_rows(n, seed):
    rnd = random.Random(seed)
    ids = [lambda: rnd.randint(0, 3000), lambda: rnd.randint(-2**63, 2**63 - 1), lambda: rnd.choice([None, 5, 5, 70_000]),
           lambda: rnd.randint(-70_000, 70_000)]
    return [(rnd.choice(ids)(), rnd.choice([None, "", "s"]), rnd.choice([None, "", "en", "en", "en", "en", "é"]), rnd.choice([None, 1]),
             rnd.choice([None, "", "Text", f"T{rnd.randint(0, 5)}"])) for _ in range(n)]


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "g", 2, "x") for r in rows], SCHEMA).repartition(5)
    seen = F.when(F.col("n_chars").isNotNull(), merkle.leaf_hash(docs, F.lower("text")))
    made = merkle.build(docs, seen)
    root, want = plain(rows)
    assert made.root == root
    got = made.proofs().collect()
    assert len(got) == len(rows)
    found = collections.defaultdict(list)
    for r in got:
        siblings = "".join(r["proof"])
        assert r["proof_sha256"] == sha(siblings)
        found[r["doc_id"], r["leaf"]].append((r["subroot"], siblings))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted((s, "".join(p)) for s, p in v) for k, v in want.items()}
    text_of = {(r[0], leaf_of(r)): r for r in rows}
    for r in got:
        row = text_of[r["doc_id"], r["leaf"]]
        changed = row[3] is not None and row[4] is not None and row[4] != row[4].lower()
        assert (r["folded_root"] == root) == (not changed)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["subroot"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_manifest_by_a_plain_tree(spark):
    for n, seed in [(1, 1), (9, 2), (700, 3), (2500, 4)]:
        check(spark, some_rows(n, seed))


def test_many_groups(spark):
    check(spark, [(i, "s", f"l{i % 90}", i, "T") for i in range(600)])


def test_hot_id_and_equal_rows(spark):
    check(spark, [(7, "s", "en", 1, "same")] * 900 + [(7, "s", "en", 1, f"T{i}") for i in range(300)] + [(None, None, None, None, None)] * 20
          + [(i, "s", "en", 1, "long " * 50_000) for i in range(3)])


def test_empty_table(spark):
    made = merkle.build(spark.createDataFrame([], SCHEMA))
    assert made.root is None and made.proofs().count() == 0


def test_bitmaps_by_sorted_lists():
    rnd = np.random.default_rng(1)
    for size in (0, 1, 50, merkle.SPARSE, merkle.SPARSE + 1, 30_000, merkle.CHUNK):
        lows = np.sort(rnd.choice(merkle.CHUNK, size, replace=False))
        packed = merkle.pack(lows)
        asked = np.arange(merkle.CHUNK)
        assert (merkle.ranks(packed, asked) == np.searchsorted(lows, asked)).all() and (merkle.members(packed) == lows).all()


def test_dense_ids(spark):
    """Whole chunks of the id space, whose bitmaps are words with a directory, in two rounds of slot arrays."""
    docs = spark.range(-70_000, 70_000, 1, 6).select(
        F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).cast("long").alias("n_chars"),
        F.lit("T").alias("text"))
    got = merkle.build(docs).proofs(siblings=False).select("slot", "doc_id").collect()
    assert sorted((r["slot"], r["doc_id"]) for r in got) == list(enumerate(range(-70_000, 70_000)))
