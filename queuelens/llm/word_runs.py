"""Periodic runs of words, found on a grammar of each text.

A run is a stretch of words with smallest period q, of at least MIN_RUN words
and two periods, that no neighbouring word extends. Per text:

1. Re-Pair: the most frequent pair of neighbouring symbols becomes a new symbol
   until no pair occurs twice (older pairs first among equals, which keeps the
   rules shallow). What is left at the top is cut in halves down to symbols.
2. For each rule X -> Y Z, at one place, and each top node, the periodic
   stretches inside X that touch the seam of Y and Z: for each distance q from
   the seam, the common extensions of both sides (names of blocks of doubled
   lengths, all pairs of a portion at once). Each run of the text touches the seam
   of the smallest node around it, so no run is missed.
3. The stretches of a rule move to all places where it is derived; stretches of
   one period that overlap by a period merge, and of equal stretches the
   smallest period stays.

A run holds some GRAM words twice, so texts without a repeated GRAM need no
grammar. Texts are worked on one at a time; memory is linear in the words of a
text (its blocks need 4 bytes a word and doubling).

Defined cases: null and empty texts have no words and no run; a text of one
repeated word is one run of period 1; rows with equal ids or texts each give
their row; an empty table gives no rows; extra input columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens.llm.common import table
from queuelens.llm.sql import CRC_TABLE, crc_of

MIN_RUN = 12
#: Words that every run holds at two places: MIN_RUN - q for short periods q, q for others.
GRAM = MIN_RUN // 2
#: Pairs of positions compared at once.
PORTION = 1 << 20


def repair(ids: list[int], fresh: int) -> tuple[list[int], list[int], list[tuple[int, int]]]:
    """Re-Pair of ``ids``, whose new symbols count up from ``fresh``: the starts
    and symbols of the top sequence, and the pair behind each new symbol."""
    n = len(ids)
    symbol, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], list[int]] = {}
    for i, pair in enumerate(zip(ids, ids[1:], strict=False)):
        places.setdefault(pair, []).append(i)
    queue = [(-len(at), age, pair) for age, (pair, at) in enumerate(places.items()) if len(at) > 1]
    heapify(queue)
    age, rules = len(places), []
    while queue:
        count, old, pair = heappop(queue)
        there = [i for i in places[pair] if symbol[i] == pair[0] and after[i] < n and symbol[after[i]] == pair[1]]
        live, taken = [], -1
        for i in there:                 # the places that do not overlap, from the left
            if i != taken:
                live.append(i)
                taken = after[i]
        if len(live) < 2:
            continue
        if len(live) < -count:          # it lost places to other pairs: back into the queue
            places[pair] = there
            heappush(queue, (-len(live), old, pair))
            continue
        new, made = fresh + len(rules), {}
        rules.append(pair)
        for i in live:
            j = after[i]
            k, h = after[j], before[i]
            symbol[i], symbol[j], after[i] = new, -1, k
            if k < n:
                before[k] = i
                made.setdefault((new, symbol[k]), []).append(i)
            if h >= 0:
                made.setdefault((symbol[h], new), []).append(h)
        for p, at in made.items():
            if len(at) > 1:
                places[p] = at
                heappush(queue, (-len(at), age, p))
                age += 1
    top = [i for i in range(n) if symbol[i] >= 0]
    return top, [symbol[i] for i in top], rules


class Blocks:
    """Common extensions of positions of one word sequence."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self.names = [ids]
        while True:
            last, step = self.names[-1], 1 << (len(self.names) - 1)
            if len(last) <= step:
                break
            _, name = np.unique(last[:-step].astype(np.int64) * self.n + last[step:], return_inverse=True)
            if name.max() + 1 == len(name):     # no block of this length twice
                break
            self.names.append(name.astype(np.int32))

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from positions i and j (i < j) on."""
        total = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name, step = self.names[k], 1 << k
            ok = np.flatnonzero(j + total + step <= self.n)
            total[ok] += step * (name[i[ok] + total[ok]] == name[j[ok] + total[ok]])
        return total

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words before positions i and j (i < j)."""
        total = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name, step = self.names[k], 1 << k
            ok = np.flatnonzero(i - total - step >= 0)
            total[ok] += step * (name[i[ok] - total[ok] - step] == name[j[ok] - total[ok] - step])
        return total


def _halves(starts: list[int], n: int) -> Iterator[tuple[int, int, int]]:
    """Nodes (from, seam, to) of a balanced tree over the top sequence."""
    bounds = [*starts, n]
    open_ = [(0, len(starts))]
    while open_:
        a, b = open_.pop()
        if b - a > 1 and bounds[b] - bounds[a] >= MIN_RUN:
            mid = (a + b) // 2
            yield bounds[a], bounds[mid], bounds[b]
            open_ += [(a, mid), (mid, b)]


def _stretches(blocks: Blocks, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, from, to, period) of the long periodic stretches inside each node that touch its seam."""
    n, two = blocks.n, blocks.names[1] if len(blocks.names) > 1 else None
    found = [np.empty((4, 0), np.int64)]
    if two is None:
        return tuple(found[0])
    same = np.concatenate([two, np.arange(-3, -1)])     # two-word names; both ends have none in common
    for right in (True, False):
        spans = (nodes[:, 2] - nodes[:, 1]) if right else (nodes[:, 1] - nodes[:, 0])
        upto = np.cumsum(spans)
        first = 0
        while first < len(nodes):
            last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + PORTION, "right")))
            size = spans[first:last]
            node = np.repeat(np.arange(first, last), size)
            q = np.arange(len(node)) - np.repeat(np.cumsum(size) - size, size) + 1
            seam = nodes[node, 1]
            i, j = (seam, seam + q) if right else (seam - q, seam)
            # Six or more equal words lie around (i, j): two of them right after or right before.
            near = (same[i] == same[np.minimum(j, n)]) | ((i >= 2) & (same[i - 2] == same[j - 2]))
            node, q, i, j = node[near], q[near], i[near], j[near]
            start = i - np.minimum(blocks.backward(i, j), i - nodes[node, 0])
            stop = j + np.minimum(blocks.forward(i, j), nodes[node, 2] - j)
            good = stop - start >= np.maximum(2 * q, MIN_RUN)
            found.append(np.stack([node[good], start[good], stop[good], q[good]]))
            first = last
    return tuple(np.concatenate(found, axis=1))


def _smallest(key: np.ndarray, start: np.ndarray, stop: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Indexes that keep the smallest period of equal stretches."""
    order = np.lexsort((q, stop, start, key))
    k, a, b = key[order], start[order], stop[order]
    head = np.ones(len(order), bool)
    head[1:] = (k[1:] != k[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order[head]


def runs_of(ids: list[int], alphabet: int) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of ids below ``alphabet``, in order."""
    n = len(ids)
    if n < MIN_RUN or len(set(zip(*(ids[k:] for k in range(GRAM)), strict=False))) == n - GRAM + 1:
        return []
    starts, symbols, rules = repair(ids, alphabet)
    length = [1] * alphabet
    for a, b in rules:
        length.append(length[a] + length[b])
    # Places of the symbols that may hold a run, from the newest rule down.
    at: dict[int, list[np.ndarray]] = {}
    for p, s in zip(starts, symbols, strict=True):
        if length[s] >= MIN_RUN:
            at.setdefault(s, []).append(np.array([p]))
    nodes, places = [], []
    for r in range(len(rules) - 1, -1, -1):
        s, (a, b) = alphabet + r, rules[r]
        if length[s] >= MIN_RUN:
            here = np.concatenate(at.pop(s))
            nodes.append((here[0], here[0] + length[a], here[0] + length[s]))
            places.append(here - here[0])
            for child, shift in ((a, 0), (b, length[a])):
                if length[child] >= MIN_RUN:
                    at.setdefault(child, []).append(here + shift)
    top = list(_halves(starts, n))
    nodes += top
    places += [np.zeros(1, np.int64)] * len(top)
    if not nodes:
        return []
    node, start, stop, q = _stretches(Blocks(np.array(ids, np.int32)), np.array(nodes, np.int64))
    keep = _smallest(node, start, stop, q)
    node, start, stop, q = node[keep], start[keep], stop[keep], q[keep]
    times = np.array([len(p) for p in places])[node]
    shift = np.concatenate([places[k] for k in node.tolist()]) if len(node) else np.empty(0, np.int64)
    start, stop, q = (np.repeat(x, times) for x in (start, stop, q))
    return _merged(start + shift, stop + shift, q)


def _merged(start: np.ndarray, stop: np.ndarray, q: np.ndarray) -> list[tuple[int, int, int]]:
    """Maximal stretches: one period's merge where they overlap by a period."""
    if not len(q):
        return []
    order = np.lexsort((start, q))
    start, stop, q = start[order], stop[order], q[order]
    whole = []
    a, b, p = int(start[0]), int(stop[0]), int(q[0])
    for s, e, r in zip(start.tolist(), stop.tolist(), q.tolist(), strict=True):
        if r == p and s <= b - p:
            b = max(b, e)
        else:
            whole.append((a, b, p))
            a, b, p = s, e, r
    whole.append((a, b, p))
    a, b, p = np.array(whole, np.int64).T
    keep = _smallest(np.zeros(len(p), np.int64), a, b, p)
    return sorted(zip(a[keep].tolist(), (b[keep] - a[keep]).tolist(), p[keep].tolist(), strict=True),
                  key=lambda r: (r[0], r[2]))


def text_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a list of words."""
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    return runs_of(ids, len(number))


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, deep in zip(words, np.cumsum(change[:-1]).tolist(), strict=True) if not deep]


def as_is(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    return words


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document with the repetitions of the query's contract."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


#: Rows, and bytes of text, in one batch handed back to Spark.
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 25


def _run_batches(prepare: Callable[[int | None, list[bytes]], list[bytes]]):
    def batch_of(ids: list, found: list, kept: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(found, pa.list_(RUN)), pa.array(kept, pa.string())],
            names=["doc_id", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found, kept, size = [], [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = prepare(doc_id, (text.as_py() or "").encode().split())      # bytes: ASCII white space only
                runs = text_runs(words)
                ids.append(doc_id)
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                kept.append(b" ".join(without_repeats(words, runs)).decode())
                size += len(kept[-1])
                if len(ids) == BATCH_ROWS or size > BATCH_BYTES:
                    yield batch_of(ids, found, kept)
                    ids, found, kept, size = [], [], [], 0
            yield batch_of(ids, found, kept)

    return run


def find_runs(docs: DataFrame, prepare: Callable[[int | None, list[bytes]], list[bytes]] = as_is) -> DataFrame:
    """(doc_id, runs, collapsed) of every document: its runs in order and its
    text without the repeated periods, words joined by single spaces."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _run_batches(prepare),
        "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(table(spark, sf_dir, "documents"), planted)
    line = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = F.reduce(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)),
                    lambda a, r: F.when(r["length"] > a["length"], r).otherwise(a))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(F.try_divide(1000 * F.col("best.length"), F.col("best.period"))).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


ORACLE = f"""
WITH crc AS ({CRC_TABLE}),
parts AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
           {crc_of("encode(doc_id::VARCHAR)")} AS h
    FROM documents, crc),
places AS (
    SELECT *, len(words) AS n, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN (h // 10) % len(words) END AS a FROM parts),
planted AS (
    SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM places),
w AS (
    SELECT doc_id, i, words[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS word
    FROM (SELECT *, unnest(range(n)) AS i FROM planted)),
equal AS (
    SELECT x.doc_id, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i),
stretches AS (
    SELECT doc_id, q, min(i) AS start, count(*) + q AS length
    FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal)
    GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(12, 2 * q)),
runs AS (
    SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length),
totals AS (
    SELECT doc_id, count(*) AS n_runs, arg_max(struct_pack(s := start, n := length, q := period),
                                               [length, -start, -period]) AS best,
           string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
    FROM runs GROUP BY doc_id),
dropped AS (
    SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM w ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.n AS length, best.q AS period,
       1000 * best.n // best.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN totals USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
