"""Which content-defined anchors of a document also occur in other documents.

Both substring operators cut a text into regions by minimizers: an anchor is a
64-bit minimum hash, and its region is the run of window starts that share
it. Equal windows have equal minimizers, so repeated windows meet under one
anchor. This module finds, without moving any text, which anchors need work:

* ``copy``: the region as a whole (by a 64-bit digest) also lies in a document
  with a smaller id;
* ``ask``: the region is the first of its kind, but other documents hold
  different regions under the same anchor, so its windows must be compared;
* ``hot``: as ``ask``, for an anchor with very many different regions. Its
  windows are compared by a keyed aggregation rather than in one task;
* ``first`` (where asked for): the first of a region that has copies and needs
  no other work.

Entries travel as packed arrays, dealt out by anchor. Repeats are combined
inside each batch first: of equal regions only the smallest id is sent on, and
an anchor with many different regions in one batch is called hot at once.
Documents are told apart by id and a checksum of the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens.llm.shingles import slices

COPY, ASK, HOT, FIRST = 0, 1, 2, 3
#: Different regions of an anchor above which it is hot: in a batch, and in all.
HOT_IN_BATCH, HOT_IN_ALL = 16, 2000
_OPEN, _MARK = -1, np.uint32(0xFFFFFFFF)
#: Set in an entry's index: its region has copies inside the entry's batch.
_COPIED = np.uint32(1 << 31)
#: Documents packed together.
CHUNK_ROWS = 2000
ENTRY = np.dtype([("doc", "<i8"), ("crc", "<u4"), ("idx", "<u4")])

PACKED = "bucket int, kind int, a binary, g binary, entry binary"
VERDICTS = "doc_id long, crc long, kind int, idx binary"


def _groups(a: np.ndarray, g: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
    """Order by (anchor, region, id); first-of-region and first-of-anchor flags."""
    order = np.argsort(a)
    a = a[order]
    tied = np.r_[False, a[1:] == a[:-1]]
    at = np.flatnonzero(tied | np.r_[tied[1:], False])      # only entries of one anchor need the other keys
    among = order[at]
    order[at] = among[np.lexsort((e["doc"][among], g[among], a[at]))]
    g, e = g[order], e[order]
    new_a = np.r_[True, a[1:] != a[:-1]]
    new_g = new_a | np.r_[True, g[1:] != g[:-1]]
    return a, g, e, new_a, new_g


def _spread(flags: np.ndarray) -> np.ndarray:
    """Position of the group's first row, for every row."""
    return np.maximum.accumulate(np.where(flags, np.arange(len(flags)), 0))


def resolve(a: np.ndarray, g: np.ndarray, e: np.ndarray, firsts: bool) -> tuple[np.ndarray, np.ndarray]:
    """Entries and verdicts of whole anchor groups (marks included)."""
    marks = e["idx"] == _MARK
    hot_anchors = np.unique(a[marks])
    a, g, e = a[~marks], g[~marks], e[~marks]
    if not len(a):
        return e, np.empty(0, np.int32)
    a, g, e, new_a, new_g = _groups(a, g, e)
    of_a = np.cumsum(new_a) - 1
    regions = np.bincount(of_a, new_g)
    starts = np.flatnonzero(new_a)
    low, high = np.minimum.reduceat(e["doc"], starts), np.maximum.reduceat(e["doc"], starts)
    marked = np.isin(a[starts], hot_anchors)
    copy = e["doc"] > e["doc"][_spread(new_g)]
    work = ~copy & ((((low < high) & (regions > 1)) | marked)[of_a])
    hot = ((regions > HOT_IN_ALL) | marked)[of_a]
    kind = np.where(copy, COPY, np.where(hot, HOT, ASK)).astype(np.int32)
    chosen = copy | work
    if firsts:
        of_g = np.cumsum(new_g) - 1
        copied = np.maximum.reduceat(copy | (e["idx"] & _COPIED > 0), np.flatnonzero(new_g))[of_g]
        kind[copied & ~chosen] = FIRST
        chosen |= copied
    e["idx"] &= ~_COPIED
    return e[chosen], kind[chosen]


def _combine(a: np.ndarray, g: np.ndarray, e: np.ndarray):
    """Inside one batch: (open entries, settled entries with their kinds)."""
    a, g, e, new_a, new_g = _groups(a, g, e)
    of_a, of_g = np.cumsum(new_a) - 1, np.cumsum(new_g) - 1
    hot = (np.bincount(of_a, new_g) > HOT_IN_BATCH)[of_a]
    copy = e["doc"] > e["doc"][_spread(new_g)]
    settled = copy | hot
    kind = np.where(copy, COPY, HOT).astype(np.int32)[settled]
    mark = e[hot & new_a].copy()
    mark["idx"] = _MARK
    left = ~settled
    e["idx"][left & np.maximum.reduceat(copy, np.flatnonzero(new_g))[of_g]] |= _COPIED
    return (np.r_[a[left], a[hot & new_a]], np.r_[g[left], g[hot & new_a]], np.r_[e[left], mark]), (e[settled], kind)


def pack(find: Callable, buckets: int):
    """Arrow function over (doc_id, text): ``find(texts)`` gives (row, anchor,
    digest, index in its text) arrays; rows go out per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        for batch in slices(batches, CHUNK_ROWS):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            row, a, g, idx = find(texts)
            if not len(row):
                continue
            e = np.empty(len(row), ENTRY)
            e["doc"] = batch.column(0).to_numpy()[row]
            e["crc"] = np.fromiter(map(crc32, texts), np.uint32, len(texts))[row]
            e["idx"] = idx
            (a, g, e), (done, kinds) = _combine(a, g, e)
            out = []
            spot = (a % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(spot, kind="stable")
            a, g, e, spot = a[order], g[order], e[order], spot[order]
            cuts = np.r_[np.flatnonzero(np.r_[True, spot[1:] != spot[:-1]]), len(spot)] if len(spot) else [0]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                out.append((int(spot[i]), _OPEN, a[i:j].tobytes(), g[i:j].tobytes(), e[i:j].tobytes()))
            for kind in (COPY, HOT):
                part = done[kinds == kind]
                if len(part):
                    out.append((int(part["doc"][0] % buckets), kind, b"", b"", part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (
                    pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)],
                names=["bucket", "kind", "a", "g", "entry"])

    return run


def _by_document(e: np.ndarray, kind: np.ndarray) -> pa.Table:
    order = np.lexsort((e["idx"], kind, e["crc"], e["doc"]))
    e, kind = e[order], kind[order]
    new = np.r_[True, (e["doc"][1:] != e["doc"][:-1]) | (e["crc"][1:] != e["crc"][:-1]) | (kind[1:] != kind[:-1])]
    starts = np.flatnonzero(new) if len(e) else np.empty(0, int)
    ends = np.r_[starts[1:], len(e)] if len(e) else starts
    idx = np.ascontiguousarray(e["idx"])
    return pa.table({"doc_id": pa.array(e["doc"][starts], pa.int64()), "crc": pa.array(e["crc"][starts].astype(np.int64)),
                     "kind": pa.array(kind[starts], pa.int32()),
                     "idx": pa.array([idx[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary())})


def _resolve_bucket(block: pa.Table, firsts: bool) -> pa.Table:
    kinds = block.column("kind").to_numpy()
    joined = {n: [x or b"" for x in block.column(n).to_pylist()] for n in ("a", "g", "entry")}
    opened = np.flatnonzero(kinds == _OPEN)

    def cat(name: str, rows: np.ndarray, dtype) -> np.ndarray:
        return np.frombuffer(b"".join(joined[name][i] for i in rows), dtype)

    parts = [resolve(cat("a", opened, "<u8"), cat("g", opened, "<u8"), cat("entry", opened, ENTRY), firsts)]
    for kind in (COPY, HOT):
        e = cat("entry", np.flatnonzero(kinds == kind), ENTRY)
        parts.append((e, np.full(len(e), kind, np.int32)))
    return _by_document(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def anchor_verdicts(docs: DataFrame, find: Callable, buckets: int, firsts: bool = False) -> DataFrame:
    """(doc_id, crc, kind, idx): for each document the indexes (packed 32-bit)
    of its anchors that are copies, asks, hot or (``firsts``) first. ``docs``: doc_id, text."""
    packed = docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(pack(find, buckets), PACKED)
    return packed.groupBy("bucket").applyInArrow(lambda block: _resolve_bucket(block, firsts), VERDICTS)


def bucket_count(docs: DataFrame, bytes_each: int) -> int:
    """Buckets so that each stands for about ``bytes_each`` bytes of text."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(48, total // bytes_each + 1)
