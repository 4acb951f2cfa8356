"""Merkle manifest of a dataset: coordinates by bitmap ranks, levels by keyed slot arrays.

A leaf is the hash of a row; the leaves of a group (language) stand in ascending
order of ids, every FAN consecutive nodes hash to one, and the group roots do the
same above. No table is sorted:

1. The ids of each group are set in compressed bitmaps, one per CHUNK of the id
   space: made per Arrow batch, merged per (group, chunk), as an array of low bits
   when sparse and as words with a popcount directory when dense. Row counts of the
   chunks add up over a tree of id prefixes with 2^16 children at most.
2. A row's slot is the base of its chunk plus its rank in the bitmap (popcounts).
   Rows that share an id, and rows without one, rank by leaf hash (``ranked``).
3. Rows are keyed by (group, slot // BLOCK) into slot arrays; each reduces by its
   levels to one node, keyed again, until one node of the group is left.
4. From the top down each block learns its path to the root; in the last step the
   blocks of leaves give every row its proof and the root that it folds to.

Defined cases: null fields are hashed as ``-`` (text, the empty text and length 0
differ); rows without a group form the first group; rows without an id stand
before all others; rows that share an id stand by leaf hash, equal rows in any
order; an empty table gives no rows and no root. Texts are hashed where they are
read and never shuffled. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from queuelens.llm.common import ranked, small_side, stored, table
from queuelens.llm.sql import CRC_TABLE, crc_of

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
FAN, LEVELS = 8, 3
#: Slots of one slot array: it reduces by LEVELS levels.
BLOCK = FAN ** LEVELS
CHUNK_BITS = 16
CHUNK = 1 << CHUNK_BITS
#: Ids of a chunk up to which an array of low bits is smaller than the words.
SPARSE = 4096
#: Chunk number of rows without an id: before those of all others.
NO_ID = -(1 << (63 - CHUNK_BITS)) - 1


def leaf_hash(docs: DataFrame, text: Column | None = None) -> Column:
    """Binary hash of the fields of a row, or of the row with another ``text``."""
    parts = []
    for name in FIELDS:
        value = (text if text is not None and name == "text" else docs[name]).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


# ---- bitmaps ---------------------------------------------------------------

def pack(lows: np.ndarray) -> bytes:
    """Compressed bitmap of sorted distinct low bits: themselves, or words and their popcount directory."""
    if len(lows) <= SPARSE:
        return lows.astype("<u2").tobytes()
    bits = np.zeros(CHUNK, np.uint8)
    bits[lows] = 1
    words = np.packbits(bits, bitorder="little").view("<u8")
    counts = np.bitwise_count(words).astype(np.int64)
    return words.tobytes() + (np.cumsum(counts) - counts).astype("<u2").tobytes()


def ranks(packed: bytes, lows: np.ndarray) -> np.ndarray:
    """How many ids of the bitmap are smaller than each of ``lows``."""
    if len(packed) <= 2 * SPARSE:
        return np.searchsorted(np.frombuffer(packed, "<u2"), lows).astype(np.int64)
    words = np.frombuffer(packed, "<u8", CHUNK // 64)
    directory = np.frombuffer(packed, "<u2", CHUNK // 64, offset=CHUNK // 8)
    low = lows.astype(np.uint64)
    below = words[low >> np.uint64(6)] & ((np.uint64(1) << (low & np.uint64(63))) - np.uint64(1))
    return directory[low >> np.uint64(6)].astype(np.int64) + np.bitwise_count(below)


def members(packed: bytes) -> np.ndarray:
    """The ids of a bitmap."""
    if len(packed) <= 2 * SPARSE:
        return np.frombuffer(packed, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8, CHUNK // 8), bitorder="little"))


def _extra_before(dup_lows: bytes, dup_extra: bytes, lows: np.ndarray) -> np.ndarray:
    """Rows beyond the first of each id, of ids smaller than each of ``lows``."""
    total = np.concatenate([[0], np.cumsum(np.frombuffer(dup_extra, "<i8"))])
    return total[np.searchsorted(np.frombuffer(dup_lows, "<u2"), lows)]


CONTAINER = "grp string, chunk long, bitmap binary, dup_lows binary, dup_extra binary, n long"


def _container(grp: str, chunk: int, lows: np.ndarray, copies: np.ndarray) -> tuple:
    lows, inverse = np.unique(lows, return_inverse=True)
    counts = np.zeros(len(lows), np.int64)
    np.add.at(counts, inverse, copies)
    more = counts > 1
    return (grp, chunk, pack(lows), lows[more].astype("<u2").tobytes(), (counts[more] - 1).astype("<i8").tobytes(), int(counts.sum()))


def _container_table(rows: list[tuple], kind=pa.RecordBatch):
    types = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
    names = ["grp", "chunk", "bitmap", "dup_lows", "dup_extra", "n"]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return kind.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def _batch_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of the ids of one Arrow batch."""
    for batch in batches:
        code = batch.column(0).dictionary_encode()
        names, grp = code.dictionary.to_pylist(), code.indices.to_numpy(zero_copy_only=False)
        chunk, low = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        order = np.lexsort((chunk, grp))
        edges = np.flatnonzero(np.diff(grp[order]) | np.diff(chunk[order])) + 1
        rows = [_container(names[grp[at[0]]], int(chunk[at[0]]), low[at], np.ones(len(at), np.int64))
                for at in np.split(order, edges) if len(at)]
        yield _container_table(rows)


def _merge_bitmaps(key: tuple, parts: pa.Table) -> pa.Table:
    lows, copies = [], []
    for bitmap, dups, extra in zip(*(parts.column(n).to_pylist() for n in ("bitmap", "dup_lows", "dup_extra")), strict=True):
        ids, again = members(bitmap), np.frombuffer(dups, "<u2")
        lows += [ids, again]
        copies += [np.ones(len(ids), np.int64), np.frombuffer(extra, "<i8")]
    row = _container(key[0].as_py(), key[1].as_py(), np.concatenate(lows).astype(np.int64), np.concatenate(copies))
    return _container_table([row], pa.Table)


def id_bitmaps(ids: DataFrame) -> DataFrame:
    """(grp, chunk, bitmap, .., n, base): the merged bitmaps of rows (grp, chunk, low), and the rows before each."""
    merged = stored(ids.select("grp", "chunk", "low").mapInArrow(_batch_bitmaps, CONTAINER)
                    .groupBy("grp", "chunk").applyInArrow(_merge_bitmaps, CONTAINER), "bitmaps")
    mid, high = F.shiftright("chunk", 16).alias("mid"), F.shiftright("chunk", 32).alias("high")
    leaves = merged.select("grp", "chunk", mid, high, "n")
    mids = leaves.groupBy("grp", "high", "mid").agg(F.sum("n").alias("n"))
    highs = mids.groupBy("grp", "high").agg(F.sum("n").alias("n"))

    def before(frame: DataFrame, within: list[str], by: str, name: str) -> DataFrame:
        return frame.withColumn(name, F.sum("n").over(Window.partitionBy(*within).orderBy(by)) - F.col("n")).drop("n")

    base = (before(leaves, ["grp", "high", "mid"], "chunk", "b0").join(before(mids, ["grp", "high"], "mid", "b1"), ["grp", "high", "mid"])
            .join(before(highs, ["grp"], "high", "b2"), ["grp", "high"])
            .select("grp", "chunk", (F.col("b0") + F.col("b1") + F.col("b2")).alias("base")))
    return stored(merged.join(base, ["grp", "chunk"]), "ranks")


# ---- slots -----------------------------------------------------------------

ROW = "grp string, chunk long, low int, leaf binary, seen binary"


def _slots(rows: pa.Table, bitmap: pa.Table) -> pa.Table:
    if not rows.num_rows:
        return rows.append_column("slot", pa.array([], pa.int64()))
    lows = rows.column("low").to_numpy().astype(np.int64)
    packed, dups, extra, base = (bitmap.column(n)[0].as_py() for n in ("bitmap", "dup_lows", "dup_extra", "base"))
    return rows.append_column("slot", pa.array(base + ranks(packed, lows) + _extra_before(dups, extra, lows), pa.int64()))


def _shared_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, chunk, low, first) of ids that several rows have, and of missing ids; ``first`` is their first slot."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            dups = np.frombuffer(r["dup_lows"], "<u2").astype(np.int64)
            at = np.zeros(1, np.int64) if r["chunk"] == NO_ID else dups
            first = r["base"] + ranks(r["bitmap"], at) + _extra_before(r["dup_lows"], r["dup_extra"], at)
            out += [(r["grp"], r["chunk"], int(x), int(f)) for x, f in zip(at, first, strict=True)]
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.int32(), pa.int64()], strict=True)],
            names=["grp", "chunk", "low", "first"])


def with_slots(rows: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Stored ``rows`` (ROW and part) with their slot in the group."""
    keys = ["grp", "chunk", "low"]
    several = bitmaps.where((F.octet_length("dup_lows") > 0) | (F.col("chunk") == NO_ID))
    alone, shared = rows.drop("part"), None
    if not several.isEmpty():
        first = stored(several.mapInArrow(_shared_ids, "grp string, chunk long, low int, first long"), "shared-ids")
        alone = alone.join(small_side(first), keys, "left_anti")
        again = stored(rows.join(small_side(first), keys), "shared-rows")
        shared = ranked(again, keys, "leaf", "turn_of_id").select(
            "grp", "chunk", "low", "leaf", "seen", (F.col("first") + F.col("turn_of_id")).alias("slot"))
    # A chunk holds CHUNK different ids at most, each once here.
    slots = alone.groupBy("grp", "chunk").cogroup(bitmaps.groupBy("grp", "chunk")).applyInArrow(_slots, f"{ROW}, slot long")
    return slots if shared is None else slots.unionByName(shared)


# ---- levels ----------------------------------------------------------------

def _hash(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def levels(nodes: list[bytes], whole: bool) -> list[bytes]:
    """The levels above and with ``nodes`` (hex digests), each joined to one string: LEVELS
    of them above, or as many as leave one node when the array is a ``whole`` group."""
    out, step = [b"".join(nodes)], 64 * FAN
    while len(out[-1]) > 64 if whole else len(out) <= LEVELS:
        last = out[-1]
        out.append(b"".join(_hash(last[i:i + step]) for i in range(0, len(last), step)))
    return out


def path_of(made: list[bytes], slot: int) -> list[bytes]:
    """Siblings left and right of a node of the array, level by level."""
    out = []
    for level in made[:-1]:
        run, at = slot // FAN * FAN * 64, slot * 64
        out += [level[run:at], level[at + 64:run + FAN * 64]]
        slot //= FAN
    return out


def _hexes(column: pa.Array) -> list[bytes]:
    return [x.hex().encode() for x in column.to_pylist()]


def _top_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tops = []
        for entries, n in zip(batch.column("entries"), batch.column("n").to_pylist(), strict=True):
            tops.append(bytes.fromhex(levels(_hexes(entries.values.field("node")), n <= BLOCK)[-1].decode()))
        yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("block"), batch.column("n"), pa.array(tops, pa.binary())],
                                         names=["grp", "block", "n", "node"])


def _keyed(nodes: DataFrame, name: str, *more: str) -> DataFrame:
    """Nodes (grp, slot, n, node) as stored slot arrays (grp, block, n, entries)."""
    return stored(nodes.groupBy("grp", F.expr(f"slot div {BLOCK}").alias("block")).agg(
        F.any_value("n").alias("n"), F.array_sort(F.collect_list(F.struct("slot", "node", *more))).alias("entries")), name)


def _reduced(first: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Slot arrays of all rounds above ``first``, and the one node of each group."""
    rounds = [first]
    while True:
        tops = stored(rounds[-1].mapInArrow(_top_nodes, "grp string, block long, n long, node binary"), "nodes")
        left = tops.select("grp", F.col("block").alias("slot"), F.ceil(F.col("n") / BLOCK).alias("n"), "node")
        if (left.agg(F.max("n")).first()[0] or 1) == 1:
            return rounds, left
        rounds.append(_keyed(left, "slots"))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Path of every node of slot arrays whose own node has ``path``."""
    for batch in batches:
        for r in batch.to_pylist():
            hexes = [e["node"].hex() for e in r["entries"]]
            made = levels([h.encode() for h in hexes], r["n"] <= BLOCK)
            paths = [[*(p.decode() for p in path_of(made, i)), *r["path"]] for i in range(len(hexes))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["grp"]] * len(hexes), pa.string()), pa.array([e["slot"] for e in r["entries"]], pa.int64()),
                 pa.array(hexes, pa.string()), pa.array([r["subroot"]] * len(hexes), pa.string()), pa.array(paths, pa.list_(pa.string()))],
                names=["grp", "block", "node", "subroot", "path"])


PATHS = "grp string, block long, node string, subroot string, path array<string>"


def _downwards(rounds: list[DataFrame], paths: DataFrame) -> DataFrame:
    """Paths (PATHS) of the nodes below the given ones, round by round."""
    for arrays in reversed(rounds):
        paths = stored(arrays.join(paths.select("grp", "block", "subroot", "path"), ["grp", "block"]).mapInArrow(_paths, PATHS), "paths")
    return paths


PROOFS = ("grp string, slot long, chunk long, low int, leaf string, subroot string, proof array<string>, "
          "proof_sha256 string, folded_root string")


def _prover(siblings: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                grp, n, subroot, upper = (batch.column(c)[k].as_py() for c in ("grp", "n", "subroot", "path"))
                entries = batch.column("entries")[k].values
                leaves, seen = _hexes(entries.field("node")), entries.field("seen").to_pylist()
                made, above, proof, hashed, folded = levels(leaves, n <= BLOCK), [p.encode() for p in upper], [], [], []
                for i, leaf in enumerate(leaves):
                    path = path_of(made, i) + above
                    proof.append([p.decode() for p in path] if siblings else None)
                    hashed.append(hashlib.sha256(b"".join(path)).hexdigest())
                    node = leaf if seen[i] is None else seen[i].hex().encode()
                    for at in range(0, len(path), 2):
                        node = _hash(path[at] + node + path[at + 1])
                    folded.append(node.decode())
                size = len(leaves)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([grp] * size, pa.string()), entries.field("slot"), entries.field("chunk"), entries.field("low"),
                     pa.array([x.decode() for x in leaves], pa.string()), pa.array([subroot] * size, pa.string()),
                     pa.array(proof, pa.list_(pa.string())), pa.array(hashed, pa.string()), pa.array(folded, pa.string())],
                    names=["grp", "slot", "chunk", "low", "leaf", "subroot", "proof", "proof_sha256", "folded_root"])

    return run


@dataclass
class Manifest:
    """Root of a dataset (None when it is empty), slot arrays of all rounds of the
    groups and of the groups' roots, and the groups in order."""

    root: str | None
    rounds: list[DataFrame]
    group_rounds: list[DataFrame]
    groups: DataFrame

    def proofs(self, siblings: bool = True) -> DataFrame:
        """One row per leaf: doc_id, grp, slot, leaf, subroot, proof (siblings left and
        right, level by level; null without ``siblings``), its hash, and the root
        folded from the leaf as seen."""
        top = self.groups.sparkSession.createDataFrame([("", 0, None, [])], "grp string, block long, subroot string, path array<string>")
        ends = _downwards(self.group_rounds, top)
        own = self.groups.join(ends.select(F.col("block").alias("place"), F.col("node").alias("subroot"), "path"), "place").select(
            "grp", F.lit(0).cast("long").alias("block"), "subroot", "path")
        above = _downwards(self.rounds[1:], own)
        found = self.rounds[0].join(above.select("grp", "block", "subroot", "path"), ["grp", "block"]).mapInArrow(_prover(siblings), PROOFS)
        doc_id = F.when(F.col("chunk") != NO_ID, F.shiftleft("chunk", CHUNK_BITS) + F.col("low"))
        return found.select(doc_id.alias("doc_id"), F.expr("substring(grp, 2)").alias("grp"), "slot", "leaf", "subroot", "proof",
                            "proof_sha256", "folded_root")


def build(docs: DataFrame, seen: Column | None = None) -> Manifest:
    """The manifest of ``docs``, by language. ``seen`` is the leaf that a later
    check found in a row (null: the same), which the proofs then fold."""
    doc_id = F.col("doc_id").cast("long")
    grp = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))        # null first, then by bytes
    seen = F.lit(None).cast("binary") if seen is None else seen
    rows = stored(docs.select(
        grp.alias("grp"), F.coalesce(F.shiftright(doc_id, CHUNK_BITS), F.lit(NO_ID)).alias("chunk"),
        F.coalesce(doc_id.bitwiseAND(CHUNK - 1), F.lit(0)).cast("int").alias("low"), leaf_hash(docs).alias("leaf"),
        seen.alias("seen"), F.spark_partition_id().alias("part")), "leaves")
    bitmaps = id_bitmaps(rows)
    totals = bitmaps.groupBy("grp").agg(F.sum("n").alias("n"))
    slots = with_slots(rows, bitmaps).join(small_side(stored(totals, "groups")), "grp").withColumnRenamed("leaf", "node")
    rounds, tops = _reduced(_keyed(slots, "slots", "seen", "chunk", "low"))
    # One row per group: their order needs no more than one window.
    groups = stored(tops.select("grp", "node", (F.row_number().over(Window.orderBy("grp")) - 1).cast("long").alias("place"),
                                F.count("*").over(Window.partitionBy()).alias("n")), "groups")
    group_rounds, top = _reduced(_keyed(groups.select(F.lit("").alias("grp"), F.col("place").alias("slot"), "n", "node"), "slots"))
    root = top.select(F.lower(F.hex("node"))).first()
    return Manifest(root[0] if root else None, rounds, group_rounds, groups.select("grp", "place"))


A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 0
    made = build(docs, F.when(tampered, leaf_hash(docs, F.translate(docs["text"], A_TO_Z, A_TO_Z.lower()))))
    root = F.lit(made.root)
    return made.proofs(siblings=False).select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root",
                                (F.col("folded_root") == root).alias("verified"), "slot")


def _field(name: str) -> str:
    return f"coalesce(octet_length(encode({name}::VARCHAR)) || ':' || {name}, '-')"


_LOWER = f"translate(text, '{A_TO_Z}', '{A_TO_Z.lower()}')"
_HEAD = " || ".join(_field(f) for f in FIELDS[:-1])
ORACLE = f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
leaves AS (
    SELECT doc_id, coalesce('=' || lang, '') AS grp, sha256({_HEAD} || {_field("text")}) AS leaf,
           sha256({_HEAD} || {_field(f"CASE WHEN {crc_of('encode(doc_id::VARCHAR)')} % 3 = 0 THEN {_LOWER} ELSE text END")}) AS seen
    FROM documents, crc),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves),
tree AS (
    SELECT grp, 0 AS level, idx, leaf AS node, count(*) OVER (PARTITION BY grp) AS n FROM placed
    UNION ALL
    SELECT grp, any_value(level) + 1, idx // {FAN}, sha256(string_agg(node, '' ORDER BY idx)), (any_value(n) + {FAN - 1}) // {FAN}
    FROM tree WHERE n > 1 GROUP BY grp, idx // {FAN}),
subroots AS (
    SELECT grp, node AS subroot, level AS depth, row_number() OVER (ORDER BY grp) - 1 AS place FROM tree WHERE n = 1),
top AS (
    SELECT 0 AS level, place AS idx, subroot AS node, count(*) OVER () AS n FROM subroots
    UNION ALL
    SELECT any_value(level) + 1, idx // {FAN}, sha256(string_agg(node, '' ORDER BY idx)), (any_value(n) + {FAN - 1}) // {FAN}
    FROM top WHERE n > 1 GROUP BY idx // {FAN}),
steps AS (
    SELECT a.grp, a.level, a.idx, coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
           coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
    FROM tree a JOIN tree b ON a.grp = b.grp AND a.level = b.level AND a.idx // {FAN} = b.idx // {FAN} WHERE a.n > 1 GROUP BY ALL
    UNION ALL
    SELECT s.grp, a.level + s.depth, any_value(a.idx), coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx < a.idx), ''),
           coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '')
    FROM subroots s JOIN top a ON a.idx = s.place // ({FAN} ** a.level)::BIGINT JOIN top b ON a.level = b.level AND a.idx // {FAN} = b.idx // {FAN}
    WHERE a.n > 1 GROUP BY s.grp, a.level, s.depth),
walk AS (
    SELECT p.doc_id, p.grp, p.idx AS slot, 0 AS level, p.idx, p.seen AS node, '' AS proof FROM placed p
    UNION ALL
    SELECT w.doc_id, w.grp, w.slot, w.level + 1,
           CASE WHEN w.level + 1 < depth THEN w.idx // {FAN} WHEN w.level + 1 = depth THEN place ELSE w.idx // {FAN} END,
           sha256(l || w.node || r), proof || l || r
    FROM (SELECT walk.*, CASE WHEN level = 0 AND depth = 0 THEN place ELSE idx END AS at, depth, place FROM walk JOIN subroots USING (grp)) w
    JOIN steps ON steps.grp = w.grp AND steps.level = w.level AND steps.idx = w.at),
folded AS (
    SELECT doc_id, slot, grp, arg_max(node, level) AS folded_root, sha256(arg_max(proof, level)) AS proof_sha256 FROM walk GROUP BY ALL),
root AS (SELECT node AS root FROM top WHERE n = 1)
SELECT f.doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified, slot
FROM folded f JOIN placed p ON p.grp = f.grp AND p.idx = f.slot JOIN subroots ON subroots.grp = f.grp, root
"""
