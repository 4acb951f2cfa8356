"""Near-duplicate documents by SetSketch registers.

Every document becomes its set of shingle hashes and a sketch: for each of
BANDS * ROWS hash functions the minimum over the set, turned into an
exponential variate and truncated to an exponentially spaced 16-bit register,
floor(1 - log_b x). Registers of a union are the maxima of the registers, and
equal registers are as likely as the sets are similar. Steps:

1. Documents with equal sets collapse into one class (its smallest id).
2. Bands of registers are bucket keys of the classes. The hub of a bucket is the
   member whose buckets hold most members (the base of near copies, not just
   any copy). Each class is paired with the two hubs it shares most buckets with.
3. The similarity of these pairs is estimated from their registers by the joint
   likelihood with the known set sizes; pairs that are far less likely at the
   threshold than at the best estimate go. The rest is verified on full sets.
4. Verified links give components. Buckets that still hold several components are
   searched in full, on full sets: all members outside the bucket's main component
   against all members of other components, in tasks of bounded size. A task finds
   pairs by the shingles of their prefixes (rarest first in the task; two near sets
   always share one), confirms each exactly, keeps a union-find of the components
   it has met, and gives out a spanning forest: at most a link per component it
   read. So pairs dropped in step 3 are found here. A pair shares several buckets
   as a rule; it is searched for in that of its first common band, and full sets are sent
   there for those members alone that agree with some other component's in as many
   registers as a near pair does.

A pair at the threshold shares no band with probability (1 - 0.8^5)^48 < 1e-8, and
agrees in too few registers with probability below 1e-9, which is all that can be
missed. Spent tables are deleted as the steps go on.

Defined cases: a text without words has an empty set and is linked with
nothing; documents without an id are linked with nothing and stay (their
component is null); rows that share an id are one document with several
texts and so lie in one component; an empty table gives no rows. Extra input
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from queuelens.llm.common import discard, stored, table, text_batches
from queuelens.llm.components import components
from queuelens.llm.shingles import set_key, shingle_sets, slices

BANDS, ROWS = 48, 5
BASE = 1.001
RATE = 20.0
MIN_PERCENT = 80
#: Log-likelihood by which the best estimate must beat the threshold to drop a pair.
LIKELIHOOD_GAP = 10.0
#: Hubs tried per class, and classes compared with a hub in one task.
HUBS, HUB_ROWS = 2, 1000
#: Shingles per block in the full search of a bucket (8 bytes each).
BLOCK_SHINGLES = 1 << 19
#: Chance that a pair at the threshold agrees in fewer registers than the search asks for.
MISS = 1e-9
#: Registers compared first.
FIRST_REGISTERS = 60

_RNG = np.random.default_rng(20240607)
_A = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers (16 bits) of a non-empty set of 64-bit hashes."""
    low = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 1024):
        np.minimum(low, (short[i:i + 1024, None] * _A + _B).min(axis=0), out=low)
    x = -np.log1p(-(low + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 65535).astype(np.uint16)


def _sketch_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column(1), width)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in sets], pa.int64()),
                 pa.array([set_key(x) if len(x) else None for x in sets], pa.binary()),
                 pa.array([registers(x).tobytes() if len(x) else None for x in sets], pa.binary())],
                names=["doc_id", "n_shingles", "set_key", "registers"])

    return run


def _set_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column(1), width)
            for i in range(0, len(sets), 256):
                some = sets[i:i + 256]
                ends = np.cumsum([0, *map(len, some)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, len(some)), pa.array([set_key(x) for x in some], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(some).view(np.int64)))],
                    names=["doc_id", "set_key", "hashes"])

    return run


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, min_percent: int) -> np.ndarray:
    """Which register pairs (rows of ``a`` and ``b``) may reach the threshold.

    With u, v the shares of the set sizes, a register of one set is above the
    other's with probability p(u - vJ) or p(v - uJ), p(x) = -log_b(1 - x(b-1)/b).
    """
    ratio = np.minimum(n_a, n_b) * 100 >= min_percent * np.maximum(n_a, n_b)
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - above - below
    u = (n_a / (n_a + n_b))[:, None]
    grid = np.linspace(0, 1, 101)[None, :]

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = p(u - (1 - u) * grid), p((1 - u) - u * grid)
    score = (above[:, None] * np.log(up) + below[:, None] * np.log(down)
             + same[:, None] * np.log(np.clip(1 - up - down, 1e-9, 1)))
    possible = grid <= np.minimum(u / (1 - u), (1 - u) / u) + 0.01
    score = np.where(possible, score, -np.inf)
    near = score[:, grid[0] >= min_percent / 100 - 1e-9].max(axis=1)
    return ratio & (near >= score.max(axis=1) - LIKELIHOOD_GAP)


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), BANDS * ROWS)


def _hub_filter(min_percent: int):
    """Of the classes of a hub's task, those that may reach the threshold with it by their registers."""
    def run(rows: pa.Table) -> pa.Table:
        node, size = rows.column("node").to_numpy(), rows.column("n_shingles").to_numpy().astype(float)
        regs, is_hub = _rows(rows.column("registers").combine_chunks()), rows.column("is_hub").to_numpy(zero_copy_only=False)
        hub, other = int(np.flatnonzero(is_hub)[0]), np.flatnonzero(~is_hub)
        ok = likely(np.broadcast_to(regs[hub], (len(other), regs.shape[1])), regs[other], np.full(len(other), size[hub]),
                    size[other], min_percent)
        near = node[other[ok]]
        return pa.table({"node": near, "hub": np.full(len(near), node[hub])})

    return run


def _near(a: np.ndarray, b: np.ndarray, min_percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= min_percent * (len(a) + len(b) - both)


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    lists = column.combine_chunks()
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _hub_verify(min_percent: int):
    """Of the classes of a hub's task, those whose full sets reach the threshold with the hub's."""
    def run(rows: pa.Table) -> pa.Table:
        node, sets = rows.column("node").to_numpy(), _arrays(rows.column("hashes"))
        is_hub = rows.column("is_hub").to_numpy(zero_copy_only=False)
        hub = int(np.flatnonzero(is_hub)[0])
        near = node[[k for k in np.flatnonzero(~is_hub) if _near(sets[k], sets[hub], min_percent)]]
        return pa.table({"a": near, "b": np.full(len(near), node[hub])}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def spanning_links(sets: list[np.ndarray], component: np.ndarray, query: np.ndarray, member: np.ndarray,
                   min_percent: int) -> list[tuple[int, int]]:
    """Pairs (row of a query, row of a member) of near sets that join all components
    which some near pair of a query and a member joins: a spanning forest."""
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.lexsort((np.arange(len(count)), count))] = np.arange(len(count))      # rarest first
    value = rank[token]
    order = np.lexsort((value, owner))
    value, single = value[order], (count[token] == 1)[order]
    begin = np.cumsum(sizes) - sizes
    ranked = [value[a:a + n] for a, n in zip(begin.tolist(), sizes.tolist(), strict=True)]
    prefix = sizes + (-min_percent * sizes) // 100 + 1
    used = (np.arange(len(value)) - begin[owner] < prefix[owner]) & ~single
    probes = [value[a:a + n][used[a:a + n]] for a, n in zip(begin.tolist(), sizes.tolist(), strict=True)]
    listed = used & member[owner]
    by_value = np.argsort(value[listed], kind="stable")
    index, who = value[listed][by_value], owner[listed][by_value]
    label = np.unique(component, return_inverse=True)[1]
    links = []
    for q in np.flatnonzero(query).tolist():
        lo, hi = np.searchsorted(index, probes[q], "left"), np.searchsorted(index, probes[q], "right")
        size = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        met, times = np.unique(who[at], return_counts=True)
        fits = ((label[met] != label[q]) & (np.minimum(sizes[met], sizes[q]) * 100 >= min_percent * np.maximum(sizes[met], sizes[q])))
        for m in met[fits][np.argsort(-times[fits], kind="stable")].tolist():     # most shared first
            if label[m] != label[q] and _near(ranked[q], ranked[m], min_percent):
                links.append((q, m))
                label[label == label[m]] = label[q]
    return links


def search_block(min_percent: int):
    """A task of ``open_tasks``: a spanning forest of links (a, b) between its components."""
    def run(block: pa.Table) -> pa.Table:
        node, component, role = (block.column(n).to_numpy() for n in ("node", "component", "role"))
        links = spanning_links(_arrays(block.column("hashes")), component, role != MEMBER, role != QUERY, min_percent)
        at = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": node[at[:, 0]], "b": node[at[:, 1]]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


#: Part of a row in a task: searched for, compared with, or both.
MEMBER, QUERY, BOTH = 0, 1, 2


def least_equal(n: int, min_percent: int) -> int:
    """Of n registers, how many a pair at the threshold has equal at least, but for the chance MISS."""
    p, k, below = min_percent / 100, 0, (1 - min_percent / 100) ** n
    while below <= MISS and k < n:
        k += 1
        below += math.comb(n, k) * p**k * (1 - p) ** (n - k)
    return k


def possible(regs: np.ndarray, size: np.ndarray, component: np.ndarray, query: np.ndarray, member: np.ndarray,
             band: int, min_percent: int) -> np.ndarray:
    """Which rows are a query or a member of a pair of other components whose first
    common band is ``band`` and that may reach the threshold by size and by its equal registers."""
    keep, members = np.zeros(len(regs), bool), np.flatnonzero(member)
    first = np.ascontiguousarray(regs[:, :FIRST_REGISTERS])
    some, all_ = least_equal(FIRST_REGISTERS, min_percent), least_equal(regs.shape[1], min_percent)
    for q in np.flatnonzero(query).tolist():
        at = members[(component[members] != component[q])
                     & (np.minimum(size[members], size[q]) * 100 >= min_percent * np.maximum(size[members], size[q]))]
        at = at[np.count_nonzero(first[at] == first[q], axis=1) >= some]
        equal = regs[at] == regs[q]
        common = equal.reshape(len(at), BANDS, ROWS).all(axis=2)
        at = at[(np.count_nonzero(equal, axis=1) >= all_) & (common.argmax(axis=1) == band)]
        if len(at):
            keep[q] = keep[at] = True
    return keep


DEALT = "bucket long, m int, q int, role int, node long, component long"


def _possible_block(min_percent: int):
    """Of a task of ``open_tasks``, the rows (DEALT) that may have a link to be searched for there."""
    def run(block: pa.Table) -> pa.Table:
        node, component, role, size = (block.column(n).to_numpy() for n in ("node", "component", "role", "n_shingles"))
        keep = possible(_rows(block.column("registers")), size, component, role != MEMBER, role != QUERY,
                        block.column("bucket")[0].as_py() & 63, min_percent)
        return block.select([x.split()[0] for x in DEALT.split(", ")]).filter(pa.array(keep))

    return run


def hub_tasks(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """Rows (hub, part, node, is_hub, ..) of pairs (node, hub): the classes of a hub in
    parts of about HUB_ROWS, and the hub's own row in each part."""
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / HUB_ROWS).cast("int").alias("parts"))
    classes = pairs.join(parts, "hub").select("hub", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node",
                                              F.lit(False).alias("is_hub"))
    own = parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("hub").alias("node"),
                       F.lit(True).alias("is_hub"))
    # A part may have got no class.
    filled = classes.select("hub", "part").distinct()
    return classes.unionByName(own.join(filled, ["hub", "part"])).join(values, "node")


def open_tasks(members: DataFrame, found: DataFrame, sets: DataFrame, signs: DataFrame | None = None,
               min_percent: int = MIN_PERCENT) -> DataFrame:
    """Rows (bucket, m, q, role, ..) of the search in buckets that hold several
    components: blocks of members against blocks of those outside the main one.
    With ``signs`` (node, n_shingles, registers), only rows that may have a link by
    them; the lowest six bits of a bucket are then its band."""
    labelled = stored(members.join(found, "node", "left").select(
        "bucket", "node", "n_shingles", F.coalesce("component", "node").alias("component")), "labelled")
    per = labelled.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    open_buckets = per.groupBy("bucket").agg(F.max(F.struct("n", "component", "w")).alias("main"), F.sum("w").alias("w"),
                                             F.count("*").alias("components")).where("components > 1")
    plan = stored(open_buckets.select("bucket", F.col("main.component").alias("main"),
                                      F.ceil(F.col("w") / BLOCK_SHINGLES).cast("int").alias("m_blocks"),
                                      F.ceil((F.col("w") - F.col("main.w")) / BLOCK_SHINGLES).cast("int").alias("q_blocks")), "open")
    rows = labelled.join(plan, "bucket").withColumn("outside", F.col("component") != F.col("main"))
    spot = F.xxhash64("node")
    one = (F.col("m_blocks") == 1) & (F.col("q_blocks") == 1)
    m, q = F.pmod(spot, F.col("m_blocks")).cast("int"), F.pmod(spot, F.col("q_blocks")).cast("int")
    each_m, each_q = (F.sequence(F.lit(0), F.col(c) - 1) for c in ("m_blocks", "q_blocks"))

    def at(m, q, role):
        return F.struct(m.alias("m"), q.alias("q"), F.lit(role).alias("role"))

    as_member = F.transform(each_q, lambda k: at(m, k, MEMBER))
    as_query = F.transform(each_m, lambda k: at(k, q, QUERY))
    zero = F.lit(0)
    places = F.when(one, F.array(F.when(F.col("outside"), at(zero, zero, BOTH)).otherwise(at(zero, zero, MEMBER)))).otherwise(
        F.when(F.col("outside"), F.concat(as_member, as_query)).otherwise(as_member))
    dealt = rows.select("bucket", "node", "component", F.explode(places).alias("at")).select("bucket", "at.*", "node", "component")
    if signs is None:
        out = stored(dealt, "dealt")
    else:
        out = stored(dealt.join(signs, "node").groupBy("bucket", "m", "q").applyInArrow(_possible_block(min_percent), DEALT), "dealt")
    discard(labelled, plan)
    return out.join(sets, "node")


def near_components(docs: DataFrame, width: int = 5, min_percent: int = MIN_PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    with text_batches(docs.sparkSession):
        return _near_components(docs, width, min_percent)


def _near_components(docs: DataFrame, width: int, min_percent: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = stored(docs.mapInArrow(
        _sketch_batches(width), "doc_id long, n_shingles long, set_key binary, registers binary"), "sketches")
    linkable = sketched.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = stored(linkable.groupBy("set_key").agg(
        F.min("doc_id").alias("node"), F.any_value("n_shingles").alias("n_shingles"),
        F.any_value("registers").alias("registers")), "classes")
    bands = F.array(*[F.shiftleft(F.xxhash64(F.lit(i), F.substring("registers", 2 * ROWS * i + 1, 2 * ROWS)), 6).bitwiseOR(F.lit(i))
                      for i in range(BANDS)])
    bucket_rows = classes.select("node", "n_shingles", F.explode(bands).alias("bucket"))
    sizes = stored(bucket_rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    members = stored(bucket_rows.join(sizes, "bucket"), "members")
    degrees = stored(members.groupBy("node").agg(F.sum("size").alias("degree")), "degrees")
    hubs = stored(members.join(degrees, "node").groupBy("bucket").agg(
        F.max(F.struct("degree", (-F.col("node")).alias("node"))).alias("h"))
        .select("bucket", (-F.col("h.node")).alias("hub")), "hubs")
    shared = members.join(hubs, "bucket").where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.col("n").desc(), "hub"))
    pairs = stored(shared.withColumn("rank", rank).where(F.col("rank") <= HUBS).select("node", "hub"), "pairs")
    likely_pairs = stored(hub_tasks(pairs, classes.select("node", "n_shingles", "registers")).groupBy("hub", "part").applyInArrow(
        _hub_filter(min_percent), "node long, hub long"), "likely")
    discard(sizes, hubs, pairs)

    # The full sets of all classes that share a bucket, made once from their documents.
    needed = degrees.join(classes.select("node", "set_key"), "node").select("node", F.col("set_key").alias("key"))
    texts = docs.join(degrees.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    made = texts.mapInArrow(_set_batches(width), "doc_id long, set_key binary, hashes array<long>")
    sets = stored(made.groupBy("doc_id", "set_key").agg(F.any_value("hashes").alias("hashes"))
                  .join(needed, (F.col("doc_id") == F.col("node")) & (F.col("set_key") == F.col("key"))).select("node", "hashes"), "sets")

    member_of = linkable.select("doc_id", "set_key").join(classes.select("set_key", "node"), "set_key").select("doc_id", "node")
    several = member_of.groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    twins = stored(member_of.join(several, "doc_id").select(F.col("node").alias("a"), F.col("lo").alias("b"))
                   .where("a <> b").distinct(), "twins")
    links = stored(hub_tasks(likely_pairs, sets).groupBy("hub", "part").applyInArrow(_hub_verify(min_percent), "a long, b long"), "verified")
    found = components(links.union(twins))
    discard(likely_pairs, degrees)

    signs = classes.select("node", "n_shingles", "registers")
    forest = stored(open_tasks(members, found, sets, signs, min_percent).groupBy("bucket", "m", "q").applyInArrow(
        search_block(min_percent), "a long, b long"), "forest")
    discard(members, sets)
    final = components(links.union(twins).union(forest))
    by_class = stored(classes.select("set_key", "node").join(final, "node", "left").select(
        F.col("set_key").alias("of_set"), F.coalesce("component", "node").alias("found")), "by-class")
    discard(found, links, twins, forest, classes, final)
    rows = sketched.select("doc_id", "n_shingles", "set_key").join(by_class, F.col("set_key") == F.col("of_set"), "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("found", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"))


def op8_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"), width=2)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, width: int = 5) -> DataFrame:
    """One document of each group: the one with the smallest id. Rows without
    an id all stay; of rows that share the id that stays, the first by text."""
    kept = stored(near_components(docs, width).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id"))
                  .distinct(), "kept")
    rows = docs.select(F.struct("*").alias("row"))
    named = rows.where("row.doc_id IS NOT NULL").join(kept, F.col("row.doc_id") == F.col("kept_id"))
    firsts = named.groupBy("kept_id").agg(F.min_by("row", F.struct(F.col("row.text").isNull(), F.col("row.text"))).alias("row"))
    return firsts.select("row.*").union(rows.where("row.doc_id IS NULL").select("row.*"))
