"""Sharding on a consistent-hash ring with virtual nodes and bounded loads
(DataFrame functions only).

The ring has POINTS points. Each shard stands on it with several virtual nodes;
a document belongs to the point of its id's hash and goes clockwise to the next
virtual node. A shard takes at most its load bound; what finds it full goes on
clockwise to the next shard with room. With no slack the bounds add up to the
number of rows, so that all shards end full and row counts are at most one apart.

The documents between two virtual nodes (an arc) are alike to the ring, so the
placement is worked out on the counts of arcs, whose number does not depend on
the data: first each shard takes from its own arcs, in ring order, then the rest
of each arc walks on clockwise. The result says which ranks of an arc go to
which shard and slots. Ranks follow a hash of id, size and checksum, counted in
cells of an arc; rows that agree in all three take their ranks per input
partition, so one id or text may hold any share of the rows.

Defined cases: documents without an id share one point; null text has no bytes
and checksum 0; rows that share an id, or are equal, each get a slot; an empty
table gives no rows. Long texts stay where they are unless ``extra`` carries
them. Extra columns are ignored, or carried (``write_shards``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from queuelens.llm.common import let, ranked, stored, table
from queuelens.llm.sql import CRC_TABLE, crc_of

SHARDS, VNODES = 40, 64
POINTS = 1 << 16
#: Bytes that a row counts beside its text.
ROW_BYTES = 16
#: Rows in one file of a written shard.
FILE_ROWS = 1_000_000


def _point(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("int")


def ring(spark: SparkSession, n_shards: int, vnodes: int) -> DataFrame:
    """(arc, shard, point, walk, points): the virtual nodes in ring order; ``walk`` are
    the shards met clockwise from there on, ``points`` those whose documents come here."""
    shard, v = F.expr(f"id div {vnodes}"), F.expr(f"id % {vnodes}")
    node = F.struct(_point(F.concat_ws("-", F.lit("shard"), shard, v)).alias("point"), shard.cast("int").alias("shard"), v.alias("v"))
    nodes = spark.range(n_shards * vnodes).agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    size, at = F.size("nodes"), F.col("arc")
    point, before = F.col("node.point"), F.coalesce(F.get("nodes", at - 1)["point"], F.lit(-1))
    own = F.when(before < point, F.sequence(before + 1, point)).otherwise(F.array().cast("array<int>"))
    last = F.get("nodes", size - 1)["point"]
    rest = F.when((at == 0) & (last < POINTS - 1), F.sequence(last + 1, F.lit(POINTS - 1))).otherwise(F.array().cast("array<int>"))
    walk = F.array_distinct(F.concat(F.slice("nodes.shard", at + 1, size), F.slice("nodes.shard", F.lit(1), at)))
    return nodes.select("nodes", F.posexplode("nodes").alias("arc", "node")).select(
        "arc", "node.shard", "node.point", walk.alias("walk"), F.concat(own, rest).alias("points"))


def bounds(n_rows: int, n_shards: int, slack: float) -> list[int]:
    """Most rows of each shard; without slack they add up to ``n_rows``."""
    if slack > 0:
        return [int(-(-(1 + slack) * n_rows // n_shards))] * n_shards
    return [n_rows // n_shards + (s < n_rows % n_shards) for s in range(n_shards)]


def flows(arcs: DataFrame, loads: list[int]) -> DataFrame:
    """(arc, shard, lo, hi, slot): ranks lo .. hi - 1 of an arc take the slots of
    ``shard`` from ``slot`` on. ``arcs`` has a row per virtual node (arc, shard, walk, n)."""
    room = F.array(*[F.lit(x).cast("long") for x in loads])
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    home = arcs.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("n"), F.get(room, F.col("shard")) - before)))

    # What is left of each arc walks on, one arc after the other; all on one row of bounded arrays.
    taken = F.struct("shard", "taken")
    one = home.agg(
        F.collect_list(taken).alias("taken"),
        F.array_sort(F.collect_list(F.when(F.col("n") > F.col("taken"), F.struct(
            "arc", (F.col("n") - F.col("taken")).alias("n"), F.col("taken").alias("lo"), "walk")))).alias("rest"))
    left = F.transform(room, lambda r, s: r - F.reduce(
        F.col("taken"), F.lit(0).cast("long"), lambda t, x: t + F.when(x["shard"] == s, x["taken"]).otherwise(0)))

    def step(state: Column, arc: Column, shard: Column) -> Column:
        return let(F.least(state["n"], F.get(state["room"], shard)), lambda t: F.when(t <= 0, state).otherwise(F.struct(
            F.transform(state["room"], lambda r, s: F.when(s == shard, r - t).otherwise(r)).alias("room"),
            (state["n"] - t).alias("n"), (state["lo"] + t).alias("lo"),
            F.concat(state["made"], F.array(F.struct(arc["arc"].alias("arc"), shard.alias("shard"), state["lo"].alias("lo"),
                                                     (state["lo"] + t).alias("hi")))).alias("made"))))

    def walk(state: Column, arc: Column) -> Column:
        begin = F.struct(state["room"].alias("room"), arc["n"].alias("n"), arc["lo"].alias("lo"), state["made"].alias("made"))
        return F.reduce(arc["walk"], begin, lambda inner, shard: step(inner, arc, shard))

    nothing = F.array().cast("array<struct<arc: int, shard: int, lo: bigint, hi: bigint>>")
    zero = F.lit(0).cast("long")
    moved = one.select(F.reduce(F.col("rest"), F.struct(left.alias("room"), zero.alias("n"), zero.alias("lo"), nothing.alias("made")),
                                walk)["made"].alias("made")).select(F.posexplode("made").alias("turn", "m")).select(
        "m.arc", "m.shard", "m.lo", "m.hi", (F.col("turn") + 1).alias("turn"))
    settled = home.where("taken > 0").select("arc", "shard", F.lit(0).cast("long").alias("lo"), F.col("taken").alias("hi"), F.lit(0).alias("turn"))
    size = F.col("hi") - F.col("lo")
    slot = F.sum(size).over(Window.partitionBy("shard").orderBy("turn", "arc")) - size
    return settled.unionByName(moved).select("arc", "shard", "lo", "hi", slot.alias("slot"))


def place(docs: DataFrame, n_shards: int = SHARDS, vnodes: int = VNODES, slack: float = 0.0,
          extra: Column | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, home, shard, slot) of every document, and the
    column ``extra`` if given. ``home`` is the shard it would have without bounds."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit("")).cast("binary")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
                         F.crc32(text).alias("text_crc32"), *([extra.alias("extra")] if extra is not None else []))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    order = F.unhex(F.md5(F.concat_ws(":", name, "size", "text_crc32")))
    nodes = stored(ring(spark, n_shards, vnodes), "ring")
    arc_of = F.broadcast(nodes.select("arc", F.col("shard").alias("home"), F.explode("points").alias("point")))     # POINTS rows
    rows = stored(narrow.withColumn("point", _point(name)).join(arc_of, "point").drop("point")
                  .withColumn("order", order).withColumn("part", F.spark_partition_id()), "ring-rows")

    placed = ranked(rows, ["arc"], "order", "rank")
    counts = rows.groupBy("arc").agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    arcs = nodes.join(counts, "arc", "left").select("arc", "shard", "walk", F.coalesce("n", F.lit(0)).alias("n"))
    plan = stored(flows(arcs, bounds(total, n_shards, slack)).groupBy("arc").agg(
        F.collect_list(F.struct("lo", "hi", "shard", "slot")).alias("flows")), "ring-flows")        # a row per virtual node
    flow = F.get(F.filter("flows", lambda f: (f["lo"] <= F.col("rank")) & (F.col("rank") < f["hi"])), F.lit(0))
    return placed.join(F.broadcast(plan), "arc").withColumn("flow", flow).select(
        "doc_id", "size", "text_crc32", "home", "flow.shard", (F.col("flow.slot") + F.col("rank") - F.col("flow.lo")).alias("slot"),
        *(["extra"] if extra is not None else []))


def write_shards(docs: DataFrame, path: str, n_shards: int = SHARDS, vnodes: int = VNODES, slack: float = 0.0) -> None:
    """Write the documents as Parquet folders shard=0 .. n - 1, with all columns
    as ``row`` and their slot, in files of FILE_ROWS consecutive slots."""
    placed = place(docs, n_shards, vnodes, slack, F.struct("*")).select("shard", "slot", F.col("extra").alias("row"))
    dealt = placed.repartition("shard", F.expr(f"slot div {FILE_ROWS}")).sortWithinPartitions("shard", "slot")
    dealt.write.partitionBy("shard").option("compression", "zstd").parquet(path)


def op12_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = place(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "home")


_HEX = "('0x' || substr(md5({}), 1, 4))::INT"
ORACLE = f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
nodes AS (
    SELECT row_number() OVER (ORDER BY point, shard, v) - 1 AS arc, shard, point
    FROM (SELECT s.s AS shard, v.v AS v, {_HEX.format("'shard-' || s.s || '-' || v.v")} AS point
          FROM range({SHARDS}) s(s), range({VNODES}) v(v))),
walks AS (
    SELECT arc, list(shard ORDER BY met) AS walk
    FROM (SELECT a.arc, b.shard, min((b.arc - a.arc + {SHARDS * VNODES}) % {SHARDS * VNODES}) AS met
          FROM nodes a, nodes b GROUP BY a.arc, b.shard) GROUP BY arc),
points AS (SELECT point, min(arc) AS arc FROM nodes GROUP BY point),
sized AS (
    SELECT doc_id, octet_length(encode(coalesce(text, ''))) + {ROW_BYTES} AS size, {crc_of("encode(coalesce(text, ''))")} AS text_crc32
    FROM documents, crc),
keyed AS (
    SELECT *, {_HEX.format("coalesce(doc_id::VARCHAR, '-')")} AS point,
           md5(coalesce(doc_id::VARCHAR, '-') || ':' || size || ':' || text_crc32) AS k FROM sized),
rows AS (
    SELECT keyed.*, coalesce(points.arc, 0) AS arc, row_number() OVER (PARTITION BY coalesce(points.arc, 0) ORDER BY k) - 1 AS rank
    FROM keyed ASOF LEFT JOIN points ON keyed.point <= points.point),
total AS (SELECT count(*) AS n FROM documents),
bounds AS (
    SELECT s AS shard, n // {SHARDS} + (s < n % {SHARDS})::INT AS bound FROM range({SHARDS}) t(s), total),
counts AS (
    SELECT nodes.arc, shard, count(k) AS n FROM nodes LEFT JOIN rows USING (arc) GROUP BY ALL),
home AS (
    SELECT *, greatest(0, least(n, bound - (sum(n) OVER (PARTITION BY shard ORDER BY arc) - n))) AS taken
    FROM counts JOIN bounds USING (shard)),
rest AS (
    SELECT row_number() OVER (ORDER BY arc) AS turn, arc, n - taken AS n, taken AS lo, walk
    FROM home JOIN walks USING (arc) WHERE n > taken),
free AS (
    SELECT list(room ORDER BY shard) AS rooms
    FROM (SELECT shard, any_value(bound) - sum(taken) AS room FROM home GROUP BY shard)),
walked AS (
    SELECT 0::BIGINT AS turn, rooms::BIGINT[] AS rooms, []::BIGINT[] AS takes FROM free
    UNION ALL
    SELECT turn, list_transform(range({SHARDS}), lambda s: rooms[s + 1] - takes[list_position(walk, s)]), takes
    FROM (SELECT *, list_transform(range({SHARDS}), lambda i: greatest(0, least(rooms[walk[i + 1] + 1],
                       n - coalesce(list_sum(list_transform(walk[:i], lambda s: rooms[s + 1])), 0)))::BIGINT) AS takes
          FROM (SELECT rest.turn, rest.walk, rest.n, walked.rooms FROM walked JOIN rest ON rest.turn = walked.turn + 1))),
overflow AS (
    SELECT turn, arc, lo, unnest(walk) AS shard, unnest(takes) AS n, unnest(range({SHARDS})) AS nth FROM walked JOIN rest USING (turn)),
flows AS (
    SELECT arc, shard, lo, hi, sum(hi - lo) OVER (PARTITION BY shard ORDER BY turn, arc) - (hi - lo) AS slot
    FROM (SELECT arc, shard, 0 AS lo, taken AS hi, 0 AS turn FROM home WHERE taken > 0
          UNION ALL
          SELECT arc, shard, lo + before, lo + before + n, turn
          FROM (SELECT *, sum(n) OVER (PARTITION BY turn ORDER BY nth) - n AS before FROM overflow) WHERE n > 0))
SELECT doc_id, size, text_crc32, 'rows' AS law, flows.shard, (slot + rank - lo)::BIGINT AS slot, NULL::INT AS grown_shard, nodes.shard AS home
FROM rows JOIN flows ON flows.arc = rows.arc AND rank >= lo AND rank < hi JOIN nodes ON nodes.arc = rows.arc
"""
