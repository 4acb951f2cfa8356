"""Mixing sources to target weights by Pfair scheduling (DataFrame functions only).

Each source's documents, in the order of a hash of their id, form blocks. Weights
are shares of rows; a source whose blocks are shorter gets more of them. Of a
period of L slots source i owns a_i. Its k-th block of a period is released at slot
floor(k * L / a_i) and due by ceil((k + 1) * L / a_i); each slot takes, of the
released blocks, the one with the earliest deadline. Since the a_i add up to L,
every block meets its window, so after any number of slots each source is less
than one block from its share of the slots. The schedule of one period (L rows)
places every block of every later period.

The period is long enough to give the least weight two slots (at least PERIOD;
beyond SCHEDULE_STEPS / sources slots the least weights are rounded up to one
slot), whatever the number of sources.

The mix ends when the source that lasts longest has been read once; sources
that end sooner are read again (a further epoch), so no document is lost and
the weights hold throughout.

Defined cases: documents without a source form one source of their own; a
document without an id is ordered by its text; rows that share an id get
neighbouring places; an empty table gives no rows. Texts, long ones too, are only
carried. Extra columns are carried (``mix``) or ignored (query); the position of
``positioned_rows`` takes a name that no column has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from queuelens.llm.common import let, stored, table

BLOCK_ROWS = 64
PERIOD = 1000
#: Most slots times sources of a schedule, which is made on one row.
SCHEDULE_STEPS = 300_000_000
#: Slots scheduled between two additions to the schedule.
CHUNK = 500
#: Hash ranges in which the documents of a source are numbered in parallel.
RANGES = 4096
_PACK = 1 << 20


def block_weights(counts: DataFrame, weights: dict[str, float] | None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(source, n_rows, w): the weight of a source's blocks. Sources without a given
    weight get n_rows ** 0.75 of the rows, the share that tempered mixing gives;
    given weights are relative to those."""
    n = F.col("n_rows").cast("double")
    weight = F.sqrt(n * F.sqrt(n))
    for source, w in (weights or {}).items():
        weight = F.when(F.col("source") == source, F.lit(float(w))).otherwise(weight)
    return counts.select("source", "n_rows", (weight * F.ceil(n / block_rows) / n).alias("w"))


def quotas(weighted: DataFrame, period: int = PERIOD) -> DataFrame:
    """(source, n_rows, owned): slots of a source in a period, whose length is their
    sum: rounded shares of as many slots as give the least weight two, at least
    about ``period``, within SCHEDULE_STEPS; one slot each at the least."""
    in_order = Window.partitionBy().orderBy(F.col("source").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)           # one row per source
    share = F.col("w") / F.sum("w").over(in_order)
    n = F.count("*").over(in_order)
    least = 2 * F.ceil(F.sum("w").over(in_order) / F.min("w").over(in_order)).cast("long")
    most = F.greatest(F.floor(F.lit(SCHEDULE_STEPS) / n).cast("long"), 2 * n)
    slots = F.greatest(F.lit(period), F.least(least, most))
    return weighted.select("source", "n_rows", F.greatest(F.floor(share * slots + 0.5).cast("long"), F.lit(1).cast("long")).alias("owned"))


def period_schedule(owned: DataFrame, period: int) -> DataFrame:
    """(source, k, slot): earliest deadline first over one period."""
    one = owned.agg(F.sort_array(F.collect_list(F.struct("source", "owned"))).alias("s"))

    def choose(served: Column, t: Column) -> Column:
        def deadline(k: Column, i: Column) -> Column:
            a = F.get(F.col("s"), i)["owned"]
            due = F.floor(((k + 1) * period + a - 1) / a) * _PACK + i
            return F.when((k < a) & (F.floor(k * period / a) <= t), due)

        return (F.array_min(F.transform(served, deadline)) % _PACK).cast("int")

    def step(state: Column, t: Column) -> Column:
        return let(choose(state["served"], t), lambda pick: F.struct(
            F.transform(state["served"], lambda k, i: k + (i == pick).cast("long")).alias("served"),
            F.concat(state["picks"], F.array(pick)).alias("picks")))

    nothing = F.array().cast("array<int>")

    def chunk(state: Column, first: Column) -> Column:
        slots = F.sequence(first, F.least(first + CHUNK, F.lit(period)) - 1)
        inner = F.aggregate(slots, F.struct(state["served"].alias("served"), nothing.alias("picks")), step)
        return let(inner, lambda x: F.struct(x["served"].alias("served"), F.concat(state["picks"], F.array(x["picks"])).alias("picks")))

    start = F.struct(F.transform("s", lambda x: F.lit(0).cast("long")).alias("served"), F.array().cast("array<array<int>>").alias("picks"))
    picks = F.flatten(F.aggregate(F.sequence(F.lit(0), F.lit(period - 1), F.lit(CHUNK)), start, chunk, lambda st: st["picks"]))
    slots = (one.where(F.size("s") > 0).select("s", F.posexplode(picks).alias("slot", "pick"))
             .select(F.get(F.col("s"), F.col("pick"))["source"].alias("source"), F.col("slot").cast("long").alias("slot")))
    k = F.row_number().over(Window.partitionBy("source").orderBy("slot")) - 1
    return slots.select("source", k.cast("long").alias("k"), "slot")


def mix(docs: DataFrame, carry: Column | None = None, weights: dict[str, float] | None = None,
        block_rows: int = BLOCK_ROWS, period: int = PERIOD) -> DataFrame:
    """Every placed document: source, epoch, block, slot, position, and
    ``carry`` (a column of ``docs``)."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))
    part = F.floor(F.conv(F.substr(key, F.lit(1), F.lit(4)), 16, 10).cast("long") / (65536 // RANGES))
    rows = docs.select(F.col("source"), key.alias("key"), F.col("doc_id").alias("id"),
                       (carry if carry is not None else F.lit(0)).alias("carried")).withColumn(
        "part", F.floor(F.conv(F.substr("key", F.lit(1), F.lit(4)), 16, 10).cast("long") / (65536 // RANGES)))
    # Numbering: counts per (source, hash range) first, so a source with a third
    # of all rows is numbered in RANGES independent groups.
    counts = stored(docs.select("source", part.alias("part")).groupBy("source", "part")
                    .agg(F.count("*").alias("n")), "ranges")
    totals = counts.groupBy("source").agg(F.sum("n").alias("n_rows"))
    weighted = stored(block_weights(totals, weights, block_rows), "weights")
    owned = stored(quotas(weighted, period), "owned")
    period = owned.agg(F.sum("owned")).first()[0] or period
    schedule = stored(period_schedule(owned, period), "schedule")
    blocks = owned.withColumn("n_blocks", F.ceil(F.col("n_rows") / block_rows).cast("long"))
    ends = blocks.join(F.broadcast(schedule), blocks["source"].eqNullSafe(schedule["source"])
                       & ((F.col("n_blocks") - 1) % F.col("owned") == F.col("k")))
    end = ends.agg(F.max(F.floor((F.col("n_blocks") - 1) / F.col("owned")) * period + F.col("slot") + 1)).first()[0] or 0
    tail = (schedule.where(F.col("slot") < end % period).groupBy(F.col("source").alias("tail_of"))
            .agg(F.count("*").alias("tail")))
    plan = blocks.join(tail, F.col("source").eqNullSafe(F.col("tail_of")), "left").select(
        F.col("source").alias("plan_of"), "owned", "n_blocks",
        (F.lit(end // period) * F.col("owned") + F.coalesce("tail", F.lit(0))).alias("taken"))
    before = counts.select(F.col("source").alias("range_of"), F.col("part").alias("range_part"), (
        F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")).alias("before"))

    in_range = Window.partitionBy("source", "part").orderBy("key", F.col("id").asc_nulls_first())
    ranked = rows.withColumn("at", F.row_number().over(in_range) - 1).join(
        before, F.col("source").eqNullSafe(F.col("range_of")) & (F.col("part") == F.col("range_part")))
    rank = F.col("before") + F.col("at")
    # `plan` has a row per source, `schedule` one per slot of the period: bounded broadcasts.
    placed = ranked.withColumn("rank", rank).join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("plan_of")))
    block = F.floor(F.col("rank") / block_rows).cast("long")
    epochs = F.floor((F.col("taken") - 1 - block) / F.col("n_blocks")).cast("long")
    copies = placed.withColumn("block", block).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), epochs)))
    turn = F.col("epoch") * F.col("n_blocks") + F.col("block")
    timed = copies.withColumn("turn", turn).withColumn("turn_k", F.col("turn") % F.col("owned")).join(
        F.broadcast(schedule.select(F.col("source").alias("slot_of"), "k", F.col("slot").alias("in_period"))),
        F.col("source").eqNullSafe(F.col("slot_of")) & (F.col("turn_k") == F.col("k")))
    slot = F.floor(F.col("turn") / F.col("owned")).cast("long") * period + F.col("in_period")
    return timed.withColumn("slot", slot).select(
        "carried", "source", "epoch", "block", "slot",
        (F.col("slot") * block_rows + F.col("rank") % block_rows).alias("position"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, F.col("doc_id")).withColumnRenamed("carried", "doc_id")


def mixed_rows(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The rows of the mix, each document once per epoch it is read in."""
    return mix(docs, F.struct("*"), weights).select("carried.*")


def positioned_rows(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """As ``mixed_rows``, with the position of each row in the mix under ``position_name``."""
    name = position_name(docs.columns)
    return mix(docs, F.struct("*"), weights).select("carried.*", F.col("position").alias(name))


def position_name(columns: list[str]) -> str:
    """``position``, with underscores behind it as long as a column has that name (in any case)."""
    taken, name = {c.lower() for c in columns}, "position"
    while name in taken:
        name += "_"
    return name


def placed_by(columns: list[str]) -> str:
    """The position column that ``positioned_rows`` added."""
    name = "position"
    while name + "_" in columns:
        name += "_"
    return name


def mix_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix with languages as sources, whose sizes differ."""
    docs = table(spark, sf_dir, "documents").withColumn("source", F.col("lang"))
    return mix(docs, F.col("doc_id")).withColumnRenamed("carried", "doc_id")


ORACLE = r"""
WITH RECURSIVE c AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source),
w AS (SELECT source, n, sqrt(n::DOUBLE * sqrt(n::DOUBLE)) * ceil(n::DOUBLE / 64) / n::DOUBLE AS w FROM c),
q AS (
  SELECT source, n, greatest(1, floor(w / sum(w) OVER o * greatest(1000, least(
    2 * ceil(sum(w) OVER o / min(w) OVER o)::BIGINT, greatest(300000000 // count(*) OVER o, 2 * count(*) OVER o))) + 0.5)::BIGINT) AS a
  FROM w WINDOW o AS (ORDER BY source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
per AS (SELECT sum(a)::BIGINT AS len FROM q),
s AS (SELECT list(a ORDER BY source NULLS FIRST) AS a, list(source ORDER BY source NULLS FIRST) AS src FROM q),
edf AS (
  SELECT -1 AS t, list_transform(a, lambda x: 0::BIGINT) AS served, -1::BIGINT AS pick, a, src FROM s
  UNION ALL
  SELECT t, list_transform(served, lambda k, i: k + (i = pick)::BIGINT), pick, a, src
  FROM (SELECT t + 1 AS t, served, a, src, 
          list_min(list_filter(list_transform(served, lambda k, i: CASE WHEN k < a[i] AND (k * len) // a[i] <= t + 1
            THEN ((k + 1) * len + a[i] - 1) // a[i] * 1048576 + i END), lambda x: x IS NOT NULL)) % 1048576 AS pick
        FROM edf, per WHERE t < len - 1)),
sch AS (
  SELECT src[pick] AS source, t AS slot, row_number() OVER (PARTITION BY src[pick] ORDER BY t) - 1 AS k
  FROM edf WHERE t >= 0),
bl AS (SELECT source, a, (n + 63) // 64 AS nb FROM q),
fin AS (
  SELECT max((nb - 1) // a * len + slot + 1) AS t FROM per, bl JOIN sch
  ON bl.source IS NOT DISTINCT FROM sch.source AND (nb - 1) % a = k),
tk AS (
  SELECT bl.source, a, nb, (t // len) * a + (SELECT count(*) FROM sch WHERE sch.source IS NOT DISTINCT FROM bl.source
    AND slot < t % len) AS taken FROM bl, fin, per),
r AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source
    ORDER BY md5(coalesce(doc_id::VARCHAR, text, '')), doc_id NULLS FIRST) - 1 AS rk FROM documents),
x AS (
  SELECT doc_id, r.source, rk, a, nb, rk // 64 AS block, unnest(range(0, (taken - 1 - rk // 64) // nb + 1)) AS epoch
  FROM r JOIN tk ON r.source IS NOT DISTINCT FROM tk.source)
SELECT doc_id, x.source, epoch, block, ((epoch * nb + block) // a * len + slot)::BIGINT AS slot,
       (((epoch * nb + block) // a * len + slot) * 64 + rk % 64)::BIGINT AS position
FROM per, x JOIN sch ON x.source IS NOT DISTINCT FROM sch.source AND (epoch * nb + block) % a = k
"""

#: The same with languages as sources.
ORACLE_BY_LANGUAGE = ORACLE.replace("FROM documents GROUP BY source", "FROM (SELECT * REPLACE (lang AS source) FROM documents) GROUP BY source").replace(
    "AS rk FROM documents)", "AS rk FROM (SELECT * REPLACE (lang AS source) FROM documents))")
