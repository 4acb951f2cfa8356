"""Connected components of a link table by alternating large-star and
small-star steps. Minima are aggregated per task first, each join has a plain
stored table on either side (so AQE can split a hub's links), and every step
is written to the shared folder, which cuts the lineage; spent steps are deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens.llm.common import discard, stored


def _state(links: DataFrame) -> tuple:
    """Number of links, a sum over them, and number of different smaller ends."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)")), F.count_distinct("lo")).first())


def components(links: DataFrame) -> DataFrame:
    """Stored (node, component) for each node on a link (a, b); the component is
    its smallest node. Null ends and links of a node to itself are left out."""
    e = stored(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
               .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("hi") > F.col("lo"))).distinct(), "links")
    before, nodes = _state(e), None
    # Stars are done: the larger ends are all different, and none is a smaller end.
    while before[0] and before[0] + before[2] != nodes:
        ends = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = stored(ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        nodes = nodes or least.count()
        large = stored(e.join(least, e["lo"] == least["u"]).select("hi", F.col("m").alias("lo")).distinct(), "large")
        low = stored(large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m")), "low")
        small = (large.join(low, large["hi"] == low["u"]).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                 .union(low.select("u", "m")))
        last, e = e, stored(small.distinct(), "links")
        discard(last, least, large, low)
        after = _state(e)
        if after == before:
            break
        before = after
    found = stored(e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        e.select(F.col("lo"), F.col("lo")).distinct()), "components")
    discard(e)
    return found
