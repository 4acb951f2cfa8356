"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from queuelens.session import checkpoint_dir
from queuelens.sources.files import delete

#: ASCII white space that separates words (space, tab, LF, VT, FF, CR).
WORD_GAP = r"[\x20\x09-\x0D]+"
#: A side is broadcast only when a count shows at most this many rows.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder of the session."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and
    lets two branches read one result; a lost executor costs a re-read."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete stored tables that no later plan reads."""
    for frame in frames:
        delete(frame.sparkSession, frame.stored_path)


@contextmanager
def text_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs started inside hand texts to Python in batches of few rows, which bounds
    what a task holds beside its heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a stored, narrow frame for broadcast if it counts at most ``rows``
    rows; beyond that the join shuffles (with AQE's skew splitting)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def words_of(text: Column) -> Column:
    """Words between ASCII white space; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def ranked(rows: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """``rows`` with the column ``name``: the rank from 0 of each row among those of
    equal ``keys`` by the hash ``order`` (binary, not null).

    ``rows`` is a stored table with a column ``part`` (the partition that wrote
    it). Ranks add up cells of the hash, smaller hashes in the cell, and rows of
    equal hash by part, so neither a hot key nor a hot hash meets in one task.
    """
    cell = F.substring(order, 1, 2)
    alike = rows.groupBy(*keys, cell.alias("rank_cell"), order, "part").agg(F.count("*").alias("rank_n"))
    below = F.sum("rank_n").over(Window.partitionBy(*keys, "rank_cell").orderBy(order, "part")) - F.col("rank_n")
    in_cell = stored(alike.withColumn("rank_below", below), "cells")
    cells = in_cell.groupBy(*keys, "rank_cell").agg(F.sum("rank_n").alias("rank_n"))
    base = F.sum("rank_n").over(Window.partitionBy(*keys).orderBy("rank_cell")) - F.col("rank_n")
    first = in_cell.join(cells.select(*keys, "rank_cell", base.alias("rank_base")), [*keys, "rank_cell"]).select(
        *keys, order, "part", (F.col("rank_base") + F.col("rank_below")).alias("rank_first"))
    turn = F.row_number().over(Window.partitionBy(*keys, order, "part").orderBy(F.lit(0))) - 1
    return (rows.withColumn("rank_turn", turn).join(first, [*keys, order, "part"])
            .withColumn(name, F.col("rank_first") + F.col("rank_turn")).drop("rank_turn", "rank_first"))
