"""Benchmark decontamination by size-partitioned MinHash containment search
(DataFrame functions only).

Texts are lower-cased and cut into letter-and-digit words; a set holds the
5-word shingles, each as a 64-bit hash. Test items are partitioned by set size
into powers of two. In a partition with largest size u, an item's sketch is
its ``m`` smallest hashes, m = u - ceil(t * u) + 1 at most: an item of which
the share t or more lies in a document has at least one of them there, so the
search misses nothing. A document's sketch of the same partition holds its
hashes up to the partition's bound (the largest m-th minimum of its items),
which is a small, size-dependent part of a long document. Colliding pairs are
then verified: shared shingles over the item's shingles, on full sets.

Defined cases: a null or empty text and any text of fewer than five words has
no shingle and matches nothing; repeated items each match; documents are told
apart by id and text, so rows with a shared or null id are judged one by one
and exact repeats of a row count once; an empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens.llm.common import let, small_side, stored, table

SHINGLE_WORDS = 5
MIN_CONTAINMENT = 0.8


def shingle_hashes(text: Column, width: int = SHINGLE_WORDS) -> Column:
    """Distinct hashes of the ``width``-word shingles of a text."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")

    def hashes(w: Column) -> Column:
        at = F.transform(F.sequence(F.lit(0), F.size(w) - width),
                         lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        return F.when(F.size(w) < width, F.array().cast("array<bigint>")).otherwise(at)

    return let(words, hashes)


def item_sets(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, n, part, shingles) of the items that have a shingle."""
    sets = items.select(F.monotonically_increasing_id().alias("item_no"), F.col(item_id).alias("item"),
                        F.array_distinct(shingle_hashes(F.col(text))).alias("shingles"))
    return (sets.withColumn("n", F.size("shingles")).where("n > 0")
            .withColumn("part", F.ceil(F.log2("n")).cast("int")))


def sketches(sets: DataFrame, threshold: float) -> DataFrame:
    """(item_no, part, shingle): the smallest hashes of every item."""
    missing_ok = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    return sets.select("item_no", "part", F.explode(
        F.slice(F.array_sort("shingles"), F.lit(1), missing_ok.cast("int"))).alias("shingle"))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = MIN_CONTAINMENT) -> DataFrame:
    """Verified (doc_id, text_hash, item, n_item, n_shared) pairs."""
    sets = stored(item_sets(items), "items")
    sketch = stored(sketches(sets, threshold), "sketches")
    # One bound per size partition (a few dozen at most: sizes are powers of two).
    bounds = {r["part"]: r["b"] for r in sketch.groupBy("part").agg(F.max("shingle").alias("b")).collect()}
    top = max(bounds.values(), default=None)
    key = [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]
    if top is None:
        cut = F.array().cast("array<bigint>")
    else:
        cut = F.filter(shingle_hashes(F.col("text")), lambda h: h <= F.lit(top))
    probes = docs.select(*key, F.explode(cut).alias("shingle"))
    hits = probes.join(small_side(sketch), "shingle")
    if bounds:      # a document's sketch for a partition ends at that partition's bound
        within = F.create_map(*[F.lit(x) for kv in bounds.items() for x in kv])
        hits = hits.where(F.col("shingle") <= F.element_at(within, F.col("part")))
    pairs = stored(hits.select("doc_id", "text_hash", "item_no").distinct(), "pairs")
    # Verification: only documents with a candidate are shingled again.
    named = pairs.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct()
    again = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(
        small_side(stored(named, "named")),
        F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left_semi")
    full = again.select("doc_id", "text_hash", F.explode(F.array_distinct(shingle_hashes(F.col("text"))))
                        .alias("shingle"))
    members = sets.select("item_no", F.explode("shingles").alias("shingle"))
    shared = (full.join(small_side(stored(members, "members")), "shingle")
              .groupBy("doc_id", "text_hash", "item_no").agg(F.countDistinct("shingle").alias("n_shared")))
    return (shared.join(small_side(sets.select("item_no", "item", F.col("n").cast("long").alias("n_item"))), "item_no")
            .where(F.col("n_shared") >= F.lit(threshold) * F.col("n_item") - 1e-9)
            .select("doc_id", "text_hash", "item", "n_item", "n_shared"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("item").alias("item_id"), "n_item", "n_shared",
                        F.round(F.col("n_shared") / F.col("n_item"), 6).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no test item."""
    leaks = stored(contaminated(docs, items).select(F.col("doc_id").alias("leak_id"), F.col("text_hash").alias("leak"))
                   .distinct(), "leaks")
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(small_side(leaks), F.col("row.doc_id").eqNullSafe(F.col("leak_id"))
                     & (F.xxhash64("row.text") == F.col("leak")), "left_anti").select("row.*")


ORACLE = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
  FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')
  FROM benchmark),
s AS (
  SELECT DISTINCT kind, id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT kind, id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
n AS (SELECT id, count(*)::BIGINT AS n_item FROM s WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, n_item, count(*)::BIGINT AS n_shared,
       round(count(*) / n_item, 6) AS containment
FROM s d JOIN s i ON d.kind = 'd' AND i.kind = 'i' AND d.g = i.g JOIN n ON n.id = i.id
GROUP BY d.id, i.id, n_item HAVING count(*) >= 0.8 * n_item
"""
