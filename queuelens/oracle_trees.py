"""DuckDB SQL that grows boosted trees: second-order gains over all cuts, level by level.

The oracle side of the small boosted model: every level is an aggregation by
(node, feature, bin), running sums over the bins, and the best cut per node.
Nodes are numbered by their path (children of k are 2k and 2k + 1). Sums are
over whole gradients, so they are exact in both engines.
"""

from __future__ import annotations

from queuelens.sources.schemas import LABEL, MODEL_FEATURES

UNITS = 1 << 20


def _score(g: str, n: str, reg_lambda: float) -> str:
    return f"(({g}) / {UNITS}::DOUBLE) * (({g}) / {UNITS}::DOUBLE) / (({n}) + {reg_lambda}::DOUBLE)"


def boosted_ctes(rounds: int, depth: int, rate: float, bins: int, reg_lambda: float, min_child: float, clip: float) -> str:
    """CTEs over ``features``: tree_nodes (tree, path, f, threshold, default_left,
    gain, rows, value) and scores (split, y, raw)."""
    listed = ", ".join(f"{c}::DOUBLE" for c in MODEL_FEATURES)
    out = [f"""
g_rows AS MATERIALIZED (
  SELECT row_number() OVER () AS id, split, {LABEL} AS seconds, ln(1 + least({LABEL}, {clip}::DOUBLE)) AS y, [{listed}] AS xs FROM features),
g_base AS MATERIALIZED (SELECT round(avg(y) * {UNITS}) / {UNITS}::DOUBLE AS base FROM g_rows WHERE split = 'train'),
g_long AS MATERIALIZED (SELECT id, unnest(range(len(xs))) AS f, unnest(xs) AS x FROM g_rows WHERE split = 'train'),
g_values AS (
  SELECT f, x, n, sum(n) OVER (PARTITION BY f ORDER BY x) - n AS before, sum(n) OVER (PARTITION BY f) AS total,
         row_number() OVER (PARTITION BY f ORDER BY x) AS k, count(*) OVER (PARTITION BY f) AS different
  FROM (SELECT f, x, count(*) AS n FROM g_long WHERE x IS NOT NULL GROUP BY ALL)),
g_targets AS (
  SELECT f, i * (total / {bins}::DOUBLE) AS target FROM (SELECT DISTINCT f, total FROM g_values WHERE different > {bins}), range(1, {bins}) t(i)),
g_cuts AS MATERIALIZED (
  SELECT f, cut, row_number() OVER (PARTITION BY f ORDER BY cut) AS b
  FROM (SELECT f, x AS cut FROM g_values WHERE different <= {bins} AND k > 1
        UNION SELECT v.f, v.x FROM g_targets t ASOF JOIN g_values v ON t.f = v.f AND t.target >= v.before WHERE v.k > 1)),
g_binned AS MATERIALIZED (
  SELECT l.id, l.f, CASE WHEN l.x IS NOT NULL THEN coalesce(c.b, 0) END AS bin FROM g_long l ASOF LEFT JOIN g_cuts c ON l.f = c.f AND l.x >= c.cut),
g_margin_0 AS MATERIALIZED (SELECT id, y, base AS m FROM g_rows, g_base WHERE split = 'train')"""]
    for r in range(rounds):
        out.append(f"""
g_at_{r}_0 AS MATERIALIZED (SELECT id, round((m - y) * {UNITS})::BIGINT AS g, 1 AS node FROM g_margin_{r})""")
        for d in range(depth):
            at, gain = f"g_at_{r}_{d}", f"{_score('gl', 'nl', reg_lambda)} + {_score('g - gl', 'n - nl', reg_lambda)} - {_score('g', 'n', reg_lambda)}"
            out.append(f"""
g_cells_{r}_{d} AS MATERIALIZED (
  SELECT node, f, bin, sum(g) AS cg, count(*) AS cn FROM {at} JOIN g_binned USING (id) WHERE node >= {2 ** d} GROUP BY ALL),
g_best_{r}_{d} AS MATERIALIZED (
  SELECT node, f, bin, dl, gain
  FROM (SELECT *, {gain} AS gain
        FROM (SELECT c.node, c.f, c.bin, dl, t.g, t.n,
                     sum(cg) OVER (PARTITION BY c.node, c.f, dl ORDER BY c.bin) + dl * coalesce(m.mg, 0) AS gl,
                     sum(cn) OVER (PARTITION BY c.node, c.f, dl ORDER BY c.bin) + dl * coalesce(m.mn, 0) AS nl
              FROM g_cells_{r}_{d} c CROSS JOIN (VALUES (0), (1)) side(dl)
              JOIN (SELECT node, sum(g) AS g, count(*) AS n FROM {at} GROUP BY node) t ON t.node = c.node
              LEFT JOIN (SELECT node, f, cg AS mg, cn AS mn FROM g_cells_{r}_{d} WHERE bin IS NULL) m ON m.node = c.node AND m.f = c.f
              WHERE c.bin IS NOT NULL AND (dl = 0 OR mn > 0)))
  WHERE nl >= {min_child} AND n - nl >= {min_child} AND gain > 1e-6
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, dl, bin) = 1),
g_at_{r}_{d + 1} AS MATERIALIZED (
  SELECT a.id, a.g, CASE WHEN s.node IS NULL THEN a.node
                         ELSE 2 * a.node + (CASE WHEN v.bin IS NULL THEN s.dl = 0 ELSE v.bin > s.bin END)::INT END AS node
  FROM {at} a LEFT JOIN g_best_{r}_{d} s ON s.node = a.node LEFT JOIN g_binned v ON v.id = a.id AND v.f = s.f)""")
        splits = " UNION ALL ".join(f"SELECT * FROM g_best_{r}_{d}" for d in range(depth))
        ends = " UNION ALL ".join(f"SELECT node, g FROM g_at_{r}_{d} WHERE node >= {2 ** d}" for d in range(depth + 1))
        out.append(f"""
g_splits_{r} AS MATERIALIZED ({splits}),
g_nodes_{r} AS MATERIALIZED (
  SELECT {r} AS tree, e.node AS path, s.f, c.cut AS threshold, s.dl = 1 AS default_left, coalesce(s.gain, 0.0) AS gain, e.n AS rows,
         CASE WHEN s.node IS NULL THEN -(e.g / {UNITS}::DOUBLE) / (e.n + {reg_lambda}::DOUBLE) * {rate}::DOUBLE ELSE 0.0 END AS value
  FROM (SELECT node, sum(g) AS g, count(*) AS n FROM ({ends}) GROUP BY node) e LEFT JOIN g_splits_{r} s ON s.node = e.node
  LEFT JOIN g_cuts c ON c.f = s.f AND c.b = s.bin + 1),
g_margin_{r + 1} AS MATERIALIZED (
  SELECT id, y, m + value AS m FROM g_margin_{r} JOIN g_at_{r}_{depth} USING (id) JOIN g_nodes_{r} n ON n.path = node)""")
    out.append("""
tree_nodes AS MATERIALIZED (""" + " UNION ALL ".join(f"SELECT * FROM g_nodes_{r}" for r in range(rounds)) + ")")
    # Scores of all rows by the raw values and thresholds, tree after tree.
    walked = "SELECT id, 1 AS node FROM g_rows"
    for r in range(rounds):
        node = walked
        for _ in range(depth):
            node = f"""
    SELECT w.id, CASE WHEN n.f IS NULL THEN w.node
                      ELSE 2 * w.node + (CASE WHEN xs[n.f + 1] IS NULL THEN NOT n.default_left
                                              ELSE NOT coalesce(xs[n.f + 1] < n.threshold, true) END)::INT END AS node
    FROM ({node}) w JOIN g_rows USING (id) JOIN g_nodes_{r} n ON n.path = w.node"""
        out.append(f"""
g_reached_{r} AS (SELECT w.id, n.value FROM ({node}) w JOIN g_nodes_{r} n ON n.path = w.node)""")
    total = " + ".join(["base", *(f"v{r}.value" for r in range(rounds))])
    joins = " ".join(f"JOIN g_reached_{r} v{r} ON v{r}.id = g_rows.id" for r in range(rounds))
    out.append(f"""
scores AS (SELECT split, seconds AS y, {total} AS raw FROM g_rows {joins} CROSS JOIN g_base)""")
    return ",".join(out)
