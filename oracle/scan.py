"""DuckDB text of the scan: dedupe, fill, baselines, forest, rules."""

from oracle.views import query, rnd

SLICE = "region, product_name, customer_tier"
MEASURES = (
    "merchant_category, daily_spend_amount, transaction_count, avg_ticket_size, success_rate_pct, avg_latency_ms, "
    "chargeback_rate_pct, avg_fraud_risk_score"
)
CARRIED = ["success_rate_pct", "avg_latency_ms", "chargeback_rate_pct", "avg_fraud_risk_score"]
BASELINES = {"success_rate_pct": 0.05, "avg_latency_ms": 5.0, "chargeback_rate_pct": 0.05}


def deduped(source: str) -> str:
    order = ", ".join(f"{c.strip()} NULLS FIRST" for c in MEASURES.split(",") if c.strip() != "avg_ticket_size")
    return f"""
deduped AS (
  SELECT * FROM {source} WHERE region IS NOT NULL AND product_name IS NOT NULL AND customer_tier IS NOT NULL AND metric_date IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {SLICE}, metric_date ORDER BY {order}) = 1)"""


def filled() -> str:
    carried = ",\n    ".join(
        f"coalesce(last_value(d.{c} IGNORE NULLS) OVER (PARTITION BY s.region, s.product_name, s.customer_tier ORDER BY s.metric_date"
        f" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),"
        f" first_value(d.{c} IGNORE NULLS) OVER (PARTITION BY s.region, s.product_name, s.customer_tier ORDER BY s.metric_date"
        f" ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"
        for c in CARRIED
    )
    return f"""
spine AS (
  SELECT {SLICE}, CAST(unnest(generate_series(min(metric_date), max(metric_date), INTERVAL 1 DAY)) AS DATE) AS metric_date
  FROM deduped GROUP BY {SLICE} HAVING count(*) >= 3),
filled AS (
  SELECT s.region, s.product_name, s.customer_tier, s.metric_date,
    {carried},
    coalesce(CAST(d.daily_spend_amount AS DOUBLE), 0.0) AS daily_spend_amount,
    coalesce(CAST(d.transaction_count AS DOUBLE), 0.0) AS transaction_count,
    d.metric_date IS NOT NULL AS is_observed
  FROM spine s LEFT JOIN deduped d USING (region, product_name, customer_tier, metric_date))"""


def baselined(window: int) -> str:
    cols = []
    for c, floor in BASELINES.items():
        cols.append(f"CASE WHEN count({c}) OVER w >= 3 THEN avg({c}) OVER w END AS mean_{c}")
        cols.append(
            f"coalesce(CASE WHEN count({c}) OVER w >= 3 AND stddev_samp({c}) OVER w > 1e-9"
            f" THEN stddev_samp({c}) OVER w END, {floor}::DOUBLE) AS sd_{c}"
        )
    return (
        "baselined AS (SELECT *, "
        + ",\n  ".join(cols)
        + f" FROM filled WINDOW w AS (PARTITION BY {SLICE} ORDER BY metric_date ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW))"
    )


def scored() -> str:
    cols = []
    for c in BASELINES:
        cols.append(f"coalesce(({c} - mean_{c}) / sd_{c}, 0.0) AS z_{c}")
        cols.append(f"coalesce(mean_{c}, {c}) AS expected_{c}")
    return "scored AS (SELECT *, " + ", ".join(cols) + " FROM baselined)"


WITHOUT_FOREST = "isolated AS (SELECT *, 0.0::DOUBLE AS iso_score, FALSE AS is_isolated FROM scored)"

P = 2147483647
FEATURES = ["success_rate_pct", "avg_latency_ms", "chargeback_rate_pct", "daily_spend_amount"]


def mix(tree: str, item: str, purpose: int) -> str:
    h = f"((seed + {tree} * 1000003 + {item} * 7919 + {purpose} * 104729) % {P})"
    h = f"(({h} * {h} + 12345) % {P})"
    h = f"(({h} * 48271 + {tree}) % {P})"
    h = f"(({h} * {h} + 67890) % {P})"
    h = f"(({h} * 16807 + {item}) % {P})"
    return f"(({h} * {h} + {purpose}) % {P})"


def forest(contamination: float = 0.03, max_depth: int = 8) -> list[str]:
    feats = ", ".join(f"coalesce({c}, 0.0) AS f{i}" for i, c in enumerate(FEATURES))
    ctes = [
        f"""pts AS (
  SELECT {SLICE}, metric_date, {feats}, count(*) OVER (PARTITION BY {SLICE}) AS n,
    (metric_date - DATE '1970-01-01')::BIGINT AS day_no,
    ('0x' || substr(md5(region || '|' || product_name || '|' || customer_tier), 1, 8))::BIGINT % {P} AS seed
  FROM scored)""",
        f"""sized AS MATERIALIZED (
  SELECT *, least(n, 256) AS psi, CAST(ceil(log2(greatest(least(n, 256), 2))) AS BIGINT) AS depth_max FROM pts WHERE n >= 7)""",
        f"""g0 AS MATERIALIZED (
  SELECT {SLICE}, seed, depth_max, t, 1::BIGINT AS node, f0, f1, f2, f3
  FROM sized, (SELECT unnest(range(0, 50)) AS t)
  QUALIFY row_number() OVER (PARTITION BY {SLICE}, t ORDER BY {mix('t', 'day_no', 3)}, day_no) <= 256)""",
    ]
    key = f"{SLICE}, seed, depth_max, t, node"
    for level in range(max_depth):
        lo_hi = ", ".join(f"min(f{i}) AS lo{i}, max(f{i}) AS hi{i}" for i in range(4))
        varies = [f"CAST(hi{i} > lo{i} AS BIGINT)" for i in range(4)]
        choices = " + ".join(varies)
        before = ["0"] + [" + ".join(varies[:i]) for i in range(1, 4)]
        pick = " ".join(f"WHEN hi{i} > lo{i} AND ({before[i]}) = pick THEN {i}" for i in range(4))
        lo = "CASE feat WHEN 0 THEN lo0 WHEN 1 THEN lo1 WHEN 2 THEN lo2 WHEN 3 THEN lo3 END"
        hi = "CASE feat WHEN 0 THEN hi0 WHEN 1 THEN hi1 WHEN 2 THEN hi2 WHEN 3 THEN hi3 END"
        ctes.append(
            f"""n{level} AS MATERIALIZED (
  SELECT *, CASE WHEN cut0 >= hi THEN lo ELSE cut0 END AS cut FROM (
    SELECT *, lo + ({mix('t', 'node', 2)}::DOUBLE / {P}) * (hi - lo) AS cut0 FROM (
      SELECT *, {lo} AS lo, {hi} AS hi FROM (
        SELECT *, CASE WHEN choices > 0 AND {level} < depth_max THEN (CASE {pick} END) END AS feat FROM (
          SELECT *, {mix('t', 'node', 1)} * choices // {P} AS pick FROM (
            SELECT *, {choices} AS choices FROM (
              SELECT {key}, count(*) AS cnt, {lo_hi} FROM g{level} GROUP BY {key})))))))"""
        )
        value = "CASE n.feat WHEN 0 THEN g.f0 WHEN 1 THEN g.f1 WHEN 2 THEN g.f2 WHEN 3 THEN g.f3 END"
        ctes.append(
            f"""g{level + 1} AS MATERIALIZED (
  SELECT g.region, g.product_name, g.customer_tier, g.seed, g.depth_max, g.t,
    2 * g.node + CASE WHEN {value} > n.cut THEN 1 ELSE 0 END AS node, g.f0, g.f1, g.f2, g.f3
  FROM g{level} g JOIN n{level} n USING (region, product_name, customer_tier, t, node) WHERE n.feat IS NOT NULL)"""
        )
    ctes.append(
        f"n{max_depth} AS MATERIALIZED (SELECT {key}, count(*) AS cnt, NULL::INTEGER AS feat, NULL::DOUBLE AS cut FROM g{max_depth} GROUP BY {key})"
    )
    ctes.append(
        f"w0 AS (SELECT {SLICE}, metric_date, psi, t, 1::BIGINT AS node, f0, f1, f2, f3 FROM sized, (SELECT unnest(range(0, 50)) AS t))"
    )
    leaf = (
        "CASE WHEN n.cnt <= 1 THEN 0.0 WHEN n.cnt = 2 THEN 1.0"
        " ELSE 2.0 * (ln(n.cnt - 1.0) + 0.5772156649) - 2.0 * (n.cnt - 1.0) / n.cnt END"
    )
    for level in range(max_depth + 1):
        cut = f"CASE n.feat WHEN 0 THEN w.f0 WHEN 1 THEN w.f1 WHEN 2 THEN w.f2 WHEN 3 THEN w.f3 END > n.cut"
        ctes.append(
            f"""s{level} AS MATERIALIZED (
  SELECT w.*, n.feat, {level} + {leaf} AS path, 2 * w.node + CASE WHEN {cut} THEN 1 ELSE 0 END AS next_node
  FROM w{level} w JOIN n{level} n USING (region, product_name, customer_tier, t, node))"""
        )
        if level < max_depth:
            ctes.append(
                f"w{level + 1} AS (SELECT {SLICE}, metric_date, psi, t, next_node AS node, f0, f1, f2, f3 FROM s{level} WHERE feat IS NOT NULL)"
            )
    paths = " UNION ALL ".join(f"SELECT {SLICE}, metric_date, psi, path FROM s{i} WHERE feat IS NULL" for i in range(max_depth + 1))
    ctes += [
        f"paths AS ({paths})",
        f"""raw_scores AS (
  SELECT {SLICE}, metric_date, -round(pow(2.0, -(sum(path) / 50.0) / CASE WHEN psi = 2 THEN 1.0
    ELSE 2.0 * (ln(psi - 1.0) + 0.5772156649) - 2.0 * (psi - 1.0) / psi END), 8) AS score
  FROM paths GROUP BY {SLICE}, metric_date, psi)""",
        f"""decisions AS (
  SELECT {SLICE}, metric_date, round(score - quantile_cont(score, {contamination}) OVER (PARTITION BY {SLICE}), 8) AS decision FROM raw_scores)""",
        """isolated AS (
  SELECT scored.*, coalesce(decision, 0.0) AS iso_score, coalesce(decision < 0, FALSE) AS is_isolated
  FROM scored LEFT JOIN decisions USING (region, product_name, customer_tier, metric_date))""",
    ]
    return ctes


def signals(threshold: float = 2.5, name: str = "signals") -> str:
    t = threshold
    parts = []
    rules = [
        (
            "success_rate_plunge",
            "success_rate_pct",
            f"(z <= -{t} AND (x <= e - 2.0 OR x <= 95.0)) OR x <= 85.0 OR (is_isolated AND x <= 92.0)",
            "x <= 80.0 OR z <= -3.5",
            "-50.0",
        ),
        (
            "avg_latency_surge",
            "avg_latency_ms",
            f"(z >= {t} AND x >= 500.0) OR x >= 1500.0 OR (is_isolated AND x >= 800.0)",
            "x >= 2000.0 OR z >= 4.0",
            "100.0",
        ),
        (
            "chargeback_dispute_spike",
            "chargeback_rate_pct",
            f"x >= 2.0 OR (z >= {t} AND x >= 1.0) OR (is_isolated AND x >= 1.5)",
            "x >= 5.0",
            "200.0",
        ),
    ]
    for rule, metric, fires, critical, flat in rules:
        parts.append(
            f"""SELECT {SLICE}, metric_date, '{rule}' AS metric_name, x AS actual_value, {rnd('e', 2)} AS expected_value,
    {rnd(f'CASE WHEN e > 0 THEN (x - e) / e * 100.0 ELSE {flat} END', 2)} AS deviation_pct, {rnd('z', 2)} AS z_score,
    CASE WHEN {critical} THEN 'CRITICAL' ELSE 'HIGH' END AS severity, {rnd('iso_score', 4)} AS isolation_score
  FROM (SELECT {SLICE}, metric_date, {metric} AS x, z_{metric} AS z, expected_{metric} AS e, iso_score, is_isolated
        FROM isolated WHERE is_observed) WHERE {fires}"""
        )
    return f"{name} AS (" + "\n  UNION ALL ".join(parts) + ")"


def scan(view: str, source: str, window: int = 14, threshold: float = 2.5, use_forest: bool = False, max_depth: int = 8):
    """CTEs from a metrics view to its ``signals``."""
    steps = [view, deduped(source), filled(), baselined(window), scored()]
    steps += forest(max_depth=max_depth) if use_forest else [WITHOUT_FOREST]
    return [*steps, signals(threshold)]


SIGNAL_SELECT = f"""SELECT strftime(metric_date, '%Y-%m-%d') AS metric_date, {SLICE}, metric_name,
  {rnd('actual_value', 6)} AS actual_value, expected_value, deviation_pct, z_score, isolation_score, severity FROM signals"""


def scan_query(view: str, source: str, **kw) -> str:
    return query(*scan(view, source, **kw), select=SIGNAL_SELECT)
