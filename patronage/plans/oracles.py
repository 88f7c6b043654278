"""The same results stated in SQL, one text per query of the catalog.

The texts run on the star-schema tables and use only exact sums (decimals and whole numbers)
where an order-dependent sum could change the last bits; other doubles are rounded on
both sides. Queries that fit models have no text.
"""

from __future__ import annotations

from dataclasses import replace

AS_OF = "TIMESTAMP '2002-01-01 00:00:00'"


def _even(x: str, digits: int = 2) -> str:
    factor = f"1e{digits}"
    return f"(round_even(({x}) * {factor}, 0) / {factor})"


def _money(x: str) -> str:
    return f"coalesce(CAST(sum(CAST({x} AS DECIMAL(18,2))) AS DOUBLE), 0e0)"


CUSTOMERS = """cust AS (SELECT c_custkey AS customer_id, c_name AS name, c_nationkey AS nation,
  c_acctbal AS balance, c_mktsegment AS segment FROM customer)"""
GAPS = """gaps AS (SELECT c_custkey AS customer_id, c_name AS name,
  CASE WHEN c_nationkey >= 5 THEN c_nationkey END AS nation,
  CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance,
  CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS segment FROM customer)"""
RFM = f"""bought AS (SELECT o_custkey, count(*) AS n, {_money('o_totalprice')} AS spent,
  max(o_orderdate) AS last_at FROM orders GROUP BY o_custkey),
rfm AS (SELECT c_custkey AS customer_id, c_nationkey AS nation, c_acctbal AS balance,
  CAST(coalesce(n, 0) AS BIGINT) AS purchase_frequency, coalesce(spent, 0e0) AS total_spent,
  last_at AS last_purchase_date,
  CASE WHEN coalesce(n, 0) > 0 THEN spent / n ELSE 0e0 END AS avg_transaction_value,
  CAST(coalesce(date_sub('day', last_at, {AS_OF}), 365) AS BIGINT) AS days_since_last_purchase
  FROM customer LEFT JOIN bought ON o_custkey = c_custkey)"""
SCORED = RFM + """,
recent AS (SELECT *, CASE WHEN days_since_last_purchase > 0
  THEN 1e0 / (1e0 + days_since_last_purchase / 30e0) ELSE 0e0 END AS recency_score FROM rfm),
stat AS (SELECT avg(purchase_frequency) mf, stddev_samp(purchase_frequency) sf,
  avg(total_spent) ms, stddev_samp(total_spent) ss, avg(recency_score) mr,
  stddev_samp(recency_score) sr FROM recent),
normed AS (SELECT recent.*,
  CASE WHEN sf > 0 THEN (purchase_frequency - mf) / sf ELSE 0e0 END AS purchase_frequency_normalized,
  CASE WHEN ss > 0 THEN (total_spent - ms) / ss ELSE 0e0 END AS total_spent_normalized,
  CASE WHEN sr > 0 THEN (recency_score - mr) / sr ELSE 0e0 END AS recency_score_normalized
  FROM recent, stat),
scored AS (SELECT *, (purchase_frequency_normalized + total_spent_normalized
  + recency_score_normalized) / 3e0 AS engagement_score FROM normed)"""
RULE = RFM + """,
pred AS (SELECT customer_id, least(greatest((days_since_last_purchase - 153) / 1e3, 0e0), 1e0)
  AS churn_probability FROM rfm),
predicted AS (SELECT *, CAST(churn_probability > 0.5e0 AS INTEGER) AS churn_prediction FROM pred)"""
VALUE = f"""value AS (SELECT o_custkey AS customer_id, {_money('o_totalprice')} AS total_spent,
  count(o_totalprice) AS total_transactions,
  {_even(_money('o_totalprice') + ' / count(o_totalprice)')} AS avg_transaction
  FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey)"""
PRODUCTS = f"""perf AS (SELECT l_partkey AS product_id, {_money('l_extendedprice')} AS total_revenue,
  count(l_extendedprice) AS total_sales,
  {_even(_money('l_extendedprice') + ' / count(l_extendedprice)')} AS avg_price
  FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY l_partkey),
total AS (SELECT {_money('total_revenue')} AS t FROM perf),
shared AS (SELECT perf.*, {_even('total_revenue / t * 100e0')} AS revenue_share, t FROM perf, total)"""
PARETO = PRODUCTS + """,
curve AS (SELECT product_id, total_revenue, total_sales, avg_price, revenue_share,
  row_number() OVER w - 1 AS product_rank,
  CAST(sum(CAST(total_revenue AS DECIMAL(18,2))) OVER w AS DOUBLE) / t * 100e0 AS cumulative_share,
  CAST(sum(CAST(revenue_share AS DECIMAL(18,2))) OVER w AS DOUBLE) AS cumulative_rounded
  FROM shared WINDOW w AS (ORDER BY total_revenue DESC, product_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _trend(unit: str, label: str) -> str:
    return f"""SELECT CAST(date_trunc('{unit}', o_orderdate) AS DATE) AS period_start,
      {label} AS period, {_money('o_totalprice')} AS total_revenue,
      count(o_totalprice) AS transaction_count,
      {_even(_money('o_totalprice') + ' / count(o_totalprice)')} AS avg_transaction
      FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1, 2"""


_MONTH = "strftime(date_trunc('month', o_orderdate), '%Y-%m')"
GROWTH = f"""trend AS ({_trend('month', _MONTH)}),
growth AS (SELECT *,
  (total_revenue / nullif(lag(total_revenue) OVER w, 0) - 1) * 100e0 AS revenue_growth,
  (CAST(transaction_count AS DOUBLE) / nullif(lag(transaction_count) OVER w, 0) - 1) * 100e0
    AS transaction_growth
  FROM trend WINDOW w AS (ORDER BY period_start))"""


def _histogram(ctes: str, source: str, column: str, bins: int) -> str:
    return f"""WITH {ctes},
    span AS (SELECT CAST(min({column}) AS DOUBLE) lo, CAST(max({column}) AS DOUBLE) hi,
      (CAST(max({column}) AS DOUBLE) - CAST(min({column}) AS DOUBLE)) / {bins}e0 AS width FROM {source}),
    counted AS (SELECT CAST(CASE WHEN width > 0
      THEN least(floor(({column} - lo) / width), {bins - 1}) ELSE 0 END AS BIGINT) AS bin, count(*) n
      FROM {source}, span WHERE {column} IS NOT NULL GROUP BY 1)
    SELECT CAST(r.range AS BIGINT) AS bin, lo + r.range * width AS lower,
      lo + (r.range + 1) * width AS upper, CAST(coalesce(n, 0) AS BIGINT) AS n
    FROM range({bins}) r CROSS JOIN span LEFT JOIN counted ON counted.bin = r.range"""


def _described(column: str) -> str:
    return f"""SELECT '{column}' AS feature, count({column}) AS "count",
      {_even(f'avg({column})', 4)} AS mean, {_even(f'stddev_samp({column})', 4)} AS std,
      CAST(min({column}) AS DOUBLE) AS "min",
      {_even(f'quantile_cont(CAST({column} AS DOUBLE), 0.25)', 4)} AS p25,
      {_even(f'quantile_cont(CAST({column} AS DOUBLE), 0.5)', 4)} AS p50,
      {_even(f'quantile_cont(CAST({column} AS DOUBLE), 0.75)', 4)} AS p75,
      CAST(max({column}) AS DOUBLE) AS "max" FROM rfm"""


BEHAVIOUR = ("purchase_frequency", "total_spent", "avg_transaction_value",
             "days_since_last_purchase")


def _scaled(columns, source: str) -> str:
    parts = ", ".join(
        f"(SELECT CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) END FROM {source}) AS s_{c}, "
        f"(SELECT avg({c}) FROM {source}) AS m_{c}" for c in columns)
    return f"(SELECT {parts})"


def _scale_list(columns, digits: int | None = 6) -> str:
    def one(c: str) -> str:
        x = f"coalesce(({c} - m_{c}) / s_{c}, 0e0)"
        return f"{_even(x, digits) if digits else x} AS {c}"
    return ", ".join(one(c) for c in columns)


def _reasons(weights: dict[str, float], tree: bool) -> str:
    rows = " UNION ALL ".join(
        f"SELECT customer_id, {i} AS i, '{c}' AS feature, CAST({c} AS DOUBLE) AS value, "
        f"CAST('{w!r}' AS DOUBLE) AS w FROM rfm" for i, (c, w) in enumerate(weights.items()))
    size = "abs(value) * w" if tree else "abs(value * w)"
    shown = ("w AS importance_weight, abs(value) * w AS reason_score" if tree else
             "w AS coef, value * w AS impact, CASE WHEN value * w > 0 THEN '↑ increases churn risk'"
             " ELSE '↓ decreases churn risk' END AS effect")
    return f"""WITH {RFM}, long AS ({rows}),
    placed AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY {size} DESC, i) AS r
      FROM long)
    SELECT customer_id, r AS reason_rank, feature, value, {shown} FROM placed WHERE r <= 3"""


_DB_COLS = ("purchase_frequency", "total_spent", "days_since_last_purchase")
DENSITY = f"""{RFM},
pts AS (SELECT customer_id AS id, {_scale_list(_DB_COLS, None)}
  FROM rfm, {_scaled(_DB_COLS, 'rfm')}),
near AS (SELECT p.id AS a, q.id AS b FROM pts p JOIN pts q ON
  (p.purchase_frequency - q.purchase_frequency) ** 2 + (p.total_spent - q.total_spent) ** 2
  + (p.days_since_last_purchase - q.days_since_last_purchase) ** 2 <= 0.3e0 * 0.3e0),
core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 5),
core_edge AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
touched AS (SELECT DISTINCT a AS id FROM near WHERE b IN (SELECT id FROM core))"""
CLUSTERS = DENSITY + """,
reach(id, seed) AS (SELECT id, id FROM core
  UNION SELECT e.b, r.seed FROM reach r JOIN core_edge e ON e.a = r.id WHERE r.seed < e.b),
seeds AS (SELECT id, min(seed) AS seed FROM reach GROUP BY id),
numbered AS (SELECT id, dense_rank() OVER (ORDER BY seed) - 1 AS number FROM seeds),
labelled AS (SELECT id, number FROM numbered UNION ALL
  SELECT n.a, min(number) FROM near n JOIN numbered c ON c.id = n.b
  WHERE n.a NOT IN (SELECT id FROM core) GROUP BY n.a),
clustered AS (SELECT pts.id AS customer_id, coalesce(number, -1) AS cluster
  FROM pts LEFT JOIN labelled USING (id))"""

# Closed-form line and seasonal effects, per series key.
Z80 = "1.2815515655446004e0"


def _fit(series: str, key: str = "", daily: bool = False) -> str:
    k = f"{key}, " if key else ""
    by_key = f"GROUP BY {key}" if key else ""
    part = f"PARTITION BY {key}" if key else ""
    and_key = f"{key}," if key else ""
    weekly = ("avg(y - trend - yearly) OVER (PARTITION BY " + and_key + " isodow(ds))"
              if daily else "0e0")
    on = f"USING ({key})" if key else "ON true"
    return f"""series AS ({series}),
    nums AS (SELECT *, date_diff('day', min(ds) OVER ({part}), ds) AS x,
      CAST(round_even(y * 1e2, 0) AS BIGINT) AS c FROM series),
    means AS (SELECT *, avg(x) OVER ({part}) AS mx,
      CAST(sum(c) OVER ({part}) AS DOUBLE) / count(c) OVER ({part}) AS mc,
      CAST(sum(x) OVER mon AS DOUBLE) / count(x) OVER mon AS mxm,
      CAST(sum(c) OVER mon AS DOUBLE) / count(c) OVER mon AS mcm FROM nums
      WINDOW mon AS (PARTITION BY {and_key} month(ds))),
    lines AS (SELECT {k}min(ds) AS first_ds, max(ds) AS last_ds, any_value(mx) AS mx,
      any_value(mc) AS mc, coalesce(CASE WHEN max(x) >= 690 THEN
        sum((x - mxm) * (c - mcm)) / nullif(sum((x - mxm) * (x - mxm)), 0) END,
        sum((x - mx) * (c - mc)) / nullif(sum((x - mx) * (x - mx)), 0), 0e0) AS slope
      FROM means {by_key}),
    levels AS (SELECT *, mc - slope * mx AS level FROM lines),
    months AS (SELECT {k}month(ds) AS m, any_value((mcm - (level + slope * mxm)) / 1e2) AS yearly
      FROM means JOIN levels {on} GROUP BY {k}month(ds)),
    trended AS (SELECT nums.*, yearly, (level + slope * x) / 1e2 AS trend
      FROM nums JOIN levels {on} JOIN months ON m = month(ds)
      {f'AND months.{key} = nums.{key}' if key else ''}),
    history AS (SELECT *, {weekly} AS weekly FROM trended),
    spread AS (SELECT {k}sqrt(avg((y - (trend + yearly + weekly)) ** 2)) AS sigma
      FROM history {by_key})"""


def _ahead(step: str, steps: int, key: str = "", daily: bool = False) -> str:
    k = f"{key}, " if key else ""
    on = f"USING ({key})" if key else "ON true"
    lk = f"levels.{key}, " if key else ""
    weekly = "coalesce(weekly, 0e0)" if daily else "0e0"
    days = ("LEFT JOIN (SELECT DISTINCT isodow(ds) AS dow, weekly FROM history) w "
            "ON w.dow = isodow(calendar.ds)" if daily else "")
    same = f"AND months.{key} = calendar.{key}" if key else ""
    return f"""calendar AS (SELECT {lk}CAST(last_ds + i * INTERVAL {step} AS DATE) AS ds,
      first_ds, level, slope, sigma FROM levels JOIN spread {on}
      CROSS JOIN (SELECT unnest(generate_series(1, {steps})) AS i)),
    future AS (SELECT calendar.*,
      (level + slope * date_diff('day', first_ds, ds)) / 1e2 AS trend,
      coalesce(yearly, 0e0) AS yearly, {weekly} AS weekly
      FROM calendar LEFT JOIN months ON m = month(ds) {same} {days}),
    ahead AS (SELECT {k}ds, trend, yearly, weekly, sigma, trend + yearly + weekly AS yhat FROM future)"""


def _table(key: str = "") -> str:
    k = f"{key}, " if key else ""
    return f"""SELECT {k}ds AS date, {_even('yhat')} AS forecast,
      {_even(f'yhat - {Z80} * sigma')} AS lower_bound,
      {_even(f'yhat + {Z80} * sigma')} AS upper_bound FROM ahead"""


def _series(unit: str) -> str:
    return (f"SELECT CAST(date_trunc('{unit}', o_orderdate) AS DATE) AS ds, "
            f"{_money('o_totalprice')} AS y FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1")


MONTHLY = _fit(_series("month")) + ", " + _ahead("1 MONTH", 12)
SUMMARY = MONTHLY + """,
every AS (SELECT ds, trend FROM history UNION ALL SELECT ds, trend FROM ahead),
figures AS (SELECT (SELECT CAST(sum(CAST(y AS DECIMAL(18,2))) AS DOUBLE) / count(*) FROM series) AS ah,
  avg(yhat) AS af, sum(yhat) AS tf, arg_max(ds, yhat) AS best_period,
  arg_min(ds, yhat) AS worst_period,
  (SELECT CASE WHEN arg_max(trend, ds) > arg_min(trend, ds) THEN 'increasing' ELSE 'decreasing' END
   FROM every) AS trend_direction FROM ahead),
grown AS (SELECT *, CASE WHEN ah > 0 THEN (af - ah) / ah * 100e0 ELSE 0e0 END AS g FROM figures),
summary AS (SELECT *, CASE WHEN g > 5 THEN 'strong' WHEN g > 0 THEN 'mild' ELSE 'decline' END
  AS outlook FROM grown)"""


def _bending(series: str, shape, step: str, steps: int, key: str = "", draws: int = 200,
             seed: int = 42) -> str:
    """The forecast with a bending trend: sums, sweeps one after the other, and simulated bounds."""
    size, c, y = shape.size, shape.changes, 2 * shape.yearly
    k = f"{key}, " if key else ""
    on = f"USING ({key})" if key else "ON true"
    ridge = "[" + ", ".join(f"{r!r}::DOUBLE" for r in shape.ridge()) + "]"
    hinges = ", ".join(f"greatest(t - {p!r}::DOUBLE, 0e0)" for p in shape.places())
    waves = ", ".join(f"{f}(dn * {2.0 * i / 365.25!r}::DOUBLE * pi())"
                      for i in range(1, shape.yearly + 1) for f in ("sin", "cos"))
    terms = f"[1e0, t, {hinges}, {waves}]"
    dot = lambda a, b: f"list_sum(list_transform({a}, lambda u, e: u * {b}))"
    return f"""raw AS ({series}),
    span AS (SELECT {k}min(ds) AS first_ds, max(ds) AS last_ds, count(*) AS n,
      greatest(date_diff('day', min(ds), max(ds)), 1)::DOUBLE AS days,
      CASE WHEN max(abs(y)) > 0 THEN max(abs(y)) ELSE 1e0 END AS size FROM raw
      {f'GROUP BY {key}' if key else ''}),
    placed AS (SELECT {k}y / size AS v, date_diff('day', first_ds, ds) / days AS t,
      date_diff('day', DATE '1970-01-01', ds)::DOUBLE AS dn FROM raw JOIN span {on}),
    z AS (SELECT {k}{terms[:-1]}, v] AS z FROM placed),
    products AS (SELECT {k}i, j, sum(z[i] * z[j]) AS v FROM z,
      (SELECT unnest(range(1, {size + 2})) AS i), (SELECT unnest(range(1, {size + 2})) AS j)
      GROUP BY {k}i, j),
    lines AS (SELECT {k}i, list(v + CASE WHEN i = j AND i <= {size} THEN {ridge}[i] ELSE 0e0 END
      ORDER BY j) AS line FROM products GROUP BY {k}i),
    swept AS (SELECT {k}1::BIGINT AS p, list(line ORDER BY i) AS a FROM lines
      {f'GROUP BY {key}' if key else ''}
      UNION ALL SELECT {k}p + 1, list_transform(a, lambda line, i: list_transform(line, lambda x, j:
        CASE WHEN i = p AND j = p THEN -1e0 / a[p][p] WHEN i = p OR j = p THEN x / a[p][p]
        ELSE x - line[p] * a[p][j] / a[p][p] END)) FROM swept WHERE p <= {size}),
    solved AS (SELECT {k}a, a[{size + 1}][1:{size}] AS w, n, first_ds, last_ds, days, size
      FROM swept JOIN span {on} WHERE p = {size + 1}),
    fit AS (SELECT *, sqrt(greatest(a[{size + 1}][{size + 1}]
        - list_sum(list_transform(w, lambda x, i: x * x * {ridge}[i])), 0e0)
        / greatest(n - list_sum(list_transform({ridge}, lambda r, i: 1e0 + r * a[i][i])), 1e0)) AS sigma,
      list_avg(list_transform(w[3:{2 + c}], lambda x: abs(x))) AS strength FROM solved),
    future AS (SELECT *, CAST(last_ds + h * INTERVAL {step} AS DATE) AS ds
      FROM fit, (SELECT unnest(range(1, {steps + 1})) AS h)),
    timed AS (SELECT *, date_diff('day', first_ds, ds) / days AS t,
      date_diff('day', DATE '1970-01-01', ds)::DOUBLE AS dn,
      coalesce(lag(date_diff('day', first_ds, ds) / days) OVER (
        {f'PARTITION BY {key}' if key else ''} ORDER BY h),
        date_diff('day', first_ds, last_ds) / days) AS t_before FROM future),
    termed AS (SELECT *, {terms} AS x FROM timed),
    valued AS (SELECT *, size * {dot(f'x[1:{2 + c}]', 'w[e]')} AS trend,
      size * {dot(f'x[{3 + c}:{2 + c + y}]', f'w[{2 + c} + e]')} AS yearly,
      sigma * sqrt(1e0 + greatest(-list_sum(list_transform(x, lambda u, i: u * list_sum(
        list_transform(x, lambda o, j: o * a[i][j])))), 0e0)) AS spread FROM termed),
    code AS (SELECT s, h, md5(concat_ws(':', {seed}, s, h)) AS code
      FROM (SELECT unnest(range(1, {draws + 1})) AS s), (SELECT unnest(range(1, {steps + 1})) AS h)),
    chance AS (SELECT s, h, {', '.join(
        f"(CAST('0x' || substr(code, {8 * i + 1}, 8) AS BIGINT) + 0.5e0) / {2.0 ** 32!r}::DOUBLE AS u{i}"
        for i in range(4))} FROM code),
    draw AS (SELECT s, h, u0, -sign(u1 - 0.5e0) * ln(greatest(1e0 - 2e0 * abs(u1 - 0.5e0), 1e-12))
      AS bend, sqrt(-2e0 * ln(u2)) * cos(2e0 * pi() * u3) AS noise FROM chance),
    sloped AS (SELECT {k}s, v.h, spread, noise, t - t_before AS span, sum(
        CASE WHEN u0 < (t - t_before) * {c / shape.reach!r}::DOUBLE THEN bend * strength ELSE 0e0 END)
      OVER (PARTITION BY {k}s ORDER BY v.h) AS slope FROM valued v JOIN draw d ON d.h = v.h),
    paths AS (SELECT {k}h, sum(slope * span) OVER (PARTITION BY {k}s ORDER BY h) + spread * noise AS off
      FROM sloped),
    bounds AS (SELECT {k}h, quantile_cont(off, 0.1e0) AS low, quantile_cont(off, 1e0 - 0.1e0) AS high
      FROM paths GROUP BY {k}h),
    ahead AS (SELECT {k}ds, trend, yearly, trend + yearly AS yhat,
      trend + yearly + size * low AS yhat_lower, trend + yearly + size * high AS yhat_upper
      FROM valued JOIN bounds USING ({k}h))"""


def _bent(period: str):
    from patronage.operators.changepoints import SHAPES
    return SHAPES[period]


def _bent_table(series: str, shape, step: str, steps: int, key: str = "") -> str:
    shown = ["yhat", "yhat_lower", "yhat_upper", *([] if key else ["trend", "yearly"])]
    return (f"WITH RECURSIVE {_bending(series, shape, step, steps, key)} SELECT "
            + (f"{key}, " if key else "") + "ds, "
            + ", ".join(f"{_even(x, 0)} AS {x}" for x in shown) + " FROM ahead")


def _product_series() -> str:
    return f"""SELECT l_partkey AS product_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS ds,
        {_money('l_extendedprice')} AS y FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1, 2"""


def _normal_sums() -> str:
    shape = _bent("month")
    width = shape.size + 1
    return f"""WITH RECURSIVE {_bending(_series('month'), shape, '1 MONTH', 1)}
    SELECT CAST((i - 1) * {width} - ((i - 1) * (i - 2)) // 2 + j - i AS INTEGER) AS place,
      {_even('v', 6)} AS product FROM products WHERE i <= j"""


def _split_gains() -> str:
    from patronage.plans.catalog import GAIN_EDGES
    rows = " UNION ALL ".join(
        f"SELECT {i} AS feature, len(list_filter({cuts}, lambda e: e < {c})) AS bin, y FROM labelled"
        for i, (c, cuts) in enumerate(GAIN_EDGES.items()))
    score = lambda g, h: f"({g}) * ({g}) / (({h}) + 1e0)"
    return f"""WITH {RFM}, labelled AS (SELECT *, CAST(balance < 0 AS INTEGER) AS y FROM rfm),
    share AS (SELECT avg(y) AS p FROM labelled), long AS ({rows}),
    cells AS (SELECT feature, bin, count(*) AS n, sum(y) AS ones FROM long GROUP BY 1, 2),
    sides AS (SELECT feature, bin, p, sum(n) OVER w AS n_left, sum(ones) OVER w AS ones_left,
      sum(n) OVER (PARTITION BY feature) AS n_all, sum(ones) OVER (PARTITION BY feature) AS ones_all
      FROM cells, share WINDOW w AS (PARTITION BY feature ORDER BY bin)),
    sums AS (SELECT feature, bin, n_left * p - ones_left AS gl, n_left * p * (1 - p) AS hl,
      (n_all - n_left) * p - (ones_all - ones_left) AS gr, (n_all - n_left) * p * (1 - p) AS hr
      FROM sides WHERE n_all > n_left)
    SELECT CAST(feature AS INTEGER) AS feature, CAST(bin AS INTEGER) AS bin,
      {_even(f"({score('gl', 'hl')} + {score('gr', 'hr')} - {score('gl + gr', 'hl + hr')}) / 2e0", 6)}
        AS gain, {_even('gl', 6)} AS g_left, {_even('hl', 6)} AS h_left, {_even('gr', 6)} AS g_right,
      {_even('hr', 6)} AS h_right FROM sums WHERE hl >= 1 AND hr >= 1"""


def _hash(key: str, seed: int = 42) -> str:
    return (f"(CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, 13) AS BIGINT)"
            f" / CAST({16 ** 13} AS DOUBLE))")


def _dtypes() -> str:
    kinds = {
        "customers": ("customer", {"bigint": 1, "double": 1, "int": 1, "string": 2}),
        "transactions": ("orders", {"bigint": 2, "double": 1, "timestamp_ntz": 1}),
        "products": ("part", {"bigint": 1, "double": 1, "int": 1, "string": 3}),
    }
    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, '{k}' AS data_type, CAST({n} AS BIGINT) AS n_columns, "
        f"count(*) AS n_rows FROM {table}"
        for name, (table, types) in kinds.items() for k, n in types.items())


def _metrics_ctes() -> str:
    return """m AS (SELECT quality AS label, toxic AS prediction, count(*) AS n FROM labels GROUP BY 1, 2)"""


def _cluster_means(source: str, columns) -> str:
    return " UNION ALL ".join(
        f"SELECT nation AS cluster, {i} AS position, '{c}' AS feature, count(*) AS size, "
        f"avg({c}) AS mean_value, count({c}) AS cnt, (SELECT avg({c}) FROM {source}) AS base "
        f"FROM {source} GROUP BY nation" for i, c in enumerate(columns))


LINEAR_WEIGHTS = {"purchase_frequency": -0.25, "total_spent": -0.000001,
                  "avg_transaction_value": 0.00001, "days_since_last_purchase": 0.01}
TREE_WEIGHTS = {"purchase_frequency": 0.375, "total_spent": 0.000001,
                "avg_transaction_value": 0.00002, "days_since_last_purchase": 0.125}

_FEATURES = ["nation", "balance", "segment", *BEHAVIOUR, "recency_score",
             "purchase_frequency_normalized", "total_spent_normalized",
             "recency_score_normalized", "engagement_score"]


def _retention() -> str:
    from patronage.operators.risk import RETENTION_ACTIONS
    rows = ", ".join(
        f"('{level}', {i + 1}, '{text}')" for level, texts in RETENTION_ACTIONS.items()
        for i, text in enumerate(texts))
    return f"(VALUES {rows}) AS act(risk, position, action)"


def _advice() -> str:
    from patronage.operators.forecast import OUTLOOKS
    rows = ", ".join(f"('{level}', {i + 1}, '{text}')" for level, texts in OUTLOOKS.items()
                     for i, text in enumerate(texts))
    return f"(VALUES {rows}) AS act(outlook, position, advice)"


_BUCKET = """CASE WHEN churn_probability IS NULL THEN 'Unknown' WHEN churn_probability < 0.3e0
  THEN 'Low' WHEN churn_probability < 0.7e0 THEN 'Medium' ELSE 'High' END"""


def _recommendations() -> str:
    from patronage.operators.segments import RECOMMENDATIONS
    return " UNION ALL ".join(
        f"SELECT nation AS cluster, count(*) AS customers, CAST({i + 1} AS BIGINT) AS position, "
        f"CASE WHEN avg({c}) > (SELECT median({c}) FROM scored) THEN '{hi}' ELSE '{lo}' END "
        f"AS recommendation FROM scored GROUP BY nation"
        for i, (c, (hi, lo)) in enumerate(RECOMMENDATIONS.items()))


def _opportunities() -> str:
    from patronage.operators.segments import OPPORTUNITIES
    parts = " UNION ALL ".join(
        f"SELECT '{o}' AS opportunity, nation AS cluster, avg({c}) AS mean_value, "
        f"{'-' if high else ''}avg({c}) AS s FROM scored GROUP BY nation"
        for o, (c, high) in OPPORTUNITIES.items())
    return f"""WITH {SCORED}, long AS ({parts}), placed AS (SELECT *, row_number() OVER (
      PARTITION BY opportunity ORDER BY s, cluster) AS opportunity_rank FROM long)
    SELECT opportunity, opportunity_rank, cluster, {_even('mean_value', 4)} AS mean_value
    FROM placed WHERE opportunity_rank <= 2"""


def _outliers() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg({c}) FILTER (days_since_last_purchase > 700) AS o, "
        f"avg({c}) FILTER (days_since_last_purchase <= 700) AS n FROM rfm" for c in BEHAVIOUR)
    return f"""WITH {RFM}, long AS ({parts}),
    pct AS (SELECT *, coalesce((o - n) / nullif(n, 0) * 100e0, 0e0) AS p FROM long)
    SELECT feature, {_even('o', 4)} AS outlier_mean, {_even('n', 4)} AS normal_mean,
      {_even('p', 6)} AS diff_pct FROM pct WHERE abs(p) > 10"""


_LABELLED = """CASE WHEN p > 10 THEN 'above average' WHEN p < -10 THEN 'below average'
  ELSE 'Near average' END"""

ORACLES: dict[str, str] = {
    "scan_customers": f"WITH {CUSTOMERS} SELECT * FROM cust",
    "scan_transactions_dates": """SELECT o_orderkey AS transaction_id, o_totalprice AS amount,
      try_cast(CASE WHEN o_orderstatus = 'P' THEN 'not a date'
        ELSE CAST(o_orderdate AS VARCHAR) END AS TIMESTAMP) AS date FROM orders""",
    "scan_products": """SELECT p_partkey AS product_id, p_name AS product_name, p_brand AS brand,
      p_type AS kind, p_size AS size, p_retailprice AS price FROM part""",
    "preview": f"WITH {CUSTOMERS} SELECT * FROM cust ORDER BY customer_id LIMIT 5",
    "table_summary": f"""WITH {GAPS}
      SELECT 'customers' AS table_name, count(*) AS n_rows, CAST(5 AS BIGINT) AS n_columns,
        5 * count(*) - count(customer_id) - count(name) - count(nation) - count(balance)
        - count(segment) AS missing_cells FROM gaps
      UNION ALL SELECT 'transactions', count(*), 4, 4 * count(*) - count(o_orderkey)
        - count(o_custkey) - count(o_totalprice) - count(o_orderdate) FROM orders
      UNION ALL SELECT 'products', count(*), 6, 6 * count(*) - count(p_partkey) - count(p_name)
        - count(p_brand) - count(p_type) - count(p_size) - count(p_retailprice) FROM part""",
    "dtype_histogram": _dtypes(),
    "missing_by_column": f"""WITH {GAPS}, long AS (
      SELECT 'customer_id' AS column_name, count(*) - count(customer_id) AS missing_count FROM gaps
      UNION ALL SELECT 'name', count(*) - count(name) FROM gaps
      UNION ALL SELECT 'nation', count(*) - count(nation) FROM gaps
      UNION ALL SELECT 'balance', count(*) - count(balance) FROM gaps
      UNION ALL SELECT 'segment', count(*) - count(segment) FROM gaps)
      SELECT * FROM long WHERE missing_count > 0""",
    "completeness": f"""WITH {GAPS} SELECT CAST(5 AS BIGINT) AS total_features, count(*) AS samples,
      (1e0 - CAST(5 * count(*) - count(customer_id) - count(name) - count(nation)
        - count(balance) - count(segment) AS DOUBLE) / (count(*) * 5)) * 100e0 AS completeness_pct
      FROM gaps""",
    "describe_features": f"WITH {RFM} " + " UNION ALL ".join(
        _described(c) for c in ("balance", *BEHAVIOUR)),
    "find_target_column": """SELECT column_name AS target_column FROM (
      SELECT 0 AS i, 'doc_id' AS column_name, count(DISTINCT doc_id) AS k FROM labels
      UNION ALL SELECT 1, 'quality', count(DISTINCT quality) FROM labels
      UNION ALL SELECT 2, 'toxic', count(DISTINCT toxic) FROM labels)
      WHERE k <= 2 ORDER BY i DESC LIMIT 1""",
    "safe_numeric": """SELECT c_custkey AS customer_id, CAST(c_nationkey AS DOUBLE) AS nation,
      CASE WHEN c_acctbal < 0 OR c_acctbal > 9000 THEN 0e0 ELSE c_acctbal END AS balance
      FROM customer""",
    "customer_lookup": f"""WITH {CUSTOMERS} SELECT * FROM cust
      WHERE CAST(customer_id AS VARCHAR) = '77'""",
    "customer_profile": """SELECT CAST(0 AS BIGINT) AS position, 'customer_id' AS attribute,
        CAST(c_custkey AS VARCHAR) AS value FROM customer WHERE c_custkey = 77
      UNION ALL SELECT 1, 'name', c_name FROM customer WHERE c_custkey = 77
      UNION ALL SELECT 2, 'nation', CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_custkey = 77
      UNION ALL SELECT 3, 'segment', c_mktsegment FROM customer WHERE c_custkey = 77""",
    "overview_kpis": f"""SELECT count(*) AS total_customers,
      (SELECT {_money('o_totalprice')} FROM orders) AS total_revenue,
      {_even('avg(CAST(c_acctbal < 0 AS INTEGER)) * 100e0', 6)} AS churn_rate,
      (SELECT {_money('o_totalprice')} / count(o_totalprice) FROM orders) AS avg_transaction
      FROM customer""",
    "sales_kpis": f"""SELECT {_money('o_totalprice')} AS total_revenue,
      count(*) AS total_transactions, {_money('o_totalprice')} / count(o_totalprice)
      AS avg_transaction, count(DISTINCT o_custkey) AS unique_customers FROM orders""",
    "sales_trend_daily": _trend("day", "strftime(date_trunc('day', o_orderdate), '%Y-%m-%d')"),
    "sales_trend_monthly": _trend("month", _MONTH),
    "sales_trend_quarterly": _trend(
        "quarter", "CAST(year(o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR)"),
    "sales_trend_yearly": _trend("year", "CAST(year(o_orderdate) AS VARCHAR)"),
    "sales_growth_monthly": f"WITH {GROWTH} SELECT * FROM growth",
    "growth_summary": f"""WITH {GROWTH} SELECT {_even('avg(revenue_growth)', 6)} AS avg_revenue_growth,
      {_even('avg(transaction_growth)', 6)} AS avg_transaction_growth,
      arg_max(revenue_growth, period_start) AS latest_growth FROM growth""",
    "product_performance": f"WITH {PRODUCTS} SELECT * FROM perf",
    "top_products_revenue": f"""WITH {PRODUCTS} SELECT * FROM perf
      ORDER BY total_revenue DESC, product_id LIMIT 10""",
    "top_products_volume": f"""WITH {PRODUCTS} SELECT * FROM perf
      ORDER BY total_sales DESC, total_revenue DESC, product_id LIMIT 10""",
    "product_summary_top20": f"""WITH {PRODUCTS} SELECT product_id, total_revenue, total_sales,
      avg_price, revenue_share FROM shared ORDER BY total_revenue DESC, product_id LIMIT 20""",
    "product_pareto": f"""WITH {PARETO} SELECT product_id, total_revenue, total_sales, avg_price,
      revenue_share, product_rank, cumulative_share FROM curve""",
    "product_pareto_rounded": f"""WITH {PARETO} SELECT product_id, total_revenue, total_sales,
      avg_price, revenue_share, product_rank, cumulative_rounded AS cumulative_share FROM curve""",
    "pareto_summary": f"""WITH {PARETO} SELECT count(*) FILTER (cumulative_share <= 80) AS
      products_within, count(*) AS total_products,
      CAST(count(*) FILTER (cumulative_share <= 80) AS DOUBLE) / count(*) * 100e0 AS pct_products
      FROM curve""",
    "customer_performance": f"WITH {VALUE} SELECT * FROM value",
    "customer_value_kpis": f"""WITH {VALUE} SELECT
      {_money('total_spent')} / count(*) AS avg_customer_value,
      CAST(sum(total_transactions) AS DOUBLE) / count(*) AS avg_transactions_per_customer,
      count(*) FILTER (total_transactions > 1) AS repeat_customers,
      CAST(count(*) FILTER (total_transactions > 1) AS DOUBLE) / count(*) * 100e0 AS repeat_rate
      FROM value""",
    "top_customers": f"WITH {VALUE} SELECT * FROM value ORDER BY total_spent DESC, customer_id LIMIT 20",
    "hist_total_spent": _histogram(VALUE, "value", "total_spent", 50),
    "hist_transactions": _histogram(VALUE, "value", "total_transactions", 30),
    "hist_probability": _histogram(RULE, "predicted", "churn_probability", 50),
    "customer_value_histograms": " UNION ALL ".join(
        f"SELECT '{c}' AS feature, * FROM ({_histogram(RFM, 'rfm', c, 30)})"
        for c in ("total_spent", "purchase_frequency", "avg_transaction_value")),
    "customer_rfm": f"""WITH {RFM} SELECT customer_id, last_purchase_date, {', '.join(BEHAVIOUR)}
      FROM rfm""",
    "customer_recency": f"""WITH {SCORED} SELECT customer_id, days_since_last_purchase, recency_score
      FROM recent""",
    "engagement_score": f"WITH {SCORED} SELECT customer_id, " + ", ".join(
        f"{_even(c, 6)} AS {c}" for c in (
            "purchase_frequency_normalized", "total_spent_normalized",
            "recency_score_normalized", "engagement_score")) + " FROM scored",
    "subscription_tenure": f"""SELECT c_custkey AS customer_id, start_date,
      CAST(coalesce(date_sub('day', start_date, {AS_OF}), 0) AS BIGINT) AS subscription_tenure_days
      FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS start_date FROM orders
        GROUP BY o_custkey) ON o_custkey = c_custkey""",
    "impute_median": f"""WITH {GAPS} SELECT customer_id,
      coalesce(CAST(nation AS DOUBLE), (SELECT median(nation) FROM gaps)) AS nation,
      coalesce(balance, (SELECT median(balance) FROM gaps)) AS balance FROM gaps""",
    "impute_mode": f"""WITH {GAPS} SELECT customer_id, coalesce(segment, (SELECT segment FROM gaps
      WHERE segment IS NOT NULL GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1)) AS segment
      FROM gaps""",
    "label_encode": """SELECT c_custkey AS customer_id,
      dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS segment,
      dense_rank() OVER (ORDER BY c_name) - 1 AS name FROM customer""",
    "standard_scale": f"""WITH {RFM} SELECT customer_id, {_scale_list(BEHAVIOUR)}
      FROM rfm, {_scaled(BEHAVIOUR, 'rfm')}""",
    "processed_features": f"""WITH {GAPS}, {SCORED},
      filled AS (SELECT customer_id,
        coalesce(CAST(nation AS DOUBLE), (SELECT median(nation) FROM gaps)) AS nation,
        coalesce(balance, (SELECT median(balance) FROM gaps)) AS balance,
        coalesce(segment, (SELECT segment FROM gaps WHERE segment IS NOT NULL GROUP BY segment
          ORDER BY count(*) DESC, segment LIMIT 1)) AS segment_text FROM gaps),
      ready AS (SELECT customer_id, filled.nation, filled.balance,
        dense_rank() OVER (ORDER BY segment_text) - 1 AS segment,
        {', '.join(c for c in _FEATURES if c not in ('nation', 'balance', 'segment'))}
        FROM scored JOIN filled USING (customer_id))
      SELECT customer_id, {_scale_list(_FEATURES)} FROM ready, {_scaled(_FEATURES, 'ready')}""",
    "binary_target": """SELECT c_custkey AS customer_id, CAST(c_acctbal > 0 AS INTEGER) AS from_number,
      CAST(c_acctbal < 0 AS INTEGER) AS from_flag,
      CAST(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN true
        WHEN c_mktsegment = 'FURNITURE' THEN false ELSE c_nationkey = 1 END AS INTEGER) AS from_text
      FROM customer""",
    "median_binarize": """SELECT c_custkey AS customer_id, c_acctbal AS balance, CAST(CASE
      WHEN (SELECT count(DISTINCT c_acctbal) FROM customer) > 2
      THEN c_acctbal > (SELECT median(c_acctbal) FROM customer) ELSE c_acctbal > 0 END AS INTEGER)
      AS churn FROM customer""",
    "synthetic_churn": f"""WITH {SCORED}, ends AS (SELECT min(engagement_score) le,
        max(engagement_score) he, min(purchase_frequency) lf, max(purchase_frequency) hf,
        min(days_since_last_purchase) ld, max(days_since_last_purchase) hd FROM scored),
      mixed AS (SELECT customer_id,
        ((1e0 - (engagement_score - le) / (he - le + 1e-8))
        + (1e0 - (purchase_frequency - lf) / (hf - lf + 1e-8))
        + (days_since_last_purchase - ld) / (hd - ld + 1e-8)) / 3e0 AS s FROM scored, ends)
      SELECT customer_id, {_even('s', 6)} AS churn_score,
        CAST(s >= (SELECT quantile_cont(s, 0.7) FROM mixed) AS INTEGER) AS churn FROM mixed""",
    "train_test_split": f"""WITH h AS (SELECT doc_id, toxic, {_hash('doc_id')} AS h FROM labels),
      q AS (SELECT toxic, quantile_cont(h, 0.2) AS cut FROM h GROUP BY toxic)
      SELECT doc_id, toxic, h <= cut AS is_test FROM h JOIN q USING (toxic)""",
    "train_test_split_hashed": f"""SELECT c_custkey AS customer_id, {_hash('c_custkey')} < 0.2e0
      AS is_test FROM customer""",
    "class_weights": """SELECT toxic, count(*) AS rows, CAST((SELECT count(toxic) FROM labels) AS DOUBLE)
      / (2e0 * count(*)) AS weight FROM labels WHERE toxic IS NOT NULL GROUP BY toxic""",
    "confusion_matrix": f"WITH {_metrics_ctes()} SELECT label, prediction, n FROM m",
    "metrics_weighted": f"""WITH {_metrics_ctes()},
      cls AS (SELECT c, sum(CASE WHEN label = c THEN n ELSE 0 END) AS support,
        sum(CASE WHEN prediction = c THEN n ELSE 0 END) AS predicted,
        sum(CASE WHEN label = c AND prediction = c THEN n ELSE 0 END) AS tp
        FROM m, (SELECT label AS c FROM m UNION SELECT prediction FROM m) GROUP BY c),
      pr AS (SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(predicted, 0), 0e0) AS p,
        coalesce(CAST(tp AS DOUBLE) / nullif(support, 0), 0e0) AS r FROM cls),
      f AS (SELECT *, coalesce(2e0 * p * r / nullif(p + r, 0), 0e0) AS f1 FROM pr)
      SELECT {_even('CAST(sum(tp) AS DOUBLE) / sum(support)', 6)} AS accuracy,
        {_even('sum(p * support) / sum(support)', 6)} AS precision,
        {_even('sum(r * support) / sum(support)', 6)} AS recall,
        {_even('sum(f1 * support) / sum(support)', 6)} AS f1 FROM f""",
    "metrics_binary": f"""WITH {_metrics_ctes()}, s AS (SELECT sum(n) AS n,
        sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS hit,
        sum(CASE WHEN label = 1 AND prediction = 1 THEN n ELSE 0 END) AS tp,
        sum(CASE WHEN prediction = 1 THEN n ELSE 0 END) AS pp,
        sum(CASE WHEN label = 1 THEN n ELSE 0 END) AS ap FROM m),
      pr AS (SELECT CAST(hit AS DOUBLE) / n AS accuracy,
        coalesce(CAST(tp AS DOUBLE) / nullif(pp, 0), 0e0) AS precision,
        coalesce(CAST(tp AS DOUBLE) / nullif(ap, 0), 0e0) AS recall FROM s)
      SELECT *, coalesce(2e0 * precision * recall / nullif(precision + recall, 0), 0e0) AS f1 FROM pr""",
    "churn_distribution": f"""WITH {RULE} SELECT CASE WHEN churn_prediction = 1 THEN 'Churned'
      ELSE 'Not Churned' END AS status, count(*) AS customers FROM predicted GROUP BY 1""",
    "risk_bucket": f"""WITH {RULE} SELECT customer_id, churn_probability, {_BUCKET} AS risk
      FROM predicted""",
    "risk_segments": f"""WITH {RULE} SELECT 'Low Risk' AS risk_segment,
        count(*) FILTER (churn_probability > 0 AND churn_probability <= 0.3e0) AS customers FROM predicted
      UNION ALL SELECT 'Medium Risk',
        count(*) FILTER (churn_probability > 0.3e0 AND churn_probability <= 0.7e0) FROM predicted
      UNION ALL SELECT 'High Risk',
        count(*) FILTER (churn_probability > 0.7e0 AND churn_probability <= 1) FROM predicted""",
    "retention_actions": f"""WITH {RULE}, r AS (SELECT customer_id, {_BUCKET} AS risk FROM predicted)
      SELECT customer_id, r.risk, CAST(position AS BIGINT) AS position, action
      FROM r JOIN {_retention()} ON act.risk = r.risk""",
    "revenue_at_risk": f"""WITH {RULE}, {VALUE}, high AS (SELECT total_spent FROM predicted
        LEFT JOIN value USING (customer_id) WHERE churn_probability > 0.7e0)
      SELECT count(*) AS high_risk_customers, {_money('total_spent')} AS revenue_at_risk,
        {_money('total_spent')} / (SELECT {_money('total_spent')} FROM value) * 100e0 AS pct_of_revenue,
        {_money('total_spent')} / nullif(count(total_spent), 0) AS avg_high_risk_value FROM high""",
    "revenue_vs_churn": f"""WITH {RULE}, {VALUE} SELECT customer_id, churn_probability,
      churn_prediction, total_spent, total_transactions
      FROM predicted LEFT JOIN value USING (customer_id)""",
    "top_risk": f"""WITH {RULE} SELECT * FROM predicted
      ORDER BY churn_probability DESC, customer_id LIMIT 50""",
    "local_reasons_linear": _reasons(LINEAR_WEIGHTS, tree=False),
    "local_reasons_tree": _reasons(TREE_WEIGHTS, tree=True),
    "segment_export_summary": f"""WITH {SCORED} SELECT customer_id, nation AS cluster, total_spent,
      purchase_frequency, {_even('engagement_score', 6)} AS engagement_score FROM scored""",
    "cluster_distribution": f"""WITH c AS (SELECT label AS cluster, count(*) AS customers
        FROM embeddings GROUP BY label)
      SELECT cluster, customers, {_even(
        'CAST(customers AS DOUBLE) / (SELECT sum(customers) FROM c) * 100e0', 1)} AS percentage,
        customers = (SELECT max(customers) FROM c) AS largest,
        customers = (SELECT min(customers) FROM c) AS smallest FROM c""",
    "cluster_stats": f"""WITH {SCORED}, long AS ({_cluster_means(
        'scored', (*BEHAVIOUR, 'engagement_score'))})
      SELECT cluster, feature, {_even('mean_value')} AS mean_value, cnt AS "count" FROM long""",
    "cluster_profiles": f"""WITH {SCORED}, long AS ({_cluster_means('scored', BEHAVIOUR)}),
      pct AS (SELECT *, (mean_value - base) / nullif(base, 0) * 100e0 AS p FROM long),
      placed AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY abs(p) DESC, position)
        AS profile_rank FROM pct)
      SELECT cluster, size, CAST(size AS DOUBLE) / (SELECT count(*) FROM scored) * 100e0 AS percentage,
        profile_rank, feature, {_even('mean_value', 4)} AS mean_value,
        {_even('p', 6)} AS diff_pct, {_LABELLED} AS characteristic
      FROM placed WHERE profile_rank <= 5""",
    "segment_recommendations": f"WITH {SCORED} {_recommendations()}",
    "cluster_opportunities": _opportunities(),
    "cluster_sample": f"""WITH h AS (SELECT c_custkey AS customer_id, c_acctbal AS balance,
        c_nationkey AS cluster, row_number() OVER (PARTITION BY c_nationkey
          ORDER BY {_hash('c_custkey')}, c_custkey) AS r FROM customer)
      SELECT customer_id, balance, cluster FROM h WHERE r <= 10""",
    "dbscan_noise": f"""WITH {DENSITY} SELECT id AS customer_id,
      id IN (SELECT id FROM core) AS is_core, id NOT IN (SELECT id FROM touched) AS is_noise FROM pts""",
    "dbscan_clusters": f"WITH RECURSIVE {CLUSTERS} SELECT customer_id, cluster FROM clustered",
    "anomaly_summary": f"""WITH RECURSIVE {CLUSTERS} SELECT count(*) AS total_customers,
      count(*) FILTER (cluster = -1) AS n_outliers,
      count(DISTINCT cluster) FILTER (cluster <> -1) AS n_clusters,
      CAST(count(*) FILTER (cluster = -1) AS DOUBLE) / count(*) * 100e0 AS outlier_percentage
      FROM clustered""",
    "outlier_characteristics": _outliers(),
    "outlier_sample": f"""WITH {DENSITY} SELECT customer_id,
      CAST(r.purchase_frequency AS DOUBLE) AS purchase_frequency, r.total_spent,
      CAST(r.days_since_last_purchase AS DOUBLE) AS days_since_last_purchase,
      CAST(-1 AS BIGINT) AS cluster, false AS is_core FROM rfm r
      WHERE customer_id NOT IN (SELECT id FROM touched) ORDER BY customer_id LIMIT 5""",
    "anomaly_scatter": f"""WITH {RFM} SELECT customer_id, total_spent, purchase_frequency,
      CASE WHEN days_since_last_purchase > 700 THEN -1 ELSE nation END AS cluster,
      CASE WHEN days_since_last_purchase > 700 THEN 'Anomaly' ELSE 'Normal' END AS type FROM rfm""",
    "series_daily": _series("day"),
    "series_weekly": _series("week"),
    "series_monthly": _series("month"),
    "future_calendar": f"""WITH s AS ({_series('week')})
      SELECT CAST(last_ds + i * INTERVAL 7 DAY AS DATE) AS ds FROM (SELECT max(ds) AS last_ds FROM s),
      (SELECT unnest(generate_series(1, 90)) AS i)""",
    "forecast_daily": f"""WITH {_fit(_series('day'), daily=True)},
      {_ahead('1 DAY', 90, daily=True)} {_table()}""",
    "forecast_weekly": f"WITH {_fit(_series('week'))}, {_ahead('7 DAY', 90)} {_table()}",
    "forecast_monthly": f"WITH {MONTHLY} {_table()}",
    "forecast_by_product": "WITH " + _fit(
        f"""SELECT l_partkey AS product_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS ds,
        {_money('l_extendedprice')} AS y FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1, 2""",
        "product_id") + ", " + _ahead("1 MONTH", 3, "product_id") + " " + _table("product_id"),
    "customer_stream": f"""SELECT o_custkey AS customer_id, count(*) AS purchase_frequency,
      {_money('o_totalprice')} AS total_spent, max(o_orderdate) AS last_purchase_date FROM orders
      WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL GROUP BY 1""",
    "sales_from_sketches": f"""SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS period,
      {_money('o_totalprice')} AS total_revenue, count(o_totalprice) AS transaction_count,
      true AS customers_within_3_percent FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1""",
    "profile_from_sketches": f"""SELECT 'o_totalprice' AS feature, count(*) AS count,
      {_even('avg(o_totalprice)')} AS mean, {_even('stddev_samp(o_totalprice)')} AS std,
      min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders""",
    "scan_with_quarantine": """SELECT 'rows' AS measure, NULL::VARCHAR AS "column", count(*) AS n
      FROM customer WHERE c_custkey % 40 <> 0 AND c_custkey % 41 <> 0
      UNION ALL SELECT 'quarantined', NULL, count(*) FROM customer
      WHERE c_custkey % 40 = 0 OR c_custkey % 41 = 0
      UNION ALL SELECT 'coerced_dates', 'created_at', count(*) FROM customer
      WHERE c_custkey % 40 <> 0 AND c_custkey % 41 <> 0 AND c_custkey % 7 = 0""",
    "forecast_normal_sums": _normal_sums(),
    "forecast_changepoint": _bent_table(_series("month"), _bent("month"), "1 MONTH", 12),
    "forecast_changepoint_weekly": _bent_table(_series("week"), _bent("week"), "7 DAY", 52),
    "forecast_changepoint_by_product": _bent_table(
        _product_series(), replace(_bent("month"), changes=6, yearly=2), "1 MONTH", 3, "product_id"),
    "boosting_split_gains": _split_gains(),
    "forecast_components": f"""WITH {MONTHLY}, every AS (SELECT ds, trend, yearly, weekly FROM history
        UNION ALL SELECT ds, trend, yearly, weekly FROM ahead)
      SELECT ds, {_even('trend')} AS trend, {_even('yearly')} AS yearly,
        {_even('weekly')} AS weekly FROM every""",
    "forecast_summary": f"""WITH {SUMMARY} SELECT {_even('ah')} AS avg_historical,
      {_even('af')} AS avg_forecast, {_even('g', 6)} AS growth_pct,
      {_even('tf')} AS total_forecast, trend_direction, best_period, worst_period, outlook
      FROM summary""",
    "forecast_advice": f"""WITH {SUMMARY} SELECT s.outlook, CAST(position AS BIGINT) AS position, advice
      FROM summary s JOIN {_advice()} ON act.outlook = s.outlook""",
    "events_kpi_hourly": """SELECT date_trunc('hour', ts) AS window_start,
      coalesce(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 0e0) AS revenue,
      count(*) AS events, count(DISTINCT user_id) AS active_customers FROM events GROUP BY 1""",
}

# Density over all columns of the feature table, stated on that table's own text.
ORACLES["dbscan_all_features"] = f"""WITH RECURSIVE pts AS (
  SELECT customer_id AS id, [{', '.join(f'CAST({c} AS DOUBLE)' for c in _FEATURES)}] AS x
  FROM ({ORACLES['processed_features']})),
near AS (SELECT p.id AS a, q.id AS b FROM pts p JOIN pts q
  ON list_sum([(p.x[i] - q.x[i]) ** 2 for i in range(1, {len(_FEATURES) + 1})]) <= 1.25e0 * 1.25e0),
core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 5),
core_edge AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach(id, seed) AS (SELECT id, id FROM core
  UNION SELECT e.b, r.seed FROM reach r JOIN core_edge e ON e.a = r.id WHERE r.seed < e.b),
seeds AS (SELECT id, min(seed) AS seed FROM reach GROUP BY id),
numbered AS (SELECT id, dense_rank() OVER (ORDER BY seed) - 1 AS number FROM seeds),
labelled AS (SELECT id, number FROM numbered UNION ALL
  SELECT n.a, min(number) FROM near n JOIN numbered c ON c.id = n.b
  WHERE n.a NOT IN (SELECT id FROM core) GROUP BY n.a)
SELECT pts.id AS customer_id, coalesce(number, -1) AS cluster,
  pts.id IN (SELECT id FROM core) AS is_core FROM pts LEFT JOIN labelled USING (id)"""
ORACLES["customer_rfm_bucketed"] = ORACLES["customer_rfm"]
