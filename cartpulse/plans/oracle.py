"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark plans and closer to the plain definition
of each feature: distinct counts with FILTER, block lists with
list(DISTINCT ...), the month series as a calendar cross join with LEAD for
the discretisation, and so on.  Tables are the driver's pre-registered views.
"""

from __future__ import annotations

from cartpulse.functions.periods import Windows, sql_date as d
from cartpulse.plans.present import join_doubles_sql, join_longs_sql, r


def lines_sql(households: int | None = 100) -> str:
    fam = "o.o_custkey" if not households else f"o.o_custkey % {households}"
    return f"""
    SELECT CAST({fam} AS BIGINT) AS family_id,
           TRY_CAST(substring(p.p_brand, 7) AS BIGINT) AS subcat_id,
           p.p_brand AS subcat_name,
           l.l_partkey AS item_id,
           l.l_orderkey AS invoice_id,
           l.l_suppkey AS store_id,
           CAST(o.o_orderdate AS DATE) AS day,
           l.l_quantity AS qty,
           l.l_extendedprice AS list_price,
           l.l_extendedprice * (1 - l.l_discount) AS net_sales,
           l.l_extendedprice * l.l_discount AS discount,
           CASE WHEN p.p_type IN ('ECONOMY', 'STANDARD') THEN 'A'
                WHEN p.p_type IN ('PROMO', 'SMALL') THEN 'B' END AS division
    FROM lineitem l
    JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN part p ON l.l_partkey = p.p_partkey"""


def events_sql() -> str:
    return """
    SELECT CAST(user_id AS BIGINT) AS family_id, event_type AS subcat_id, event_type AS subcat_name,
           event_type AS item_id, event_id AS invoice_id, CAST(NULL AS BIGINT) AS store_id,
           CAST(ts AS DATE) AS day, 1.0 AS qty, value AS list_price, value AS net_sales,
           0.0 AS discount, CAST(NULL AS VARCHAR) AS division
    FROM events"""


def pair_features_ctes(w: Windows, lines: str, data_cutoff=None) -> str:
    """CTE chain ending in ``feat`` (raw, unrounded feature rows)."""
    cut = f" AND day <= {d(data_cutoff)}" if data_cutoff is not None else ""
    nb = w.n_months
    return f"""
    lines AS ({lines}),
    hist AS (SELECT * FROM lines WHERE day < {d(w.ref)}{cut}),
    summ AS (
      SELECT family_id, subcat_id,
             sum(qty) AS total_qty, sum(net_sales) AS total_net, sum(discount) AS total_discount,
             sum(list_price) AS total_list_price, avg(list_price) AS mean_list_price,
             count(DISTINCT invoice_id) AS n_invoices, count(invoice_id) AS n_lines,
             min(day) AS first_day, max(day) AS last_day,
             count(*) FILTER (WHERE day >= {d(w.cycle_start)}) AS rows_active,
             count(*) FILTER (WHERE day >= {d(w.freq_start)}) AS rows_freq,
             count(invoice_id) FILTER (WHERE day >= {d(w.freq_start)}) AS lines_freq,
             7 * count(invoice_id) FILTER (WHERE day >= {d(w.sow_recent_start)})
               + 3 * count(invoice_id) FILTER (WHERE day >= {d(w.sow_start)} AND day < {d(w.sow_recent_start)}) AS w,
             count(DISTINCT invoice_id) FILTER (WHERE day > {d(w.season_start)} AND day <= {d(w.ref)}) AS a_inv,
             count(DISTINCT invoice_id) FILTER (WHERE day > {d(w.season_prior_start)} AND day <= {d(w.season_prior_end)}) AS p_inv,
             count(*) FILTER (WHERE day >= {d(w.series_start)} AND day <= {d(w.ref)}) AS rows_series
      FROM hist GROUP BY family_id, subcat_id),
    fam AS (
      SELECT family_id, max(rows_active) AS fam_active, max(rows_freq) AS fam_freq,
             CAST(sum(w) AS DOUBLE) AS w_total, CAST(max(w) AS DOUBLE) AS w_max
      FROM summ GROUP BY family_id),
    blk AS (
      SELECT family_id, subcat_id,
             list_sort(list(DISTINCT CAST(floor(date_diff('day', {d(w.cycle_start)}, day) / 7) AS BIGINT))) AS b
      FROM hist WHERE day >= {d(w.cycle_start)} GROUP BY family_id, subcat_id),
    blk10 AS (
      SELECT family_id, subcat_id, CASE WHEN len(b) > 10 THEN list_slice(b, len(b) - 9, len(b)) ELSE b END AS b
      FROM blk),
    gaps AS (
      SELECT family_id, subcat_id, len(b) AS nb,
             CASE WHEN len(b) >= 3
                  THEN list_transform(range(2, len(b) + 1), lambda i: (b[i] - b[i - 1]) * 7)
                  ELSE CAST([] AS BIGINT[]) END AS g
      FROM blk10),
    gstat AS (
      SELECT *, list_avg(list_transform(g, lambda x: CAST(x AS DOUBLE))) AS gm,
             sqrt(list_avg(list_transform(g, lambda x: (x - list_avg(g)) * (x - list_avg(g))))) AS gs
      FROM gaps),
    cyc AS (
      SELECT family_id, subcat_id, g,
             CASE WHEN nb < 3 THEN CAST([] AS DOUBLE[])
                  WHEN gs = 0 THEN list_transform(g, lambda x: CAST(x AS DOUBLE))
                  ELSE list_transform(g, lambda x: greatest(least(CAST(x AS DOUBLE), gm + 0.1 * gs), gm - 0.1 * gs)) END AS gc,
             CASE WHEN nb < 3 OR gs = 0 THEN 2.0 WHEN gm > 0 THEN gs / gm ELSE 1.0 END AS strength,
             CASE WHEN nb < 3 OR gs = 0 THEN 0.0 ELSE gm END AS pmean,
             CASE WHEN nb < 3 OR gs = 0 THEN 0.0 ELSE gs END AS pstd,
             nb
      FROM gstat),
    cyc2 AS (SELECT *, CASE WHEN nb >= 3 THEN list_avg(gc) ELSE 0.0 END AS cycle FROM cyc),
    months AS (SELECT range AS m FROM range(0, {nb})),
    spairs AS (SELECT family_id, subcat_id FROM summ WHERE rows_series > 0),
    mcount AS (
      SELECT family_id, subcat_id,
             (year(day) - {w.series_start.year}) * 12 + month(day) - {w.series_start.month} AS m,
             count(invoice_id) AS n
      FROM hist WHERE day >= {d(w.series_start)} AND day <= {d(w.ref)}
      GROUP BY ALL),
    dense AS (
      SELECT s.family_id, s.subcat_id, mo.m, coalesce(c.n, 0) AS n
      FROM spairs s CROSS JOIN months mo
      LEFT JOIN mcount c ON c.family_id = s.family_id AND c.subcat_id = s.subcat_id AND c.m = mo.m),
    thr AS (
      SELECT family_id, subcat_id, coalesce(CAST(floor(avg(n) FILTER (WHERE n > 0)) AS BIGINT), 0) AS thr
      FROM dense GROUP BY ALL),
    bits AS (
      SELECT d.family_id, d.subcat_id, d.m, d.n, t.thr,
             CASE WHEN lead(d.n) OVER (PARTITION BY d.family_id, d.subcat_id ORDER BY d.m) IS NULL
                  THEN CASE WHEN d.n >= t.thr THEN '1' ELSE '0' END
                  WHEN d.n > 0 AND d.n + lead(d.n) OVER (PARTITION BY d.family_id, d.subcat_id ORDER BY d.m) >= t.thr
                  THEN '1' ELSE '0' END AS bit
      FROM dense d JOIN thr t ON d.family_id = t.family_id AND d.subcat_id = t.subcat_id),
    ser AS (
      SELECT family_id, subcat_id, any_value(thr) AS thr,
             list(n ORDER BY m) AS series, string_agg(bit, '' ORDER BY m) AS bits
      FROM bits GROUP BY family_id, subcat_id),
    ser2 AS (
      SELECT *, regexp_replace(bits, '11', '10', 'g') AS thinned FROM ser),
    ser3 AS (
      SELECT *, CASE WHEN length(thinned) - length(replace(thinned, '1', '')) >= 2
                     THEN list_filter(list_transform(string_split(thinned, '1'), lambda s: CAST(length(s) AS BIGINT)), lambda x: x > 0)
                     ELSE CAST([] AS BIGINT[]) END AS pg
      FROM ser2),
    ser4 AS (
      SELECT *, CASE WHEN len(pg) > 1 THEN list_avg(pg) ELSE 0.85 END AS pmean_s,
             CASE WHEN len(pg) > 1 THEN sqrt(list_avg(list_transform(pg, lambda x: (x - list_avg(pg)) * (x - list_avg(pg))))) ELSE 0.85 END AS pstd_s
      FROM ser3),
    ser5 AS (
      SELECT *, CASE WHEN len(pg) > 1 THEN pstd_s / pmean_s ELSE 0.85 END AS cv FROM ser4),
    ser6 AS (SELECT *, exp(-1.85 * pow(cv, 2.5)) AS reg FROM ser5),
    base AS (
      SELECT s.*, f.fam_freq, f.w_total, f.w_max,
             coalesce(c.cycle, 0.0) AS cycle_days,
             CASE WHEN c.family_id IS NULL THEN 0.0 ELSE c.strength END AS penalty_strength,
             coalesce(c.pmean, 0.0) AS penalty_mean, coalesce(c.pstd, 0.0) AS penalty_std,
             coalesce(c.g, CAST([] AS BIGINT[])) AS gaps_days,
             coalesce(c.gc, CAST([] AS DOUBLE[])) AS gaps_clipped_days,
             greatest(0, date_diff('day', s.last_day, {d(w.ref)})) AS days_since_last,
             x.family_id IS NOT NULL AS in_series, x.thr, x.series, x.bits, x.thinned, x.pg,
             x.cv, x.pmean_s, x.pstd_s, x.reg
      FROM summ s
      JOIN fam f ON s.family_id = f.family_id AND f.fam_active > 0
      LEFT JOIN cyc2 c ON s.family_id = c.family_id AND s.subcat_id = c.subcat_id
      LEFT JOIN ser6 x ON s.family_id = x.family_id AND s.subcat_id = x.subcat_id),
    rec AS (
      SELECT *,
             CASE WHEN cycle_days > 0 THEN least(1.0, 2.0 * (1 - pow(2.0, -days_since_last / cycle_days))) ELSE 0.0 END AS recency_base,
             CASE WHEN cycle_days > 0 THEN days_since_last / cycle_days ELSE 0.0 END AS last_over_cycle,
             CASE WHEN cycle_days > 0 THEN exp(-0.1 * pow(greatest(1.0, days_since_last / cycle_days) - 1, 2.5)) ELSE 0.0 END AS recency_penalty,
             CASE WHEN rows_freq > 0 AND cycle_days > 0 THEN round_even(180.0 / cycle_days * 1.2, 0) ELSE 0.0 END AS exp_n
      FROM base),
    frq AS (
      SELECT *,
             CASE WHEN rows_freq = 0 THEN 0.0 WHEN exp_n > 0 THEN lines_freq / exp_n ELSE 10.0 END AS ratio_n
      FROM rec),
    feat AS (
      SELECT family_id, subcat_id,
             recency_base * recency_penalty AS recency,
             CASE WHEN fam_freq = 0 THEN 0.1
                  WHEN rows_freq = 0 OR exp_n = 0 THEN 0.0
                  WHEN ratio_n <= 1 THEN 0.4 + 0.6 * pow(1 - ratio_n, 0.25)
                  ELSE 0.4 * greatest(0.0, 1 - (least(ratio_n, 1.6) - 1) / 0.6) END AS frequency,
             CASE WHEN w_total > 0 THEN (w / w_total) * (1.0 / (w_max / w_total)) ELSE 0.0 END AS sow,
             CASE WHEN in_series THEN
                  (CASE WHEN p_inv > 0 THEN greatest(0.0, least(1.0, (p_inv - a_inv) / CAST(p_inv AS DOUBLE))) ELSE 0.0 END)
                  * (0.5 + 0.5 * reg) ELSE 0.0 END AS season,
             cycle_days, penalty_strength, penalty_mean, penalty_std, gaps_days, gaps_clipped_days,
             recency_penalty, last_over_cycle, days_since_last, recency_base,
             CASE WHEN fam_freq = 0 THEN NULL ELSE exp_n END AS freq_expected,
             CASE WHEN fam_freq = 0 THEN NULL WHEN rows_freq > 0 THEN lines_freq ELSE 0 END AS freq_lines,
             CASE WHEN fam_freq = 0 THEN NULL ELSE ratio_n END AS freq_ratio,
             w AS sow_weighted_lines,
             CASE WHEN in_series THEN reg ELSE 0.0 END AS season_regularity,
             CASE WHEN in_series THEN thr ELSE 0 END AS season_threshold,
             CASE WHEN in_series THEN series ELSE CAST([] AS BIGINT[]) END AS season_series,
             CASE WHEN in_series THEN bits ELSE '' END AS season_bits,
             CASE WHEN in_series THEN thinned ELSE '' END AS season_thinned,
             CASE WHEN in_series THEN pg ELSE CAST([] AS BIGINT[]) END AS season_peak_gaps,
             CASE WHEN in_series THEN cv ELSE 0.0 END AS season_cv,
             CASE WHEN in_series THEN pmean_s ELSE 0.0 END AS season_gap_mean,
             CASE WHEN in_series THEN pstd_s ELSE 0.0 END AS season_gap_std,
             total_net AS net_sales,
             a_inv AS season_recent_invoices, p_inv AS season_prior_invoices,
             CASE WHEN p_inv > 0 THEN greatest(0.0, least(1.0, (p_inv - a_inv) / CAST(p_inv AS DOUBLE))) ELSE 0.0 END AS season_need
      FROM frq),
    scored AS (
      SELECT *, 0.4 * recency + 0.3 * frequency + 0.1 * sow + 0.2 * season AS score FROM feat)"""


def pair_features_sql(w: Windows, lines: str, data_cutoff=None) -> str:
    return f"""WITH {pair_features_ctes(w, lines, data_cutoff)}
    SELECT family_id, subcat_id, {r('recency')} AS recency, {r('frequency')} AS frequency,
           {r('sow')} AS sow, {r('season')} AS season, {r('score')} AS score,
           {r('cycle_days')} AS cycle_days, {r('penalty_strength')} AS penalty_strength,
           {r('penalty_mean')} AS penalty_mean, {r('penalty_std')} AS penalty_std,
           {join_longs_sql('gaps_days')} AS gaps_days,
           {join_doubles_sql('gaps_clipped_days')} AS gaps_clipped_days,
           {r('recency_penalty')} AS recency_penalty, {r('last_over_cycle')} AS last_over_cycle,
           CAST(days_since_last AS BIGINT) AS days_since_last, {r('recency_base')} AS recency_base,
           {r('freq_expected')} AS freq_expected, CAST(freq_lines AS BIGINT) AS freq_lines,
           {r('freq_ratio')} AS freq_ratio, CAST(sow_weighted_lines AS BIGINT) AS sow_weighted_lines,
           {r('season_regularity')} AS season_regularity, CAST(season_threshold AS BIGINT) AS season_threshold,
           {join_longs_sql('season_series')} AS season_series, season_bits, season_thinned,
           {join_longs_sql('season_peak_gaps')} AS season_peak_gaps,
           {r('season_cv')} AS season_cv, {r('season_gap_mean')} AS season_gap_mean,
           {r('season_gap_std')} AS season_gap_std, {r('net_sales')} AS net_sales
    FROM scored"""


def division_by_subcat_sql() -> str:
    return """
    SELECT subcat_id, division FROM (
      SELECT TRY_CAST(substring(p_brand, 7) AS BIGINT) AS subcat_id,
             CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'A'
                  WHEN p_type IN ('PROMO', 'SMALL') THEN 'B' END AS division,
             count(*) AS n
      FROM part GROUP BY 1, 2) v
    WHERE division IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY subcat_id ORDER BY n DESC, division) = 1"""




def _num(v: float) -> str:
    return f"{float(v):.17e}"


def ranker_ctes(ranker, src: str, cols, out: str = "prob") -> str:
    """CTEs rk1..rkN computing the ranker's forward pass in plain SQL from
    table ``src``; the last one is ``rk_out`` with column ``out``."""
    ws = ranker.weights
    x = [f"((coalesce({c}, 0.0) - {_num(m)}) / {_num(s)})" for c, m, s in zip(cols, ranker.mean, ranker.std)]
    ctes = []
    prev, names = src, x
    n = len(ws) // 2
    for li in range(n):
        W, b = ws[2 * li], ws[2 * li + 1]
        exprs = []
        for j in range(W.shape[1]):
            terms = " + ".join(f"{nm} * {_num(W[i, j])}" for i, nm in enumerate(names))
            z = f"({_num(b[j])} + {terms})"
            if li < n - 1:
                exprs.append(f"greatest(0.0, {z}) AS h{li}_{j}")
            else:
                exprs.append(f"1.0 / (1.0 + exp(-{z})) AS {out}")
        name = f"rk{li}" if li < n - 1 else "rk_out"
        ctes.append(f"{name} AS (SELECT *, {', '.join(exprs)} FROM {prev})")
        prev = name
        names = [f"h{li}_{j}" for j in range(W.shape[1])]
    return ",\n    ".join(ctes)
