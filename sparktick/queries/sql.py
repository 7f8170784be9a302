"""Shared SQL table expressions: trades, bars, labels, directions, return surface, folds, theta, intensities."""

from __future__ import annotations

HISTORY = 10  # days before the first test day
NUM = 4
LATENCIES = (0.0, 600_000.0, 3_600_000.0)
# Where every fit of the queries starts, and how many EM steps it takes from there: few enough to be written in SQL.
ALPHA, BETA, EM_STEPS = (0.30, 0.10, 0.15, 0.25), (1.0, 0.5, 0.8, 1.2), 2
QUANTILE = 0.5


def tsign(x: str, scale: str) -> str:
    return f"(CASE WHEN abs({x}) <= 1e-12*abs({scale}) THEN 0 ELSE CAST(sign({x}) AS INTEGER) END)"


def zsmall(x: str, ref: str) -> str:
    return f"(CASE WHEN abs({x}) <= 1e-12*abs({ref}) THEN 0.0 ELSE {x} END)"


def uniform(*keys: str) -> str:
    inner = ", ".join(keys)
    return f"(CAST('0x' || substr(md5(concat_ws('|', {inner})), 1, 15) AS BIGINT) / CAST(1152921504606846976 AS DOUBLE))"


def shuffled(position: str, size: str, *keys: str, rounds: int = 20) -> str:
    """Image of a position under a keyed permutation of 0 .. size-1: swap-or-not rounds as a fold."""
    shift = f"CAST(floor({uniform(*keys, chr(39) + 'shift' + chr(39), 'r')} * {size}) AS BIGINT)"
    other = f"((({shift} - x) % {size} + {size}) % {size})"
    bit = f"substr(md5(concat_ws('|', {', '.join(keys)}, r, greatest(x, {other}))), 1, 1) < '8'"
    return f"list_reduce(range({rounds}), lambda x, r: CASE WHEN {bit} THEN {other} ELSE x END, CAST({position} AS BIGINT))"


def trades(symbol: str = "'ALL'") -> str:
    return f"""tr AS (SELECT {symbol} AS symbol, CAST(ts AS DATE) AS day, epoch_us(ts) * 1000 AS ts_ns, 100.0 + value AS price,
  CAST(1 + event_id % 7 AS DOUBLE) AS qty, event_type IN ('error', 'signup') AS maker, event_id AS trade_id FROM events),
seqd AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY ts_ns, trade_id) - 1 AS seq FROM tr)"""


def bars(num: int = NUM) -> str:
    return f"""bars AS (SELECT symbol, day, CAST({num} AS BIGINT) AS num, seq // {num} AS bar_idx, min(ts_ns) AS ts_start_ns,
  max(ts_ns) AS ts_end_ns, coalesce(sum(price * qty) / nullif(sum(qty), 0), avg(price)) AS vwap, sum(qty) AS volume,
  count(*) AS n_trades, sum(CASE WHEN maker THEN -qty ELSE qty END) / nullif(sum(qty), 0) AS ofi,
  avg(CASE WHEN maker THEN -1.0 ELSE 1.0 END) AS count_imb, arg_max(price, seq) AS close
  FROM seqd GROUP BY symbol, day, seq // {num} HAVING count(*) = {num})"""


W = "(PARTITION BY symbol, day, num ORDER BY bar_idx)"
FRAME = "(PARTITION BY symbol, day, num ORDER BY bar_idx ROWS BETWEEN {} AND {})"


def over(a: str, b: str) -> str:
    return FRAME.format(a, b)


DIFFS = f"""dd AS (SELECT *, vwap - lag(vwap) OVER {W} AS d, count(*) OVER (PARTITION BY symbol, day, num) AS n FROM bars)"""

LABELS = f"""l0 AS (SELECT *, abs(lead(vwap) OVER {W} / vwap - 1) AS r,
  avg(vwap) OVER {over('3 PRECEDING', '1 PRECEDING')} AS prior_m, avg(vwap) OVER {over('1 FOLLOWING', '3 FOLLOWING')} AS post_m FROM dd),
l1 AS (SELECT *, avg(r) OVER {over('1 FOLLOWING', '3 FOLLOWING')} AS s3,
  quantile_cont(r, 0.5) OVER (PARTITION BY symbol, day, num) AS r_pivot, (bar_idx >= 3 AND bar_idx <= n - 5) AS evaluable FROM l0),
lab AS (SELECT * EXCLUDE (s3), CASE WHEN evaluable THEN s3 END AS strength,
  CASE WHEN evaluable THEN {zsmall('prior_m - vwap', 'vwap')} * {zsmall('post_m - vwap', 'vwap')} END AS mom_rev_flag,
  evaluable AND s3 > r_pivot AS real,
  evaluable AND NOT ({zsmall('prior_m - vwap', 'vwap')} * {zsmall('post_m - vwap', 'vwap')} > 0) AS momentum FROM l1),
base AS (SELECT symbol, day, num, count(*) AS n_bars, count(*) FILTER (evaluable) AS n_evaluable, max(r_pivot) AS r_pivot,
  count(*) FILTER (real) / nullif(count(*) FILTER (evaluable), 0) AS base_accuracy,
  count(*) FILTER (momentum) / nullif(count(*) FILTER (evaluable), 0) AS base_momentum_pct FROM lab GROUP BY ALL)"""

RULES = f"""dir0 AS (SELECT *, avg(vwap) OVER {over('3 PRECEDING', '1 PRECEDING')} AS m3, lag(vwap) OVER {W} AS p1,
  min(vwap) OVER {over('2 PRECEDING', 'CURRENT ROW')} AS lo3, max(vwap) OVER {over('2 PRECEDING', 'CURRENT ROW')} AS hi3 FROM dd),
dirs AS (SELECT symbol, day, num, bar_idx, unnest(['momentum', 'alexanders_filter', 'stochastic_oscillator']) AS rule, unnest([
  CASE WHEN bar_idx < 3 THEN 0 ELSE -{tsign('m3 - vwap', 'vwap')} END,
  CASE WHEN bar_idx < 1 THEN 0 ELSE {tsign('(vwap / p1 - 1.0) * 100.0', '100.0')} END,
  CASE WHEN bar_idx < 2 OR hi3 - lo3 <= 1e-12 * abs(vwap) THEN 0
    ELSE {tsign('(vwap - lo3) / nullif(hi3 - lo3, 0) * 100.0 - 50.0', '100.0')} END]) AS direction FROM dir0)"""

ENTRIES = f"""ent AS (SELECT a.symbol, a.day, a.num, a.bar_idx, lat.latency_ms, a.n, CASE WHEN lat.latency_ms = 0 THEN a.bar_idx + 1
    ELSE greatest(a.bar_idx + 1, min(b.bar_idx)) END AS e0
  FROM dd a CROSS JOIN (SELECT unnest([{', '.join(map(str, LATENCIES))}]::DOUBLE[]) AS latency_ms) lat
  LEFT JOIN bars b ON b.symbol = a.symbol AND b.day = a.day AND b.num = a.num
    AND b.ts_start_ns >= a.ts_end_ns + CAST(lat.latency_ms * 1000000 AS BIGINT)
  GROUP BY a.symbol, a.day, a.num, a.bar_idx, lat.latency_ms, a.n
  HAVING lat.latency_ms = 0 OR min(b.bar_idx) IS NOT NULL),
entries AS (SELECT * FROM ent WHERE e0 < n),
surf AS (SELECT e.symbol, e.day, e.num, e.bar_idx, dirs.rule, e.latency_ms, e.e0 AS entry_bar, least(e.e0 + 3, e.n - 1) AS exit_bar,
  dirs.direction, i.vwap AS entry_price, o.vwap AS exit_price, dirs.direction * (o.vwap / i.vwap - 1.0) AS net_return
  FROM entries e JOIN dirs USING (symbol, day, num, bar_idx)
  JOIN bars i ON i.symbol = e.symbol AND i.day = e.day AND i.num = e.num AND i.bar_idx = e.e0
  JOIN bars o ON o.symbol = e.symbol AND o.day = e.day AND o.num = e.num AND o.bar_idx = least(e.e0 + 3, e.n - 1)
  WHERE dirs.direction <> 0)"""

TRADE_LABEL = f"""tl AS (SELECT *, CASE WHEN dir <> 0 THEN dir * (p4 / p1 - 1.0) END AS ret FROM (SELECT dd.*, dirs.direction AS dir,
  lead(vwap, 4) OVER (PARTITION BY dd.symbol, dd.day, dd.num ORDER BY dd.bar_idx) AS p4,
  lead(vwap, 1) OVER (PARTITION BY dd.symbol, dd.day, dd.num ORDER BY dd.bar_idx) AS p1
  FROM dd JOIN dirs USING (symbol, day, num, bar_idx) WHERE rule = 'momentum'))"""


def folds(*windows: int) -> str:
    spans = ", ".join(map(str, windows))
    return f"""tdays AS (SELECT CAST(unnest(generate_series(a + {HISTORY}, b, INTERVAL 1 DAY)) AS DATE) AS test_day FROM (SELECT min(day) AS a, max(day) AS b FROM tr)),
ws AS (SELECT unnest([{spans}]) AS w_snn),
folds AS (SELECT w_snn, test_day, test_day - CAST(k AS INTEGER) AS train_day FROM tdays, ws, (SELECT unnest(range(1, 32)) AS k) WHERE k <= w_snn)"""


def fold_stats(columns: list[str], source: str) -> str:
    aggs = ", ".join(f"count({c}) AS n_{c}, avg({c}) AS mean_{c}, stddev_pop({c}) AS std_{c}" for c in columns)
    return f"""SELECT symbol, num, w_snn, test_day, {aggs} FROM {source} s JOIN folds f ON s.day = f.train_day
  GROUP BY symbol, num, w_snn, test_day"""


SCOPED = """scoped AS (SELECT w_snn, test_day, train_day AS day, 'train' AS split FROM folds
  UNION ALL SELECT DISTINCT w_snn, test_day, test_day, 'test' FROM folds)"""

ZSCORE_ONLY = f"""xs AS (SELECT *, d AS x1, -d AS x2 FROM dd), zst AS ({fold_stats(['x1', 'x2'], 'xs')}),
zin AS (SELECT x.*, s.w_snn, s.test_day, s.split,
  CASE WHEN x1 IS NULL THEN 0.0 ELSE greatest(least((x1 - mean_x1) / std_x1 * 0.1 + 0.2, 1.0), 0.0) END AS p1,
  CASE WHEN x2 IS NULL THEN 0.0 ELSE greatest(least((x2 - mean_x2) / std_x2 * 0.1 + 0.2, 1.0), 0.0) END AS p2
  FROM xs x JOIN scoped s USING (day) JOIN zst USING (symbol, num, w_snn, test_day))"""
ZSCORE = SCOPED + ",\n" + ZSCORE_ONLY


def events(axis: str = "bar_index") -> str:
    t = "CAST(bar_idx AS DOUBLE)" if axis == "bar_index" else "(ts_end_ns - epoch_us(CAST(day AS TIMESTAMP)) * 1000) / 1e9"
    horizon = "CAST(n AS DOUBLE)" if axis == "bar_index" else "86400.0"
    return f"""ev AS (SELECT symbol, day, num, bar_idx, {t} AS t, CASE WHEN d > 0 THEN 0 ELSE 1 END AS k, abs(d) AS mark,
  CAST({horizon} AS DOUBLE) AS horizon FROM dd WHERE d <> 0)"""


def start_theta(spans: tuple[int, ...] = (1,), quantile: float = QUANTILE) -> str:
    """Fit windows, thresholds, marks and the theta every fit starts from; `day` is the day theta is used on."""
    names = ["uu", "ud", "du", "dd"]
    params = ", ".join([f"CAST({a} AS DOUBLE) AS alpha_{p}" for p, a in zip(names, ALPHA)] + [f"CAST({b} AS DOUBLE) AS beta_{p}" for p, b in zip(names, BETA)])
    return f"""whs AS (SELECT unnest([{', '.join(map(str, spans))}]) AS w_h),
win AS (SELECT w_h, fday, fday - CAST(j AS INTEGER) AS fit_day FROM (SELECT DISTINCT day AS fday FROM dd WHERE day > (SELECT min(day) FROM dd)), whs,
  (SELECT unnest(range(1, 32)) AS j) WHERE j <= w_h),
pool AS (SELECT e.symbol, e.num, w.w_h, w.fday AS day, w.fit_day, e.bar_idx, e.t, e.k, e.mark, e.horizon FROM ev e JOIN win w ON e.day = w.fit_day),
thr AS (SELECT symbol, num, w_h, day, quantile_cont(mark, {quantile}) AS event_threshold, count(*) AS candidate_moves FROM pool GROUP BY ALL),
kept AS (SELECT p.*, event_threshold, candidate_moves FROM pool p JOIN thr USING (symbol, num, w_h, day) WHERE mark > event_threshold),
mk AS (SELECT symbol, num, w_h, day, avg(mark) FILTER (k = 0) AS mark_scale_u, avg(mark) FILTER (k = 1) AS mark_scale_d,
  count(*) FILTER (k = 0) AS n_up, count(*) FILTER (k = 1) AS n_down FROM kept GROUP BY ALL HAVING min(k) = 0 AND max(k) = 1),
tt AS (SELECT symbol, num, w_h, fday AS day, sum(h) AS total_time FROM (SELECT symbol, num, day AS fit_day, CAST(count(*) AS DOUBLE) AS h
  FROM dd GROUP BY ALL) JOIN win USING (fit_day) GROUP BY ALL),
theta AS (SELECT *, {params}, 0.5 * n_up / total_time AS mu_u, 0.5 * n_down / total_time AS mu_d
  FROM thr JOIN mk USING (symbol, num, w_h, day) JOIN tt USING (symbol, num, w_h, day)),
fits AS (SELECT kept.*, mark / CASE WHEN k = 0 THEN mark_scale_u ELSE mark_scale_d END AS g FROM kept JOIN mk USING (symbol, num, w_h, day))"""


_NAMES = ("uu", "ud", "du", "dd")
_KEY = "symbol, num, w_h, day"


def sums(theta: str = "theta", n: str = "") -> str:
    """Likelihood sums of the fit set at a theta table: `sm{n}` with one row for each key, and the log-likelihood in `ll{n}`."""
    def past(m: str, k: str, lag: str = "") -> str:
        return f"coalesce(sum(e.g * {lag}exp(-b.beta_{m}{k} * (b.t - e.t))) FILTER (e.k = {'ud'.index(k)}), 0)"

    per_pair = ", ".join(
        f"max(alpha_{p}) AS alpha_{p}, max(beta_{p}) AS beta_{p}, sum(CASE WHEN k = {'ud'.index(p[0])} THEN s_{p} / lam ELSE 0 END) AS sl_{p}, "
        f"sum(CASE WHEN k = {'ud'.index(p[0])} THEN alpha_{p} * r_{p} / lam ELSE 0 END) AS rl_{p}, "
        f"sum(CASE WHEN k = {'ud'.index(p[1])} THEN g * (1 - exp(-beta_{p} * rest)) ELSE 0 END) AS g_{p}, "
        f"sum(CASE WHEN k = {'ud'.index(p[1])} THEN g * rest * exp(-beta_{p} * rest) ELSE 0 END) AS h_{p}" for p in _NAMES
    )
    decayed = ", ".join(f"{past(*p)} AS s_{p}, {past(*p, '(b.t - e.t) * ')} AS r_{p}" for p in _NAMES)
    return f"""fe{n} AS (SELECT f.*, th.* EXCLUDE (symbol, num, w_h, day, event_threshold, candidate_moves) FROM fits f JOIN {theta} th USING ({_KEY})),
fs{n} AS (SELECT b.symbol, b.num, b.w_h, b.day, b.fit_day, b.bar_idx, {decayed}
  FROM fe{n} b LEFT JOIN fe{n} e ON e.symbol = b.symbol AND e.num = b.num AND e.w_h = b.w_h AND e.day = b.day AND e.fit_day = b.fit_day AND e.bar_idx < b.bar_idx
  GROUP BY b.symbol, b.num, b.w_h, b.day, b.fit_day, b.bar_idx),
fl{n} AS (SELECT *, CASE WHEN k = 0 THEN mu_u + alpha_uu * s_uu + alpha_ud * s_ud ELSE mu_d + alpha_du * s_du + alpha_dd * s_dd END AS lam,
  horizon - t AS rest FROM fe{n} JOIN fs{n} USING (symbol, num, w_h, day, fit_day, bar_idx)),
sm{n} AS (SELECT {_KEY}, count(*) AS n_events, sum(ln(lam)) AS sum_log, max(total_time) AS total_time, max(mu_u) AS mu_u, max(mu_d) AS mu_d,
  sum(CASE WHEN k = 0 THEN 1 / lam ELSE 0 END) AS inv_u, sum(CASE WHEN k = 1 THEN 1 / lam ELSE 0 END) AS inv_d, {per_pair} FROM fl{n} GROUP BY {_KEY}),
ll{n} AS (SELECT *, sum_log - (mu_u + mu_d) * total_time - {' - '.join(f"alpha_{p} / beta_{p} * g_{p}" for p in _NAMES)} AS loglik FROM sm{n})"""


def em_step(theta: str, n: int, out: str) -> str:
    """One EM step, parameter by parameter, without the bound on the spectral radius (which two steps do not reach)."""
    mu = ", ".join(f"greatest(least(mu_{c} * inv_{c} / total_time, 1e3), 1e-8) AS mu_{c}" for c in "ud")
    ratio = ", ".join(f"alpha_{p} * sl_{p} AS kids_{p}, alpha_{p} * sl_{p} / greatest(g_{p}, 1e-300) AS a_{p}" for p in _NAMES)
    beta = ", ".join(
        f"greatest(least(CASE WHEN kids_{p} > 0 THEN kids_{p} / greatest(rl_{p} + a_{p} * h_{p}, 1e-300) ELSE beta_{p} END, 1e3), 1e-4) AS beta_{p}" for p in _NAMES)
    alpha = ", ".join(f"greatest(least(e.a_{p} * e.beta_{p}, 1e3), 1e-8) AS alpha_{p}" for p in _NAMES)
    changed = ", ".join(["mu_u", "mu_d"] + [f"{x}_{p}" for x in ("alpha", "beta") for p in _NAMES])
    return f"""{sums(theta, str(n))},
em{n} AS (SELECT {_KEY}, {mu}, {', '.join(f'beta_{p}' for p in _NAMES)}, {ratio}, {', '.join(f'rl_{p}, h_{p}' for p in _NAMES)} FROM sm{n}),
eb{n} AS (SELECT * EXCLUDE ({', '.join(f'beta_{p}' for p in _NAMES)}), {beta} FROM em{n}),
{out} AS (SELECT t.* EXCLUDE ({changed}), e.mu_u, e.mu_d, {', '.join(f'e.beta_{p}' for p in _NAMES)}, {alpha}
  FROM {theta} t JOIN eb{n} e USING ({_KEY}))"""


def theta(spans: tuple[int, ...] = (1,), quantile: float = QUANTILE, steps: int = EM_STEPS) -> str:
    """Theta after `steps` EM steps over the fit window; 0: the start itself."""
    if not steps:
        return start_theta(spans, quantile)
    names = [f"theta{i}" for i in range(steps)] + ["theta"]
    chain = [start_theta(spans, quantile).replace("theta AS (SELECT *,", "theta0 AS (SELECT *,")]
    return ",\n".join(chain + [em_step(a, i, b) for i, (a, b) in enumerate(zip(names, names[1:]))])


_S = lambda m, k, op: (
    f"coalesce(sum(e.g * exp(-b.beta_{m}{k} * (b.t - e.t))) FILTER (e.k = {'ud'.index(k)} AND e.bar_idx {op} b.bar_idx), 0)"
)

LAM = f"""tb AS (SELECT dd.*, CAST(dd.bar_idx AS DOUBLE) AS t, th.* EXCLUDE (symbol, day, num),
  CASE WHEN d <> 0 AND abs(d) > event_threshold THEN CASE WHEN d > 0 THEN 0 ELSE 1 END END AS k,
  CASE WHEN d <> 0 AND abs(d) > event_threshold THEN abs(d) / CASE WHEN d > 0 THEN mark_scale_u ELSE mark_scale_d END END AS g
  FROM dd JOIN theta th USING (symbol, day, num)),
s0 AS (SELECT b.symbol, b.num, b.w_h, b.day, b.bar_idx,
  {', '.join(f"{_S(m, k, '<')} AS sm_{m}{k}, {_S(m, k, '<=')} AS sp_{m}{k}" for m in 'ud' for k in 'ud')}
  FROM tb b LEFT JOIN tb e ON e.symbol = b.symbol AND e.num = b.num AND e.w_h = b.w_h AND e.day = b.day AND e.k IS NOT NULL AND e.bar_idx <= b.bar_idx
  GROUP BY b.symbol, b.num, b.w_h, b.day, b.bar_idx),
l2 AS (SELECT tb.*, {', '.join(f"mu_{m} + alpha_{m}u * s{x}_{m}u + alpha_{m}d * s{x}_{m}d AS lam_{m}{n}" for m in 'ud' for x, n in (('m', '_minus'), ('p', '')))},
  sm_uu, sm_ud, sm_du, sm_dd FROM tb JOIN s0 USING (symbol, num, w_h, day, bar_idx)),
lam AS (SELECT *, CASE k WHEN 0 THEN mu_u / lam_u_minus WHEN 1 THEN mu_d / lam_d_minus END AS p_bg,
  CASE k WHEN 0 THEN alpha_uu * sm_uu / lam_u_minus WHEN 1 THEN alpha_dd * sm_dd / lam_d_minus END AS p_same,
  CASE k WHEN 0 THEN alpha_ud * sm_ud / lam_u_minus WHEN 1 THEN alpha_du * sm_du / lam_d_minus END AS p_cross,
  p_same - p_cross AS mom FROM l2)"""


def chain(*parts: str, symbol: str = "'ALL'", num: int = NUM) -> str:
    """WITH clause: trades, bars, differences and the given further parts."""
    return "WITH " + ",\n".join([trades(symbol), bars(num), DIFFS, *parts]) + "\n"
