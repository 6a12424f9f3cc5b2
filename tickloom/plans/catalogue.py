"""Registered queries of the engine and their SQL oracles. Numbers are rounded to six decimals on both sides."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.constants import KERNEL_NAMES, THETA, TRIPOWER, kernel_id, kernel_weight, list_available_kernels, mu_p, normal_quantile, psi_constants
from tickloom.functions.returns import KEYS, lags, log_returns, median3, min2, product, series, simple_returns
from tickloom.functions.stats import normal_tail_sql, t_two_sided
from tickloom.operators import async_cov, inference, jumps, liquidity, matrix, models, noise, panel, realized, spot
from tickloom.sources import tables
from tickloom.streaming.incremental import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PI = math.pi


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def add(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir))
    if oracle:
        ORACLES[name] = oracle


def on_ticks(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(tables.ticks(spark, sf_dir))


def on_panel(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(tables.panel(spark, sf_dir))


def on_daily(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(models.daily_measures(tables.order_ticks(spark, sf_dir)))


def rnd(expression: str, name: str) -> str:
    return f"round(CAST({expression} AS DOUBLE), 6) AS {name}"


# --- returns and rolling helpers --------------------------------------------------------------------------

TICKS = "t AS (SELECT event_type AS symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, ts, event_id AS seq, value AS price FROM events WHERE value > 0)"
W = "(PARTITION BY symbol, day ORDER BY ts, seq)"
RETURNS = f"{TICKS}, r AS (SELECT *, ln(price / lag(price) OVER w) AS r FROM t WINDOW w AS {W})"
LAGGED = f"{RETURNS}, l AS (SELECT *, abs(r) AS a, abs(lag(r, 1) OVER w) AS a1, abs(lag(r, 2) OVER w) AS a2, abs(lag(r, 3) OVER w) AS a3 FROM r WINDOW w AS {W})"
MIN2 = "CASE WHEN a IS NOT NULL AND a1 IS NOT NULL THEN least(a, a1) END"
MED3 = "CASE WHEN a IS NOT NULL AND a1 IS NOT NULL AND a2 IS NOT NULL THEN greatest(least(a, a1), least(greatest(a, a1), a2)) END"


def _rows(column, returns=log_returns) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = returns(tables.ticks(spark, sf_dir))
        value = column() if column else F.col("r")
        return rows.select(*KEYS, "seq", value.alias("value")).filter("value IS NOT NULL")

    return query


def _a(n: int) -> list:
    return lags(F.abs("r"), n, series())


def _row_oracle(value: str, source: str = LAGGED, of: str = "l") -> str:
    return f"WITH {source} SELECT symbol, day, seq, {rnd(value, 'value')} FROM {of} WHERE {value} IS NOT NULL"


add("log_returns", _rows(None), _row_oracle("r"))
add("simple_returns", _rows(None, simple_returns), f"WITH {TICKS}, r AS (SELECT *, price / lag(price) OVER w - 1 AS r FROM t WINDOW w AS {W}) SELECT symbol, day, seq, {rnd('r', 'value')} FROM r WHERE r IS NOT NULL")
add("roll_min2", _rows(lambda: min2(*_a(2))), _row_oracle(MIN2))
add("roll_median3", _rows(lambda: median3(*_a(3))), _row_oracle(MED3))
add("roll_prod", _rows(lambda: product(_a(3))), _row_oracle("a * a1 * a2"))

# --- realized measures ------------------------------------------------------------------------------------

S = lambda x: f"coalesce(sum({x}), 0)"
N = "count(r)"
SUMS = {
    "rrvar": S("r * r"),
    "rbpvar": f"{PI / 2!r} * {S('a * a1')}",
    "rmedrvar": f"CASE WHEN {N} < 3 THEN 0 ELSE {PI / (6 - 4 * math.sqrt(3) + PI)!r} * {N} / ({N} - 2) * {S(f'pow({MED3}, 2)')} END",
    "rminrvar": f"CASE WHEN {N} < 2 THEN 0 ELSE {PI / (PI - 2)!r} * {N} / ({N} - 1) * {S(f'pow({MIN2}, 2)')} END",
    "rsvar_down": S("CASE WHEN r < 0 THEN r * r END"),
    "rsvar_up": S("CASE WHEN r > 0 THEN r * r END"),
    "rquar": f"({N} + 1) / 3.0::DOUBLE * {S('r * r * r * r')}",
    "rtpquar": f"CASE WHEN {N} < 3 THEN 0 ELSE {N} * ({N}::DOUBLE / ({N} - 2)) * {TRIPOWER**-3!r} * {S('pow(a, 4.0::DOUBLE / 3) * pow(a1, 4.0::DOUBLE / 3) * pow(a2, 4.0::DOUBLE / 3)')} END",
    "rmedrquar": f"CASE WHEN {N} < 3 THEN 0 ELSE {3 * PI / (9 * PI + 72 - 52 * math.sqrt(3))!r} * {N} * ({N}::DOUBLE / ({N} - 2)) * {S(f'pow({MED3}, 4)')} END",
    "rminrquar": f"CASE WHEN {N} < 2 THEN 0 ELSE {PI / (3 * PI - 8)!r} * {N} * ({N}::DOUBLE / ({N} - 1)) * {S(f'pow({MIN2}, 4)')} END",
    "rqpvar": f"CASE WHEN {N} < 4 THEN 0 ELSE {N} * ({N}::DOUBLE / ({N} - 3)) * {(PI / 2) ** 2!r} * {S('a * a1 * a2 * a3')} END",
    "rskew": f"CASE WHEN {S('r * r')} < 1e-15 THEN 0 ELSE (sum(r * r * r) / {N}) / pow(sum(r * r) / {N}, 1.5) END",
    "rkurt": f"CASE WHEN {S('r * r')} < 1e-15 THEN 0 ELSE (sum(r * r * r * r) / {N}) / pow(sum(r * r) / {N}, 2) END",
}


def _group_oracle(*names: str) -> str:
    return f"WITH {LAGGED} SELECT symbol, day, {N} AS n, {', '.join(rnd(SUMS[m], m) for m in names)} FROM l GROUP BY symbol, day"


def _measures(*names: str) -> Query:
    return on_ticks(lambda t: realized.realized(t, list(names)))


for _m in SUMS:
    if not _m.startswith("rsvar"):
        add(_m, _measures(_m), _group_oracle(_m))
add("rsvar", _measures("rsvar_down", "rsvar_up"), _group_oracle("rsvar_down", "rsvar_up"))
add("realized_all", _measures(*SUMS), _group_oracle(*SUMS))
add("rmpvar", on_ticks(lambda t: noise_free_multipower(t)), f"WITH {LAGGED} SELECT symbol, day, {rnd(f'CASE WHEN {N} < 3 THEN 0 ELSE {mu_p(2 / 3) ** -3!r} * pow({N}::DOUBLE, 1.0) / ({N} - 2) * {S("pow(a, 2.0::DOUBLE / 3) * pow(a1, 2.0::DOUBLE / 3) * pow(a2, 2.0::DOUBLE / 3)")} END', 'rmpvar')} FROM l GROUP BY symbol, day")


def noise_free_multipower(t: DataFrame) -> DataFrame:
    return realized.multipower(t, m=3, p=2.0)


# --- noise-robust measures --------------------------------------------------------------------------------

add("rtsvar", on_ticks(lambda t: noise.two_scale(t, k=10, j=1)), f"""
WITH {TICKS}, g AS (SELECT symbol, day, pow(ln(price) - ln(lag(price, 10) OVER w), 2) AS k, pow(ln(price) - ln(lag(price, 1) OVER w), 2) AS j FROM t WINDOW w AS {W}),
s AS (SELECT symbol, day, count(*) AS n, coalesce(sum(k), 0) AS sk, coalesce(sum(j), 0) AS sj, CASE WHEN count(*) <> 1 THEN ((count(*) - 10) / 10.0::DOUBLE) / ((count(*) - 1) / 1.0::DOUBLE) END AS q FROM g GROUP BY symbol, day)
SELECT symbol, day, {rnd('CASE WHEN q <> 1 THEN (sk / 10 - q * sj) / (1 - q) END', 'rtsvar')} FROM s""")


def _kernel_oracle(kernel: str, h: int) -> str:
    cols = ", ".join(f"2 * r * lag(r, {i}) OVER w AS c{i}" for i in range(1, h + 1))
    value = S("r * r") + "".join(f" + {kernel_weight((i - 1) / h, kernel)!r} * CASE WHEN count(r) + 1 = {i} THEN 0 ELSE (count(r) + 1.0::DOUBLE) / (count(r) + 1 - {i}) END * {S(f'c{i}')}" for i in range(1, h + 1))
    return f"WITH {RETURNS}, k AS (SELECT symbol, day, r, {cols} FROM r WINDOW w AS {W}) SELECT symbol, day, {rnd(value, 'rkernelvar')} FROM k GROUP BY symbol, day"


for _k in ("bartlett", "parzen", "qs", "tukey", "cubic", "order5", "order6", "order7", "order8", "parzenpoly", "tukeypoly", "flattop"):
    add(f"rkernelvar_{_k}", on_ticks(lambda t, k=_k: noise.realized_kernel(t, k, 3)), _kernel_oracle(_k, 3))


def _remedi_sql(kn: int, lag: int) -> str:
    return f"(lead(price, {lag}) OVER w - lead(price, {lag + kn}) OVER w) * (price - lag(price, {2 * kn}) OVER w)"


add("remedi", on_ticks(lambda t: noise.remedi(t, kn=1, lags=(0, 1, 2, 3))), f"WITH {TICKS}, x AS (" + " UNION ALL ".join(f"SELECT symbol, day, {g} AS lag, {_remedi_sql(1, g)} AS x FROM t WINDOW w AS {W}" for g in range(4)) + f") SELECT symbol, day, lag, {rnd('coalesce(sum(x), 0) / count(*)', 'remedi')} FROM x GROUP BY symbol, day, lag")
_KN_ROWS = " UNION ALL ".join(f"SELECT symbol, day, {kn} AS kn, {_remedi_sql(kn, 0)} AS x0, {_remedi_sql(kn, 1)} AS x1, {_remedi_sql(kn, 2)} AS x2, {_remedi_sql(kn, 3)} AS x3 FROM t WINDOW w AS {W}" for kn in range(1, 6))
add("knchoose_remedi", on_ticks(lambda t: noise.choose_kn(t, max_kn=5, tol=25.0)), f"WITH {TICKS}, x AS ({_KN_ROWS}), c AS (SELECT symbol, day, kn, pow(coalesce(sum(x0), 0) / count(*) - coalesce(sum(x1), 0) / count(*) - coalesce(sum(x2), 0) / count(*) + coalesce(sum(x3), 0) / count(*), 2) AS c FROM x GROUP BY symbol, day, kn) SELECT symbol, day, CAST(coalesce(min(CASE WHEN c < 25.0 THEN kn END), 5) AS INTEGER) AS kn FROM c GROUP BY symbol, day")
#: Pre-averaged returns of a group: rows (keys, i, pa) by a join on row numbers; kn depends on the group.
_PRE = f"""{RETURNS}, v AS (SELECT symbol, day, r, row_number() OVER {W} - 1 AS i FROM r), q AS (SELECT symbol, day, r, i FROM v WHERE r IS NOT NULL),
m AS (SELECT symbol, day, count(*) + 1 AS n, greatest(2, CAST(floor(0.8::DOUBLE * sqrt(count(*) + 1)) AS INTEGER)) AS kn, sum(r * r) AS rr FROM q GROUP BY symbol, day),
g AS (SELECT symbol, day, n, kn, rr, j, least(j::DOUBLE / kn, 1 - j::DOUBLE / kn) AS g, least((j + 1)::DOUBLE / kn, 1 - (j + 1)::DOUBLE / kn) AS g1 FROM (SELECT *, unnest(range(kn)) AS j FROM m)),
p AS (SELECT symbol, day, any_value(rr) AS rr, any_value(n) AS n, any_value(kn) AS kn, sum(g) AS gs, kn * sum(pow(g1 - g, 2)) AS psi1, sum(g * g) / kn AS psi2 FROM g GROUP BY symbol, day, kn),
a AS (SELECT q.symbol, q.day, q.i, sum(z.r * g.g) / any_value(p.gs) AS pa FROM q JOIN p USING (symbol, day) JOIN g USING (symbol, day) JOIN q AS z ON z.symbol = q.symbol AND z.day = q.day AND z.i = q.i + g.j WHERE q.i + p.kn <= p.n GROUP BY q.symbol, q.day, q.i)"""
add("rmrvar", on_ticks(noise.modulated), f"WITH {_PRE} SELECT p.symbol, p.day, {rnd('coalesce((SELECT sum(pa * pa) FROM a WHERE a.symbol = p.symbol AND a.day = p.day), 0) / (sqrt(n) * 0.8 * psi2) - psi1 / (2 * 0.64 * psi2 * n) * rr', 'rmrvar')} FROM p")

_G6 = [min(j / 6, 1 - j / 6) for j in range(6)]
_AHEAD = " + ".join(f"lead(r, {j}) OVER w * {g!r}::DOUBLE" for j, g in enumerate(_G6))
add("pre_average_returns", on_ticks(lambda t: noise.pre_average(t, 6)), f"WITH {RETURNS}, q AS (SELECT * FROM r WHERE r IS NOT NULL), a AS (SELECT symbol, day, row_number() OVER w - 1 AS idx, ({_AHEAD}) / {sum(_G6)!r}::DOUBLE AS v FROM q WINDOW w AS {W}) SELECT symbol, day, CAST(idx AS INTEGER) AS idx, {rnd('v', 'pre_averaged')} FROM a WHERE v IS NOT NULL")


def _kernel_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(k, i / 17, kernel_weight(i / 17, k)) for k in KERNEL_NAMES for i in range(18)]
    return spark.createDataFrame(rows, "kernel string, x double, weight double")


_PZ = "CASE WHEN x < 0.5 THEN 1 - 6 * x * x + 6 * x * x * x ELSE 2 * pow(1 - x, 3) END"
_KSQL = {"bartlett": "1 - x", "parzen": _PZ, "parzenpoly": _PZ, "tukey": "(1 + cos(pi() * x)) / 2", "tukeypoly": "(1 + cos(pi() * x)) / 2", "cubic": "1 - 3 * x * x + 2 * x * x * x", "qs": "CASE WHEN x = 0 THEN 1 ELSE 25 / (12 * pi() * pi() * x * x) * (sin(1.2 * pi() * x) / (1.2 * pi() * x) - cos(1.2 * pi() * x)) END", "order5": "1 - 10 * pow(x, 2) + 15 * pow(x, 3) - 6 * pow(x, 4)", "order6": "1 - 15 * pow(x, 2) + 35 * pow(x, 3) - 21 * pow(x, 4)", "order7": "1 - 21 * pow(x, 2) + 70 * pow(x, 3) - 84 * pow(x, 4) + 35 * pow(x, 5)", "order8": "1 - 28 * pow(x, 2) + 126 * pow(x, 3) - 210 * pow(x, 4) + 120 * pow(x, 5)", "flattop": "CASE WHEN x < 0.1 THEN 1 ELSE (1 - x) / 0.9 END"}
add("kernel_weights", _kernel_table, "WITH g AS (SELECT CAST(i AS DOUBLE) / 17 AS x FROM (SELECT unnest(range(18)) AS i)) " + " UNION ALL ".join(f"SELECT '{k}' AS kernel, {rnd('x', 'x')}, {rnd(v, 'weight')} FROM g" for k, v in _KSQL.items()))


def _psi_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(kn, *psi_constants(kn)) for kn in range(2, 41)], "kn long, psi1 double, psi2 double")


#: The published spellings of each kernel.
_SPELLED = "VALUES ('bartlett', 'bartlett'), ('triangular', 'bartlett'), ('parzen', 'parzen'), ('qs', 'qs'), ('quadratic', 'qs'), ('tukey', 'tukey'), ('hanning', 'tukey'), ('tukey-hanning', 'tukey'), ('cubic', 'cubic'), ('5th', 'order5'), ('fifth', 'order5'), ('6th', 'order6'), ('7th', 'order7'), ('8th', 'order8'), ('parzen_poly', 'parzenpoly'), ('tukey_poly', 'tukeypoly'), ('flat-top', 'flattop'), ('flattop', 'flattop')"
add("list_available_kernels", lambda s, d: s.createDataFrame([(k,) for k in list_available_kernels()], "name string"), f"SELECT name FROM ({_SPELLED}) AS k(name, kernel)")
add("kernel_ids", lambda s, d: s.createDataFrame([(k, kernel_id(k)) for k in list_available_kernels()], "name string, kernel string"), f"SELECT name, kernel FROM ({_SPELLED}) AS k(name, kernel)")
add("psi_constants", _psi_table, f"""WITH k AS (SELECT unnest(range(2, 41)) AS kn), j AS (SELECT kn, unnest(range(kn)) AS j FROM k), g AS (SELECT kn, least(j::DOUBLE / kn, 1 - j::DOUBLE / kn) AS a, least((j + 1)::DOUBLE / kn, 1 - (j + 1)::DOUBLE / kn) AS b FROM j)
SELECT kn, {rnd('kn * sum(pow(b - a, 2))', 'psi1')}, {rnd('sum(a * a) / kn', 'psi2')} FROM g GROUP BY kn""")
add("mu_p", lambda s, d: s.createDataFrame([(p / 4, mu_p(p / 4)) for p in range(1, 33)], "p double, mu double"), f"WITH g AS (SELECT CAST(i AS DOUBLE) / 4 AS p FROM (SELECT unnest(range(1, 33)) AS i)) SELECT {rnd('p', 'p')}, {rnd('pow(2, p / 2) * gamma((p + 1) / 2) / sqrt(pi())', 'mu')} FROM g")

# --- covariances of an aligned panel ----------------------------------------------------------------------

PANEL = f"""{RETURNS}, o AS (SELECT symbol, day, r, row_number() OVER {W} - 1 AS idx FROM r), c AS (SELECT day, min(n) AS n FROM (SELECT symbol, day, count(*) AS n FROM o WHERE idx > 0 GROUP BY symbol, day) GROUP BY day),
p AS (SELECT o.day, idx, symbol, r FROM o JOIN c USING (day) WHERE idx > 0 AND idx <= c.n),
x AS (SELECT i.day, i.idx, i.symbol AS sym_i, j.symbol AS sym_j, i.r AS a, j.r AS b FROM p i JOIN p j ON i.day = j.day AND i.idx = j.idx AND i.symbol <= j.symbol)"""
PAIR = "day, sym_i, sym_j"
PW = "(PARTITION BY day, sym_i, sym_j ORDER BY idx)"
add("rcov", on_panel(panel.covariance), f"WITH {PANEL} SELECT {PAIR}, {rnd('sum(a * b)', 'rcov')} FROM x GROUP BY {PAIR}")
add("rbpcov", on_panel(panel.bipower_covariance), f"WITH {PANEL}, y AS (SELECT *, abs(a + b) * lag(abs(a + b)) OVER w - abs(a - b) * lag(abs(a - b)) OVER w AS v FROM x WINDOW w AS {PW}) SELECT {PAIR}, {rnd(f'{PI / 8!r} * coalesce(sum(v), 0)', 'rbpcov')} FROM y GROUP BY {PAIR}")
_P, _Q = (lambda c: f"greatest({c}, 0)"), (lambda c: f"least({c}, 0)")
add("rsemicov", on_panel(panel.semi_covariance), f"""WITH {PANEL} SELECT {PAIR}, {rnd(f"sum({_P('a')} * {_P('b')})", 'positive')}, {rnd(f"sum({_Q('a')} * {_Q('b')})", 'negative')}, {rnd(f"sum({_P('a')} * {_Q('b')} + {_Q('a')} * {_P('b')})", 'mixed')},
{rnd(f"sum({_P('a')} * {_P('b')} + {_Q('a')} * {_Q('b')})", 'concordant')}, {rnd('sum(a * b)', 'rcov')} FROM x GROUP BY {PAIR}""")
_KC = ", ".join(f"lag(a, {h}) OVER w * b + a * lag(b, {h}) OVER w AS c{h}" for h in (1, 2, 3))
_KV = "sum(a * b)" + "".join(f" + {kernel_weight((h - 1) / 3, 'parzen')!r} * CASE WHEN count(*) + 1 = {h} THEN 0 ELSE (count(*) + 1.0::DOUBLE) / (count(*) + 1 - {h}) END * coalesce(sum(c{h}), 0)" for h in (1, 2, 3))
add("rkernelcov", on_panel(lambda p: panel.kernel_covariance(p, "parzen", 3)), f"WITH {PANEL}, y AS (SELECT *, {_KC} FROM x WINDOW w AS {PW}) SELECT {PAIR}, {rnd(_KV, 'rkernelcov')} FROM y GROUP BY {PAIR}")
add("rthresholdcov", on_panel(panel.threshold_covariance), f"WITH {PANEL}, v AS (SELECT day, 3 * sqrt(avg(rv)) AS lim FROM (SELECT day, symbol, sum(r * r) AS rv FROM p GROUP BY day, symbol) GROUP BY day) SELECT {PAIR}, {rnd('coalesce(sum(CASE WHEN sym_i = sym_j OR (abs(a) <= lim AND abs(b) <= lim) THEN a * b END), 0)', 'rthresholdcov')} FROM x JOIN v USING (day) GROUP BY {PAIR}")
add("ravgcov", on_panel(lambda p: panel.averaged_covariance(p, 3)), f"""WITH {PANEL}, n AS (SELECT {PAIR}, count(*) AS n FROM x GROUP BY {PAIR}), offs AS (SELECT unnest([2, 1, 2]) AS off, unnest([1, 0, 0]) AS main),
y AS (SELECT {PAIR}, off, main, n, (a - lag(a) OVER g) * (b - lag(b) OVER g) AS v FROM x JOIN n USING ({PAIR}) JOIN offs ON idx - 1 >= off AND (idx - 1 - off) % 3 = 0 WINDOW g AS (PARTITION BY {PAIR}, off, main ORDER BY idx)),
z AS (SELECT {PAIR}, off, main, any_value(n) AS n, coalesce(sum(v), 0) AS v FROM y GROUP BY {PAIR}, off, main)
SELECT {PAIR}, {rnd('coalesce(sum(CASE WHEN main = 1 THEN v WHEN (n - off) // 3 > 0 THEN v * ((n - 2) // 3) / ((n - off) // 3) ELSE 0 END), 0) / 3', 'ravgcov')} FROM n LEFT JOIN z USING ({PAIR}, n) GROUP BY {PAIR}""")
add("rowcov", on_panel(panel.weighted_covariance), f"""WITH {PANEL}, d AS (SELECT *, abs(r - median(r) OVER (PARTITION BY day, symbol)) AS dev FROM p), e AS (SELECT *, median(dev) OVER (PARTITION BY day, symbol) * 1.4826 AS mad FROM d),
f AS (SELECT day, idx, sum(pow(dev / (mad + 1e-10), 2)) AS d FROM e GROUP BY day, idx), w AS (SELECT day, idx, CASE WHEN d > 9 THEN 9 / d ELSE 1 END AS w FROM f)
SELECT {PAIR}, {rnd('sum(w * a * b) / sum(w) * count(*)', 'rowcov')} FROM x JOIN w USING (day, idx) GROUP BY {PAIR}""")
add("make_psd", on_panel(lambda p: matrix.make_psd(panel.bipower_covariance(p), "rbpcov")))

# --- covariances of ticks without a common clock -----------------------------------------------------------

#: Ticks of a symbol at one time are one tick, the last by seq.
STEPS = f"{RETURNS}, u AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY symbol, day, ts ORDER BY seq DESC, price DESC) = 1), h AS (SELECT symbol, day, seq, epoch_us(ts)::DOUBLE / 3.6e9 AS t, ln(price) AS lp, ln(price / lag(price) OVER w) AS r, lag(epoch_us(ts)::DOUBLE / 3.6e9) OVER w AS t0 FROM u WINDOW w AS {W}), z AS (SELECT * FROM h WHERE r IS NOT NULL), nm AS (SELECT DISTINCT day, symbol FROM t), pr AS (SELECT i.day, i.symbol AS sym_i, j.symbol AS sym_j FROM nm i JOIN nm j ON i.day = j.day AND i.symbol < j.symbol)"
_OVER = "a.t0 < b.t + lag AND b.t0 + lag < a.t"
_SHIFT = f"s AS (SELECT pr.day, pr.sym_i, pr.sym_j, lag, coalesce(sum(a.r * b.r), 0) AS v FROM pr CROSS JOIN (SELECT unnest(range(-3, 4)) AS lag) LEFT JOIN (z a JOIN z b ON a.day = b.day AND a.symbol < b.symbol) ON a.day = pr.day AND a.symbol = pr.sym_i AND b.symbol = pr.sym_j AND {_OVER} GROUP BY pr.day, pr.sym_i, pr.sym_j, lag)"
add("rhycov", on_ticks(async_cov.overlap_covariance), f"WITH {STEPS} SELECT day, symbol AS sym_i, symbol AS sym_j, {rnd('coalesce(sum(r * r), 0)', 'rhycov')} FROM r GROUP BY day, symbol UNION ALL SELECT pr.day, sym_i, sym_j, {rnd('coalesce(sum(a.r * b.r), 0)', 'rhycov')} FROM pr LEFT JOIN (z a JOIN z b ON a.day = b.day AND a.symbol < b.symbol AND a.t0 < b.t AND b.t0 < a.t) ON a.day = pr.day AND a.symbol = pr.sym_i AND b.symbol = pr.sym_j GROUP BY pr.day, sym_i, sym_j")
add("leadlag_covariances", on_ticks(lambda t: async_cov.shifted_covariances(t, 3)), f"WITH {STEPS}, {_SHIFT} SELECT {PAIR}, CAST(lag AS INTEGER) AS lag, {rnd('v', 'covariance')} FROM s")
add("leadlag", on_ticks(lambda t: async_cov.lead_lag(t, 3)), f"""WITH {STEPS}, {_SHIFT}, k AS (SELECT *, row_number() OVER (PARTITION BY {PAIR} ORDER BY abs(v) DESC, lag) AS k FROM s)
SELECT {PAIR}, CAST(lag AS INTEGER) AS lag, {rnd('v', 'covariance')}, CASE WHEN lag > 0 THEN 'Series 1 leads series 2 by ' || lag WHEN lag < 0 THEN 'Series 2 leads series 1 by ' || abs(lag) ELSE 'No lead-lag relationship' END AS interpretation FROM k WHERE k = 1""")
#: The refresh-time grid by a recursive walk, and each symbol's last value strictly before a grid time.
REFRESH = f"""{STEPS}, ts2 AS (SELECT pr.day, sym_i, sym_j, h.symbol, h.t, h.lp FROM pr JOIN h ON h.day = pr.day AND h.symbol IN (sym_i, sym_j)),
lim AS (SELECT {PAIR}, max(t) FILTER (symbol = sym_i) AS hi_i, max(t) FILTER (symbol = sym_j) AS hi_j, min(t) FILTER (symbol = sym_i) AS lo_i, min(t) FILTER (symbol = sym_j) AS lo_j, arg_min(lp, t) FILTER (symbol = sym_i) AS first_i, arg_min(lp, t) FILTER (symbol = sym_j) AS first_j FROM ts2 GROUP BY {PAIR}),
nx AS (SELECT *, min(t) FILTER (symbol = sym_i) OVER f AS ni, min(t) FILTER (symbol = sym_j) OVER f AS nj, last_value(CASE WHEN symbol = sym_i THEN lp END IGNORE NULLS) OVER b AS pi, last_value(CASE WHEN symbol = sym_j THEN lp END IGNORE NULLS) OVER b AS pj FROM ts2
  WINDOW f AS (PARTITION BY {PAIR} ORDER BY t, symbol ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), b AS (PARTITION BY {PAIR} ORDER BY t, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
walk AS (SELECT {PAIR}, 0 AS m, greatest(lo_i, lo_j) AS t FROM lim WHERE greatest(lo_i, lo_j) <= least(hi_i, hi_j)
  UNION ALL SELECT w.day, w.sym_i, w.sym_j, w.m + 1, greatest(nx.ni, nx.nj) FROM walk w JOIN nx ON nx.day = w.day AND nx.sym_i = w.sym_i AND nx.sym_j = w.sym_j AND nx.t = w.t JOIN lim ON lim.day = w.day AND lim.sym_i = w.sym_i AND lim.sym_j = w.sym_j
  WHERE nx.ni IS NOT NULL AND nx.nj IS NOT NULL AND greatest(nx.ni, nx.nj) <= least(hi_i, hi_j)),
grid AS (SELECT w.day, w.sym_i, w.sym_j, w.m, w.t, coalesce(nx.pi, first_i) AS lp_i, coalesce(nx.pj, first_j) AS lp_j FROM walk w JOIN nx ON nx.day = w.day AND nx.sym_i = w.sym_i AND nx.sym_j = w.sym_j AND nx.t = w.t JOIN lim ON lim.day = w.day AND lim.sym_i = w.sym_i AND lim.sym_j = w.sym_j)"""
add("refresh_time", on_ticks(async_cov.refresh_sync), f"WITH RECURSIVE {REFRESH} SELECT {PAIR}, CAST(m AS BIGINT) AS m, {rnd('t', 't')}, {rnd('lp_i', 'lp_i')}, {rnd('lp_j', 'lp_j')} FROM grid")
_GW = "(PARTITION BY day, sym_i, sym_j ORDER BY m)"


def _two_scale_oracle(name: str) -> str:
    return f"""WITH RECURSIVE {REFRESH}, gap AS (SELECT {PAIR}, (lp_i - lag(lp_i, 10) OVER w) * (lp_j - lag(lp_j, 10) OVER w) AS k, (lp_i - lag(lp_i) OVER w) * (lp_j - lag(lp_j) OVER w) AS j FROM grid WINDOW w AS {_GW}),
s AS (SELECT {PAIR}, count(*) AS n, sum(k) AS sk, sum(j) AS sj FROM gap GROUP BY {PAIR} HAVING count(*) >= 11),
v AS (SELECT {PAIR}, n / (9 * ((n - 10) / 10.0::DOUBLE)) * (sk / 10 - ((n - 10) / 10.0::DOUBLE) / (n - 1) * sj) AS v FROM s),
d AS (SELECT symbol, day, pow(ln(price) - ln(lag(price, 10) OVER w), 2) AS k, pow(ln(price) - ln(lag(price, 1) OVER w), 2) AS j FROM t WINDOW w AS {W}),
e AS (SELECT symbol, day, coalesce(sum(k), 0) AS sk, coalesce(sum(j), 0) AS sj, CASE WHEN count(*) <> 1 THEN ((count(*) - 10) / 10.0::DOUBLE) / (count(*) - 1) END AS q FROM d GROUP BY symbol, day)
SELECT day, symbol AS sym_i, symbol AS sym_j, {rnd('CASE WHEN q <> 1 THEN (sk / 10 - q * sj) / (1 - q) END', name)} FROM e UNION ALL SELECT {PAIR}, {rnd('coalesce(v, 0)', name)} FROM pr LEFT JOIN v USING ({PAIR})"""


add("rtscov", on_ticks(lambda t: async_cov.two_scale_covariance(t, 10, 1)), _two_scale_oracle("rtscov"))
add("rrtscov", on_ticks(lambda t: async_cov.robust_two_scale_covariance(t, 10, 1)), _two_scale_oracle("rrtscov"))
_MRC = f"""WITH RECURSIVE {REFRESH}, q AS (SELECT {PAIR}, m - 1 AS i, lp_i - lag(lp_i) OVER w AS ri, lp_j - lag(lp_j) OVER w AS rj FROM grid WINDOW w AS {_GW}),
mm AS (SELECT {PAIR}, count(*) AS n, greatest(2, CAST(floor(0.8::DOUBLE * sqrt(count(*))) AS INTEGER)) AS kn FROM q GROUP BY {PAIR} HAVING count(*) >= 4),
g AS (SELECT {PAIR}, n, kn, j, least(j::DOUBLE / kn, 1 - j::DOUBLE / kn) AS g FROM (SELECT *, unnest(range(kn)) AS j FROM mm)), gs AS (SELECT {PAIR}, n, kn, sum(g) AS gs FROM g GROUP BY {PAIR}, n, kn),
a AS (SELECT q.day, q.sym_i, q.sym_j, q.i, sum(z.ri * g.g) / any_value(gs) AS pi, sum(z.rj * g.g) / any_value(gs) AS pj FROM q JOIN gs USING ({PAIR}) JOIN g USING ({PAIR}) JOIN q AS z ON z.day = q.day AND z.sym_i = q.sym_i AND z.sym_j = q.sym_j AND z.i = q.i + g.j WHERE q.i >= 0 AND q.i + gs.kn <= gs.n - 1 GROUP BY q.day, q.sym_i, q.sym_j, q.i),
v AS (SELECT {PAIR}, any_value(n) / (any_value(n) - any_value(kn) + 2.0::DOUBLE) * (12.0::DOUBLE / any_value(kn)) * sum(pi * pj) AS v FROM a JOIN gs USING ({PAIR}) GROUP BY {PAIR})
SELECT {PAIR}, {rnd('coalesce(v, 0)', 'rmrcov')} FROM pr LEFT JOIN v USING ({PAIR})"""
add("rmrcov_pairs", on_ticks(lambda t: async_cov.modulated_covariance(t).filter("sym_i < sym_j")), _MRC)
add("rmrcov", on_ticks(async_cov.modulated_covariance), f"SELECT * FROM ({_MRC}) UNION ALL SELECT day, symbol AS sym_i, symbol AS sym_j, rmrvar AS rmrcov FROM ({ORACLES['rmrvar']})")

# --- jumps, inference, spot -------------------------------------------------------------------------------


def _two_sided(z: str) -> str:
    return f"2 * ({normal_tail_sql(f'abs({z})')})"


def _bns_oracle(iv: str, iq: str, theta: float, ratio: bool = False) -> str:
    z = f"CASE WHEN iv > 0 AND rv > 0 AND iq > 0 THEN (rv / iv - 1) / sqrt({theta!r} * iq / (n * iv * iv)) WHEN iv > 0 AND rv > 0 THEN NULL ELSE 0 END" if ratio else f"CASE WHEN {theta!r} * iq > 0 AND iv > 0 THEN (rv - iv) / sqrt({theta!r} * iq / n) ELSE 0 END"
    return f"WITH {LAGGED}, m AS (SELECT symbol, day, {N} AS n, {SUMS['rrvar']} AS rv, {SUMS[iv]} AS iv, {SUMS[iq]} AS iq FROM l GROUP BY symbol, day), z AS (SELECT *, {z} AS z FROM m) SELECT symbol, day, {rnd('z', 'ztest')}, {rnd(_two_sided('z'), 'pvalue')}, round(CAST({normal_quantile(0.975)!r} AS DOUBLE), 6) AS critical_value, {rnd('iv', 'iv')}, {rnd('iq', 'iq')} FROM z"


add("bns_linear", on_ticks(jumps.bns), _bns_oracle("rbpvar", "rtpquar", THETA["BV"]))
add("bns_ratio", on_ticks(lambda t: jumps.bns(t, test_type="ratio")), _bns_oracle("rbpvar", "rtpquar", THETA["BV"], True))
add("bns_med", on_ticks(lambda t: jumps.bns(t, "rMedRVar", "rMedRQuar")), _bns_oracle("rmedrvar", "rmedrquar", THETA["rMedRVar"]))
add("bns_min", on_ticks(lambda t: jumps.bns(t, "rMinRVar", "rMinRQuar")), _bns_oracle("rminrvar", "rminrquar", THETA["rMinRVar"]))
add("bns_rv", on_ticks(lambda t: jumps.bns(t, "RV", "rQuar")), _bns_oracle("rrvar", "rquar", THETA["RV"]))
add("bns_linear_log", on_ticks(lambda t: jumps.bns(t, log_transform=True)), f"WITH {LAGGED} SELECT symbol, day, 0.0::DOUBLE AS ztest, 1.0::DOUBLE AS pvalue, round(CAST({normal_quantile(0.975)!r} AS DOUBLE), 6) AS critical_value, {rnd(SUMS['rbpvar'], 'iv')}, {rnd(SUMS['rtpquar'], 'iq')} FROM l GROUP BY symbol, day")
_AJC, _AJS = mu_p(4) / mu_p(2) ** 2, mu_p(4) ** 2 / mu_p(2) ** 4 - 1
add("ajjump", on_ticks(jumps.aj), f"WITH {RETURNS}, m AS (SELECT symbol, day, {N} AS n, coalesce(sum(pow(abs(r), 4)), 0) AS a, coalesce(sum(pow(abs(r), 2)), 0) AS b FROM r GROUP BY symbol, day), z AS (SELECT *, CASE WHEN b > 1e-15 THEN a / (b * b) END AS ratio, CASE WHEN b > 1e-15 THEN (a / (b * b) - {_AJC!r}) / sqrt({_AJS!r} / n) ELSE 0 END AS z FROM m) SELECT symbol, day, {rnd('z', 'ztest')}, {rnd(_two_sided('z'), 'pvalue')}, round(CAST({normal_quantile(0.975)!r} AS DOUBLE), 6) AS critical_value, {rnd('ratio', 'ratio')} FROM z")
add("ivinference", on_ticks(inference.iv_inference), f"WITH {LAGGED}, m AS (SELECT symbol, day, {N} AS n, {SUMS['rrvar']} AS iv, {SUMS['rtpquar']} AS iq FROM l GROUP BY symbol, day), s AS (SELECT *, CASE WHEN iq > 0 AND n > 0 THEN sqrt(2 * iq / n) ELSE 0 END AS se FROM m) SELECT symbol, day, {rnd('iv', 'iv')}, {rnd('iq', 'iq')}, {rnd('se', 'se')}, {rnd(f'greatest(0, iv - {normal_quantile(0.975)!r} * se)', 'lower')}, {rnd(f'iv + {normal_quantile(0.975)!r} * se', 'upper')} FROM s")
_SPOT = f"{RETURNS}, q AS (SELECT symbol, day, ts, seq, r FROM r WHERE r IS NOT NULL), s AS (SELECT *, row_number() OVER {W} - 1 AS idx FROM q)"
_LOCAL = lambda source, keys, order: f"""b AS (SELECT *, abs(r) * abs(lag(r) OVER (PARTITION BY {keys} ORDER BY {order})) AS b, count(*) OVER (PARTITION BY {keys}) AS n FROM {source}),
u AS (SELECT *, sqrt({PI / 2!r} * coalesce(avg(b) OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN 39 PRECEDING AND 39 FOLLOWING), 0) * n + 1e-15) AS sigma, CASE WHEN n > 1 THEN sqrt(2 * ln(n::DOUBLE)) END AS cn FROM b),
v AS (SELECT *, abs(r) / sigma AS stat, cn / (cn / sqrt(2 * ln(cn))) + {normal_quantile(0.999)!r} / (cn / sqrt(2 * ln(cn))) AS cv FROM u),
jj AS (SELECT *, coalesce(stat > cv AND idx > 0, FALSE) AS jump FROM v)"""  # noqa: E731
add("intraday_jump", on_ticks(jumps.intraday), f"WITH {_SPOT}, {_LOCAL('s', 'symbol, day', 'ts, seq')} SELECT symbol, day, CAST(idx AS INTEGER) AS idx, {rnd('r', 'r')}, {rnd('sigma', 'sigma')}, {rnd('stat', 'stat')}, {rnd('cv', 'critical_value')}, jump, {rnd('CASE WHEN jump THEN r ELSE 0 END', 'jump_size')} FROM jj")
#: The co-jump queries use a level at which the test data has jumps, as the coded test is very conservative.
LEVEL = 0.05
_COJ = PANEL + ", pp AS (SELECT day, symbol, r, idx - 1 AS idx FROM p), " + _LOCAL("pp", "symbol, day", "idx").replace(repr(normal_quantile(0.999)), repr(normal_quantile(LEVEL)))
add("cojumps", on_panel(lambda p: jumps.cojumps(p, alpha=LEVEL)), f"WITH {_COJ} SELECT day, CAST(sum(CASE WHEN k >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_cojumps FROM (SELECT day, idx, sum(CAST(jump AS INTEGER)) AS k FROM jj GROUP BY day, idx) GROUP BY day")
add("cojump_places", on_panel(lambda p: jumps.cojump_places(p, alpha=LEVEL)), f"WITH {_COJ} SELECT day, CAST(idx AS INTEGER) AS idx, CAST(sum(CAST(jump AS INTEGER)) AS BIGINT) AS n_jumps, sum(CAST(jump AS INTEGER)) >= 2 AS cojump FROM jj GROUP BY day, idx")
_RK = lambda c: f"rank() OVER (PARTITION BY {PAIR} ORDER BY {c}) + (count(*) OVER (PARTITION BY {PAIR}, {c}) - 1) / 2.0::DOUBLE"
add("rank_jump", on_panel(lambda p: jumps.rank_correlation(p, alpha=LEVEL)), f"""WITH {_COJ}, js AS (SELECT day, idx, symbol, CASE WHEN jump THEN r ELSE 0 END AS v FROM jj), jp AS (SELECT i.day, i.idx, i.symbol AS sym_i, j.symbol AS sym_j, i.v AS vi, j.v AS vj FROM js i JOIN js j ON i.day = j.day AND i.idx = j.idx AND i.symbol < j.symbol),
hit AS (SELECT {PAIR}, {_RK('vi')} AS ri, {_RK('vj')} AS rj FROM jp WHERE vi <> 0 OR vj <> 0), co AS (SELECT {PAIR}, count(*) AS n, corr(ri, rj) AS rho FROM hit GROUP BY {PAIR}),
al AS (SELECT DISTINCT {PAIR} FROM jp), ot AS (SELECT al.day, al.sym_i, al.sym_j, coalesce(n, 0) AS n, CASE WHEN n > 5 AND NOT isnan(rho) THEN rho END AS rho FROM al LEFT JOIN co USING ({PAIR}))
SELECT {PAIR}, n, {rnd('rho', 'rho')}, {rnd('rho * sqrt(CASE WHEN (1 - rho) * (1 + rho) <> 0 THEN (n - 2) / ((1 - rho) * (1 + rho)) END)', 'tstat')} FROM ot""")


def _rank_pvalues(p: DataFrame) -> DataFrame:
    @F.pandas_udf("double")
    def pvalue(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided(a, b - 2) if a == a and a is not None else None for a, b in zip(t, n)], dtype="float64")

    return jumps.rank_correlation(p, alpha=LEVEL).withColumn("pvalue", pvalue("tstat", "n"))


add("rank_jump_pvalue", on_panel(_rank_pvalues))
add("spotvol", on_ticks(spot.spot_vol), f"WITH {_SPOT} SELECT symbol, day, CAST(idx AS INTEGER) AS idx, {rnd(f'sqrt(sum(r * r) OVER (PARTITION BY symbol, day ORDER BY ts, seq ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING))', 'spotvol')} FROM s")
add("spotdrift", on_ticks(spot.spot_drift), f"WITH {_SPOT} SELECT symbol, day, CAST(idx AS INTEGER) AS idx, {rnd(f'avg(r) OVER (PARTITION BY symbol, day ORDER BY ts, seq ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)', 'spotdrift')} FROM s")
_DB = f"{_SPOT}, f AS (SELECT symbol, day, idx, sqrt(avg(r * r) OVER (PARTITION BY symbol, day ORDER BY ts, seq ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)) AS vol, avg(r) OVER d * sqrt(count(*) OVER d) AS top FROM s WINDOW d AS (PARTITION BY symbol, day ORDER BY ts, seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)), g AS (SELECT symbol, day, idx, CASE WHEN vol > 1e-10 THEN top / vol END AS z FROM f)"
add("driftburst_stats", on_ticks(spot.drift_statistics), f"WITH {_DB} SELECT symbol, day, CAST(idx AS INTEGER) AS idx, {rnd('z', 'tstat')} FROM g")
add("driftbursts", on_ticks(spot.drift_bursts), f"WITH {_DB} SELECT symbol, day, CAST(sum(CASE WHEN abs(z) > {normal_quantile(0.99)!r} THEN 1 ELSE 0 END) AS BIGINT) AS n_bursts, {rnd('max(abs(z))', 'max_tstat')} FROM g GROUP BY symbol, day")

# --- liquidity --------------------------------------------------------------------------------------------


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda df: df.withColumn("day", F.to_date("ts").cast("string"))
    return liquidity.asof_quotes(day(tables.trades(spark, sf_dir)), day(tables.quotes(spark, sf_dir)))


_ASOF = """q AS (SELECT ts, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, value * 0.99::DOUBLE AS bid, value * 1.01::DOUBLE AS ask FROM events WHERE event_type = 'view' AND value > 0 QUALIFY row_number() OVER (PARTITION BY ts ORDER BY event_id DESC) = 1),
tr AS (SELECT ts, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_id AS seq, value AS price FROM events WHERE event_type = 'purchase' AND value > 0),
m AS (SELECT tr.day, tr.ts, tr.seq, tr.price, q.bid, q.ask FROM tr ASOF LEFT JOIN q ON tr.day = q.day AND tr.ts >= q.ts)"""
add("quote_asof", lambda s, d: _matched(s, d).drop("ts"), f"WITH {_ASOF} SELECT day, seq, {rnd('price', 'price')}, {rnd('bid', 'bid')}, {rnd('ask', 'ask')} FROM m")
_DIR = f"""{_ASOF}, k AS (SELECT *, lag(price) OVER (PARTITION BY day ORDER BY ts, seq) AS before FROM m WHERE bid IS NOT NULL),
o AS (SELECT *, CASE WHEN price > (bid + ask) / 2 THEN 1 WHEN price < (bid + ask) / 2 THEN -1 WHEN before IS NULL THEN 0 WHEN price > before THEN 1 WHEN price < before THEN -1 END AS own FROM k),
di AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY day ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS direction FROM o)"""
_directed = lambda s, d: liquidity.trade_direction(_matched(s, d).filter("bid IS NOT NULL"))
add("trade_direction_rows", lambda s, d: _directed(s, d).select("day", "seq", "direction"), f"WITH {_DIR} SELECT day, seq, direction FROM di")
add("trade_direction", lambda s, d: liquidity.direction_summary(_directed(s, d)), f"WITH {_DIR}, c AS (SELECT day, CAST(count(*) FILTER (direction = 1) AS BIGINT) AS n_buys, CAST(count(*) FILTER (direction = -1) AS BIGINT) AS n_sells, CAST(count(*) FILTER (direction = 0) AS BIGINT) AS n_unknown, count(*) AS n FROM di GROUP BY day) SELECT day, n_buys, n_sells, n_unknown, {rnd('CASE WHEN n_buys + n_sells > 0 THEN (n_buys - n_sells)::DOUBLE / (n_buys + n_sells) ELSE 0 END', 'order_imbalance')}, {rnd('n_buys::DOUBLE / n', 'buy_ratio')} FROM c")


def _lineitem_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_extendedprice")
    return tables.read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", (x * (1 - F.col("l_discount"))).alias("bid"), (x * (1 + F.col("l_tax"))).alias("ask"), x.alias("price"))


_LIQ = "l_returnflag, l_linestatus"
add("liquidity", lambda s, d: liquidity.liquidity_measures(_lineitem_quotes(s, d), ("l_returnflag", "l_linestatus"), "price"), f"""WITH q AS (SELECT {_LIQ}, l_extendedprice * (1 - l_discount) AS bid, l_extendedprice * (1 + l_tax) AS ask, l_extendedprice AS price FROM lineitem),
m AS (SELECT *, (bid + ask) / 2 AS mid, ask - bid AS sp, CASE WHEN (bid + ask) / 2 > 0 THEN (ask - bid) / ((bid + ask) / 2) ELSE 0 END AS pct FROM q)
SELECT {_LIQ}, {rnd('avg(sp)', 'quoted_spread_abs')}, {rnd('avg(pct)', 'quoted_spread_pct')}, {rnd('stddev_pop(sp)', 'quoted_spread_abs_std')}, {rnd('stddev_pop(pct)', 'quoted_spread_pct_std')}, {rnd('avg(mid)', 'mid_price_mean')}, {rnd('stddev_pop(mid)', 'mid_price_std')},
{rnd('avg(2 * abs(price - mid))', 'effective_spread_abs')}, {rnd('avg(CASE WHEN mid <> 0 THEN 2 * abs(price - mid) / mid END)', 'effective_spread_pct')} FROM m GROUP BY {_LIQ}""")

# --- models -----------------------------------------------------------------------------------------------

DAILY = f"""t AS (SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, 'orders' AS symbol, o_orderdate AS ts, o_orderkey AS seq, o_totalprice AS price FROM orders WHERE o_totalprice > 0),
r AS (SELECT *, ln(price / lag(price) OVER w) AS r FROM t WINDOW w AS {W}), l AS (SELECT *, abs(r) AS a, abs(lag(r, 1) OVER w) AS a1, abs(lag(r, 2) OVER w) AS a2 FROM r WINDOW w AS {W}),
dm AS (SELECT symbol, day, sum(r) AS ret, {SUMS['rrvar']} AS rv, {SUMS['rbpvar']} AS bpv, {SUMS['rtpquar']} AS tq FROM l GROUP BY symbol, day HAVING {N} >= 3)"""
add("daily_measures", on_daily(lambda d: d), f"WITH {DAILY} SELECT symbol, day, {rnd('ret', 'ret')}, {rnd('rv', 'rv')}, {rnd('bpv', 'bpv')}, {rnd('tq', 'tq')} FROM dm")


def _har_oracle(source: str, extra: str) -> str:
    avg = lambda k: f"avg({source}) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"WITH {DAILY}, h AS (SELECT symbol, day, rv AS y, {avg(1)} AS daily, {avg(5)} AS weekly, {avg(22)} AS monthly, bpv, tq, rv, row_number() OVER (PARTITION BY symbol ORDER BY day) AS k FROM dm) SELECT symbol, day, {rnd('y', 'y')}, {rnd('daily', 'daily')}, {rnd('weekly', 'weekly')}, {rnd('monthly', 'monthly')}, {rnd(extra, 'extra')} FROM h WHERE k > 22"


def _har_values_oracle(source: str, extra: str, k: int) -> str:
    """Least squares by Gram-Schmidt: each regressor without its part along the ones before it, then y's parts
    along them. A regressor that the others span gives nothing."""
    cols = ["daily", "weekly", "monthly", "extra"][:k]
    avg = lambda n: f"avg({source}) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    out = f"WITH {DAILY}, h AS (SELECT symbol, day, rv AS y, {avg(1)} AS daily, {avg(5)} AS weekly, {avg(22)} AS monthly, bpv, tq, rv, row_number() OVER (PARTITION BY symbol ORDER BY day) AS k FROM dm), "
    centred = ", ".join(f"{c} - avg({c}) OVER () AS {c}" for c in ("y", *cols))
    out += f"x AS (SELECT *, {extra} AS extra FROM h WHERE k > 22), e0 AS (SELECT symbol, day, y AS y0, {centred} FROM x)"
    for i, c in enumerate(cols):
        part = lambda v, c=c: f"{v} - {c} * CASE WHEN sum({c} * {c}) OVER () > 1e-18 THEN sum({v} * {c}) OVER () / sum({c} * {c}) OVER () ELSE 0 END AS {v}"
        out += f", e{i + 1} AS (SELECT symbol, day, y0, {', '.join(part(v) for v in ('y', *cols[i + 1 :]))} FROM e{i})"
    return f"{out} SELECT symbol, day, {rnd('y0', 'y')}, {rnd('y0 - y', 'fitted')}, {rnd('CASE WHEN abs(y) < 5e-7 THEN 0 ELSE y END', 'residual')} FROM e{k}"


_EXTRA = {None: "CAST(NULL AS DOUBLE)", "jump": "greatest(rv - bpv, 0)", "rq_interaction": "daily * sqrt(tq)"}
for _h, (_source, _extra) in models.HAR_MODELS.items():
    add(f"{_h.lower()}_design", on_daily(lambda d, m=_h: models.har_design(d, m)), _har_oracle(_source, _EXTRA[_extra]))
    add(_h.lower(), on_daily(lambda d, m=_h: models.fit_har(d, m)))
    add(f"{_h.lower()}_values", on_daily(lambda d, m=_h: models.har_values(d, m)), _har_values_oracle(_source, _EXTRA[_extra], 4 if _extra else 3))
add("har_lagged", on_daily(lambda d: models.fit_har(d, "HAR", "literature")))
_ABD = mu_p(1) ** -4 + 2 * mu_p(1) ** -2 - 5
add("abd_jump", on_daily(models.abd_statistic), f"WITH {DAILY} SELECT symbol, day, {rnd(f'CASE WHEN rv > 1e-30 THEN sqrt(count(*) OVER (PARTITION BY symbol)) * (rv - bpv) / rv / sqrt({_ABD!r} * greatest(1, CASE WHEN bpv * bpv > 1e-30 THEN tq / (bpv * bpv) ELSE 1 END)) ELSE 0 END', 'z_abd')} FROM dm")
add("heavy_filter", on_daily(lambda d: models.heavy_filter(d, "rv", 0.1, 0.3, 0.6)), f"""WITH RECURSIVE {DAILY}, x AS (SELECT symbol, day, rv AS x, row_number() OVER (PARTITION BY symbol ORDER BY day) AS k, avg(rv) OVER (PARTITION BY symbol) AS m FROM dm),
h AS (SELECT symbol, day, x, k, m AS h FROM x WHERE k = 1 UNION ALL SELECT x.symbol, x.day, x.x, x.k, greatest(1e-30, 0.1::DOUBLE + 0.3::DOUBLE * h.x + 0.6::DOUBLE * h.h) FROM h JOIN x ON x.symbol = h.symbol AND x.k = h.k + 1)
SELECT symbol, day, {rnd('h', 'h')} FROM h""")
add("heavy_fit", on_daily(models.fit_heavy))
add("heavy_paths", on_daily(models.heavy_paths))

# --- streaming --------------------------------------------------------------------------------------------


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of one trigger; the latest update of a group is its result."""
    schema = tables.read(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    name = f"realized_stream_{abs(hash(sf_dir)) % 10**8}"
    ticks = tables.as_ticks(source, "event_type", "ts", "event_id", "value")
    run = incremental(ticks).writeStream.outputMode("update").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.table(name)
    return rows.groupBy("symbol", "day").agg(F.max(F.struct("n", "rrvar", "rbpvar")).alias("s")).select("symbol", "day", "s.n", "s.rrvar", "s.rbpvar")


add("streaming_realized", _streamed, _group_oracle("rrvar", "rbpvar"))
