"""Volatility models on daily series (symbol, day, ret, rv, bpv, tq): HAR regressions and HEAVY recursions.

Regressors are windows; a symbol's daily series is thousands of rows, so its fit is one grouped call."""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.constants import mu_p
from tickloom.functions.returns import log_returns
from tickloom.functions.stats import t_two_sided
from tickloom.operators.realized import realized_from_returns

PERIODS = {"daily": 1, "weekly": 5, "monthly": 22}
#: Model -> the series that is averaged, and the extra regressor.
HAR_MODELS = {"HAR": ("rv", None), "HARJ": ("rv", "jump"), "HARCJ": ("rv", "jump"), "HARQ": ("rv", "rq_interaction"), "HARQJ": ("rv", "rq_interaction"), "CHAR": ("bpv", None), "CHARQ": ("bpv", "rq_interaction")}


def daily_measures(ticks: DataFrame, least: int = 4) -> DataFrame:
    """(symbol, day, ret, rv, bpv, tq) of days with ``least`` ticks or more."""
    returns = log_returns(ticks)
    m = realized_from_returns(returns, ["rrvar", "rbpvar", "rtpquar"]).filter(F.col("n") >= least - 1)
    ret = returns.groupBy("symbol", "day").agg(F.sum("r").alias("ret"))
    return m.join(ret, ["symbol", "day"]).select("symbol", "day", "ret", F.col("rrvar").alias("rv"), F.col("rbpvar").alias("bpv"), F.col("rtpquar").alias("tq"))


def har_design(daily: DataFrame, model: str = "HAR", variant: str = "faithful") -> DataFrame:
    """(symbol, day, y, daily, weekly, monthly, extra) from the 23rd day on. As coded, the averages include
    the day that they explain; variant="literature" lags the regressors by a day."""
    if model not in HAR_MODELS:
        raise ValueError(f"unknown model {model!r}; known: {list(HAR_MODELS)}")
    source, extra = HAR_MODELS[model]
    w = Window.partitionBy("symbol").orderBy("day")
    rows = daily.withColumns({k: F.avg(source).over(w.rowsBetween(-(n - 1), 0)) for k, n in PERIODS.items()})
    x: Column = F.lit(None).cast("double")
    if extra == "jump":
        x = F.greatest(F.col("rv") - F.col("bpv"), F.lit(0.0))
    elif extra:
        x = F.col("daily") * F.sqrt("tq")
    rows = rows.withColumn("extra", x).withColumn("_k", F.row_number().over(w))
    if variant == "literature":
        rows = rows.withColumns({c: F.lag(c).over(w) for c in (*PERIODS, "extra")})
    return rows.filter("_k > 22").select("symbol", "day", F.col("rv").alias("y"), *PERIODS, "extra")


def ols(y: np.ndarray, x: np.ndarray) -> dict:
    keep = ~(np.isnan(y) | np.isnan(x).any(1))
    y, x = y[keep], x[keep]
    n, k = x.shape
    if n < k + 1:
        return {"n": n, "beta": np.full(k, np.nan), "se": np.full(k, np.nan), "t": np.full(k, np.nan), "p": np.full(k, np.nan), "r2": np.nan}
    gram = x.T @ x
    try:
        beta = np.linalg.solve(gram, x.T @ y)
    except np.linalg.LinAlgError:
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
    rest = y - x @ beta
    se = np.sqrt(np.maximum(np.diag(rest @ rest / (n - k) * np.linalg.pinv(gram)), 0))
    t = beta / (se + 1e-15)
    about = ((y - y.mean()) ** 2).sum()
    return {"n": n, "beta": beta, "se": se, "t": t, "p": np.array([t_two_sided(v, n - k) for v in t]), "r2": 1 - rest @ rest / about if about > 0 else 0.0}


def har_values(daily: DataFrame, model: str = "HAR", variant: str = "faithful") -> DataFrame:
    """(symbol, day, y, fitted, residual) of the days that the fit uses; null for a symbol of too few days."""
    extra = HAR_MODELS[model][1] if model in HAR_MODELS else None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.column_stack([np.ones(len(pdf)), *[pdf[c].to_numpy(float) for c in (*PERIODS, *(["extra"] if extra else []))]])
        fitted = x @ ols(pdf["y"].to_numpy(float), x)["beta"]
        return pd.DataFrame({"symbol": pdf["symbol"], "day": pdf["day"], "y": pdf["y"], "fitted": fitted, "residual": pdf["y"] - fitted})

    rows = har_design(daily, model, variant)
    rows = rows.dropna(subset=["y", *PERIODS, *(["extra"] if extra else [])])
    return rows.groupBy("symbol").applyInPandas(run, "symbol string, day string, y double, fitted double, residual double")


def fit_har(daily: DataFrame, model: str = "HAR", variant: str = "faithful") -> DataFrame:
    """(symbol, term, coefficient, std_error, t_stat, pvalue, r2, nobs): one row a coefficient."""
    extra = HAR_MODELS[model][1] if model in HAR_MODELS else None
    terms = ["const", *PERIODS, *([extra] if extra else [])]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        x = np.column_stack([np.ones(len(pdf)), *[pdf[c].to_numpy(float) for c in PERIODS], *([pdf["extra"].to_numpy(float)] if extra else [])])
        f = ols(pdf["y"].to_numpy(float), x)
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[0], "term": terms, "coefficient": f["beta"], "std_error": f["se"], "t_stat": f["t"], "pvalue": f["p"], "r2": f["r2"], "nobs": f["n"]})

    return har_design(daily, model, variant).groupBy("symbol").applyInPandas(run, "symbol string, term string, coefficient double, std_error double, t_stat double, pvalue double, r2 double, nobs long")


def abd_statistic(daily: DataFrame) -> DataFrame:
    """The jump statistic that the HAR jump models compute and do not use; n is the symbol's days."""
    scale = mu_p(1) ** -4 + 2 * mu_p(1) ** -2 - 5
    n = F.count("*").over(Window.partitionBy("symbol"))
    b2 = F.col("bpv") * F.col("bpv")
    ratio = F.greatest(F.lit(1.0), F.when(b2 > 1e-30, F.try_divide(F.col("tq"), b2)).otherwise(1.0))
    z = F.sqrt(n) * F.try_divide(F.col("rv") - F.col("bpv"), F.col("rv")) / F.sqrt(F.lit(scale) * ratio)
    return daily.select("symbol", "day", F.when(F.col("rv") > 1e-30, z).otherwise(0.0).alias("z_abd"))


def heavy_filter(daily: DataFrame, source: str, omega: float, alpha: float, beta: float) -> DataFrame:
    """(symbol, day, h): the recursion with given parameters, by an aggregate over the symbol's ordered days."""
    x = F.coalesce(F.pow("ret", 2) if source == "ret2" else F.col(source), F.lit(0.0))
    rows = daily.select("symbol", "day", x.alias("x")).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("day", "x"))).alias("s"), F.avg("x").alias("m"))
    start = F.struct(F.array(F.col("m")).alias("h"), F.col("m").alias("last"))

    def step(acc: Column, p: Column) -> Column:
        new = F.greatest(F.lit(1e-30), F.lit(omega) + F.lit(alpha) * p["x"] + F.lit(beta) * acc["last"])
        return F.struct(F.concat(acc["h"], F.array(new)).alias("h"), new.alias("last"))

    h = F.aggregate(F.slice("s", F.lit(1), F.size("s") - 1), start, step)["h"]
    pairs = F.explode(F.arrays_zip(F.transform("s", lambda p: p["day"]).alias("day"), h.alias("h")))
    return rows.select("symbol", pairs.alias("p")).select("symbol", "p.day", "p.h")


def recursion(par: np.ndarray, x: np.ndarray) -> np.ndarray:
    w, a, b = par
    return np.fromiter(accumulate(x[:-1].tolist(), lambda h, v: max(1e-30, w + a * v + b * h), initial=float(x.mean())), float, len(x))


def log_likelihoods(par: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = recursion(par, x)
    return -0.5 * (math.log(2 * math.pi) + np.log(h) + x / h)


LOWER, UPPER = np.array([1e-10, 0.0, 0.0]), np.array([10.0, 5.0, 0.9999])


def maximise(x: np.ndarray, start: np.ndarray | None = None, multi_start: bool = True) -> tuple[np.ndarray, float]:
    """Quasi-likelihood estimates within bounds: Nelder-Mead on (log w, a, b) from ``start`` (told from the
    series where there is none) and, with ``multi_start``, from three fixed ones, so that reruns agree."""
    if start is None:
        phi = 0.5
        if len(x) > 2 and x[:-1].var() > 0:
            phi = float(np.clip(np.cov(x[:-1], x[1:])[0, 1] / x[:-1].var(), 0, 0.95))
        start = np.array([max(x.mean() * (1 - phi), 1e-8), phi / 2, phi / 2])

    def par_of(u: np.ndarray) -> np.ndarray:
        return np.clip(np.array([math.exp(min(u[0], 2.5)), u[1], u[2]]), LOWER, UPPER)

    def loss(u: np.ndarray) -> float:
        out = np.clip(u[1:], LOWER[1:], UPPER[1:]) - u[1:]
        v = -log_likelihoods(par_of(u), x).sum()
        return (v if math.isfinite(v) else 1e10) + 1e6 * float(out @ out)

    best, least = None, math.inf
    mean = max(float(x.mean()), 1e-8)
    others = (np.array([mean * 0.1, 0.1, 0.8]), np.array([mean * 0.3, 0.3, 0.4]), np.array([mean * 0.05, 0.05, 0.9]))
    for p0 in (start, *(others if multi_start else ())):
        u = nelder_mead(loss, np.array([math.log(max(p0[0], 1e-10)), p0[1], p0[2]]))
        if (v := loss(u)) < least:
            best, least = par_of(u), v
    return best, -least


def nelder_mead(f, x0: np.ndarray, n_iter: int = 400, tol: float = 1e-10) -> np.ndarray:
    pts = [x0, *[x0 + d for d in np.diag([0.5, 0.1, 0.1])]]
    vals = [f(p) for p in pts]
    for _ in range(n_iter):
        order = np.argsort(vals, kind="stable")
        pts, vals = [pts[i] for i in order], [vals[i] for i in order]
        if abs(vals[-1] - vals[0]) <= tol * (abs(vals[0]) + tol):
            break
        mid = np.mean(pts[:-1], axis=0)
        far = mid + (mid - pts[-1])
        vf = f(far)
        if vf < vals[0]:
            wide = mid + 2 * (mid - pts[-1])
            vw = f(wide)
            pts[-1], vals[-1] = (wide, vw) if vw < vf else (far, vf)
        elif vf < vals[-2]:
            pts[-1], vals[-1] = far, vf
        else:
            near = mid + 0.5 * ((far if vf < vals[-1] else pts[-1]) - mid)
            vn = f(near)
            if vn < min(vf, vals[-1]):
                pts[-1], vals[-1] = near, vn
            else:
                pts = [pts[0], *[pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]]
                vals = [vals[0], *[f(p) for p in pts[1:]]]
    return pts[int(np.argmin(vals))]


def sandwich(par: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Robust standard errors; each perturbed parameter costs one recursion for all observations."""
    step = np.maximum(1e-4 * np.abs(par), 1e-7)
    moved = lambda *ks: log_likelihoods(par + sum(s * step[k] * np.eye(3)[k] for k, s in ks), x)
    score = np.column_stack([(moved((k, 1)) - moved((k, -1))) / (2 * step[k]) for k in range(3)])
    n = len(x)
    hess = np.array([[(moved((i, 1), (j, 1)) - moved((i, 1), (j, -1)) - moved((i, -1), (j, 1)) + moved((i, -1), (j, -1))).sum() / (4 * step[i] * step[j]) for j in range(3)] for i in range(3)]) / n
    inverse = np.linalg.pinv(hess)
    return np.sqrt(np.maximum(np.diag(inverse @ (score.T @ score / n) @ inverse / n), 0))


Starts = tuple[float, float, float] | None


def _equations(pdf: pd.DataFrame, variant: str, variance_starting: Starts, rm_starting: Starts):
    """(equation, its driving series, starting values) of the two equations."""
    rv, own = pdf["rv"].to_numpy(float), pdf["ret"].to_numpy(float) ** 2
    return [(name, x, None if start is None else np.array(start, float)) for name, x, start in (("variance", rv if variant == "literature" else own, variance_starting), ("rm", rv, rm_starting)) if len(x) >= 4]


def fit_heavy(daily: DataFrame, variant: str = "faithful", variance_starting: Starts = None, rm_starting: Starts = None, multi_start: bool = True) -> DataFrame:
    """(symbol, equation, param, estimate, std_error, t_stat, pvalue, log_likelihood, nobs). As coded, the
    variance equation is driven by squared returns; variant="literature" drives it by the realized measure."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        out = []
        for equation, x, start in _equations(pdf, variant, variance_starting, rm_starting):
            par, ll = maximise(x, start, multi_start)
            se = sandwich(par, x)
            for name, p, s in zip(("omega", "alpha", "beta"), par, se):
                t = p / (s + 1e-15)
                out.append((pdf["symbol"].iloc[0], equation, name, p, s, t, t_two_sided(t, len(x) - 3), ll, len(x)))
        return pd.DataFrame(out, columns=["symbol", "equation", "param", "estimate", "std_error", "t_stat", "pvalue", "log_likelihood", "nobs"])

    return daily.select("symbol", "day", "ret", "rv").groupBy("symbol").applyInPandas(run, "symbol string, equation string, param string, estimate double, std_error double, t_stat double, pvalue double, log_likelihood double, nobs long")


def heavy_paths(daily: DataFrame, variant: str = "faithful", variance_starting: Starts = None, rm_starting: Starts = None, multi_start: bool = True) -> DataFrame:
    """(symbol, day, conditional_variance, conditional_mean): the recursions at the estimates of fit_heavy;
    symbols of under four days have none."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        h = {name: recursion(maximise(x, start, multi_start)[0], x) for name, x, start in _equations(pdf, variant, variance_starting, rm_starting)}
        if not h:
            pdf, h = pdf.iloc[:0], {"variance": np.zeros(0), "rm": np.zeros(0)}
        return pd.DataFrame({"symbol": pdf["symbol"], "day": pdf["day"], "conditional_variance": h["variance"], "conditional_mean": h["rm"]})

    return daily.select("symbol", "day", "ret", "rv").groupBy("symbol").applyInPandas(run, "symbol string, day string, conditional_variance double, conditional_mean double")
