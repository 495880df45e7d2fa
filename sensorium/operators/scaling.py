"""Scalers, log transform and imputation: parameters are aggregates over training rows, applied as expressions.

NULLs are ignored when fitting and stay NULL when transforming. A scale of 0 counts as 1.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quantiles

QUANTILES = 5000


@dataclass(frozen=True)
class Scaler:
    """A fitted scaler of one column: (x - center) / scale, or by knots or power."""

    kind: str
    center: float = 0.0
    scale: float = 1.0
    lam: float = 1.0
    knots: tuple[float, ...] = ()

    def apply(self, x: Column, knots: Column | None = None) -> Column:
        """knots: a column that holds them, so that they needn't be in the plan."""
        if self.kind in ("none", "standard", "robust", "minmax", "maxabs"):
            return (x - self.center) / self.scale
        if self.kind.startswith("quantile"):
            rank = _rank(x, self.knots, self.literal() if knots is None else knots)
            return F.when(x.isNotNull(), _normal(rank) if self.kind.endswith("normal") else rank)
        return (_power(x, self.lam, self.kind.startswith("yeo")) - self.center) / self.scale

    def literal(self) -> Column:
        return F.array(*[F.lit(k) for k in self.knots])

    def invert(self, z: Column, knots: Column | None = None) -> Column:
        if self.kind in ("none", "standard", "robust", "minmax", "maxabs"):
            return z * self.scale + self.center
        if self.kind.startswith("quantile"):
            if self.kind.endswith("normal"):
                z = _share(z)
            ks = self.literal() if knots is None else knots
            at = F.greatest(F.lit(0.0), F.least(z, F.lit(1.0))) * (len(self.knots) - 1)
            low = F.least(F.floor(at), F.lit(len(self.knots) - 2)).cast("int")
            a, b = F.get(ks, low), F.get(ks, low + 1)
            return a + (b - a) * (at - low)
        return _unpower(z * self.scale + self.center, self.lam, self.kind.startswith("yeo"))


def _count(x: Column, ks: Column, n: int, equal: bool) -> Column:
    """How many of n ascending knots are below x (or equal), by halves."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    less = lambda k: (k <= x) if equal else (k < x)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & less(F.get(ks, at + step - 1)), at + step).otherwise(at))


def _rank(x: Column, knots: tuple[float, ...], ks: Column) -> Column:
    """Place of x among the knots as a share, by interpolation; ties take the middle of their places."""
    n = len(knots) - 1
    below, upto = _count(x, ks, n + 1, False), _count(x, ks, n + 1, True)
    a, b = F.get(ks, below - 1), F.get(ks, below)
    inner = (below - 1 + (x - a) / F.nullif(b - a, F.lit(0.0))) / n
    return F.when(x <= knots[0], 0.0).when(x >= knots[-1], 1.0).when(upto > below, (below + upto - 1) / (2.0 * n)).otherwise(inner)


def _share(z: Column) -> Column:
    """The share whose normal quantile is z: the inverse of _normal, by halving an interval."""
    start = F.struct(F.lit(1e-7).alias("lo"), F.lit(1 - 1e-7).alias("hi"))

    def half(x: Column, _: Column) -> Column:
        mid = (x.lo + x.hi) / 2
        return F.when(_normal(mid) < z, F.struct(mid.alias("lo"), x.hi.alias("hi"))).otherwise(F.struct(x.lo.alias("lo"), mid.alias("hi")))

    return F.when(z.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(50)), start, half, lambda x: (x.lo + x.hi) / 2))


def _normal(rank: Column) -> Column:
    """The normal quantile of a share by Acklam's rational approximation (relative error 1.2e-9)."""
    #: Fixed public values: the approximation's coefficients.
    a = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
    b = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]

    def poly(cs: list[float], x: Column) -> Column:
        out = F.lit(cs[0])
        for k in cs[1:]:
            out = out * x + k
        return out

    p = F.greatest(F.lit(1e-7), F.least(rank, F.lit(1 - 1e-7)))
    q = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = poly(c, q) / poly([*d, 1.0], q)
    m = p - 0.5
    mid = m * poly(a, m * m) / poly([*b, 1.0], m * m)
    return F.when(p < 0.02425, tail).when(p > 1 - 0.02425, -tail).otherwise(mid)


def _power(x: Column, lam: float, yeo: bool) -> Column:
    if not yeo:
        return F.log(x) if abs(lam) < 1e-9 else (F.pow(x, F.lit(lam)) - 1) / lam
    up = F.log1p(x) if abs(lam) < 1e-9 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def _unpower(z: Column, lam: float, yeo: bool) -> Column:
    if not yeo:
        return F.exp(z) if abs(lam) < 1e-9 else F.pow(z * lam + 1, F.lit(1 / lam))
    up = F.expm1(z) if abs(lam) < 1e-9 else F.pow(z * lam + 1, F.lit(1 / lam)) - 1
    down = 1 - F.exp(-z) if abs(lam - 2) < 1e-9 else 1 - F.pow(1 - (2 - lam) * z, F.lit(1 / (2 - lam)))
    return F.when(z >= 0, up).otherwise(down)


def _best_power(train: DataFrame, col: str, yeo: bool) -> float:
    """The exponent of greatest likelihood: golden sections, a pass of several candidates in one aggregate each."""
    lo, hi = -4.0, 6.0
    x = F.col(col)
    jac = F.signum(x) * F.log1p(F.abs(x)) if yeo else F.log(x)
    for _ in range(5):
        grid = [lo + (hi - lo) * k / 10 for k in range(11)]
        got = train.agg(F.count(x).alias("n"), F.sum(jac).alias("j"), *[F.var_pop(_power(x, g, yeo)).alias(f"v{k}") for k, g in enumerate(grid)]).first()
        likely = [(-got.n / 2 * math.log(got[f"v{k}"]) + (g - 1) * got.j, g) for k, g in enumerate(grid) if got[f"v{k}"] and got[f"v{k}"] > 0]
        if not likely:
            return 1.0
        best = max(likely)[1]
        step = (hi - lo) / 10
        lo, hi = best - step, best + step
    return (lo + hi) / 2


LINEAR = ("standard", "robust", "minmax", "maxabs")


def fit(train: DataFrame, kinds: dict[str, str]) -> dict[str, Scaler]:
    """Scalers by column, fitted on train. All linear ones come from a single aggregate, and all quantiles that any
    column wants (exact and interpolated) from one selection by ranges of values.

    Kinds: none, standard, robust, minmax, maxabs, quantile_uniform, quantile_normal, yeo-johnson, yeo-johnson_std,
    box-cox, box-cox_std.
    """
    aggs = []
    for k, (c, kind) in enumerate(kinds.items()):
        x = F.col(c).cast("double")
        if kind == "standard":
            aggs += [F.avg(x).alias(f"a{k}"), F.stddev_pop(x).alias(f"b{k}")]
        elif kind == "minmax":
            aggs += [F.min(x).alias(f"a{k}"), (F.max(x) - F.min(x)).alias(f"b{k}")]
        elif kind == "maxabs":
            aggs += [F.lit(0.0).alias(f"a{k}"), F.max(F.abs(x)).alias(f"b{k}")]
        elif kind.startswith("quantile"):
            aggs += [F.count(F.nanvl(x, F.lit(None).cast("double"))).alias(f"a{k}")]
    got = train.agg(*aggs).first() if aggs else None
    knots = {c: max(2, min(QUANTILES, got[f"a{k}"])) for k, (c, kind) in enumerate(kinds.items()) if kind.startswith("quantile")}
    shares = {c: [i / (n - 1) for i in range(n)] for c, n in knots.items()}
    found = quantiles.of_columns(train, shares | {c: [0.25, 0.5, 0.75] for c, kind in kinds.items() if kind == "robust"})
    out = {}
    for k, (c, kind) in enumerate(kinds.items()):
        if kind == "none":
            out[c] = Scaler(kind)
        elif kind == "robust":
            q = found.get(c, {0.25: 0.0, 0.5: 0.0, 0.75: 0.0})
            out[c] = Scaler(kind, q[0.5], q[0.75] - q[0.25] or 1.0)
        elif kind in LINEAR:
            out[c] = Scaler(kind, got[f"a{k}"] or 0.0, got[f"b{k}"] or 1.0)
        elif kind.startswith("quantile"):
            out[c] = Scaler(kind, knots=tuple(found[c][p] for p in shares[c]) if c in found else (0.0, 1.0))
        elif kind.startswith(("yeo-johnson", "box-cox")):
            yeo = kind.startswith("yeo")
            lam = _best_power(train, c, yeo)
            m, s = (train.agg(F.avg(p := _power(F.col(c).cast("double"), lam, yeo)), F.stddev_pop(p)).first()) if kind.endswith("_std") else (0.0, 1.0)
            out[c] = Scaler(kind, m or 0.0, s or 1.0, lam)
        else:
            raise ValueError(f"unknown scaler {kind}")
    return out


def masked(df: DataFrame, masks: dict[str, str]) -> DataFrame:
    """df with the columns NULL where their mask is 0, false or NULL."""
    return df.withColumns({c: F.when(F.col(m).cast("double") > 0, F.col(c)) for c, m in masks.items()})


def fit_targets(train: DataFrame, targets: list[str], kind: str = "robust", per_horizon: bool = False, masks: list[str] | None = None) -> dict[str, Scaler]:
    """Scalers of the targets of several horizons, fitted on values whose mask (one for each target) holds.

    One for each horizon, all from the same pass; or else one for all, fitted on the values of all horizons together.
    Raises ValueError if there are no values to fit on (of some horizon).
    """
    if kind == "none":
        return {c: Scaler(kind) for c in targets}
    rows = masked(train.select(*dict.fromkeys([*targets, *(masks or ())])), dict(zip(targets, masks, strict=True))) if masks else train
    counts = rows.agg(*[F.count(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(c) for c in targets]).first()
    if not all(counts) if per_horizon else not any(counts):
        raise ValueError(f"no valid values to fit a scaler of {', '.join(c for c in targets if not counts[c])}")
    if per_horizon:
        return fit(rows.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in targets]), dict.fromkeys(targets, kind))
    one = fit(quantiles.long(rows, targets).select("value"), {"value": kind})["value"]
    return dict.fromkeys(targets, one)


def invert_predictions(rows: DataFrame, scalers: dict[str, Scaler], cols: list[str], horizon: str = "horizon", prefix: str = "target_h_") -> DataFrame:
    """Rows of predictions by horizon with the columns on their own scale again, each by the scaler of its horizon.
    Horizons without a scaler make the job fail."""
    at = F.col(horizon).cast("int")
    lost = F.raise_error(F.concat(F.lit("no scaler for horizon "), at.cast("string"))).cast("double")

    def back(c: str) -> Column:
        out = lost
        for name, s in scalers.items():
            out = F.when(at == int(name.removeprefix(prefix)), s.invert(F.col(c))).otherwise(out)
        return F.when(F.col(c).isNotNull(), out)

    return rows.withColumns({c: back(c) for c in cols})


def transform(df: DataFrame, scalers: dict[str, Scaler], inverse: bool = False) -> DataFrame:
    """All columns in one projection. Knots of quantile scalers come from a frame of one row, not from the plan."""
    columns, held = df.columns, {c: f"__knots{k}" for k, (c, s) in enumerate(scalers.items()) if s.knots}
    if held:
        one = df.sparkSession.createDataFrame([tuple(list(scalers[c].knots) for c in held)], ", ".join(f"{n} array<double>" for n in held.values()))
        df = df.crossJoin(F.broadcast(one))
    knots = {c: F.col(n) for c, n in held.items()}
    return df.select(*[(s.invert(F.col(c), knots.get(c)) if inverse else s.apply(F.col(c), knots.get(c))).alias(c) if (s := scalers.get(c)) else F.col(c) for c in columns])


def scaler_map(cols: list[str], default: str, rules: dict[str, str], skip: list[str] = ()) -> dict[str, str]:
    """The kind of each column: of the first rule whose text its name has, else the default; none for skipped ones."""
    return {c: "none" if any(s in c for s in skip) else next((k for part, k in rules.items() if part in c), default) for c in cols}


def log1p(df: DataFrame, parts: list[str] = ("_std",)) -> DataFrame:
    """log(1 + x) of the columns whose name has a part, negative values counting as 0."""
    cols = [c for c in df.columns if any(p in c for p in parts)]
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.log1p(F.greatest(F.col(c), F.lit(0.0)))) for c in cols})


def impute_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0)) for c in cols})


def statistics(df: DataFrame, cols: list[str]) -> DataFrame:
    """column, min, max, mean, std (population), missing of each column: one pass, then unpivoted."""
    parts = [F.struct(F.lit(c).alias("column"), F.min(x := F.col(c).cast("double")).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.avg(x.isNull().cast("double")).alias("missing")) for c in cols]
    return df.agg(F.array(*parts).alias("x")).select(F.inline("x"))
