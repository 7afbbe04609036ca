"""Scalar functions as column expressions; nulls give nulls unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Industry code ranges, lower bound included, upper not.
SIC_SECTORS = (
    (100, 1000, "Agriculture, Forestry & Fishing"),
    (1000, 1500, "Mining"),
    (1500, 1800, "Construction"),
    (2000, 4000, "Manufacturing"),
    (4000, 5000, "Transportation & Utilities"),
    (5000, 5200, "Wholesale Trade"),
    (5200, 6000, "Retail Trade"),
    (6000, 6800, "Finance, Insurance & Real Estate"),
    (7000, 9000, "Services"),
    (9100, 9730, "Public Administration"),
)
# Leveraged funds and what they hold.
UNDERLYING = {"AAPB": "AAPL", "AAPU": "AAPL", "FBL": "META"}


def sic_sector(code: Column) -> Column:
    """Sector of a code, 'Other' outside the ranges, null for null or no number."""
    n = code.try_cast("int")
    out = F.when(n.isNull(), F.lit(None))
    for low, high, name in SIC_SECTORS:
        out = out.when((n >= low) & (n < high), name)
    return out.otherwise("Other")


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def clip(x: Column, low, high) -> Column:
    """x within [low, high]; greatest and least alone would make a bound of a null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(x, F.lit(high))))


def half_life_score(days: Column, most: float) -> Column:
    """1 at a day or less, 0 at ``most`` or more, logarithmic between; 0 for null or no number, or most <= 1."""
    if most <= 1:
        return F.lit(0.0)
    ramp = 1 - F.log(F.greatest(days, F.lit(1.0))) / F.log(F.lit(float(most)))
    return F.coalesce(F.when(finite(days).isNotNull(), clip(ramp, 0.0, 1.0)), F.lit(0.0))


def coint_score(p: Column, ceiling: float = 0.20) -> Column:
    return F.greatest(F.lit(0.0), 1 - p / ceiling)


def composite_score(corr_long: Column, corr_short: Column, z_depth: Column, w_long: float = 0.3, w_short: float = 0.3, w_depth: float = 0.4) -> Column:
    """Weighted sum of components clipped to [0, 1]; a missing one counts 0."""
    part = lambda x: clip(F.coalesce(finite(x), F.lit(0.0)), 0.0, 1.0)
    return w_long * part(corr_long) + w_short * part(corr_short) + w_depth * part(z_depth)


def quality_k(pool_corr: Column, pivot: float, low: float, high: float, max_k: int) -> Column:
    """max_k scaled by the pool's correlation, rounded half to even, 1 at least."""
    return F.greatest(F.lit(1), F.bround(max_k * clip(pool_corr / pivot, low, high), 0).cast("int"))


def z_depth(z: Column, entry: float, exit: float) -> Column:
    """0 at -exit and above, 1 at -entry and below."""
    return clip((-z - exit) / (entry - exit), 0.0, 1.0)


def regime_label(vol: Column, ret: Column) -> Column:
    return F.when(vol >= 0.30, "vol_shock").when((vol < 0.13) & (ret >= 0.0), "calm_bull").when((vol < 0.18) & (ret >= 0.005), "trend_bull").otherwise("sideways")


def forward_bps(z0: Column, s0: Column, s_t: Column, hedge: Column) -> Column:
    """Gross gain of fading the spread, in basis points of the gross notional."""
    return -F.signum(z0) * (s_t - s0) / (1 + F.abs(hedge)) * 1e4


def borrow_bps(hedge: Column, days: Column, annual: float = 0.01) -> Column:
    return annual * (F.abs(hedge) / (1 + F.abs(hedge))) * (days / 252.0) * 1e4


def filing_groups(form: Column, items: Column) -> dict[str, Column]:
    """Event groups of a filing: its form's beginning and items that its list holds."""
    has = lambda *codes: form.startswith("8-K") & _any([F.contains(items, F.lit(c)) for c in codes])
    return {"results": has("2.02"), "deals": has("1.01", "2.01"), "exec_change": has("5.02"), "restatement": has("4.02"), "guidance": has("7.01"), "foreign": form == "6-K"}


def _any(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def instrument_class(symbol: Column, is_etf: Column) -> Column:
    return F.when(F.coalesce(is_etf, F.lit(False)), "etf").when(symbol.rlike(r"\.PR[A-Z]?$|-P[A-Z]?$"), "preferred").otherwise("stock")


def correlation_distance(rho: Column) -> Column:
    return F.coalesce(clip(1 - finite(rho), 0.0, 2.0), F.lit(1.0))


def normalized_ticker(s: Column) -> Column:
    return F.translate(F.upper(s), "./", "--")


def mirror_symbol(s: Column) -> Column:
    return F.concat(F.lit("X"), F.upper(s), F.lit("X"))


# A prime below 2^31 and multipliers of the seeded order.
PRIME, STEPS = 2147483647, (48271, 69621, 16807)


def mixed(seed: int, draw: Column, key: Column) -> Column:
    """A number in [0, PRIME) that orders the rows of each draw differently; plain integer arithmetic, so any engine gives the same."""
    a, b, c = STEPS
    line = F.pmod(F.pmod(key.cast("long"), F.lit(PRIME)) * F.pmod(draw.cast("long") * a + (seed * b + 1), F.lit(PRIME)) + draw.cast("long") * c + seed, F.lit(PRIME))
    square = F.pmod(line * line, F.lit(PRIME))
    return F.pmod(square * b + line, F.lit(PRIME))


def mixed_sql(seed: int, draw: str, key: str) -> str:
    """The same in SQL."""
    a, b, c = STEPS
    line = f"((({key}) % {PRIME}) * ((({draw}) * {a} + {seed * b + 1}) % {PRIME}) + ({draw}) * {c} + {seed}) % {PRIME}"
    return f"((((({line}) * ({line})) % {PRIME}) * {b} + ({line})) % {PRIME})"
