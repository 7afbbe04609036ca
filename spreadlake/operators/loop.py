"""The daily loop: scoring, selection, execution and indicators. State tables go in and come out as DataFrames.

A day's scoring is one batch job: the book, the last evaluations, the cointegration cache and the cluster cursor go in, the
next ones come out.  Execution carries cash from pair to pair, so it is a fold over the day's pairs, max_k at most.  ``runs`` takes
many runs over many days.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import cointegration as K
from . import gates as G
from . import panel as P


@dataclass(frozen=True)
class Settings:
    lookback: int = 152  # calendar days
    corr_long: int = 90
    corr_short: int = 20
    window: int = 32
    entry: float = 2.0
    exit: float = 0.5
    budget: int = 200  # pairs that are scored in a day
    cooldown: int | None = 5
    penny: float = 5.0
    max_k: int = 20
    pivot: float = 0.7
    scale: tuple[float, float] = (0.25, 1.0)
    weights: tuple[float, float, float] = (0.3, 0.3, 0.4)
    coint_ceiling: float = 0.20
    max_half_life: float = 60.0


@dataclass
class State:
    """What a day hands to the next. book: lead, lag, score, corr_short, z_depth, held. evaluated: lead, lag, date. coint: lead, lag, at, coint_pvalue, halflife_days."""

    book: DataFrame
    evaluated: DataFrame
    coint: DataFrame
    cursor: int = 0


@dataclass
class Day:
    actions: DataFrame  # lead, lag, score, action (buy, sell, hold), exit_reason
    scanned: DataFrame  # the day's new pairs with their components
    penny: DataFrame  # symbol: below the threshold, found on the way
    state: State


def components(prices: DataFrame, pairs: DataFrame, at: str, p: Settings) -> DataFrame:
    """lead, lag, corr_long, corr_short, z, z_depth, score of pairs with common days up to ``at``; z is null without a whole window."""
    day = F.lit(at).cast("date")
    rows = P.align(prices.where(F.col("day").between(F.date_sub(day, p.lookback), day)), pairs.select("lead", "lag"))
    z = P.last_row(P.zscore(rows, p.window), P.PAIR, "day", "z")
    x = z.join(P.dual_correlation(rows, p.corr_long, p.corr_short), [*P.PAIR], "left")
    depth = F.coalesce(S.z_depth(F.col("z"), p.entry, p.exit), F.lit(0.0))
    return x.withColumn("z_depth", depth).withColumn("score", F.round(S.composite_score(F.col("corr_long"), F.col("corr_short"), depth, *p.weights), 9))


def budgeted(pairs: DataFrame, start: int, budget: int) -> DataFrame:
    """Pairs in round-robin order of clusters from ``start``, by correlation within one, as many as the budget allows. pairs: cluster_rank, n_clusters, corr, lead, lag."""
    turn = F.pmod(F.col("cluster_rank") - start, F.col("n_clusters"))
    return pairs.withColumn("turn", turn).orderBy(*_round_robin()).limit(budget)


def _round_robin() -> list[Column]:
    return [F.col("turn"), F.desc(F.round(F.coalesce("corr", F.lit(-1.0)), 9)), F.col("lead"), F.col("lag")]


def select_book(book: DataFrame, candidates: DataFrame, max_k: int, pivot: float, low: float, high: float) -> DataFrame:
    """The day's pairs: K best of different lag symbols, what is held first on equal scores; K follows the pool's correlation.

    book, candidates: lead, lag, score, corr_short, z_depth. Adds k_target.
    """
    pool = book.withColumn("src", F.lit(0)).unionByName(candidates.withColumn("src", F.lit(1)))
    corr = pool.where("z_depth > 0").agg(F.coalesce(F.median("corr_short"), F.lit(0.0)).alias("pool"))  # the book and the day's budget
    k = corr.select(S.quality_k(F.col("pool"), pivot, low, high, max_k).alias("k_target"))
    best = pool.withColumn("n", F.row_number().over(W.partitionBy("lag").orderBy(F.desc("score"), "src", "lead"))).where("n = 1").drop("n")
    top = best.orderBy(F.desc("score"), "src", "lead", "lag").limit(max_k)
    rank = F.row_number().over(W.orderBy(F.desc("score"), "src", "lead", "lag"))  # max_k rows
    return top.withColumn("rank", rank).join(F.broadcast(k), F.col("rank") <= F.col("k_target"))


def candidates(prices: DataFrame, clustered: DataFrame, state: State, at: str, p: Settings) -> tuple[DataFrame, DataFrame]:
    """The pairs that the day's budget reaches, in round-robin order, and the symbols found too cheap on the way.

    clustered: cluster_rank, n_clusters, corr, lead, lag. Pairs with a leg in the book, on cooldown, without prices or below the
    threshold take nothing from the budget.
    """
    day = F.lit(at).cast("date")
    held = state.book.select(F.explode(F.array("lead", "lag")).alias("symbol")).distinct()
    free = G.off_cooldown(G.without_legs(clustered, held), state.evaluated, at, p.cooldown)
    rows = clustered.join(free, [*P.PAIR], "left_semi").withColumn("turn", F.pmod(F.col("cluster_rank") - state.cursor, F.col("n_clusters")))
    last = prices.where(F.col("day").between(F.date_sub(day, p.lookback), day)).groupBy("symbol").agg(F.max_by("close", "day").alias("close"))
    leg = lambda c: last.select(F.col("symbol").alias(c), F.col("close").alias(f"c_{c}"))
    rows = rows.join(leg("lead"), "lead", "left").join(leg("lag"), "lag", "left")
    dear = lambda c: F.coalesce(F.col(f"c_{c}") >= p.penny, F.lit(False))
    good = rows.where(dear("lead") & dear("lag")).orderBy(*_round_robin()).limit(p.budget)
    # Cheap symbols count as found if their pair comes before the last one that the budget reached, or the budget lasted.
    place = F.struct("turn", (-F.round(F.coalesce("corr", F.lit(-1.0)), 9)).alias("c"), "lead", "lag")
    end = good.agg(F.max(place).alias("end"), F.count("*").alias("taken"))
    seen = rows.join(F.broadcast(end), F.col("taken") >= 0).where((F.col("taken") < p.budget) | (place <= F.col("end")))  # one row
    cheap = F.when(F.col("c_lead") < p.penny, F.col("lead")).when(dear("lead") & (F.col("c_lag") < p.penny), F.col("lag"))
    return good.select("cluster_rank", "turn", "corr", "lead", "lag"), seen.select(cheap.alias("symbol")).where("symbol is not null").distinct()


def spread_scores(prices: DataFrame, pairs: DataFrame, cache: DataFrame, at: str, p: Settings) -> tuple[DataFrame, DataFrame]:
    """lead, lag, coint_pvalue, halflife_days, score_coint, score_halflife of the pairs, and the cache with what it lacked: only that is tested."""
    day = F.lit(at).cast("date")
    wanted = pairs.select(*P.PAIR)
    cached = cache.where(F.col("at") == day).join(wanted, [*P.PAIR], "left_semi")
    missing = wanted.join(cached.select(*P.PAIR), [*P.PAIR], "left_anti")
    rows = P.align(prices.where(F.col("day").between(F.date_sub(day, p.lookback), day)), missing)
    tested = K.cointegration(rows, p.coint_ceiling).select(*P.PAIR, "coint_pvalue").join(K.half_life(P.spread(rows)).select(*P.PAIR, F.col("half_life").alias("halflife_days")), [*P.PAIR], "left")
    fresh = tested.withColumn("at", day).select(*cache.columns)
    both = cached.unionByName(fresh)
    scored = both.withColumn("score_coint", S.coint_score(F.col("coint_pvalue"), p.coint_ceiling)).withColumn("score_halflife", S.half_life_score(F.col("halflife_days"), p.max_half_life))
    return scored.drop("at"), cache.unionByName(fresh)


def daily_scoring(prices: DataFrame, clustered: DataFrame, state: State, at: str, p: Settings = Settings(), cointegrated: bool = True) -> Day:
    """Re-scores the book, scores what the budget reaches, and selects: what leaves the K best is displaced, what enters is bought.

    A pair of the book without prices is sold (data_missing), a held one whose spread is back too (zscore_exit); neither
    competes for a place. What is in the target but not held yet is bought.
    """
    book = state.book.select("lead", "lag", "held")
    scored = book.join(components(prices, book, at, p), [*P.PAIR], "left").withColumn("missing", F.col("score").isNull())
    back = F.col("held") & F.coalesce(F.col("z") > -p.exit, F.lit(False))
    scored = scored.withColumn("exit_reason", F.when(F.col("missing"), "data_missing").when(back, "zscore_exit"))
    reached, penny = candidates(prices, clustered, state, at, p)
    found = components(prices, reached, at, p)
    fields = ["lead", "lag", "score", "corr_short", "z_depth"]
    target = select_book(scored.where("exit_reason is null").select(*fields), found.select(*fields), p.max_k, p.pivot, *p.scale)
    chosen = target.select("lead", "lag", F.lit(True).alias("chosen"))
    old = scored.join(chosen, [*P.PAIR], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    reason = F.when(F.col("exit_reason").isNotNull(), F.col("exit_reason")).when(F.col("held") & ~F.col("chosen"), "displaced")
    old = old.withColumn("exit_reason", reason)
    action = F.when(F.col("exit_reason").isNotNull(), "sell").when(F.col("chosen") & ~F.col("held"), "buy").otherwise("hold")
    old = old.select(*fields, F.col("held"), action.alias("action"), "exit_reason")
    new = found.join(chosen, [*P.PAIR], "left_semi").select(*fields, F.lit(False).alias("held"), F.lit("buy").alias("action"), F.lit(None).cast("string").alias("exit_reason"))
    both = old.unionByName(new)
    evaluated = state.evaluated.unionByName(reached.select("lead", "lag", F.lit(at).cast("date").alias("date")))
    scanned, coint = found, state.coint
    if cointegrated:
        spreads, coint = spread_scores(prices, reached, state.coint, at, p)
        scanned = found.join(spreads, [*P.PAIR], "left")
    n = clustered.agg(F.max("n_clusters")).first()[0] or 0
    # Held pairs that are sold leave the book when the sale is executed; an unheld one that lost its prices leaves at once.
    kept = both.where("action <> 'sell' or held").select(*fields, "held")
    return Day(both, scanned, penny, State(kept, evaluated, coint, (state.cursor + 1) % n if n else 0))


@dataclass
class Account:
    cash: float
    value: float
    long: set[str] = field(default_factory=set)
    short: set[str] = field(default_factory=set)
    quantity: dict[str, float] = field(default_factory=dict)  # of long symbols
    short_quantity: dict[tuple[str, str], float] = field(default_factory=dict)  # of (lead, lag): what was sold short for the pair


@dataclass(frozen=True)
class Limits:
    min_pct: float
    max_pct: float
    short_fraction: float = 0.0
    target_deployed: float = 0.0


@dataclass(frozen=True)
class Purse:
    """What may still be spent, how much of it the target deployment wants, and how many pairs are to come."""

    free: float
    gap: float
    left: int

    def share(self, score: float, value: float, limits: Limits) -> float:
        """A pair's part: by its score between the limits, and its part of the gap below the upper one."""
        own = (limits.min_pct + score * (limits.max_pct - limits.min_pct)) * value
        return min(own + self.gap / self.left, limits.max_pct * value) if self.gap > 0 and self.left > 0 else own

    def spent(self, cost: float) -> Purse:
        return Purse(self.free - cost, max(0.0, self.gap - cost), self.left - 1)


def _orders(pairs: list[dict], purse: Purse, account: Account, limits: Limits, quote: Callable[[str, float], float | None]) -> tuple[Purse, list[dict]]:
    """The pairs that get an order, best score first, and those whose lag has no price (bought is None): a fold over the ranked pairs.

    quote(symbol, money): the quantity for so much money, None without a price. A pair is passed over, and takes nothing, if it costs more than
    is left, if it is to be hedged and its lead can't be sold, or if a leg is held the other way round, also since this call.
    """
    hedge = limits.short_fraction

    def offer(state: tuple[Purse, list[dict]], p: dict) -> tuple[Purse, list[dict]]:
        left, done = state
        budget = left.share(p["score"], account.value, limits)
        cost, sold = budget * (1 + hedge), quote(p["lead"], budget * hedge) if hedge > 0 else 0.0
        if left.free < cost or (hedge > 0 and (not sold or mirrored(p, account))):
            return state
        bought = quote(p["lag"], budget)
        order = {**p, "budget": budget, "cost": cost, "bought": bought, "sold": sold}
        if bought is None:
            return replace(left, left=left.left - 1), [*done, order]
        if bought <= 0:
            return state
        account.long.add(p["lag"])
        account.short.update([p["lead"]] if hedge > 0 else [])
        return left.spent(cost), [*done, order]

    return reduce(offer, sorted(pairs, key=lambda p: (-p["score"], p["lead"], p["lag"])), (purse, []))


def execute(ranked: list[dict], account: Account, min_pct: float, max_pct: float, short_fraction: float, gap: float = 0.0) -> list[dict]:
    """Buys in order of score while the cash lasts, in money: the pairs with budget and cost. At most max_k pairs."""
    purse, orders = _orders(ranked, Purse(account.cash, gap, len(ranked)), account, Limits(min_pct, max_pct, short_fraction), lambda _, money: money)
    account.cash = purse.free
    return [{k: v for k, v in o.items() if k not in ("bought", "sold")} for o in orders]


def mirrored(pair: dict, account: Account) -> bool:
    """Whether a leg is held in the opposite direction."""
    return pair["lag"] in account.short or pair["lead"] in account.long


def trade_day(actions: list[dict], account: Account, prices: dict[str, float], limits: Limits) -> tuple[list[dict], list[str]]:
    """Trades of one day, and symbols whose price is missing: sells with their covers first, then buys.

    actions: rows of ``Day.actions``. Sells pay into the cash, covers take from it; the value is that at the call.
    Trades: symbol, side, quantity, price, leg, exit_reason, lead, lag.
    """
    trades: list[dict] = []

    def trade(p: dict, symbol: str, side: str, quantity: float, leg: str, reason: str | None = None) -> None:
        trades.append({"symbol": symbol, "side": side, "quantity": quantity, "price": prices[symbol], "leg": leg, "exit_reason": reason, "lead": p["lead"], "lag": p["lag"]})
        account.cash += quantity * prices[symbol] * (1 if side == "sell" else -1)

    priced = lambda s: (prices.get(s) or 0) > 0
    for p in sorted((p for p in actions if p["action"] == "sell"), key=lambda p: (p["lag"], p["lead"])):
        quantity = account.quantity.pop(p["lag"], 0.0)
        account.long.discard(p["lag"])
        if quantity > 0 and priced(p["lag"]):
            trade(p, p["lag"], "sell", quantity, "long", p["exit_reason"])
        covered = account.short_quantity.pop((p["lead"], p["lag"]), 0.0)
        if covered > 0:
            if not any(lead == p["lead"] for lead, _ in account.short_quantity):
                account.short.discard(p["lead"])
            if priced(p["lead"]):
                trade(p, p["lead"], "buy", covered, "short", p["exit_reason"])
    owed = sum(q * prices.get(lead, 0.0) for (lead, _), q in account.short_quantity.items())
    free = account.cash - owed
    gap = max(0.0, limits.target_deployed * account.value - (account.value - free))
    buys = [p for p in actions if p["action"] == "buy" and p["lag"] not in account.quantity]
    quote = lambda symbol, money: round(money / prices[symbol], 6) if priced(symbol) else None
    _, orders = _orders(buys, Purse(free, gap, len(buys)), account, limits, quote)
    failed = [o["lag"] for o in orders if o["bought"] is None]
    for o in (o for o in orders if o["bought"] is not None):
        trade(o, o["lag"], "buy", o["bought"], "long")
        account.quantity[o["lag"]] = o["bought"]
        if limits.short_fraction > 0:
            trade(o, o["lead"], "sell", o["sold"], "short")
            account.short_quantity[o["lead"], o["lag"]] = o["sold"]
    return trades, failed


def indicators(positions: DataFrame, prices: DataFrame, cash: float) -> DataFrame:
    """portfolio_value, gross_long_pct, gross_short_pct, cash_ratio; positions: symbol, quantity, leg."""
    last = prices.groupBy("symbol").agg(F.max_by("close", "day").alias("close"))
    v = F.col("quantity") * F.col("close")
    x = positions.join(last, "symbol").agg(F.coalesce(F.sum(F.when(F.col("leg") == "long", v)), F.lit(0.0)).alias("l"), F.coalesce(F.sum(F.when(F.col("leg") == "short", v)), F.lit(0.0)).alias("s"))
    pv = cash + F.col("l") - F.col("s")
    return x.select(pv.alias("portfolio_value"), (F.col("l") / pv).alias("gross_long_pct"), (F.col("s") / pv).alias("gross_short_pct"), (F.lit(cash) / pv).alias("cash_ratio"))
