"""The daily loop of many runs over many days: what a day needs of prices is worked out for all days at once, and each run is a group that takes its days in order.

A run's account and book are keyed state: tables go into a span of days, and out of it into the next, so a run can be as
long as one likes while a group holds one span.  Only what depends on the days before it is done in the group: selection, and buys and
sells as ``loop`` has them.
"""

from __future__ import annotations

import datetime as dt
import statistics
import uuid
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..sources.folders import shared_folder
from . import loop as L
from . import panel as P

SETTINGS = ("budget", "max_k", "cooldown", "min_pct", "max_pct", "short_fraction", "target_deployed")
STATE = "run string, kind string, lead string, lag string, x double, y double, day date"  # account (cash, cursor), book (held), seen (day), long and short (quantity)
OUT = f"{STATE}, symbol string, side string, reason string"


def components_by_day(prices: DataFrame, pairs: DataFrame, days: DataFrame, p: L.Settings) -> DataFrame:
    """lead, lag, day, corr_short, z, z_depth, score of every pair on every day on which it has common rows in the lookback: what ``loop.components`` gives for one.

    The hedge is that of the lookback's rows. Deviations of the spread over the last rows follow from rolling moments of both legs, so
    one pass of windows over the pair's rows serves all days. days: day, a calendar.
    """
    back = W.partitionBy(*P.PAIR).orderBy("day")
    last = lambda n: back.rowsBetween(1 - n, 0)
    x = P.align(prices, pairs.select(*P.PAIR)).withColumns({"ll": P.log_floor(F.col("pl")), "lg": P.log_floor(F.col("pg"))})
    x = x.withColumns({"rl": F.col("ll") - F.lag("ll").over(back), "rg": F.col("lg") - F.lag("lg").over(back)})
    w = last(p.window)
    rho = lambda n: F.covar_samp("rl", "rg").over(last(n)) / F.nullif(F.stddev_samp("rl").over(last(n)) * F.stddev_samp("rg").over(last(n)), F.lit(0.0))
    told = F.struct(
        F.col("ll").alias("l"), F.col("lg").alias("g"), F.avg("ll").over(w).alias("ml"), F.avg("lg").over(w).alias("mg"), F.var_samp("ll").over(w).alias("vl"), F.var_samp("lg").over(w).alias("vg"),
        F.covar_samp("ll", "lg").over(w).alias("c"), rho(p.corr_long).alias("cl"), rho(p.corr_short).alias("cs"),
    )
    rows = x.select(*P.PAIR, "day", F.lit(0).alias("asked"), "ll", "lg", told.alias("s"))
    calendar = days.agg(F.collect_set("day").alias("days"))  # one row
    grid = pairs.select(*P.PAIR).join(calendar, F.col("lead").isNotNull()).select(*P.PAIR, F.explode("days").alias("day"), F.lit(1).alias("asked"))
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("ll", "lg", "s")]
    both = rows.unionByName(grid.select("*", *none)).withColumn("at", F.unix_date("day"))
    span = W.partitionBy(*P.PAIR).orderBy("at").rangeBetween(-p.lookback, 0)
    upto = W.partitionBy(*P.PAIR).orderBy("at", "asked").rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumns({"n": F.count("ll").over(span), "h": F.regr_slope("lg", "ll").over(span), "s": F.last("s", ignorenulls=True).over(upto)}).where("asked = 1 and n > 0")
    h, s = F.col("h"), F.col("s")
    sd = F.sqrt(F.greatest(s["vg"] - 2 * h * s["c"] + h * h * s["vl"], F.lit(0.0)))
    z = F.when(F.col("n") >= p.window, (s["g"] - h * s["l"] - (s["mg"] - h * s["ml"])) / F.nullif(sd, F.lit(0.0)))
    cl, cs = (F.when(F.col("n") > k, s[c]) for k, c in ((p.corr_long, "cl"), (p.corr_short, "cs")))
    depth = F.coalesce(S.z_depth(F.col("z"), p.entry, p.exit), F.lit(0.0))
    got = both.select(*P.PAIR, "day", cl.alias("corr_long"), cs.alias("corr_short"), z.alias("z")).withColumn("z_depth", depth)
    return got.withColumn("score", F.round(S.composite_score(F.col("corr_long"), F.col("corr_short"), F.col("z_depth"), *p.weights), 9))


def closes_by_day(prices: DataFrame, days: DataFrame, lookback: int) -> DataFrame:
    """symbol, day, close: the last close up to each day and not older than the lookback."""
    calendar = days.agg(F.collect_set("day").alias("days"))  # one row
    grid = prices.select("symbol").distinct().join(calendar, F.col("symbol").isNotNull()).select("symbol", F.explode("days").alias("day"), F.lit(1).alias("asked"), F.lit(None).cast("struct<day:date,close:double>").alias("s"))
    rows = prices.select("symbol", "day", F.lit(0).alias("asked"), F.struct("day", F.col("close").cast("double").alias("close")).alias("s"))
    w = W.partitionBy("symbol").orderBy("day", "asked").rowsBetween(W.unboundedPreceding, 0)
    told = grid.unionByName(rows).withColumn("s", F.last("s", ignorenulls=True).over(w)).where("asked = 1")
    return told.where(F.col("s.day") >= F.date_sub("day", lookback)).select("symbol", "day", F.col("s.close").alias("close"))


@dataclass
class Run:
    """A run between two days."""

    account: L.Account
    cursor: int = 0
    book: dict[tuple[str, str], bool] = field(default_factory=dict)  # whether a pair is held
    seen: dict[tuple[str, str], dt.date] = field(default_factory=dict)  # when an unordered pair was last reached

    @classmethod
    def of(cls, state: pd.DataFrame) -> Run:
        run = cls(L.Account(0.0, 0.0))
        for r in state.itertuples():
            pair = r.lead, r.lag
            if r.kind == "account":
                run.account.cash, run.cursor = r.x, int(r.y)
            elif r.kind == "book":
                run.book[pair] = bool(r.x)
            elif r.kind == "seen":
                run.seen[pair] = r.day
            elif r.kind == "long":
                run.account.quantity[r.lag] = r.x
                run.account.long.add(r.lag)
            else:
                run.account.short_quantity[pair] = r.x
                run.account.short.add(r.lead)
        return run

    def rows(self, cooldown: int | None, day: dt.date | None) -> list[dict]:
        """The state; of what was reached, only what still counts."""
        out = [{"kind": "account", "x": self.account.cash, "y": float(self.cursor)}]
        out += [{"kind": "book", "lead": a, "lag": b, "x": float(h)} for (a, b), h in self.book.items()]
        out += [{"kind": "seen", "lead": a, "lag": b, "day": d} for (a, b), d in self.seen.items() if cooldown and (day is None or (day - d).days < cooldown)]
        out += [{"kind": "long", "lag": s, "x": q} for s, q in self.account.quantity.items()]
        return out + [{"kind": "short", "lead": a, "lag": b, "x": q} for (a, b), q in self.account.short_quantity.items()]

    def reached(self, day: dt.date, rows: list[dict], closes: dict[str, float], p: L.Settings) -> list[dict]:
        """The new pairs that the day's budget reaches: clusters in turn, the highest correlation first."""
        legs = {s for pair in self.book for s in pair}
        free = [r for r in rows if r["cluster_rank"] is not None and r["lead"] not in legs and r["lag"] not in legs]
        cold = lambda r: p.cooldown and (day - self.seen.get(tuple(sorted((r["lead"], r["lag"]))), dt.date.min)).days < p.cooldown
        dear = lambda r: min(closes.get(r["lead"], 0.0), closes.get(r["lag"], 0.0)) >= p.penny
        turn = lambda r: ((r["cluster_rank"] - self.cursor) % r["n_clusters"], -round(-1.0 if r["corr"] is None else r["corr"], 9), r["lead"], r["lag"])
        return sorted((r for r in free if not cold(r) and dear(r)), key=turn)[: p.budget]

    def take(self, day: dt.date, rows: list[dict], closes: dict[str, float], p: L.Settings, limits: L.Limits) -> tuple[list[dict], list[str]]:
        """One day: rows are the components of pairs, closes the last price of each symbol. Trades, and symbols without a price."""
        told = {(r["lead"], r["lag"]): r for r in rows if r["score"] is not None}
        why = {}
        for pair, held in self.book.items():
            z = told[pair]["z"] if pair in told else None
            why[pair] = "data_missing" if pair not in told else "zscore_exit" if held and z is not None and z > -p.exit else None
        found = [r for r in self.reached(day, rows, closes, p) if (r["lead"], r["lag"]) in told]
        pool = [(told[pair], 0) for pair in self.book if why[pair] is None] + [(r, 1) for r in found]
        near = [r["corr_short"] for r, _ in pool if r["z_depth"] > 0 and r["corr_short"] is not None]
        low, high = p.scale
        most = max(1, round(p.max_k * min(max((statistics.median(near) if near else 0.0) / p.pivot, low), high)))
        best: dict[str, dict] = {}  # by lag symbol
        for r, _ in sorted(pool, key=lambda x: (-x[0]["score"], x[1], x[0]["lead"], x[0]["lag"])):
            if len(best) < most:
                best.setdefault(r["lag"], r)
        target = {(r["lead"], r["lag"]) for r in best.values()}
        actions = []
        for pair, held in self.book.items():
            reason = why[pair] or ("displaced" if held and pair not in target else None)
            action = "sell" if reason else "buy" if pair in target and not held else "hold"
            actions.append({"lead": pair[0], "lag": pair[1], "score": told[pair]["score"] if pair in told else None, "action": action, "exit_reason": reason})
        new = [r for r in found if (r["lead"], r["lag"]) in target]
        actions += [{"lead": r["lead"], "lag": r["lag"], "score": r["score"], "action": "buy", "exit_reason": None} for r in new]
        a = self.account
        a.value = a.cash + sum(q * closes.get(s, 0.0) for s, q in a.quantity.items()) - sum(q * closes.get(s, 0.0) for (s, _), q in a.short_quantity.items())
        trades, failed = L.trade_day(actions, a, closes, limits)
        self.book = {(x["lead"], x["lag"]): x["lag"] in a.quantity for x in actions if x["action"] != "sell" and x["lag"] not in failed}
        self.seen |= {tuple(sorted((r["lead"], r["lag"]))): day for r in found}
        turns = next((r["n_clusters"] for r in rows if r["n_clusters"]), 0)
        self.cursor = (self.cursor + 1) % turns if turns else 0
        return trades, failed


def _span(p: L.Settings):
    def step(inputs: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        run, out, last, cooldown = Run.of(state.astype(object).where(state.notna(), None)), [], None, p.cooldown
        name = (state if len(state) else inputs)["run"].iloc[0]
        if len(inputs):
            first = inputs.iloc[0]
            cooldown = None if pd.isna(first["cooldown"]) else int(first["cooldown"])
            settings = L.replace(p, budget=int(first["budget"]), max_k=int(first["max_k"]), cooldown=cooldown)
            limits = L.Limits(*(float(first[c]) for c in ("min_pct", "max_pct", "short_fraction", "target_deployed")))
            for day, g in inputs.sort_values(["day", "lead", "lag"]).groupby("day", sort=True):
                g = g.astype(object).where(g.notna(), None)
                rows = g[g["lag"].notna()].to_dict("records")
                closes = {r["lead"]: r["c_lead"] for r in g.to_dict("records") if r["lag"] is None and r["c_lead"] is not None}
                trades, failed = run.take(day, rows, closes, settings, limits)
                last = day
                out += [{"kind": "trade", "day": day, "lead": t["lead"], "lag": t["lag"], "symbol": t["symbol"], "side": t["side"], "reason": t["exit_reason"], "x": t["quantity"], "y": t["price"]} for t in trades]
                out += [{"kind": "failed", "day": day, "symbol": s} for s in failed]
                out.append({"kind": "day", "day": day, "x": run.account.cash, "y": float(len(run.account.quantity))})
        columns = [c.split()[0] for c in OUT.split(", ")]
        told = pd.DataFrame([{"run": name, **r} for r in out + run.rows(cooldown, last)], columns=columns).astype(object)
        return told.where(told.notna(), None).astype({"x": float, "y": float})

    return step


def _written(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def run_days(prices: DataFrame, clustered: DataFrame, runs: DataFrame, state: DataFrame, p: L.Settings, spans: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(events, state) after the spans of days (first, last), one after another.

    runs: run, start, end and SETTINGS; clustered: cluster_rank, n_clusters, corr, lead, lag. state: STATE, at least an account of each run.
    events: run, kind (trade, failed, day), day, lead, lag, symbol, side, reason, x (quantity; cash), y (price; number of positions).
    Pairs of a state's book that no cluster has are followed too. A group holds one run's pairs and symbols on the days of one span.
    """
    listed = _written(clustered.select(*P.PAIR, "cluster_rank", "n_clusters", "corr"))
    state, events = _written(state), None
    for first, last in spans:
        days = prices.select("day").where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).distinct()
        since = prices.where((F.col("day") >= F.date_sub(F.lit(first).cast("date"), p.lookback)) & (F.col("day") <= F.lit(last).cast("date")))
        followed = listed.select(*P.PAIR).unionByName(state.where("kind = 'book'").select(*P.PAIR)).distinct()
        told = _written(components_by_day(since, followed, days, p).join(listed, [*P.PAIR], "left"))
        closes = closes_by_day(since, days, p.lookback)
        of = runs.join(days, F.col("day").between(F.col("start"), F.col("end"))).select("run", "day", *SETTINGS)  # a row for each run and day
        pairs = told.withColumn("c_lead", F.lit(None).cast("double")).join(of, "day")
        symbols = closes.select("day", F.col("symbol").alias("lead"), F.col("close").alias("c_lead")).join(of, "day")
        inputs = pairs.unionByName(symbols, allowMissingColumns=True)
        done = _written(inputs.groupBy("run").cogroup(state.groupBy("run")).applyInPandas(_span(p), OUT))
        happened = done.where("kind in ('trade', 'failed', 'day')")
        events = happened if events is None else events.unionByName(happened)
        state = done.where("kind not in ('trade', 'failed', 'day')").select(*[c.split()[0] for c in STATE.split(", ")])
    return events, state


def opened(runs: DataFrame, cash: str = "cash") -> DataFrame:
    """The state of runs that hold nothing but cash."""
    return runs.select("run", F.lit("account").alias("kind"), F.lit(None).cast("string").alias("lead"), F.lit(None).cast("string").alias("lag"), F.col(cash).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(None).cast("date").alias("day"))
