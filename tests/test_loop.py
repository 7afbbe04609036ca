"""The daily loop over several days against a plain loop over the same rules, and a day's trades."""

import datetime as dt
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadlake.operators import loop

START = dt.date(2024, 1, 1)
P = loop.Settings(lookback=200, corr_long=20, corr_short=10, window=10, entry=1.5, exit=0.3, budget=3, cooldown=2, penny=5.0, max_k=3)
CLUSTERS = [["a", "b", "c", "d"], ["e", "f", "g", "h"]]
N = 90


def closes():
    rng = np.random.default_rng(123)
    common = np.cumsum(rng.normal(0, 0.02, (N, 2)), axis=0)
    out = {}
    for k, names in enumerate(CLUSTERS):
        for j, s in enumerate(names):
            out[s] = 20 * np.exp(common[:, k] + np.cumsum(rng.normal(0, 0.01 * (1 + j), N)) * 0.5 + rng.normal(0, 0.02, N))
    out["d"] = out["d"] / 10  # below the threshold
    return {s: {START + dt.timedelta(days=i): float(v) for i, v in enumerate(x) if not (s == "h" and i >= N - 6)} for s, x in out.items()}


def components(prices, a, b, at):
    days = sorted(d for d in prices.get(a, {}) if d in prices.get(b, {}) and at - dt.timedelta(days=P.lookback) <= d <= at)
    if not days:
        return None
    ll, lg = (np.log([prices[s][d] for d in days]) for s in (a, b))
    rl, rg = np.diff(ll), np.diff(lg)
    corr = lambda n: float(np.corrcoef(rl[-n:], rg[-n:])[0, 1]) if len(rl) >= n else None
    spread = lg - np.polyfit(ll, lg, 1)[0] * ll
    z = (spread[-1] - spread[-P.window :].mean()) / spread[-P.window :].std(ddof=1) if len(days) >= P.window else None
    depth = 0.0 if z is None else min(1.0, max(0.0, (-z - P.exit) / (P.entry - P.exit)))
    part = lambda x: min(1.0, max(0.0, x or 0.0))
    cl, cs = corr(P.corr_long), corr(P.corr_short)
    return {"lead": a, "lag": b, "corr_short": cs, "z": z, "z_depth": depth, "score": round(0.3 * part(cl) + 0.3 * part(cs) + 0.4 * depth, 9)}


def clustered():
    prices = closes()
    out = []
    for rank, names in enumerate(CLUSTERS):
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                days = sorted(set(prices[a]) & set(prices[b]))
                x, y = (np.diff(np.log([prices[s][d] for d in days])) for s in (a, b))
                out.append((rank, 2, float(np.corrcoef(x, y)[0, 1]), a, b))
    return out


def plain_day(prices, pairs, book, evaluated, cursor, at):
    scored = []
    for p in book:
        got = components(prices, p["lead"], p["lag"], at)
        why = "data_missing" if got is None else "zscore_exit" if p["held"] and got["z"] is not None and got["z"] > -P.exit else None
        scored.append({**p, **(got or {"score": None}), "why": why})
    held = {s for p in book for s in (p["lead"], p["lag"])}
    last = {s: v[max(d for d in v if d <= at)] for s, v in prices.items()}
    reached, cheap = [], set()
    for turn in range(2):
        rank = (cursor + turn) % 2
        for _, _, _, a, b in sorted((x for x in pairs if x[0] == rank), key=lambda x: (-round(x[2], 9), x[3], x[4])):
            if len(reached) == P.budget:
                break
            if a in held or b in held or any({a, b} == {x, y} and (at - d).days < P.cooldown for x, y, d in evaluated):
                continue
            low = next((s for s in (a, b) if last[s] < P.penny), None)
            if low:
                cheap.add(low)
                continue
            reached.append((a, b))
    found = [components(prices, a, b, at) for a, b in reached]
    pool = [p for p in scored if p["why"] is None]
    values = [p["corr_short"] for p in [*pool, *found] if p["z_depth"] > 0 and p["corr_short"] is not None]
    k = max(1, round(P.max_k * max(P.scale[0], min(statistics.median(values) / P.pivot if values else 0.0, P.scale[1]))))
    target, lags = set(), set()
    for p, _ in sorted([(p, 0) for p in pool] + [(p, 1) for p in found], key=lambda x: (-x[0]["score"], x[1], x[0]["lead"], x[0]["lag"])):
        if len(target) < k and p["lag"] not in lags:
            target.add((p["lead"], p["lag"]))
            lags.add(p["lag"])
    actions = {}
    for p in scored:
        key = p["lead"], p["lag"]
        why = p["why"] or ("displaced" if p["held"] and key not in target else None)
        actions[key] = ("sell", why) if why else ("buy" if key in target and not p["held"] else "hold", None)
    actions.update({key: ("buy", None) for key in target if key in {(p["lead"], p["lag"]) for p in found}})
    return actions, cheap, evaluated + [(a, b, at) for a, b in reached], (cursor + 1) % 2


def test_days_equal_a_plain_loop(spark):
    prices, pairs = closes(), clustered()
    frame = spark.createDataFrame([(s, d, c) for s, v in prices.items() for d, c in v.items()], "symbol string, day date, close double").cache()
    listed = spark.createDataFrame(pairs, "cluster_rank int, n_clusters int, corr double, lead string, lag string").cache()
    book, evaluated, cursor = [{"lead": "g", "lag": "h", "held": True}, {"lead": "a", "lag": "zz", "held": False}], [], 0
    fields = "lead string, lag string, score double, corr_short double, z_depth double, held boolean"
    coint = spark.createDataFrame([], "lead string, lag string, at date, coint_pvalue double, halflife_days double")
    kinds = set()
    for i in range(N - 8, N, 2):
        at = START + dt.timedelta(days=i)
        state = loop.State(spark.createDataFrame([(p["lead"], p["lag"], 0.0, 0.0, 0.0, p["held"]) for p in book], fields), spark.createDataFrame(evaluated, "lead string, lag string, date date"), coint, cursor)
        day = loop.daily_scoring(frame, listed, state, at.isoformat(), P, cointegrated=False)
        got = {(r["lead"], r["lag"]): (r["action"], r["exit_reason"]) for r in day.actions.collect()}
        want, cheap, evaluated, cursor = plain_day(prices, pairs, book, evaluated, cursor, at)
        assert got == want and {r["symbol"] for r in day.penny.collect()} == cheap and day.state.cursor == cursor
        assert {tuple(r) for r in day.state.evaluated.collect()} == set(evaluated)
        kinds |= set(want.values())
        book = [{"lead": a, "lag": b, "held": True if x == "buy" else next((p["held"] for p in book if (p["lead"], p["lag"]) == (a, b)), False)} for (a, b), (x, _) in want.items() if x != "sell"]
    assert ("buy", None) in kinds and any(why for _, why in kinds)


def test_cache_first_cointegration(spark):
    prices = closes()
    frame = spark.createDataFrame([(s, d, c) for s, v in prices.items() for d, c in v.items()], "symbol string, day date, close double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "lead string, lag string")
    at = START + dt.timedelta(days=N - 1)
    cache = spark.createDataFrame([("a", "b", at, 0.123, 7.0), ("a", "c", at - dt.timedelta(days=1), 0.5, 1.0)], "lead string, lag string, at date, coint_pvalue double, halflife_days double")
    scored, after = loop.spread_scores(frame, pairs, cache, at.isoformat(), P)
    by = {r["lag"]: r for r in scored.collect()}
    assert by["b"]["coint_pvalue"] == 0.123 and by["b"]["score_coint"] == pytest.approx(1 - 0.123 / 0.2) and by["c"]["coint_pvalue"] != 0.5
    assert after.count() == 3 and after.where(F.col("at") == F.lit(at)).count() == 2


def test_trade_day():
    def pair(lead, lag, score, action, why=None):
        return {"lead": lead, "lag": lag, "score": score, "action": action, "exit_reason": why}

    account = loop.Account(1_000.0, 10_000.0, {"b", "d"}, {"a"}, {"b": 10.0, "d": 2.0}, {("a", "b"): 4.0})
    actions = [pair("a", "b", 0.1, "sell", "zscore_exit"), pair("c", "d", 0.9, "hold"), pair("d", "e", 0.8, "buy"), pair("x", "f", 0.7, "buy"), pair("x", "nowhere", 0.6, "buy"), pair("y", "g", 0.5, "buy")]
    prices = {"a": 50.0, "b": 100.0, "d": 10.0, "e": 10.0, "f": 20.0, "x": 5.0, "y": 40.0, "g": 8.0}
    trades, failed = loop.trade_day(actions, account, prices, loop.Limits(0.01, 0.05, 0.5))
    assert [(t["symbol"], t["side"], t["leg"], t["exit_reason"]) for t in trades] == [
        ("b", "sell", "long", "zscore_exit"), ("a", "buy", "short", "zscore_exit"), ("f", "buy", "long", None), ("x", "sell", "short", None), ("g", "buy", "long", None), ("y", "sell", "short", None)]
    # d is held long, so a pair that would sell it short is left out; a symbol without a price is reported.
    assert failed == ["nowhere"] and "b" not in account.quantity and account.short == {"x", "y"} and account.long == {"d", "f", "g"}
    f = (0.01 + 0.7 * 0.04) * 10_000
    assert account.quantity["f"] == pytest.approx(f / 20) and account.short_quantity["x", "f"] == pytest.approx(f * 0.5 / 5)
    assert account.cash == pytest.approx(1_000 + 1_000 - 200 + sum(t["quantity"] * t["price"] * (1 if t["side"] == "sell" else -1) for t in trades[2:]))
    poor = loop.Account(100.0, 10_000.0)
    assert loop.trade_day([pair("x", "f", 0.7, "buy")], poor, prices, loop.Limits(0.01, 0.05))[0] == [] and poor.cash == 100.0
    gap = loop.Account(10_000.0, 10_000.0)
    first = loop.trade_day([pair("x", "f", 0.0, "buy"), pair("y", "g", 0.0, "buy")], gap, prices, loop.Limits(0.01, 0.05, 0.0, 0.06))[0]
    assert [t["quantity"] * t["price"] for t in first] == pytest.approx([min(100 + 300, 500), min(100 + 200, 500)], abs=1e-3)
    assert math.isclose(gap.cash, 10_000 - 700, abs_tol=1e-2)
