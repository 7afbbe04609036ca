"""Many runs over many days against a plain loop for each, in one span of days and in several; components of all days against those of one."""

import dataclasses
import datetime as dt

import pytest

from spreadlake.operators import loop, runs
from tests import test_loop as plain

START, N = plain.START, plain.N
DAYS = [START + dt.timedelta(days=i) for i in range(N - 26, N)]
RUNS = {
    "calm": {"start": DAYS[0], "end": DAYS[-1], "budget": 3, "max_k": 3, "cooldown": 2, "min_pct": 0.02, "max_pct": 0.2, "short_fraction": 0.5, "target_deployed": 0.3, "cash": 10_000.0},
    "poor": {"start": DAYS[4], "end": DAYS[-3], "budget": 2, "max_k": 2, "cooldown": 4, "min_pct": 0.05, "max_pct": 0.4, "short_fraction": 0.0, "target_deployed": 0.0, "cash": 60.0},
    "wide": {"start": DAYS[2], "end": DAYS[-1], "budget": 6, "max_k": 5, "cooldown": None, "min_pct": 0.01, "max_pct": 0.1, "short_fraction": 1.0, "target_deployed": 0.9, "cash": 100_000.0},
}
BOOK = {"calm": {("g", "h"): False, ("a", "zz"): False}, "poor": {}, "wide": {}}


def plain_run(monkeypatch, name, prices, pairs):
    """Trades of a run by the rules of the plain day and ``trade_day``, and the account in the end."""
    r = RUNS[name]
    monkeypatch.setattr(plain, "P", dataclasses.replace(plain.P, budget=r["budget"], max_k=r["max_k"], cooldown=r["cooldown"] or 0))
    limits = loop.Limits(*(r[c] for c in ("min_pct", "max_pct", "short_fraction", "target_deployed")))
    account, book, seen, cursor, out = loop.Account(r["cash"], 0.0), [{"lead": a, "lag": b, "held": h} for (a, b), h in BOOK[name].items()], [], 0, []
    for at in DAYS:
        if not r["start"] <= at <= r["end"]:
            continue
        closes = {s: v[max(d for d in v if d <= at)] for s, v in prices.items()}
        actions, _, seen, cursor = plain.plain_day(prices, pairs, book, seen, cursor, at)
        rows = []
        for (a, b), (action, why) in actions.items():
            got = plain.components(prices, a, b, at)
            rows.append({"lead": a, "lag": b, "score": got and got["score"], "action": action, "exit_reason": why})
        account.value = account.cash + sum(q * closes[s] for s, q in account.quantity.items()) - sum(q * closes[s] for (s, _), q in account.short_quantity.items())
        trades, failed = loop.trade_day(rows, account, closes, limits)
        out += [(name, at, t["symbol"], t["side"], t["lead"], t["lag"], t["exit_reason"], t["quantity"], t["price"]) for t in trades]
        book = [{"lead": x["lead"], "lag": x["lag"], "held": x["lag"] in account.quantity} for x in rows if x["action"] != "sell" and x["lag"] not in failed]
    return out, account, {(p["lead"], p["lag"]): p["held"] for p in book}, cursor


@pytest.fixture(scope="module")
def tables(spark):
    prices, pairs = plain.closes(), plain.clustered()
    frame = spark.createDataFrame([(s, d, c) for s, v in prices.items() for d, c in v.items()], "symbol string, day date, close double").cache()
    listed = spark.createDataFrame(pairs, "cluster_rank int, n_clusters int, corr double, lead string, lag string").cache()
    return prices, pairs, frame, listed


def test_components_of_all_days(spark, tables):
    prices, pairs, frame, listed = tables
    days = spark.createDataFrame([(d,) for d in DAYS[::5]], "day date")
    settings = dataclasses.replace(plain.P, lookback=60)
    got = {(r["day"], r["lead"], r["lag"]): r for r in runs.components_by_day(frame, listed, days, settings).collect()}
    n = 0
    for at in DAYS[::5]:
        for r in loop.components(frame, listed, at.isoformat(), settings).collect():
            x = got.pop((at, r["lead"], r["lag"]))
            for c in ("z", "z_depth", "corr_short", "score"):
                assert x[c] == pytest.approx(r[c], abs=1e-7), (at, r["lead"], r["lag"], c)
            n += 1
    assert n > 50 and not got


@pytest.mark.parametrize("cuts", [[len(DAYS)], [3, 11, len(DAYS)]])
def test_runs_equal_plain_loops(spark, tables, monkeypatch, cuts):
    prices, pairs, frame, listed = tables
    schema = "run string, start date, end date, budget int, max_k int, cooldown int, min_pct double, max_pct double, short_fraction double, target_deployed double, cash double"
    table = spark.createDataFrame([(n, *r.values()) for n, r in RUNS.items()], schema)
    books = spark.createDataFrame([(n, "book", a, b, float(h), None, None) for n, book in BOOK.items() for (a, b), h in book.items()], runs.STATE)
    spans = [(DAYS[a].isoformat(), DAYS[b - 1].isoformat()) for a, b in zip([0, *cuts], cuts, strict=False)]
    events, state = runs.run_days(frame, listed, table, runs.opened(table).unionByName(books), plain.P, spans)
    got = sorted((r["run"], r["day"], r["symbol"], r["side"], r["lead"], r["lag"], r["reason"] or "", r["x"], r["y"]) for r in events.where("kind = 'trade'").collect())
    want, ends = [], {}
    for name in RUNS:
        trades, *ends[name] = plain_run(monkeypatch, name, prices, pairs)
        want += [(*t[:6], t[6] or "", *t[7:]) for t in trades]
    assert [t[:7] for t in got] == [t[:7] for t in sorted(want)]
    assert [t[7] for t in got] == pytest.approx([t[7] for t in sorted(want)], rel=1e-5, abs=2e-6) and [t[8] for t in got] == pytest.approx([t[8] for t in sorted(want)])
    assert len({t[0] for t in want}) == 3 and {t[6] for t in want} >= {"", "zscore_exit"} and {t[3] for t in want} == {"buy", "sell"}
    rows = state.collect()
    for name, (account, book, cursor) in ends.items():
        mine = [r for r in rows if r["run"] == name]
        (x,) = [r for r in mine if r["kind"] == "account"]
        assert x["x"] == pytest.approx(account.cash, rel=1e-6) and x["y"] == cursor
        assert {(r["lead"], r["lag"]): bool(r["x"]) for r in mine if r["kind"] == "book"} == book
        assert {r["lag"]: r["x"] for r in mine if r["kind"] == "long"} == pytest.approx(account.quantity, rel=1e-6)
        assert {(r["lead"], r["lag"]): r["x"] for r in mine if r["kind"] == "short"} == pytest.approx(account.short_quantity, rel=1e-6)
    assert events.where("kind = 'day'").count() == sum(r["start"] <= d <= r["end"] for r in RUNS.values() for d in DAYS)


def test_no_collect_and_no_state(spark, tables):
    _, _, frame, listed = tables
    none = spark.createDataFrame([], "run string, start date, end date, budget int, max_k int, cooldown int, min_pct double, max_pct double, short_fraction double, target_deployed double, cash double")
    events, state = runs.run_days(frame, listed, none, runs.opened(none), plain.P, [(DAYS[0].isoformat(), DAYS[1].isoformat())])
    assert events.count() == 0 and state.count() == 0


def test_a_short_of_nothing_is_no_order():
    pair = {"lead": "x", "lag": "f", "score": 0.5, "action": "buy", "exit_reason": None}
    account = loop.Account(1_000.0, 1_000.0)
    trades, failed = loop.trade_day([pair], account, {"x": 1e12, "f": 1.0}, loop.Limits(0.0, 0.01, 0.01))
    assert trades == [] and failed == [] and account.cash == 1_000.0
