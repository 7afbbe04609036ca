"""Folds, overfitting guards, parameter space and studies."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import mixed, mixed_sql
from ..sources.tables import counted
from . import panel as P
from .inference import weighted_sums
from .ranks import quantiles, with_average_rank


def folds(spark: SparkSession, start: str, end: str, train: int, test: int) -> DataFrame:
    """fold, train_start, train_end, test_end by calendar months; each begins where the last one's holdout began."""
    d = lambda s: F.lit(s).cast("date")
    n = F.floor(F.months_between(d(end), d(start)) / test).cast("int") + 1
    x = spark.range(1).select(F.explode(F.sequence(F.lit(0), n)).alias("fold"))
    x = x.select("fold", F.add_months(d(start), F.col("fold") * test).alias("train_start"))
    x = x.withColumn("train_end", F.add_months("train_start", train)).withColumn("test_end", F.add_months("train_start", train + test))
    return x.where(F.col("test_end") <= F.date_add(d(end), 1))


def embargoed_splits(dates: DataFrame, n: int, embargo: int, col: str = "date") -> DataFrame:
    """split, train_end, eval_start, eval_end over n equal parts of the distinct dates; the evaluation begins the embargo after training."""
    days = dates.select(col).distinct().withColumn("part", F.ntile(n + 1).over(W.orderBy(col)))  # a calendar
    part = days.groupBy("part").agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    a = part.select(F.col("part").alias("split"), F.col("hi").alias("train_end"))
    b = part.select((F.col("part") - 1).alias("split"), F.col("lo").alias("eval_lo"), F.col("hi").alias("eval_end"))
    x = a.join(b, "split").withColumn("eval_start", F.greatest("eval_lo", F.date_add("train_end", embargo)))
    return x.where("eval_start <= eval_end").select("split", "train_end", "eval_start", "eval_end")


def causality_violations(splits: DataFrame, embargo: int) -> DataFrame:
    return splits.where(F.col("eval_start") < F.date_add("train_end", embargo))


def unit_signal(df: DataFrame, group: str, x: str, y: str, draws: int, seed: int, key: str) -> DataFrame:
    """Rank correlation of each group and the 95 % interval of its bootstrap: draws of the ranks' correlation, weighted."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(group, key, x, y)
    r = with_average_rank(with_average_rank(both, [group], x, "a"), [group], y, "b")
    a, b = F.col("a"), F.col("b")
    d = weighted_sums(r, [group], {"sw": F.lit(1.0), "sa": a, "sb": b, "ab": a * b, "aa": a * a, "bb": b * b}, draws, seed, F.col(key))
    m = lambda c: F.col(c) / F.nullif(F.col("sw"), F.lit(0.0))
    cov = lambda uv, u, v: m(uv) - m(u) * m(v)
    sd = F.sqrt(F.greatest(cov("aa", "sa", "sa") * cov("bb", "sb", "sb"), F.lit(0.0)))
    rho = d.select(group, (cov("ab", "sa", "sb") / F.nullif(sd, F.lit(0.0))).alias("rho"))
    ci = rho.groupBy(group).agg(F.percentile("rho", 0.025).alias("low"), F.percentile("rho", 0.975).alias("high"))  # a row for each draw
    return P.spearman(df, [group], x, y).join(ci, group).withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0))


def holdout_gap(df: DataFrame, group: str, sums: dict[str, Column], fit: Callable[[Callable[[str], Column]], dict[str, Column]], evaluate: Callable[[Callable[[str], Column], dict[str, Column]], Column]) -> DataFrame:
    """group, train, holdout, gap: for each group, a model fitted on the others, scored there and on the group itself.

    One pass: ``sums`` are aggregates that add up over groups; fit and evaluate are given a lookup of a side's sums. What the
    others hold is the total less the group's own.
    """
    own = df.groupBy(group).agg(*[c.alias(f"own_{k}") for k, c in sums.items()])
    w = W.partitionBy()  # a row for each group
    both = own.select("*", *[(F.sum(f"own_{k}").over(w) - F.col(f"own_{k}")).alias(f"rest_{k}") for k in sums])
    rest, held = (lambda k: F.col(f"rest_{k}")), (lambda k: F.col(f"own_{k}"))
    fitted = both.select("*", *[c.alias(f"fit_{k}") for k, c in fit(rest).items()])
    model = {c.removeprefix("fit_"): F.col(c) for c in fitted.columns if c.startswith("fit_")}
    return fitted.select(F.col(group).alias("group"), evaluate(rest, model).alias("train"), evaluate(held, model).alias("holdout")).withColumn("gap", F.col("train") - F.col("holdout"))


def line(x: str, y: str) -> tuple[dict[str, Column], Callable, Callable]:
    """sums, fit and evaluate of ``holdout_gap`` for the least-squares line of y on x; scored by the share of variance that it explains."""
    a, b = F.col(x), F.col(y)
    sums = {"n": F.count(F.lit(1)), "x": F.sum(a), "y": F.sum(b), "xx": F.sum(a * a), "xy": F.sum(a * b), "yy": F.sum(b * b)}

    def fit(s: Callable[[str], Column]) -> dict[str, Column]:
        slope = (s("n") * s("xy") - s("x") * s("y")) / F.nullif(s("n") * s("xx") - s("x") * s("x"), F.lit(0.0))
        return {"slope": slope, "intercept": (s("y") - slope * s("x")) / s("n")}

    def evaluate(s: Callable[[str], Column], m: dict[str, Column]) -> Column:
        u, v = m["slope"], m["intercept"]
        error = s("yy") - 2 * u * s("xy") - 2 * v * s("y") + u * u * s("xx") + 2 * u * v * s("x") + v * v * s("n")
        return 1 - error / F.nullif(s("yy") - s("y") * s("y") / s("n"), F.lit(0.0))

    return sums, fit, evaluate


def permuted(x: Column, size: Column, seed: int, draw: Column, most: int = 48) -> Column:
    """Where x in [0, size) goes in the draw's permutation of these numbers.

    A Feistel network of four rounds over pairs below a = ceil(sqrt(size)), walked on until it is back below size: a step leaves it
    for at most half of the a * a numbers, and for few if size is large.
    """
    a = F.ceil(F.sqrt(size.cast("double"))).cast("long")
    turns = lambda s, k: F.struct(s["r"].alias("l"), F.pmod(s["l"] + F.pmod(mixed(seed, draw * 4 + k, s["r"]), a), a).alias("r"))
    pair = lambda l, r: F.struct(l.cast("long").alias("l"), r.cast("long").alias("r"))  # noqa: E731, E741
    once = lambda s: F.aggregate(F.sequence(F.lit(0), F.lit(3)), s, turns)
    at = lambda s: s["l"] * a + s["r"]
    first = once(pair(F.floor(x / a), F.pmod(x.cast("long"), a)))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(most)), first, lambda s, _: F.when(at(s) < size, s).otherwise(once(s)))
    return F.when(at(walked) < size, at(walked)).otherwise(F.raise_error(F.lit("a permutation did not come back")).cast("long"))


def permuted_sql(rows: str, seed: int) -> str:
    """The body of a recursive table (id, draw, size, l, r, i) over rows (id, draw, size, spot); its rows where ``ARRIVED`` holds give the place l * a + r."""
    a = "cast(ceil(sqrt(cast(size as double))) as bigint)"
    return f"select id, draw, size, spot // {a} as l, spot % {a} as r, 0 as i from {rows} union all select id, draw, size, r, (l + ({mixed_sql(seed, 'draw * 4 + i % 4', 'r')}) % {a}) % {a}, i + 1 from walk where not ({ARRIVED})"


ARRIVED = "i > 0 and i % 4 = 0 and l * cast(ceil(sqrt(cast(size as double))) as bigint) + r < size"


def null_baseline(df: DataFrame, cells: list[str], score: str, outcome: str, k: int, draws: int, seed: int, key: str) -> DataFrame:
    """null (random, shuffle), real, mean, sd, z, percentile: the mean over cells of the k best rows' mean outcome, against two nulls.

    random: k rows of each cell, drawn anew. shuffle: outcomes permuted over all rows, selection as it was. Rows are numbered
    once, by cell and key; a draw is a keyed permutation of the numbers, of which only the selected places are worked out, so an
    equi-join on few numbers takes the place of an order of all rows.
    """
    rows = counted(df.select(*cells, key, F.col(score).alias("__score"), F.col(outcome).alias("o")), [*cells, key])
    best = P.top_k(rows, cells, k, F.desc("__score"), key)
    pooled = lambda x, by: x.groupBy(*by, *cells).agg(F.avg("o").alias("m")).groupBy(*by).agg(F.avg("m").alias("m"))
    real = best.groupBy(*cells).agg(F.avg("o").alias("m")).agg(F.avg("m").alias("real"))
    draw = F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")
    # A row for each cell, with the numbers of its rows.
    cell = rows.groupBy(*cells).agg(F.min("__n").alias("first"), F.count("*").alias("size")).withColumn("no", F.row_number().over(W.orderBy(*cells)) - 1)
    places = cell.select(*cells, "first", "size", "no", draw).select("*", F.explode(F.sequence(F.lit(0), F.least(F.lit(k), F.col("size")) - 1)).alias("at"))
    inside = places.select(F.lit("random").alias("null"), "draw", *cells, (F.col("first") + permuted(F.col("at"), F.col("size"), seed, F.col("draw") + draws * F.col("no"))).alias("__n"))
    total = cell.agg(F.sum("size").alias("size"))
    slots = best.select(*cells, (F.row_number().over(W.orderBy(*cells, "rank")) - 1).alias("at"))  # k rows for each cell
    every = slots.select(*cells, "at", draw).join(total, F.col("size") > 0)  # one row
    over = every.select(F.lit("shuffle").alias("null"), "draw", *cells, (1 + permuted(F.col("at"), F.col("size"), seed, F.col("draw"))).alias("__n"))
    taken = inside.unionByName(over).join(rows.select("__n", "o"), "__n")
    x = pooled(taken, ["null", "draw"]).join(real, F.col("m").isNotNull())  # one row
    r, m = F.first("real"), F.avg("m")
    return x.groupBy("null").agg(r.alias("real"), m.alias("mean"), F.stddev_samp("m").alias("sd"), ((r - m) / F.nullif(F.stddev_samp("m"), F.lit(0.0))).alias("z"), (100.0 * F.avg(F.when(F.col("m") <= F.col("real"), 1.0).otherwise(0.0))).alias("percentile"))


def seed_stability(runs: DataFrame, by: list[str], x: str) -> DataFrame:
    range_ = runs.groupBy(*by).agg(F.min(x).alias("low"), F.max(x).alias("high"), (F.max(x) - F.min(x)).alias("range_"))
    return range_.join(quantiles(runs, by, x, {"median_": 0.5}), by)


# Parameters with their bounds; equal types.
SPACE = {"corr_window_long": (60, 120), "corr_window_short": (10, 40), "zscore_window": (15, 60), "entry_threshold": (1.0, 3.0), "exit_threshold": (0.0, 1.0), "max_k": (5, 40), "w_corr_long": (0.0, 1.0), "w_corr_short": (0.0, 1.0), "w_z_depth": (0.0, 1.0)}


def suggest(seed: int, space: dict = SPACE) -> dict:
    """A point that meets the joint constraints: short window below the long one, exit below entry, weights that sum to 1."""
    rng = np.random.default_rng(seed)
    p = {k: (int(rng.integers(lo, hi + 1)) if isinstance(lo, int) else float(rng.uniform(lo, hi))) for k, (lo, hi) in space.items()}
    p["corr_window_short"] = min(p["corr_window_short"], p["corr_window_long"] - 1)
    p["exit_threshold"] = min(p["exit_threshold"], p["entry_threshold"] - 0.25)
    total = sum(v for k, v in p.items() if k.startswith("w_")) or 1.0
    return {k: (v / total if k.startswith("w_") else v) for k, v in p.items()}


def report_panel(*, complexity: dict | None = None, unit_signal: list[dict] | None = None, null: dict | None = None, holdout: list[dict] | None = None, stability: dict | None = None, least_percentile: float = 90.0) -> list[dict]:
    """guard, verdict, value of the guards that are given, in a fixed order.

    complexity: ratio, flagged. unit_signal: rows with excludes_zero. null: percentile. holdout: rows with holdout and gap; passes
    with a mean holdout above 0 that the mean gap does not exceed. stability: range_, and flagged if it is unstable.
    """
    out = []
    if complexity is not None:
        out.append(("complexity", "RED" if complexity["flagged"] else "GREEN", float(complexity["ratio"])))
    if unit_signal is not None:
        n = sum(bool(r["excludes_zero"]) for r in unit_signal)
        out.append(("unit signal", "PASS" if n else "FAIL", float(n)))
    if null is not None:
        p = null["percentile"]
        out.append(("null baseline", "PASS" if p is not None and p >= least_percentile else "FAIL", float("nan") if p is None else float(p)))
    if holdout is not None:
        mean = lambda c: sum(r[c] for r in holdout) / len(holdout) if holdout else float("nan")
        out.append(("holdout gap", "PASS" if mean("holdout") > 0 and mean("gap") <= abs(mean("holdout")) else "FAIL", mean("gap")))
    if stability is not None:
        out.append(("seed stability", "FAIL" if stability["flagged"] else "PASS", float(stability["range_"])))
    return [{"guard": g, "verdict": v, "value": x} for g, v, x in out]


def battery(results: DataFrame, warmth: DataFrame, label: str, warm_only: bool = True) -> DataFrame:
    """label, regime, status (done, cold, error), score of every regime; a cold one is left out if only warm ones shall run.

    results: regime, score (null: the run failed). warmth: regime, warm.
    """
    x = warmth.join(results, "regime", "left")
    cold = F.lit(warm_only) & ~F.col("warm")
    return x.select(F.lit(label).alias("label"), "regime", F.when(cold, "cold").when(F.col("score").isNull(), "error").otherwise("done").alias("status"), F.when(~cold, F.col("score")).alias("score"))


def battery_report(a: DataFrame, b: DataFrame, margin: float = 0.01) -> DataFrame:
    """regime, score_a, score_b, winner: a side wins by more than the margin; SKIP where one is cold, N/A where one has no score."""
    side = lambda x, s: x.select("regime", F.col("status").alias(f"st_{s}"), F.col("score").alias(f"score_{s}"))
    x = side(a, "a").join(side(b, "b"), "regime", "full")
    cold = lambda s: F.coalesce(F.col(f"st_{s}") == "cold", F.lit(True))
    p, q = F.col("score_a"), F.col("score_b")
    winner = F.when(cold("a") | cold("b"), "SKIP").when(p.isNull() | q.isNull(), "N/A").when(p > q + margin, "a").when(q > p + margin, "b").otherwise("TIE")
    return x.select("regime", "score_a", "score_b", winner.alias("winner"))


def battery_gate(good: DataFrame, bad: DataFrame, least_wins: int = 3) -> DataFrame:
    """completed, wins, verdict: regimes that both ended, and in how many of them the good side has the greater score; INCONCLUSIVE without any."""
    done = lambda x, s: x.where("status = 'done'").select("regime", F.col("score").alias(s))
    x = done(good, "g").join(done(bad, "b"), "regime").agg(F.count("*").alias("completed"), F.count_if(F.col("g") > F.col("b")).alias("wins"))
    return x.withColumn("verdict", F.when(F.col("completed") == 0, "INCONCLUSIVE").when(F.col("wins") >= least_wins, "PASS").otherwise("FAIL"))


def best_trial(trials: DataFrame, study: str) -> DataFrame:
    """The study's best completed trial. trials: study, trial, state, value, and parameters."""
    return trials.where((F.col("study") == study) & (F.col("state") == "COMPLETE") & F.col("value").isNotNull()).orderBy(F.desc("value"), "trial").limit(1)


def study_base(trials: DataFrame, study: str, defaults: dict, weights: tuple[str, ...]) -> dict:
    """The fixed base of a further study: defaults, then the best trial's parameters, weights normalised, no short leg. An error without the study or a completed trial."""
    if trials.where(F.col("study") == study).isEmpty():
        raise LookupError(f"no study {study}")
    best = best_trial(trials, study).first()  # one row
    if best is None:
        raise LookupError(f"study {study} has no completed trial")
    base = {**defaults, **{k: v for k, v in best.asDict().items() if k not in ("study", "trial", "state", "value") and v is not None}}
    total = sum(base[w] for w in weights)
    return {**base, **{w: base[w] / total if total > 0 else 1 / len(weights) for w in weights}, "short_leg_fraction": 0.0}


def phase_gate(trials: DataFrame, study: str, baseline: DataFrame) -> DataFrame:
    """best, baseline, delta, verdict: whether the best trial beats the baseline's score; no row without a completed trial or a baseline. baseline: score."""
    best = best_trial(trials, study).select(F.col("value").alias("best"))
    x = best.join(F.broadcast(baseline.where("score is not null").select(F.col("score").alias("baseline"))), F.col("best").isNotNull())  # one row each
    return x.withColumn("delta", F.col("best") - F.col("baseline")).withColumn("verdict", F.when(F.col("delta") > 0, "PASS").otherwise("FAIL"))


def run_by_token(runs: DataFrame, token: str) -> DataFrame:
    """The completed run whose settings hold the token; no other will do. runs: run_id, mode, started_at, completed_at, settings."""
    hit = (F.get_json_object("settings", "$.tuning_trial_token") == token) & F.col("completed_at").isNotNull()
    return runs.where(hit).orderBy("run_id").limit(1).select("run_id", F.lit("token").alias("how"))


def latest_run(runs: DataFrame, snapshots: DataFrame, after: str, least: int = 5) -> DataFrame:
    """The last backtest that began at or after a time: completed ones first, else one without an end that has enough snapshots."""
    recent = runs.where((F.col("started_at") >= F.lit(after).cast("timestamp_ntz")) & (F.col("mode") == "backtest"))
    n = snapshots.groupBy("run_id").agg(F.count("*").alias("n"))
    x = recent.join(n, "run_id", "left").withColumn("done", F.col("completed_at").isNotNull()).where(F.col("done") | (F.col("n") >= least))
    return x.orderBy(F.desc("done"), F.desc("started_at"), "run_id").limit(1).select("run_id", F.when(F.col("done"), "completed").otherwise("partial").alias("how"))
