"""The flagship query: pairs of a sector ranked by the composite of correlations and dislocation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import panel as P
from ..registry import query
from .aggregates import RETURNS, aligned
from .series import ZS


def ranked_pairs(t, long: int = 90, short: int = 20, window: int = 20, k: int = 10) -> DataFrame:
    """lead, lag, score, rank of the k best pairs of each sector digit. The aligned rows are hashed by pair once; every window keeps that partitioning."""
    rows = aligned(t)
    z = P.last_row(P.zscore(rows, window).where("z is not null"), P.PAIR, "day", "z")
    x = z.join(P.dual_correlation(rows, long, short), [*P.PAIR], "left")
    scored = x.withColumn("score", F.round(S.composite_score(F.col("corr_long"), F.col("corr_short"), S.z_depth(F.col("z"), 2.0, 0.5)), 6))
    return P.top_k(scored.withColumn("g", F.substring("lead", 1, 7)), ["g"], k, F.desc("score"), "lead", "lag").select("lead", "lag", "score", "rank")


C = "greatest(0, least(1, coalesce({0}, 0)))"


@query("flagship_ranked_pairs", f"with {ZS}, zl as (select lead, lag, arg_max(z, day) as z from zs where z is not null group by lead, lag), rb as (select lead, lag, ln(pl) - lag(ln(pl)) over w as rl, ln(pg) - lag(ln(pg)) over w as rg, row_number() over (partition by lead, lag order by day desc) as k from al window w as (partition by lead, lag order by day)), rc as (select lead, lag, case when count(rl) filter (where k <= 90) >= 90 then corr(rl, rg) filter (where k <= 90) end as cl, case when count(rl) filter (where k <= 20) >= 20 then corr(rl, rg) filter (where k <= 20) end as cs from rb where rl is not null group by lead, lag), sc as (select lead, lag, R(0.3 * {C.format('cl')} + 0.3 * {C.format('cs')} + 0.4 * greatest(0, least(1, (-z - 0.5) / 1.5))) as score from zl left join rc using (lead, lag)) select lead, lag, score, cast(row_number() over (partition by substr(lead, 1, 7) order by score desc, lead, lag) as int) as rank from sc qualify row_number() over (partition by substr(lead, 1, 7) order by score desc, lead, lag) <= 10")
def _(t):
    return ranked_pairs(t)


__all__ = ["RETURNS", "ranked_pairs"]
