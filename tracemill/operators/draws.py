"""Drawing without replacement across groups (I5), in parallel rounds.

Groups in their order each take the first ``quota`` candidates of their own
ranking that no earlier group has taken. Done one after another, this is a loop
over all groups. Here all groups propose at once, each candidate stays with the
first group that proposes it, and the groups that lost a candidate propose their
next one. What a candidate holds only ever moves to an earlier group, so the
rounds end, and the end is what the loop gives: the first group is never
refused, the second only by the first, and so on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.sources.shared import kept


def draw(preferences: DataFrame, quota: int, *, group: str = "group", candidate: str = "candidate", rank: str = "rank", most_rounds: int | None = None) -> DataFrame:
    """(group, candidate, rank, place) of what each group draws, place from 1 in the order of its ranking.

    preferences: group (ordered by its own values), candidate, rank (from the most wanted; ties by candidate). Rows with a
    null take no part; of a pair that is repeated the best rank counts. A group that runs out of candidates has fewer.
    A round is two windows over what is still wanted; most groups settle in a few rounds. A round that changes nothing is
    the last; ``most_rounds`` makes more an error.
    """
    wanted = preferences.select(F.col(group).alias("g"), F.col(candidate).alias("c"), F.col(rank).alias("r")).dropna()
    wanted = kept(wanted.groupBy("g", "c").agg(F.min("r").alias("r")))
    own, rivals = Window.partitionBy("g").orderBy("r", "c"), Window.partitionBy("c").orderBy("g")
    rounds = 0
    while True:
        proposed = wanted.withColumn("place", F.row_number().over(own)).filter(F.col("place") <= quota)
        judged = proposed.withColumn("refused", F.row_number().over(rivals) > 1)
        refused = kept(judged.filter("refused").select("g", "c"))
        if not refused.take(1):
            break
        rounds += 1
        if most_rounds is not None and rounds > most_rounds:
            raise ValueError(f"not settled after {most_rounds} rounds")
        wanted = kept(wanted.join(refused, ["g", "c"], "left_anti"))
    return proposed.select(F.col("g").alias(group), F.col("c").alias(candidate), F.col("r").alias(rank), "place")


def in_turn(preferences: list[tuple], quota: int) -> dict:
    """The loop itself, over (group, candidate, rank): what ``draw`` must equal."""
    by: dict = {}
    for g, c, r in preferences:
        if None not in (g, c, r):
            by.setdefault(g, {}).setdefault(c, r)
            by[g][c] = min(by[g][c], r)
    taken: set = set()
    out = {}
    for g in sorted(by):
        out[g] = [c for r, c in sorted((r, c) for c, r in by[g].items()) if c not in taken][:quota]
        taken |= set(out[g])
    return out
