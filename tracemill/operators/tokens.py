"""Token operators over trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def next_turns(messages: DataFrame, case: str, turn: str, role: str, length: Column) -> DataFrame:
    """M1: of each assistant turn the length of all before it (masked) and its own (supervised); over-length is for the caller to reject, never cut."""
    before = Window.partitionBy(case).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    rows = messages.withColumn("target", length.cast("bigint")).withColumn("prefix", F.coalesce(F.sum("target").over(before), F.lit(0)).cast("bigint"))
    return rows.filter(F.col(role) == "assistant").select(case, turn, "prefix", "target", role)


def statistics(examples: DataFrame) -> DataFrame:
    """examples, tokens, supervised tokens, longest example."""
    whole = F.col("prefix") + F.col("target")
    return examples.agg(F.count(F.lit(1)).alias("examples"), F.sum(whole).alias("tokens"), F.sum("target").alias("supervised"), F.max(whole).alias("longest"))


def messages_of(turns: Column, query: Column, system: str) -> Column:
    """M3: a trajectory's turns (role, content) after the system and user messages."""
    head = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), query.alias("content")))
    return F.concat(head, F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))))


def behaviour_faults(df: DataFrame, *, most_new: int = 512, most_context: int = 8192) -> DataFrame:
    """M6: why a recorded turn cannot be trained on; null where it can."""
    n = F.size("generated_ids")
    finite = lambda a: F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    reason = (
        F.when(n == 0, "empty").when((F.size("old_logprobs") != n) | (F.size("token_entropies") != n), "misaligned")
        .when(~finite("old_logprobs") | ~finite("token_entropies"), "not_finite").when(n > most_new, "too_many_new").when(F.size("prompt_ids") + n > most_context, "context_too_long")
    )
    return df.withColumn("fault", reason)


def episode_weights(tokens: DataFrame, update: str, episode: str) -> DataFrame:
    """M7: each token's weight 1 / (episodes of the update * tokens of the episode)."""
    per = tokens.groupBy(update, episode).agg(F.count(F.lit(1)).alias("n"))
    episodes = per.groupBy(update).agg(F.count(F.lit(1)).alias("episodes"))
    return tokens.join(per.join(episodes, update), [update, episode]).withColumn("weight", 1.0 / (F.col("episodes") * F.col("n"))).drop("n", "episodes")
