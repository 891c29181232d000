"""Row maths of preference and policy optimisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softplus(x: Column) -> Column:
    """ln(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def dpo_terms(policy_chosen: Column, policy_rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float) -> dict[str, Column]:
    """Margin z, loss softplus(-z) and the coefficient beta * sigmoid(-z)."""
    z = beta * ((policy_chosen - policy_rejected) - (ref_chosen - ref_rejected))
    return {"margin": z, "loss": softplus(-z), "coefficient": F.lit(beta) / (1.0 + F.exp(F.least(F.greatest(z, F.lit(-700.0)), F.lit(700.0))))}


def grpo_terms(logp: Column, old_logp: Column, ref_logp: Column, advantage: Column, clip: float, kl_weight: float) -> dict[str, Column]:
    """Ratio, clipped surrogate, k3 divergence exp(d) - d - 1, and their objective."""
    ratio = F.exp(logp - old_logp)
    clipped = F.least(F.greatest(ratio, F.lit(1.0 - clip)), F.lit(1.0 + clip))
    surrogate = F.least(ratio * advantage, clipped * advantage)
    d = ref_logp - logp
    kl = F.exp(d) - d - 1.0
    return {"ratio": ratio, "surrogate": surrogate, "kl": kl, "objective": surrogate - kl_weight * kl}


def is_close(a: Column, b: Column, rel: float = 1e-9, absolute: float = 0.0) -> Column:
    """Relative or absolute closeness; never for infinities that differ or NaN."""
    near = F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))
    return (a == b) | (near & ~F.isnan(a) & ~F.isnan(b) & (F.abs(a) != float("inf")) & (F.abs(b) != float("inf")))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def chunk_ranges(length: Column, size: int) -> Column:
    """[start, end) ranges of at most ``size`` that cover 0..length."""
    starts = F.when(length > 0, F.sequence(F.lit(0).cast("bigint"), length.cast("bigint") - 1, F.lit(size).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size, length.cast("bigint")).alias("end")))


def masked_labels(ids: Column, prefix: Column, ignore: int = -100) -> Column:
    """The ids with the first ``prefix`` replaced by the ignored label."""
    return F.concat(F.array_repeat(F.lit(ignore), prefix.cast("int")), F.slice(ids, prefix.cast("int") + 1, F.greatest(F.size(ids) - prefix.cast("int"), F.lit(0))))


def padded(ids: Column, width: Column, fill: int) -> Column:
    """M2: the ids, filled up on the right."""
    return F.concat(ids, F.array_repeat(F.lit(fill), F.greatest(width.cast("int") - F.size(ids), F.lit(0))))
