"""Arithmetic of preference training over array columns, one row for each sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.arrays import masked_mean, total

# The trainer's coefficients.
KL, CLIP_REWARD, CLIP_RATIO, CLIP_VALUE, GAMMA, LAMBDA = 0.1, 5.0, 0.2, 0.2, 1.0, 0.95


def rewards(logprobs: Column, reference: Column, score: Column, start: Column, answer: Column) -> Column:
    """-KL (logp - ref) for each token, and the clipped score on the answer's last, the token at
    start + answer (or the last there is); places count from 0."""
    kl = F.zip_with(logprobs, reference, lambda a, b: -KL * (a - b))
    at = F.least(start + answer, F.size(logprobs) - 1)
    clipped = F.greatest(F.lit(-CLIP_REWARD), F.least(score, F.lit(CLIP_REWARD)))
    return F.transform(kl, lambda v, i: v + F.when(i == at, clipped).otherwise(0.0))


def advantages(values: Column, reward: Column, start: Column, gamma: float = GAMMA, lam: float = LAMBDA) -> Column:
    """Generalised advantage estimates from ``start`` (from 0) on, by a scan from the end."""
    n = F.size(reward)
    deltas = F.transform(reward, lambda r, t: r + gamma * F.coalesce(F.get(values, t + 1), F.lit(0.0)) - F.get(values, t))
    back = F.reverse(F.slice(deltas, start + 1, F.greatest(n - start, F.lit(0))))
    zero = F.struct(F.lit(0.0).alias("g"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, d: Column) -> Column:
        g = d + gamma * lam * s["g"]
        return F.struct(g.alias("g"), F.concat(F.array(g), s["out"]).alias("out"))

    return F.aggregate(back, zero, step, lambda s: s["out"])


def returns(advantage: Column, values: Column, start: Column) -> Column:
    return F.zip_with(advantage, F.slice(values, start + 1, F.size(advantage)), lambda a, v: a + v)


def actor_loss(logprobs: Column, old: Column, advantage: Column, mask: Column, clip: float = CLIP_RATIO) -> Column:
    """Clipped policy loss, the mean over the mask."""
    ratio = F.zip_with(F.zip_with(logprobs, old, lambda a, b: a - b), mask, lambda d, m: F.exp(d * m))
    loss = F.zip_with(advantage, ratio, lambda a, r: F.greatest(-a * r, -a * F.greatest(F.lit(1 - clip), F.least(r, F.lit(1 + clip)))))
    return masked_mean(loss, mask)


def critic_loss(values: Column, old: Column, target: Column, mask: Column, clip: float = CLIP_VALUE) -> Column:
    """Half the clipped squared error, the mean over the mask."""
    near = F.zip_with(values, old, lambda v, o: F.greatest(o - clip, F.least(v, o + clip)))
    square = lambda a: F.zip_with(a, target, lambda v, r: (v - r) * (v - r))
    return 0.5 * masked_mean(F.zip_with(square(values), square(near), lambda a, b: F.greatest(a, b)), mask)


def log_sigmoid(x: Column) -> Column:
    return -(F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))


def first_pad(ids: Column, pad: int, skip: int = 0) -> Column:
    """Place (from 0) of the pad after ``skip`` pads at the beginning; the length if none."""
    places = F.filter(F.transform(ids, lambda x, i: F.when(x == pad, i)), lambda i: i.isNotNull())
    return F.coalesce(F.get(places, F.lit(skip)), F.size(ids))


def pair_spans(chosen: Column, rejected: Column, pad: int, skip: int = 0) -> dict[str, Column]:
    """Where a pair's loss runs: from its first difference to the later end; a pair that does not
    differ has its last place alone."""
    differs = F.filter(F.transform(F.zip_with(chosen, rejected, lambda a, b: a != b), lambda d, i: F.when(d, i)), lambda i: i.isNotNull())
    n, same = F.size(chosen), F.size(differs) == 0
    c_end = first_pad(chosen, pad, skip)
    r_end = F.when(same, c_end).otherwise(first_pad(rejected, pad, skip))
    return {"begin": F.when(same, n - 1).otherwise(F.get(differs, F.lit(0))), "end": F.when(same, n).otherwise(F.greatest(c_end, r_end)), "c_end": c_end, "r_end": r_end}


def pair_loss(df: DataFrame, pad: int, skip: int = 0) -> DataFrame:
    """Adds loss, chosen_score and rejected_score to rows (chosen, rejected, chosen_rewards,
    rejected_rewards): -log sigmoid of the rewards' difference, the mean over the span."""
    at = pair_spans(F.col("chosen"), F.col("rejected"), pad, skip)
    cut = lambda c: F.slice(c, at["begin"] + 1, at["end"] - at["begin"])
    loss = F.zip_with(cut("chosen_rewards"), cut("rejected_rewards"), lambda c, r: -log_sigmoid(c - r))
    score = lambda c, end: F.get(c, F.when(at[end] > 0, at[end] - 1).otherwise(F.size(c) - 1))
    return df.withColumns({"loss": F.try_divide(total(loss), F.size(loss)), "chosen_score": score("chosen_rewards", "c_end"), "rejected_score": score("rejected_rewards", "r_end")})


def preference_loss(logit: Column, other_logit: Column, value: Column, other_value: Column, margin: float = 0.1) -> Column:
    """For a preferred and another action: -log sigmoid of the logits' difference plus a hinge on
    that of the values. (The weights' own penalty is the trainer's.)"""
    return -log_sigmoid(logit - other_logit) + F.greatest(margin - (value - other_value), F.lit(0.0))


def answered(df: DataFrame, ids: str, prompt_length: str, pad: int) -> DataFrame:
    """Sequences whose answer has more than one token that is not padding."""
    answer = F.slice(ids, F.col(prompt_length) + 1, F.greatest(F.size(ids) - F.col(prompt_length), F.lit(0)))
    return df.where(F.size(F.filter(answer, lambda x: x != pad)) > 1)


def flops(batch: Column, length: Column, layers: Column, hidden: Column, vocabulary: Column, checkpointing: bool = True, lora: int = 0) -> Column:
    """Floating-point operations of a training step of a decoder; adapters of rank ``lora`` save
    most of the weights' gradients."""
    factor = F.lit(4.0 if checkpointing else 3.0)
    if lora > 0:
        factor = factor - (1.0 - 2.0 * lora / hidden)
    return factor * forward_flops(batch, length, layers, hidden, vocabulary)


def forward_flops(batch: Column, length: Column, layers: Column, hidden: Column, vocabulary: Column) -> Column:
    """Floating-point operations of a pass forward."""
    return 24.0 * batch * length * layers * hidden * hidden * (1.0 + length / (6.0 * hidden) + vocabulary / (16.0 * layers * hidden))


def throughput(operations: Column, seconds: Column, batch: Column, gpus: Column) -> Column:
    """A training step's latency, tflops a device, samples_per_second and seconds_per_sample."""
    return F.struct(seconds.alias("latency"), (operations / (seconds * gpus * 1e12)).alias("tflops"), (batch / seconds).alias("samples_per_second"), (seconds / batch).alias("seconds_per_sample"))


def generation(parameters: Column, value_bytes: Column, seconds: Column, answer_length: Column, operations: Column, gpus: Column) -> Column:
    """Generation's latency, token_latency, tflops a device and bandwidth, the GB of weights read a second; -1
    where ``value_bytes``, a weight's size, is below 1."""
    token = seconds / answer_length
    bandwidth = F.when(value_bytes > 0, parameters * value_bytes / token / 1e9).otherwise(-1.0)
    return F.struct(seconds.alias("latency"), token.alias("token_latency"), (operations / (seconds * gpus * 1e12)).alias("tflops"), bandwidth.alias("bandwidth"))
