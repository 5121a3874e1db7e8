"""Schedules, weights, counting rules and other closed formulas, as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unit_grid(i: Column, n: int) -> Column:
    """Place of index ``i`` on ``n`` even points of [0, 1]."""
    return i / float(max(1, n - 1))


def karras(i: Column, n: int, low: float, high: float, rho: float = 7.0, pinned: bool = True) -> Column:
    """Descending noise levels, even in the ``rho``-th root; the ends are exact if ``pinned``."""
    if n < 2:
        return F.lit(float(high))
    a, b = high ** (1 / rho), low ** (1 / rho)
    level = F.pow(F.lit(a) + unit_grid(i, n) * (b - a), F.lit(rho))
    return F.when(i == 0, float(high)).when(i == n - 1, float(low)).otherwise(level) if pinned else level


def log_uniform(u: Column, low: float, high: float) -> Column:
    return F.exp(F.lit(math.log(low)) + u * (math.log(high) - math.log(low)))


def log_normal(u: Column, low: float, high: float, mean: float, spread: float) -> Column:
    """Even steps of the standardised logarithm between the ends."""
    z0, z1 = (math.log(low) - mean) / spread, (math.log(high) - mean) / spread
    return F.exp(F.lit(mean) + spread * (F.lit(z0) + u * (z1 - z0)))


def blend(a: Column, b: Column, alpha: float) -> Column:
    return (1 - alpha) * a + alpha * b


def loss_weight(sigma: Column, data: float) -> Column:
    return (sigma * sigma + data * data) / (sigma * sigma * data * data)


def churn(sigma: Column, amount: float, steps: int, low: float, high: float) -> Column:
    """``struct<gamma, raised, added>``: noise added inside the window, nothing outside."""
    gamma = F.when((sigma >= low) & (sigma <= high), F.least(F.lit(amount / steps), F.lit(math.sqrt(2) - 1))).otherwise(F.lit(0.0))
    raised = sigma * (1 + gamma)
    return F.struct(gamma.alias("gamma"), raised.alias("raised"), F.sqrt(F.greatest(raised * raised - sigma * sigma, F.lit(0.0))).alias("added"))


def churn_amount(gamma: Column, evaluations: Column) -> Column:
    return gamma * F.greatest(F.lit(1), evaluations - 1)


def ramp(step: Column, warm: int, transition: int, most: float) -> Column:
    """Nothing while warming up, then linear, then ``most``; within [0, 1]."""
    part = F.least((step - warm) / float(max(1, transition)), F.lit(1.0))
    return F.when(step < warm, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(part * most, F.lit(1.0))))


def warm_cosine(step: Column, warm: int, total: int, peak: float, floor: float = 0.0, ahead: int = 0) -> Column:
    """Linear warm-up, then a half cosine down to ``floor``; ``ahead`` counts steps taken before use."""
    part = F.least(F.greatest((step + ahead - warm) / float(max(1, total - warm)), F.lit(0.0)), F.lit(1.0))
    return F.when(step < warm, peak * (step + 1) / float(max(1, warm))).otherwise(floor + (peak - floor) * 0.5 * (1 + F.cos(part * math.pi)))


# Sampler names by how many evaluations a step takes.
TWO_STAGE = ("heun", "heun_karras", "karras")
ONE_STAGE = ("ddim", "ddim_karras", "ddim_entropic", "entropic", "euler")
FINAL_STEP = ("tweedie", "tweedie_tau", "tweedie_tau_leaping", "euler", "euler_rate")


def evaluations_per_step(sampler: Column, conditioned: Column, refined: Column) -> Column:
    extra = (conditioned & refined).cast("int")
    return F.when(sampler.isin(*TWO_STAGE), 2 + extra).when(sampler.isin(*ONE_STAGE), 1 + extra).otherwise(F.lit(1))


def evaluations(framework: Column, sampler: Column, steps: Column, conditioned: Column, refined: Column, final: Column) -> Column:
    """Model evaluations that a run takes; ``final``: one more for probabilities."""
    continuous = evaluations_per_step(sampler, conditioned, refined) * steps + final.cast("int")
    discrete = steps + sampler.isin(*FINAL_STEP).cast("int")
    return F.when(F.startswith(framework, F.lit("continuous")), continuous).when(F.startswith(framework, F.lit("discrete")), discrete).otherwise(steps)


def steps_for(framework: Column, sampler: Column, target: Column, conditioned: Column, refined: Column, final: Column) -> Column:
    """Most steps whose evaluations stay within the target, one at least."""
    per = evaluations_per_step(sampler, conditioned, refined)
    discrete = F.greatest(F.lit(1), target - sampler.isin(*FINAL_STEP).cast("int"))
    continuous = F.greatest(F.lit(1), F.floor(F.greatest(target - final.cast("int"), F.lit(1)) / per).cast("int"))
    return F.when(F.startswith(framework, F.lit("discrete")), discrete).otherwise(continuous)


def loglinear_noise(t: Column, eps: float = 1e-3) -> Column:
    return -F.log1p(-(1 - eps) * t)


def loglinear_rate(t: Column, eps: float = 1e-3) -> Column:
    return (1 - eps) / (1 - (1 - eps) * t)


def geometric_noise(t: Column, low: float, high: float) -> Column:
    return F.pow(F.lit(low), 1 - t) * F.pow(F.lit(high), t)


def geometric_rate(t: Column, low: float, high: float) -> Column:
    return geometric_noise(t, low, high) * math.log(high / low)


def uniform_transition(noise: Column, size: int) -> Column:
    """``struct<stay, change>`` of a symbol under uniform replacement."""
    kept = F.exp(-noise)
    return F.struct((kept + (1 - kept) / size).alias("stay"), ((1 - kept) / size).alias("change"))


def absorbing_transition(noise: Column) -> Column:
    return F.struct(F.exp(-noise).alias("stay"), (1 - F.exp(-noise)).alias("mask"))


def endpoint_divergence(noise: Column, size: int, absorbing: bool) -> Column:
    """Divergence of a position's end distribution from the prior, in nats."""
    kept = F.exp(-noise)
    if absorbing:
        return kept * math.log(size - 1)
    other = (1 - kept) / size
    same = kept + other
    return same * F.log(same * size) + (size - 1) * other * F.log(other * size)


def matched_filter(x: Column, sigma: Column) -> Column:
    return 1 / (1 + F.exp(-(x - 0.5) / (sigma * sigma)))


@F.pandas_udf(T.DoubleType())
def bit_error_rate(sigma: pd.Series) -> pd.Series:
    """Error rate of thresholding one bit under Gaussian noise; Spark has no erfc."""
    known, at = np.unique(sigma.to_numpy(np.float64), return_inverse=True)  # the levels of a schedule repeat
    rates = np.array([0.5 * math.erfc(0.5 / (s * math.sqrt(2))) if s > 0 else 0.0 for s in known.tolist()])
    return pd.Series(rates[at] if len(known) else np.zeros(0))


def gate(sigma: Column, centre: float, power: float) -> Column:
    x = F.pow(F.greatest(sigma, F.lit(1e-12)) / max(centre, 1e-12), F.lit(power))
    return x / (1 + x)


def log_bin(sigma: Column, low: float, high: float, bins: int) -> Column:
    """Index of the bin, even in the logarithm and closed above, that a clamped value falls into."""
    width = (math.log(high) - math.log(low)) / bins
    x = F.log(F.greatest(F.lit(low), F.least(sigma, F.lit(high))))
    return F.greatest(F.lit(0), F.least(F.ceil((x - math.log(low)) / width).cast("int") - 1, F.lit(bins - 1)))


def worker_seed(base: Column, rank: Column, stride: int) -> Column:
    return base + rank * stride


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column, eps: float = 1e-8) -> Column:
    return F.transform(a, lambda x: x.cast("double") / (norm(a) + eps))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def masked_mean(values: Column, mask: Column) -> Column:
    """Weighted mean with weights summed to 1 at least."""
    total = F.aggregate(F.zip_with(values, mask, lambda v, w: v * w), F.lit(0.0), lambda s, x: s + x)
    return total / F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, x: s + x), F.lit(1.0))


def log_sum_exp(scores: Column) -> Column:
    """Logarithm of the summed exponentials of an array, with its largest entry taken out; an empty one: null."""
    top = F.array_max(scores)
    return top + F.log(F.aggregate(F.transform(scores, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x))


def softmax(scores: Column, temperature: float = 1.0) -> Column:
    """Probabilities of an array of scores; a temperature near zero is taken as a millionth."""
    scaled = F.transform(scores, lambda x: x / max(temperature, 1e-6))
    return F.transform(F.array(scaled), lambda a: F.transform(a, lambda x: F.exp(x - log_sum_exp(a))))[0]


def keep_top(scores: Column, k: int) -> Column:
    """Scores that reach the ``k``-th largest, ties included; the others become a very low one."""
    least = F.try_element_at(F.sort_array(scores, asc=False), F.least(F.lit(k), F.size(scores)))
    return F.transform(scores, lambda x: F.when(x < least, F.lit(-1e10)).otherwise(x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def binary_cross_entropy(logit: Column, target: Column) -> Column:
    """In nats, from the logit, without overflow at either end."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def squared_error(x: Column, y: Column) -> Column:
    return (x - y) * (x - y)
