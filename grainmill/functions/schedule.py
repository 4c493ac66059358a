"""Closed formulas: learning rates, sizes, costs, number formats, activations."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def learning_rate(step: Column, peak: float, floor: float, warmup: int, decay_start: int, decay: int, style: str, warmup_style: str = "linear") -> Column:
    """Warm-up, plateau, decay, floor."""
    done = (step - decay_start) / F.lit(float(decay or 1))
    shapes = {"cosine": (1 + F.cos(math.pi * done)) / 2, "linear": 1 - done, "1-sqrt": 1 - F.sqrt(F.greatest(done, F.lit(0.0)))}
    if style not in shapes or warmup_style not in ("linear", "constant"):
        raise ValueError(f"{style}, {warmup_style}")
    if warmup == 0 and decay == 0:
        return F.lit(peak)
    rising = peak * step / max(warmup, 1) if warmup_style == "linear" else F.lit(peak)
    return F.when(step <= warmup, rising).when(step < decay_start, F.lit(peak)).when(step < decay_start + decay, floor + (peak - floor) * shapes[style]).otherwise(F.lit(floor))


def model_flops(layers: Column, hidden: Column, heads: Column, kv_heads: Column, vocab: Column, length: Column, ffn: Column, batch: Column) -> Column:
    """Floating-point operations of a step: forward, and twice that backward."""
    per_token = layers * (2 * hidden * (hidden + 2 * kv_heads * F.floor(hidden / heads)) + 4 * length * hidden + 2 * hidden * hidden + 6 * hidden * ffn)
    return 3.0 * batch * length * (per_token + 2 * hidden * vocab)


def parameters(layers: Column, hidden: Column, heads: Column, kv_heads: Column, vocab: Column, ffn: Column, tied: Column) -> Column:
    embedding = vocab * hidden * F.when(tied, 1).otherwise(2)
    return embedding + layers * (3 * hidden * ffn + (2 + 2 * kv_heads / heads) * hidden * hidden)


def block_cost(heads: Column, d_qkv: Column, hidden: Column, ffn: Column) -> Column:
    return 4 * heads * d_qkv * hidden + 3 * ffn * hidden


def padded_vocab(vocab: Column, divisible_by: int, ranks: int) -> Column:
    unit = divisible_by * ranks
    return (F.ceil(vocab / unit) * unit).cast("long")


def human_format(x: Column, base: float = 1000.0) -> Column:
    """Three significant digits and a unit: 1234 as 1.23K. The unit letters."""
    x = x.cast("double")
    size = F.floor(F.log10(F.greatest(F.abs(x), F.lit(1e-300))) + 1e-12)
    unit = F.pow(F.lit(10.0), 2 - size)
    kept = F.round(x * unit) / unit
    power = F.lit(0)
    for i in range(1, 7):
        power = F.when(F.abs(kept) >= 1000 * base ** (i - 1), i).otherwise(power)
    number = F.round(kept / F.pow(F.lit(base), power), 6)
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", number), "0+$", ""), r"\.$", "")
    small = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", F.round(kept, 6)), "0+$", ""), r"\.$", "")
    return F.when(F.abs(x) < 1, small).otherwise(F.concat(text, F.element_at(F.array(*(F.lit(u) for u in ("", "K", "M", "B", "T", "P", "E"))), power + 1)))


def size_format(n: Column) -> Column:
    """Bytes in the largest unit of 1024, two decimals. The units' names."""
    out, unit = None, ["B", "KB", "MB", "GB", "TB"]
    for i in reversed(range(len(unit))):
        text = F.format_string("%.2f" + unit[i], F.round(n / F.lit(1024.0**i), 2))
        out = text if out is None else F.when(n < 1024.0 ** (i + 1), text).otherwise(out)
    return out


def mup_rate(rate: float, kind: Column, fan_in: Column, fan_out: Column, ranks: int) -> Column:
    """Spectral learning rate; the sharded side is counted over all ranks."""
    column, row = rate * fan_out * ranks / fan_in, rate * fan_out / (fan_in * ranks)
    return F.when(kind == "column", column).when(kind == "row", row).otherwise(F.lit(rate))


def spectral_std(std: float, fan_in: Column, fan_out: Column) -> Column:
    return std / F.sqrt(fan_in) * F.least(F.lit(1.0), F.sqrt(fan_out / fan_in))


def init_scale(method: Column, layers: Column) -> Column:
    """By name; scaling by a layer's index or the model's size is planned, not defined."""
    undefined = F.raise_error(F.concat(F.lit("no init scale is defined for "), method)).cast("double")
    return F.when(method == "NUM_LAYERS", F.sqrt(2.0 * layers)).when(method == "NONE", F.lit(1.0)).otherwise(undefined)


def fp8_scale(amax: Column, scale: Column, most: float, margin: float = 0.0) -> Column:
    """The power of two that brings amax under the type's maximum; the old scale
    where amax is not positive or not finite."""
    finite = (amax > 0) & ~F.isnan(amax) & (amax < float("inf"))
    exponent = F.floor(F.log2(F.lit(most) / amax)) - margin
    fresh = F.pow(F.lit(2.0), F.abs(exponent))
    return F.when(~finite, scale).when(exponent < 0, 1 / fresh).otherwise(fresh)


def activations(x: Column) -> dict[str, Column]:
    """The constants of the published definitions."""
    sigmoid = lambda v: 1 / (1 + F.exp(-v))
    gelu_tanh = 0.5 * x * (1 + F.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x * x * x)))
    return {
        "gelu_tanh": gelu_tanh, "gelu_fast": 0.5 * x * (1 + F.tanh(x * 0.7978845608 * (1 + 0.044715 * x * x))), "quick_gelu": x * sigmoid(1.702 * x),
        "clipped_gelu": F.greatest(F.least(gelu_tanh, F.lit(1.0)), F.lit(-0.1)), "silu": x * sigmoid(x), "mish": x * F.tanh(F.log1p(F.exp(x))), "linear": x,
        "relu_squared": F.pow(F.greatest(x, F.lit(0.0)), 2), "gelu": 0.5 * x * (1 + erf(x / math.sqrt(2))), "laplace": 0.5 * (1 + erf((x - 0.707107) / (0.282095 * math.sqrt(2)))),
    }


def erf(x: Column) -> Column:
    """Error function by a rational approximation of absolute error below 2e-7.

    Fixed values: Abramowitz and Stegun 7.1.26."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def gbps(n_bytes: Column, seconds: Column) -> Column:
    return n_bytes * 8 / seconds / 1e9


def throughput(sequences: Column, length: int, seconds: Column, devices: int, steps_left: Column) -> dict[str, Column]:
    """Rates of a step of so many sequences, and the time that the steps left take."""
    rate = sequences * length / seconds
    return {"tokens_per_s": rate, "per_gpu": rate / devices, "eta_s": steps_left * seconds}
