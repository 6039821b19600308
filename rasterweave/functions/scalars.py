"""Scalar expressions shared by the operators; all stay inside generated JVM code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of modes, backends and log tags.
COMPUTE_MODES = ("by_row", "by_column", "by_pixel", "by_grid")
EXEC_MODES = ("normal", "queue", "mpi")
BACKENDS = ("CPU", "GPU")
LOG_TAGS = ("QPOP", "QPUSH", "READER", "WORKER", "WRITER")

Z_975 = 1.959963984540054
#: Degrees of freedom up to which quantiles are tabled.
TABLED = 200


def _t_inside(t: float, df: int) -> float:
    """P(-t < T < t), by the finite series for whole degrees of freedom."""
    angle = math.atan(t / math.sqrt(df))
    sine, square = math.sin(angle), math.cos(angle) ** 2
    odd = df % 2
    term = math.cos(angle) if odd else 1.0
    total = term if df > 1 else 0.0
    for k in range(2 + odd, df - 1, 2):
        term *= square * (k - 1) / k
        total += term
    return 2 / math.pi * (angle + sine * total) if odd else sine * total


def t_975(df: int) -> float:
    """The 0.975 quantile of Student's t, by bisection."""
    low, high = 1.0, 20.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if _t_inside(middle, df) < 0.95 else (low, middle)
    return (low + high) / 2


T_975 = tuple(t_975(df) for df in range(1, TABLED + 1))


def to_byte(acc: Column, factor: float, bias: float) -> Column:
    """``clamp(round(acc * factor + bias))`` with halves away from zero, as int."""
    scaled = F.round(acc.cast("double") * F.lit(factor) + F.lit(bias))
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), scaled)).cast("int")


def to_byte_truncated(acc: Column, factor: float, bias: float) -> Column:
    """The variant of device kernels: clamp and truncate without rounding."""
    scaled = acc.cast("double") * F.lit(factor) + F.lit(bias)
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), scaled))).cast("int")


def clamp_index(index: Column, size: Column) -> Column:
    return F.greatest(F.lit(0), F.least(size - 1, index))


def wrap_index(index: Column, size: Column) -> Column:
    return F.pmod(index, size)


def image_memory_mb(width: Column, height: Column, bits: int = 24, struct_bytes: int = 64, pointer_bytes: int = 8) -> Column:
    """Estimated MiB an image takes in a queue: pixels, row pointers and struct, rounded up, plus one."""
    total = (width * height * bits / 8) + F.lit(struct_bytes) + height * pointer_bytes + 1
    return (F.ceil(total / (1024 * 1024)) + 1).cast("long")


def elapsed_label(seconds: Column) -> Column:
    """``mm:ss.cc`` of a duration in seconds."""
    whole = F.floor(seconds)
    return F.format_string("%02d:%02d.%02d", F.floor(whole / 60), whole % 60, F.floor((seconds - whole) * 100))


def t_quantile(df: Column) -> Column:
    """0.975 quantile of Student's t; null below one degree of freedom."""
    z = Z_975
    terms = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)
    far = F.lit(z)
    for k, term in enumerate(terms, 1):
        far = far + F.lit(term) / F.pow(df.cast("double"), F.lit(float(k)))
    table = F.array(*[F.lit(t) for t in T_975])
    return F.when(df < 1, None).when(df <= len(T_975), F.element_at(table, F.greatest(F.lit(1), F.least(F.lit(len(T_975)), df.cast("int"))))).otherwise(far)


def ci95_half_width(value: Column) -> Column:
    """Aggregate: half-width of the 95 % t interval of the mean; 0 for fewer than two values."""
    n = F.count(value)
    return F.when(n < 2, 0.0).otherwise(t_quantile(n - 1) * F.stddev_samp(value) / F.sqrt(n.cast("double")))
