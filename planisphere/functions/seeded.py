"""Portable seeded randomness: the same draw in Spark, SQL and numpy.

``u01(seed, key)`` is the first 32 bits of md5("seed:key") divided by 2^32, so a
draw depends on nothing but its key and survives re-execution of a lost task.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def _joined(parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws(":", *[c.cast("string") for c in cols])


def hash_order(seed, *key) -> Column:
    """Text whose ascending order is a seeded shuffle."""
    return F.md5(_joined([seed, *key]))


def u01(seed, *key) -> Column:
    """Uniform draw in [0, 1)."""
    return F.conv(F.substring(hash_order(seed, *key), 1, 8), 16, 10).cast("bigint") / F.lit(TWO32)


def normal(seed, *key) -> Column:
    """Standard normal draw (Box-Muller on two uniforms)."""
    a, b = u01(seed, *key, "a"), u01(seed, *key, "b")
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - a)) * F.cos(F.lit(2.0 * math.pi) * b)


def u01_value(seed, *key) -> float:
    text = ":".join(str(p) for p in (seed, *key))
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / TWO32


def normal_value(seed, *key) -> float:
    a, b = u01_value(seed, *key, "a"), u01_value(seed, *key, "b")
    return math.sqrt(-2.0 * math.log(1.0 - a)) * math.cos(2.0 * math.pi * b)


def normal_matrix(seed, rows: int, cols: int) -> np.ndarray:
    """A parameter-sized matrix of normal draws keyed ``row:col``."""
    return np.array([[normal_value(seed, r, c) for c in range(cols)] for r in range(rows)])
