"""Deterministic per-row randomness from an md5 of ``id:seed``.

The same expression runs in Spark and in DuckDB, so splits and samples are
reproducible anywhere and do not depend on partitioning or task order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["hash_key", "hash_u", "hash_u52", "hash_bit", "hash_beta", "BETA_TRIES"]

#: Pairs of uniforms that a Beta draw may use up; all are refused once in 10^18 draws or more rarely.
BETA_TRIES = 96


def hash_key(id_col, seed) -> Column:
    """md5 hex of ``concat_ws(':', id, seed)`` — a sort key."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat_ws(":", c.cast("string"), F.lit(str(seed))))


def hash_u(id_col, seed) -> Column:
    """Uniform [0,1) from the first 8 hex digits of the md5 key."""
    return F.conv(F.substring(hash_key(id_col, seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_u52(id_col, seed) -> Column:
    """Uniform (0, 1), never 0, from the first 13 hex digits of the md5 key."""
    return (F.conv(F.substring(hash_key(id_col, seed), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4503599627370496.0)


def hash_bit(id_col, seed, modulo: int = 2) -> Column:
    """Small integer in [0, modulo) from the md5 key."""
    return (F.conv(F.substring(hash_key(id_col, seed), 1, 8), 16, 10).cast("long") % F.lit(modulo)).cast("int")


def hash_beta(id_col, seed, alpha: float) -> Column:
    """A draw from Beta(alpha, alpha), by rejection over hashed uniforms.

    Try ``t`` takes two uniforms from the keys ``seed:t:0`` and ``seed:t:1``.
    Up to alpha 1 their powers ``u^(1/alpha), v^(1/alpha)`` are taken if they add
    up to 1 or less, and the draw is the first's share of the sum; above, ``u``
    is taken if ``v <= (4 u (1 - u))^(alpha - 1)``.  No try after the one that
    holds is computed; if none does the draw is 1/2."""
    alpha = float(alpha)
    if alpha <= 0:
        raise ValueError("alpha must be positive")
    c = F.col(id_col) if isinstance(id_col, str) else id_col

    def uniform(t: Column, part: int) -> Column:
        key = F.md5(F.concat_ws(":", c.cast("string"), F.lit(str(seed)), t.cast("string"), F.lit(str(part))))
        return (F.conv(F.substring(key, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4503599627370496.0)

    def accepted(z: Column) -> Column:
        if alpha <= 1:
            x, y = F.pow(z["u"], F.lit(1 / alpha)), F.pow(z["v"], F.lit(1 / alpha))
            return F.when(x + y <= 1, x / (x + y))
        return F.when(z["v"] <= F.pow(4 * z["u"] * (1 - z["u"]), F.lit(alpha - 1)), z["u"])

    def step(found: Column, t: Column) -> Column:
        pair = F.struct(uniform(t, 0).alias("u"), uniform(t, 1).alias("v"))
        return F.when(found.isNotNull(), found).otherwise(F.element_at(F.transform(F.array(pair), accepted), 1))

    none = F.lit(None).cast("double")
    return F.coalesce(F.aggregate(F.sequence(F.lit(0), F.lit(BETA_TRIES - 1)), none, step), F.lit(0.5))
