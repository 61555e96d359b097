"""Seeded, partition-independent randomness as plain SQL expressions.

Every draw is a function of (seed, key, epoch, tag) only, so a result never
depends on how Spark split or ordered the data, and DuckDB can compute the
same numbers:

* order key  ``md5('<seed>:<key>')``, ties broken by the key itself;
* uniform    ``conv(substr(md5(concat_ws(':', seed, key, epoch, tag)), 1, 8), 16, 10) / 2^32``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..util import as_col

TWO_POW_32 = 4294967296.0


def order_hash(seed, *keys) -> Column:
    """Hex md5 of ``seed:key[:key...]``; sort by it (then by key) for a seeded shuffle."""
    parts = [F.lit(str(seed))] + [as_col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts))


def uniform(seed, key, epoch=0, tag: str = "") -> Column:
    """U(seed, key, epoch, tag) in [0, 1), from the first 32 bits of an md5."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), as_col(key).cast("string"),
                          F.lit(str(epoch)), F.lit(tag)))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(TWO_POW_32)


def uniform_between(lo: float, hi: float, seed, key, epoch=0, tag: str = "") -> Column:
    return F.lit(float(lo)) + uniform(seed, key, epoch, tag) * F.lit(float(hi) - float(lo))
