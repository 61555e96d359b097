"""Equi-joins that split hot keys by counts instead of trusting their spread."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY_KEYS = 1000
FEW_ROWS = 200


def join_counted(big: DataFrame, small: DataFrame, keys: str | Sequence[str], count: str, total: int,
                 how: str = "left") -> DataFrame:
    """``big`` joined with ``small``, which has each key once and in ``count`` its number of rows in ``big``.

    A key with more than ``total / HEAVY_KEYS`` rows (``FEW_ROWS`` at least) is
    heavy; as the rows of different keys are different rows, there are at most
    ``HEAVY_KEYS`` of them (``total``: the rows of ``big``), so they are
    broadcast and their rows stay where they are.  Only the others are
    shuffled, or all where no key is heavy.  Both tables are read several
    times: they should be stored or cheap to make.  ``how`` is ``left`` or ``inner``.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    heavy = F.col(count) > max(FEW_ROWS, total // HEAVY_KEYS)
    few = small.filter(heavy).drop(count)
    if not few.limit(1).count():
        return big.join(small.drop(count), keys, how)
    few, rest = F.broadcast(few), small.filter(~heavy).drop(count)
    return (big.join(few, keys, "inner")
            .unionByName(big.join(few.select(*keys), keys, "left_anti").join(rest, keys, how)))
