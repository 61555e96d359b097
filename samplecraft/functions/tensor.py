"""Element-wise tensor expressions (I2-I5) over the tensor struct.

A tensor is ``STRUCT<height INT, width INT, channels INT, data ARRAY<FLOAT>>``,
HWC order, RGB channels.  Index maths runs as Catalyst lambdas; pixel
gathers that need neighbourhoods (resize, rotate, crop, jitter) live in
``operators.tensors`` as Arrow-batched NumPy steps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..util import as_col

# ImageNet channel statistics used by the source pipeline's normalise step.
IMAGENET_MEAN = (0.485, 0.456, 0.406)
IMAGENET_STD = (0.229, 0.224, 0.225)


def make_tensor(height, width, channels, data) -> Column:
    return F.struct(
        as_col(height).cast("int").alias("height"),
        as_col(width).cast("int").alias("width"),
        as_col(channels).cast("int").alias("channels"),
        as_col(data).cast("array<float>").alias("data"),
    )


def _with_data(t: Column, data: Column) -> Column:
    """Same shape, new data; a NULL tensor stays NULL."""
    return F.when(t.isNotNull(), make_tensor(t["height"], t["width"], t["channels"], data))


def to_unit(tensor) -> Column:
    """8-bit values -> float in 0..1."""
    t = as_col(tensor)
    return _with_data(t, F.transform(t["data"], lambda x: x / F.lit(255.0)))


def _per_channel(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def normalize(tensor, mean: Sequence[float] = IMAGENET_MEAN, std: Sequence[float] = IMAGENET_STD) -> Column:
    """``(x - mean[c]) / std[c]`` with c = flat index mod channels."""
    t = as_col(tensor)
    m, s = _per_channel(mean), _per_channel(std)
    nch = F.lit(len(mean))
    return _with_data(t, F.transform(
        t["data"],
        lambda x, i: (x - F.element_at(m, F.pmod(i, nch) + 1)) / F.element_at(s, F.pmod(i, nch) + 1)))


def denormalize(tensor, mean: Sequence[float] = IMAGENET_MEAN, std: Sequence[float] = IMAGENET_STD) -> Column:
    """I4: ``std[c] * x + mean[c]``, clipped to 0..1."""
    t = as_col(tensor)
    m, s = _per_channel(mean), _per_channel(std)
    nch = F.lit(len(mean))
    return _with_data(t, F.transform(
        t["data"],
        lambda x, i: F.least(F.greatest(
            F.element_at(s, F.pmod(i, nch) + 1) * x + F.element_at(m, F.pmod(i, nch) + 1),
            F.lit(0.0)), F.lit(1.0))))


def hflip(tensor) -> Column:
    """Mirror every pixel row: out[y, x, c] = in[y, W-1-x, c]."""
    t = as_col(tensor)
    w, c = t["width"], t["channels"]
    def src(i):
        y = F.floor(i / (w * c))
        x = F.floor(F.pmod(i, w * c) / c)
        ch = F.pmod(i, c)
        return ((y * w + (w - 1 - x)) * c + ch).cast("int")
    return _with_data(t, F.transform(t["data"], lambda v, i: F.get(t["data"], src(i))))


def random_hflip(tensor, flip: Column) -> Column:
    """I5 core: flip where the boolean column ``flip`` is true."""
    t = as_col(tensor)
    return F.when(flip, hflip(t)).otherwise(t)
