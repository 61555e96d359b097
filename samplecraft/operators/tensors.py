"""Image tensor steps that gather pixels, run as Arrow-batched NumPy.

Every step runs here in NumPy; the element-wise ones (unit scale, normalise,
denormalise, flip) also exist as Catalyst column expressions
(``functions.tensor``) for pure-SQL use, but interpreted array lambdas are
several times slower than an Arrow batch through NumPy at real image sizes.  Randomness is
drawn as ordinary columns (``functions.draws``) before the Python stage, so
every draw depends only on (seed, key, epoch, tag).

A pipeline fuses each run of adjacent NumPy steps into a single
``mapInArrow`` call: one JVM -> Python -> JVM trip per run, the tensor kept
in float64 inside the run and written back as float32.  Neighbouring rows of
one shape go through each step in one NumPy call, and output batches are cut
by their bytes.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import tensor as TX
from ..functions.draws import uniform, uniform_between
from ..schemas import TENSOR
from ..session import ship_package
from ..util import unused_name

STACK_BYTES = 8 << 20    # float64 pixels that go through the steps together
OUTPUT_BYTES = 64 << 20  # float32 pixels of one output batch

# ----------------------------------------------------------------- kernels
# They take (N, H, W, C) float64 stacks; a single (H, W, C) image works as well.

@functools.lru_cache(maxsize=256)
def _resize_axis(n_in: int, n_out: int) -> tuple[np.ndarray, np.ndarray]:
    """(source index, weight) of every tap of every output place along one axis.

    A triangle filter over half-pixel centres.  When the axis shrinks, the
    triangle is widened by the scale, so every source pixel counts
    (antialiasing); taps outside the image are left out and the weights
    normalised.
    """
    scale = n_in / n_out
    wide = max(scale, 1.0)
    centre = (np.arange(n_out, dtype=np.float64) + 0.5) * scale
    lo = np.maximum(np.floor(centre - wide + 0.5), 0).astype(np.int64)
    hi = np.minimum(np.floor(centre + wide + 0.5), n_in).astype(np.int64)
    idx = lo[:, None] + np.arange(int((hi - lo).max()))
    w = np.maximum(1.0 - np.abs((idx - centre[:, None] + 0.5) / wide), 0.0)
    w[idx >= hi[:, None]] = 0.0
    total = np.zeros(n_out)
    for t in range(w.shape[1]):  # left to right, so that the sums can be checked against SQL
        total += w[:, t]
    return np.minimum(idx, n_in - 1), w / total[:, None]


def _filter_axis(x: np.ndarray, axis: int, n_out: int, levels: bool) -> np.ndarray:
    if x.shape[axis] == n_out:
        return x
    idx, w = _resize_axis(x.shape[axis], n_out)
    shape = [1] * x.ndim
    shape[axis] = n_out
    out = None
    for t in range(idx.shape[1]):
        part = np.take(x, idx[:, t], axis=axis)
        part *= w[:, t].reshape(shape)
        out = part if out is None else np.add(out, part, out=out)
    return whole_levels(out) if levels else out


def whole_levels(x: np.ndarray) -> np.ndarray:
    """8-bit image steps hand on whole levels: rounded half up, in 0..255."""
    return np.clip(np.floor(x + 0.5), 0.0, 255.0)


def resize_image(img: np.ndarray, out_h: int, out_w: int, levels: bool = False) -> np.ndarray:
    """Antialiased bilinear resize, aspect ratio ignored; first along the rows, then down.

    ``levels``: the image is 8-bit, each of the two passes gives whole levels.
    """
    return _filter_axis(_filter_axis(img, img.ndim - 2, out_w, levels), img.ndim - 3, out_h, levels)


@functools.lru_cache(maxsize=64)
def _centred_grid(h: int, w: int):
    yy, xx = np.meshgrid(np.arange(h, dtype=np.float64) - (h - 1) / 2.0,
                         np.arange(w, dtype=np.float64) - (w - 1) / 2.0, indexing="ij")
    return yy, xx


def rotate_image(img: np.ndarray, degrees, fill: float = 0.0) -> np.ndarray:
    """Rotate counter-clockwise about the centre; nearest pixel; same size; corners filled.

    ``degrees`` is one angle, or one per image of a stack.
    """
    stack = img if img.ndim == 4 else img[None]
    n, h, w = stack.shape[:3]
    t = np.broadcast_to(np.asarray(degrees, dtype=np.float64), (n,))
    cos_t = np.array([math.cos(math.radians(d)) for d in t])[:, None, None]
    sin_t = np.array([math.sin(math.radians(d)) for d in t])[:, None, None]
    cy, cx = (h - 1) / 2.0, (w - 1) / 2.0
    yy, xx = _centred_grid(h, w)
    # sx = floor(cx + xx cos - yy sin + 0.5), sy = floor(cy + xx sin + yy cos + 0.5), same operation order
    sx = np.floor(((xx * cos_t + cx) - yy * sin_t) + 0.5).astype(np.int64)
    sy = np.floor(((xx * sin_t + cy) + yy * cos_t) + 0.5).astype(np.int64)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = stack[np.arange(n)[:, None, None], np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)]
    out[~inside] = fill
    return out if img.ndim == 4 else out[0]


def crop_box(h: int, w: int, u_area: float, u_ratio: float, u_top: float, u_left: float,
             scale=(0.8, 1.0), ratio=(3 / 4, 4 / 3)):
    """Crop box from four uniforms: area share in ``scale``, log-uniform aspect in
    ``ratio``, sides rounded half up and clamped to the image, then a uniform
    position.  Returns (top, left, height, width)."""
    area = h * w * (scale[0] + u_area * (scale[1] - scale[0]))
    lo, hi = math.log(ratio[0]), math.log(ratio[1])
    ar = math.exp(lo + u_ratio * (hi - lo))
    cw = int(min(max(math.floor(math.sqrt(area * ar) + 0.5), 1), w))
    ch = int(min(max(math.floor(math.sqrt(area / ar) + 0.5), 1), h))
    top = int(math.floor(u_top * (h - ch + 1)))
    left = int(math.floor(u_left * (w - cw + 1)))
    return top, left, ch, cw


def _gray(img: np.ndarray, levels: bool) -> np.ndarray:
    """Grey level of each pixel; of 8-bit pixels a whole level, by the usual 16-bit fixed-point weights."""
    if img.shape[-1] != 3:
        return img[..., 0]
    if levels:
        return np.floor((img[..., 0] * 19595.0 + img[..., 1] * 38470.0 + img[..., 2] * 7471.0 + 32768.0) / 65536.0)
    g = img[..., 0] * 0.299
    g += img[..., 1] * 0.587
    g += img[..., 2] * 0.114
    return g


def jitter_image(img: np.ndarray, fb, fc, fs, max_value: float, levels: bool = False) -> np.ndarray:
    """Brightness, contrast, saturation blends (in that fixed order), each clipped.

    Contrast blends with the mean grey level (0.299 R + 0.587 G + 0.114 B),
    saturation with each pixel's grey level.  The mean of 8-bit data is a whole
    level; with ``levels`` each blend also gives whole levels, cut off as image
    blends do.  A factor is one number, or one per image of a stack.
    """
    def per_image(f):
        f = np.asarray(f, dtype=np.float64)
        return f.reshape(f.shape + (1,) * (img.ndim - 1)) if f.ndim else f

    def done(x):
        np.clip(x, 0.0, max_value, out=x)
        return np.floor(x, out=x) if levels else x

    def changes(f):
        return np.any(np.asarray(f) != 1.0)

    if changes(fb):
        img = done(img * per_image(fb))
    if changes(fc):
        m = np.mean(_gray(img, levels), axis=(-2, -1))
        if max_value == 255.0:  # 8-bit range: the grey mean is a whole level, rounded half up
            m = np.floor(m + 0.5)
        f = per_image(fc)
        out = f * img
        out += (1.0 - f) * per_image(m)
        img = done(out)
    if changes(fs) and img.shape[-1] == 3:
        g = _gray(img, levels)[..., None]
        f = per_image(fs)
        out = f * img
        out += (1.0 - f) * g
        img = done(out)
    return img


# ------------------------------------------------------------------- steps

@dataclass
class TensorStep:
    """One pipeline step.

    ``params`` are Catalyst columns computed before the Python stage (random
    draws).  ``kernel(stack, p)`` gets an (N, H, W, C) float64 stack and a dict
    of arrays with the N rows' parameter values; ``per_row`` kernels get one
    (H, W, C) image and its own values.  ``catalyst`` (optional) is the same
    step as a column expression.
    """
    name: str
    kernel: Callable[[np.ndarray, dict], np.ndarray]
    params: dict[str, Column] = field(default_factory=dict)
    catalyst: Callable[[Column], Column] | None = None
    per_row: bool = False


def numpy_step(fn: Callable[..., np.ndarray], name: str = "custom",
               params: dict[str, Column] | None = None) -> TensorStep:
    """Wrap a user function as a pipeline step.

    ``fn(img)`` or, with ``params`` (per-row columns, e.g. seeded draws),
    ``fn(img, p)`` gets an (H, W, C) float64 array and returns a new one; it
    runs inside the fused Arrow stage with its neighbours.
    """
    if params:
        return TensorStep(name, fn, params=dict(params), per_row=True)
    return TensorStep(name, lambda img, p: fn(img), per_row=True)


def resize(height: int, width: int, levels: bool = False) -> TensorStep:
    """I1 (``levels``: of 8-bit images, giving whole levels)."""
    return TensorStep("resize", lambda x, p: resize_image(x, height, width, levels))


def to_unit() -> TensorStep:
    """I2 (NumPy form; ``functions.tensor.to_unit`` is the Catalyst form)."""
    return TensorStep("unit", lambda x, p: x / 255.0, catalyst=TX.to_unit)


def normalize(mean: Sequence[float] = TX.IMAGENET_MEAN, std: Sequence[float] = TX.IMAGENET_STD) -> TensorStep:
    """I3."""
    m, s = np.asarray(mean, dtype=np.float64), np.asarray(std, dtype=np.float64)
    def kernel(x, p):
        out = x - m
        out /= s
        return out
    return TensorStep("normalize", kernel, catalyst=lambda t: TX.normalize(t, mean, std))


def denormalize(mean: Sequence[float] = TX.IMAGENET_MEAN, std: Sequence[float] = TX.IMAGENET_STD) -> TensorStep:
    """I4: ``std * x + mean``, clipped to 0..1 (to look at a normalised tensor)."""
    m, s = np.asarray(mean, dtype=np.float64), np.asarray(std, dtype=np.float64)
    return TensorStep("denormalize", lambda x, p: np.clip(s * x + m, 0.0, 1.0),
                      catalyst=lambda t: TX.denormalize(t, mean, std))


def random_hflip(p: float = 0.5, seed: int = 42, epoch: int = 0, key: str = "key") -> TensorStep:
    """Mirror with probability ``p``; the draw is U(seed, key, epoch, 'flip')."""
    flip = uniform(seed, key, epoch, "flip") < F.lit(float(p))

    def kernel(x, q):
        return np.where(np.asarray(q["flip"], bool)[:, None, None, None], x[:, :, ::-1, :], x)
    return TensorStep("flip", kernel, params={"flip": flip}, catalyst=lambda t: TX.random_hflip(t, flip))


def rotate(degrees: float) -> TensorStep:
    """Fixed-angle rotation (counter-clockwise, nearest pixel, zero fill)."""
    return TensorStep("rotate", lambda x, p: rotate_image(x, degrees))


def random_rotate(degrees: float, seed: int = 42, epoch: int = 0, key: str = "key") -> TensorStep:
    """Angle uniform in [-degrees, degrees], drawn as U(seed, key, epoch, 'rotate')."""
    angle = uniform_between(-degrees, degrees, seed, key, epoch, "rotate")
    return TensorStep("rotate", lambda x, p: rotate_image(x, p["angle"]), params={"angle": angle})


def random_resized_crop(size: int, scale=(0.8, 1.0), ratio=(3 / 4, 4 / 3), seed: int = 42,
                        epoch: int = 0, key: str = "key", levels: bool = False) -> TensorStep:
    """Random crop (area share ``scale``, aspect ``ratio``) resized to ``size`` x ``size``."""
    draws = {t: uniform(seed, key, epoch, "crop_" + t) for t in ("area", "ratio", "top", "left")}

    def kernel(x, p):
        boxes = [crop_box(x.shape[1], x.shape[2], *u, scale, ratio)
                 for u in zip(p["area"], p["ratio"], p["top"], p["left"])]
        out = np.empty((len(x), size, size, x.shape[3]))
        for n, (top, left, ch, cw) in enumerate(boxes):  # each image has its own box
            out[n] = resize_image(x[n, top:top + ch, left:left + cw], size, size, levels)
        return out
    return TensorStep("crop", kernel, params=draws)


def color_jitter(brightness: float = 0.2, contrast: float = 0.2, saturation: float = 0.2,
                 seed: int = 42, epoch: int = 0, key: str = "key", max_value: float = 255.0,
                 levels: bool = False) -> TensorStep:
    """I8: factors uniform in [1 - x, 1 + x], drawn per row; applied b, c, s."""
    def factor(x, tag):
        return uniform_between(1.0 - x, 1.0 + x, seed, key, epoch, tag) if x else F.lit(1.0)
    params = {"b": factor(brightness, "brightness"), "c": factor(contrast, "contrast"),
              "s": factor(saturation, "saturation")}
    return TensorStep("jitter", lambda x, p: jitter_image(x, p["b"], p["c"], p["s"], max_value, levels),
                      params=params)


# ---------------------------------------------------------------- execution

def _read_tensors(tcol, n):
    """Per-row (H, W, C) float64 arrays from a tensor struct column; None when a row is NULL or is no tensor: a side
    that is missing or not positive, another number of values than H x W x C, or a NULL among them."""
    hs, ws, cs = (tcol.field(k).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                  for k in ("height", "width", "channels"))
    data = tcol.field("data")
    offsets = data.offsets.to_numpy().astype(np.int64)
    holes = np.zeros(len(data.values) + 1, np.int64)
    if data.values.null_count:
        np.cumsum(np.asarray(data.values.is_null().to_numpy(zero_copy_only=False)), out=holes[1:])
    values = data.values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    valid = np.asarray(tcol.is_valid().to_numpy(zero_copy_only=False), dtype=bool) \
        & np.asarray(data.is_valid().to_numpy(zero_copy_only=False), dtype=bool) \
        & (np.minimum(np.minimum(hs, ws), cs) > 0) & (np.diff(offsets) == hs * ws * cs) \
        & (holes[offsets[1:]] == holes[offsets[:-1]])
    for r in range(n):
        if not valid[r]:
            yield None
            continue
        yield values[offsets[r]:offsets[r + 1]].reshape(int(hs[r]), int(ws[r]), int(cs[r]))


def _read_images(icol, n):
    """Per-row RGB (H, W, 3) float64 arrays from Spark's image struct (8-bit BGR(A) or
    gray bytes); undecodable rows (height -1, short data) give None."""
    hs = icol.field("height").to_numpy(zero_copy_only=False)
    ws = icol.field("width").to_numpy(zero_copy_only=False)
    cs = icol.field("nChannels").to_numpy(zero_copy_only=False)
    data = icol.field("data")
    bufs = data.buffers()
    offs = np.frombuffer(bufs[1], dtype=np.int32)[data.offset:data.offset + len(data) + 1]
    raw = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    ok = np.asarray(icol.is_valid().to_numpy(zero_copy_only=False), dtype=bool) \
        & np.asarray(data.is_valid().to_numpy(zero_copy_only=False), dtype=bool)
    for r in range(n):
        if not ok[r]:  # NULL image (e.g. no file for this row): its fields are undefined
            yield None
            continue
        h, w, c = int(hs[r]), int(ws[r]), int(cs[r])
        if h <= 0 or w <= 0 or c <= 0 or offs[r + 1] - offs[r] != h * w * c:
            yield None
            continue
        a = raw[offs[r]:offs[r + 1]].reshape(h, w, c)
        a = np.repeat(a, 3, axis=2) if c == 1 else a[..., 2::-1]  # BGR(A) -> RGB, alpha dropped
        yield a.astype(np.float64)


def usable_tensor(df: DataFrame, tensor_col: str = "tensor") -> F.Column:
    """Can the steps read this row's tensor (or raw image)?  The rows for which not come out of them as NULL."""
    t = F.col(tensor_col)
    if _is_image_struct(df.schema[tensor_col].dataType):
        sides, size, holes = ("height", "width", "nChannels"), F.octet_length(t["data"]), F.lit(False)
    else:
        sides, size, holes = ("height", "width", "channels"), F.size(t["data"]), F.exists(t["data"], lambda v: v.isNull())
    h, w, c = (t[k].cast("long") for k in sides)
    return F.coalesce(t.isNotNull() & (F.least(h, w, c) > 0) & (size == h * w * c) & ~holes, F.lit(False))


def tensor_report(df: DataFrame, tensor_col: str = "tensor") -> DataFrame:
    """One row: (n, n_null, n_unusable), of the latter those that are there but cannot be read."""
    ok, there = usable_tensor(df, tensor_col), F.col(tensor_col).isNotNull()
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(~there).alias("n_null"), F.count_if(there & ~ok).alias("n_unusable"))


def _is_image_struct(dtype) -> bool:
    return isinstance(dtype, T.StructType) and "nChannels" in dtype.fieldNames()


def _apply(steps: list[tuple[Callable, bool]], images: list[np.ndarray], params: list[dict]) -> list[np.ndarray]:
    """All steps over images of one shape; images stay stacked for as long as they share a shape."""
    stack = np.stack(images)
    for at, ((kernel, per_row), p) in enumerate(zip(steps, params), 1):
        if per_row:
            rows = [kernel(img, {k: v[i] for k, v in p.items()}) for i, img in enumerate(stack)]
            if len({r.shape for r in rows}) > 1:  # from here on one by one
                return [_apply(steps[at:], [r], [{k: v[i:i + 1] for k, v in q.items()} for q in params[at:]])[0]
                        for i, r in enumerate(rows)]
            stack = np.stack(rows)
        else:
            stack = kernel(stack, p)
    return list(stack)


def _tensor_kernel(steps: list[TensorStep], tensor_col: str, param_cols: list[dict[str, str]], source: str,
                   stack_bytes: int, output_bytes: int):
    """Build the ``mapInArrow`` function applying ``steps`` to ``tensor_col``.

    ``source='image'`` reads Spark's raw image struct (uint8 bytes) and does
    the channel fix in the same pass, so pixels cross to Python as bytes.
    """
    kernels = [(s.kernel, s.per_row) for s in steps]  # ship plain functions, never Column objects
    reader = _read_images if source == "image" else _read_tensors
    own = {c for cols in param_cols for c in cols.values()}

    def results(rb) -> Iterator[tuple[int, np.ndarray | None]]:
        """(row, image or None) in row order."""
        params = [{nm: rb.column(rb.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                   for nm, c in cols.items()} for cols in param_cols]

        def run(rows, images):
            at = np.array(rows)
            done = _apply(kernels, images, [{k: v[at] for k, v in p.items()} for p in params])
            return list(zip(rows, done))

        rows, images, room = [], [], 1
        for r, img in enumerate(reader(rb.column(rb.schema.get_field_index(tensor_col)), rb.num_rows)):
            if images and (img is None or img.shape != images[0].shape or len(images) >= room):
                done = run(rows, images)
                # as many images at a time as fit, going by what one of them takes before or after the steps
                room = max(1, stack_bytes // max(1, images[0].nbytes, 8 * done[0][1].size))
                yield from done
                if img is None or img.shape != images[0].shape:
                    room = 1
                rows, images = [], []
            if img is None:
                yield r, None
            else:
                rows.append(r)
                images.append(img)
        if images:
            yield from run(rows, images)

    def batch(rb, lo: int, images: list):
        ok = np.array([i is not None for i in images], dtype=bool)
        shapes = np.array([i.shape if i is not None else (0, 0, 0) for i in images], dtype=np.int32).reshape(-1, 3)
        flat = [np.ascontiguousarray(i, dtype=np.float32).reshape(-1) for i in images if i is not None]
        offsets = np.concatenate([[0], np.cumsum([0 if i is None else i.size for i in images])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(
            np.concatenate(flat) if flat else np.zeros(0, dtype=np.float32)))
        struct = pa.StructArray.from_arrays([*(pa.array(shapes[:, k].copy()) for k in range(3)), lists],
                                            names=["height", "width", "channels", "data"], mask=pa.array(~ok))
        part = rb.slice(lo, len(images))
        names = [f.name for f in part.schema if f.name not in own]
        return pa.RecordBatch.from_arrays(
            [struct if n == tensor_col else part.column(part.schema.get_field_index(n)) for n in names], names=names)

    def run(batches):
        for rb in batches:
            lo, images, size = 0, [], 0
            for _, img in results(rb):
                more = 0 if img is None else 4 * img.size
                if images and size + more > output_bytes:
                    yield batch(rb, lo, images)
                    lo, images, size = lo + len(images), [], 0
                images.append(img)
                size += more
            if images:
                yield batch(rb, lo, images)
    return run


def apply_numpy_steps(df: DataFrame, steps: Sequence[TensorStep], tensor_col: str = "tensor",
                      stack_bytes: int = STACK_BYTES, output_bytes: int = OUTPUT_BYTES) -> DataFrame:
    """Run NumPy steps fused in one ``mapInArrow`` stage (no shuffle, same partitions).

    ``tensor_col`` may hold a tensor struct or Spark's raw image struct (from
    ``spark.read.format('image')``); the output column is always a tensor.
    """
    ship_package(df.sparkSession)
    source = "image" if _is_image_struct(df.schema[tensor_col].dataType) else "tensor"
    steps = list(steps)
    fields = [T.StructField(f.name, TENSOR if f.name == tensor_col else f.dataType, f.nullable)
              for f in df.schema.fields]
    param_cols: list[dict[str, str]] = []
    for k, step in enumerate(steps):
        cols = {}
        for nm, c in step.params.items():
            cols[nm] = unused_name(df, f"_p{k}_{nm}")
            df = df.withColumn(cols[nm], c)
        param_cols.append(cols)
    run = _tensor_kernel(steps, tensor_col, param_cols, source, stack_bytes, output_bytes)
    return df.mapInArrow(run, T.StructType(fields))


def apply_step(df: DataFrame, step: TensorStep, tensor_col: str = "tensor", prefer: str = "numpy") -> DataFrame:
    """One step on its own.

    NumPy by default: for real image sizes an Arrow batch through NumPy is
    several times faster than Catalyst's interpreted array lambdas (96x96x3:
    6 s against 30 s for unit scale + normalise over 10k tensors).
    ``prefer='catalyst'`` keeps a step that has a Catalyst form in the JVM.
    """
    if prefer == "catalyst" and step.catalyst is not None \
            and not _is_image_struct(df.schema[tensor_col].dataType):
        return df.withColumn(tensor_col, step.catalyst(F.col(tensor_col)))
    return apply_numpy_steps(df, [step], tensor_col)


def pipeline(df: DataFrame, steps: Sequence, tensor_col: str = "tensor") -> DataFrame:
    """Ordered composition of steps.

    A row whose tensor cannot be read (``usable_tensor``) gets NULL and stops
    nothing; ``tensor_report`` counts such rows.

    A step is a ``TensorStep`` or any ``DataFrame -> DataFrame`` callable.
    Each run of adjacent ``TensorStep``s executes as one fused NumPy stage.
    """
    run: list[TensorStep] = []

    def flush(d):
        if not run:
            return d
        d = apply_numpy_steps(d, run, tensor_col)
        run.clear()
        return d

    for step in steps:
        if isinstance(step, TensorStep):
            run.append(step)
        else:
            df = step(flush(df))
    return flush(df)


def eval_preset(size: int = 224, mean=TX.IMAGENET_MEAN, std=TX.IMAGENET_STD) -> list[TensorStep]:
    """Resize, unit scale, normalise."""
    return [resize(size, size, levels=True), to_unit(), normalize(mean, std)]


def train_preset(size: int = 224, seed: int = 42, epoch: int = 0, key: str = "key",
                 mean=TX.IMAGENET_MEAN, std=TX.IMAGENET_STD) -> list[TensorStep]:
    """Random resized crop, flip, rotate (15), colour jitter, unit scale, normalise."""
    return [random_resized_crop(size, seed=seed, epoch=epoch, key=key, levels=True),
            random_hflip(0.5, seed, epoch, key), random_rotate(15, seed, epoch, key),
            color_jitter(0.2, 0.2, 0.2, seed, epoch, key, levels=True), to_unit(), normalize(mean, std)]


def small_train_preset(size: int = 224, seed: int = 42, epoch: int = 0, key: str = "key",
                       mean=TX.IMAGENET_MEAN, std=TX.IMAGENET_STD) -> list[TensorStep]:
    """Resize, flip, rotate (10), unit scale, normalise (the small three-class run)."""
    return [resize(size, size, levels=True), random_hflip(0.5, seed, epoch, key), random_rotate(10, seed, epoch, key),
            to_unit(), normalize(mean, std)]
