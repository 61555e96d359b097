import numpy as np
from pyspark.sql import functions as F

from samplecraft.functions import tensor as TX
from samplecraft.operators import tensors as T


def tensors(spark, n=20, h=6, w=6, c=3, parts=3):
    rng = np.random.default_rng(0)
    rows = [(k, h, w, c, [float(v) for v in rng.integers(0, 256, h * w * c)]) for k in range(n)]
    df = spark.createDataFrame(rows, "key long, h int, w int, c int, d array<float>").repartition(parts)
    return df.select("key", TX.make_tensor("h", "w", "c", "d").alias("tensor"))


def as_np(df):
    out = {}
    for r in df.collect():
        t = r.tensor
        out[r.key] = np.array(t.data, dtype=np.float64).reshape(t.height, t.width, t.channels)
    return out


def test_normalize_then_denormalize_is_identity(spark):
    df = tensors(spark)
    unit = df.select("key", TX.to_unit("tensor").alias("tensor"))
    back = unit.select("key", TX.denormalize(TX.normalize("tensor")).alias("tensor"))
    a, b = as_np(unit), as_np(back)
    assert all(np.allclose(a[k], b[k], atol=1e-6) for k in a)


def test_flip_twice_is_identity_and_matches_numpy(spark):
    df = tensors(spark)
    once = df.select("key", TX.hflip("tensor").alias("tensor"))
    twice = once.select("key", TX.hflip("tensor").alias("tensor"))
    a, b, c = as_np(df), as_np(once), as_np(twice)
    assert all(np.array_equal(a[k], c[k]) for k in a)
    assert all(np.array_equal(a[k][:, ::-1, :], b[k]) for k in a)
    # NumPy form inside a fused stage agrees with the Catalyst form
    fused = as_np(T.apply_numpy_steps(df, [T.random_hflip(1.0, key="key"), T.resize(6, 6)]))
    assert all(np.array_equal(b[k], fused[k]) for k in a)


def test_resize_identity_and_block_means():
    img = np.arange(16, dtype=np.float64).reshape(4, 4, 1)
    assert np.array_equal(T.resize_image(img, 4, 4), img)
    line = np.zeros((1, 8, 1))
    line[0, 3] = 8.0  # inner weights of a halving: 1/8, 3/8, 3/8, 1/8
    assert np.allclose(T.resize_image(line, 1, 4)[0, :, 0], [0.0, 3.0, 1.0, 0.0])
    assert np.allclose(T.resize_image(np.full((7, 5, 2), 3.0), 3, 2), 3.0)
    assert np.array_equal(T.resize_image(np.array([[0.0, 3.0]]).reshape(1, 2, 1), 1, 1, levels=True)[0, 0], [2.0])
    up = T.resize_image(np.array([[0.0, 1.0]]).reshape(1, 2, 1), 1, 4)[0, :, 0]  # enlarging: plain bilinear
    assert np.allclose(up, [0.0, 0.25, 0.75, 1.0])


def test_rotate_quarter_turns():
    img = np.arange(25, dtype=np.float64).reshape(5, 5, 1)
    r = T.rotate_image(img, 90)
    assert np.array_equal(r[..., 0], np.rot90(img[..., 0], 1))  # counter-clockwise
    four = img
    for _ in range(4):
        four = T.rotate_image(four, 90)
    assert np.array_equal(four, img)
    r45 = T.rotate_image(img + 1, 45)
    assert r45[0, 0, 0] == 0  # corner filled


def test_crop_full_scale_equals_resize(spark):
    df = tensors(spark, h=8, w=8)
    crop = as_np(T.apply_step(df, T.random_resized_crop(4, scale=(1.0, 1.0), ratio=(1.0, 1.0), key="key")))
    res = as_np(T.apply_step(df, T.resize(4, 4)))
    assert all(np.allclose(crop[k], res[k]) for k in crop)
    box = T.crop_box(100, 100, 0.0, 0.5, 0.0, 1.0)
    assert box[2] * box[3] >= 0.79 * 10000 and box[0] == 0


def test_jitter_identity_and_ranges():
    img = np.full((2, 2, 3), 100.0)
    assert np.array_equal(T.jitter_image(img, 1.0, 1.0, 1.0, 255.0), img)
    assert np.allclose(T.jitter_image(img, 3.0, 1.0, 1.0, 255.0), 255.0)
    gray = np.stack([np.full((2, 2), v) for v in (10.0, 20.0, 30.0)], axis=2)
    flat = T.jitter_image(gray, 1.0, 1.0, 0.0, 255.0)
    assert np.allclose(flat[..., 0], flat[..., 1])  # saturation 0 -> gray


def test_pipeline_fused_equals_stepwise_and_partition_invariant(spark):
    df = tensors(spark, h=8, w=8, parts=2)
    steps = T.train_preset(4, seed=3, epoch=1, key="key")
    fused = as_np(T.pipeline(df, steps))
    one_by_one = df
    for s in T.train_preset(4, seed=3, epoch=1, key="key"):
        one_by_one = T.apply_numpy_steps(one_by_one, [s])
    stepwise = as_np(one_by_one)
    other = as_np(T.pipeline(tensors(spark, h=8, w=8, parts=5), T.train_preset(4, seed=3, epoch=1, key="key")))
    for k in fused:
        assert fused[k].shape == (4, 4, 3)
        assert np.allclose(fused[k], stepwise[k], atol=1e-5)
        assert np.array_equal(fused[k], other[k])


def test_pipeline_accepts_dataframe_steps_and_nulls(spark):
    df = tensors(spark, n=4)
    df = df.withColumn("tensor", F.when(F.col("key") == 0, F.lit(None)).otherwise(F.col("tensor")))
    out = T.pipeline(df, [T.resize(3, 3), lambda d: d.withColumn("x", F.lit(1)), T.to_unit()])
    rows = {r.key: r for r in out.collect()}
    assert rows[0].tensor is None and rows[1].tensor.height == 3 and rows[1].x == 1


def test_user_numpy_step_in_pipeline(spark):
    df = tensors(spark, n=6, h=4, w=4)
    out = as_np(T.pipeline(df, [T.numpy_step(lambda img: 255.0 - img, "invert"), T.resize(2, 2),
                                T.numpy_step(lambda img, p: img * p["k"], "scale",
                                             params={"k": F.col("key").cast("double")})]))
    src = as_np(df)
    for k, img in out.items():
        assert np.allclose(img, T.resize_image(255.0 - src[k], 2, 2) * k, atol=1e-3)


def test_numpy_and_catalyst_elementwise_steps_agree(spark):
    df = tensors(spark, n=8, h=5, w=4)
    for step in (T.to_unit(), T.normalize(), T.denormalize()):
        a = as_np(T.apply_step(df, step, prefer="catalyst"))
        b = as_np(T.apply_step(df, step))
        assert all(np.allclose(a[k], b[k], atol=1e-5) for k in a), step.name
    back = as_np(T.pipeline(df, [T.to_unit(), T.normalize(), T.denormalize()]))
    src = as_np(df)
    assert all(np.allclose(back[k], src[k] / 255.0, atol=1e-6) for k in back)


def _filtered(line, n_out):
    """One axis by the definition: a triangle of half width max(scale, 1) around each centre."""
    scale = len(line) / n_out
    wide = max(scale, 1.0)
    out = []
    for o in range(n_out):
        c = (o + 0.5) * scale
        w = [max(0.0, 1 - abs(k + 0.5 - c) / wide) for k in range(len(line))]
        out.append(sum(a * b for a, b in zip(w, line)) / sum(w))
    return out


def test_kernels_against_straightforward_formulas():
    import math
    rng = np.random.default_rng(11)
    for _ in range(40):
        h, w = int(rng.integers(1, 20)), int(rng.integers(1, 20))
        img = rng.integers(0, 256, (h, w, 3)).astype(np.float64)
        oh, ow = int(rng.integers(1, 25)), int(rng.integers(1, 25))
        across = np.array([[_filtered(img[y, :, c], ow) for c in range(3)] for y in range(h)]).transpose(0, 2, 1)
        both = np.array([[_filtered(across[:, x, c], oh) for c in range(3)] for x in range(ow)]).transpose(2, 0, 1)
        assert np.allclose(T.resize_image(img, oh, ow), both)
        deg = float(rng.uniform(-90, 90))
        t = math.radians(deg)
        cy, cx = (h - 1) / 2.0, (w - 1) / 2.0
        yy, xx = np.meshgrid(np.arange(h) - cy, np.arange(w) - cx, indexing="ij")
        sx = np.floor(cx + xx * math.cos(t) - yy * math.sin(t) + 0.5).astype(np.int64)
        sy = np.floor(cy + xx * math.sin(t) + yy * math.cos(t) + 0.5).astype(np.int64)
        inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
        ref = np.zeros_like(img)
        ref[inside] = img[sy[inside], sx[inside]]
        assert np.array_equal(T.rotate_image(img, deg), ref)


def test_stacks_equal_single_images():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, (5, 9, 7, 3)).astype(np.float64)
    deg, f = rng.uniform(-30, 30, 5), rng.uniform(0.8, 1.2, (3, 5))
    for levels in (False, True):
        a, j = T.resize_image(x, 4, 12, levels), T.jitter_image(x, *f, 255.0, levels)
        for n in range(5):
            assert np.array_equal(a[n], T.resize_image(x[n], 4, 12, levels))
            assert np.allclose(j[n], T.jitter_image(x[n], *f[:, n], 255.0, levels))
    assert all(np.array_equal(T.rotate_image(x, deg)[n], T.rotate_image(x[n], deg[n])) for n in range(5))


def test_mixed_shapes_user_columns_and_output_bytes(spark):
    a = tensors(spark, n=30, h=4, w=5)
    b = tensors(spark, n=30, h=3, w=3, c=1).withColumn("key", F.col("key") + 100)
    df = a.union(b).withColumn("__p0__x", F.col("key") * 2).withColumn("_p0_flip", F.lit("mine")).repartition(2, "key")
    df = df.withColumn("tensor", F.when(F.col("key") == 7, None).otherwise(F.col("tensor")))
    src = as_np(df.filter("tensor is not null"))
    steps = [T.random_hflip(1.0, key="key"), T.numpy_step(lambda i: i[: 1 + int(i[0, 0, 0]) % 2]), T.resize(6, 6)]
    out = T.apply_numpy_steps(df, steps, stack_bytes=2000, output_bytes=5000)
    assert out.columns == df.columns
    rows = {r.key: r for r in out.collect()}
    assert len(rows) == 60 and rows[7].tensor is None and all(r["__p0__x"] == 2 * k and r["_p0_flip"] == "mine" for k, r in rows.items())
    for k, img in src.items():
        want = img[:, ::-1]
        want = T.resize_image(want[: 1 + int(want[0, 0, 0]) % 2], 6, 6)
        assert np.allclose(np.array(rows[k].tensor.data).reshape(6, 6, -1), want, atol=1e-3)


def test_output_batches_are_cut_by_bytes():
    import pyarrow as pa
    n = 400
    data = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 16), pa.array(np.ones(16 * n, np.float32)))
    one = pa.array(np.full(n, 4, np.int32))
    t = pa.StructArray.from_arrays([one, one, pa.array(np.ones(n, np.int32)), data], names=["height", "width", "channels", "data"])
    rb = pa.RecordBatch.from_arrays([t], names=["tensor"])
    run = T._tensor_kernel([T.resize(256, 256)], "tensor", [{}], "tensor", T.STACK_BYTES, T.OUTPUT_BYTES)
    sizes = [(b.num_rows, len(b.column(0).field("data").flatten()) * 4) for b in run([rb])]
    assert sum(k for k, _ in sizes) == n and max(s for _, s in sizes) <= T.OUTPUT_BYTES and len(sizes) > 1


def test_malformed_tensors_give_null_and_are_counted(spark):
    from samplecraft.operators import tensors as T
    good = (2, 2, 1, [1.0, 2.0, 3.0, 4.0])
    bad = [(2, 2, 1, [1.0, 2.0, 3.0]), (2, 2, 1, [1.0, None, 3.0, 4.0]), (None, 2, 1, [1.0]), (0, 2, 1, []), (-2, -2, 1, [1.0] * 4),
           (2, 2, 1, None), (2, 2, 2, [1.0] * 4)]
    rows = [(0, good)] + [(k, x) for k, x in enumerate(bad, 1)] + [(90, None), (91, good)]
    df = spark.createDataFrame(rows, "key int, tensor struct<height:int,width:int,channels:int,data:array<float>>").coalesce(1)
    out = {r.key: r.tensor for r in T.pipeline(df, [T.resize(1, 1), T.to_unit()]).collect()}
    assert len(out) == len(rows)
    assert all((out[k] is not None) == (k in (0, 91)) for k in out) and abs(out[0].data[0] - 2.5 / 255) < 1e-6
    assert tuple(T.tensor_report(df).first()) == (10, 1, 7)
    assert sorted(r.key for r in df.where(T.usable_tensor(df)).collect()) == [0, 91]
