from samplecraft.operators import classes as C


def test_dictionary_sorted_dense(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "label string")
    d = [tuple(r) for r in C.class_dictionary(df).orderBy("label_idx").collect()]
    assert d == [(0, "a"), (1, "b"), (2, "c")]


def test_encode_unknown_is_null_and_decode(spark):
    train = spark.createDataFrame([("a",), ("b",)], "label string")
    d = C.class_dictionary(train)
    test = spark.createDataFrame([(1, "a"), (2, "z")], "id int, label string")
    enc = {r.id: r.label_idx for r in C.encode_labels(test, d).collect()}
    assert enc == {1: 0, 2: None}
    dec = C.decode_labels(spark.createDataFrame([(1,)], "pred_idx int"), d, "pred_idx", "name").first()
    assert dec.name == "b"


def test_class_consistency_sides(spark):
    a = spark.createDataFrame([("x",), ("y",)], "label string")
    b = spark.createDataFrame([("y",), ("z",)], "label string")
    got = {r.label: r.side for r in C.class_consistency(a, b).collect()}
    assert got == {"x": "train_only", "y": "both", "z": "test_only"}


def test_distributed_dictionary_matches(spark):
    from pyspark.sql import functions as F
    df = spark.range(5000).select(F.format_string("L%04d", (F.col("id") * 7) % 1300).alias("label")).repartition(7)
    a = sorted(tuple(r) for r in C.class_dictionary(df).collect())
    b = sorted(tuple(r) for r in C.class_dictionary(df, distributed=True).collect())
    assert a == b and len(a) == 1300 and a[-1][0] == 1299


def test_form_is_chosen_by_the_count(spark, monkeypatch):
    from pyspark.sql import functions as F
    df = spark.range(300).select(F.format_string("L%04d", F.col("id") % 40).alias("label"))
    a = sorted(tuple(r) for r in C.class_dictionary(df).collect())
    monkeypatch.setattr(C, "MAX_WINDOW_CLASSES", 10)
    many = C.class_dictionary(df)
    assert sorted(tuple(r) for r in many.collect()) == a
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(label" not in plan
    monkeypatch.setattr(C, "MAX_WINDOW_CLASSES", 40)
    assert "row_number() windowspecdefinition(label" in C.class_dictionary(df)._jdf.queryExecution().optimizedPlan().toString()
