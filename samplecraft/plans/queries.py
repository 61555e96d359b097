"""Registered queries: one per operator of the coverage list.

Each query takes ``(spark, sf_dir)``, reads whole driver tables and returns a
DataFrame.  ``ORACLES`` holds the equivalent DuckDB SQL over the same tables
(views ``events``, ``embeddings``, ...).  Floats that come out of sums over
arrays or rows are rounded to 6 decimals on both sides; computed columns
carry the same alias on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import classes as C
from ..operators import evaluate as E
from ..operators import history as H
from ..operators import manifest as M
from ..operators import sampling as S
from ..session import ensure_checkpoint_dir, scratch_path
from ..sources import metadata as SRC
from ..sources import run_log as RL
from . import fixtures as X

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------- SQL pieces

SQL_SAMPLES = """samples AS (
  SELECT event_id AS id, event_type AS label,
         CASE WHEN event_id % 4 = 0 THEN 'test' ELSE 'train' END AS dataset_type
  FROM events)"""

SQL_META = """meta AS (
  SELECT '/data/images/' || event_type || '/' || CAST(event_id AS VARCHAR) || '.jpg' AS image_path,
         event_type AS label,
         CASE WHEN event_id % 4 = 0 THEN 'test' ELSE 'train' END AS dataset_type
  FROM events)"""

SQL_PRED = """pred AS (
  SELECT id, label_idx, logits,
         CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred_idx
  FROM (SELECT vec_id AS id, CAST(label AS INTEGER) AS label_idx,
               list_value(""" + ", ".join(" + ".join(f"CAST(embedding[{j + 1}] AS DOUBLE)" for j in range(c, 64, 10))
                                          for c in range(10)) + """) AS logits
        FROM embeddings))"""

SQL_DICT = """dict AS (
  SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_idx, label
  FROM (SELECT DISTINCT 'class_' || CAST(label AS VARCHAR) AS label FROM embeddings))"""

SQL_COUNTS = """counts AS (
  SELECT label_idx AS true_idx, pred_idx, count(*) AS n FROM pred GROUP BY 1, 2)"""

SQL_CM = """cm AS (
  SELECT t.label_idx AS true_idx, p.label_idx AS pred_idx, CAST(coalesce(c.n, 0) AS BIGINT) AS n
  FROM dict t JOIN dict p ON true JOIN (SELECT 1) one ON true
  LEFT JOIN counts c ON c.true_idx = t.label_idx AND c.pred_idx = p.label_idx)"""

SQL_ERRORS = """errs AS (
  SELECT d.label_idx AS class_idx, d.label,
         CAST(coalesce(sum(CASE WHEN c.true_idx <> c.pred_idx THEN c.n ELSE 0 END), 0) AS BIGINT) AS errors
  FROM dict d LEFT JOIN counts c ON c.true_idx = d.label_idx
  GROUP BY 1, 2)"""

SQL_HARD5 = """hard AS (
  SELECT CAST(row_number() OVER (ORDER BY errors, class_idx) - 1 AS INTEGER) AS rank, class_idx, label, errors
  FROM (SELECT * FROM errs ORDER BY errors DESC, class_idx DESC LIMIT 5))"""

SQL_HIST = """g AS (
  SELECT event_type AS run_id, CAST(day(ts) AS INTEGER) AS epoch,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS v_loss,
         sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END) AS v_correct,
         count(*) AS v_n,
         CAST(sum(CASE WHEN user_id % 2 = 1 THEN CAST(round(value * 100) AS BIGINT) END) AS DOUBLE) / 100.0 AS t_loss,
         sum(CASE WHEN user_id % 2 = 1 THEN (CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END) END) AS t_correct,
         sum(CASE WHEN user_id % 2 = 1 THEN 1 END) AS t_n
  FROM events GROUP BY 1, 2),
hist AS (
  SELECT run_id, epoch,
         t_loss / CAST(t_n AS DOUBLE) AS train_loss,
         CAST(t_correct AS DOUBLE) / CAST(t_n AS DOUBLE) AS train_acc,
         v_loss / CAST(v_n AS DOUBLE) AS val_loss,
         CAST(v_correct AS DOUBLE) / CAST(v_n AS DOUBLE) AS val_acc
  FROM g)"""

SQL_RUNS = """runs AS (
  SELECT event_type AS run_id, event_type AS model,
         CASE WHEN event_type < 'p' THEN 3 END AS n_classes,
         30 AS epochs_asked, 256 AS batch_size,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS seconds
  FROM events GROUP BY 1)"""

SQL_BEST = """best AS (
  SELECT *, coalesce(val_loss < best_before, false) AS improved FROM (
    SELECT run_id, epoch, val_loss,
           coalesce(min(CASE WHEN NOT isnan(val_loss) THEN val_loss END) OVER (
             PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
             'inf'::DOUBLE) AS best_before,
           coalesce(min(CASE WHEN NOT isnan(val_loss) THEN val_loss END) OVER (
             PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             'inf'::DOUBLE) AS best_so_far
    FROM hist))"""

SQL_PATIENCE = """pat AS (
  SELECT *, bad_epochs >= 5 AS patience_hit FROM (
    SELECT *, CAST(rn - coalesce(max(CASE WHEN improved THEN rn END) OVER (
                PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)
              AS INTEGER) AS bad_epochs
    FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS rn FROM best)))"""

SQL_STOP = """stopped AS (
  SELECT * FROM (
    SELECT *, min(CASE WHEN patience_hit THEN epoch END) OVER (PARTITION BY run_id) AS stop_epoch FROM pat)
  WHERE stop_epoch IS NULL OR epoch <= stop_epoch)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# ------------------------------------------------------------ sources, A/U/B

@register("manifest_lines", "SELECT event_type || '/' || CAST(event_id AS VARCHAR) AS value FROM events")
def q_manifest_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "manifest")
    X.manifest_lines(X.events(spark, sf)).select("value").write.mode("overwrite").text(path)
    return SRC.scan_manifest(spark, path)


@register("manifest_parse", """
SELECT '/data/images/' || event_type || '/' || CAST(event_id AS VARCHAR) || '.jpg' AS image_path,
       event_type AS label FROM events""")
def q_manifest_parse(spark, sf):
    lines = X.manifest_lines(X.events(spark, sf)).select(F.trim("value").alias("value"))
    return M.parse_manifest(lines, X.IMAGE_ROOT)


@register("manifest_tag", _with(SQL_META) + "SELECT * FROM meta WHERE dataset_type = 'test'")
def q_manifest_tag(spark, sf):
    lines = X.manifest_lines(X.events(spark, sf))
    test = lines.where(F.col("split") == "test").select(F.trim("value").alias("value"))
    return M.tag_split(M.parse_manifest(test, X.IMAGE_ROOT), "test")


@register("combine_splits", _with(SQL_META) + "SELECT * FROM meta")
def q_combine_splits(spark, sf):
    return X.metadata(X.events(spark, sf))


def _written_metadata(spark, sf) -> str:
    path = scratch_path(spark, "metadata")
    SRC.write_metadata(X.metadata(X.events(spark, sf)), path)
    return path


@register("metadata_roundtrip", _with(SQL_META) + """
SELECT dataset_type, label, count(*) AS n FROM meta GROUP BY 1, 2""")
def q_metadata_roundtrip(spark, sf):
    path = _written_metadata(spark, sf)
    back = SRC.read_metadata(spark, path, columns=("image_path", "label", "dataset_type"))
    return back.groupBy("dataset_type", "label").agg(F.count(F.lit(1)).alias("n"))


@register("metadata_scan", _with(SQL_META) + """
SELECT image_path, label FROM meta WHERE dataset_type = 'test'""")
def q_metadata_scan(spark, sf):
    return SRC.read_metadata(spark, _written_metadata(spark, sf), split="test")


@register("split_filter", _with(SQL_SAMPLES) + "SELECT * FROM samples WHERE dataset_type = 'train'")
def q_split_filter(spark, sf):
    return M.filter_split(X.samples(X.events(spark, sf)), "train")


@register("class_filter", _with(SQL_SAMPLES) + """
SELECT * FROM samples WHERE dataset_type = 'train' AND label IN ('click', 'view', 'error')""")
def q_class_filter(spark, sf):
    return M.filter_classes(M.filter_split(X.samples(X.events(spark, sf)), "train"), X.CLASS_SUBSET)


@register("preview", _with(SQL_META) + "SELECT * FROM meta ORDER BY image_path, label, dataset_type LIMIT 5")
def q_preview(spark, sf):
    return M.preview(X.metadata(X.events(spark, sf)), 5)


@register("random_sample", _with(SQL_SAMPLES) + """
SELECT id, label FROM samples ORDER BY md5('42:' || CAST(id AS VARCHAR)), id LIMIT 5""")
def q_random_sample(spark, sf):
    return S.random_sample(X.samples(X.events(spark, sf)).select("id", "label"), 5, X.SEED, "id")


@register("row_fetch", _with(SQL_SAMPLES) + """
SELECT row_idx, id, label FROM (
  SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS row_idx, id, label FROM samples) s
WHERE row_idx IN (SELECT vec_id FROM embeddings)""")
def q_row_fetch(spark, sf):
    idx = S.key_order_index(X.samples(X.events(spark, sf)).select("id", "label"), "id")
    positions = X.embeddings(spark, sf).select(F.col("vec_id").alias("row_idx"))
    return S.fetch_rows(idx, positions).select("row_idx", "id", "label")


@register("row_fetch_indexed", ORACLES["row_fetch"])
def q_row_fetch_indexed(spark, sf):
    """B5 from a stored table: only the files that hold the positions are opened."""
    idx = S.key_order_index(X.samples(X.events(spark, sf)).select("id", "label"), "id")
    path = scratch_path(spark, "indexed")
    S.write_indexed(idx, path, rows_per_file=4096)
    positions = X.embeddings(spark, sf).select(F.col("vec_id").alias("row_idx"))
    return S.fetch_indexed(spark, path, positions).select("row_idx", "id", "label")


@register("class_consistency", _with(SQL_SAMPLES) + """
SELECT coalesce(a.label, b.label) AS label, a.label IS NOT NULL AS in_train, b.label IS NOT NULL AS in_test,
       CASE WHEN a.label IS NOT NULL AND b.label IS NOT NULL THEN 'both'
            WHEN a.label IS NOT NULL THEN 'train_only' ELSE 'test_only' END AS side
FROM (SELECT DISTINCT label FROM samples WHERE dataset_type = 'train') a
FULL OUTER JOIN (SELECT DISTINCT label FROM samples
                 WHERE dataset_type = 'test' AND label IN ('click', 'view', 'error')) b
ON a.label = b.label""")
def q_class_consistency(spark, sf):
    s = X.samples(X.events(spark, sf))
    test = M.filter_classes(M.filter_split(s, "test"), X.CLASS_SUBSET)
    return C.class_consistency(M.filter_split(s, "train"), test)


@register("class_dictionary", _with(SQL_SAMPLES) + """
SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_idx, label
FROM (SELECT DISTINCT label FROM samples WHERE dataset_type = 'train')""")
def q_class_dictionary(spark, sf):
    return C.class_dictionary(M.filter_split(X.samples(X.events(spark, sf)), "train"))


@register("label_encode", _with(SQL_SAMPLES, """d AS (
  SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_idx, label
  FROM (SELECT DISTINCT label FROM samples
        WHERE dataset_type = 'train' AND label IN ('click', 'view', 'error')))""") + """
SELECT s.id, s.label, d.label_idx FROM samples s LEFT JOIN d ON s.label = d.label
WHERE s.dataset_type = 'test'""")
def q_label_encode(spark, sf):
    s = X.samples(X.events(spark, sf))
    d = C.class_dictionary(M.filter_classes(M.filter_split(s, "train"), X.CLASS_SUBSET))
    return C.encode_labels(M.filter_split(s, "test"), d).select("id", "label", "label_idx")


@register("label_decode", _with(SQL_PRED, SQL_DICT) + """
SELECT p.id, p.pred_idx, d.label AS pred_label FROM pred p LEFT JOIN dict d ON d.label_idx = p.pred_idx""")
def q_label_decode(spark, sf):
    emb = X.embeddings(spark, sf)
    pred = X.predictions_input(emb).withColumn("pred_idx", scoring.argmax("logits"))
    d = C.class_dictionary(X.class_names(emb))
    return C.decode_labels(pred.select("id", "pred_idx"), d, "pred_idx", "pred_label")


@register("dataset_stats", _with(SQL_META) + """
SELECT dataset_type, count(*) AS n_rows, count(DISTINCT label) AS n_classes,
       grouping(dataset_type) = 1 AS is_total
FROM meta GROUP BY ROLLUP (dataset_type)""")
def q_dataset_stats(spark, sf):
    return M.dataset_stats(X.metadata(X.events(spark, sf)))


# ------------------------------------------------------ scoring and analysis

def _pred(spark, sf):
    emb = X.embeddings(spark, sf)
    return X.predictions_input(emb), C.class_dictionary(X.class_names(emb))


def _scored(spark, sf):
    pred, d = _pred(spark, sf)
    return E.score(pred), d


@register("epoch_metrics", _with(SQL_PRED) + """
SELECT count(*) AS n, CAST(sum(CASE WHEN label_idx = pred_idx THEN 1 ELSE 0 END) AS BIGINT) AS n_correct,
       round(avg(ln(list_sum(list_transform(logits, lambda v: exp(v - list_max(logits))))) + list_max(logits)
                 - logits[label_idx + 1]), 6) AS loss,
       avg(CASE WHEN label_idx = pred_idx THEN 1.0 ELSE 0.0 END) AS acc
FROM pred""")
def q_epoch_metrics(spark, sf):
    scored, _ = _scored(spark, sf)
    m = E.epoch_metrics(scored)
    return m.select("n", "n_correct", r6(F.col("loss")).alias("loss"), "acc")


@register("batch_metrics", _with(SQL_PRED) + """
SELECT batch_id, count(*) AS n, round(sum(loss), 6) AS loss_sum, round(avg(loss), 6) AS loss,
       CAST(sum(CASE WHEN label_idx = pred_idx THEN 1 ELSE 0 END) AS BIGINT) AS n_correct
FROM (SELECT *, CAST((row_number() OVER (ORDER BY id) - 1) // 64 AS BIGINT) AS batch_id,
             ln(list_sum(list_transform(logits, lambda v: exp(v - list_max(logits))))) + list_max(logits)
               - logits[label_idx + 1] AS loss
      FROM pred)
GROUP BY batch_id""")
def q_batch_metrics(spark, sf):
    scored, _ = _scored(spark, sf)
    b = E.batch_metrics(S.sequential_batches(scored, 64, key="id"))
    return b.select("batch_id", "n", r6(F.col("loss_sum")).alias("loss_sum"), r6(F.col("loss")).alias("loss"),
                    "n_correct")


@register("confusion_counts", _with(SQL_PRED, SQL_COUNTS) + "SELECT * FROM counts")
def q_confusion_counts(spark, sf):
    pred, _ = _pred(spark, sf)
    return E.confusion_counts(pred.withColumn("pred_idx", scoring.argmax("logits")))


def _counts(spark, sf):
    """(counts, dictionary) from one scan: counts per class name and prediction are kept, both derive from them."""
    emb = X.embeddings(spark, sf)
    pred = X.predictions_input(emb, name=True).withColumn("pred_idx", scoring.argmax("logits"))
    ensure_checkpoint_dir(spark)
    kept = pred.groupBy("label_idx", "label", "pred_idx").agg(F.count(F.lit(1)).alias("rows")).checkpoint(eager=True)
    return E.confusion_counts(kept, n_col="rows"), C.class_dictionary(kept)


@register("confusion_matrix", _with(SQL_PRED, SQL_DICT, SQL_COUNTS, SQL_CM) + "SELECT * FROM cm")
def q_confusion_matrix(spark, sf):
    counts, d = _counts(spark, sf)
    return E.confusion_matrix(counts, d)


@register("class_errors", _with(SQL_PRED, SQL_DICT, SQL_COUNTS, SQL_ERRORS) + "SELECT * FROM errs")
def q_class_errors(spark, sf):
    counts, d = _counts(spark, sf)
    return E.class_errors(counts, d)


@register("top_confusions", _with(SQL_PRED, SQL_DICT, SQL_COUNTS) + """
SELECT c.true_idx, c.pred_idx, t.label AS true_label, p.label AS pred_label, c.n
FROM counts c JOIN dict t ON t.label_idx = c.true_idx JOIN dict p ON p.label_idx = c.pred_idx
WHERE c.true_idx <> c.pred_idx AND c.n > 0
ORDER BY c.n DESC, true_label DESC, pred_label DESC LIMIT 10""")
def q_top_confusions(spark, sf):
    counts, d = _counts(spark, sf)
    return E.top_confusions(counts, d, 10)


@register("hardest_classes", _with(SQL_PRED, SQL_DICT, SQL_COUNTS, SQL_ERRORS, SQL_HARD5) + "SELECT * FROM hard")
def q_hardest_classes(spark, sf):
    counts, d = _counts(spark, sf)
    return E.hardest_classes(E.class_errors(counts, d), 5)


@register("hardest_submatrix", _with(SQL_PRED, SQL_DICT, SQL_COUNTS, SQL_CM, SQL_ERRORS, SQL_HARD5) + """
SELECT t.rank AS true_rank, p.rank AS pred_rank, cm.true_idx, cm.pred_idx,
       t.label AS true_label, p.label AS pred_label, cm.n
FROM cm JOIN hard t ON t.class_idx = cm.true_idx JOIN hard p ON p.class_idx = cm.pred_idx""")
def q_hardest_submatrix(spark, sf):
    counts, d = _counts(spark, sf)
    cm = E.confusion_matrix(counts, d)
    return E.submatrix(cm, E.hardest_classes(E.class_errors(counts, d), 5))


@register("heatmap_cells", _with(SQL_PRED, SQL_DICT, SQL_COUNTS, SQL_CM) + """
SELECT true_idx, pred_idx, n, CAST(n AS DOUBLE) > (SELECT max(n) FROM cm) / 2.0 AS dark_cell
FROM cm WHERE n > 0""")
def q_heatmap_cells(spark, sf):
    counts, _ = _counts(spark, sf)
    return E.heatmap_cells(counts)


def _examples_sql(correct: bool) -> str:
    op = "=" if correct else "<>"
    return _with(SQL_PRED, SQL_DICT) + f"""
SELECT e.id, e.true_idx, e.pred_idx, t.label AS true_label, p.label AS pred_label
FROM (SELECT id, label_idx AS true_idx, pred_idx FROM pred WHERE label_idx {op} pred_idx
      ORDER BY md5('42:' || CAST(id AS VARCHAR)), id LIMIT 10) e
LEFT JOIN dict t ON t.label_idx = e.true_idx LEFT JOIN dict p ON p.label_idx = e.pred_idx"""


@register("examples_correct", _examples_sql(True))
def q_examples_correct(spark, sf):
    scored, d = _scored(spark, sf)
    return E.example_predictions(scored, d, 10, True, X.SEED, "id")


@register("examples_images", _examples_sql(False).replace("SELECT e.id, e.true_idx", "SELECT e.id, CAST(i AS INTEGER) AS i, e.true_idx")
          .replace("p.label AS pred_label", "p.label AS pred_label, " + """round(CAST(CAST(least(greatest(
         0.224 * CAST(emb.embedding[i + 1] AS DOUBLE) + 0.456, 0.0), 1.0) AS FLOAT) AS DOUBLE), 6) AS value""")
          + " JOIN embeddings emb ON emb.vec_id = e.id, range(64) g(i)")
def q_examples_images(spark, sf):
    """T4 with pictures: ten wrong examples and their denormalised one-channel tensors."""
    scored, d = _scored(spark, sf)
    t = X.tensors_8x8(X.embeddings(spark, sf)).withColumnRenamed("key", "id")
    out = E.example_predictions(scored, d, 10, False, X.SEED, "id", tensors=t, mean=(0.456,), std=(0.224,))
    return out.select("id", "true_idx", "pred_idx", "true_label", "pred_label", F.posexplode(F.col("image")["data"]).alias("i", "v")) \
              .withColumn("value", r6(F.col("v").cast("double"))).withColumn("i", F.col("i").cast("int")).drop("v")


@register("examples_incorrect", _examples_sql(False))
def q_examples_incorrect(spark, sf):
    scored, d = _scored(spark, sf)
    return E.example_predictions(scored, d, 10, False, X.SEED, "id")


def _head_sql() -> str:
    # w[c][j] = ((31c + 17j) % 11 - 5) / 10, b[c] = c / 100  (j is 0-based)
    return """lin AS (
  SELECT vec_id AS id, CAST(label AS INTEGER) AS label_idx, c AS class_idx,
         list_sum(list_transform(range(64), lambda j:
             CAST(embedding[j + 1] AS DOUBLE) * (CAST(((31 * c + 17 * j) % 11) - 5 AS DOUBLE) / 10.0)))
           + CAST(c AS DOUBLE) / 100.0 AS logit
  FROM embeddings, range(10) r(c)),
zz AS (
  SELECT id, label_idx, list(logit ORDER BY class_idx) AS logits FROM lin GROUP BY id, label_idx)"""


@register("linear_logits", _with(_head_sql()) + """
SELECT id, CAST(class_idx AS INTEGER) AS class_idx, round(logit, 6) AS logit FROM lin""")
def q_linear_logits(spark, sf):
    w, b = X.fixture_head()
    emb = X.embeddings(spark, sf)
    z = emb.select(F.col("vec_id").alias("id"), scoring.linear_logits("embedding", w, b).alias("logits"))
    return z.select("id", F.posexplode("logits").alias("class_idx", "logit")) \
            .select("id", "class_idx", r6(F.col("logit")).alias("logit"))


@register("argmax_predict", _with(SQL_PRED) + "SELECT id, pred_idx FROM pred")
def q_argmax_predict(spark, sf):
    pred, _ = _pred(spark, sf)
    return pred.select("id", scoring.argmax("logits").alias("pred_idx"))


@register("cross_entropy", _with(SQL_PRED) + """
SELECT id, label_idx,
       round(ln(list_sum(list_transform(logits, lambda v: exp(v - list_max(logits))))) + list_max(logits)
             - logits[label_idx + 1], 6) AS loss
FROM pred""")
def q_cross_entropy(spark, sf):
    pred, _ = _pred(spark, sf)
    return pred.select("id", "label_idx", r6(scoring.cross_entropy("logits", "label_idx")).alias("loss"))


@register("score_rows", _with(_head_sql()) + """
SELECT id, label_idx, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred_idx,
       round(ln(list_sum(list_transform(logits, lambda v: exp(v - list_max(logits))))) + list_max(logits)
             - logits[label_idx + 1], 6) AS loss,
       label_idx = CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS correct
FROM zz""")
def q_score_rows(spark, sf):
    w, b = X.fixture_head()
    emb = X.embeddings(spark, sf).select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label_idx"),
                                         "embedding")
    s = E.score(emb, features_col="embedding", weights=w, bias=b)
    return s.select("id", "label_idx", "pred_idx", r6(F.col("loss")).alias("loss"), "correct")


@register("score_head_blocks", ORACLES["score_rows"])
def q_score_head_blocks(spark, sf):
    """F4 / D3 with the head as a table, two classes a block."""
    w, b = X.fixture_head()
    head = spark.createDataFrame([(c, b[c], w[c]) for c in range(len(b))], "class_idx int, bias double, weights array<double>")
    emb = X.embeddings(spark, sf).select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label_idx"), "embedding")
    s = E.score_by_blocks(emb, head, "embedding", block_numbers=130)
    return s.select("id", "label_idx", "pred_idx", r6(F.col("loss")).alias("loss"), "correct")


@register("confusion_outside", _with(SQL_PRED, SQL_DICT, SQL_COUNTS) + """
SELECT true_idx, pred_idx, n FROM counts
WHERE true_idx NOT IN (SELECT label_idx FROM dict WHERE label_idx % 2 = 0)
   OR pred_idx NOT IN (SELECT label_idx FROM dict WHERE label_idx % 2 = 0)""")
def q_confusion_outside(spark, sf):
    """E2's other table: cells outside a dictionary, here of the even classes."""
    counts, d = _counts(spark, sf)
    return E.outside_cells(counts, d.where("label_idx % 2 = 0"))


@register("tensor_report", """
SELECT count(*) AS n, count(*) FILTER (vec_id % 7 = 0) AS n_null,
       count(*) FILTER (vec_id % 7 <> 0 AND vec_id % 3 = 0) AS n_unusable FROM embeddings""")
def q_tensor_report(spark, sf):
    """I9's report over tensors of which some are NULL and some have a value too few."""
    t = X.tensors_8x8(X.embeddings(spark, sf))
    cut = F.col("tensor").withField("data", F.slice(F.col("tensor")["data"], 1, 63))
    t = t.withColumn("tensor", F.when(F.col("key") % 7 == 0, None).when(F.col("key") % 3 == 0, cut).otherwise(F.col("tensor")))
    return T.tensor_report(t)


# ------------------------------------------------------------------ batching

@register("shuffle_batches", _with(SQL_SAMPLES) + """
SELECT id, row_idx, CAST(row_idx // 256 AS BIGINT) AS batch_id FROM (
  SELECT id, CAST(row_number() OVER (ORDER BY md5('42:1:' || CAST(id AS VARCHAR)), id) - 1 AS BIGINT) AS row_idx
  FROM samples WHERE dataset_type = 'train')""")
def q_shuffle_batches(spark, sf):
    train = M.filter_split(X.samples(X.events(spark, sf)), "train").select("id")
    return S.shuffle_batches(train, 256, seed=X.SEED, epoch=1, key="id").select("id", "row_idx", "batch_id")


@register("sequential_batches", _with(SQL_SAMPLES) + """
SELECT id, row_idx, CAST(row_idx // 256 AS BIGINT) AS batch_id FROM (
  SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS row_idx
  FROM samples WHERE dataset_type = 'test')""")
def q_sequential_batches(spark, sf):
    test = M.filter_split(X.samples(X.events(spark, sf)), "test").select("id")
    return S.sequential_batches(test, 256, key="id").select("id", "row_idx", "batch_id")


# ------------------------------------------------------------------- history

def _hist(spark, sf):
    return X.history(X.events(spark, sf))


@register("history_from_events", _with(SQL_HIST) + "SELECT * FROM hist")
def q_history_from_events(spark, sf):
    return _hist(spark, sf)


@register("running_best", _with(SQL_HIST, SQL_BEST) + """
SELECT run_id, epoch, val_loss, best_before, improved, best_so_far FROM best""")
def q_running_best(spark, sf):
    return H.running_best(_hist(spark, sf)).select(
        "run_id", "epoch", "val_loss", "best_before", "improved", "best_so_far")


@register("patience_counter", _with(SQL_HIST, SQL_BEST, SQL_PATIENCE) + """
SELECT run_id, epoch, bad_epochs, patience_hit FROM pat""")
def q_patience_counter(spark, sf):
    return H.patience_counter(_hist(spark, sf), 5).select("run_id", "epoch", "bad_epochs", "patience_hit")


@register("early_stop", _with(SQL_HIST, SQL_BEST, SQL_PATIENCE, SQL_STOP) + """
SELECT run_id, epoch, val_loss, stop_epoch FROM stopped""")
def q_early_stop(spark, sf):
    return H.early_stop(_hist(spark, sf), 5).select("run_id", "epoch", "val_loss", "stop_epoch")


_PLATEAU_BETTER = "coalesce(o.val_loss < s.best * (CAST(1.0 AS DOUBLE) - CAST(1e-4 AS DOUBLE)), false)"
_PLATEAU_CUT = (f"(NOT {_PLATEAU_BETTER} AND s.bad + 1 > 3 "
                "AND s.lr - greatest(s.lr * CAST(0.1 AS DOUBLE), CAST(0.0 AS DOUBLE)) > CAST(1e-8 AS DOUBLE))")


@register("plateau_lr", "WITH RECURSIVE " + SQL_HIST + f""",
ordered AS (
  SELECT run_id, epoch, val_loss, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS rn FROM hist),
s AS (
  SELECT DISTINCT run_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS INTEGER) AS epoch, 'inf'::DOUBLE AS best,
         0 AS bad, CAST(0.001 AS DOUBLE) AS lr, false AS cut
  FROM ordered
  UNION ALL
  SELECT o.run_id, o.rn, o.epoch,
         CASE WHEN {_PLATEAU_BETTER} THEN o.val_loss ELSE s.best END,
         CASE WHEN {_PLATEAU_BETTER} THEN 0 WHEN s.bad + 1 > 3 THEN 0 ELSE s.bad + 1 END,
         CASE WHEN {_PLATEAU_CUT} THEN greatest(s.lr * CAST(0.1 AS DOUBLE), CAST(0.0 AS DOUBLE)) ELSE s.lr END,
         {_PLATEAU_CUT}
  FROM s JOIN ordered o ON o.run_id = s.run_id AND o.rn = s.rn + 1)
SELECT run_id, epoch, lr, cut FROM s WHERE rn > 0""")
def q_plateau_lr(spark, sf):
    return H.plateau_lr(_hist(spark, sf), lr=1e-3, factor=0.1, patience=3, threshold=1e-4)


@register("best_checkpoint", _with(SQL_HIST, SQL_BEST, SQL_PATIENCE, SQL_STOP) + """
SELECT run_id, max(CASE WHEN improved THEN epoch END) AS best_epoch,
       min(CASE WHEN improved THEN val_loss END) AS best_val_loss, count(*) AS epochs_run
FROM stopped GROUP BY run_id HAVING max(CASE WHEN improved THEN epoch END) IS NOT NULL""")
def q_best_checkpoint(spark, sf):
    return H.best_checkpoint(_hist(spark, sf), patience=5)


@register("history_arrays", _with(SQL_HIST) + """
SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY epoch) - 1 AS INTEGER) AS pos,
       epoch, train_loss, train_acc, val_loss, val_acc FROM hist""")
def q_history_arrays(spark, sf):
    a = H.history_arrays(_hist(spark, sf))
    z = a.select("run_id", F.posexplode(F.arrays_zip("epochs", "train_losses", "train_accs",
                                                     "val_losses", "val_accs")).alias("pos", "z"))
    return z.select("run_id", F.col("pos").cast("int").alias("pos"), F.col("z.epochs").alias("epoch"),
                    F.col("z.train_losses").alias("train_loss"), F.col("z.train_accs").alias("train_acc"),
                    F.col("z.val_losses").alias("val_loss"), F.col("z.val_accs").alias("val_acc"))


@register("history_series", _with(SQL_HIST) + """
SELECT run_id, epoch, metric, split, value FROM (
  SELECT run_id, epoch, 'loss' AS metric, 'train' AS split, train_loss AS value FROM hist
  UNION ALL SELECT run_id, epoch, 'acc', 'train', train_acc FROM hist
  UNION ALL SELECT run_id, epoch, 'loss', 'val', val_loss FROM hist
  UNION ALL SELECT run_id, epoch, 'acc', 'val', val_acc FROM hist) WHERE value IS NOT NULL""")
def q_history_series(spark, sf):
    return H.history_series(_hist(spark, sf))


@register("run_summary", _with(SQL_HIST, SQL_RUNS) + """, agg AS (
  SELECT run_id, count(*) AS epochs_run,
         min(val_loss) AS best_val_loss,
         min(epoch) FILTER (WHERE rl = 1) AS best_loss_epoch,
         max(val_acc) AS best_val_acc,
         min(epoch) FILTER (WHERE ra = 1) AS best_acc_epoch,
         max(train_acc) FILTER (WHERE rlast = 1) AS last_train_acc,
         max(val_acc) FILTER (WHERE rlast = 1) AS last_val_acc
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY val_loss, epoch) AS rl,
               row_number() OVER (PARTITION BY run_id ORDER BY val_acc DESC, epoch) AS ra,
               row_number() OVER (PARTITION BY run_id ORDER BY epoch DESC) AS rlast FROM hist)
  GROUP BY run_id)
SELECT r.run_id, r.model, r.n_classes, r.epochs_asked, a.epochs_run, a.best_val_loss, a.best_loss_epoch,
       a.best_val_acc, a.best_acc_epoch, a.last_train_acc, a.last_val_acc,
       a.last_train_acc - a.last_val_acc AS acc_gap, r.seconds, r.seconds / a.epochs_run AS seconds_per_epoch
FROM runs r JOIN agg a ON a.run_id = r.run_id""")
def q_run_summary(spark, sf):
    ev = X.events(spark, sf)
    return H.run_summary(X.runs(ev), X.history(ev))


@register("history_roundtrip", _with(SQL_HIST) + "SELECT * FROM hist")
def q_history_roundtrip(spark, sf):
    path = scratch_path(spark, "history")
    SRC.write_history(_hist(spark, sf), path)
    return SRC.read_history(spark, path)


@register("run_log_scan", _with(SQL_HIST, SQL_RUNS) + """
SELECT r.model, r.n_classes, r.epochs_asked, r.batch_size, r.seconds,
       h.epoch, h.train_loss, h.train_acc, h.val_loss, h.val_acc
FROM hist h JOIN runs r ON r.run_id = h.run_id""")
def q_run_log_scan(spark, sf):
    ev = X.events(spark, sf)
    path = scratch_path(spark, "runlog")
    RL.write_run_log(X.runs(ev), X.history(ev), path)
    runs, hist = RL.scan_run_log(spark, path)
    return (hist.join(runs, "run_id")
                .select("model", "n_classes", "epochs_asked", "batch_size", "seconds", "epoch",
                        "train_loss", "train_acc", "val_loss", "val_acc"))


# ------------------------------------------------------------------- tensors

from ..functions import tensor as TX  # noqa: E402
from ..operators import tensors as T  # noqa: E402


def explode_tensor(df: DataFrame, tensor_col: str = "tensor") -> DataFrame:
    """``(key, i, value)`` with values as doubles rounded to 6 decimals."""
    return (df.select("key", F.posexplode(F.col(tensor_col)["data"]).alias("i", "v"))
              .select("key", F.col("i").cast("int").alias("i"), r6(F.col("v").cast("double")).alias("value")))


def _u_sql(tag: str, epoch: int = 1) -> str:
    return (f"(CAST(('0x' || substr(md5('42:' || CAST(vec_id AS VARCHAR) || ':{epoch}:{tag}'), 1, 8)) AS BIGINT)"
            " / CAST(4294967296.0 AS DOUBLE))")


_EMB_8x8x3 = "embedding[(i // 3 + 21 * (i % 3)) % 64 + 1]"
_MEAN_C = ("CASE i % 3 WHEN 0 THEN CAST(0.485 AS DOUBLE) WHEN 1 THEN CAST(0.456 AS DOUBLE) "
           "ELSE CAST(0.406 AS DOUBLE) END")
_STD_C = ("CASE i % 3 WHEN 0 THEN CAST(0.229 AS DOUBLE) WHEN 1 THEN CAST(0.224 AS DOUBLE) "
          "ELSE CAST(0.225 AS DOUBLE) END")


def _r6f(expr: str) -> str:
    return f"round(CAST(CAST({expr} AS FLOAT) AS DOUBLE), 6)"


@register("tensor_unit", f"""
SELECT vec_id AS key, CAST(i AS INTEGER) AS i,
       {_r6f("CAST(CAST(floor((CAST(embedding[i + 1] AS DOUBLE) + 1) * 127.5) AS FLOAT) AS DOUBLE) / CAST(255.0 AS DOUBLE)")} AS value
FROM embeddings, range(64) t(i)""")
def q_tensor_unit(spark, sf):
    t = X.tensors_8x8(X.embeddings(spark, sf), eight_bit=True)
    return explode_tensor(t.select("key", TX.to_unit("tensor").alias("tensor")))


@register("tensor_normalize", f"""
SELECT vec_id AS key, CAST(i AS INTEGER) AS i,
       {_r6f(f"(CAST({_EMB_8x8x3} AS DOUBLE) - {_MEAN_C}) / {_STD_C}")} AS value
FROM embeddings, range(192) t(i)""")
def q_tensor_normalize(spark, sf):
    t = X.tensors_8x8x3(X.embeddings(spark, sf))
    return explode_tensor(t.select("key", TX.normalize("tensor").alias("tensor")))


@register("tensor_denormalize", f"""
SELECT vec_id AS key, CAST(i AS INTEGER) AS i,
       {_r6f(f"least(greatest({_STD_C} * CAST({_EMB_8x8x3} AS DOUBLE) + {_MEAN_C}, CAST(0.0 AS DOUBLE)), CAST(1.0 AS DOUBLE))")} AS value
FROM embeddings, range(192) t(i)""")
def q_tensor_denormalize(spark, sf):
    t = X.tensors_8x8x3(X.embeddings(spark, sf))
    return explode_tensor(T.apply_step(t, T.denormalize()))


@register("tensor_hflip", f"""
SELECT vec_id AS key, CAST(i AS INTEGER) AS i,
       round(CAST(CASE WHEN {_u_sql("flip")} < CAST(0.5 AS DOUBLE)
                       THEN embedding[((i // 24) * 8 + 7 - (i % 24) // 3 + 21 * (i % 3)) % 64 + 1]
                       ELSE {_EMB_8x8x3} END AS DOUBLE), 6) AS value
FROM embeddings, range(192) t(i)""")
def q_tensor_hflip(spark, sf):
    t = X.tensors_8x8x3(X.embeddings(spark, sf))
    return explode_tensor(T.apply_step(t, T.random_hflip(0.5, X.SEED, 1, "key")))


def _dbl(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def _filter_sql(o: str, n_in: str, n_out: int, value, levels: bool) -> str:
    """One pass of the resize: the triangle filter at output place ``o``, widened by the scale
    when the axis shrinks; ``value(k)`` is the source value at ``k``."""
    scale = f"({_dbl(n_in)} / {n_out})"
    wide = f"greatest({scale}, {_dbl('1.0')})"
    centre = f"(({_dbl(o)} + 0.5) * {scale})"
    taps = (f"range(CAST(greatest(floor({centre} - {wide} + 0.5), 0) AS BIGINT), "
            f"CAST(least(floor({centre} + {wide} + 0.5), {n_in}) AS BIGINT))")
    weight = f"greatest({_dbl('1.0')} - abs((k - {centre} + 0.5) / {wide}), {_dbl('0.0')})"
    total = f"list_sum(list_transform({taps}, lambda k: {weight}))"
    out = f"list_sum(list_transform({taps}, lambda k: {value('k')} * ({weight} / {total})))"
    return f"least(greatest(floor({out} + 0.5), {_dbl('0.0')}), {_dbl('255.0')})" if levels else out


def _resize_sql(base: str, channels: int, out: int, pixel, levels: bool) -> str:
    """CTEs from ``base`` (key, embedding, top, lft, ch, cw) to ``rz`` (key, Y, X, c, v):
    along the rows of the box, then down its columns."""
    across = _filter_sql("X", "cw", out, lambda k: pixel("top + yy", f"lft + {k}"), levels)
    down = _filter_sql("Y", "ch", out, lambda k: f"col[{k} + 1]", levels)
    return f"""
rx AS (
  SELECT key, ch, yy, X, c, {across} AS v
  FROM (SELECT * FROM {base}, range(8) r(yy), range({out}) q(X), range({channels}) cc(c) WHERE yy < ch)),
rc AS (SELECT key, X, c, ch, list(v ORDER BY yy) AS col FROM rx GROUP BY key, X, c, ch),
rz AS (SELECT key, Y, X, c, {down} AS v FROM (SELECT * FROM rc, range({out}) q(Y)))"""


def _pixel1(y: str, x: str) -> str:
    """The 8 x 8 x 1 tensor."""
    return f"CAST(embedding[({y}) * 8 + ({x}) + 1] AS DOUBLE)"


def _pixel3(y: str, x: str) -> str:
    """The 8-bit 8 x 8 x 3 tensor."""
    return f"floor((CAST(embedding[(({y}) * 8 + ({x}) + 21 * c) % 64 + 1] AS DOUBLE) + 1) * 127.5)"


_WHOLE = "SELECT vec_id AS key, embedding, 0 AS top, 0 AS lft, 8 AS ch, 8 AS cw FROM embeddings"
_NORM = (f"(v / {_dbl('255.0')} - CASE c WHEN 0 THEN {_dbl('0.485')} WHEN 1 THEN {_dbl('0.456')} ELSE {_dbl('0.406')} END)"
         f" / CASE c WHEN 0 THEN {_dbl('0.229')} WHEN 1 THEN {_dbl('0.224')} ELSE {_dbl('0.225')} END")


def _tensor_rows(table: str, size: int, channels: int, value: str) -> str:
    return f"""
SELECT key, CAST((Y * {size} + X) * {channels} + c AS INTEGER) AS i, {_r6f(value)} AS value FROM {table}"""


@register("tensor_resize", _with(f"base AS ({_WHOLE})", _resize_sql("base", 1, 4, _pixel1, False).strip())
          + _tensor_rows("rz", 4, 1, "v"))
def q_tensor_resize(spark, sf):
    t = X.tensors_8x8(X.embeddings(spark, sf))
    return explode_tensor(T.apply_step(t, T.resize(4, 4)))


@register("tensor_rotate", """
SELECT vec_id AS key, CAST(i AS INTEGER) AS i,
       round(CAST(embedding[(i % 8) * 8 + 7 - i // 8 + 1] AS DOUBLE), 6) AS value
FROM embeddings, range(64) t(i)""")
def q_tensor_rotate(spark, sf):
    t = X.tensors_8x8(X.embeddings(spark, sf))
    return explode_tensor(T.apply_step(t, T.rotate(90.0)))


@register("tensor_jitter", f"""
SELECT vec_id AS key, CAST(i AS INTEGER) AS i,
       {_r6f("least(greatest(CAST(CAST(floor((CAST(embedding[i + 1] AS DOUBLE) + 1) * 127.5) AS FLOAT) AS DOUBLE) * (CAST(0.8 AS DOUBLE) + " + _u_sql("brightness") + " * (CAST(1.2 AS DOUBLE) - CAST(0.8 AS DOUBLE))), CAST(0.0 AS DOUBLE)), CAST(255.0 AS DOUBLE))")} AS value
FROM embeddings, range(64) t(i)""")
def q_tensor_jitter(spark, sf):
    t = X.tensors_8x8(X.embeddings(spark, sf), eight_bit=True)
    return explode_tensor(T.apply_step(t, T.color_jitter(0.2, 0.0, 0.0, X.SEED, 1, "key")))


def _box_sql() -> str:
    """CTEs to ``box`` (key, embedding, top, lft, ch, cw): the random crop of an 8 x 8 image
    (scale 0.8..1, ratio 3/4..4/3)."""
    u = {t: _u_sql("crop_" + t) for t in ("area", "ratio", "top", "left")}
    return f"""
p0 AS (
  SELECT vec_id AS key, embedding,
         64 * (CAST(0.8 AS DOUBLE) + {u["area"]} * (CAST(1.0 AS DOUBLE) - CAST(0.8 AS DOUBLE))) AS area,
         exp(ln(CAST(3 AS DOUBLE) / 4) + {u["ratio"]} * (ln(CAST(4 AS DOUBLE) / 3) - ln(CAST(3 AS DOUBLE) / 4))) AS ar,
         {u["top"]} AS ut, {u["left"]} AS ul
  FROM embeddings),
p1 AS (
  SELECT key, embedding, ut, ul,
         CAST(least(greatest(floor(sqrt(area * ar) + 0.5), 1), 8) AS BIGINT) AS cw,
         CAST(least(greatest(floor(sqrt(area / ar) + 0.5), 1), 8) AS BIGINT) AS ch
  FROM p0),
box AS (
  SELECT key, embedding, cw, ch,
         CAST(floor(ut * (8 - ch + 1)) AS BIGINT) AS top, CAST(floor(ul * (8 - cw + 1)) AS BIGINT) AS lft
  FROM p1)"""


@register("tensor_crop", _with(_box_sql().strip(), _resize_sql("box", 1, 4, _pixel1, False).strip())
          + _tensor_rows("rz", 4, 1, "v"))
def q_tensor_crop(spark, sf):
    t = X.tensors_8x8(X.embeddings(spark, sf))
    return explode_tensor(T.apply_step(t, T.random_resized_crop(4, seed=X.SEED, epoch=1, key="key")))


@register("pipeline_eval", _with(f"base AS ({_WHOLE})", _resize_sql("base", 3, 4, _pixel3, True).strip())
          + _tensor_rows("rz", 4, 3, _NORM))
def q_pipeline_eval(spark, sf):
    t = X.tensors_8x8x3(X.embeddings(spark, sf), eight_bit=True)
    return explode_tensor(T.pipeline(t, T.eval_preset(4)))


def _turn_sql(src: str, size: int, angle: float, tags: str) -> str:
    """CTEs from ``src`` (key, Y, X, c, v) to ``rot``: flip, then rotate within +-``angle`` degrees."""
    mid = (size - 1) / 2
    return f"""
draws AS (
  SELECT vec_id AS key, {_u_sql("flip")} AS uf,
         ({_dbl(-angle)} + {_u_sql("rotate")} * {_dbl(2 * angle)}) * (pi() / 180.0) AS t{tags} FROM embeddings),
fl AS (
  SELECT a.key, a.Y, a.X, a.c, CASE WHEN d.uf < {_dbl('0.5')} THEN m.v ELSE a.v END AS v
  FROM {src} a JOIN draws d ON d.key = a.key
  JOIN {src} m ON m.key = a.key AND m.Y = a.Y AND m.X = {size - 1} - a.X AND m.c = a.c),
rsrc AS (
  SELECT fl.key, Y, X, c,
         CAST(floor((({mid} + ({_dbl('X')} - {mid}) * cos(t)) - ({_dbl('Y')} - {mid}) * sin(t)) + 0.5) AS BIGINT) AS rx,
         CAST(floor((({mid} + ({_dbl('X')} - {mid}) * sin(t)) + ({_dbl('Y')} - {mid}) * cos(t)) + 0.5) AS BIGINT) AS ry
  FROM fl JOIN draws d ON d.key = fl.key),
rot AS (
  SELECT s.key, s.Y, s.X, s.c,
         CASE WHEN s.rx BETWEEN 0 AND {size - 1} AND s.ry BETWEEN 0 AND {size - 1} THEN fl.v ELSE {_dbl('0.0')} END AS v
  FROM rsrc s LEFT JOIN fl ON fl.key = s.key AND fl.Y = s.ry AND fl.X = s.rx AND fl.c = s.c)"""


def _train_pipeline_sql() -> str:
    """The training preset (size 4) on the 8-bit 8 x 8 x 3 tensor, step by step:
    random resized crop, flip, rotation (+-15), brightness / contrast / saturation,
    unit scale, normalise; whole levels after each image step."""
    def factor(tag):
        return f"({_dbl('0.8')} + {_u_sql(tag)} * ({_dbl('1.2')} - {_dbl('0.8')}))"

    def level(x):
        return f"floor(least(greatest({x}, {_dbl('0.0')}), {_dbl('255.0')}))"

    def gray(src):
        ch = [f"max(CASE WHEN c = {k} THEN v END)" for k in range(3)]
        return (f"SELECT key, Y, X, floor(({ch[0]} * 19595.0 + {ch[1]} * 38470.0 + {ch[2]} * 7471.0 + 32768.0) / 65536.0) AS g "
                f"FROM {src} GROUP BY key, Y, X")

    tags = "".join(f", {factor(t)} AS {n}" for t, n in (("brightness", "fb"), ("contrast", "fc"), ("saturation", "fs")))
    return _with(_box_sql().strip(), _resize_sql("box", 3, 4, _pixel3, True).strip(), _turn_sql("rz", 4, 15.0, tags).strip(),
                 f"j1 AS (SELECT r.key, Y, X, c, {level('v * fb')} AS v FROM rot r JOIN draws d ON d.key = r.key)",
                 f"g1 AS ({gray('j1')})", "m1 AS (SELECT key, floor(avg(g) + 0.5) AS gm FROM g1 GROUP BY key)",
                 f"j2 AS (SELECT j1.key, Y, X, c, {level('fc * v + (1.0 - fc) * gm')} AS v "
                 "FROM j1 JOIN m1 ON m1.key = j1.key JOIN draws d ON d.key = j1.key)",
                 f"g2 AS ({gray('j2')})",
                 f"j3 AS (SELECT j2.key, j2.Y, j2.X, c, {level('fs * v + (1.0 - fs) * g')} AS v FROM j2 "
                 "JOIN g2 ON g2.key = j2.key AND g2.Y = j2.Y AND g2.X = j2.X JOIN draws d ON d.key = j2.key)") \
        + _tensor_rows("j3", 4, 3, _NORM)


@register("pipeline_train", _train_pipeline_sql())
def q_pipeline_train(spark, sf):
    t = X.tensors_8x8x3(X.embeddings(spark, sf), eight_bit=True)
    return explode_tensor(T.pipeline(t, T.train_preset(4, seed=X.SEED, epoch=1, key="key")))


# ------------------------------------------------------- heads and images

from ..operators import head as HD  # noqa: E402
from ..sources import images as IMG  # noqa: E402


def _features(spark, sf):
    emb = X.embeddings(spark, sf)
    return emb.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"),
                      F.col("label").cast("int").alias("label_idx"))


_FIT_LR, _FIT_DECAY = 0.05, 1e-4


def _fit_sql() -> str:
    """Two full-batch epochs from zero weights, chained: each step is the softmax gradient of the
    training rows, one Adam update, and the metrics of the validation rows."""
    def scores(name, weights, rows):
        return f"""{name} AS (
  SELECT r.id, r.y, wt.class_idx, sum(wt.w * r.x) AS z FROM {rows} r JOIN {weights} wt ON wt.j = r.j GROUP BY ALL)"""

    def metrics(name, zs):
        return f"""{name}p AS (
  SELECT id, y, class_idx, z, max(z) OVER (PARTITION BY id) AS m,
         row_number() OVER (PARTITION BY id ORDER BY z DESC, class_idx) AS rk FROM {zs}),
{name}e AS (SELECT id, y, class_idx, z, m, rk, sum(exp(z - m)) OVER (PARTITION BY id) AS s FROM {name}p),
{name}m AS (
  SELECT sum(CASE WHEN class_idx = y THEN ln(s) + m - z END) / count(DISTINCT id) AS loss,
         sum(CASE WHEN rk = 1 AND class_idx = y THEN 1 ELSE 0 END) / {_dbl('count(DISTINCT id)')} AS acc,
         count(DISTINCT id) AS n FROM {name}e)"""

    def step(k, zs, before, moments):
        t = f"s{k}"
        return f"""{metrics(t, zs)},
{t}g AS (
  SELECT e.class_idx, r.j, sum((exp(e.z - e.m) / e.s - CASE WHEN e.class_idx = e.y THEN 1 ELSE 0 END) * r.x) AS g
  FROM {t}e e JOIN tr r ON r.id = e.id GROUP BY ALL),
{t}u AS (
  SELECT b.class_idx, b.j, b.w, g.g / (SELECT n FROM {t}m) + {_dbl(_FIT_DECAY)} * b.w AS g, {moments}
  FROM {before} b JOIN {t}g g ON g.class_idx = b.class_idx AND g.j = b.j),
w{k} AS (
  SELECT class_idx, j, m, v,
         w - {_dbl(_FIT_LR)} * (m / (1 - power({_dbl('0.9')}, {k}))) / (sqrt(v / (1 - power({_dbl('0.999')}, {k}))) + {_dbl('1e-8')}) AS w
  FROM (SELECT class_idx, j, w, {_dbl('0.9')} * m0 + (1 - {_dbl('0.9')}) * g AS m,
               {_dbl('0.999')} * v0 + (1 - {_dbl('0.999')}) * g * g AS v FROM {t}u))"""

    rows = """rows AS (
  SELECT vec_id AS id, CAST(label AS INTEGER) AS y, j,
         CASE WHEN j < 64 THEN CAST(embedding[j + 1] AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS x
  FROM embeddings, range(65) t(j)),
tr AS (SELECT * FROM rows WHERE id % 4 <> 0),
va AS (SELECT * FROM rows WHERE id % 4 = 0),
w0 AS (SELECT c AS class_idx, j, CAST(0 AS DOUBLE) AS w FROM range(10) a(c), range(65) b(j))"""
    zero = f"{_dbl(0)} AS m0, {_dbl(0)} AS v0"
    return _with(rows, scores("z1", "w0", "tr"), step(1, "z1", "w0", zero), scores("q1", "w1", "va"), metrics("v1", "q1"),
                 scores("z2", "w1", "tr"), step(2, "z2", "w1", "b.m AS m0, b.v AS v0"), scores("q2", "w2", "va"),
                 metrics("v2", "q2")) + "\nUNION ALL".join(f"""
SELECT 'embeddings' AS run_id, CAST({k} AS INTEGER) AS epoch, round(s.loss, 6) AS train_loss, round(s.acc, 6) AS train_acc,
       round(v.loss, 6) AS val_loss, round(v.acc, 6) AS val_acc, {_dbl(_FIT_LR)} AS lr FROM s{k}m s, v{k}m v"""
                                                        for k in (1, 2))


@register("fit_head", _fit_sql())
def q_fit_head(spark, sf):
    """Two full-batch epochs from zero weights."""
    import numpy as np
    feats = _features(spark, sf)
    test = X.is_test_split(F.col("id"))
    res = HD.fit_head(feats.where(~test), feats.where(test), X.N_LOGITS, initial=(np.zeros((X.N_LOGITS, 64)), np.zeros(X.N_LOGITS)),
                      opts=HD.HeadOptions(lr=_FIT_LR, weight_decay=_FIT_DECAY, epochs=2, run_id="embeddings"))
    return res.history.select("run_id", "epoch", *[r6(F.col(c)).alias(c) for c in
                                                   ("train_loss", "train_acc", "val_loss", "val_acc")], "lr")


_BATCH = 256


def _fit_batches_sql() -> str:
    """Two epochs of 256-row batches from zero weights: the rows of an epoch in md5 order, cut every 256; each step of
    the recursion is the softmax gradient of one batch and one Adam update.  State 0 has the first weights."""
    ten = f"list_transform(range(65), lambda j: {_dbl(0)})"
    softmax = """SELECT *, exp(z - m) / sum(exp(z - m)) OVER (PARTITION BY {by}) AS p,
                ln(sum(exp(z - m)) OVER (PARTITION BY {by})) + m AS lse,
                row_number() OVER (PARTITION BY {by} ORDER BY z DESC, c) AS rk
         FROM (SELECT *, max(z) OVER (PARTITION BY {by}) AS m FROM ({zs}))"""
    step = softmax.format(by="id", zs="""SELECT st.step, st.c, st.w, st.m1, st.m2, r.id, r.y, r.xs, r.n,
                                               list_dot_product(r.xs, st.w) AS z
                                        FROM st JOIN tr r ON r.step = st.step + 1""")

    def scored(rows, on):
        return softmax.format(by="step, id", zs=f"""SELECT st.step, st.c, r.id, r.y,
                 list_dot_product(r.xs, st.w) AS z FROM st JOIN {rows} r ON {on}""")
    return f"""WITH RECURSIVE rows AS (
  SELECT vec_id AS id, CAST(label AS INTEGER) AS y,
         list_append(list_transform(embedding, lambda e: CAST(e AS DOUBLE)), {_dbl(1)}) AS xs FROM embeddings),
dealt AS (
  SELECT *, (row_number() OVER (PARTITION BY epoch ORDER BY md5('42:' || epoch || ':' || id), id) - 1) // {_BATCH} AS b
  FROM (SELECT rows.*, t.epoch FROM rows, range(1, 3) t(epoch) WHERE id % 4 <> 0)),
k AS (SELECT max(b) + 1 AS k FROM dealt),
tr AS (SELECT *, (epoch - 1) * k + b + 1 AS step, count(*) OVER (PARTITION BY epoch, b) AS n FROM dealt, k),
st AS (
  SELECT CAST(0 AS BIGINT) AS step, c, {ten} AS w, {ten} AS m1, {ten} AS m2 FROM range(10) t(c)
  UNION ALL
  SELECT step + 1, c,
         list(w - {_dbl(_FIT_LR)} * (m1 / (1 - power({_dbl('0.9')}, step + 1)))
              / (sqrt(m2 / (1 - power({_dbl('0.999')}, step + 1))) + {_dbl('1e-8')}) ORDER BY j),
         list(m1 ORDER BY j), list(m2 ORDER BY j)
  FROM (SELECT step, c, j, w, {_dbl('0.9')} * m1 + (1 - {_dbl('0.9')}) * g AS m1,
               {_dbl('0.999')} * m2 + (1 - {_dbl('0.999')}) * g * g AS m2
        FROM (SELECT step, c, j, any_value(w[j]) AS w, any_value(m1[j]) AS m1, any_value(m2[j]) AS m2,
                     sum((p - CASE WHEN c = y THEN 1 ELSE 0 END) * xs[j]) / any_value(n)
                     + {_dbl(_FIT_DECAY)} * any_value(w[j]) AS g
              FROM ({step}), range(1, 66) t(j) GROUP BY step, c, j))
  GROUP BY step, c),
s AS (
  SELECT (step // k) + 1 AS epoch, sum(CASE WHEN c = y THEN lse - z END) / count(DISTINCT id) AS loss,
         sum(CASE WHEN rk = 1 AND c = y THEN 1 ELSE 0 END) / {_dbl('count(DISTINCT id)')} AS acc
  FROM ({scored("tr", "r.step = st.step + 1")}), k GROUP BY 1),
v AS (
  SELECT step // k AS epoch, sum(CASE WHEN c = y THEN lse - z END) / count(DISTINCT id) AS loss,
         sum(CASE WHEN rk = 1 AND c = y THEN 1 ELSE 0 END) / {_dbl('count(DISTINCT id)')} AS acc
  FROM ({scored("(SELECT rows.*, k FROM rows, k WHERE id % 4 = 0)", "st.step > 0 AND st.step % r.k = 0")}), k GROUP BY 1)
SELECT 'batches' AS run_id, CAST(epoch AS INTEGER) AS epoch, round(s.loss, 6) AS train_loss, round(s.acc, 6) AS train_acc,
       round(v.loss, 6) AS val_loss, round(v.acc, 6) AS val_acc, {_dbl(_FIT_LR)} AS lr
FROM s JOIN v USING (epoch)"""


@register("fit_head_batches", _fit_batches_sql())
def q_fit_head_batches(spark, sf):
    """Two epochs of 256-row mini-batches in the seeded order of D1, the last batch as large as what is left."""
    import numpy as np
    feats = _features(spark, sf)
    test = X.is_test_split(F.col("id"))
    res = HD.fit_head(feats.where(~test), feats.where(test), X.N_LOGITS, initial=(np.zeros((X.N_LOGITS, 64)), np.zeros(X.N_LOGITS)),
                      opts=HD.HeadOptions(lr=_FIT_LR, weight_decay=_FIT_DECAY, epochs=2, batch_size=_BATCH, seed=X.SEED,
                                          run_id="batches"))
    return res.history.select("run_id", "epoch", *[r6(F.col(c)).alias(c) for c in
                                                   ("train_loss", "train_acc", "val_loss", "val_acc")], "lr")


@register("head_roundtrip", """
WITH long AS (SELECT CAST(label AS INTEGER) AS class_idx, j, CAST(embedding[j + 1] AS DOUBLE) AS x
              FROM embeddings, range(64) t(j)),
means AS (SELECT class_idx, j, avg(x) AS w FROM long GROUP BY 1, 2),
b AS (SELECT class_idx, -0.5 * sum(w * w) AS bias FROM means GROUP BY 1)
SELECT 'centroid' AS run_id, 'final' AS kind, m.class_idx, round(b.bias, 6) AS bias,
       CAST(m.j AS INTEGER) AS j, round(m.w, 6) AS w
FROM means m JOIN b ON b.class_idx = m.class_idx""")
def q_head_roundtrip(spark, sf):
    path = scratch_path(spark, "head")
    SRC.write_head(X.centroid_head(_features(spark, sf)), path)
    back = SRC.read_head(spark, path, run_id="centroid", kind="final")
    return back.select("run_id", "kind", "class_idx", r6(F.col("bias")).alias("bias"),
                       F.posexplode("weights").alias("j", "w")).select(
        "run_id", "kind", "class_idx", "bias", F.col("j").cast("int").alias("j"), r6(F.col("w")).alias("w"))


@register("image_scan", """
SELECT vec_id AS key, 'class_' || CAST(label AS VARCHAR) AS label, CAST(i AS INTEGER) AS i,
       round(CAST(CAST(floor((CAST(embedding[i // 3 + 1] AS DOUBLE) + 1) * 127.5) AS FLOAT) AS DOUBLE), 6) AS value
FROM embeddings, range(192) t(i)""")
def q_image_scan(spark, sf):
    """PNG files (written from the 8-bit 8 x 8 fixture) scanned by Spark's image
    source, channel-fixed to RGB, and joined to metadata rows by path."""
    emb = X.embeddings(spark, sf)
    folder = scratch_path(spark, "images")
    local = folder[len("file:"):] if folder.startswith("file:") else folder
    IMG.write_png_files(X.tensors_8x8(emb, eight_bit=True), local)
    meta = emb.select(F.col("vec_id").alias("key"),
                      F.concat(F.lit(local.rstrip("/") + "/"), F.col("vec_id").cast("string"), F.lit(".png"))
                       .alias("image_path"),
                      F.concat(F.lit("class_"), F.col("label").cast("string")).alias("label"))
    joined = IMG.attach_images(meta, IMG.scan_images(spark, folder, invalid="flag"), folder=folder)
    return (joined.select("key", "label", F.posexplode(F.col("tensor")["data"]).alias("i", "v"))
                  .select("key", "label", F.col("i").cast("int").alias("i"),
                          r6(F.col("v").cast("double")).alias("value")))


def _small_train_pipeline_sql() -> str:
    """The small-run preset (size 2) on the 8-bit 8 x 8 x 3 tensor: resize, flip,
    rotation (+-10), unit scale, normalise."""
    return _with(f"base AS ({_WHOLE})", _resize_sql("base", 3, 2, _pixel3, True).strip(),
                 _turn_sql("rz", 2, 10.0, "").strip()) + _tensor_rows("rot", 2, 3, _NORM)


@register("pipeline_small_train", _small_train_pipeline_sql())
def q_pipeline_small_train(spark, sf):
    """I9, the small three-class run's preset: resize, flip, rotate (10), unit, normalise."""
    t = X.tensors_8x8x3(X.embeddings(spark, sf), eight_bit=True)
    return explode_tensor(T.pipeline(t, T.small_train_preset(2, seed=X.SEED, epoch=1, key="key")))


_GRAD_SQL = _head_sql() + """, mx AS (
  SELECT id, max(logit) AS m FROM lin GROUP BY id),
e AS (
  SELECT lin.id, lin.label_idx, lin.class_idx, exp(lin.logit - mx.m) AS ex FROM lin JOIN mx ON mx.id = lin.id),
p AS (
  SELECT id, class_idx, ex / sum(ex) OVER (PARTITION BY id)
         - CASE WHEN class_idx = label_idx THEN 1.0 ELSE 0.0 END AS dz FROM e),
g AS (
  SELECT p.class_idx, t.j, sum(p.dz * CAST(emb.embedding[t.j + 1] AS DOUBLE)) AS grad
  FROM p JOIN embeddings emb ON emb.vec_id = p.id, range(64) t(j) GROUP BY 1, 2
  UNION ALL
  SELECT class_idx, 64 AS j, sum(dz) AS grad FROM p GROUP BY 1)"""


@register("head_gradient", _with(_GRAD_SQL) + """
SELECT CAST(class_idx AS INTEGER) AS class_idx, CAST(j AS INTEGER) AS j, round(grad, 4) AS grad FROM g""")
def q_head_gradient(spark, sf):
    """D4's core step: the full-batch gradient of the summed softmax loss at the
    fixture head, from the training kernel's per-partition sums.  Row j = 64
    holds the bias gradient."""
    return _gradient(spark, sf).select("class_idx", "j", F.round("grad", 4).alias("grad"))


def _gradient(spark, sf):
    import numpy as np
    w, b = (np.asarray(x) for x in X.fixture_head())
    n_cls, dim = w.shape
    rows = HD.training_rows(_features(spark, sf), n_cls, dim, "features", "label_idx")
    i = F.col("i")
    in_w = i < n_cls * dim
    return HD.sums(rows, w, b).where(i < n_cls * (dim + 1)).select(
        F.when(in_w, F.floor(i / dim)).otherwise(i - n_cls * dim).cast("int").alias("class_idx"),
        F.when(in_w, i % dim).otherwise(dim).cast("int").alias("j"), F.col("v").alias("grad"))


def _adam_sql() -> str:
    d = "CAST({} AS DOUBLE)".format
    w0 = (f"CASE WHEN j < 64 THEN CAST(((31 * class_idx + 17 * j) % 11) - 5 AS DOUBLE) / 10.0 "
          f"ELSE CAST(class_idx AS DOUBLE) / 100.0 END")
    return _with(_GRAD_SQL) + f""", n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM embeddings),
gw AS (
  SELECT class_idx, j, {w0} AS w0, grad / n.n + {d('1e-4')} * ({w0}) AS gg FROM g, n),
st AS (
  SELECT class_idx, j, w0,
         (({d('1.0')} - {d('0.9')}) * gg) / ({d('1.0')} - {d('0.9')}) AS m_hat,
         ((({d('1.0')} - {d('0.999')}) * gg) * gg) / ({d('1.0')} - {d('0.999')}) AS v_hat
  FROM gw)
SELECT CAST(class_idx AS INTEGER) AS class_idx, CAST(j AS INTEGER) AS j,
       round(w0 - ({d('0.001')} * m_hat) / (sqrt(v_hat) + {d('1e-8')}), 6) AS w
FROM st"""


@register("head_adam_step", _adam_sql())
def q_head_adam_step(spark, sf):
    """D4's update rule: one Adam step (lr 1e-3, L2 1e-4 in the gradient, zero
    moments) from the fixture head, on the full-batch gradient of the training
    kernel.  Row j = 64 holds the bias."""
    n = _features(spark, sf).agg(F.count(F.lit(1)).cast("double")).scalar()
    c, j = F.col("class_idx"), F.col("j")
    w0 = F.when(j < 64, (((31 * c + 17 * j) % 11) - 5) / F.lit(10.0)).otherwise(c / F.lit(100.0))
    g = _gradient(spark, sf).withColumn("w0", w0)
    new, _, _ = HD.adam_step(F.col("w0"), F.col("grad") / n + 1e-4 * F.col("w0"), F.lit(0.0), F.lit(0.0), 1, 1e-3)
    return g.select("class_idx", "j", F.round(new, 6).alias("w"))


@register("head_dictionary_roundtrip", _with(SQL_DICT) + "SELECT label_idx, label FROM dict")
def q_head_dictionary_roundtrip(spark, sf):
    """The class dictionary kept beside a run's head; written twice, it is there once."""
    path = scratch_path(spark, "head")
    d = C.class_dictionary(X.class_names(X.embeddings(spark, sf)))
    for _ in range(2):
        SRC.write_dictionary(d, "centroid", path)
    SRC.write_dictionary(d.where("label_idx > 1"), "other", path)
    return SRC.read_dictionary(spark, path, "centroid")
