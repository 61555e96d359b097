"""Driver contract: entry smoke check and every oracle at the smallest scale."""

import importlib
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    entry = importlib.import_module("__spark_entry__")
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["true_idx", "pred_idx", "true_label", "pred_label", "n"]
    assert 0 < len(rows) <= 10


def test_oracle_keys_are_queries():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_all_oracles_match_at_smallest_scale(spark):
    import oracle_compare as oc
    entry = importlib.import_module("__spark_entry__")
    con = oc.duck(SF)
    bad = []
    for name, fn in entry.queries().items():
        if fn.__module__.startswith(("samplecraft.llm", "corpus_pipeline")):
            continue  # checked by their own tests
        msg, ok = oc.compare(spark, name, fn, entry.oracle_sql().get(name), SF, con)
        if not ok:
            bad.append(msg)
    assert not bad, "\n".join(bad)


def test_python_stages_work_from_a_foreign_directory(tmp_path):
    """The driver imports __spark_entry__ from elsewhere: workers must still import the package."""
    import subprocess
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "run.py"
    script.write_text(
        "import importlib.util\n"
        f"spec = importlib.util.spec_from_file_location('e', {os.path.join(repo, '__spark_entry__.py')!r})\n"
        "m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        f"print('ROWS', m.queries()['tensor_resize'](s, {SF!r}).count())\n")
    out = subprocess.run([sys.executable, str(script)], cwd=str(tmp_path), capture_output=True, text=True,
                         timeout=600)
    assert "ROWS 8000" in out.stdout, out.stderr[-2000:]


SURVEY_KEYS = """manifest_lines manifest_parse manifest_tag metadata_roundtrip metadata_scan image_scan
run_log_scan history_roundtrip head_roundtrip split_filter class_filter preview random_sample row_fetch
class_consistency label_encode label_decode class_dictionary dataset_stats epoch_metrics batch_metrics
confusion_counts confusion_matrix class_errors running_best patience_counter early_stop plateau_lr
best_checkpoint top_confusions hardest_classes hardest_submatrix examples_correct examples_incorrect
combine_splits linear_logits argmax_predict cross_entropy tensor_resize tensor_unit tensor_normalize
tensor_denormalize tensor_hflip tensor_rotate tensor_crop tensor_jitter pipeline_eval pipeline_train
shuffle_batches sequential_batches score_rows fit_head history_from_events history_arrays history_series
heatmap_cells run_summary""".split()


def test_every_survey_query_key_is_registered():
    entry = importlib.import_module("__spark_entry__")
    assert not set(SURVEY_KEYS) - set(entry.queries())


def test_bench_prints_one_json_line_even_on_errors(tmp_path):
    import json
    import subprocess
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = dict(os.environ, BENCH_SF_DIR=str(tmp_path / "sf9"), BENCH_REPEAT="1",
               BENCH_QUERIES="preview,random_sample", BENCH_CPUS="2")
    out = subprocess.run([sys.executable, os.path.join(repo, "bench.py")], cwd=str(tmp_path), env=env,
                         capture_output=True, text=True, timeout=600)
    lines = [x for x in out.stdout.splitlines() if x.strip()]
    assert len(lines) == 1, out.stderr[-2000:]
    d = json.loads(lines[0])
    assert d["unit"] == "sec" and set(d["queries"]) == {"preview", "random_sample"} and "errors" in d
