"""Golden run histories: the seven logged runs (FIXTURES.md section 3)."""

import io
import math
import os
import tempfile

from pyspark.sql import functions as F

from samplecraft.operators import history as H
from samplecraft.sources import run_log as RL

GOLDEN = """run_id,epoch,train_loss,train_acc,val_loss,val_acc
r1,1,0.827652186817593,0.6417777777777778,0.4990295289357503,0.8013333333333333
r1,2,0.46081510461701286,0.8742222222222222,0.3045798537731171,0.9186666666666666
r1,3,0.35639616809950936,0.8955555555555555,0.25628911805152893,0.9226666666666666
r1,4,0.3159038238260481,0.9008888888888889,0.2183007483482361,0.936
r1,5,0.2799499464564853,0.9097777777777778,0.1899042176802953,0.948
r2,1,0.9441612888442146,0.584,0.6859289518992107,0.76
r2,2,0.6459797515339322,0.808,0.4232623079617818,0.8866666666666667
r2,3,0.5049331976572673,0.8431111111111111,0.30309974106152854,0.9213333333333333
r2,4,0.4380127112335629,0.8573333333333333,0.24464973560969036,0.9333333333333333
r2,5,0.38710346399413215,0.8804444444444445,0.2140582188765208,0.936
r3,1,,0.36856765676567654,2.115006977855569,0.4518019801980198
r3,2,,0.5699009900990099,1.4945466311426445,0.5938217821782178
r3,3,,0.6276303630363036,1.3298367576032581,0.6396039603960396
r3,4,,0.6613597359735973,1.2499136078711783,0.656950495049505
r3,5,,0.6864686468646864,1.1384722483606622,0.6874455445544555
r3,6,,0.704976897689769,1.1219886935772283,0.6909702970297029
r3,7,,0.7233135313531354,1.1220849230926815,0.6914851485148514
r3,8,,0.7373465346534653,1.0796802072902718,0.7025742574257425
r3,9,,0.7513795379537954,1.1051576087309583,0.6994455445544554
r3,10,,0.762970297029703,1.0956982403745745,0.7012673267326732
r3,11,,0.7732409240924092,1.102961734752844,0.7034455445544554
r3,12,,0.7837491749174917,1.0917982672984057,0.7042376237623762
r3,13,,0.8215841584158415,1.0017504196355838,0.7281980198019802
r3,14,,0.8332409240924092,1.0066590197440421,0.7283960396039604
r3,15,,0.8384290429042904,1.0099262865935221,0.7283564356435643
r3,16,,0.8422574257425742,1.0173209014363809,0.7284752475247525
r3,17,,0.8446336633663366,1.0241865871353906,0.726059405940594
r3,18,,0.848897689768977,1.02774549244418,0.7269306930693069
r4,1,0.6433945732116699,0.8048888888888889,0.20045956869920095,0.9826666666666667
r4,2,0.22367033211390178,0.9466666666666667,0.09372538069883983,0.9893333333333333
r4,3,0.15442614698410034,0.9582222222222222,0.06781278642018636,0.992
r4,4,0.13190242759386697,0.9608888888888889,0.0573166774113973,0.992
r4,5,0.11708185013135275,0.9693333333333334,0.05150974954168002,0.9906666666666667
r5,1,0.7912362645467123,0.7608888888888888,0.3889071348508199,0.972
r5,2,0.37865512198872037,0.9288888888888889,0.17589824740091958,0.988
r5,3,0.23743082047833336,0.9497777777777778,0.11041570170720419,0.9933333333333333
r5,4,0.18292028125127158,0.9528888888888889,0.08359262619415919,0.9933333333333333
r5,5,0.1577477913432651,0.9551111111111111,0.06984161047140758,0.992
r5,6,0.14026200207736758,0.9635555555555556,0.06280754907925924,0.9906666666666667
r5,7,0.13042602455615998,0.9644444444444444,0.05786433500051499,0.9906666666666667
r5,8,0.11654795470502642,0.972,0.053826763888200124,0.992
r5,9,0.11152748446332084,0.9706666666666667,0.05075910274187724,0.992
r5,10,0.10851716111765967,0.9702222222222222,0.04842875305811564,0.9906666666666667
r6,1,0.9558212281333076,0.5844444444444444,0.6221897470156351,0.9293333333333333
r6,2,0.6791250348620944,0.8364444444444444,0.4433737376530965,0.9386666666666666
r6,3,0.531097232553694,0.8626666666666667,0.36732615931828816,0.932
r6,4,0.447610708422131,0.8751111111111111,0.3246182125409444,0.9346666666666666
r6,5,0.39781257865164016,0.8951111111111111,0.2954220445156097,0.9333333333333333
r7,1,1.7072736349515003,0.5748646864686469,0.9167080271220444,0.7504554455445545
r7,2,1.025806305142519,0.7256369636963697,0.7620019344905815,0.7881188118811882
r7,3,0.8502361090490134,0.7662574257425743,0.7312484782167,0.7942178217821783
r7,4,0.746110806554851,0.7916171617161716,0.7387587649987476,0.7956039603960396
r7,5,0.6722427210650428,0.8105214521452145,0.71115320073496,0.8038415841584159
r7,6,0.6122153447941191,0.8265478547854785,0.7428112013080332,0.7952079207920792
r7,7,0.5700357564400524,0.8356171617161716,0.7395956849343706,0.8003960396039604
r7,8,0.5358844634534502,0.8423630363036304,0.7002612869857562,0.8108118811881189
r7,9,0.49618866191838834,0.85396699669967,0.7828171997400794,0.7970693069306931
r7,10,0.4712660122090834,0.8602640264026402,0.7260413394564449,0.8097425742574258
r7,11,0.44642534098452075,0.8673795379537954,0.7529421415706672,0.8031683168316832
r7,12,0.43193175381323684,0.8704818481848184,0.7533716156765966,0.8030891089108911
r7,13,0.2602577016695891,0.9244092409240924,0.6011927414058459,0.842059405940594
r7,14,0.19089502504989259,0.945069306930693,0.596218011705002,0.8464158415841584
r7,15,0.16443165972091184,0.9536897689768977,0.600670305568393,0.8465742574257425
r7,16,0.1453541081168077,0.9597095709570957,0.606984490491376,0.8491881188118812
r7,17,0.13184510638218114,0.962917491749175,0.6107700907593907,0.8493465346534653
r7,18,0.12213706555067509,0.96603300330033,0.6223911641163401,0.8483564356435643
r7,19,0.10552458237736138,0.9718415841584158,0.6193043592755157,0.8495049504950495
"""

RUNS = [("r1", "MobileNetV2", 3, 5, 128, 87.45), ("r2", "MobileNetV3-Small", 3, 5, 256, 70.82),
        ("r3", "MobileNetV3-Small", None, 20, 1024, 5276.34), ("r4", "ConvNeXT Tiny", 3, 5, 128, 171.45),
        ("r5", "ConvNeXT Tiny", 3, 10, 256, 352.04), ("r6", "EfficientNet-B0", 3, 5, 256, 113.25),
        ("r7", "EfficientNet-B0", None, 20, 256, 7660.59)]


def golden(spark):
    import csv
    rows = []
    for r in csv.DictReader(io.StringIO(GOLDEN)):
        f = lambda k: float(r[k]) if r[k] else None
        rows.append((r["run_id"], int(r["epoch"]), f("train_loss"), f("train_acc"), f("val_loss"), f("val_acc")))
    return spark.createDataFrame(rows, "run_id string, epoch int, train_loss double, train_acc double, "
                                       "val_loss double, val_acc double")


def test_golden_early_stop_and_best(spark):
    h = golden(spark)
    assert h.count() == 67
    stops = {r.run_id: r.stop_epoch for r in H.early_stop(h, 5).select("run_id", "stop_epoch").distinct().collect()}
    assert stops == {"r1": None, "r2": None, "r3": 18, "r4": None, "r5": None, "r6": None, "r7": 19}
    best = {r.run_id: r.best_epoch for r in H.best_checkpoint(h, 5).collect()}
    assert best == {"r1": 5, "r2": 5, "r3": 13, "r4": 5, "r5": 10, "r6": 5, "r7": 14}


def test_golden_plateau_cuts(spark):
    cuts = {}
    for r in H.plateau_lr(golden(spark)).where("cut").collect():
        cuts.setdefault(r.run_id, []).append(r.epoch)
    assert cuts == {"r3": [12, 17], "r7": [12, 18]}
    lr = {(r.run_id, r.epoch): r.lr for r in H.plateau_lr(golden(spark)).collect()}
    assert abs(lr[("r7", 19)] - 1e-5) < 1e-12 and lr[("r1", 5)] == 1e-3


def test_patience_counter_resets(spark):
    pc = {r.epoch: r.bad_epochs for r in H.patience_counter(golden(spark), 5).where("run_id = 'r3'").collect()}
    assert pc[13] == 0 and pc[18] == 5 and pc[8] == 0 and pc[12] == 4


def test_nan_never_improves(spark):
    h = spark.createDataFrame([("a", 1, float("nan")), ("a", 2, 1.0), ("a", 3, float("nan"))],
                              "run_id string, epoch int, val_loss double")
    got = [r.improved for r in H.running_best(h).orderBy("epoch").collect()]
    assert got == [False, True, False]


def test_arrays_series_and_summary(spark):
    h = golden(spark)
    arr = {r.run_id: r for r in H.history_arrays(h).collect()}
    assert arr["r1"].epochs == [1, 2, 3, 4, 5] and arr["r3"].train_losses == [None] * 18
    series = H.history_series(h)
    assert series.count() == 67 * 4 - 18
    runs = spark.createDataFrame(RUNS, "run_id string, model string, n_classes int, epochs_asked int, "
                                       "batch_size int, seconds double")
    s = {r.run_id: r for r in H.run_summary(runs, h).collect()}
    assert s["r3"].epochs_run == 18 and s["r3"].best_loss_epoch == 13 and s["r3"].best_acc_epoch == 16
    assert abs(s["r7"].last_train_acc - 0.9718415841584158) < 1e-15
    assert abs(s["r1"].seconds_per_epoch - 17.49) < 1e-9


def _ref_layout_log(h, runs) -> str:
    """Text in the layout of the hand-kept log, with its defects: run 3 has
    train_accs twice and no train_losses; run 7's val_losses breaks over two lines."""
    by = {}
    for r in h.orderBy("run_id", "epoch").collect():
        by.setdefault(r.run_id, []).append(r)
    blocks = []
    for run_id, model, ncls, ep, bs, sec in runs:
        rows = by[run_id]
        def lst(k):
            return "[" + ", ".join(repr(getattr(r, k)) for r in rows) + "]"
        scope = "всех" if ncls is None else str(ncls)
        lines = [f"{model} на {scope} классах {ep} эпох батч {bs}:"]
        if run_id == "r3":
            lines += [f"train_accs = {lst('train_acc')}", f"train_accs = {lst('train_acc')}"]
        else:
            lines += [f"train_losses = {lst('train_loss')}", f"train_accs = {lst('train_acc')}"]
        vl = lst("val_loss")
        if run_id == "r7":
            cut = vl.index(", ", len(vl) // 2)
            vl = vl[:cut + 1] + "\n" + vl[cut + 2:]
        lines += [f"val_losses = {vl}", f"val_accs = {lst('val_acc')}", f"Обучение завершено за {sec:.2f} секунд."]
        blocks.append("\n".join(lines))
    return "\n\n".join(blocks) + "\n"


def test_run_log_scan_reads_defective_log(spark):
    h = golden(spark)
    d = tempfile.mkdtemp(prefix="runlog-test-")
    with open(os.path.join(d, "runs.log"), "w", encoding="utf-8") as fh:
        fh.write(_ref_layout_log(h, RUNS))
    runs, hist = RL.scan_run_log(spark, d)
    assert runs.count() == 7 and hist.count() == 67
    r3 = runs.where(F.col("model") == "MobileNetV3-Small").where(F.col("n_classes").isNull()).first()
    assert r3.epochs_asked == 20 and r3.batch_size == 1024 and r3.seconds == 5276.34
    r3_rows = hist.where(F.col("run_id") == "MobileNetV3-Small всех 20 1024").collect()
    assert len(r3_rows) == 18 and all(r.train_loss is None for r in r3_rows)
    stops = {r.run_id: r.stop_epoch for r in H.early_stop(hist, 5).select("run_id", "stop_epoch").distinct().collect()}
    assert sorted(v for v in stops.values() if v) == [18, 19]
    orig = sorted((r.val_loss, r.val_acc, r.train_acc) for r in h.collect())
    got = sorted((r.val_loss, r.val_acc, r.train_acc) for r in hist.collect())
    assert orig == got


def test_log_writer_roundtrip(spark):
    h = golden(spark)
    runs = spark.createDataFrame(RUNS, "run_id string, model string, n_classes int, epochs_asked int, "
                                       "batch_size int, seconds double")
    from samplecraft.session import scratch_path
    path = scratch_path(spark, "runlog-rt")
    RL.write_run_log(runs, h, path)
    r2, h2 = RL.scan_run_log(spark, path)
    assert sorted((tuple(r)[1:] for r in r2.collect()), key=repr) == \
        sorted((tuple(r)[1:] for r in runs.collect()), key=repr)
    assert sorted((tuple(r)[1:] for r in h2.collect()), key=repr) == \
        sorted((tuple(r)[1:] for r in h.collect()), key=repr)


def test_run_log_repeated_header_and_crlf(spark):
    block = ("M на 3 классах 2 эпох батч 8:\ntrain_losses = [1.0, 0.5]\ntrain_accs = [0.1, 0.2]\n"
             "val_losses = [0.9, 0.8]\nval_accs = [0.3, 0.4]\nОбучение завершено за 1.50 секунд.")
    d = tempfile.mkdtemp(prefix="runlog-rep-")
    with open(os.path.join(d, "log.txt"), "w", encoding="utf-8", newline="") as fh:
        fh.write((block + "\n\n" + block.replace("0.9", "0.7") + "\n").replace("\n", "\r\n"))
    runs, hist = RL.scan_run_log(spark, d, line_sep="\r\n")
    ids = sorted(r.run_id for r in runs.collect())
    assert ids == ["M 3 2 8", "M 3 2 8#2"]
    first = {r.epoch: r.val_loss for r in hist.where(F.col("run_id") == "M 3 2 8").collect()}
    assert first == {1: 0.9, 2: 0.8}
    assert hist.count() == 4


def test_run_log_crlf_and_missing_blank_lines_without_options(spark):
    block = ("M на 3 классах 2 эпох батч 8:\ntrain_losses = [1.0, 0.5]\ntrain_accs = [0.1, 0.2]\n"
             "val_losses = [0.9, 0.8]\nval_accs = [0.3, 0.4]\nОбучение завершено за 1.50 секунд.")
    other = block.replace("M на 3", "N на всех").replace("0.9", "0.7")
    d = tempfile.mkdtemp(prefix="runlog-crlf-")
    with open(os.path.join(d, "a.txt"), "w", encoding="utf-8", newline="") as fh:
        fh.write((block + "\n\n" + other + "\n").replace("\n", "\r\n"))   # Windows line ends
    with open(os.path.join(d, "b.txt"), "w", encoding="utf-8") as fh:
        fh.write(other.replace("N на", "K на") + "\n" + block.replace("M на", "J на") + "\n")  # no blank line
    runs, hist = RL.scan_run_log(spark, d)
    assert sorted(r.model for r in runs.collect()) == ["J", "K", "M", "N"]
    assert hist.count() == 8
    assert {r.epoch: r.val_loss for r in hist.where(F.col("run_id").startswith("N ")).collect()} == {1: 0.7, 2: 0.8}


def test_run_log_keeps_nan_rejects_and_many_repeats(spark, tmp_path):
    from samplecraft.sources import run_log as RL
    head = "Net на 3 классах 5 эпох батч 128:"
    block = head + "\ntrain_losses = [inf, 1.5,\n 0.5]\nval_losses = [nan, 0.7]\nval_accs = []\nОбучение завершено за 3.50 секунд."
    folder = tmp_path / "logs"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.txt").write_text("a note without a header\n\n" + "\n\n".join([block] * 4) + "\n\n", encoding="utf-8")
    runs, hist = RL.scan_run_log(spark, str(folder))
    ids = sorted(r.run_id for r in runs.collect())
    assert ids == sorted([f"Net 3 5 128{'' if n == 1 else f'#{n}'}" for n in range(1, 13)])
    rows = hist.where("run_id = 'Net 3 5 128#7'").orderBy("epoch").collect()
    assert [r.train_loss for r in rows] == [math.inf, 1.5, 0.5] and [r.train_acc for r in rows] == [None] * 3
    assert math.isnan(rows[0].val_loss) and [r.val_loss for r in rows[1:]] == [0.7, None]
    bad = RL.rejected_blocks(spark, str(folder)).collect()
    assert [r.value.strip() for r in bad] == ["a note without a header"] * 3
