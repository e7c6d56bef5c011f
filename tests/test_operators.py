"""Hand cases for the traps and property checks of the scans,
the exact bucketed ranking, DARP and the sources."""

import math
import os
import tempfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sslspark.constants import OOD, UNLABELLED
from sslspark.functions import arrays as A
from sslspark.operators import adaptive, encode, lookup, metrics, policies, split, state
from sslspark.operators.imbalance import refine_to_target
from sslspark.sources import io


def test_ood_is_row_wise_t2(spark):
    # one outlier in a batch of size 1 is still flagged (the reference skips it)
    df = spark.createDataFrame([(1, 0, [0.5, 0.5], UNLABELLED), (2, 1, [0.99, 0.01], UNLABELLED),
                                (3, 1, [0.6, 0.4], 0)], "row_id int, batch_id int, probs array<double>, label_id int")
    out = {r.row_id: r.label_id for r in policies.ood_by_confidence(df, tau=0.9).collect()}
    assert out == {1: OOD, 2: UNLABELLED, 3: 0}


def test_encode_ood_and_unknown_t4_t5(spark):
    df = spark.createDataFrame([("Cytoplasm",), ("ood",), ("nonsense",), (None,)], "location string")
    got = [r.x for r in df.select(encode.encode_label("location", ["Cytoplasm", "Cell Membrane"]).alias("x")).collect()]
    assert got == [0, OOD, None, None]


def test_argmax_tie_first_index_t19(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2],)], "p array<double>")
    assert df.select(A.argmax("p")).first()[0] == 0


def test_micro_prf_equals_accuracy_t20(spark):
    df = spark.createDataFrame([(0, 0), (1, 2), (2, 2), (1, 1), (0, 1)], "truth int, pred int")
    acc = metrics.accuracy(df).first()[0]
    prf = metrics.precision_recall_f1(df).first()
    assert abs(prf.micro_precision - acc) < 1e-12 and abs(prf.micro_recall - acc) < 1e-12
    assert abs(prf.micro_f1 - acc) < 1e-12


def test_queue_mean_counts_zeros_before_full_t11(spark):
    df = spark.createDataFrame([(0, t, float(t + 1)) for t in range(5)], "class_id int, batch_id long, x double")
    out = {r.batch_id: r.v for r in state.queue_mean(df, ["class_id"], "batch_id", "x", 3, chunk=2).collect()}
    assert out == {0: 1 / 3, 1: 3 / 3, 2: 6 / 3, 3: 9 / 3, 4: 12 / 3}


def _fold(xs, a, init, first_sets=False, m=None):
    out, v = [], init
    for t, x in enumerate(xs):
        if m is not None:
            v = x if (first_sets and t == 0) else m * v + (1 - m) * x
        else:
            v = a * v + x
        out.append(v)
    return out


@pytest.mark.parametrize("m", [0.3, 0.7, 0.999])
def test_ema_chunked_equals_fold_t12(spark, m):
    xs = [math.sin(t) * 0.5 + 0.5 for t in range(120)]
    df = spark.createDataFrame([(0, t, x) for t, x in enumerate(xs)], "k int, batch_id long, x double")
    got = [r.v for r in state.ema(df, ["k"], "batch_id", "x", m, None).orderBy("batch_id").collect()]
    want = _fold(xs, None, 0.0, True, m)
    assert max(abs(a - b) for a, b in zip(got, want)) < 1e-12
    got2 = [r.v for r in state.ema(df, ["k"], "batch_id", "x", m, 0.25).orderBy("batch_id").collect()]
    want2 = _fold(xs, None, 0.25, False, m)
    assert max(abs(a - b) for a, b in zip(got2, want2)) < 1e-12


def test_running_sum_two_levels(spark):
    xs = [float((t * 7) % 5) for t in range(50)]
    df = spark.createDataFrame([(1, t, x) for t, x in enumerate(xs)], "k int, batch_id long, x double")
    got = [r.v for r in state.running_sum(df, ["k"], "batch_id", "x", chunk=4).orderBy("batch_id").collect()]
    acc, want = 0.0, []
    for x in xs:
        acc += x
        want.append(acc)
    assert got == want


def test_rank_select_matches_row_number_with_hot_key(spark):
    # one key holds most rows: the bucketed cut must equal the plain window
    rows = [(i, 0 if i % 3 else i % 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g int")
    sel = split.rank_select(df, ["g"], "id", 5, {"pick": lambda n: F.floor(n * 0.37).cast("long")})
    w = Window.partitionBy("g").orderBy(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit("5"))), "id")
    naive = df.withColumn("rn", F.row_number().over(w)).withColumn(
        "n", F.count(F.lit(1)).over(Window.partitionBy("g"))).withColumn("pick", F.col("rn") <= F.floor(F.col("n") * 0.37))
    a = {r.id: r.pick for r in sel.collect()}
    b = {r.id: r.pick for r in naive.collect()}
    assert a == b


def test_flexmatch_first_batch_all_masked_t14(spark):
    df = spark.createDataFrame([(i, 0, [0.6, 0.4]) for i in range(4)] + [(i, 1, [0.3, 0.7]) for i in range(4)],
                               "row_id int, batch_id long, probs array<double>")
    m = {(r.row_id, r.batch_id): r.mask for r in adaptive.flexmatch_mask(df, K=2, tau=0.95).collect()}
    # nothing ever reaches tau: all ids stay -1, a_c = 0, threshold 0 -> everything masked
    assert all(v == 1.0 for v in m.values())


def test_fallback_first_allowed_in_list_order_t27(spark):
    rows = spark.createDataFrame([("g1", "B")], "subj string, species string")
    prim = spark.createDataFrame([], "entity string, species_full string")
    fb = spark.createDataFrame([("g1", ["C", "B", "A"])], "entity string, species array<string>")
    x = lookup.primary_lookup(rows, prim, ["subj"], {"A": "A", "B": "B", "C": "C"})
    x = lookup.fallback_lookup(x, fb, ["subj"], ["A", "B", "C"])
    assert x.first().subj_species == "A"


def test_darp_rows_and_class_mass(spark):
    import random
    random.seed(1)
    rows = []
    for i in range(300):
        v = [random.random() + (2.0 if i % 3 == c else 0.0) for c in range(3)]
        s = sum(v)
        rows.append((i, [x / s for x in v]))
    df = spark.createDataFrame(rows, "row_id long, probs array<double>")
    target = [150.0, 100.0, 50.0]
    ref, _ = refine_to_target(df, target, num_iter=10)
    got = ref.select(F.posexplode("probs_refined").alias("c", "p")).groupBy("c").agg(F.sum("p").alias("m"))
    mass = {r.c: r.m for r in got.collect()}
    sums = [r[0] for r in ref.select(A.asum("probs_refined")).collect()]
    assert max(abs(s - 1) for s in sums) < 1e-9
    assert all(abs(mass[c] - target[c]) / target[c] < 0.05 for c in range(3))


def test_pipe_round_trip_and_augmentations(spark):
    d = tempfile.mkdtemp(prefix="sslspark-pipe-", dir="/tmp")
    corpus = spark.createDataFrame([(10, "a b"), (11, "c d")], "original_index long, text string")
    io.export_pipe(corpus, f"{d}/export")
    back = spark.read.option("sep", "|").csv(f"{d}/export").collect()
    assert sorted((r[0], r[1], r[2]) for r in back) == [("10", "10", "a b"), ("11", "11", "c d")]
    with open(f"{d}/aug.txt", "w") as fh:
        for k in range(6):
            fh.write(f"10|10|s{k}\n")
        fh.write("11|11|t0\n")
    lines = io.import_pipe(spark, f"{d}/aug.txt")
    wide = lookup.attach_augmentations(corpus, lines, "original_index", "line_no", "sentence",
                                       ["umls", "sr", "ri", "rs", "rd", "original"])
    got = {r.original_index: (r.umls, r.original) for r in wide.collect()}
    assert got == {10: ("s0", "s5"), 11: ("t0", None)}
    with open(f"{d}/bad.txt", "w") as fh:
        fh.write("10|10|x\n## header\n")
    with pytest.raises(ValueError):
        io.import_pipe(spark, f"{d}/bad.txt")


def test_json_records_and_path_lists(spark):
    d = tempfile.mkdtemp(prefix="sslspark-json-", dir="/tmp")
    with open(f"{d}/train.json", "w") as fh:
        fh.write('{"0": {"ori": "x", "aug_0": "y", "aug_1": "z", "label": 1}, "1": {"ori": "u", "aug_0": "v", "aug_1": "w", "label": 0}}')
    r = {x.idx: (x.views, x.label_id) for x in io.read_json_records(spark, f"{d}/train.json", "train").collect()}
    assert r == {0: (["x", "y", "z"], 1), 1: (["u", "v", "w"], 0)}
    t = io.read_json_records(spark, f"{d}/train.json", "test").first()
    assert t.views[1] is None and t.views[2] is None
    with open(f"{d}/list.txt", "w") as fh:
        fh.write("a/1.png 3\nb/2.png 4\n")
    with open(f"{d}/extra.txt", "w") as fh:
        fh.write("c/3.png 5\n")
    p = io.read_path_label_list(spark, f"{d}/list.txt", extra=f"{d}/extra.txt")
    assert sorted((x.path, x.label_id) for x in p.collect()) == [("a/1.png", 3), ("b/2.png", 4), ("c/3.png", 5)]


def test_class_dirs_distribution_and_cached_split(spark):
    d = tempfile.mkdtemp(prefix="sslspark-dirs-", dir="/tmp")
    for cls, n in [("zebra", 2), ("ant", 1)]:
        os.makedirs(f"{d}/img/{cls}")
        for i in range(n):
            open(f"{d}/img/{cls}/{i}.jpg", "w").write("x")
        open(f"{d}/img/{cls}/skip.txt", "w").write("x")
    c = io.read_class_dirs(spark, f"{d}/img", ["jpg"])
    got = sorted((r.class_name, r.label_id) for r in c.collect())
    assert got == [("ant", 0), ("zebra", 1), ("zebra", 1)]
    counts = spark.createDataFrame([(0, 0.25), (1, 0.75)], "class_id int, share double")
    io.write_class_distribution(counts, f"{d}/dist")
    txt = spark.read.text(f"{d}/dist").first()[0]
    assert txt == '{"distribution":[0.25,0.75]}'
    calls = []

    def compute():
        calls.append(1)
        return counts
    a = io.cached_split(spark, f"{d}/cache", {"num_labels": 40, "seed": 0}, compute)
    b = io.cached_split(spark, f"{d}/cache", {"num_labels": 40, "seed": 0}, compute)
    assert a.count() == b.count() == 2 and len(calls) == 1


def test_registry_and_composition(spark):
    from sslspark.operators import registry
    df = spark.createDataFrame([(1, 0, [0.97, 0.03], [3.0, -1.0])], "row_id int, batch_id long, probs array<double>, logits array<double>")
    assert registry.apply_policy(df, "fixmatch").first().mask == 1.0
    with pytest.raises(KeyError):
        registry.get_policy("nope")
    with pytest.raises(ValueError):
        registry.compose("debiaspl", "mixmatch")
    f = registry.compose("debiaspl", "fixmatch", {"num_classes": 2})
    assert f(df).count() == 1


def test_select_views_presets(spark):
    df = spark.createDataFrame([(1, "t", "u1", "s1", "r1", "unlabelled"), (2, "t2", "u2", "s2", "r2", "labelled")],
                               "id long, text string, umls string, sr string, ri string, role string")
    v = {r.id: (r.text_w, r.text_s) for r in encode.select_views(df, "fixmatch", "id").collect()}
    assert v[1][0] == "u1" and v[1][1] in ("s1", "r1") and v[2] == ("t2", None)
    # multi-task preset (T6): weak = text, strong views = umls, umls
    m = {r.id: (r.text_w, r.text_s) for r in encode.select_views(df, "mtl_fixmatch", "id", preset="multi_task").collect()}
    assert m[1] == ("t", "u1") and m[2] == ("t2", None)


def test_weighted_resample_exact_size_no_duplicates(spark):
    df = spark.createDataFrame([(i, 1.0 + (i % 4)) for i in range(500)], "row_id long, w double")
    s = split.resample_weighted(df, "row_id", "w", 120, seed=5)
    ids = [r.row_id for r in s.collect()]
    assert len(ids) == 120 and len(set(ids)) == 120


def test_tail_feature_synthesis_balances_classes(spark):
    from sslspark.operators.imbalance import tail_feature_synthesis
    lb_rows = [(i, [float(i), 1.0], [0.8, 0.2] if i < 6 else [0.3, 0.7], 0 if i < 6 else 1) for i in range(8)]
    lb = spark.createDataFrame(lb_rows, "row_id long, feat array<double>, probs array<double>, label_id int")
    ulb = spark.createDataFrame([(100 + i, [0.0, float(i)], [0.1 * (i % 10), 1 - 0.1 * (i % 10)]) for i in range(20)],
                                "row_id long, feat array<double>, probs array<double>")
    out = tail_feature_synthesis(lb, ulb, 2, seed=1)
    counts = {r.label_id: r.n for r in out.groupBy("label_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {0: 6, 1: 6}
    syn = out.filter("synthetic").collect()
    assert len(syn) == 4 and all(0.0 <= r.lam <= 1.0 for r in syn)
    again = {r.row_id: r.lam for r in tail_feature_synthesis(lb, ulb, 2, seed=1).filter("synthetic").collect()}
    assert again == {r.row_id: r.lam for r in syn}


def test_write_split_and_predictions(spark):
    d = tempfile.mkdtemp(prefix="sslspark-sink-", dir="/tmp")
    df = spark.createDataFrame([(1, "train", 0, 0), (2, "test", 1, 2)], "id long, split string, truth int, pred int")
    io.write_split(df, f"{d}/splits", partition_by=["split"])
    back = spark.read.parquet(f"{d}/splits")
    assert sorted((r.id, r.split) for r in back.collect()) == [(1, "train"), (2, "test")]
    io.write_predictions(df, f"{d}/preds", "truth", "pred", keep=["id"])
    got = {r.id: r.mismatch for r in spark.read.parquet(f"{d}/preds").collect()}
    assert got == {1: False, 2: True}


def test_score_ranks_with_hot_buckets(spark):
    """Scores crowding near 0, a third equal to 1: the ranks of row_number, no bucket above the target by much."""
    from pyspark.sql import Window
    df = spark.range(6000).select(F.col("id").alias("row_id"), (F.col("id") % 2).alias("g"), F.when(F.col("id") % 3 == 0, F.lit(1.0)).otherwise(
        F.pow(F.rand(1), 4) * 0.01).alias("p")).checkpoint()
    got = split.rank_select(df, ["g"], "row_id", 0, {"top": lambda n: F.floor(n * 0.4).cast("long")}, score=F.col("p"), rank_col="r", target=50)
    want = df.withColumn("w", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("p"), "row_id")))
    j = got.join(want.select("row_id", "w"), "row_id")
    assert j.count() == 6000 and j.filter("r <> w OR top <> (w <= 1200)").count() == 0
    base = split._split_large(df.withColumn("_s", F.col("p")).withColumn("_b", split.score_bucket(F.col("_s"))), ["g"], ["_b"], "row_id", "_b1", 50)
    assert base.groupBy("g", "_b", "_b1").count().agg(F.max("count")).first()[0] <= 50


def test_weighted_resample_is_fair_and_repeats(spark):
    df = spark.range(20000).select(F.col("id").alias("row_id"), F.lit(1.0 / 20000).alias("w"))
    s = split.resample_weighted(df, "row_id", "w", 2000, seed=1).agg(F.count("*"), F.avg("row_id")).first()
    assert s[0] == 2000 and abs(s[1] - 10000) < 600
    more = split.resample_weighted(df.limit(30), "row_id", "w", 70, seed=1)
    assert more.count() == 70 and more.groupBy("row_id").count().agg(F.min("count"), F.max("count")).first() == (2, 3)


def test_f1_without_a_right_prediction(spark):
    from sslspark.operators import metrics
    r = metrics.precision_recall_f1(spark.createDataFrame([(0, 1), (1, 0)], "truth int, pred int")).first()
    assert r["micro_f1"] == 0.0 and r["macro_f1"] == 0.0


def test_quota_by_rank_keeps_the_tail(spark):
    from sslspark.operators.imbalance import crest_quota
    assert crest_quota(3, 4.0, 1.0, by="rank", class_order=[2, 0, 1]) == pytest.approx([0.5, 1.0, 0.25])


def test_labelled_row_wins(spark):
    lb = spark.createDataFrame([(1, 5)], "row_id long, label_id int")
    ulb = spark.createDataFrame([(1, -200), (2, -200)], "row_id long, label_id int")
    assert sorted(map(tuple, split.full_supervised_pool(lb, ulb, "row_id").collect())) == [(1, 5), (2, -200)]


def test_step_gaps_do_not_change_state(spark):
    from sslspark.operators import adaptive
    rows = [(i, i // 4, [0.97, 0.03] if i % 3 else [0.02, 0.98]) for i in range(24)]
    df = spark.createDataFrame(rows, "row_id long, batch_id long, probs array<double>")
    gaps = df.withColumn("batch_id", F.col("batch_id") * 3 + 7)
    for f in (lambda d: adaptive.flexmatch_mask(d, K=2, tau=0.9), lambda d: adaptive.freematch_mask(d, K=2, m=0.5),
              lambda d: adaptive.align_distribution(d, K=2, m=0.5)):
        a, b = ({r["row_id"]: r.asDict() for r in f(d).drop("batch_id").collect()} for d in (df, gaps))
        assert a == b


def test_cached_split_keeps_what_it_cannot_read(spark):
    d = tempfile.mkdtemp(prefix="sslspark-split-", dir="/tmp")
    one = io.cached_split(spark, d, {"n": 1}, lambda: spark.range(5))
    assert one.count() == 5 and io.cached_split(spark, d, {"n": 1}, lambda: spark.range(9)).count() == 5


def test_crmatch_has_its_repulsion(spark):
    from sslspark.operators import registry
    rows = [(1, [0.99, 0.01], [3.0, 0.0], [1.0, 0.0], [1.0, 1.0]), (2, [0.99, 0.01], [3.0, 0.0], [1.0, 0.0], [-1.0, 0.0]), (3, [0.6, 0.4], [3.0, 0.0], [1.0, 0.0], [1.0, 0.0])]
    df = spark.createDataFrame(rows, "row_id long, probs array<double>, logits_s array<double>, ds array<double>, ds_s array<double>")
    got = {r["row_id"]: r for r in registry.apply_policy(df, "crmatch").collect()}
    assert abs(got[1]["repulsion_loss"] - 0.5 ** 0.5) < 1e-9 and got[2]["repulsion_loss"] == 0 and got[3]["repulsion_loss"] == 0
    assert abs(got[1]["unsup_loss"] - math.log1p(math.exp(-3.0))) < 1e-9 and got[3]["unsup_loss"] == 0


# --- state as of each batch, clamped scans, exact quantiles: against plain loops -------------------

def test_clamped_scan_matches_a_loop(spark):
    import random

    from sslspark.operators import state
    r = random.Random(1)
    rows = [(k, 3 * t + 5, r.uniform(-1, 1)) for k in range(3) for t in range(50)]
    df = spark.createDataFrame(rows, "k int, t long, b double")
    got = {(x["k"], x["t"]): x["v"] for x in state.clamped_scan(df, ["k"], "t", "b", 0.8, -0.5, 0.6, 0.1, chunk=4).collect()}
    for k in range(3):
        v = 0.1
        for kk, t, b in rows:
            if kk == k:
                v = min(max(0.8 * v + b, -0.5), 0.6)
                assert abs(got[k, t] - v) < 1e-12


def test_exact_quantile_in_rounds(spark):
    import random

    import numpy as np

    from sslspark.operators import aggs
    r = random.Random(1)
    rows = [(g, x) for g in "ab" for x in (r.choice([0.5, r.random() ** 9]) for _ in range(3000))]
    rows += [("c", None), ("c", float("nan")), ("d", -1e300), ("d", 1e300), ("e", 3.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {x["g"]: x["quantile"] for x in aggs.exact_quantile(df, "x", ["g"], 0.8, slots=7, small=10).collect()}
    for g in "abde":
        want = np.quantile([x for k, x in rows if k == g], 0.8)
        assert abs(got[g] - want) <= 1e-9 * max(1.0, abs(want))
    assert got["c"] is None and len(got) == 5
    whole = aggs.exact_quantile(df.filter("g IN ('a', 'b')"), "x", [], 0.3, slots=7, small=10).first()["quantile"]
    assert abs(whole - np.quantile([x for k, x in rows if k in "ab"], 0.3)) < 1e-12
    assert aggs.exact_quantile(df.limit(0), "x", ["g"], 0.5).count() == 0


def test_banks_and_prototypes_as_of_each_batch(spark):
    import random

    import numpy as np

    from sslspark.operators import similarity as S
    r = random.Random(1)
    rows = [(r.randint(0, 2), [r.random(), r.random()], b, 100 * b + i) for b in (0, 1, 4, 5, 9) for i in range(r.randint(1, 7))]
    df = spark.createDataFrame(rows, "label int, emb array<double>, batch_id long, row_id long")
    newest = sorted(rows, key=lambda x: (x[2], x[3]), reverse=True)
    for L in (1, 3, 50):
        got = {(x["label"], x["batch_id"]): x for x in S.fifo_prototypes(df, "label", "emb", L).collect()}
        want = {(x[0], x[2]): [y[1] for y in newest if y[0] == x[0] and y[2] <= x[2]][:L] for x in rows}
        assert set(got) == set(want)
        assert all(got[k]["n"] == len(v) and np.allclose(got[k]["proto"], np.mean(v, 0)) for k, v in want.items())
        asked = spark.createDataFrame([(b,) for b in (0, 1, 2, 4, 7, 9, 12)], "batch_id long")
        for x in S.ring_bank_as_of(asked, df, L, ["row_id"]).collect():
            assert [y["row_id"] for y in x["_bank"]] == [y[3] for y in newest if y[2] < x["batch_id"]][:L]


def test_freematch_clip_matches_the_loop(spark):
    from pyspark.sql import functions as F

    from sslspark.operators.registry import apply_policy
    rows = [(b, 10 * b + i, [p, 1 - p]) for b in range(6) for i, p in enumerate((0.9 + 0.02 * b, 0.99, 0.97))]
    df = spark.createDataFrame([(b, k, p, p) for b, k, p in rows], "batch_id long, row_id long, probs array<double>, logits array<double>")
    got = {x["batch_id"]: x["t"] for x in apply_policy(df, "freematch", num_classes=2, ema_p=0.1, clip_thresh=True)
           .groupBy("batch_id").agg(F.max("time_p").alias("t")).collect()}
    v = 0.5
    for b in range(6):
        v = min(max(0.1 * v + 0.9 * sum(max(p) for x, _, p in rows if x == b) / 3, 0.0), 0.95)
        assert abs(got[b] - v) < 1e-12


def test_bank_blocks_are_summed_tile_by_tile():
    """A block pair of FN22 / JOI9 holds tiles of its similarities, not several matrices of all of them."""
    import tracemalloc
    import numpy as np
    from sslspark.operators.similarity import _block_sums
    rng = np.random.default_rng(1)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.normal(size=(3000, 8)), rng.normal(size=(2500, 8))))
    n = rng.integers(1, 4, 2500).astype(float)
    of = (rng.integers(0, 3, 2500)[:, None] == np.arange(3)[None, :]) * n[:, None]
    tracemalloc.start()
    m, c, z = _block_sums(x, y, of, n, 0.1, 0.2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15e6  # one matrix of all pairs has 60 MB
    s = x @ y.T
    assert np.allclose(m, np.exp(s / 0.1) @ of) and np.allclose(c, (np.exp(s / 0.1) * s) @ of) and np.allclose(z, np.exp(s / 0.2) @ n)


def test_bank_copies_do_not_meet_in_one_block(spark):
    """Equal entries of the bank and rows of one id count as often as they occur."""
    import numpy as np
    from sslspark.operators.similarity import propagate_over_bank
    bank = [([1.0, 0.0], 0)] * 300 + [([0.6, 0.8], 1)] * 5 + [([0.0, 1.0], 1)]
    df = spark.createDataFrame([(1, [0.6, 0.8], [0.3, 0.7]), (2, [1.0, 0.0], [0.5, 0.5])], "row_id long, feat array<double>, probs array<double>")
    out = {r["row_id"]: r for r in propagate_over_bank(df, spark.createDataFrame(bank, "feat array<double>, label_id int"), 2, 0.5, 1.0, 0.9, block=2).collect()}
    y, lab = np.array([b[0] for b in bank]), np.array([b[1] for b in bank])
    for rid, f, p in ((1, [0.6, 0.8], [0.3, 0.7]), (2, [1.0, 0.0], [0.5, 0.5])):
        s = y @ np.array(f)
        a, st = np.exp(s / 0.5), np.exp(s)
        a, st = a / a.sum(), st / st.sum()
        teacher = a * np.array(p)[lab]
        teacher /= teacher.sum()
        assert np.allclose(out[rid]["p_prop"], 0.9 * np.array(p) + 0.1 * np.array([a[lab == k].sum() for k in (0, 1)]))
        assert abs(out[rid]["in_loss"] + (teacher * np.log(st)).sum()) < 1e-9
