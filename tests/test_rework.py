"""Stump weights against a hand calculation, rankings over partly shared and
disjoint feature sets, CSV scan with NA tokens, one-rank folds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfold.operators import boost as B
from riskfold.operators import split as S
from riskfold.operators import stability as ST
from riskfold.sources.files import read_csv


@pytest.mark.parametrize("p", [1, 2, 10])
def test_stump_weight_does_not_depend_on_the_feature_count(p):
    """Weighted error 0.25 and rate 0.1 give 0.1 ln 3, however many features
    the histogram holds."""
    hist = np.zeros((3, p, 2), np.int64)
    for j in range(p):
        hist[:, j] = [[3, 1], [1, 3], [4, 4]] if j == p - 1 else [[2, 2], [2, 2], [4, 4]]
    ask = B.Ask("stumps", {0: -1}, np.arange(p))
    j, b, side, gain, *left = B.best_split(ask, hist, 0, 1.0)
    grower = B.Stumps([0], {0: np.arange(p)}, rounds=1, rate=0.1)
    grower.take({(0, 0): B.Found(j, b, side, gain, tuple(left), (4.0, 4.0, 8))})
    (j, b, left, alpha), = grower.model[0]
    assert (j, b, left) == (p - 1, 0, 1) and abs(alpha - 0.1 * math.log(3)) < 1e-12


def test_stumps_follow_direct_weight_updates(spark):
    """Several rounds over two features equal a direct discrete AdaBoost."""
    data = [(i, [float(i % 7), float(i * 3 % 11)], int((i % 7 > 3) ^ (i % 5 == 0))) for i in range(60)]
    train = spark.createDataFrame([(0, str(i), y, 1.0, i, x) for i, x, y in data], "g int, row_id string, y int, w0 double, h long, x array<double>")
    cuts, model = B.fit_stumps(train, 2, rounds=6, rate=0.5, max_bins=16)
    w, want = [1.0] * 60, []
    for _ in range(6):
        best = None
        for j in range(2):
            for b in range(15):
                for left in (1, -1):
                    miss = sum(wi for wi, (_, x, y) in zip(w, data) if (left if sum(c < x[j] for c in cuts[0][j]) <= b else -left) != 2 * y - 1)
                    if best is None or miss / sum(w) < best[0] - 1e-12:
                        best = (miss / sum(w), j, b, left)
        err, j, b, left = best
        a = 0.5 * math.log((1 - err) / err)
        want.append((j, a))
        w = [wi * math.exp(-(2 * y - 1) * a * (left if sum(c < x[j] for c in cuts[0][j]) <= b else -left) / 2) for wi, (_, x, y) in zip(w, data)]
    assert [j for j, *_ in model[0]] == [j for j, _ in want]
    assert all(abs(m[3] - a) < 1e-9 for m, (_, a) in zip(model[0], want))


def imp(spark, folds):
    rows = [("d", "D", "m", "M", f, name, 1.0 / r, r) for f, ranks in folds.items() for name, r in ranks.items()]
    return spark.createDataFrame(rows, "dataset_key string, dataset_name string, model_key string, model_name string, fold int, feature string, mean_abs_shap double, rank int")


def test_correlation_re_ranks_the_shared_features(spark):
    x = imp(spark, {0: {"a": 1, "b": 2, "z": 3, "q": 4, "c": 5}, 1: {"a": 1, "b": 4, "c": 3, "y": 2}})
    (r,) = ST.shared_correlations(x).collect()
    assert abs(r.value - 0.5) < 1e-12  # ranks 1, 2, 3 against 1, 3, 2
    (k,) = ST.shared_correlations(x, "kendall").collect()
    assert abs(k.value - 1 / 3) < 1e-12


def test_disjoint_features(spark):
    x = imp(spark, {0: {"a": 1, "b": 2}, 1: {"c": 1, "d": 2}})
    matrix = ST.fold_correlation_matrix(ST.shared_correlations(x), x.select(*ST.GK, "fold").distinct(), "value").collect()
    assert len(matrix) == 4 and all(r.value == 1.0 for r in matrix)
    with pytest.raises(Exception, match="different features"):
        ST.pairwise_stability(x, 2).collect()
    with pytest.raises(Exception, match="different features"):
        ST.pairwise_stability(imp(spark, {0: {"a": 1, "b": 2, "c": 3}, 1: {"a": 1, "b": 2}}), 2).collect()


def test_empty_selection_and_empty_input(spark):
    none = imp(spark, {0: {"a": 1}}).limit(0)
    with pytest.raises(ValueError):
        ST.rank_matrix(none)
    assert ST.pairwise_stability(none, 3).count() == 0
    assert ST.stability_summary(ST.pairwise_stability(none, 3)).count() == 0


def test_csv_scan_turns_na_tokens_to_null_and_rejects_other_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text(' n , s ,d\nNA,b,1.5\n 7 ,None,nan\n,x,-1e3\n')
    schema = T.StructType([T.StructField(" n ", T.IntegerType()), T.StructField(" s ", T.StringType()), T.StructField("d", T.DoubleType())])
    got = sorted(map(tuple, read_csv(spark, str(tmp_path / "a.csv"), schema).collect()), key=str)
    assert got == sorted([(None, "b", 1.5), (7, None, None), (None, "x", -1000.0)], key=str)
    (tmp_path / "b.csv").write_text(" n , s ,d\nseven,b,1.5\n")
    with pytest.raises(Exception, match="column n"):
        read_csv(spark, str(tmp_path / "b.csv"), schema).collect()
    with pytest.raises(ValueError):
        read_csv(spark, str(tmp_path / "a.csv"), schema, target="absent")


def test_one_rank_equals_split_then_folds(spark):
    df = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("row_id"), F.when(F.col("id") % 7 == 0, "Yes").otherwise("No").alias("t"))
    one = {r.row_id: (r.split, r.fold) for r in S.split_and_folds(df, "t", 42, 0.2, 5).collect()}
    split = S.stratified_split(df, "t", 42, 0.2)
    folds = {r.row_id: r.fold for r in S.stratified_folds(split.where("split = 'train'"), "t", 5, 42).collect()}
    assert one == {r.row_id: (r.split, folds.get(r.row_id)) for r in split.collect()}


def test_an_id_like_column_is_refused_by_name(spark):
    from riskfold.operators import prep as P
    counts = spark.createDataFrame([(0, "code", str(i), 1) for i in range(12)] + [(0, "flag", "a", 9)], "g int, column string, value string, n long")
    assert P.bounded_categories(counts, 12).count() == 13
    with pytest.raises(ValueError, match="code has 12 values"):
        P.bounded_categories(counts, 11)


def test_scores_of_a_rare_event_rank_exactly(spark):
    """Tiny, equal, middle and edge scores against the pair count."""
    from riskfold.operators import metrics as M
    scores = [0.0, 1e-9, 2e-9, 2e-9, 1e-4, 1.1e-4, 0.3, 0.3000001, 0.9999999, 1.0, 1.0, 0.5]
    rows = [(1, s, int(i % 3 == 0)) for i, s in enumerate(scores)]
    got = M.auc_metrics(M.score_counts(spark.createDataFrame(rows, "k int, score double, y int"), ["k"]), ["k"]).first()
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(got.roc_auc - want) < 1e-12
