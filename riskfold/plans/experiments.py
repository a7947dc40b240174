"""Cross-validated model runs: every fold and the hold-out refit are fit
groups of the same jobs (see operators/boost.py)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfold.config import Cohort, Settings
from riskfold.operators import boost as B
from riskfold.operators import prep as P
from riskfold.operators import split as S
from riskfold.plans.assign import assign, dev_and_test
from riskfold.session import materialize

MODEL_SPECS = {
    # study configuration (tests reduce the rounds by ``scale``)
    "adaboost": dict(display="AdaBoost", kind="stumps", rounds=200, rate=0.10),
    "xgboost": dict(display="XGBoost", kind="trees", trees=300, rate=0.05, depth=4, lam=1.0,
                    min_child_weight=1.0, subsample=0.8, colsample=0.8),
    "lightgbm": dict(display="LightGBM", kind="trees", trees=300, rate=0.05, depth=6, leaves=31, lam=1.0,
                     min_child_weight=1e-3, min_child_rows=20, subsample=0.8, colsample=0.8),
}


@dataclass
class Matrices:
    train: DataFrame     # (g, row_id, y, w0, h, x): fit-group training rows, selected features
    apply: DataFrame     # (g, row_id, y, fold, x): validation rows (g = fold) and hold-out rows (g = -1)
    n_features: int
    features: list
    kept: dict           # {g: positions of the features that the group's selector kept}
    blocks: list = field(default_factory=list)   # positions of each categorical column's dummies: one of them is 1 in a row


def matrices(spark: SparkSession, sf_dir: str, cohort: Cohort, settings: Settings = Settings(),
             balance: bool = True) -> Matrices:
    """Fold-expanded processed training matrix with balanced row weights and
    the matching validation / hold-out matrix; both checkpointed because
    every boosting step re-reads them."""
    a = materialize(assign(spark, sf_dir, cohort, settings))
    dev, test = dev_and_test(a)
    return model_matrices(S.train_view(dev, settings.n_folds), S.apply_view(dev, test), cohort, settings, balance, dev, S.fold_fits(settings.n_folds))


def model_matrices(tr: DataFrame, rows: DataFrame, cohort: Cohort, settings: Settings, balance: bool = True,
                   dev: DataFrame | None = None, folds=None) -> Matrices:
    """Matrices of any fit groups: ``tr`` holds each group's training rows,
    ``rows`` the rows that it scores, both with ``g`` and ``fold``."""
    fitted = P.fit(tr, cohort.numeric, cohort.categorical, cohort.iqr_columns, settings.iqr_multiplier, dev, folds)
    flist = P.global_feature_list(fitted)
    sel = P.select_features(fitted, P.transform_array(tr, fitted, flist), flist,
                            settings.variance_threshold, settings.correlation_threshold, rows=tr)
    kept = sel.where("kept").groupBy("g").agg(F.collect_set("gpos").alias("_k"))   # <= p per group
    mask = kept.select("g", F.transform(F.sequence(F.lit(0), F.lit(len(flist) - 1)),
                                        lambda i: F.when(F.array_contains("_k", i), 1.0).otherwise(0.0))
                       .alias("_mask"))
    masked = lambda df: df.join(F.broadcast(mask), "g").withColumn(
        "x", F.zip_with("x", "_mask", lambda v, m: v * m)).drop("_mask")
    t = cohort.target
    w = P.class_weights(tr, t, by=["g"]).select("g", t, F.col("weight").alias("w0"))
    train = masked(P.transform_array(tr, fitted, flist, keep=[t])).join(F.broadcast(w), ["g", t])
    if not balance:
        train = train.withColumn("w0", F.lit(1.0))
    train = train.select(F.col("g").cast("int").alias("g"), "row_id", F.col(t).cast("int").alias("y"), "w0",
                         F.xxhash64("row_id").alias("h"), "x")
    app = masked(P.transform_array(rows, fitted, flist, keep=[t, "fold"])).select(
        F.col("g").cast("int").alias("g"), "row_id", F.col(t).cast("int").alias("y"), "fold", "x")
    names = [P.feature_name(*f) for f in flist]
    columns = {int(r["g"]): sorted(r["_k"]) for r in kept.collect()}   # at most groups x features
    blocks = [[i for i, (kind, c, _) in enumerate(flist) if kind == "dummy" and c == column] for column in cohort.categorical]
    return Matrices(materialize(train), materialize(app), len(flist), names, columns, [b for b in blocks if len(b) > 1])


def select_keys(requested, available) -> list[str]:
    """Subset selection of datasets or models; an unknown key raises."""
    requested = list(available) if requested is None else list(requested)
    unknown = [k for k in requested if k not in available]
    if unknown:
        raise KeyError(f"Unknown keys {unknown}; available: {sorted(available)}")
    return requested


def _fit_args(spec: dict, scale: float, seed: int) -> tuple[str, dict]:
    if spec["kind"] == "stumps":
        return "stumps", dict(rounds=max(1, int(spec["rounds"] * scale)), rate=spec["rate"])
    return "trees", dict(trees=max(1, int(spec["trees"] * scale)), rate=spec["rate"], depth=spec["depth"],
                         lam=spec["lam"], min_child_weight=spec["min_child_weight"],
                         min_child_rows=spec.get("min_child_rows", 0), subsample=spec["subsample"],
                         colsample=spec["colsample"], leaves=spec.get("leaves"), seed=seed)


def fit_models(m: Matrices, model_keys=("adaboost", "xgboost", "lightgbm"), scale: float = 1.0,
               seed: int = 42) -> dict:
    """{key: (kind, cuts, model)}: all requested models trained together, so
    each histogram job serves every model that is still growing."""
    keys, seconds = select_keys(model_keys, MODEL_SPECS), {}
    fitted = B.fit_many(m.train, m.n_features, {k: _fit_args(MODEL_SPECS[k], scale, seed) for k in keys}, columns=m.kept, seconds=seconds, blocks=m.blocks)
    return FittedModels({k: (MODEL_SPECS[k]["kind"], *fitted[k]) for k in keys}, seconds)


class FittedModels(dict):
    """{key: (kind, cuts, model)} and each model's seconds: passes are shared,
    so a pass's time belongs to its models by the time that the tasks spent on
    each of them."""

    def __init__(self, models: dict, seconds: dict) -> None:
        super().__init__(models)
        self.fit_seconds = seconds


def with_fit_seconds(rows: DataFrame, fitted: FittedModels) -> DataFrame:
    own = F.create_map(*[x for k, v in fitted.fit_seconds.items() for x in (F.lit(k), F.lit(round(v, 6)))])
    return rows.withColumn("fit_seconds", own[F.col("model_key")])


def fit_model(m: Matrices, model_key: str, scale: float = 1.0, seed: int = 42):
    return fit_models(m, [model_key], scale, seed)[model_key]


def cv_scores(spark: SparkSession, m: Matrices, cohort: Cohort, model_keys=("adaboost", "xgboost", "lightgbm"),
              scale: float = 1.0, fitted: dict | None = None, groups: str | None = None) -> DataFrame:
    """(dataset_key, dataset_name, model_key, model_name, g, fold, row_id, y,
    score): out-of-fold scores (g = fold) and hold-out scores (g = -1);
    ``groups``: a condition on ``g``, met before rows are scored."""
    models = [fitted[key] if fitted else fit_model(m, key, scale) for key in model_keys]
    named = lambda of: F.element_at(F.array(*[F.lit(of(k)) for k in model_keys]), F.col("m") + 1)
    return B.score_models(m.apply if groups is None else m.apply.where(groups), models, m.blocks).select(
        F.lit(cohort.key).alias("dataset_key"), F.lit(cohort.name).alias("dataset_name"),
        named(lambda k: k).alias("model_key"), named(lambda k: MODEL_SPECS[k]["display"]).alias("model_name"),
        "g", F.when(F.col("g") >= 0, F.col("g")).alias("fold"), "row_id", "y", "score")
