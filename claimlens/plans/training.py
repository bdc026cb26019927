"""Training: encode -> split -> over-sample -> under-sample -> boosted trees -> evaluation.

``plans.boosting`` grows the trees round by round and stops by patience on the mean, unweighted
validation logloss; the positive class is weighted by 1 / under-sampling ratio. Tree depth is capped
at 30 and features are binned, so trees differ from the reference's; metrics are compared, not trees.
Curves over rounds come from one array of running scores in each row.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens import constants as K
from claimlens.operators import encoding as EN
from claimlens.operators import metrics as ME
from claimlens.operators import neighbors as NB
from claimlens.operators import sampling as SA
from claimlens.operators import sparse as SP
from claimlens.plans import boosting as BO
from claimlens.plans.trees import BoostedTreesModel, logistic, margin_arrays
from claimlens.sources import sinks as SK

MLLIB_MAX_DEPTH = 30


@dataclass
class TrainConfig:
    max_iter: int = K.GBT_ROUNDS
    max_depth: int = MLLIB_MAX_DEPTH
    step_size: float = K.GBT_LEARNING_RATE
    column_share: float = K.GBT_COLSAMPLE
    oversample_k: int = K.OVERSAMPLE_K
    oversample_ratio: float = K.OVERSAMPLE_RATIO
    undersample_ratio: float = K.UNDERSAMPLE_RATIO
    threshold: float = K.DEFAULT_THRESHOLD
    early_stop_rounds: int = K.GBT_EARLY_STOP
    alpha: float = K.GBT_ALPHA
    reg_lambda: float = K.GBT_LAMBDA
    max_bins: int = 32
    seed: int = K.SEED

    def boosting(self) -> BO.BoostConfig:
        return BO.BoostConfig(self.max_iter, self.max_depth, self.step_size, self.column_share, self.early_stop_rounds, self.alpha,
                              self.reg_lambda, max_bins=self.max_bins, seed=self.seed)


@dataclass
class TrainResult:
    model: BoostedTreesModel
    encoder: object
    num_features: int
    eval_scores: DataFrame      # (split, id, label, score) for val and test
    best_iteration: int = 0
    val_loss: list | None = None
    train_loss: list | None = None
    fitted: int = 0             # rounds fitted; at most best_iteration + early_stop_rounds


def positive_weight(cfg: TrainConfig) -> float:
    return 1.0 / cfg.undersample_ratio


def prepare(features: DataFrame, facility_vocab: list[str], cfg: TrainConfig):
    """Encode and split; returns (encoder, encoded rows with ``split``)."""
    encoder = EN.fit_encoder(features, facility_vocab)
    split = SA.stratified_split(features, seed=cfg.seed)
    return encoder, encoder.transform(split).select("id", "label", "split", "features")


def rebalanced(train_rows: DataFrame, cfg: TrainConfig) -> DataFrame:
    """id, label, features: synthetic minority rows up to the over-sampling ratio, then the majority cut to the other ratio.

    A minority class of no more than ``oversample_k`` rows is over-sampled from all its other rows.

    Vectors stay sparse throughout. The over-sampled rows are written once, since cutting the majority reads them several times."""
    rows = train_rows.select("id", "label", SP.sparse("features").alias("features"))
    least = min((r["count"] for r in rows.groupBy("label").count().limit(3).collect()), default=0)
    more = NB.oversample(rows, min(cfg.oversample_k, max(1, least - 1)), cfg.oversample_ratio, vec_col="features", seed=cfg.seed)
    more = SP.stored_vectors(more.select("id", "label", "features"), "features")
    return SA.undersample(more, ratio=cfg.undersample_ratio, seed=cfg.seed).select("id", "label", "features")


def train_encoded(encoded: DataFrame, cfg: TrainConfig) -> BO.BoostResult:
    """``encoded``: id, label, features, and ``split`` unless it is to be made here."""
    if cfg.max_depth > MLLIB_MAX_DEPTH:
        raise ValueError(f"max_depth {cfg.max_depth}: trees grow to {MLLIB_MAX_DEPTH} levels at most")
    rows = encoded if "split" in encoded.columns else SA.stratified_split(encoded, seed=cfg.seed)
    first = rows.select("features").first()
    if first is None:
        raise ValueError("no rows to train on")
    positive = F.when(F.col("label") == 1, F.lit(positive_weight(cfg))).otherwise(F.lit(1.0))
    grow = rebalanced(rows.where("split = 'train'"), cfg).select(F.lit(BO.FIT).alias("part"), "label", positive.alias("w"), "features")
    watch = rows.where("split in ('train', 'val')").select(F.col("split").alias("part"), "label", F.lit(1.0).alias("w"), "features")
    return BO.fit(grow.unionByName(watch), len(first["features"]), cfg.boosting())


def train(features: DataFrame, facility_vocab: list[str], cfg: TrainConfig | None = None) -> TrainResult:
    """Fit on the rebalanced training split, stop on validation logloss, score validation and test rows."""
    cfg = cfg or TrainConfig()
    encoder, enc = prepare(features, facility_vocab, cfg)
    r = train_encoded(enc, cfg)
    scores = r.model.transform(enc.where("split in ('val', 'test')")).select("split", "id", "label", F.col("probability").alias("score"))
    path = SK.write_report(scores, SK.work_dir(features.sparkSession, "eval-scores"))  # read several times
    scores = SK.read_report(features.sparkSession, path, scores.schema)
    num_features = len(enc.select("features").first()[0])
    return TrainResult(r.model, encoder, num_features, scores, r.best_iteration, r.losses.get("val"), r.losses.get("train"), r.fitted)


def metrics_block(scores: DataFrame, split: str, threshold: float) -> DataFrame:
    s = scores.where(F.col("split") == split)
    m = ME.metrics(s, (threshold,), groups=["split"])
    pts = ME.curve_points(s, groups=["split"])
    return (m.join(ME.roc_auc(pts, ["split"]), "split").join(ME.pr_auc(pts, ["split"]), "split"))


def evaluation(scores: DataFrame, threshold: float = K.DEFAULT_THRESHOLD) -> DataFrame:
    """The three published blocks: val @ 0.5, val @ threshold, test @ threshold."""
    return (metrics_block(scores, "val", 0.5).withColumn("block", F.lit("val_metrics_default_0.5"))
            .unionByName(metrics_block(scores, "val", threshold).withColumn("block", F.lit("val_metrics_target_threshold")))
            .unionByName(metrics_block(scores, "test", threshold).withColumn("block", F.lit("test_metrics_target_threshold"))))


def run_record(spark: SparkSession, result: TrainResult, evaluation_df: DataFrame,
               cfg: TrainConfig, sample_fraction: float = 1.0) -> DataFrame:
    """One-row run record with a nested metrics struct per block."""
    blocks = {r["block"]: r for r in evaluation_df.collect()}  # three rows

    def block(name):
        r = blocks.get(name)
        if r is None:
            return F.lit(None)
        cm = F.struct(*[F.lit(int(r[k])).alias(k) for k in ("tn", "fp", "fn", "tp")]).alias("confusion_matrix")
        return F.struct(*[F.lit(float(r[k])).alias(k) for k in
                          ("precision", "recall", "f1_score", "roc_auc", "pr_auc", "specificity")], cm)

    return spark.range(1).select(
        F.lit("GBT").alias("model_name"),
        F.lit(_dt.datetime.now().strftime("%Y-%m-%d %H:%M:%S")).alias("training_date"),
        F.lit(cfg.seed).alias("random_seed"), F.lit(float(sample_fraction)).alias("sample_fraction"),
        F.lit(result.num_features).alias("num_features"),
        F.lit(result.best_iteration).alias("best_iteration"),
        F.lit(cfg.threshold).alias("classification_threshold"),
        block("val_metrics_default_0.5").alias("val_metrics_default_0_5"),
        block("val_metrics_target_threshold").alias("val_metrics_target_threshold"),
        block("test_metrics_target_threshold").alias("test_metrics_target_threshold"))


def curve_rounds(n: int, points: int = K.CURVE_POINTS) -> list[int]:
    """The rounds a curve shows: evenly spaced from the first on, about ``points`` of them, and the last one."""
    return sorted({*range(1, n + 1, max(1, n // points)), n}) if n else []


def running_scores(model: BoostedTreesModel, rows: DataFrame, rounds: Sequence[int] | None = None) -> DataFrame:
    """``rows`` without ``features`` but with ``scores``: the probability after each of ``rounds`` (default: all), as one array.

    Running sums of the tree outputs, so a row's work grows with the number of trees, and rows are not multiplied."""
    rounds = list(rounds) if rounds is not None else list(range(1, model.getNumTrees + 1))
    keep = [c for c in rows.columns if c != "features"]
    margins = rows.select(*keep, margin_arrays(rows, model.trees, rounds).alias("margins"))
    return margins.select(*keep, F.transform("margins", logistic).alias("scores"))


def partial_scores(model: BoostedTreesModel, rows: DataFrame, rounds: Sequence[int] | None = None) -> DataFrame:
    """(kept columns, iteration, score): ``running_scores`` as rows, for reports; the curves below use the arrays."""
    rounds = list(rounds) if rounds is not None else list(range(1, model.getNumTrees + 1))
    df = running_scores(model, rows, rounds)
    spread = df.select(*[c for c in df.columns if c != "scores"], F.posexplode("scores").alias("at", "score"))
    return spread.withColumn("iteration", F.element_at(F.lit(rounds), F.col("at") + 1)).drop("at")


def round_figures(scored: DataFrame, rounds: Sequence[int], threshold: float = K.DEFAULT_THRESHOLD) -> DataFrame:
    """set, iteration, precision, recall, loss from (set, label, scores): one element-wise sum over all rows, then unpivoted."""
    n, y, t = len(rounds), F.col("label") == 1, F.lit(threshold)
    one = lambda c: F.transform("scores", lambda p: F.when(c(p), F.lit(1.0)).otherwise(F.lit(0.0)))
    parts = F.concat(one(lambda p: (p >= t) & y), one(lambda p: (p >= t) & ~y), one(lambda p: (p < t) & y),
                     F.transform("scores", lambda p: BO.logloss(F.col("label"), p)))
    sums = scored.select("set", array_to_vector(parts).alias("v")).groupBy("set").agg(Summarizer.sum(F.col("v")).alias("s"), F.count(F.lit(1)).alias("rows"))
    at = sums.select("set", "rows", vector_to_array("s").alias("s"), F.posexplode(F.lit(list(rounds))).alias("at", "iteration"))
    tp, fp, fn, loss = (F.element_at("s", F.col("at") + 1 + k * n) for k in range(4))
    return at.select("set", "iteration", (tp / (tp + fp + F.lit(K.CURVE_EPS))).alias("precision"),
                     (tp / (tp + fn + F.lit(K.CURVE_EPS))).alias("recall"), (loss / F.col("rows")).alias("loss"))


def round_auc(scores: DataFrame) -> DataFrame:
    """ROC AUC per set and round, from partial scores with ``set``."""
    return ME.roc_auc(ME.curve_points(scores, groups=["set", "iteration"]), groups=["set", "iteration"])


def headline(records: DataFrame) -> DataFrame:
    """Headline figures from the latest run record, with fixed defaults for
    missing fields (one row)."""
    d = K.HEADLINE_DEFAULTS
    latest = records.agg(F.max_by(F.struct(*records.columns), "training_date").alias("r")).select("r.*")
    cols = set(latest.columns)

    def field(name, default, cast):
        c = F.col(name) if name in cols else F.lit(None)
        return F.coalesce(c.cast(cast), F.lit(default).cast(cast)).alias(name)

    test = "test_metrics_target_threshold"
    def metric(m):
        c = F.col(f"{test}.{m}") if test in cols else F.lit(None)
        return F.coalesce(c.cast("double"), F.lit(d[m])).alias(m)

    return latest.select(metric("precision"), metric("recall"), metric("f1_score"),
                         field("classification_threshold", d["classification_threshold"], "double"),
                         field("num_features", d["num_features"], "int"),
                         field("sample_fraction", d["sample_fraction"], "double"),
                         field("training_date", d["training_date"], "string"))
