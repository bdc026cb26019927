"""Batch and nested-claim scoring.

``score`` takes a feature table and any probability column producer (a fixed
logistic formula for checks and demos) and adds the decision and the confidence, all as column
expressions keyed by ``id``. Trained models score through ``plans.artefact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens import constants as K
from claimlens.functions.dates import stay_days
from claimlens.functions.scoring import confidence, decide, explanation, reason_codes
from claimlens.functions.text import null_token_columns
from claimlens.plans import features as FE

# A fixed logistic scorer over named features (for exact checks and demos;
# a trained model replaces it in production). (bias, [(weight, term)...])
LOGIT_BIAS = -2.5
LOGIT_TERMS = [
    (0.02, "stay"), (0.3, "diagfkrtl_sekunder_counts"), (0.1, "proc_count"),
    (0.8, "kdsa_flag"), (0.6, "kdsp_flag"), (0.4, "sev3"), (-0.01, "usia"),
]


def _term(name: str) -> Column:
    if name == "stay":
        return F.coalesce(F.col("lama_rawat"), F.lit(0)).cast("bigint")
    if name == "kdsa_flag":
        return (F.col("kdsa_CMG") != "-").cast("bigint")
    if name == "kdsp_flag":
        return (F.col("kdsp_spesifikkasus") != "-").cast("bigint")
    if name == "sev3":
        return (F.col("cbg_severity") == "III").cast("bigint")
    return F.col(name).cast("bigint")


def _dec(x: float) -> Column:
    return F.lit(x).cast("decimal(10,4)")


def fixed_logit(df: DataFrame | None = None) -> Column:
    """Sigmoid of a linear score. The linear part is exact decimal arithmetic
    over integer features, so equal inputs give bit-equal scores everywhere."""
    z = _dec(LOGIT_BIAS)
    for w, name in LOGIT_TERMS:
        z = z + _dec(w) * _term(name)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z.cast("double")))


def score(features: DataFrame, prob: Column | None = None,
          threshold: float = K.DEFAULT_THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    p = prob if prob is not None else fixed_logit(features)
    out = features.withColumn("fraud_probability", p)
    return out.select("id", "fraud_probability",
                      decide(F.col("fraud_probability"), threshold).alias("is_fraud"),
                      confidence(F.col("fraud_probability"), threshold).alias("confidence_score"), *keep)


def score_batch(claims: DataFrame, diag: DataFrame, proc: DataFrame, params: FE.FeatureParams,
                threshold: float = K.DEFAULT_THRESHOLD) -> DataFrame:
    """Scoring path: missing tokens -> structural pass with fitted params -> score."""
    feats = FE.transform(null_token_columns(claims), diag, proc, params)
    return score(feats, threshold=threshold)


def raw_counts(claims: DataFrame, diag: DataFrame, proc: DataFrame) -> DataFrame:
    """Child counts as given (not de-duplicated), 0 without children, and the first primary code ('' if none)."""
    sec = diag.where(F.col("levelid") == 2).groupBy("id").agg(F.count(F.lit(1)).alias("n_secondary"))
    prim = diag.where(F.col("levelid") == 1).groupBy("id").agg(F.min_by(F.struct("diag"), "ord").alias("first"))
    procs = proc.groupBy("id").agg(F.count(F.lit(1)).alias("n_procedures"))
    out = claims.select("id").join(sec, "id", "left").join(prim, "id", "left").join(procs, "id", "left")
    return out.select("id", F.coalesce("n_secondary", F.lit(0)).alias("n_secondary"),
                      F.coalesce("n_procedures", F.lit(0)).alias("n_procedures"),
                      F.when(F.col("first").isNull(), F.lit("")).otherwise(F.col("first.diag")).alias("primary_diag"))


def with_raw_figures(scored: DataFrame, claims: DataFrame, counts: DataFrame) -> DataFrame:
    """Scored claims with the figures explanations quote: raw cost and stay (0 if missing) and raw child counts."""
    raw = claims.select("id", F.coalesce(F.col("biaya").cast("double"), F.lit(0.0)).alias("cost"),
                        F.coalesce(stay_days("tgldatang", "tglpulang"), F.lit(0)).alias("stay"))
    return scored.join(raw, "id").join(counts, "id")


FIGURES = ("cost", "stay", "n_secondary", "n_procedures")


def reasons(scored: DataFrame) -> DataFrame:
    """Risk reasons per claim from its raw cost, stay and child counts."""
    return scored.select("id", "is_fraud", reason_codes(*map(F.col, FIGURES)).alias("reasons"))


def explain(scored: DataFrame) -> DataFrame:
    return scored.select("id", "is_fraud", explanation(F.col("fraud_probability"), F.col("is_fraud"), *map(F.col, FIGURES)).alias("explanation"))


# --- nested claims -------------------------------------------------------------
# A nested claim row carries its own children:
#   claim columns..., diagnoses array<struct<diag:string, levelid:int>>, procedures array<string>

def flatten_nested(nested: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nested claims -> (claims, diagnoses, procedures), for storing them as tables; scoring needs no such detour.

    A missing ``levelid`` means primary (1) and a missing code is empty text; list position is the row order of the diagnoses."""
    claims = nested.select(*[c for c in nested.columns if c not in ("diagnoses", "procedures")])
    d = nested.select("id", F.posexplode_outer("diagnoses").alias("ord", "d")).where(F.col("d").isNotNull())
    diags = d.select("id", F.coalesce(F.col("d.diag"), F.lit("")).alias("diag"),
                     F.coalesce(F.col("d.levelid").cast("int"), F.lit(1)).alias("levelid"),
                     F.col("ord").cast("long").alias("ord"))
    return claims, diags, nested.select("id", F.explode("procedures").alias("proc"))


def nested_figures() -> dict[str, Column]:
    """What explanations quote, from the row itself: raw cost and stay (0 if missing), lists as given (not de-duplicated; null counts 0)."""
    def level(d: Column) -> Column:
        return F.coalesce(d["levelid"].cast("int"), F.lit(1))
    return {
        "cost": F.coalesce(F.col("biaya").cast("double"), F.lit(0.0)),
        "stay": F.coalesce(stay_days("tgldatang", "tglpulang"), F.lit(0)),
        "n_secondary": F.coalesce(F.size(F.filter("diagnoses", lambda d: level(d) == 2)), F.lit(0)),
        "n_procedures": F.coalesce(F.size("procedures"), F.lit(0)),
        "primary_diag": F.coalesce(F.get(F.filter("diagnoses", lambda d: level(d) == 1), F.lit(0))["diag"], F.lit("")),
    }


def nested_counts(nested: DataFrame) -> DataFrame:
    """Secondary diagnoses, procedures and first primary code of each claim's lists."""
    figures = nested_figures()
    return nested.select("id", *[figures[c].alias(c) for c in ("n_secondary", "n_procedures", "primary_diag")])


def explained(scored: DataFrame, model_name: str, threshold: float) -> DataFrame:
    """Scored rows that carry ``FIGURES`` -> the answer to a single claim, with explanation and model info."""
    return scored.select(
        "id", "is_fraud", "fraud_probability", "confidence_score",
        explanation(F.col("fraud_probability"), F.col("is_fraud"), *map(F.col, FIGURES)).alias("explanation"),
        F.struct(F.lit(model_name).alias("name"), F.lit("1.0.0").alias("version"),
                 F.lit(threshold).alias("threshold")).alias("model_info"))


def score_nested(nested: DataFrame, params: FE.FeatureParams,
                 threshold: float = K.DEFAULT_THRESHOLD, model_name: str = "fixed-logit") -> DataFrame:
    """Scored nested claims with explanation and model info: one projection of each row, in batch or as a stream."""
    raw = nested.withColumns({c: x for c, x in nested_figures().items() if c in FIGURES})
    feats = FE.transform_nested(null_token_columns(raw), params, keep=FIGURES)
    return explained(score(feats, threshold=threshold, keep=FIGURES), model_name, threshold)
