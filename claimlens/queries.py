"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each reads the driver tables (through the claims-shaped views) so its work
grows with the data. Computed columns carry fixed names that the oracle SQL
repeats. Fitted parameters and shared tables are kept per application and input
folder until the folder's files change or ``release`` is called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens import constants as K
from claimlens.functions.codes import kdsa_severity, split_code, split_code_columns
from claimlens.functions.dates import stay_days
from claimlens.functions.diagnosis import clean_diag, code_letter, code_number, icd_chapter
from claimlens.functions.text import clean_text, null_tokens
from claimlens.operators import children as CH
from claimlens.operators import encoding as EN
from claimlens.operators import lsh as LSH
from claimlens.operators import metrics as ME
from claimlens.operators import observed as OB
from claimlens.operators import overview as OV
from claimlens.operators import quality as QA
from claimlens.operators import sampling as SA
from claimlens.operators import sparse as SP
from claimlens.operators.impute import median_table, mode_table
from claimlens.operators.prefix import exact_medians, modes, stack
from claimlens.plans import features as FE
from claimlens.plans import fitted_state as FS
from claimlens.plans import scoring as SC
from claimlens.session import release_kept, tune_session
from claimlens.sources import fixtures as FX
from claimlens.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_PARAMS: dict[tuple, FE.FeatureParams] = {}

SAMPLED = 0.1
EVAL_THRESHOLDS = (0.5, K.DEFAULT_THRESHOLD)
TARGET_PRECISIONS = (0.9, 0.5, 0.1, 0.02, 0.01)


# Computed double columns are reported rounded to 6 places (the oracle SQL
# rounds the same columns), so engine-level last-bit differences (exp, sum
# order) cannot change a report.
ROUND6: dict[str, list[str]] = {
    "fit_medians": ["median"], "impute": ["biaya"], "features": ["biaya"], "label_share": ["share"],
    "metrics": ["precision", "recall", "f1_score", "specificity"],
    "metrics_by_split": ["precision", "recall", "f1_score", "specificity"],
    "roc_curve": ["threshold", "fpr", "tpr"], "pr_curve": ["threshold", "precision", "recall"],
    "roc_auc": ["roc_auc"], "pr_auc": ["pr_auc"], "tune_threshold": ["threshold", "precision", "recall"],
    "score_batch": ["fraud_probability", "confidence_score"],
    "score_nested": ["fraud_probability", "confidence_score"],
    "score_stream": ["fraud_probability", "confidence_score"],
    "stream_children": ["fraud_probability", "confidence_score"],
    "report_sink": ["fraud_probability", "confidence_score"],
    **{q: ["fraud_probability", "confidence_score"] for q in (
        "score_batch_model", "stream_dedup", "score_nested_model", "score_nested_stream", "score_stream_model", "csv_report")},
    "run_store": ["value"], "partial_scores": ["score"], "learning_curve": ["precision", "recall"], "round_loss": ["loss"], "round_auc": ["roc_auc"],
    "scan_csv": ["biaya"], "eval_sink": ["score"],
    "knn_minority": ["dist"],
    "oversample_embeddings": ["x_first", "x_last"],
    "overview_demographics": ["avg_cost", "avg_stay"],
    "overview_cost": ["total_cost", "min_cost", "max_cost", "avg_cost", "median_cost"],
    "overview_imbalance": ["fraud_rate"],
}


def query(name: str):
    def deco(fn):
        cols = ROUND6.get(name)
        if cols:
            def wrapped(spark, sf, _fn=fn, _cols=cols):
                tune_session(spark)
                _CURRENT.clear()
                df = _fn(spark, sf)
                return df.withColumns({c: F.round(F.col(c), 6) for c in _cols})
            wrapped.__name__ = fn.__name__
            wrapped.__doc__ = fn.__doc__
            QUERIES[name] = wrapped
        else:
            def plain(spark, sf, _fn=fn):
                tune_session(spark)
                _CURRENT.clear()
                return _fn(spark, sf)
            plain.__name__ = fn.__name__
            plain.__doc__ = fn.__doc__
            QUERIES[name] = plain
        return fn
    return deco


def _tables(spark, sf):
    tune_session(spark)
    return FX.fixture_tables(spark, sf)


def feature_params(spark: SparkSession, sf: str) -> FE.FeatureParams:
    k = _key(spark, sf, "params")
    if k not in _PARAMS:
        _PARAMS[k] = FE.fit_rows(claim_rows(spark, sf))
    return _PARAMS[k]


_MATERIALISED: dict[tuple, DataFrame | tuple[DataFrame, DataFrame]] = {}
_STAMPS: dict[tuple, tuple] = {}
_CURRENT: dict[tuple, tuple] = {}


def _stamp(spark: SparkSession, sf: str) -> tuple:
    """Names, sizes and times of the files that the claims views read (no content is read)."""
    files = [spark.read.format("binaryFile").load(f"{sf}/{t}.parquet").select("path", "length", "modificationTime")
             for t in ("orders", "customer", "lineitem")]
    return tuple(sorted(map(tuple, files[0].unionByName(files[1]).unionByName(files[2]).collect())))


def _key(spark: SparkSession, sf: str, what: str) -> tuple:
    """Memo key; what was kept for a folder goes when its files have changed since."""
    own = (spark.sparkContext.applicationId, sf)
    if own not in _CURRENT:
        _CURRENT[own] = _stamp(spark, sf)
        if _STAMPS.get(own, _CURRENT[own]) != _CURRENT[own]:
            release(spark)
        _STAMPS[own] = _CURRENT[own]
    return (*own, what)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once and read back."""
    path = SK.write_report(df, SK.work_dir(df.sparkSession, name))
    return SK.read_report(df.sparkSession, path, df.schema)


def child_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Per-claim diagnosis parts and procedure counts (the child-table shuffles),
    stored once per session and input folder."""
    k = _key(spark, sf, "children")
    if k not in _MATERIALISED:
        _, d, p = _tables(spark, sf)
        _MATERIALISED[k] = (stored(FE.diag_parts(d), "diag-parts"), stored(FE.proc_table(p), "proc-counts"))
    return _MATERIALISED[k]


def claim_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Raw claims with their child figures: all joins and child-table shuffles, done and stored once per session and input folder.
    Fitting, features and scoring are scans and projections of it, which read the columns that they need."""
    k = _key(spark, sf, "rows")
    if k not in _MATERIALISED:
        c, d, p = _tables(spark, sf)
        _MATERIALISED[k] = stored(FE.with_child_tables(c, FE.diag_parts(d), FE.proc_table(p)), "claim-rows")
    return _MATERIALISED[k]


def stored_claims(spark: SparkSession, sf: str) -> DataFrame:
    """The claims view from the stored rows."""
    return claim_rows(spark, sf).drop(*FE.CHILD_COLUMNS)


def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    """The feature table: a projection of the stored rows."""
    return FE.transform_rows(claim_rows(spark, sf), feature_params(spark, sf))


def split_features(spark: SparkSession, sf: str) -> DataFrame:
    """Features with their split; its counts are taken once per session and input folder."""
    k = _key(spark, sf, "split")
    if k not in _MATERIALISED:
        _MATERIALISED[k] = SA.stratified_split(feature_table(spark, sf))
    return _MATERIALISED[k]


def release(spark: SparkSession | None = None) -> None:
    """Drop memoised fitted values and everything persisted."""
    spark = spark or SparkSession.getActiveSession()
    if spark is not None:
        release_kept(spark)
    for memo in (_MATERIALISED, _PARAMS, _TRAINED, _STAMPS):
        memo.clear()


def eval_set(spark: SparkSession, sf: str) -> DataFrame:
    """(split, id, label, score) for the validation and test splits."""
    f = split_features(spark, sf)
    return (f.where(F.col("split").isin("val", "test"))
            .select("split", "id", "label", SC.fixed_logit(f).alias("score")))


# --- scans and text ----------------------------------------------------------
@query("scan_claims")
def q_scan_claims(spark, sf):
    c = FX.claims(spark, sf)
    return c.withColumns({"tgldatang": F.col("tgldatang").cast("string"),
                          "tglpulang": F.col("tglpulang").cast("string")})


@query("clean_text")
def q_clean_text(spark, sf):
    c = FX.claims(spark, sf)
    return c.select("id", *[clean_text(x).alias(x) for x in K.TEXT_COLUMNS])


@query("null_tokens")
def q_null_tokens(spark, sf):
    c = FX.claims(spark, sf)
    return c.select("id", *[null_tokens(x).alias(x) for x in K.SCORING_TOKEN_COLUMNS])


@query("cbg_split")
def q_cbg_split(spark, sf):
    c = FX.claims(spark, sf)
    parts = split_code(clean_text("cbg"))
    return c.select("id", *[parts[p].alias(f"cbg_{p}") for p in ["CMG", "tipekasus", "spesifikkasus", "severity"]])


@query("kds_split")
def q_kds_split(spark, sf):
    c = FX.claims(spark, sf)
    cols = [x for x, _ in K.CODE_PARTS if x != "cbg"]
    df = c.select("id", *[clean_text(x).alias(x) for x in cols])
    return split_code_columns(df, [lp for lp in K.CODE_PARTS if lp[0] != "cbg"])


@query("kdsa_severity")
def q_kdsa_severity(spark, sf):
    c = FX.claims(spark, sf)
    sev = split_code(clean_text("kdsa"))["severity"]
    return c.select("id", sev.alias("kdsa_part"), kdsa_severity(sev).alias("kdsa_severity"))


@query("stay_days")
def q_stay_days(spark, sf):
    c = FX.claims(spark, sf)
    return c.select("id", stay_days("tgldatang", "tglpulang").alias("lama_rawat"))


# --- diagnosis codes -----------------------------------------------------------
@query("clean_diag")
def q_clean_diag(spark, sf):
    d = FX.diagnoses(spark, sf)
    return d.select("id", "ord", "diag", clean_diag("diag").alias("diag_clean"))


@query("icd_parts")
def q_icd_parts(spark, sf):
    d = FX.diagnoses(spark, sf).withColumn("code", clean_diag("diag"))
    return d.select("id", "ord", code_letter(F.col("code")).alias("letter"),
                    code_number(F.col("code")).alias("number"))


@query("icd_chapter")
def q_icd_chapter(spark, sf):
    d = FX.diagnoses(spark, sf).withColumn("code", clean_diag("diag"))
    num = F.coalesce(code_number(F.col("code")), F.lit(0))
    return d.select("id", "ord", icd_chapter(code_letter(F.col("code")), num).alias("chapter"))


# --- child tables ---------------------------------------------------------------
@query("diag_dedup")
def q_diag_dedup(spark, sf):
    return CH.dedupe_rows(FX.diagnoses(spark, sf))


@query("diag_primary")
def q_diag_primary(spark, sf):
    return CH.primary_diagnosis(CH.dedupe_rows(FX.diagnoses(spark, sf)))


@query("diag_primary_kddiag")
def q_diag_primary_kddiag(spark, sf):
    """The same from a table that names its code column ``kddiag``."""
    renamed = FX.diagnoses(spark, sf).withColumnRenamed("diag", "kddiag")
    return CH.primary_diagnosis(CH.dedupe_rows(CH.normalise_diag_columns(renamed)))


@query("diag_secondary")
def q_diag_secondary(spark, sf):
    return CH.secondary_counts(CH.dedupe_rows(FX.diagnoses(spark, sf)))


@query("diag_prepared")
def q_diag_prepared(spark, sf):
    dp = CH.diag_prepared(FX.diagnoses(spark, sf))
    return dp.withColumn("diag", clean_diag("diag"))


@query("proc_count")
def q_proc_count(spark, sf):
    return CH.proc_counts(FX.procedures(spark, sf))


# --- imputation and vocabulary ---------------------------------------------------
@query("fit_modes")
def q_fit_modes(spark, sf):
    c, d, _ = _tables(spark, sf)
    main = FE.clean_main(c)
    j = FE.joined_diag(main.select("id"), d)
    long = stack(main, K.MODE_COLUMNS, cast="string").unionByName(stack(j, ["diagfkrtl_letter"], cast="string"))
    return modes(long).select("name", "mode")


@query("fit_medians")
def q_fit_medians(spark, sf):
    c, d, _ = _tables(spark, sf)
    main = FE.clean_main(c)
    j = FE.joined_diag(main.select("id"), d)
    long = stack(main, K.MEDIAN_COLUMNS, cast="double", value="x").unionByName(
        stack(j, ["diagfkrtl_num", "diagfkrtl_sekunder_counts"], cast="double", value="x"))
    return exact_medians(long).select("name", "median")


@query("impute")
def q_impute(spark, sf):
    p = feature_params(spark, sf)
    main = FE.clean_main(FX.claims(spark, sf))
    out = main.select("id", "jenispulang", "pisat", "biaya")
    return out.select("id",
                      F.coalesce("jenispulang", F.lit(p.modes["jenispulang"])).alias("jenispulang"),
                      F.coalesce("pisat", F.lit(p.modes["pisat"])).alias("pisat"),
                      F.coalesce("biaya", F.lit(p.medians["biaya"]).cast("double")).alias("biaya"))


@query("fit_vocab")
def q_fit_vocab(spark, sf):
    return EN.vocab_table(FE.clean_main(FX.claims(spark, sf)), "typefaskes")


@query("merged_fit")
def q_merged_fit(spark, sf):
    """Modes, vocabulary and the medians' rank check, merged from the stored state of two batches, the second appended twice."""
    c, d, _ = _tables(spark, sf)
    path = SK.work_dir(spark, "fitted-state")
    for batch, part in (("a", "id % 2 = 0"), ("b", "id % 2 <> 0"), ("b", "id % 2 <> 0")):
        FS.append(c.where(part), d.where(part), path, batch)
    within = FS.rank_checked(FS.median_values(c, d), FS.merged_medians(spark, path))
    out = FS.merged_modes(spark, path).select(F.lit("mode").alias("kind"), "name", F.col("mode").alias("value"))
    out = out.unionByName(FS.merged_vocabulary(spark, path).select(F.lit("vocabulary").alias("kind"), F.lit(FS.VOCABULARY).alias("name"), "value"))
    return out.unionByName(within.select(F.lit("median within").alias("kind"), "name", F.col("within").cast("string").alias("value")))


@query("features")
def q_features(spark, sf):
    return feature_table(spark, sf)


# --- quality ---------------------------------------------------------------------
@query("validate")
def q_validate(spark, sf):
    c, d, p = _tables(spark, sf)
    return (QA.validate(c, "claims")
            .unionByName(QA.validate(d.drop("ord"), "diagnoses"))
            .unionByName(QA.validate(p, "procedures")))


@query("missing")
def q_missing(spark, sf):
    return QA.missing_values(FX.claims(spark, sf))


@query("duplicates")
def q_duplicates(spark, sf):
    _, d, p = _tables(spark, sf)
    return (QA.duplicate_rows(d.drop("ord")).select(F.lit("diagnoses").alias("table_name"), "duplicate_records")
            .unionByName(QA.duplicate_rows(p).select(F.lit("procedures").alias("table_name"), "duplicate_records")))


@query("observed_quality")
def q_observed_quality(spark, sf):
    """Counts of the claims, gathered while their feature table is written."""
    rows, seen = OB.observed(claim_rows(spark, sf), leave_out=FE.CHILD_COLUMNS)
    FE.transform_rows(rows, feature_params(spark, sf)).write.parquet(SK.work_dir(spark, "observed-features"))
    return OB.counts(spark, seen)


@query("label_share")
def q_label_share(spark, sf):
    return QA.label_share(FX.claims(spark, sf))


# --- sampling and splits -----------------------------------------------------------
@query("sample_exact")
def q_sample_exact(spark, sf):
    return SA.sample_exact(FX.claims(spark, sf).select("id", "label"))


@query("sample_children")
def q_sample_children(spark, sf):
    c, d, _ = _tables(spark, sf)
    return SA.sample_children(d, SA.sample_exact(c.select("id")))


@query("split")
def q_split(spark, sf):
    return split_features(spark, sf).select("id", "label", "split")


@query("eval_subsample")
def q_eval_subsample(spark, sf):
    tr = split_features(spark, sf).where(F.col("split") == "train").select("id", "label")
    return SA.eval_subsample(tr, K.EVAL_SUBSAMPLE)


@query("undersample")
def q_undersample(spark, sf):
    tr = split_features(spark, sf).where(F.col("split") == "train").select("id", "label")
    return SA.undersample(tr)


# --- metrics ------------------------------------------------------------------------
@query("confusion")
def q_confusion(spark, sf):
    return ME.confusion(eval_set(spark, sf), EVAL_THRESHOLDS, groups=["split"])


@query("metrics")
def q_metrics(spark, sf):
    return ME.metrics(eval_set(spark, sf), (K.DEFAULT_THRESHOLD,), groups=["split"])


@query("metrics_by_split")
def q_metrics_by_split(spark, sf):
    return ME.metrics(eval_set(spark, sf), EVAL_THRESHOLDS, groups=["split"])


@query("roc_curve")
def q_roc_curve(spark, sf):
    return ME.roc_curve(ME.curve_points(eval_set(spark, sf), groups=["split"]), groups=["split"])


@query("pr_curve")
def q_pr_curve(spark, sf):
    return ME.pr_curve(ME.curve_points(eval_set(spark, sf), groups=["split"]), groups=["split"])


@query("roc_auc")
def q_roc_auc(spark, sf):
    return ME.roc_auc(ME.curve_points(eval_set(spark, sf), groups=["split"]), groups=["split"])


@query("pr_auc")
def q_pr_auc(spark, sf):
    return ME.pr_auc(ME.curve_points(eval_set(spark, sf), groups=["split"]), groups=["split"])


@query("tune_threshold")
def q_tune_threshold(spark, sf):
    pts = ME.curve_points(eval_set(spark, sf), groups=["split"])
    pts = pts.withColumn("target_precision", F.explode(F.array(*[F.lit(t) for t in TARGET_PRECISIONS])))
    return ME.tune_threshold_for_targets(pts, groups=["split"])


# --- encoding -------------------------------------------------------------------------
@query("onehot")
def q_onehot(spark, sf):
    return EN.onehot_long(feature_table(spark, sf), K.KNOWN_CAT_VOCAB)


@query("onehot_open")
def q_onehot_open(spark, sf):
    p = feature_params(spark, sf)
    return EN.onehot_long(feature_table(spark, sf), {"typefaskes": p.facility_vocab})


@query("ordinal")
def q_ordinal(spark, sf):
    return EN.ordinal_columns(feature_table(spark, sf))


# --- scoring ----------------------------------------------------------------------------
@query("score_batch")
def q_score_batch(spark, sf):
    from claimlens.functions.text import null_token_columns
    return SC.score(FE.transform_rows(null_token_columns(claim_rows(spark, sf)), feature_params(spark, sf)))


def raw_scored(spark: SparkSession, sf: str) -> DataFrame:
    c, d, p = _tables(spark, sf)
    return SC.with_raw_figures(q_score_batch(spark, sf), c, SC.raw_counts(c, d, p))


@query("reasons")
def q_reasons(spark, sf):
    s = SC.reasons(raw_scored(spark, sf))
    return s.select("id", "is_fraud", F.array_join("reasons", ",").alias("reasons"), F.size("reasons").alias("n_reasons"))


def nested_table(spark: SparkSession, sf: str, claims: DataFrame | None = None) -> DataFrame:
    """Claims that carry their children in short lists: null, empty, without a primary, and full ones."""
    c = claims if claims is not None else _tables(spark, sf)[0]
    kind = "array<struct<diag:string,levelid:int>>"
    lists = F.expr(f"""CASE id % 5 WHEN 0 THEN CAST(null AS {kind}) WHEN 1 THEN CAST(array() AS {kind})
        WHEN 2 THEN array(named_struct('diag', 'I10', 'levelid', 2))
        WHEN 3 THEN array(named_struct('diag', diagfktp, 'levelid', CAST(null AS INT)), named_struct('diag', 'I10', 'levelid', 2))
        ELSE array(named_struct('diag', 'E11.9', 'levelid', 1), named_struct('diag', 'I10', 'levelid', 2), named_struct('diag', 'I11', 'levelid', 2),
                   named_struct('diag', 'I12', 'levelid', 2), named_struct('diag', 'I13', 'levelid', 2), named_struct('diag', 'I13', 'levelid', 2)) END""")
    procs = F.expr("""CASE id % 4 WHEN 0 THEN CAST(null AS array<string>) WHEN 1 THEN CAST(array() AS array<string>)
        WHEN 2 THEN array('99.04', '88.78') ELSE array('1', '2', '3', '4', '5', '6') END""")
    return c.withColumn("diagnoses", lists).withColumn("procedures", procs)


@query("nested_claims")
def q_nested_claims(spark, sf):
    return SC.nested_counts(nested_table(spark, sf))


@query("score_nested")
def q_score_nested(spark, sf):
    out = SC.score_nested(nested_table(spark, sf, stored_claims(spark, sf)), feature_params(spark, sf))
    return out.select("id", "is_fraud", "fraud_probability", "confidence_score", "explanation")


@query("quality_report")
def q_quality_report(spark, sf):
    """The validation report with its maps spread into rows: column, type, missing values."""
    r = QA.quality_report(_tables(spark, sf)[0], "claims")
    rows = r.select("num_rows", "num_cols", "duplicate_records", "dtypes", F.explode("missing_values").alias("column_name", "missing"))
    return rows.select("num_rows", "num_cols", "duplicate_records", "column_name", "missing",
                       F.element_at("dtypes", F.col("column_name")).alias("data_type"))


@query("sampled_tables")
def q_sampled_tables(spark, sf):
    """Row counts of the claims sample and its child rows."""
    names = ("claims", "diagnoses", "procedures")
    counts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "n")
              for n, t in zip(names, SA.sampled_tables(*_tables(spark, sf), frac=SAMPLED), strict=True)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# --- overview -------------------------------------------------------------------------
@query("overview_demographics")
def q_overview_demographics(spark, sf):
    return OV.demographics(feature_table(spark, sf))


@query("overview_cost")
def q_overview_cost(spark, sf):
    return OV.cost_by_age(feature_table(spark, sf))


@query("overview_imbalance")
def q_overview_imbalance(spark, sf):
    return OV.imbalance(feature_table(spark, sf))


# --- training --------------------------------------------------------------------------
# The fixture's own label is noise; training runs on a label planted in the same claims, so that there is something to learn.
# The settings are the reference's but for depth (30 levels at most).
from claimlens.plans import artefact as AR  # noqa: E402
from claimlens.plans import training as TR  # noqa: E402
from claimlens.plans import trees as TE  # noqa: E402
from claimlens.sources import runs as RU  # noqa: E402
from claimlens.sources import sinks as SK  # noqa: E402

TRAIN = TR.TrainConfig()
_TRAINED: dict[tuple, TR.TrainResult] = {}


def planted(features: DataFrame) -> DataFrame:
    """The feature table with a label that follows from cost, stay, severity and children, with some noise by id."""
    points = sum((F.when(c, F.lit(w)).otherwise(F.lit(0.0)) for c, w in (
        (F.col("biaya") > 25_000_000, 2.0), (F.col("lama_rawat") > 80, 1.5), (F.col("cbg_severity") == "III", 1.0),
        (F.col("diagfkrtl_sekunder_counts") > 3, 1.0), (F.col("proc_count") > 5, 1.0))), F.lit(0.0))
    noise = F.pmod(F.xxhash64("id", F.lit("planted")), F.lit(1000)) / 1000.0
    return features.withColumn("label", (points + noise > 4.0).cast("int"))


def trained(spark: SparkSession, sf: str) -> TR.TrainResult:
    """Model fitted once per session and input folder."""
    k = _key(spark, sf, "trained")
    if k not in _TRAINED:
        _TRAINED[k] = TR.train(planted(feature_table(spark, sf)), feature_params(spark, sf).facility_vocab, TRAIN)
    return _TRAINED[k]


@query("encode")
def q_encode(spark, sf):
    p = feature_params(spark, sf)
    f = feature_table(spark, sf)
    enc = EN.encode(EN.fit_encoder(f, p.facility_vocab), f)
    from pyspark.ml.functions import vector_to_array
    arr = vector_to_array("features")
    return enc.select("id", "label", F.size(arr).alias("width"),
                      F.size(F.filter(arr, lambda x: x != 0)).alias("nonzero"))


@query("train_gbt")
def q_train_gbt(spark, sf):
    return TR.evaluation(trained(spark, sf).eval_scores)


@query("train_losses")
def q_train_losses(spark, sf):
    """Training and validation loss after each fitted round, with the round that was kept."""
    r = trained(spark, sf)
    rows = [(k + 1, float(a), float(b), r.best_iteration) for k, (a, b) in enumerate(zip(r.train_loss, r.val_loss, strict=True))]
    return spark.createDataFrame(rows, "iteration int, train_loss double, val_loss double, best_iteration int")


# Trees that are given, not fitted: scoring and curves over them can be repeated in SQL. (feature, threshold, left, right, leaf value)
FIXED_TREES = [
    [("biaya", 15_000_000.0, 1, 2, None), (None, None, None, None, -0.375), (None, None, None, None, 0.625)],
    [("lama_rawat", 40.0, 1, 2, None), (None, None, None, None, -0.3125), (None, None, None, None, 0.5)],
    [("usia", 48.0, 1, 4, None), ("diagfkrtl_sekunder_counts", 2.0, 2, 3, None), (None, None, None, None, -0.1875), (None, None, None, None, 0.125),
     ("proc_count", 3.0, 5, 6, None), (None, None, None, None, 0.0), (None, None, None, None, 0.34375)],
    [("proc_count", 5.0, 1, 2, None), (None, None, None, None, -0.125), (None, None, None, None, 0.25)],
]


def fixed_model(encoder, encoded: DataFrame) -> TE.BoostedTreesModel:
    slot = {name: k for k, name in enumerate(EN.feature_names(encoder, encoded))}
    trees = [[(slot[f"{n[0]}__num"] if n[0] else None, *n[1:]) for n in tree] for tree in FIXED_TREES]
    return TE.BoostedTreesModel(TE.Trees.of(trees))


def fixed_artefact(spark: SparkSession, sf: str):
    """The scoring artefact around the given trees."""
    params = feature_params(spark, sf)
    f = feature_table(spark, sf)
    encoder = EN.fit_encoder(f, params.facility_vocab)
    return AR.assembled(params, encoder, fixed_model(encoder, encoder.transform(f)))


def curve_rows(spark: SparkSession, sf: str) -> tuple[TE.BoostedTreesModel, DataFrame]:
    """The given trees, and the whole, unbalanced training and validation splits with ``set``."""
    encoder, enc = TR.prepare(feature_table(spark, sf), feature_params(spark, sf).facility_vocab, TRAIN)
    sets = enc.where(F.col("split").isin("train", "val")).select(F.col("split").alias("set"), "id", "label", "features")
    return fixed_model(encoder, enc), sets


@query("partial_scores")
def q_partial_scores(spark, sf):
    return TR.partial_scores(*curve_rows(spark, sf))


def round_table(spark: SparkSession, sf: str) -> DataFrame:
    model, sets = curve_rows(spark, sf)
    rounds = TR.curve_rounds(model.getNumTrees)
    return TR.round_figures(TR.running_scores(model, sets, rounds), rounds, CURVE_THRESHOLD)


CURVE_THRESHOLD = 0.6


@query("learning_curve")
def q_learning_curve(spark, sf):
    return round_table(spark, sf).select("set", "iteration", "precision", "recall")


@query("round_loss")
def q_round_loss(spark, sf):
    return round_table(spark, sf).select("set", "iteration", "loss")


@query("run_store")
def q_run_store(spark, sf):
    """Curves of two runs (two of the given trees, then all), the second appended twice; the latest is read back."""
    model, sets = curve_rows(spark, sf)
    path = SK.work_dir(spark, "run-store")
    for run, n in (("2024-01-01", 2), ("2024-01-02", 4), ("2024-01-02", 4)):
        rounds = TR.curve_rounds(n)
        figures = TR.round_figures(TR.running_scores(model, sets, rounds), rounds, CURVE_THRESHOLD)
        RU.append(RU.figure_rows(figures), path, run)
    return RU.latest(spark, path)


@query("round_auc")
def q_round_auc(spark, sf):
    return TR.round_auc(TR.partial_scores(*curve_rows(spark, sf)))


@query("rebalance")
def q_rebalance(spark, sf):
    """Rows per label after over- and under-sampling the training split."""
    enc = TR.prepare(feature_table(spark, sf), feature_params(spark, sf).facility_vocab, TRAIN)[1]
    return TR.rebalanced(enc.where(F.col("split") == "train"), TRAIN).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("score_batch_model")
def q_score_batch_model(spark, sf):
    """Claims scored by the artefact, child tables joined."""
    return AR.score_rows(fixed_artefact(spark, sf), claim_rows(spark, sf))


@query("score_nested_model")
def q_score_nested_model(spark, sf):
    """Nested claims scored by the same artefact."""
    return AR.score_lists(fixed_artefact(spark, sf), nested_table(spark, sf, stored_claims(spark, sf))).drop("model_info")


@query("score_batch_trained")
def q_score_batch_trained(spark, sf):
    """Claims scored by the trained artefact, saved and loaded."""
    r = trained(spark, sf)
    path = SK.save_model(AR.assembled(feature_params(spark, sf), r.encoder, r.model), SK.work_dir(spark, "artefact"))
    return AR.score_tables(SK.load_pipeline(path), *_tables(spark, sf))


@query("score_roundtrip")
def q_score_roundtrip(spark, sf):
    """Scores of the saved and re-loaded artefact equal those before saving."""
    r, p = trained(spark, sf), feature_params(spark, sf)
    artefact = AR.assembled(p, r.encoder, r.model)
    loaded = SK.load_pipeline(SK.save_model(artefact, SK.work_dir(spark, "artefact")))
    a = AR.score_tables(artefact, *_tables(spark, sf)).select("id", F.col("fraud_probability").alias("a"))
    b = AR.score_tables(loaded, *_tables(spark, sf)).select("id", F.col("fraud_probability").alias("b"))
    return a.join(b, "id").select("id", (F.col("a") == F.col("b")).alias("same"))


@query("run_record")
def q_run_record(spark, sf):
    r = trained(spark, sf)
    rec = TR.run_record(spark, r, TR.evaluation(r.eval_scores), TRAIN)
    path = SK.append_run_record(rec, SK.work_dir(spark, "runs"))
    return SK.read_run_records(spark, path)


@query("headline")
def q_headline(spark, sf):
    """Headline figures from the run-record table (latest run, defaults if absent)."""
    r = trained(spark, sf)
    rec = TR.run_record(spark, r, TR.evaluation(r.eval_scores), TRAIN)
    path = SK.append_run_record(rec, SK.work_dir(spark, "runs"))
    return TR.headline(SK.read_run_records(spark, path))


@query("eval_sink")
def q_eval_sink(spark, sf):
    """Evaluation rows (fixed scorer) written and read back."""
    scores = eval_set(spark, sf)
    path = SK.write_report(scores, SK.work_dir(spark, "eval"))
    return SK.read_report(spark, path, scores.schema)


@query("model_roundtrip")
def q_model_roundtrip(spark, sf):
    """Saved and re-loaded model scores the evaluation rows identically."""
    r = trained(spark, sf)
    path = SK.save_model(r.model, SK.work_dir(spark, "model"))
    m2 = TE.BoostedTreesModel.load(path)
    enc = TR.prepare(feature_table(spark, sf), feature_params(spark, sf).facility_vocab, TRAIN)[1]
    ev = enc.where(F.col("split").isin("val", "test"))
    a = r.model.transform(ev).select("id", F.col("probability").alias("p_saved"))
    b = m2.transform(ev).select("id", F.col("probability").alias("p_loaded"))
    return a.join(b, "id").select("id", (F.col("p_saved") == F.col("p_loaded")).alias("same"))


@query("prep_roundtrip")
def q_prep_roundtrip(spark, sf):
    """Fitted parameters and encoder saved, re-loaded and re-applied."""
    p = feature_params(spark, sf)
    path = SK.save_params(spark, p.to_dict(), SK.work_dir(spark, "params"))
    p2 = FE.FeatureParams.from_dict(SK.load_params(spark, path))
    c, d, pr = _tables(spark, sf)
    f = FE.transform(c, d, pr, p2)
    enc_path = SK.save_model(EN.fit_encoder(f, p2.facility_vocab), SK.work_dir(spark, "encoder"))
    from pyspark.ml.functions import vector_to_array
    return SK.load_pipeline(enc_path).transform(f).select(
        "id", "label", F.size(vector_to_array("features")).alias("width"))


# --- streaming, CSV source, report sink, raw child counts, explanations ---------
from claimlens.sources import bulk as BU  # noqa: E402
from claimlens.streaming import score_stream as ST  # noqa: E402


@query("score_stream")
def q_score_stream(spark, sf):
    """Orders arrive as a stream; scored output equals the batch scoring."""
    stream = ST.scored_stream(spark, sf, feature_params(spark, sf))
    return ST.run_to_table(spark, stream)


@query("scan_csv")
def q_scan_csv(spark, sf):
    """Claims exported to CSV and read back with a declared schema (PERMISSIVE)."""
    c, d, p = _tables(spark, sf)
    path = SK.work_dir(spark, "claims-csv")
    (c.write.mode("overwrite").option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    back = (spark.read.schema(c.schema).option("header", True).option("mode", "PERMISSIVE")
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return FE.transform(back, d, p, feature_params(spark, sf))


STREAM_FILE_ROWS = 500_000


def part_files(rows: int) -> int:
    """Files for so many rows of a stream's input, so that no task writes or reads more than some ``STREAM_FILE_ROWS``."""
    return max(1, -(-rows // STREAM_FILE_ROWS))


def nested_stream(spark: SparkSession, sf: str, resent: bool = False) -> DataFrame:
    """The nested claims as a stream of files; ``resent``: claims with an odd id come once more in later files."""
    path = SK.work_dir(spark, "nested-claims")
    nested, files = nested_table(spark, sf), 4 * part_files(read_table(spark, sf, "orders").count() // 4)
    nested.repartition(files).write.parquet(path)
    if resent:
        nested.where("id % 2 = 1").repartition(files // 2).write.mode("append").parquet(path)
    return spark.readStream.schema(nested.schema).option("maxFilesPerTrigger", files // 2).parquet(path)


@query("score_nested_stream")
def q_score_nested_stream(spark, sf):
    """Nested claims that arrive as a stream: a projection of each row, no state and no shuffle."""
    out = SC.score_nested(nested_stream(spark, sf), feature_params(spark, sf)).drop("model_info")
    return ST.run_to_table(spark, out, "nested")


@query("stream_dedup")
def q_stream_dedup(spark, sf):
    """Nested claims of which many are sent twice: each is scored once."""
    stream = ST.first_sent(nested_stream(spark, sf, resent=True), "tgldatang", "4000 days")
    return ST.run_to_table(spark, SC.score_nested(stream, feature_params(spark, sf)).drop("model_info"), "dedup")


def child_streams(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Claims, diagnoses and procedures as three streams of files; about a third of the child rows come in a later turn than their claims, a
    third in an earlier one. A last row of id -1 in each closes the time, so that every claim is due. Each table is derived once, by turn."""
    claims, diag, proc = FX.fixture_tables(spark, sf)
    visit = claims.select("id", "tgldatang")
    out = []
    for name, rows in (("claims", claims), ("diagnoses", diag.join(visit, "id")), ("procedures", proc.join(visit, "id"))):
        path, staged = SK.work_dir(spark, f"{name}-stream"), SK.work_dir(spark, f"{name}-turns")
        turn = F.pmod(F.xxhash64(*rows.columns), F.lit(3)) if name != "claims" else F.when(F.col("id") % 2 == 0, 1).when(F.col("id") % 2 == 1, 2)
        rows.withColumn("_turn", turn.cast("int")).where("_turn is not null").write.partitionBy("_turn").parquet(staged)
        turns = spark.read.schema(f"{rows.schema.toDDL()}, _turn int").parquet(staged)
        files = part_files(turns.count() // 3)
        for k in range(3):
            turns.where(F.col("_turn") == k).drop("_turn").coalesce(files).write.mode("append").parquet(path)
        closing = spark.range(1).select(*[
            F.lit({"id": "-1", "tgldatang": "2100-01-01"}.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema])
        closing.coalesce(1).write.mode("append").parquet(path)
        out.append(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path))
    return tuple(out)


@query("stream_children")
def q_stream_children(spark, sf):
    """Claims and their children arrive in three streams: scores equal the batch's."""
    return ST.run_to_table(spark, ST.scored_with_children(*child_streams(spark, sf), feature_params(spark, sf), delay="4000 days"), "children")


@query("score_stream_model")
def q_score_stream_model(spark, sf):
    """The same stream through the artefact."""
    return ST.run_to_table(spark, AR.score_lists(fixed_artefact(spark, sf), nested_stream(spark, sf)).drop("model_info"), "nested-model")


def dirty_csv(spark: SparkSession, sf: str) -> tuple[str, object]:
    """Claims as CSV, some with an id or a cost that is no number, some without an id; and the claims' schema."""
    c = stored_claims(spark, sf)
    k = F.col("id")
    bad = c.withColumns({"id": F.when(k % 97 == 0, F.concat(F.lit("x"), k)).when(k % 89 == 0, None).otherwise(k.cast("string")),
                         "biaya": F.when(k % 83 == 0, F.lit("n/a")).otherwise(F.col("biaya").cast("string"))})
    path = SK.work_dir(spark, "dirty-csv")
    bad.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path, c.schema


@query("csv_rejects")
def q_csv_rejects(spark, sf):
    """Rows set aside, by reason; values beside the bad one are kept."""
    path, schema = dirty_csv(spark, sf)
    rows = BU.rejects(BU.read_claims(spark, path, schema))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum("id_peserta").alias("members"))


@query("csv_report")
def q_csv_report(spark, sf):
    """The usable rows scored by the artefact; the batch is written twice and stands in the report once."""
    path, schema = dirty_csv(spark, sf)
    artefact, target, children = fixed_artefact(spark, sf), SK.work_dir(spark, "bulk"), child_tables(spark, sf)
    for _ in range(2):
        report, _ = BU.scored_report(spark, path, schema, target, "2024-01-01", lambda c: AR.score_rows(artefact, FE.with_child_tables(c, *children)))
    return spark.read.parquet(report).drop("batch")


@query("report_sink")
def q_report_sink(spark, sf):
    """Scored claims written as parquet and read back."""
    s = q_score_batch(spark, sf)
    path = SK.write_report(s, SK.work_dir(spark, "report"))
    return SK.read_report(spark, path, s.schema)


@query("raw_child_counts")
def q_raw_child_counts(spark, sf):
    """Counts as the explanation sees them: raw (not de-duplicated) child rows."""
    return SC.raw_counts(*_tables(spark, sf)).withColumnsRenamed({"n_secondary": "n_secondary_raw", "n_procedures": "n_procedures_raw"})


@query("explain")
def q_explain(spark, sf):
    return SC.explain(raw_scored(spark, sf))


# --- neighbours and synthetic over-sampling ----------------------------------
from claimlens.operators import neighbors as NB  # noqa: E402

KNN_MINORITY_LABEL = 0
KNN_K = 5


@query("knn_minority")
def q_knn_minority(spark, sf):
    """Exact 5 nearest neighbours among the minority rows (label 0) of ``embeddings``."""
    tune_session(spark)
    e = read_table(spark, sf, "embeddings").where(F.col("label") == KNN_MINORITY_LABEL)
    nn = NB.knn(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), KNN_K)
    return nn


@query("knn_lsh")
def q_knn_lsh(spark, sf):
    """Neighbours of every row of ``embeddings`` by hashing, held against the exact ones."""
    tune_session(spark)
    e = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    found = LSH.lsh_knn(e, KNN_K)
    return LSH.recall(found, NB.knn(e, KNN_K)).select("n_links", (F.col("recall") >= 0.9).alias("recall_reached"))


@query("oversample")
def q_oversample(spark, sf):
    """Synthetic fraud rows for the encoded training split."""
    enc = TR.prepare(feature_table(spark, sf), feature_params(spark, sf).facility_vocab, TRAIN)[1]
    tr = enc.where(F.col("split") == "train").select("id", "label", SP.sparse("features").alias("vec"))
    out = NB.oversample(tr, KNN_K)
    return out.select("id", "label", "is_synthetic", F.col("vec.size").alias("width"))


@query("oversample_embeddings")
def q_oversample_embeddings(spark, sf):
    """Synthetic minority rows over ``embeddings`` (label 0 is the minority class)."""
    tune_session(spark)
    e = read_table(spark, sf, "embeddings")
    rows = e.select(F.col("vec_id").alias("id"),
                    F.when(F.col("label") == KNN_MINORITY_LABEL, 1).otherwise(0).alias("label"),
                    F.col("embedding").cast("array<double>").alias("vec"))
    out = NB.oversample(rows, KNN_K)
    return out.select("id", "label", "is_synthetic", F.element_at("vec", 1).alias("x_first"),
                      F.element_at("vec", -1).alias("x_last"), F.size("vec").alias("dim"))
