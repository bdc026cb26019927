"""Structural pass: claims + diagnoses + procedures -> one feature row per claim.

Plan shape: the two child tables are reduced by claim id (partial + final
aggregation), then left-joined to the claims on ``id``; both right sides are
unique by id, so the joins never fan out, and they share one hash
partitioning of the claims. Imputation values are fitted once (small
aggregate jobs) and applied as literals.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens import constants as K
from claimlens.functions.codes import split_code_columns
from claimlens.functions.dates import stay_days
from claimlens.functions.diagnosis import clean_diag, code_letter, code_number, icd_chapter
from claimlens.functions.text import clean_text_columns
from claimlens.operators.children import diag_prepared, proc_counts
from claimlens.operators.impute import collect_params, fill, median_table, mode_table
from claimlens.operators.prefix import approx_medians, exact_medians, modes_from_counts, stack, value_counts

FEATURE_COLUMNS = [
    "id", "id_peserta", "label",
    "jenispulang", "jenkel", "pisat", "biaya", "typefaskes", "usia", "jenispel", "kelasrawat",
    "lama_rawat",
    "cbg_CMG", "cbg_tipekasus", "cbg_spesifikkasus", "cbg_severity",
    "kdsa_CMG", "kdsa_tipekasus", "kdsa_spesifikkasus", "kdsa_severity",
    "kdsp_spesifikkasus", "kdsp_severity", "kdsr_spesifikkasus", "kdsr_severity",
    "kdsi_spesifikkasus", "kdsd_spesifikkasus", "kdsd_severity",
    "diagfkrtl_sekunder_counts", "diagfktp_icd10", "diagfkrtl_icd10", "proc_count",
]


@dataclass
class FeatureParams:
    """Fitted state of the structural pass (all tiny)."""
    modes: dict = field(default_factory=dict)          # main-table modes
    medians: dict = field(default_factory=dict)        # main-table medians (biaya)
    diag_letter_mode: str | None = None
    diag_num_median: float | None = None
    secondary_median: float | None = None
    facility_vocab: list = field(default_factory=list)

    def to_dict(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_dict(d: dict) -> "FeatureParams":
        return FeatureParams(**d)


def clean_main(claims: DataFrame) -> DataFrame:
    """Text clean-up, politujuan dropped, numeric casts (strict)."""
    df = clean_text_columns(claims).drop("politujuan")
    casts = {"biaya": "double", "usia": "bigint", "kelasrawat": "bigint"}
    return df.withColumns({c: F.col(c).cast(t) for c, t in casts.items() if c in df.columns})


def engineer(main: DataFrame) -> DataFrame:
    """Diagnosis clean of the clinic code, stay days, code parts; dati2 dropped."""
    df = main.withColumn("diagfktp", clean_diag("diagfktp"))
    df = df.withColumn("lama_rawat", stay_days("tgldatang", "tglpulang")).drop("tgldatang", "tglpulang")
    return split_code_columns(df).drop("dati2")


def diag_parts(diag: DataFrame, by: tuple[str, ...] = ("id",)) -> DataFrame:
    """Per-claim primary diagnosis letter / number and secondary count."""
    dp = diag_prepared(diag, by).withColumn("diag", clean_diag("diag"))
    return dp.select(*by, "diagfkrtl_sekunder_counts",
                     code_letter(F.col("diag")).alias("diagfkrtl_letter"),
                     code_number(F.col("diag")).cast("double").alias("diagfkrtl_num"))


def joined_diag(main: DataFrame, diag: DataFrame) -> DataFrame:
    return main.join(diag_parts(diag), "id", "left")


def fit(claims: DataFrame, diag: DataFrame, proc: DataFrame, median: str = "exact") -> FeatureParams:
    """Fit imputation values and the facility-type vocabulary.

    Value counts give the modes and the vocabulary; exact medians come from
    bucketed running sums over distinct values (``median="approx"`` uses one
    ``percentile_approx`` sketch pass instead)."""
    # the claims are re-read per job (a pruned columnar scan is cheaper than a
    # cached copy of every claim); the joined diagnosis parts are kept, since
    # rebuilding them means re-shuffling the diagnosis table
    main = clean_main(claims)
    j = joined_diag(main.select("id"), diag).persist(StorageLevel.MEMORY_AND_DISK)
    params = fit_parts(main, j, median)
    j.unpersist()
    return params


def fit_rows(rows: DataFrame, median: str = "exact") -> FeatureParams:
    """``fit`` on claim rows that carry ``CHILD_COLUMNS``."""
    return fit_parts(clean_main(rows), rows, median)


def fit_parts(main: DataFrame, j: DataFrame, median: str) -> FeatureParams:
    """Fitted values from cleaned claims and, row by row, their diagnosis figures."""
    mode_cols = [c for c in K.MODE_COLUMNS if c in main.columns]
    long_modes = stack(main, mode_cols + list(K.OPEN_CAT_COLUMNS), cast="string").unionByName(
        stack(j, ["diagfkrtl_letter"], cast="string"))
    vc = value_counts(long_modes).persist(StorageLevel.MEMORY_AND_DISK)
    m = collect_params(modes_from_counts(vc), "mode")
    vocab = sorted(r[0] for r in vc.where(F.col("name") == K.OPEN_CAT_COLUMNS[0]).select("v").collect())
    long_med = stack(main, K.MEDIAN_COLUMNS, cast="double", value="x").unionByName(
        stack(j, ["diagfkrtl_num", "diagfkrtl_sekunder_counts"], cast="double", value="x"))
    med_fn = exact_medians if median == "exact" else approx_medians
    med = collect_params(med_fn(long_med), "median")
    vc.unpersist()
    return FeatureParams(
        modes={c: m.get(c) for c in mode_cols},
        medians={c: med.get(c) for c in K.MEDIAN_COLUMNS},
        diag_letter_mode=m.get("diagfkrtl_letter"),
        diag_num_median=med.get("diagfkrtl_num"),
        secondary_median=med.get("diagfkrtl_sekunder_counts"),
        facility_vocab=vocab,
    )


def proc_table(proc: DataFrame, by: tuple[str, ...] = ("id",)) -> DataFrame:
    return proc_counts(proc, by)


def transform(claims: DataFrame, diag: DataFrame, proc: DataFrame, params: FeatureParams) -> DataFrame:
    """The structural pass as one lazy plan."""
    return transform_with_children(claims, diag_parts(diag), proc_table(proc), params)


CHILD_COLUMNS = ("diagfkrtl_letter", "diagfkrtl_num", "diagfkrtl_sekunder_counts", "proc_count")


def with_child_tables(claims: DataFrame, dparts: DataFrame, pcounts: DataFrame, by: tuple[str, ...] = ("id",)) -> DataFrame:
    """Claims with ``CHILD_COLUMNS`` from the per-claim child aggregates (unique by ``by``); null where a claim has none."""
    return claims.join(dparts, list(by), "left").join(pcounts, list(by), "left")


def with_child_lists(nested: DataFrame) -> DataFrame:
    """The same from claims that carry their children in lists: expressions over one row, no explode, no join, no shuffle.

    ``diagnoses`` array<struct<diag, levelid>> and ``procedures`` array<string>, the latter two dropped. List position is the row order: of
    equal rows the first counts, and the primary code is the last distinct one of level 1. A null entry is no row, a missing level is 1, a
    missing code is empty text; claims without a primary code get null figures, as in the tables."""
    rows = F.transform(F.filter("diagnoses", lambda d: d.isNotNull()), lambda d: F.struct(
        F.coalesce(d["diag"], F.lit("")).alias("diag"), F.coalesce(d["levelid"].cast("int"), F.lit(1)).alias("levelid")))

    def codes(level: int) -> Column:
        return F.array_distinct(F.transform(F.filter(rows, lambda d: d["levelid"] == level), lambda d: d["diag"]))

    df = nested.withColumns({"_primary": codes(1), "_secondary": codes(2)})
    primary = clean_diag(F.get("_primary", F.size("_primary") - 1))
    has = F.size("_primary") > 0
    return df.withColumns({
        "diagfkrtl_letter": F.when(has, code_letter(primary)),
        "diagfkrtl_num": F.when(has, code_number(primary).cast("double")),
        "diagfkrtl_sekunder_counts": F.when(has, F.size("_secondary").cast("bigint")),
        "proc_count": F.when(F.size("procedures") > 0, F.size(F.array_distinct("procedures")).cast("bigint")),
    }).drop("_primary", "_secondary", "diagnoses", "procedures")


def transform_with_children(claims: DataFrame, dparts: DataFrame, pcounts: DataFrame,
                            params: FeatureParams) -> DataFrame:
    """Structural pass given the per-claim child aggregates (id-unique tables)."""
    return transform_rows(with_child_tables(claims, dparts, pcounts), params)


def transform_nested(nested: DataFrame, params: FeatureParams, keep: tuple[str, ...] = ()) -> DataFrame:
    """Structural pass of claims that carry their children; a narrow projection, so it runs on streams without state."""
    return transform_rows(with_child_lists(nested), params, keep)


def transform_rows(rows: DataFrame, params: FeatureParams, keep: tuple[str, ...] = ()) -> DataFrame:
    """Structural pass of claim rows with ``CHILD_COLUMNS``: a projection of one row each. ``keep``: other columns to pass on."""
    main = clean_main(rows)
    main = fill(main, params.modes)
    main = fill(main, params.medians, cast={"biaya": "double"})
    df = engineer(main)
    df = fill(df, {"diagfkrtl_letter": params.diag_letter_mode,
                   "diagfkrtl_num": params.diag_num_median,
                   "diagfkrtl_sekunder_counts": params.secondary_median},
              cast={"diagfkrtl_num": "double", "diagfkrtl_sekunder_counts": "double"})
    tp_letter = code_letter(F.col("diagfktp"))
    tp_num = F.coalesce(code_number(F.col("diagfktp")), F.lit(0)).cast("bigint")
    rt_num = F.coalesce(F.col("diagfkrtl_num"), F.lit(0.0)).cast("bigint")
    df = df.withColumns({
        "diagfktp_icd10": icd_chapter(tp_letter, tp_num),
        "diagfkrtl_icd10": icd_chapter(F.col("diagfkrtl_letter"), rt_num),
        "diagfkrtl_sekunder_counts": F.col("diagfkrtl_sekunder_counts").cast("bigint"),
        "proc_count": F.coalesce(F.col("proc_count"), F.lit(0)).cast("bigint"),
    }).drop("diagfktp", "diagfkrtl_letter", "diagfkrtl_num")
    if "label" in df.columns:
        df = df.withColumn("label", F.coalesce(F.col("label").cast("int"), F.lit(0)))
    else:
        df = df.withColumn("label", F.lit(0))
    return df.select(*[c for c in FEATURE_COLUMNS if c in df.columns], *keep)


def build(claims: DataFrame, diag: DataFrame, proc: DataFrame,
          params: FeatureParams | None = None) -> tuple[DataFrame, FeatureParams]:
    """Fit (unless given) and transform."""
    params = params or fit(claims, diag, proc)
    return transform(claims, diag, proc, params), params
