"""Encoding of the feature table: one-hot (closed and learned vocabularies),
ordinal codes, and the assembled vector.

The vector path is an MLlib ``Pipeline``: ``StringIndexerModel.from_labels``
with ``handleInvalid="keep"`` puts unknown values on an extra last index
that ``OneHotEncoder(dropLast=True)`` drops, so unknown (and null) values
encode as all zeros.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens import constants as K


def fit_vocab(df: DataFrame, col: str = "typefaskes") -> list[str]:
    """Learned vocabulary: sorted distinct non-null values (bounded by the category count)."""
    return [r[0] for r in df.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col).collect()]


def vocab_table(df: DataFrame, col: str = "typefaskes") -> DataFrame:
    """Learned vocabulary as a table (value, index) in sorted order."""
    vals = df.where(F.col(col).isNotNull()).select(F.col(col).alias("value")).distinct()
    # one row per category: a single-partition rank over it is small
    from pyspark.sql import Window
    return vals.withColumn("index", (F.row_number().over(Window.orderBy("value")) - 1).cast("int"))


def ordinal_code(c: Column | str, vocab: Sequence[str]) -> Column:
    """Position in the ordered vocabulary; -1 for unknown; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    pos = F.array_position(F.array(*[F.lit(v) for v in vocab]), c).cast("int") - 1
    return F.when(c.isNull(), F.lit(None).cast("int")).otherwise(F.when(pos < 0, F.lit(-1)).otherwise(pos))


def ordinal_columns(df: DataFrame) -> DataFrame:
    return df.select("id", *[ordinal_code(c, K.ORDINAL_VOCAB[c]).alias(c) for c in K.ORDINAL_COLUMNS])


def onehot_long(df: DataFrame, vocab: dict[str, Sequence[str]]) -> DataFrame:
    """Sparse long form of the one-hot block: (id, feature, value) for known values."""
    items = []
    for col, cats in vocab.items():
        c = F.col(col)
        items.append(F.when(c.isin(*cats), F.struct(F.concat(F.lit(f"{col}_"), c).alias("feature"),
                                                    F.lit(1.0).alias("value"))))
    return (df.select("id", F.explode(F.array(*items)).alias("_f"))
            .where(F.col("_f").isNotNull()).select("id", "_f.feature", "_f.value"))


def encoder_pipeline(facility_vocab: Sequence[str]) -> Pipeline:
    """Stages: indexers -> one-hot -> ordinals + numerics -> assembled ``features``."""
    stages = []
    cat_cols = list(K.KNOWN_CAT_COLUMNS) + list(K.OPEN_CAT_COLUMNS)
    vocabs = dict(K.KNOWN_CAT_VOCAB)
    vocabs["typefaskes"] = list(facility_vocab)
    for c in cat_cols:
        stages.append(StringIndexerModel.from_labels(vocabs[c], inputCol=c, outputCol=f"{c}__idx",
                                                     handleInvalid="keep"))
    stages.append(OneHotEncoder(inputCols=[f"{c}__idx" for c in cat_cols],
                                outputCols=[f"{c}__oh" for c in cat_cols], dropLast=True))
    ords = ", ".join(
        "CASE WHEN {c} IS NULL THEN CAST(-1 AS DOUBLE) ELSE CAST(coalesce(array_position(array({v}), {c}) - 1, -1) AS DOUBLE) END AS {c}__ord"
        .format(c=c, v=", ".join(f"'{x}'" for x in K.ORDINAL_VOCAB[c])) for c in K.ORDINAL_COLUMNS)
    nums = ", ".join(f"CAST(coalesce(CAST({c} AS DOUBLE), 0.0) AS DOUBLE) AS {c}__num" for c in K.NUMERIC_COLUMNS)
    stages.append(SQLTransformer(statement=f"SELECT *, {ords}, {nums} FROM __THIS__"))
    inputs = ([f"{c}__oh" for c in cat_cols] + [f"{c}__ord" for c in K.ORDINAL_COLUMNS]
              + [f"{c}__num" for c in K.NUMERIC_COLUMNS])
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
    return Pipeline(stages=stages)


def fit_encoder(features: DataFrame, facility_vocab: Sequence[str] | None = None) -> PipelineModel:
    vocab = list(facility_vocab) if facility_vocab is not None else fit_vocab(features)
    return encoder_pipeline(vocab).fit(features)


def encode(model: PipelineModel, features: DataFrame) -> DataFrame:
    """(id, label, features) - the model matrix keyed by claim id."""
    return model.transform(features).select("id", "label", "features")


def feature_names(model: PipelineModel, encoded: DataFrame) -> list[str]:
    """Names of the vector slots, from the assembler's attribute metadata."""
    meta = encoded.schema["features"].metadata.get("ml_attr", {})
    attrs = []
    for group in meta.get("attrs", {}).values():
        attrs.extend(group)
    names = [None] * meta.get("num_attrs", len(attrs))
    for a in attrs:
        names[a["idx"]] = a.get("name", str(a["idx"]))
    return names
