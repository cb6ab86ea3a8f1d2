"""Feature preparation for the classifiers."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import ElementwiseProduct, Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.columns import count_if
from ledgerline.functions.values import equals_flag

MISSING = "__null__"
FEATURES = "features"


@dataclass(frozen=True)
class Features:
    """Input columns of a model; ``gaps`` are the numeric ones that have missing values."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    scaled: bool = False
    gaps: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return [*self.numeric, *self.categorical]


def encode_inputs(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                  sex: str = "Sexo", male: str = "Masculino", flags: dict[str, dict[str, str]] | None = None):
    """0/1 forms of the text columns among the numeric features, with the new feature list.

    ``flags`` maps a two-valued column to {new column: value}; the column leaves the list.
    """
    flags = FLAGS if flags is None else flags
    numeric = list(numeric)
    if sex in numeric:
        df = df.withColumn(sex, equals_flag(sex, male))
    for source, outputs in flags.items():
        if source in numeric:
            df = df.withColumns({n: equals_flag(source, v) for n, v in outputs.items()})
            numeric.remove(source)
            numeric += list(outputs)
    return df, numeric, list(categorical)


# Two-valued text columns and the flags they become.
FLAGS = {
    "IAE_PREVIO_CORREGIDO": {"IAE_PREVIO_SI": "SI", "IAE_PREVIO_NO": "NO"},
    "RUCAF_cobertura": {"RUCAF_cobertura_fonasa": "Fonasa", "RUCAF_cobertura_no_fonasa": "No Fonasa"},
}


def missing(c: str) -> Column:
    """Whether a numeric cell is null or NaN."""
    return F.col(c).isNull() | F.isnan(F.col(c).cast("double"))


def plan_features(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], scaled: bool) -> Features:
    """Note which numeric columns have gaps; one aggregate."""
    counts = df.agg(*[count_if(missing(c)).alias(c) for c in numeric]).first() \
        if numeric else {}
    gaps = () if scaled else tuple(c for c in numeric if counts[c])
    return Features(tuple(numeric), tuple(categorical), scaled, gaps)


def most_frequent_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing categories become the column's most frequent value, the smallest on ties."""
    cells = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])))
    counted = cells.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))
    return df.fillna({r["column"]: r["value"] for r in best.collect()}, subset=list(columns))


def model_inputs(df: DataFrame, spec: Features) -> DataFrame:
    """Numbers as doubles, a flag per column with gaps, and missing categories as their own value."""
    new: dict[str, Column] = {c: F.col(c).cast("double") for c in spec.numeric}
    new |= {f"{c}_missing": missing(c).cast("double") for c in spec.gaps}
    new |= {c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in spec.categorical}
    return df.withColumns(new)


def fit_features(df: DataFrame, spec: Features) -> PipelineModel:
    """Fit the preparation on the training rows.

    Numbers are mean-imputed, and standardised for linear models. Categories become
    one slot each; one that was not seen in training has no slot and gives zeros.
    """
    stages = []
    inputs = []
    if spec.numeric:
        filled = [f"__i_{c}" for c in spec.numeric]
        stages.append(Imputer(inputCols=list(spec.numeric), outputCols=filled, strategy="mean"))
        stages.append(VectorAssembler(inputCols=filled, outputCol="__num"))
        if spec.scaled:
            n = df.count()  # the scaler divides by the sample deviation; the population one is wanted
            stages.append(StandardScaler(inputCol="__num", outputCol="__scaled_by_sample", withMean=True, withStd=True))
            stages.append(ElementwiseProduct(scalingVec=Vectors.dense([math.sqrt(n / max(n - 1, 1))] * len(filled)),
                                             inputCol="__scaled_by_sample", outputCol="__scaled"))
        inputs.append("__scaled" if spec.scaled else "__num")
        inputs += [f"{c}_missing" for c in spec.gaps]
    if spec.categorical:
        indexed = [f"__x_{c}" for c in spec.categorical]
        slots = [f"__o_{c}" for c in spec.categorical]
        stages.append(StringIndexer(inputCols=list(spec.categorical), outputCols=indexed, handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
        # The last slot is the one for unseen categories, and it is dropped.
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=slots, dropLast=True))
        inputs += slots
    stages.append(VectorAssembler(inputCols=inputs, outputCol=FEATURES))
    return Pipeline(stages=stages).fit(df)


def apply_features(model: PipelineModel, df: DataFrame) -> DataFrame:
    rows = model.transform(df)
    return rows.drop(*[c for c in rows.columns if c.startswith(("__i_", "__x_", "__o_", "__num", "__scaled"))])


def feature_names(model: PipelineModel, spec: Features) -> list[str]:
    """Names of the slots of the feature vector, in order."""
    found = [f"num__{c}" for c in spec.numeric] + [f"num__{c}_missing" for c in spec.gaps]
    if spec.categorical:
        indexer = next(s for s in model.stages if s.__class__.__name__ == "StringIndexerModel")
        for column, values in zip(spec.categorical, indexer.labelsArray):
            found += [f"cat__{column}_{v}" for v in values]
    return found
