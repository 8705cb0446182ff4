"""Scaling, imputation, encoding and column selection from one-pass statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA, Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.scale import pin_small


def column_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column, from one pass and one row."""
    row = df.agg(
        *[F.avg(F.col(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(F.col(f"`{c}`")).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Zero mean, unit population variance; a constant column becomes 0."""
    stats = column_stats(df, columns)

    def scaled(c: str):
        mean, sd = stats[c]
        centred = F.col(f"`{c}`") - F.lit(mean)
        return (centred / F.lit(sd) if sd else F.when(F.col(f"`{c}`").isNotNull(), F.lit(0.0))).alias(c)

    return df.select(*[scaled(c) if c in stats else F.col(f"`{c}`") for c in df.columns])


def variance_select(df: DataFrame, columns: Sequence[str], threshold: float = 0.5) -> list[str]:
    """Columns whose population variance is strictly above the threshold."""
    row = df.agg(*[F.var_pop(F.col(f"`{c}`")).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[f"v{i}"] is not None and row[f"v{i}"] > threshold]


def impute_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls to the column's mean."""
    model = Imputer(strategy="mean", inputCols=list(columns), outputCols=list(columns)).fit(df)
    return model.transform(df)


def label_table(df: DataFrame, label: str, out: str = "lc") -> DataFrame:
    """Sorted class names with codes from 0; one row per class."""
    names = df.where(F.col(label).isNotNull()).select(label).distinct()
    return names.withColumn(out, F.row_number().over(Window.orderBy(label)) - 1)


def label_encode(df: DataFrame, label: str, out: str = "lc") -> DataFrame:
    table, _ = pin_small(label_table(df, label, out))
    return df.join(table, label, "left")


def label_decode(df: DataFrame, code: str, table: DataFrame) -> DataFrame:
    """Class names next to their codes."""
    small, _ = pin_small(table)
    return df.join(small, code, "left")


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="error").transform(df)


def mixed_table(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], fill: str = "missing") -> DataFrame:
    """Mean-imputed numbers and one-hot categories in one vector."""
    filled = impute_mean(df, numeric).na.fill(fill, subset=list(categorical))
    index = [f"{c}_index" for c in categorical]
    hot = [f"{c}_hot" for c in categorical]
    indexed = (
        StringIndexer(inputCols=list(categorical), outputCols=index, stringOrderType="alphabetAsc", handleInvalid="keep")
        .fit(filled)
        .transform(filled)
    )
    encoded = OneHotEncoder(inputCols=index, outputCols=hot, dropLast=False).fit(indexed).transform(indexed)
    return assemble(encoded, [*numeric, *hot]).drop(*index, *hot)


def pca_project(df: DataFrame, columns: Sequence[str], k: int = 2, out: str = "pc") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    vectors = assemble(df, columns, "_v")
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(vectors)
    parts = vector_to_array("_p")
    return model.transform(vectors).select(*df.columns, *[parts[i].alias(f"{out}{i + 1}") for i in range(k)])


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlation of every column pair; the matrix is columns x columns."""
    matrix = Correlation.corr(assemble(df, columns, "_v").select("_v"), "_v").first()[0].toArray()
    rows = [
        (columns[i], columns[j], float(matrix[i, j]))
        for i in range(len(columns))
        for j in range(i + 1, len(columns))
    ]
    return df.sparkSession.createDataFrame(rows, "a string, b string, corr double")


def collinear_columns(pairs: DataFrame, columns: Sequence[str], threshold: float, greedy: bool = False) -> list[str]:
    """Columns to drop: the later one of each strongly correlated pair.

    ``greedy`` looks again after each drop, so a column is dropped only for a
    partner that is still there.
    """
    strong = pairs.where(F.abs("corr") >= threshold).select("a", "b").collect()
    partners = {(r["a"], r["b"]) for r in strong}
    dropped: list[str] = []
    for j, later in enumerate(columns):
        earlier = [c for c in columns[:j] if (c, later) in partners and not (greedy and c in dropped)]
        if earlier:
            dropped.append(later)
    return dropped
