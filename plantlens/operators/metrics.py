"""Model evaluation from prediction columns; every figure is one map-side combined aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def r2_from(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """R² and MAE per group.

    The total sum of squares comes from the variance, which Spark merges without
    cancellation, so one pass is enough.
    """
    actual, predicted = F.col(y).cast("double"), F.col(p).cast("double")
    residual = actual - predicted
    sums = df.groupBy(*by).agg(
        F.sum(residual * residual).alias("sse"),
        (F.var_pop(actual) * F.count(actual)).alias("sst"),
        F.avg(F.abs(residual)).alias("mae"),
        F.count("*").alias("n"),
    )
    r2 = F.when(F.col("sst") > 0, 1.0 - F.col("sse") / F.col("sst")).otherwise(
        F.when(F.col("sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    )
    return sums.select(*by, r2.alias("r2"), "mae", "n")


def accuracy_from(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose prediction is the label; a missing label or prediction is a miss."""
    hit = F.coalesce((F.col(y) == F.col(p)).cast("double"), F.lit(0.0))
    return df.groupBy(*by).agg(F.avg(hit).alias("accuracy"), F.count("*").alias("n"))


def confusion_counts(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("label"), F.col(p).alias("predicted")).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, y: str, p: str, labels: Sequence[str] | None = None) -> DataFrame:
    """One row per true label, one column per predicted label, absent pairs 0, labels sorted.

    Without ``labels`` the matrix has every label that is true or predicted somewhere; rows with a missing label or prediction
    are in no cell. Given ``labels`` restrict it.
    """
    counts = confusion_counts(df, y, p).where("label is not null and predicted is not null")
    if labels is None:
        found = counts.select(F.explode(F.array(F.col("label").cast("string"), F.col("predicted").cast("string"))).alias("name")).distinct()
        labels = [r["name"] for r in found.collect()]
    names = sorted(labels)
    cells = {c: F.sum(F.when(F.col("predicted").cast("string") == c, F.col("n"))) for c in names}
    pivoted = counts.groupBy(F.col("label").cast("string").alias("true__")).agg(*[cells[c].alias(f"c{i}__") for i, c in enumerate(names)])
    domain = df.sparkSession.createDataFrame([(c,) for c in names], "label string")
    full = domain.join(pivoted, F.col("label") == F.col("true__"), "left")
    return full.select("label", *[F.coalesce(f"c{i}__", F.lit(0)).cast("bigint").alias(c) for i, c in enumerate(names)]).orderBy("label")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def class_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then macro and weighted averages.

    Everything after the (label, predicted) counts works on that small matrix.
    """
    cells = confusion_counts(df, y, p)
    per_side = cells.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("label").alias("name"),
                    F.col("n").alias("actual"),
                    F.lit(0).cast("bigint").alias("guessed"),
                    F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("hits"),
                ),
                F.struct(
                    F.col("predicted").alias("name"),
                    F.lit(0).cast("bigint").alias("actual"),
                    F.col("n").alias("guessed"),
                    F.lit(0).cast("bigint").alias("hits"),
                ),
            )
        )
    )
    sums = per_side.groupBy("name").agg(
        F.sum("actual").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hits").alias("hits")
    )
    precision = _ratio(F.col("hits"), F.col("guessed"))
    recall = _ratio(F.col("hits"), F.col("support"))
    classes = sums.select("name", precision.alias("precision"), recall.alias("recall"), "support").withColumn(
        "f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )
    figures = ["precision", "recall", "f1"]
    total = F.sum("support")
    averages = classes.agg(
        *[F.avg(c).alias(f"macro_{c}") for c in figures],
        *[_ratio(F.sum(F.col(c) * F.col("support")), total).alias(f"weighted_{c}") for c in figures],
        total.alias("support"),
    ).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(f"{kind} avg").alias("name"), *[F.col(f"{kind}_{c}").alias(c) for c in figures], "support")
                    for kind in ("macro", "weighted")
                ]
            )
        )
    )
    return classes.select("name", *figures, "support").unionByName(averages).withColumnRenamed("name", "label")


def fit_gap(train: DataFrame, test: DataFrame, name: str) -> DataFrame:
    """A figure on both splits side by side and their difference (over-fit gap)."""
    both = train.select(F.lit("train").alias("split"), F.col(name).alias("value")).unionByName(
        test.select(F.lit("test").alias("split"), F.col(name).alias("value"))
    )
    of = {s: F.max(F.when(F.col("split") == s, F.col("value"))) for s in ("train", "test")}
    return both.agg(of["train"].alias("train"), of["test"].alias("test")).withColumn("gap", F.col("train") - F.col("test"))


def scoreboard(spark, rows: Sequence[tuple[str, float | None, str, str | None]]) -> DataFrame:
    """Ranked candidates; failed ones stay with a score of 0 (negative scores show as 0 too)."""
    df = spark.createDataFrame(rows, "candidate string, cv_score double, status string, error string")
    shown = F.greatest(F.coalesce("cv_score", F.lit(0.0)), F.lit(0.0))
    return df.withColumn("shown_score", shown).orderBy(F.desc_nulls_last("cv_score"), "candidate")
