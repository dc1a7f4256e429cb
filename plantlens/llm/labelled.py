"""Bounded samples of texts for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def order_key(column: str, seed: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col(column))


def sample_ids(rows: DataFrame, key: str, most: int, seed: str) -> list[int]:
    """At most ``most`` distinct keys, the first by hash: the same ones however the table is partitioned."""
    ids = rows.select(F.col(key).cast("long").alias("k")).where("k is not null").distinct()
    return [r["k"] for r in ids.orderBy(order_key("k", seed), "k").limit(most).collect()]


def texts_of(docs: DataFrame, ids: list[int], most_chars: int, id_column: str, text_column: str) -> dict[int, str]:
    """Texts of the sampled keys. ``ids`` is a bounded list; of repeated keys the least text counts.

    Texts of more than ``most_chars`` characters are not used for fitting (they are scored like all others).
    """
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("k", T.LongType())])
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in ids], schema))
    rows = docs.select(F.col(id_column).cast("long").alias("k"), F.coalesce(F.col(text_column), F.lit("")).alias("t")).where(F.length("t") <= most_chars)
    found = rows.join(wanted, "k").groupBy("k").agg(F.min("t").alias("t")).toArrow()
    return dict(zip(found.column("k").to_pylist(), found.column("t").to_pylist(), strict=True))


def label_of(labels: DataFrame, id_column: str, label_column: str) -> DataFrame:
    """One row per labelled key: ``k``, ``label`` (the greatest of repeated ones); NULL keys and labels drop out."""
    rows = labels.select(F.col(id_column).cast("long").alias("k"), F.col(label_column).cast("int").alias("label"))
    return rows.where("k is not null and label is not null").groupBy("k").agg(F.max("label").alias("label"))
