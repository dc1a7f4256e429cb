"""Registered queries on rows that ordinary tables lack: missing and NaN values, other labels, clashing names, small blocks and slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.analysis import SUPPLY_SQL, _crowding_sql, _dominated, _open_ends, _supply
from checks.base import query, r4, s4, table
from checks.tables import _box, _box_sql, _split_sql
from plantlens.functions import scalar
from plantlens.operators import clean, metrics, profile, quantiles, skyline, splits
from plantlens.plans.importance import shuffled_features

STATUS_SQL = """(SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderstatus END AS y,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 10 = 0 THEN 'X' WHEN o_orderkey % 3 = 0 THEN 'F' ELSE o_orderstatus END AS p FROM orders)"""


def _status(spark, sf):
    key = F.col("o_orderkey")
    guess = F.when(key % 13 != 0, F.when(key % 10 == 0, "X").when(key % 3 == 0, "F").otherwise(F.col("o_orderstatus")))
    return table(spark, sf, "orders").select("o_orderkey", F.when(key % 17 != 0, F.col("o_orderstatus")).alias("y"), guess.alias("p"))


@query(
    f"""WITH g AS (SELECT y, p FROM {STATUS_SQL} WHERE y IS NOT NULL AND p IS NOT NULL), l AS (SELECT y AS label FROM g UNION SELECT p FROM g)
    SELECT label, {', '.join(f"count(*) FILTER (y = label AND p = '{c}') AS " + f'"{c}"' for c in "FOPX")} FROM l LEFT JOIN g ON y = label GROUP BY 1"""
)
def confusion_other_labels(spark, sf):
    """Labels outside the three classes, one of them only predicted, and missing ones."""
    return metrics.confusion_matrix(_status(spark, sf), "y", "p")


@query(f"SELECT {s4('avg(coalesce((y = p)::INT, 0))', 6)} AS accuracy, count(*) AS n FROM {STATUS_SQL}")
def accuracy_missing(spark, sf):
    return metrics.accuracy_from(_status(spark, sf), "y", "p").select(r4("accuracy", "accuracy", 6), "n")


def _nan_events(spark, sf):
    """Errors have NaN values, sign-ups none at all."""
    value = F.when(F.col("event_type") == "error", F.lit(float("nan"))).when(F.col("event_type") != "signup", F.col("value"))
    return table(spark, sf, "events").select("event_id", F.col("event_type").alias("value"), value.alias("reading"), (F.col("event_id") % 7).alias("column_"))


NAN_SQL = "(SELECT event_id, event_type AS value, CASE WHEN event_type NOT IN ('error', 'signup') THEN value END AS reading FROM events)"


@query(
    f"""WITH e AS (SELECT * FROM {NAN_SQL}), m AS (SELECT median(reading) AS mid, var_pop(reading) AS var FROM e)
    SELECT event_id, {s4('coalesce(reading, mid)')} AS reading, {s4('var')} AS var FROM e, m"""
)
def nan_impute(spark, sf):
    df = _nan_events(spark, sf)
    var = clean.population_variances(df, ["reading"])["reading"]
    filled = clean.impute(df, clean.medians(df, ["reading"]))
    return filled.select("event_id", scalar.fixed(F.col("reading")).alias("reading"), scalar.fixed(F.lit(var)).alias("var"))


@query(f"SELECT * RENAME (grp AS value) FROM (WITH e AS (SELECT value AS grp, reading FROM {NAN_SQL} WHERE reading IS NOT NULL), {_box_sql('e', ['reading'], 'grp')})")
def box_stats_by_value(spark, sf):
    """NaN values, and a group column called ``value``."""
    return _box(profile.box_stats(_nan_events(spark, sf), ["reading"], ["value"]), ["value"])


@query(
    f"""WITH f AS ({_crowding_sql(f"(SELECT * FROM {SUPPLY_SQL} WHERE k % 5 <> 0)", 'k', ['c1', 'c2', 'c3'])})
    SELECT p.k, CASE WHEN p.k % 5 = 0 THEN 0.0::DOUBLE ELSE crowding END AS crowding, coalesce(is_boundary, false) AS is_boundary
    FROM {SUPPLY_SQL} p LEFT JOIN f USING (k)"""
)
def crowding_missing(spark, sf):
    """Every fifth supplier has a NaN or NULL cost: no distance, and no part in those of the others."""
    gap = F.when(F.col("k") % 10 == 0, F.lit(float("nan"))).when(F.col("k") % 5 != 0, F.col("c2"))
    spread = skyline.crowding_distance(_supply(spark, sf).withColumn("c2", gap), ["c1", "c2", "c3"], "k")
    return spread.select("k", *_open_ends("crowding"))


@query(_crowding_sql("(SELECT o_orderkey, o_totalprice, length(o_orderpriority)::DOUBLE AS urgency FROM orders)", "o_orderkey", ["o_totalprice", "urgency"]))
def crowding_slices(spark, sf):
    """Crowding with value lists cut into slices of 2,000."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.length("o_orderpriority").cast("double").alias("urgency"))
    spread = skyline.crowding_distance(orders, ["o_totalprice", "urgency"], "o_orderkey", window_rows=2000)
    return spread.select("o_orderkey", *_open_ends("crowding"))


ANTI_SQL = "(SELECT p_partkey AS k, p_retailprice AS a, -p_retailprice + p_size AS b FROM part)"


@query(f"WITH p AS (SELECT * FROM {ANTI_SQL}) SELECT k FROM p x WHERE NOT EXISTS (SELECT 1 FROM p y WHERE {_dominated('x', 'y', ['a', 'b'])})")
def skyline_blocks(spark, sf):
    """Opposed costs, so that many rows survive, checked block against block (blocks of 50)."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("a"), (F.col("p_size") - F.col("p_retailprice")).alias("b"))
    return skyline.skyline(part, ["a", "b"], block_rows=50).select("k")


@query(
    f"""WITH RECURSIVE p AS (SELECT * FROM {SUPPLY_SQL}),
    e AS (SELECT b.k AS src, a.k AS dst FROM p a JOIN p b ON {_dominated('a', 'b', ['c1', 'c2', 'c3'])}),
    r(k, level) AS (SELECT k, 0 FROM p UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON r.k = e.src)
    SELECT k, max(level) AS front FROM r GROUP BY 1"""
)
def front_ranks_peeled(spark, sf):
    """Fronts peeled one by one (blocks of 20)."""
    return skyline.front_ranks(_supply(spark, sf), ["c1", "c2", "c3"], block_rows=20).select("k", "front")


@query(
    f"""WITH q AS (SELECT {', '.join(f"quantile_cont(l_extendedprice, {i / 20}::DOUBLE) AS q{i}" for i in range(21))} FROM lineitem)
    SELECT {', '.join(f"{s4(f'q{i}')} AS q{i}" for i in range(21))} FROM q"""
)
def quantiles_narrow_passes(spark, sf):
    """Twenty-one quantiles by counting passes that go on until a range holds 100 rows."""
    found = quantiles.quantile_values(table(spark, sf, "lineitem"), ["l_extendedprice"], [i / 20 for i in range(21)], exact_rows=100)["l_extendedprice"]
    row = spark.createDataFrame([tuple(found)], ", ".join(f"q{i} double" for i in range(21)))
    return row.select(*[r4(f"q{i}", f"q{i}") for i in range(21)])


@query(f"WITH g AS (SELECT o_orderkey, o_orderpriority AS value FROM orders) SELECT o_orderkey, floor((i - 1) * 5 / n)::INT AS fold FROM {_split_sql('value')}")
def folds_by_text(spark, sf):
    """Folds within a text column; the key's hash decides, whatever the partitioning."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("stratum")).repartition(13)
    return splits.assign_folds(orders, "o_orderkey", by=["stratum"]).select("o_orderkey", "fold")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE ('0x' || substr(md5('42-' || o_orderkey::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE < 0.25::DOUBLE")
def scatter_thinned(spark, sf):
    return profile.scatter_sample(table(spark, sf, "orders"), ["o_totalprice"], "o_orderkey", 0.25)


@query("SELECT l_orderkey, l_linenumber, l_partkey, greatest(l_quantity / 1000.0::DOUBLE - 0.02::DOUBLE, 0.01::DOUBLE) AS floored FROM lineitem")
def floor_below(spark, sf):
    """Values on both sides of the floor of 0.01."""
    x = F.col("l_quantity") / F.lit(1000.0) - F.lit(0.02)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", scalar.floor_prediction(x).alias("floored"))


SHUFFLE_HASH = "('0x' || substr(md5('42-0-' || o_orderkey::VARCHAR), 1, 13))::BIGINT"


@query(
    f"""SELECT o_orderkey, coalesce(lead(o_totalprice) OVER (ORDER BY {SHUFFLE_HASH}, o_orderkey), first_value(o_totalprice) OVER (ORDER BY {SHUFFLE_HASH}, o_orderkey)
    ) AS last_or_next FROM orders"""
)
def permuted_prices(spark, sf):
    """The permutation behind importances: each row takes the price of the next one in hash order, over 15 buckets."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    moved = shuffled_features(orders, ["o_totalprice"], "o_orderkey", repeats=1, bucket_rows=1000)
    return moved.select("o_orderkey", F.col("o_totalprice").alias("last_or_next"))
