"""Registered queries: reading, cleaning, features, labels, profiles, metrics, splits."""

from __future__ import annotations

from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import (
    SQL_GAPPY_EVENTS,
    energy_sql,
    gappy_events,
    order_sensors,
    query,
    r4,
    s4,
    sql_order_sensors,
    table,
)
from plantlens.functions import features as feat
from plantlens.functions import scalar
from plantlens.operators import clean, metrics, profile, splits
from plantlens.operators.scoring import RAW_DEFAULTS, complete_points
from plantlens.session import scratch_path
from plantlens.sources.tables import load_dataset, load_json, save_json

SENSORS = sql_order_sensors()
LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def quartile_sql(source: str, columns: list[str], probs: list[float], by: str = "") -> str:
    """Long (column, q1..) rows per group."""
    group = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    parts = []
    for c in columns:
        qs = ", ".join(f"quantile_cont({c}::DOUBLE, {p}) AS q{i}" for i, p in enumerate(probs))
        parts.append(f"SELECT {group}'{c}' AS feature, {qs}, count({c}) AS n FROM {source}{tail}")
    return " UNION ALL ".join(parts)


# ---------------------------------------------------------------- sources and sinks


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer")
    path = scratch_path(spark, "customers") + ".csv"
    customer.write.option("header", True).csv(path)
    return load_dataset(spark, path, customer.schema)


@query(f"SELECT count(*) AS n_rows, {s4('avg(l_extendedprice)')} AS mean_price, max(l_quantity) AS max_quantity FROM lineitem")
def json_report(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "lineitem").agg(
        F.count("*").alias("n_rows"), r4(F.avg("l_extendedprice"), "mean_price"), F.max("l_quantity").alias("max_quantity")
    )
    path = scratch_path(spark, "report")
    save_json(spark, path, found.first().asDict())
    return load_json(spark, path)


# ---------------------------------------------------------------- cleaning


@query(
    f"""SELECT event_id, {s4('reading')} AS reading, {s4('level')} AS level, unit,
        (reading IS NULL)::INT AS reading_was_missing, (level IS NULL)::INT AS level_was_missing
        FROM {SQL_GAPPY_EVENTS}"""
)
def missing_indicators(spark, sf):
    flagged = feat.add_missing_indicators(gappy_events(spark, sf).drop("event_type"), exclude=("event_id",))
    return flagged.withColumns({c: scalar.fixed(F.col(c)) for c in ("reading", "level")})


EVENT_FENCES = """q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
    f AS (SELECT q1 - 1.5::DOUBLE*(q3-q1) AS lo, q3 + 1.5::DOUBLE*(q3-q1) AS hi FROM q)"""


def _spiky(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", "value", (F.col("event_type") == "error").cast("double").alias("is_error"))


@query(
    f"""WITH {EVENT_FENCES}
    SELECT 'value' AS "column", count(*) FILTER (value < lo OR value > hi) AS n_capped,
      {s4('min(lo)', 6)} AS lower_fence, {s4('min(hi)', 6)} AS upper_fence FROM events, f"""
)
def winsorise_report(spark, sf):
    df = _spiky(spark, sf)
    report = clean.Fences.fit(df, "event_id").report(df, digits=6)
    return report.withColumns({c: scalar.fixed(F.col(c), 6) for c in ("lower_fence", "upper_fence")})


@query(
    f"""WITH {EVENT_FENCES}
    SELECT event_id, {s4('CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END')} AS value,
      (event_type = 'error')::INT::DOUBLE AS is_error FROM events, f"""
)
def winsorise_table(spark, sf):
    df = _spiky(spark, sf)
    capped, _ = clean.winsorise(df, "event_id")
    return capped.select("event_id", r4("value", "value"), "is_error")


def _gap_stats(name: str) -> str:
    return f"""WITH e AS (SELECT * FROM {SQL_GAPPY_EVENTS}),
    m AS (SELECT median(reading) AS mr, median(level) AS ml, median(unit) AS mu FROM e),
    c AS (SELECT event_id, event_type, coalesce(reading, mr) AS reading, coalesce(level, ml) AS level,
          coalesce(unit, mu) AS unit FROM e, m) {name}"""


@query(_gap_stats(f"SELECT event_id, event_type, {s4('reading')} AS reading, {s4('level')} AS level, unit FROM c"))
def median_impute(spark, sf):
    df = gappy_events(spark, sf)
    filled = clean.impute(df, clean.medians(df, ["reading", "level", "unit"]))
    return filled.withColumns({c: scalar.fixed(F.col(c)) for c in ("reading", "level")})


def _scaled_sql(c: str) -> str:
    return s4(f"({c} - m_{c}) / CASE WHEN h_{c} = l_{c} THEN 1.0::DOUBLE ELSE h_{c} - l_{c} END") + f" AS {c}"


@query(
    _gap_stats(
        ", s AS (SELECT "
        + ", ".join(
            f"quantile_cont({c}, 0.25) AS l_{c}, median({c}) AS m_{c}, quantile_cont({c}, 0.75) AS h_{c}"
            for c in ("reading", "level", "unit")
        )
        + ") SELECT "
        + ", ".join(_scaled_sql(c) for c in ("reading", "level", "unit"))
        + " FROM c, s"
    ).replace(") SELECT floor", " FROM c) SELECT floor", 1)
)
def batch_clean_scaled(spark, sf):
    _, scaled = clean.clean_batch(gappy_events(spark, sf).drop("event_id"))
    return scaled.select(*[r4(c, c) for c in ("reading", "level", "unit")])


@query(
    _gap_stats(
        f"""SELECT column_name, {s4('v', 3)} AS variance FROM (
        SELECT 'reading' AS column_name, var_pop(reading) AS v FROM c UNION ALL
        SELECT 'level', var_pop(level) FROM c UNION ALL SELECT 'unit', var_pop(unit) FROM c) WHERE v > 0.01"""
    )
)
def variance_filter(spark, sf):
    df = gappy_events(spark, sf)
    columns = ["reading", "level", "unit"]
    filled = clean.impute(df, clean.medians(df, columns)).withColumn("flat", F.lit(1.0))
    kept = clean.varying_columns(filled, [*columns, "flat"])
    found = filled.agg(*[F.var_pop(c).alias(c) for c in kept])
    return found.unpivot([], kept, "column_name", "v").select("column_name", r4("v", "variance", 3))


# ---------------------------------------------------------------- features and scalar columns


@query(
    f"""SELECT row_id, {s4('production_load * production_load')} AS load_squared,
    {s4('machine_temperature - (SELECT avg(machine_temperature) FROM s)')} AS temperature_deviation,
    {s4('axis_speed / (production_load + 1e-6::DOUBLE)')} AS speed_per_load,
    {s4('production_load * machine_temperature')} AS thermal_load,
    {s4('vibration_signal * axis_speed')} AS mechanical_stress,
    {s4('tool_wear * vibration_level')} AS wear_index,
    {s4('production_load * axis_speed * power_factor')} AS effective_power FROM s""".join(
        [f"WITH s AS (SELECT * FROM {SENSORS}) ", ""]
    )
)
def derived_features(spark, sf):
    df = order_sensors(spark, sf)
    new = [c for c in feat.add_features(df, 0.0).columns if c not in df.columns]
    return feat.add_features(df).select("row_id", *[r4(c, c) for c in new])


@query(
    f"""SELECT row_id, {s4(energy_sql())} AS energy, {s4('10.0::DOUBLE * ' + energy_sql())} AS cost,
    {s4('0.85::DOUBLE * ' + energy_sql())} AS co2, {s4('(cycle_time - 20.0::DOUBLE) / 60.0::DOUBLE')} AS cycle_unit,
    {s4('greatest(least(machine_temperature, 70.0::DOUBLE), 40.0::DOUBLE)')} AS temp_clipped FROM {SENSORS}"""
)
def cost_co2(spark, sf):
    points = order_sensors(spark, sf).select("row_id", "production_load", "cycle_time", "machine_temperature", "axis_speed")
    full = complete_points(points, RAW_DEFAULTS["energy"], temp_mean=0.0)
    kwh = scalar.floor_prediction(feat.energy_signal())
    return full.select(
        "row_id",
        r4(kwh, "energy"),
        r4(scalar.energy_cost(kwh), "cost"),
        r4(scalar.grid_emission(kwh), "co2"),
        r4(scalar.scale_to_unit(F.col("cycle_time"), 20.0, 80.0), "cycle_unit"),
        r4(scalar.clip(F.col("machine_temperature"), F.lit(40.0), F.lit(70.0)), "temp_clipped"),
    )


@query(
    f"""WITH s AS (SELECT * FROM {SENSORS})
    SELECT row_id, {s4('production_load')} AS production_load, {s4('oil_quality')} AS oil_quality,
    0.8::DOUBLE AS tool_wear, {s4('vibration_level')} AS vibration_level, 100.0::DOUBLE AS pressure,
    {s4('0.8::DOUBLE * vibration_level')} AS wear_index, 0.0::DOUBLE AS never_seen FROM s"""
)
def defaults_overrides(spark, sf):
    points = order_sensors(spark, sf).drop("tool_wear", "pressure", "vibration_signal")
    order = ["production_load", "oil_quality", "tool_wear", "vibration_level", "pressure", "wear_index", "never_seen"]
    full = complete_points(points, RAW_DEFAULTS["maintenance"], {"tool_wear": 0.8}, order, temp_mean=0.0, keep=["row_id"])
    return full.select("row_id", *[r4(c, c) for c in order])


@query(
    f"""WITH s AS (SELECT * FROM {SENSORS}), m AS (SELECT avg(tool_wear) AS w, avg(vibration_level) AS v,
      avg(machine_temperature) AS t FROM s)
    SELECT row_id, {s4('w')} AS tool_wear, {s4('v')} AS vibration_level, {s4('w * v')} AS wear_index,
      {s4('machine_temperature - t')} AS temperature_deviation FROM s, m"""
)
def mean_defaults(spark, sf):
    readings = order_sensors(spark, sf)
    means = profile.column_means(readings, ["tool_wear", "vibration_level", "machine_temperature"])
    temp_mean = means.pop("machine_temperature")
    points = readings.select("row_id", "production_load", "machine_temperature", "axis_speed")
    full = complete_points(points, means, temp_mean=temp_mean)
    return full.select("row_id", *[r4(c, c) for c in ("tool_wear", "vibration_level", "wear_index", "temperature_deviation")])


def _level(spark, sf):
    o = table(spark, sf, "orders")
    label = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "High")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "Medium")
        .when(F.col("o_orderpriority") == "5-LOW", "Low")
        .when(F.col("o_orderpriority") == "2-HIGH", "7.5")
        .otherwise("other")
    )
    return o.select("o_orderkey", "o_orderpriority", label.alias("label"))


SQL_LEVEL = """(SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium'
    WHEN '5-LOW' THEN 'Low' WHEN '2-HIGH' THEN '7.5' ELSE 'other' END AS label FROM orders)"""


@query(
    f"""SELECT o_orderkey, code, CASE code WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' END AS decoded,
      CASE WHEN code >= 0 THEN code::DOUBLE ELSE coalesce(try_cast(label AS DOUBLE), 0.0::DOUBLE) END AS score,
      CASE WHEN code >= 0 THEN code::DOUBLE ELSE try_cast(label AS DOUBLE) END AS number FROM
    (SELECT *, CASE label WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 ELSE -1 END AS code FROM {SQL_LEVEL})"""
)
def ordinal_encode(spark, sf):
    label = F.col("label")
    return _level(spark, sf).select(
        "o_orderkey",
        scalar.encode_ordinal(label).alias("code"),
        scalar.decode_ordinal(scalar.encode_ordinal(label)).alias("decoded"),
        scalar.label_score(label).alias("score"),
        scalar.label_score(label, unknown="number").alias("number"),
    )


@query(
    """SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::DOUBLE AS code,
      o_orderpriority AS decoded FROM orders"""
)
def alphabetic_encode(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    indexer = StringIndexer(inputCol="o_orderpriority", outputCol="code", stringOrderType="alphabetAsc").fit(df)
    back = IndexToString(inputCol="code", outputCol="decoded", labels=indexer.labels)
    return back.transform(indexer.transform(df)).select("o_orderkey", "code", "decoded")


SIGNALS_SQL = {
    "energy": energy_sql(wear="tool_wear", vibration="vibration_level", power="power_factor"),
    "efficiency": """(2.5::DOUBLE*power_factor + 0.7::DOUBLE*axis_speed - 0.04::DOUBLE*cycle_time - 0.05::DOUBLE*machine_temperature
       - 0.28::DOUBLE*vibration_signal + 0.9::DOUBLE*production_load - 0.6::DOUBLE*vibration_signal*(1.0::DOUBLE-power_factor))""",
    "emission": """(15.0::DOUBLE*production_load + 0.04::DOUBLE*machine_temperature + 0.4::DOUBLE*axis_speed + 0.025::DOUBLE*cycle_time
       - 1.2::DOUBLE*power_factor + 5.0::DOUBLE*production_load*(machine_temperature/120.0::DOUBLE))""",
    "maintenance": """(0.7::DOUBLE*vibration_level + 0.04::DOUBLE*machine_temperature + 1.2::DOUBLE*tool_wear - 1.0::DOUBLE*oil_quality
       + 0.015::DOUBLE*pressure + 0.3::DOUBLE*production_load + 1.5::DOUBLE*tool_wear*vibration_level
       - 0.8::DOUBLE*oil_quality*(1.0::DOUBLE-tool_wear))""",
}


@query("SELECT row_id, " + ", ".join(f"{s4(v)} AS {k}" for k, v in SIGNALS_SQL.items()) + f" FROM {SENSORS}")
def composite_signals(spark, sf):
    return order_sensors(spark, sf).select(
        "row_id",
        r4(feat.energy_signal(), "energy"),
        r4(feat.efficiency_signal(), "efficiency"),
        r4(feat.emission_signal(), "emission"),
        r4(feat.maintenance_signal(), "maintenance"),
    )


# ---------------------------------------------------------------- labels and profiles

TERCILES = """t AS (SELECT quantile_cont(l_extendedprice, 0.33) AS q33, quantile_cont(l_extendedprice, 0.67) AS q67 FROM lineitem),
    l AS (SELECT lineitem.*, CASE WHEN l_extendedprice < q33 THEN 'Low' WHEN l_extendedprice < q67 THEN 'Medium' ELSE 'High' END AS label
          FROM lineitem, t)"""


def _labelled(spark, sf):
    li = table(spark, sf, "lineitem")
    cuts = clean.percentile_cuts(li, "l_extendedprice")
    return li.withColumn("label", clean.percentile_label("l_extendedprice", cuts))


@query(
    f"""WITH {TERCILES} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, label FROM l"""
)
def tercile_label(spark, sf):
    return _labelled(spark, sf).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "label")


def _box_sql(source: str, columns: list[str], by: str) -> str:
    g = f"{by}, " if by else ""
    join = f"USING ({by}, feature)" if by else "USING (feature)"
    melted = " UNION ALL ".join(f"SELECT {g}'{c}' AS feature, {c}::DOUBLE AS value FROM {source}" for c in columns)
    return f"""m AS (SELECT * FROM ({melted}) WHERE value IS NOT NULL),
    b AS (SELECT {g}feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3
          FROM m GROUP BY {g}feature),
    f AS (SELECT *, q1 - 1.5::DOUBLE*(q3-q1) AS lo, q3 + 1.5::DOUBLE*(q3-q1) AS hi FROM b)
    SELECT {g}feature, {s4('min(q1)')} AS q1, {s4('min(med)')} AS median, {s4('min(q3)')} AS q3,
      min(value) FILTER (value BETWEEN lo AND hi) AS whisker_low, max(value) FILTER (value BETWEEN lo AND hi) AS whisker_high,
      count(*) FILTER (value < lo OR value > hi) AS n_outliers, count(*) AS n
    FROM m JOIN f {join} GROUP BY {g}feature"""


def _box(df: DataFrame, by: list[str]) -> DataFrame:
    return df.select(
        *by, "feature", r4("q1", "q1"), r4("median", "median"), r4("q3", "q3"), "whisker_low", "whisker_high", "n_outliers", "n"
    )


@query(f"WITH {TERCILES}, {_box_sql('l', LINE_COLUMNS, 'label')}")
def labelled_box_stats(spark, sf):
    """Flagship: label by price terciles, winsorise-ready box statistics per label."""
    return _box(profile.box_stats(_labelled(spark, sf), LINE_COLUMNS, ["label"]), ["label"])


@query(f"WITH e AS (SELECT event_type, value, user_id FROM events), {_box_sql('e', ['value', 'user_id'], 'event_type')}")
def event_box_stats(spark, sf):
    return _box(profile.box_stats(table(spark, sf, "events"), ["value", "user_id"], ["event_type"]), ["event_type"])


@query(
    """WITH f AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
    SELECT event_type, event_id, 'value' AS feature, value FROM events JOIN f USING (event_type)
    WHERE value < q1 - 1.5::DOUBLE*(q3-q1) OR value > q3 + 1.5::DOUBLE*(q3-q1)"""
)
def event_box_outliers(spark, sf):
    return profile.box_outliers(table(spark, sf, "events"), ["value"], ["event_type"], ["event_id"])


@query("SELECT count(*) AS n_rows, 10 AS n_features FROM lineitem")
def table_shape(spark, sf):
    return profile.table_shape(table(spark, sf, "lineitem"), "l_extendedprice").withColumn(
        "n_features", F.col("n_features").cast("int")
    )


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def value_counts(spark, sf):
    orders = table(spark, sf, "orders")
    if not profile.is_categorical(orders, "o_orderpriority"):
        raise AssertionError("a text target is shown by its counts")
    return profile.value_counts(orders, "o_orderpriority")


@query(
    f"""SELECT label, n FROM (VALUES ('Low'), ('Medium'), ('High'), ('Extreme')) d(label)
    LEFT JOIN (SELECT label, count(*) AS n FROM {SQL_LEVEL} GROUP BY 1) USING (label)"""
)
def class_counts_domain(spark, sf):
    return profile.class_counts(_level(spark, sf), "label", ["Low", "Medium", "High", "Extreme"]).select("label", "n")


def _hist_sql(source: str, column: str, bins: int) -> str:
    return f"""WITH r AS (SELECT min({column}) AS lo, max({column}) AS hi FROM {source}),
    c AS (SELECT least(floor(({column} - lo) / (hi - lo) * {bins}), {bins - 1})::INT AS bin, count(*) AS n FROM {source}, r
          WHERE {column} IS NOT NULL GROUP BY 1)
    SELECT i::INT AS bin, {s4(f'lo + i * ((hi - lo) / {bins})')} AS lower, coalesce(n, 0) AS n
    FROM range({bins}) t(i) CROSS JOIN r LEFT JOIN c ON c.bin = i"""


@query(_hist_sql("lineitem", "l_extendedprice", 30))
def histogram_30(spark, sf):
    return profile.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 30).withColumn("lower", scalar.fixed(F.col("lower")))


@query(_hist_sql("events", "value", 35))
def histogram_35(spark, sf):
    return profile.histogram(table(spark, sf, "events"), "value", 35).withColumn("lower", scalar.fixed(F.col("lower")))


@query(
    f"""WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
    c AS (SELECT event_type, least(floor((value - lo) / (hi - lo) * 30), 29)::INT AS bin, count(*) AS n FROM events, r GROUP BY ALL)
    SELECT event_type, bin, n, {s4('n::DOUBLE / sum(n) OVER (PARTITION BY event_type) / ((hi - lo) / 30)', 6)} AS density FROM c, r"""
)
def class_density(spark, sf):
    shape = profile.grouped_histogram(table(spark, sf, "events"), "event_type", "value", 30)
    return shape.select("event_type", "bin", "n", r4("density", "density", 6))


def _corr_cells() -> str:
    cells = [f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS r FROM lineitem" for a in LINE_COLUMNS for b in LINE_COLUMNS]
    return " UNION ALL ".join(cells)


@query(f"SELECT x, y, {s4('r', 6)} AS r FROM ({_corr_cells()})")
def correlation_matrix(spark, sf):
    return profile.correlation_matrix(table(spark, sf, "lineitem"), LINE_COLUMNS).select("x", "y", r4("r", "r", 6))


@query(
    f"SELECT feature, {s4('r', 6)} AS r FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, corr({c}, energy) AS r FROM (SELECT *, {SIGNALS_SQL['energy']} AS energy FROM {SENSORS})"
        for c in ("production_load", "machine_temperature", "tool_wear", "axis_speed")
    )
    + ")"
)
def target_correlations(spark, sf):
    df = order_sensors(spark, sf).withColumn("energy", feat.energy_signal())
    found = profile.target_correlations(df, "energy", ["production_load", "machine_temperature", "tool_wear", "axis_speed"])
    return found.select("feature", r4("r", "r", 6))


@query(
    "SELECT feature, count(*) AS n, "
    + s4("sum(value)", 2)
    + " AS total FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value FROM lineitem" for c in LINE_COLUMNS)
    + ") GROUP BY 1"
)
def melt_features(spark, sf):
    long = profile.melt(table(spark, sf, "lineitem"), LINE_COLUMNS)
    return long.groupBy("feature").agg(F.count("*").alias("n"), r4(F.sum("value"), "total", 2))


@query("SELECT l_partkey, l_quantity, l_extendedprice FROM lineitem")
def scatter_points(spark, sf):
    return profile.scatter_sample(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], "l_partkey")


@query(
    f"""SELECT {s4('avg(value)')} AS mean, {s4('stddev_pop(value)')} AS std, {s4('quantile_cont(value, 0.05)')} AS p5,
    {s4('quantile_cont(value, 0.95)')} AS p95 FROM events"""
)
def distribution_summary(spark, sf):
    found = profile.distribution_summary(table(spark, sf, "events"), "value")
    return found.select(*[r4(c, c) for c in ("mean", "std", "p5", "p95")])


# ---------------------------------------------------------------- evaluation


def _guessed(spark, sf):
    """Order labels from price terciles, predicted from a rule on customer and date."""
    o = table(spark, sf, "orders")
    cuts = clean.percentile_cuts(o, "o_totalprice")
    guess = (
        F.when(F.col("o_orderstatus") == "F", F.col("y"))
        .when(F.col("o_totalprice") < 200000, "Low")
        .when(F.col("o_totalprice") < 320000, "Medium")
        .otherwise("High")
    )
    return o.withColumn("y", clean.percentile_label("o_totalprice", cuts)).select(
        "o_orderkey", "y", guess.alias("p"), "o_totalprice", (F.col("o_totalprice") * 0.9 + 20000.0).alias("price_guess"), "o_orderpriority"
    )


SQL_GUESSED = """g AS (SELECT o_orderkey, y, CASE WHEN o_orderstatus = 'F' THEN y WHEN o_totalprice < 200000 THEN 'Low'
      WHEN o_totalprice < 320000 THEN 'Medium' ELSE 'High' END AS p, o_totalprice, o_totalprice * 0.9::DOUBLE + 20000.0::DOUBLE AS price_guess,
      o_orderpriority FROM (SELECT orders.*, CASE WHEN o_totalprice < q33 THEN 'Low' WHEN o_totalprice < q67 THEN 'Medium' ELSE 'High' END AS y
      FROM orders, (SELECT quantile_cont(o_totalprice, 0.33) AS q33, quantile_cont(o_totalprice, 0.67) AS q67 FROM orders)))"""


@query(
    f"""WITH {SQL_GUESSED}, m AS (SELECT o_orderpriority AS pr, avg(o_totalprice) AS ym FROM g GROUP BY 1)
    SELECT o_orderpriority, {s4('1.0::DOUBLE - sum((o_totalprice - price_guess)^2) / sum((o_totalprice - ym)^2)', 6)} AS r2,
      {s4('avg(abs(o_totalprice - price_guess))', 3)} AS mae, count(*) AS n
    FROM g JOIN m ON pr = o_orderpriority GROUP BY 1"""
)
def regression_metrics(spark, sf):
    found = metrics.r2_from(_guessed(spark, sf), "o_totalprice", "price_guess", ["o_orderpriority"])
    return found.select("o_orderpriority", r4("r2", "r2", 6), r4("mae", "mae", 3), "n")


@query(f"WITH {SQL_GUESSED} SELECT {s4('avg((y = p)::INT)', 6)} AS accuracy, count(*) AS n FROM g")
def accuracy(spark, sf):
    return metrics.accuracy_from(_guessed(spark, sf), "y", "p").select(r4("accuracy", "accuracy", 6), "n")


@query(
    f"""WITH {SQL_GUESSED} SELECT y AS label, count(*) FILTER (p = 'High') AS "High", count(*) FILTER (p = 'Low') AS "Low",
    count(*) FILTER (p = 'Medium') AS "Medium" FROM g GROUP BY 1"""
)
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(_guessed(spark, sf), "y", "p")


@query(
    f"""WITH {SQL_GUESSED}, c AS (SELECT d.label, (SELECT count(*) FROM g WHERE y = label) AS support,
       (SELECT count(*) FROM g WHERE p = label) AS guessed, (SELECT count(*) FROM g WHERE p = label AND y = label) AS hits
       FROM (VALUES ('Low'), ('Medium'), ('High')) d(label)),
    r AS (SELECT label, CASE WHEN guessed = 0 THEN 0.0::DOUBLE ELSE hits::DOUBLE / guessed END AS precision,
       CASE WHEN support = 0 THEN 0.0::DOUBLE ELSE hits::DOUBLE / support END AS recall, support FROM c),
    f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * precision * recall / (precision + recall) END AS f1 FROM r),
    a AS (SELECT label, precision, recall, f1, support FROM f
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
      UNION ALL SELECT 'weighted avg', sum(precision*support)/sum(support), sum(recall*support)/sum(support),
        sum(f1*support)/sum(support), sum(support) FROM f)
    SELECT label, {s4('precision', 6)} AS precision, {s4('recall', 6)} AS recall, {s4('f1', 6)} AS f1, support::BIGINT AS support FROM a"""
)
def class_report(spark, sf):
    report = metrics.class_report(_guessed(spark, sf), "y", "p")
    return report.select("label", *[r4(c, c, 6) for c in ("precision", "recall", "f1")], "support")


def _split_sql(by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    h = "('0x' || substr(md5('42-' || o_orderkey::VARCHAR), 1, 13))::BIGINT"
    return f"(SELECT g.*, row_number() OVER ({part}ORDER BY {h}) AS i, count(*) OVER ({part}) AS n FROM g)"


@query(f"WITH {SQL_GUESSED} SELECT o_orderkey, CASE WHEN i <= n - ceil(n * 0.2::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM {_split_sql()}")
def random_split(spark, sf):
    return splits.train_test_split(_guessed(spark, sf).select("o_orderkey"), "o_orderkey")


@query(
    f"""WITH {SQL_GUESSED} SELECT o_orderkey, y, CASE WHEN i <= floor(n * 0.8::DOUBLE + 0.5::DOUBLE) THEN 'train' ELSE 'test' END AS split
    FROM {_split_sql('y')}"""
)
def stratified_split(spark, sf):
    return splits.train_test_split(_guessed(spark, sf).select("o_orderkey", "y"), "o_orderkey", by=["y"])


@query(f"WITH {SQL_GUESSED} SELECT o_orderkey, y, floor((i - 1) * 5 / n)::INT AS fold FROM {_split_sql('y')}")
def stratified_folds(spark, sf):
    return splits.assign_folds(_guessed(spark, sf).select("o_orderkey", "y"), "o_orderkey", by=["y"])


@query(f"WITH {SQL_GUESSED} SELECT o_orderkey, floor((i - 1) * 5 / n)::INT AS fold FROM {_split_sql()}")
def plain_folds(spark, sf):
    return splits.assign_folds(_guessed(spark, sf).select("o_orderkey"), "o_orderkey")


@query(
    f"""WITH {SQL_GUESSED}, s AS (SELECT *, i <= floor(n * 0.8::DOUBLE + 0.5::DOUBLE) AS is_train FROM {_split_sql('y')})
    SELECT {s4('train', 6)} AS train, {s4('test', 6)} AS test, {s4('train - test', 6)} AS gap FROM
    (SELECT avg((y = p)::INT) FILTER (is_train) AS train, avg((y = p)::INT) FILTER (NOT is_train) AS test FROM s)"""
)
def overfit_gap(spark, sf):
    df = splits.train_test_split(_guessed(spark, sf), "o_orderkey", by=["y"])
    both = [metrics.accuracy_from(df.where(F.col("split") == s), "y", "p") for s in ("train", "test")]
    return metrics.fit_gap(both[0], both[1], "accuracy").select(*[r4(c, c, 6) for c in ("train", "test", "gap")])
