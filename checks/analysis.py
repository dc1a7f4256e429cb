"""Registered queries: candidate grids, skyline, what-if analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import SQL_POINTS, energy_sql, point_table, query, r4, s4, sql_permuted, sql_uniform, table
from checks.tables import SIGNALS_SQL
from plantlens.functions import features as feat
from plantlens.functions import scalar
from plantlens.functions.hashing import permuted
from plantlens.operators import skyline, whatif
from plantlens.operators.grid import SEARCH_BOUNDS, best_candidate, stratified_grid
from plantlens.operators.scoring import RAW_DEFAULTS, column_scorer, complete_points, score_tasks
from plantlens.operators.splits import sample_grid
from plantlens.plans.pareto import pareto_points

# ---------------------------------------------------------------- candidate grid


def sql_grid(rows: str, key: str) -> str:
    """The stratified grid over ``rows`` with keys that give each remainder of n once."""
    columns = ", ".join(
        f"max(CASE WHEN name = '{c}' THEN {lo}::DOUBLE + ((x::DOUBLE + {sql_uniform(f'42-{c}', 'id')}) / n::DOUBLE) * ({hi}::DOUBLE - {lo}::DOUBLE) END) AS {c}"
        for c, (lo, hi) in SEARCH_BOUNDS.items()
    )
    return f"(SELECT id AS point_id, {columns} FROM {sql_permuted(rows, key, f'SELECT count(*) FROM {rows}', list(SEARCH_BOUNDS))} GROUP BY id)"


GRID = sql_grid("part", "p_partkey")


def _grid(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("point_id"))
    return stratified_grid(part, part.count(), id_column="point_id")


@query(f"SELECT point_id, {', '.join(f'{s4(c, 6)} AS {c}' for c in SEARCH_BOUNDS)} FROM {GRID}")
def lhs_grid(spark, sf):
    return _grid(spark, sf).select("point_id", *[r4(c, c, 6) for c in SEARCH_BOUNDS])


@query(
    f"""SELECT count(*) AS n_points, count(DISTINCT floor((production_load - 0.3::DOUBLE) / 0.7::DOUBLE * n)) AS load_strata
    FROM {GRID}, (SELECT count(*) AS n FROM part)"""
)
def lhs_strata(spark, sf):
    grid = _grid(spark, sf)
    spot = F.floor((F.col("production_load") - 0.3) / F.lit(0.7) * F.lit(float(grid.count())))
    return grid.agg(F.count("*").alias("n_points"), F.count_distinct(spot).alias("load_strata"))


@query(
    f"""SELECT a, b, count(*) AS n_points, sum(x * y) AS products FROM (SELECT *, x * 10 // n AS a, y * 10 // n AS b FROM
      (SELECT id, max(n) AS n, max(x) FILTER (name = 'one') AS x, max(x) FILTER (name = 'two') AS y
       FROM {sql_permuted('orders', 'o_orderkey', 'SELECT count(*) FROM orders', ['one', 'two'])} GROUP BY id)) GROUP BY a, b"""
)
def permuted_orders(spark, sf):
    """Two keyed permutations of the orders: how many fall into each cell of a ten by ten grid."""
    orders = table(spark, sf, "orders")
    n = orders.count()
    both = orders.select(permuted(F.col("o_orderkey"), n, "one", 42).alias("x"), permuted(F.col("o_orderkey"), n, "two", 42).alias("y"))
    cell = lambda c: F.floor(F.col(c) * 10 / n).cast("bigint")
    return both.groupBy(cell("x").alias("a"), cell("y").alias("b")).agg(F.count("*").alias("n_points"), F.sum(F.col("x") * F.col("y")).alias("products"))


@query(
    f"""WITH RECURSIVE b AS (SELECT DISTINCT p_brand FROM part), z AS (SELECT DISTINCT p_size FROM part), m AS (SELECT DISTINCT c_mktsegment FROM customer),
    g AS (SELECT (SELECT list(p_brand ORDER BY p_brand) FROM b) AS brands, (SELECT list(p_size ORDER BY p_size) FROM z) AS sizes, (SELECT list(c_mktsegment ORDER BY c_mktsegment) FROM m) AS segments),
    d AS (SELECT id, x FROM {sql_permuted('(SELECT unnest(range(300)) AS i)', 'i', '(SELECT count(*) FROM b) * (SELECT count(*) FROM z) * (SELECT count(*) FROM m)', ['draw'])}),
    s AS (SELECT brands[x % len(brands) + 1] AS brand, sizes[(x // len(brands)) % len(sizes) + 1] AS size, segments[x // (len(brands) * len(sizes)) + 1] AS segment FROM d, g)
    SELECT brand, size, segment, (SELECT count(*) FROM part WHERE p_brand = brand AND p_size = size) AS n FROM s"""
)
def seeded_grid_draw(spark, sf):
    """300 settings drawn without replacement from a product of three tables' values; each counts the parts it fits."""
    part, customer = table(spark, sf, "part"), table(spark, sf, "customer")
    listed = lambda t, c: [r[0] for r in t.select(c).distinct().orderBy(c).collect()]
    grid = {"brand": listed(part, "p_brand"), "size": listed(part, "p_size"), "segment": listed(customer, "c_mktsegment")}
    drawn = spark.createDataFrame([(c["brand"], c["size"], c["segment"]) for c in sample_grid(grid, 300)], "brand string, size int, segment string")
    met = part.groupBy(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).agg(F.count("*").alias("n"))
    return drawn.join(met, ["brand", "size"], "left").select("brand", "size", "segment", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    f"""WITH s AS (SELECT point_id, p_brand, {energy_sql()} AS score FROM {GRID} JOIN part ON point_id = p_partkey)
    SELECT p_brand, point_id, {s4('score')} AS score FROM s
    QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY score, point_id) = 1"""
)
def best_candidate_by_brand(spark, sf):
    brand = table(spark, sf, "part").select(F.col("p_partkey").alias("point_id"), "p_brand")
    full = complete_points(_grid(spark, sf), RAW_DEFAULTS["energy"], temp_mean=0.0)
    scored = full.withColumn("score", feat.energy_signal()).select("point_id", "score").join(brand, "point_id")
    return best_candidate(scored, "score", "point_id", "min", ["p_brand"]).select("p_brand", "point_id", r4("score", "score"))


@query(
    f"SELECT point_id, {s4('score')} AS score FROM (SELECT point_id, {energy_sql()} AS score FROM {GRID})"
    " ORDER BY score DESC, point_id LIMIT 1"
)
def best_candidate_max(spark, sf):
    full = complete_points(_grid(spark, sf), RAW_DEFAULTS["energy"], temp_mean=0.0)
    scored = full.select("point_id", feat.energy_signal().alias("score"))
    return best_candidate(scored, "score", "point_id", "max").select("point_id", r4("score", "score"))


# ---------------------------------------------------------------- scoring of all tasks

# Class cut points of the closed-form task scorers.
TASK_CUTS = {"efficiency": (-0.5, 0.5), "emission": (6.5, 7.5), "maintenance": (3.6, 3.9)}


def _task_scorers():
    signals = {"efficiency": feat.efficiency_signal(), "emission": feat.emission_signal(), "maintenance": feat.maintenance_signal()}
    scorers = {"energy": column_scorer(feat.energy_signal())}
    for task, signal in signals.items():
        low, high = TASK_CUTS[task]
        scorers[task] = column_scorer(F.when(signal < low, "Low").when(signal < high, "Medium").otherwise("High"))
    return scorers


def _prepare(df, task):
    return complete_points(df, RAW_DEFAULTS[task], temp_mean=0.0)


DEFAULTS_SQL = ", ".join(
    f"{v}::DOUBLE AS {k}" for k, v in {**RAW_DEFAULTS["efficiency"], **RAW_DEFAULTS["maintenance"]}.items()
)


def sql_tasks(points: str) -> str:
    cases = ", ".join(
        f"CASE WHEN {SIGNALS_SQL[t]} < {lo} THEN 'Low' WHEN {SIGNALS_SQL[t]} < {hi} THEN 'Medium' ELSE 'High' END AS {t}"
        for t, (lo, hi) in TASK_CUTS.items()
    )
    return f"""(SELECT point_id, production_load, cycle_time, machine_temperature, axis_speed,
        greatest({SIGNALS_SQL['energy']}, 0.01::DOUBLE) AS energy, {cases} FROM (SELECT *, {DEFAULTS_SQL} FROM {points}))"""


@query(f"SELECT point_id, {s4('energy')} AS energy, efficiency, emission, maintenance FROM {sql_tasks(SQL_POINTS)}")
def four_task_scores(spark, sf):
    scored = score_tasks(point_table(spark, sf), _task_scorers(), _prepare)
    return scored.select("point_id", r4("energy", "energy"), "efficiency", "emission", "maintenance")


# ---------------------------------------------------------------- skyline

SUPPLY = """(SELECT l_suppkey AS k, avg(l_discount) AS c1, avg(l_tax) AS c2, avg(l_extendedprice) AS c3
    FROM lineitem GROUP BY 1)"""


def _supply(spark, sf):
    """Mean price, tax and discount per supplier, rounded so that both engines rank the same numbers."""
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").alias("k"))
        .agg(r4(F.avg("l_discount"), "c1", 6), r4(F.avg("l_tax"), "c2", 6), r4(F.avg("l_extendedprice"), "c3", 2))
    )


SUPPLY_SQL = f"(SELECT k, {s4('c1', 6)} AS c1, {s4('c2', 6)} AS c2, {s4('c3', 2)} AS c3 FROM {SUPPLY})"


def _dominated(a: str, b: str, costs: list[str]) -> str:
    """SQL: row ``b`` dominates row ``a``."""
    return (
        " AND ".join(f"{b}.{c} <= {a}.{c}" for c in costs) + " AND (" + " OR ".join(f"{b}.{c} < {a}.{c}" for c in costs) + ")"
    )


LINE_COSTS = ["l_extendedprice", "l_tax", "neg_discount", "neg_quantity"]
LINE_SQL = "(SELECT l_orderkey, l_partkey, l_extendedprice, l_tax, -l_discount AS neg_discount, -l_quantity AS neg_quantity FROM lineitem)"


@query(
    f"""WITH p AS (SELECT * FROM {LINE_SQL}), d AS (SELECT DISTINCT {', '.join(LINE_COSTS)} FROM p),
    best AS (SELECT l_tax, neg_discount, neg_quantity, min(l_extendedprice) AS l_extendedprice FROM d GROUP BY ALL),
    f AS (SELECT * FROM best a WHERE NOT EXISTS (SELECT 1 FROM best b WHERE {_dominated('a', 'b', LINE_COSTS)}))
    SELECT p.* FROM p JOIN f USING ({', '.join(LINE_COSTS)})"""
)
def skyline_lines(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_extendedprice", "l_tax", (-F.col("l_discount")).alias("neg_discount"), (-F.col("l_quantity")).alias("neg_quantity")
    )
    return skyline.skyline(li, LINE_COSTS)


@query(
    f"""WITH p AS (SELECT p_partkey, p_size::DOUBLE AS p_size, -p_retailprice AS worth FROM part)
    SELECT p_partkey, p_size, worth FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE {_dominated('a', 'b', ['p_size', 'worth'])})"""
)
def skyline_parts(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), (-F.col("p_retailprice")).alias("worth"))
    return skyline.skyline(part, ["p_size", "worth"])


@query(
    f"""WITH RECURSIVE p AS (SELECT * FROM {SUPPLY_SQL}),
    e AS (SELECT b.k AS src, a.k AS dst FROM p a JOIN p b ON {_dominated('a', 'b', ['c1', 'c2', 'c3'])}),
    r(k, level) AS (SELECT k, 0 FROM p UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON r.k = e.src)
    SELECT k, max(level) AS front FROM r GROUP BY 1"""
)
def front_ranks(spark, sf):
    return skyline.front_ranks(_supply(spark, sf), ["c1", "c2", "c3"]).select("k", "front")


def _crowding_sql(rows: str, key: str, costs: list[str]) -> str:
    parts = []
    for c in costs:
        parts.append(
            f"""SELECT {key}, CASE WHEN lag({c}) OVER w IS NULL OR lead({c}) OVER w IS NULL THEN NULL ELSE
            (lead({c}) OVER w - lag({c}) OVER w) / CASE WHEN max({c}) OVER () > min({c}) OVER () THEN max({c}) OVER () - min({c}) OVER ()
            ELSE 1.0::DOUBLE END END AS gap FROM {rows} WINDOW w AS (ORDER BY {c}, {key})"""
        )
    return f"""SELECT {key}, CASE WHEN count(gap) < {len(costs)} THEN NULL ELSE {s4('sum(gap)', 6)} END AS crowding,
      count(gap) < {len(costs)} AS is_boundary FROM ({' UNION ALL '.join(parts)}) GROUP BY 1"""


def _open_ends(c: str):
    boundary = F.col(c) == float("inf")
    return F.when(~boundary, scalar.fixed(F.when(~boundary, F.col(c)), 6)).alias(c), boundary.alias("is_boundary")


@query(_crowding_sql(SUPPLY_SQL, "k", ["c1", "c2", "c3"]))
def crowding_suppliers(spark, sf):
    spread = skyline.crowding_distance(_supply(spark, sf), ["c1", "c2", "c3"], "k")
    return spread.select("k", *_open_ends("crowding"))


@query(_crowding_sql("(SELECT o_orderkey, o_totalprice, length(o_orderpriority)::DOUBLE AS urgency FROM orders)", "o_orderkey", ["o_totalprice", "urgency"]))
def crowding_orders(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.length("o_orderpriority").cast("double").alias("urgency"))
    spread = skyline.crowding_distance(orders, ["o_totalprice", "urgency"], "o_orderkey")
    return spread.select("o_orderkey", *_open_ends("crowding"))


PARETO_COSTS = ["energy", "emission_score", "maintenance_score", "efficiency_cost"]
SCORE = "CASE {c} WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 END"


@query(
    f"""WITH t AS (SELECT *, {SCORE.format(c='emission')} AS emission_score, {SCORE.format(c='maintenance')} AS maintenance_score,
      -{SCORE.format(c='efficiency')} AS efficiency_cost FROM {sql_tasks(GRID)}),
    f AS (SELECT * FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE {_dominated('a', 'b', PARETO_COSTS)})),
    c AS ({_crowding_sql('f', 'point_id', PARETO_COSTS)})
    SELECT point_id, {', '.join(f'{s4(c)} AS {c}' for c in [*SEARCH_BOUNDS, 'energy'])}, efficiency, emission, maintenance
    FROM f JOIN c USING (point_id) ORDER BY crowding DESC NULLS FIRST, point_id LIMIT 20"""
)
def pareto_top20(spark, sf):
    best = pareto_points(_grid(spark, sf), "point_id", _task_scorers(), _prepare)
    return best.select("point_id", *[r4(c, c) for c in [*SEARCH_BOUNDS, "energy"]], "efficiency", "emission", "maintenance")


# ---------------------------------------------------------------- what-if analysis

DRAWS = whatif.DRAWS


def _points(spark, sf):
    return point_table(spark, sf)


def _energy(df):
    return complete_points(df, RAW_DEFAULTS["energy"], temp_mean=0.0).withColumn("prediction", feat.energy_signal())


def _sql_draws() -> str:
    def u(i):
        return f"((('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"

    normals = []
    for a, b in ((0, 1), (2, 3)):
        for turn in ("cos", "sin"):
            normals.append(f"sqrt(-2.0::DOUBLE * ln({u(a)})) * {turn}({2.0 * 3.141592653589793!r}::DOUBLE * {u(b)})")
    columns = []
    for (name, (kind, std)), z in zip(whatif.SENSOR_SPEC.items(), normals):
        spread = f"{std}::DOUBLE * abs({name})" if kind == "relative" else f"{std}::DOUBLE"
        lo, hi = whatif.INPUT_BOUNDS[name]
        columns.append(f"greatest({lo}::DOUBLE, least({hi}::DOUBLE, {name} + {spread} * {z})) AS {name}__s")
    return f"""(SELECT *, {', '.join(columns)} FROM (SELECT p.*, draw, md5('42-' || point_id || '-' || draw) AS h
        FROM {SQL_POINTS} p, range(1, {DRAWS + 1}) t(draw)))"""


INPUTS = list(whatif.SENSOR_SPEC)


def _varied(name: str, value: str) -> str:
    args = [value if c == name else c for c in INPUTS]
    return f"greatest({energy_sql(*args)}, 0.01::DOUBLE)"


@query(
    f"""WITH s AS (SELECT point_id, greatest({energy_sql(*[f'{c}__s' for c in INPUTS])}, 0.01::DOUBLE) AS y FROM {_sql_draws()})
    SELECT point_id, {s4('avg(y)')} AS mean, {s4('stddev_pop(y)')} AS std, {s4('quantile_cont(y, 0.05)')} AS p5,
      {s4('quantile_cont(y, 0.95)')} AS p95 FROM s GROUP BY 1"""
)
def uncertainty_summary(spark, sf):
    found = whatif.uncertainty_summary(_points(spark, sf), "point_id", _energy)
    return found.select("point_id", *[r4(c, c) for c in ("mean", "std", "p5", "p95")])


@query(
    f"WITH s AS (SELECT * FROM {_sql_draws()}) SELECT point_id, input, {s4('std', 6)} AS std, "
    "row_number() OVER (PARTITION BY point_id ORDER BY std, input) AS rank FROM ("
    + " UNION ALL ".join(
        f"SELECT point_id, '{c}' AS input, stddev_pop({_varied(c, c + '__s')}) AS std FROM s GROUP BY 1" for c in INPUTS
    )
    + ")"
)
def sensitivity(spark, sf):
    found = whatif.sensitivity(_points(spark, sf), "point_id", _energy)
    return whatif.rank_inputs(found, "point_id", "std").select("point_id", "input", r4("std", "std", 6), "rank")


@query(
    f"WITH s AS (SELECT * FROM {_sql_draws()}), r AS (SELECT point_id, "
    + ", ".join(f"any_value({c}) AS {c}, quantile_cont({c}__s, 0.05) AS lo_{c}, quantile_cont({c}__s, 0.95) AS hi_{c}" for c in INPUTS)
    + f" FROM s GROUP BY 1) SELECT point_id, input, {s4('swing', 6)} AS swing, "
    "row_number() OVER (PARTITION BY point_id ORDER BY swing, input) AS rank FROM ("
    + " UNION ALL ".join(
        f"SELECT point_id, '{c}' AS input, abs({_varied(c, 'hi_' + c)} - {_varied(c, 'lo_' + c)}) AS swing FROM r" for c in INPUTS
    )
    + ")"
)
def tornado(spark, sf):
    found = whatif.tornado(_points(spark, sf), "point_id", _energy)
    return whatif.rank_inputs(found, "point_id", "swing").select("point_id", "input", r4("swing", "swing", 6), "rank")
