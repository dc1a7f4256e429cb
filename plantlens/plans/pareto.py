"""Multi-objective choice: grid, four task scores, skyline, spread, top rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.functions.scalar import label_score
from plantlens.operators.scoring import Scorer, score_tasks
from plantlens.operators.skyline import crowding_distance, most_spread, skyline
from plantlens.session import cut

# Candidates drawn and solutions reported.
CANDIDATES = 1500
SOLUTIONS = 20

COSTS = ["energy_cost__", "emission_cost__", "maintenance_cost__", "efficiency_cost__"]


def pareto_points(
    points: DataFrame,
    key: str,
    scorers: Mapping[str, Scorer],
    prepare: Callable[[DataFrame, str], DataFrame],
    k: int = SOLUTIONS,
) -> DataFrame:
    """The ``k`` most spread non-dominated points: low energy, emission and maintenance, high efficiency.

    Points with their four labels are returned; models run once per point and the scored
    table is checkpointed because skyline and crowding both read it.
    """
    scored = cut(score_tasks(points, scorers, prepare))
    costs = scored.withColumns(
        {
            COSTS[0]: label_score(F.col("energy")),
            COSTS[1]: label_score(F.col("emission")),
            COSTS[2]: label_score(F.col("maintenance")),
            COSTS[3]: -label_score(F.col("efficiency")),
        }
    )
    front = cut(skyline(costs, COSTS))
    return most_spread(crowding_distance(front, COSTS, key), key, k).drop(*COSTS, "crowding")
