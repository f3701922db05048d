"""Claims against artifacts, run against run, node against node."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import half_even
from ..sources.storage import pin
from .keys import null_safe_join
from .ordered import running

# The prompt sizes, concurrencies and classes of each suite.
SUITES: Mapping[str, Mapping[str, Sequence]] = {
    "standard": {"prompts": (256, 2048, 8192, 32768, 131072), "conc": (1, 2, 4, 6)},
    "quick": {"prompts": (256, 2048, 8192), "conc": (1, 2, 4)},
    "fleet": {"prompts": (512, 4096), "conc": (2, 4, 8, 12, 16)},
    "mixed-long": {"prompts": (32768, 131072), "conc": (6,)},
    "spec": {"classes": ("code", "math", "prose", "tool"), "conc": (1,)},
}


def run_compare(
    left: DataFrame, right: DataFrame, label: Sequence[str], measure: str = "aggregate_tok_s"
) -> DataFrame:
    """Ratio right / left of matching cells.

    Cells pair on their label, concurrency, thinking and whether speculation was
    on: a pair that differs in one of the last two is a different workload and
    stays unpaired.
    """
    keys = [*label, "concurrency", "thinking", "speculating"]
    a = left.select(*keys, F.col(measure).alias("left_value"), F.lit(True).alias("_in_left"))
    b = right.select(*keys, F.col(measure).alias("right_value"), F.lit(True).alias("_in_right"))
    both = F.col("_in_left").isNotNull() & F.col("_in_right").isNotNull()
    return null_safe_join(a, b, keys, "full").select(
        *keys,
        "left_value",
        "right_value",
        F.when(both, "paired").when(F.col("_in_left").isNotNull(), "left only").otherwise("right only").alias("status"),
        half_even(F.try_divide("right_value", "left_value"), 2).alias("ratio"),
    )


def claim_reconcile(claims: DataFrame, artifacts: DataFrame, tolerance: float, keys: Sequence[str] = ("artifact",)) -> DataFrame:
    """Claims labelled measured-here that no artifact proves.

    `artifacts` has one value per key: the artifact alone, or also its cell and metric. Values are
    compared as doubles; `tolerance` is the largest difference still taken for equal.
    """
    here = claims.where(F.col("label") == "M-here")
    proof = artifacts.select(*keys, F.col("value").cast("double").alias("artifact_value"))
    joined = here.join(proof, list(keys), "left")
    off = F.abs(F.col("value").cast("double") - F.col("artifact_value"))
    return (
        joined.withColumn(
            "problem",
            F.when(F.col("artifact_value").isNull(), "no artifact").when(off > tolerance, "value differs"),
        )
        .where("problem IS NOT NULL")
        .select("claim_id", *keys, "value", "artifact_value", "problem")
    )


def claims_without_artifact(claims: DataFrame, artifacts: DataFrame) -> DataFrame:
    here = claims.where(F.col("label") == "M-here")
    return here.join(artifacts.select("artifact").distinct(), "artifact", "left_anti")


def capacity_fit(models: DataFrame, nodes: DataFrame) -> DataFrame:
    """Whether a model fits one node, needs two, or fits neither way.

    Split over two nodes each holds half, so the second largest node bounds it.
    """
    sizes = nodes.orderBy(F.desc("usable_gib"), "node").limit(2)
    largest = sizes.select(F.max("usable_gib"))
    second = sizes.select(F.when(F.count("*") > 1, F.min("usable_gib")))
    weights = F.col("weights_gib")
    return models.withColumns({"_one": largest.scalar(), "_two": 2 * second.scalar()}).select(
        "model",
        "weights_gib",
        F.when(weights <= F.col("_one"), "one node").when(weights <= F.col("_two"), "two nodes").otherwise("does not fit").alias("fit"),
    )


def capacity_nodes(models: DataFrame, nodes: DataFrame) -> DataFrame:
    """How many nodes hold each model whole, and the smallest of them (the first by name among equals).

    Models and nodes are walked together in the order of size, in slices, so neither side is joined with all
    of the other. A model of no known size has nulls; one that no node holds has 0 and no node.
    """
    own = models.select("model", "weights_gib").withColumn("_row", F.monotonically_increasing_id())
    own = pin(own)
    asked = own.where("weights_gib IS NOT NULL").select(
        F.col("weights_gib").cast("double").alias("_at"), F.lit(0).alias("_side"), F.col("_row"), F.lit(None).cast("string").alias("_node"), F.lit(0).alias("_one")
    )
    # A node of just the size holds the model, so models come first.
    sized = nodes.where("usable_gib IS NOT NULL").select(
        F.col("usable_gib").cast("double").alias("_at"), F.lit(1).alias("_side"), F.lit(-1).cast("long").alias("_row"), F.col("node").cast("string").alias("_node"), F.lit(1).alias("_one")
    )
    events = asked.unionByName(sized).withColumns({"_all": F.lit(0), "_name": F.coalesce("_node", F.lit(""))})
    walked = running(events, ["_all"], ["_at", "_side", "_name", "_row"], sums={"_below": "_one"}, nexts={"smallest_node": "_node"})
    total = sized.select(F.count("*")).scalar()
    found = walked.where("_side = 0").select("_row", (total - F.col("_below")).cast("long").alias("nodes_fitting"), "smallest_node")
    return own.join(found, "_row", "left").drop("_row")


def inventory_diff(head: DataFrame, worker: DataFrame) -> DataFrame:
    """Names missing on either node or recorded with different values.

    A node may list a name more than once; it is agreed only when all listed
    values agree.
    """

    def summed(node: DataFrame, prefix: str) -> DataFrame:
        return node.groupBy("kind", "name").agg(
            F.min("value").alias(f"{prefix}_value"), F.max("value").alias(f"{prefix}_max"), F.lit(True).alias(f"_on_{prefix}")
        )

    both = null_safe_join(summed(head, "head"), summed(worker, "worker"), ["kind", "name"], "full")
    differs = ~(F.col("head_value").eqNullSafe(F.col("worker_value")) & F.col("head_max").eqNullSafe(F.col("worker_max")))
    return (
        both.withColumn(
            "problem",
            F.when(F.col("_on_head").isNull(), "missing on head")
            .when(F.col("_on_worker").isNull(), "missing on worker")
            .when(differs, "mismatch"),
        )
        .where("problem IS NOT NULL")
        .select("kind", "name", "head_value", "worker_value", "problem")
    )


def revert_plan(captured: DataFrame, running_now: DataFrame, own_prefix: str) -> DataFrame:
    """Captured names to start again: not blank, not ours, not running."""
    displaced = captured.where((F.coalesce("name", F.lit("")) != "") & ~F.startswith("name", F.lit(own_prefix)))
    return displaced.join(running_now.select("name").distinct(), "name", "left_anti")


def revert_plan_as_difference(captured: DataFrame, running_now: DataFrame, own_prefix: str) -> DataFrame:
    """The same plan as a set difference of distinct names."""
    displaced = captured.where((F.coalesce("name", F.lit("")) != "") & ~F.startswith("name", F.lit(own_prefix)))
    return displaced.select("name").distinct().exceptAll(running_now.select("name").distinct())


def suite_grid(runs: DataFrame, suite: str) -> DataFrame:
    """The cells a suite asks of each run."""
    shape = SUITES[suite]
    labels, name = (shape["classes"], "class") if "classes" in shape else (shape["prompts"], "prompt_tokens")
    return runs.withColumn(name, F.explode(F.array(*[F.lit(x) for x in labels]))).withColumn(
        "concurrency", F.explode(F.array(*[F.lit(c) for c in shape["conc"]]))
    )


def suite_coverage(cells: DataFrame, suite: str, run: Sequence[str] = ("run",)) -> DataFrame:
    """Suite cells that a run did not measure."""
    expected = suite_grid(cells.select(*run).distinct(), suite)
    label = "class" if "classes" in SUITES[suite] else "prompt_tokens"
    keys = [*run, label, "concurrency"]
    return expected.join(cells.select(*keys).distinct(), keys, "left_anti")


def latest_capture(captures: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Newest capture by name order, per key or overall."""
    return captures.groupBy(*keys).agg(F.max_by(F.struct("*"), "capture").alias("_newest")).select("_newest.*")
