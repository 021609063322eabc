"""Change tables over a road network: closures and penalties with expiry, kept as rows.

``mutations`` has (mutation_id, src, dst, mutation_type, blocked, cost_multiplier, cost_override, reason,
created_at, expires_at, txn_id, seq); seq is the order of writing. The latest row of a road counts, even
after it has expired: an expired last row hides a live earlier one.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.spatial import edges_in_hazards

COLUMNS = ["mutation_id", "src", "dst", "mutation_type", "blocked", "cost_multiplier", "cost_override", "reason", "created_at", "expires_at", "txn_id", "seq"]


def _time(now: Column | datetime | str) -> Column:
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp_ntz")


def live(expires_at: Column, now: Column | datetime | str) -> Column:
    """Not expired; the moment of expiry is too late."""
    return expires_at.isNull() | (_time(now) < expires_at)


def latest(mutations: DataFrame) -> DataFrame:
    """The last written row of each road."""
    rank = F.row_number().over(Window.partitionBy("src", "dst").orderBy(F.desc("seq"), "mutation_id"))
    return mutations.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def mutated_cost(cost: Column, blocked: Column, override: Column, multiplier: Column) -> Column:
    return F.when(blocked, F.lit(float("inf"))).when(override.isNotNull(), override).otherwise(cost * F.coalesce(multiplier, F.lit(1.0)))


def apply_overlay(edges: DataFrame, mutations: DataFrame, now: Column | datetime | str, keep_blocked: bool = False) -> DataFrame:
    """``edges`` with their cost under the live changes and ``blocked``; blocked roads are dropped unless kept."""
    current = latest(mutations).where(live(F.col("expires_at"), now)).select("src", "dst", F.col("blocked").alias("_blocked"), F.col("cost_override").alias("_override"), F.col("cost_multiplier").alias("_multiplier"))
    out = edges.drop("blocked").join(current, ["src", "dst"], "left")
    blocked = F.coalesce("_blocked", F.lit(False))
    out = out.select(*[mutated_cost(F.col("cost"), blocked, F.col("_override"), F.col("_multiplier")).alias("cost") if c == "cost" else F.col(c) for c in edges.columns if c != "blocked"], blocked.alias("blocked"))
    return out if keep_blocked else out.where(~F.col("blocked"))


def overlay_counts(edges: DataFrame, mutations: DataFrame, now: Column | datetime | str) -> DataFrame:
    """One row: edges, blocked_edges and open_edges (each parallel road counts), and active_mutations."""
    marked = apply_overlay(edges, mutations, now, keep_blocked=True)
    active = latest(mutations).where(live(F.col("expires_at"), now)).agg(F.count("*").alias("active_mutations"))
    counts = marked.agg(F.count("*").alias("edges"), F.count_if("blocked").alias("blocked_edges"))
    return counts.withColumn("open_edges", F.col("edges") - F.col("blocked_edges")).join(active)


def overlay_at(incidents: DataFrame, mutations: DataFrame) -> DataFrame:
    """Incidents (incident_id, src, dst, reported_at) with each change of their road in force at that time."""
    rows = mutations.select("src", "dst", "mutation_id", "blocked", "cost_multiplier", "created_at", "expires_at")
    met = incidents.join(rows, ["src", "dst"])
    return met.where((F.col("reported_at") >= F.col("created_at")) & live(F.col("expires_at"), F.col("reported_at")))


def _known(changes: DataFrame, edges: DataFrame) -> DataFrame:
    return changes.join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_semi")


def reject_unknown(mutations: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejects): changes of roads that exist, and the rest with a code."""
    unknown = mutations.join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    return _known(mutations, edges), unknown.select("mutation_id", F.lit("unknown_edge").alias("code"), F.concat_ws("->", "src", "dst").alias("message"))


def _changes(edges: DataFrame, roads: DataFrame, kind: str, blocked: bool, multiplier: float, bidirectional: bool, created_at, expires_at, txn_id: str | None, seq: int) -> DataFrame:
    asked = _known(roads.select("src", "dst", "reason"), edges).withColumn("_back", F.lit(False))
    if bidirectional:
        back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "reason", F.lit(True).alias("_back"))
        both = asked.select(F.explode(F.array(F.struct("src", "dst", "reason", "_back"), back)).alias("r")).select("r.*")
        asked = _known(both, edges)
    once = asked.groupBy("src", "dst").agg(F.min_by("reason", F.struct("_back", "reason")).alias("reason"))
    order = F.lit(seq).cast("long")
    return once.select(
        F.concat_ws("_", F.lit(kind), "src", "dst").alias("mutation_id"), "src", "dst", F.lit(kind).alias("mutation_type"), F.lit(blocked).alias("blocked"), F.lit(multiplier).alias("cost_multiplier"),
        F.lit(None).cast("double").alias("cost_override"), "reason", _time(created_at).alias("created_at"), _time(expires_at).alias("expires_at") if expires_at is not None else F.lit(None).cast("timestamp_ntz").alias("expires_at"), F.lit(txn_id).cast("string").alias("txn_id"), order.alias("seq"),
    )


def closures(edges: DataFrame, roads: DataFrame, now, expires_at=None, bidirectional: bool = True, txn_id: str | None = None, seq: int = 0) -> DataFrame:
    """Closures of listed roads (src, dst, reason) that exist, and of their reverse where that exists."""
    return _changes(edges, roads, "road_closure", True, 1.0, bidirectional, now, expires_at, txn_id, seq)


def speed_penalties(edges: DataFrame, roads: DataFrame, speed_factor: float, now, expires_at=None, bidirectional: bool = True, txn_id: str | None = None, seq: int = 0) -> DataFrame:
    """Penalties that divide speed: the cost multiplier is 1 / factor, the factor being in (0, 1]."""
    if not 0 < speed_factor <= 1:
        raise ValueError(f"speed factor {speed_factor} is not in (0, 1]")
    return _changes(edges, roads, "speed_penalty", False, 1.0 / speed_factor, bidirectional, now, expires_at, txn_id, seq)


def hazard_blocking(severity: Column, multiplier: Column, active: Column) -> Column:
    return active & ((severity == "critical_blocked") | (multiplier == 0))


def hazard_mutations(edges: DataFrame, nodes: DataFrame, hazards: DataFrame, existing: DataFrame | None = None, now=None, bidirectional: bool = True, seq: int = 0) -> DataFrame:
    """Changes that active hazards (in the order of hazard_id) make to the roads they meet.

    A blocking hazard closes, another multiplies cost by 1 / multiplier. Forward rows overwrite; the reverse of a
    road is only filled in where neither the overlay nor a hazard of the same or an earlier turn has it.
    """
    active = hazards.where("active")
    forward = edges_in_hazards(edges, nodes, active).join(active.drop("ring"), "hazard_id")
    forward = forward.select("src", "dst", "hazard_id", "severity", "speed_multiplier", "description", "expires_at", "active", F.lit(0).alias("back"))
    rows = forward
    if bidirectional:
        reverse = _known(forward.select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in forward.columns if c != "back"], F.lit(1).alias("back")), edges)
        first = forward.groupBy("src", "dst").agg(F.min("hazard_id").alias("_first"))
        reverse = reverse.join(first, ["src", "dst"], "left").where(F.col("_first").isNull() | (F.col("_first") > F.col("hazard_id"))).drop("_first")
        if existing is not None:
            reverse = reverse.join(existing.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
        earliest = F.row_number().over(Window.partitionBy("src", "dst").orderBy("hazard_id"))
        rows = forward.unionByName(reverse.withColumn("_n", earliest).where("_n = 1").drop("_n"))
    blocking = hazard_blocking(F.col("severity"), F.col("speed_multiplier"), F.col("active"))
    turn = F.row_number().over(Window.partitionBy("src", "dst").orderBy("hazard_id"))  # only rows of one road are ever compared
    return rows.select(
        F.concat_ws("_", F.lit("haz"), "hazard_id", "src", "dst").alias("mutation_id"), "src", "dst", F.when(blocking, "road_closure").otherwise("speed_penalty").alias("mutation_type"), blocking.alias("blocked"),
        F.when(F.col("speed_multiplier") > 0, 1 / F.col("speed_multiplier")).otherwise(1.0).alias("cost_multiplier"), F.lit(None).cast("double").alias("cost_override"),
        F.coalesce(F.when(F.length("description") > 0, F.col("description")), F.concat_ws(" ", F.lit("Hazard"), "hazard_id")).alias("reason"),
        (_time(now) if now is not None else F.lit(None).cast("timestamp_ntz")).alias("created_at"), F.col("expires_at").cast("timestamp_ntz").alias("expires_at"), F.concat_ws("_", F.lit("hazard"), "hazard_id").alias("txn_id"), (F.lit(seq) + turn).cast("long").alias("seq"),
    )


def clear_hazard(mutations: DataFrame, hazard_id: str) -> DataFrame:
    """The overlay without a hazard's rows; what they overwrote counts again."""
    return mutations.where(~F.col("txn_id").eqNullSafe(f"hazard_{hazard_id}"))


def rollback(mutations: DataFrame, txn_id: str) -> DataFrame:
    """The overlay without any row of the roads a transaction touched: nothing from before it is restored."""
    touched = mutations.where(F.col("txn_id") == txn_id).select("src", "dst").distinct()
    return mutations.join(touched, ["src", "dst"], "left_anti")


def commit_nested(mutations: DataFrame, inner: str, outer: str | None) -> DataFrame:
    """Rows of a nested transaction become the outer one's."""
    return mutations.withColumn("txn_id", F.when(F.col("txn_id") == inner, F.lit(outer).cast("string")).otherwise(F.col("txn_id")))


def purge_expired(mutations: DataFrame, now) -> DataFrame:
    return mutations.where(live(F.col("expires_at"), now))


def remove(mutations: DataFrame, roads: DataFrame) -> DataFrame:
    """The overlay without the changes of listed roads (src, dst)."""
    return mutations.join(roads.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def snapshot(mutations: DataFrame, folder: str, version: int) -> str:
    """Write a version of the overlay; returns its path."""
    path = f"{folder}/v={version}"
    mutations.write.mode("errorifexists").parquet(path)
    return path


def restore(spark, folder: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/v={version}")


def effective_edge_cost(edges: DataFrame, nodes: DataFrame, hazards: DataFrame) -> DataFrame:
    """``edges`` with the cost under the worst active hazard on them: cost / least multiplier, infinite if blocked."""
    facts = edges_in_hazards(edges, nodes, hazards.where("active")).join(hazards.drop("ring"), "hazard_id")
    worst = facts.groupBy("src", "dst").agg(F.min("speed_multiplier").alias("_least"), F.bool_or(hazard_blocking(F.col("severity"), F.col("speed_multiplier"), F.col("active"))).alias("_blocked"))
    out = edges.join(worst, ["src", "dst"], "left")
    cost = F.when(F.col("_least").isNull(), F.col("cost")).when(F.col("_blocked") | (F.col("_least") <= 0), float("inf")).otherwise(F.col("cost") / F.col("_least"))
    return out.withColumn("effective_cost", cost).drop("_least", "_blocked")


def hazard_impact(edges: DataFrame, nodes: DataFrame, hazards: DataFrame) -> DataFrame:
    """(hazard_id, closed_edges, degraded_edges) of every active hazard."""
    active = hazards.where("active")
    facts = edges_in_hazards(edges, nodes, active).groupBy("hazard_id").agg(F.count("*").alias("n"))
    closes = hazard_blocking(F.col("severity"), F.col("speed_multiplier"), F.col("active"))
    n = F.coalesce("n", F.lit(0))
    return active.join(facts, "hazard_id", "left").select("hazard_id", F.when(closes, n).otherwise(0).cast("long").alias("closed_edges"), F.when(closes, 0).otherwise(n).cast("long").alias("degraded_edges"))
