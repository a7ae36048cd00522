"""Dense bucket grids per person, and rankings over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import BUCKET, bucket_start, semantic_role
from ..sources.scratch import written

ROLES = {"agents": "agent", "subagents": "subagent", "others": "unclassified"}


def sessions_by_role(activity: DataFrame, keys: list[Column | str], prefix: str = "") -> DataFrame:
    """Distinct sessions of each role per key. Rows are first folded to one per key, session and role, with map-side
    combination; a distinct count per role would copy every row once per role."""
    once = activity.select(*keys, "session_id", semantic_role(F.col("actor_role")).alias("role")).distinct()
    names = [c for c in once.columns if c not in ("session_id", "role")]
    return once.groupBy(*names).agg(*[F.count(F.when(F.col("role") == r, 1)).alias(prefix + n) for n, r in ROLES.items()])


def bucket_activity(activity: DataFrame, start: int, end: int, at: str = "effective_at", width: int = BUCKET) -> DataFrame:
    inside = activity.filter((F.col(at) >= start) & (F.col(at) < end))
    return sessions_by_role(inside, ["person_id", bucket_start(F.col(at), width, start).alias("bucket_at")])


def day_totals(activity: DataFrame, start: int, end: int, at: str = "effective_at") -> DataFrame:
    inside = activity.filter((F.col(at) >= start) & (F.col(at) < end))
    return sessions_by_role(inside, ["person_id"], "day_")


def day_facts(activity: DataFrame, prompts: DataFrame, start: int, end: int, width: int = BUCKET, at: str = "effective_at") -> DataFrame:
    """person_id, bucket_at, agents, subagents, others, prompts: a row for each bucket of a person with any, and one without a
    bucket for the person's day. Activity is read once: it is folded to a row for each session and role, with the set of its
    buckets (a day's number of them bounds it), and that row counts once in each of them and once in the day."""
    own = bucket_start(F.col(at), width, start)
    inside = activity.filter((F.col(at) >= start) & (F.col(at) < end))
    once = inside.groupBy("person_id", "session_id", semantic_role(F.col("actor_role")).alias("role")).agg(F.collect_set(own).alias("buckets"))
    counted = once.select("person_id", "role", F.lit(1).cast("long").alias("n"), F.explode(F.array_append("buckets", F.lit(None).cast("long"))).alias("bucket_at"))
    said = prompts.groupBy("person_id", bucket_start(F.col("prompt_at"), width, start).alias("bucket_at")).agg(F.count(F.lit(1)).alias("n")).withColumn("role", F.lit("prompt"))
    total = lambda role, name: F.coalesce(F.sum(F.when(F.col("role") == role, F.col("n"))), F.lit(0)).alias(name)
    return counted.unionByName(said).groupBy("person_id", "bucket_at").agg(*[total(r, n) for n, r in ROLES.items()], total("prompt", "prompts"))


def latest_activity(activity: DataFrame, read_at: int, at: str = "effective_at") -> DataFrame:
    return activity.filter(F.col(at) <= read_at).groupBy("person_id").agg(F.max(at).alias("latest_at"))


def bucket_grid(roster: DataFrame, facts: list[DataFrame], start: int, end: int, width: int = BUCKET) -> DataFrame:
    """people x buckets rows, always: each person's buckets are generated in place, facts are joined and gaps are 0."""
    out = roster.withColumn("bucket_at", F.explode(F.sequence(F.lit(start), F.lit(end - width), F.lit(width))))
    for f in facts:
        keys = ["person_id", "bucket_at"] if "bucket_at" in f.columns else ["person_id"]
        out = out.join(f, keys, "left").fillna(0, [c for c in f.columns if c not in keys and not c.endswith("_at")])
    return out


def active_seconds(grid: DataFrame, width: int = BUCKET) -> DataFrame:
    """Seconds of the buckets with any session; prompts alone are not activity."""
    busy = (F.col("agents") + F.col("subagents") + F.col("others")) > 0
    return grid.groupBy("person_id").agg((F.count_if(busy) * (width // 1_000_000)).alias("active_seconds"))


def person_metrics(grid: DataFrame, width: int = BUCKET) -> DataFrame:
    total = F.col("agents") + F.col("subagents") + F.col("others")
    return grid.groupBy("person_id").agg(
        (F.count_if(total > 0) * (width // 1_000_000)).alias("active_seconds"), F.max(total).alias("peak_sessions"), F.sum("prompts").alias("prompts"), F.max("subagents").alias("peak_subagents")
    )


def global_peak(grid: DataFrame) -> DataFrame:
    return grid.agg(F.coalesce(F.max(F.col("agents") + F.col("subagents") + F.col("others")), F.lit(0)).alias("peak"))


def ranked(people: DataFrame, metric: str, index: str = "roster_index") -> DataFrame:
    """people by metric, ties in roster order."""
    return numbered(people, [F.col(metric).desc(), F.col(index).asc()], "rank").withColumn("rank", F.col("rank").cast("int"))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with name: 1, 2, ... in an order without ties. Ranges of the order are dealt to tasks, and each row is numbered
    within its range, beyond what lies in the ranges before; no task holds all rows. df is written first, as finding the
    ranges reads it once more."""
    dealt = written(written(df, "unnumbered").repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))  # a row for each task
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn(name, own).join(F.broadcast(offsets), "__range").withColumn(name, F.col(name) + F.col("__before")).drop("__range", "__before")


def axis_ticks(start: Column | int, end: Column | int, parts: int = 12) -> Column:
    """The times that divide a span into equal parts, both ends included; times are whole multiples of `parts` apart."""
    start, end = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    width = F.call_function("div", end - start, F.lit(parts))
    return F.transform(F.sequence(F.lit(0), F.lit(parts)), lambda i: start + width * i)


def day_payload(grid: DataFrame) -> DataFrame:
    """person_id, display_name, payload: a person's day as JSON, [agents, subagents, others, prompts] for each bucket in
    order. A day has a fixed number of buckets, which bounds the group."""
    counts = F.array(*[F.col(c).cast("long") for c in (*ROLES, "prompts")])
    days = grid.groupBy("person_id", "display_name").agg(F.array_sort(F.collect_list(F.struct("bucket_at", counts.alias("c")))).alias("b"))
    return days.select("person_id", "display_name", F.to_json(F.transform("b", lambda x: x["c"])).alias("payload"))
