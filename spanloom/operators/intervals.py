"""Starts and completions as spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import SECOND
from ..sources.scratch import written

SPAN = ["span_kind", "start_at", "end_at", "start_id", "end_id", "state", "basis"]


def fifo_pairs(events: DataFrame, part: str, at: str, id_: str, is_start: Column) -> DataFrame:
    """part, start_id, start_at, end_id, end_at: each start, in order, with the earliest unused completion after it.
    Starts left open have no end, completions left over no start.

    A running balance of starts and completions tells a completion without a start: the balance's least value, 0 at
    most, falls there. The k-th start goes with the k-th other completion. The windows and the aggregation share one
    shuffle on part.
    """
    w = Window.partitionBy(part).orderBy(at, id_)
    e = events.withColumn("__s", is_start).withColumn("__balance", F.sum(F.when(F.col("__s"), 1).otherwise(-1)).over(w))
    e = e.withColumn("__least", F.least(F.lit(0), F.min("__balance").over(w)))
    e = e.withColumn("__lone", ~F.col("__s") & (F.col("__least") < F.coalesce(F.lag("__least").over(w), F.lit(0))))
    number = F.when(F.col("__s"), F.sum(F.col("__s").cast("int")).over(w)).when(F.col("__lone"), -F.sum(F.col("__lone").cast("int")).over(w)).otherwise(F.sum((~F.col("__s") & ~F.col("__lone")).cast("int")).over(w))
    side = lambda cond, c: F.max(F.when(cond, F.col(c)))
    paired = e.withColumn("__k", number).groupBy(part, "__k").agg(
        side(F.col("__s"), id_).alias("start_id"), side(F.col("__s"), at).alias("start_at"), side(~F.col("__s"), id_).alias("end_id"), side(~F.col("__s"), at).alias("end_at")
    )
    return paired.drop("__k")


def fifo_pairs_spread(events: DataFrame, part: str, at: str, id_: str, is_start: Column) -> DataFrame:
    """As fifo_pairs, for parts that may hold any share of the rows: no task sees more of a part than one range of its order.

    Ranges of the whole order are dealt to tasks. What a range must know of those before it in its part is three numbers, and
    they combine: starts, completions, and the least that the running balance reached. A part's ranges are as few as tasks, so
    one window passes these numbers on. Within a range the balance goes on from there; since each completion without a start
    takes the least balance down by one, that least also counts them, and so it numbers the others.
    """
    columns = [part, at, id_, "__s"]
    dealt = written(events.withColumn("__s", is_start).select(*columns).repartitionByRange(part, at, id_).withColumn("__range", F.spark_partition_id()), "fifo")
    step = F.when(F.col("__s"), 1).otherwise(-1).cast("long")
    w = Window.partitionBy(part, "__range").orderBy(at, id_)
    e = dealt.withColumn("__balance", F.sum(step).over(w)).withColumn("__low", F.min("__balance").over(w)).withColumn("__starts", F.sum(F.col("__s").cast("long")).over(w)).withColumn("__n", F.row_number().over(w))
    of = e.groupBy(part, "__range").agg(F.sum(step).alias("__b"), F.min("__balance").alias("__l"), F.sum(F.col("__s").cast("long")).alias("__st"), F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(part).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    none = lambda c: F.coalesce(c, F.lit(0))
    of = of.withColumn("__b0", none(F.sum("__b").over(before))).withColumn("__s0", none(F.sum("__st").over(before))).withColumn("__n0", none(F.sum("__rows").over(before)))
    of = of.withColumn("__l0", F.least(F.lit(0), none(F.min(F.col("__b0") + F.col("__l")).over(before))))
    of = of.select(F.col(part).alias("__part"), F.col("__range").alias("__r"), "__b0", "__s0", "__n0", "__l0")
    e = e.join(of, F.col(part).eqNullSafe(F.col("__part")) & (F.col("__range") == F.col("__r")))
    least = F.least(F.col("__l0"), F.col("__b0") + F.col("__low"))
    e = e.withColumn("__least", least).withColumn("__was", F.coalesce(F.lag("__least").over(w), F.col("__l0")))
    starts = F.col("__s0") + F.col("__starts")
    ends = F.col("__n0") + F.col("__n") - starts
    k = F.when(F.col("__s"), starts).when(F.col("__least") < F.col("__was"), F.col("__least")).otherwise(ends + F.col("__least"))
    side = lambda cond, c: F.max(F.when(cond, F.col(c)))
    return e.withColumn("__k", k).groupBy(part, "__k").agg(
        side(F.col("__s"), id_).alias("start_id"), side(F.col("__s"), at).alias("start_at"), side(~F.col("__s"), id_).alias("end_id"), side(~F.col("__s"), at).alias("end_at")
    ).drop("__k")


def turn_spans(events: DataFrame, keys: list[str], at: str = "at", id_: str = "id") -> DataFrame:
    """A span per turn. It begins with the first start event, else the first human message, else the first event, and
    ends with the last completion or final answer that is not a human's. Without an end it is an open second; an end
    not after the start leaves a one-second point."""
    first = lambda cond: F.min(F.when(cond, F.struct(at, id_)))
    starts = (F.col("event_kind") == "lifecycle") & F.col("event_subtype").isin("turn_started", "task_started")
    ends = (F.col("event_kind") == "lifecycle") & F.col("event_subtype").isin("turn_complete", "task_complete")
    final = ~F.col("message_origin").eqNullSafe(F.lit("human")) & (F.col("phase") == "final_answer")
    g = events.groupBy(*keys).agg(
        first(starts).alias("s1"), first(F.col("message_origin") == "human").alias("s2"), first(F.lit(True)).alias("s3"),
        F.max(F.when(ends | final, F.struct(at, id_, ends.alias("life")))).alias("e"),
    ).withColumn("s", F.coalesce("s1", "s2", "s3"))
    return g.select(*keys, F.lit("turn").alias("span_kind"), *_span(F.col("s"), F.col("e"), at, id_, F.when(F.col("s1").isNotNull() & F.col("e.life"), "lifecycle").otherwise("estimated")))


def tool_spans(events: DataFrame, keys: list[str], at: str = "at", id_: str = "id") -> DataFrame:
    """A span per tool call: from the first call to the first result after it, else to the first result. A call
    without a result is open unless its status says completed; what is left is a one-second point.

    The group's call is found first and joined to its results by a second aggregation on the same keys, without a
    window over the group.
    """
    call = F.struct(at, id_, "tool_status")
    calls = events.filter("event_kind = 'tool_call'").groupBy(*keys).agg(F.min(call).alias("c"))
    results = events.filter("event_kind = 'tool_result'").select(*keys, F.struct(at, id_).alias("r"))
    both = results.join(calls, keys, "full")
    later = F.struct(F.col(f"r.{at}"), F.col(f"r.{id_}")) > F.struct(F.col(f"c.{at}"), F.col(f"c.{id_}"))
    g = both.groupBy(*keys).agg(F.min("c").alias("c"), F.min(F.when(later & (F.col(f"r.{at}") > F.col(f"c.{at}")), F.col("r"))).alias("r1"), F.min("r").alias("r2"))
    g = g.withColumn("r", F.coalesce("r1", "r2"))
    paired = F.col("c").isNotNull() & F.col("r").isNotNull() & (F.col(f"r.{at}") > F.col(f"c.{at}"))
    open_ = F.col("c").isNotNull() & F.col("r").isNull() & ~F.col("c.tool_status").eqNullSafe(F.lit("completed"))
    anchor = F.coalesce(F.col(f"c.{at}"), F.col(f"r.{at}"))
    return g.select(
        *keys, F.lit("tool").alias("span_kind"), anchor.alias("start_at"), F.when(paired, F.col(f"r.{at}")).otherwise(anchor + SECOND).alias("end_at"),
        F.coalesce(F.col(f"c.{id_}"), F.col(f"r.{id_}")).alias("start_id"), F.when(F.col("c").isNotNull(), F.col(f"r.{id_}")).alias("end_id"),
        F.when(paired, "interval").when(open_, "open").otherwise("point").alias("state"), F.when(paired, "paired_events").otherwise("estimated").alias("basis"),
    )


def task_spans(events: DataFrame, part: str, at: str = "at", id_: str = "id") -> DataFrame:
    """Spans of FIFO pairs; a completion without a start is a point."""
    p = fifo_pairs(events, part, at, id_, F.col("event_subtype") == "task_started")
    s = F.when(p["start_id"].isNotNull(), F.struct(p["start_at"].alias(at), p["start_id"].alias(id_))).otherwise(F.struct(p["end_at"].alias(at), p["end_id"].alias(id_)))
    e = F.when(p["start_id"].isNotNull() & p["end_id"].isNotNull(), F.struct(p["end_at"].alias(at), p["end_id"].alias(id_)))
    spans = p.select(part, "start_id", "end_id", s.alias("s"), e.alias("e"))
    out = spans.select(part, F.col("start_id").alias("__start"), F.lit("task").alias("span_kind"), *_span(F.col("s"), F.col("e"), at, id_, F.lit("lifecycle")))
    return out.withColumn("state", F.when(F.col("__start").isNull(), "point").otherwise(F.col("state"))).drop("__start")


def _span(start: Column, end: Column, at: str, id_: str, basis: Column) -> list[Column]:
    has = end.isNotNull()
    whole = has & (end[at] > start[at])
    return [
        start[at].alias("start_at"), F.when(whole, end[at]).otherwise(start[at] + SECOND).alias("end_at"), start[id_].alias("start_id"), end[id_].alias("end_id"),
        F.when(whole, "interval").when(has, "point").otherwise("open").alias("state"), F.when(whole, basis).otherwise("estimated").alias("basis"),
    ]
