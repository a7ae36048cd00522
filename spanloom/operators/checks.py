"""Rules that stored rows must keep: each gives the rows that break it, and none may."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..sources import scratch

#: Name, and SQL that is true of a good row.
RANGES = {"positive range": "start < end", "size": "n_bytes = end - start", "hash": "sha256 RLIKE '^[0-9a-f]{64}$'"}
EVENTS = {
    "key has a scope": "logical_event_key IS NULL OR scope_key IS NOT NULL",
    "excerpt is short": "content_excerpt IS NULL OR octet_length(content_excerpt) <= 1024",
    "content is whole": "(content_sha256 IS NULL) = (content_bytes IS NULL)",
}
REVISIONS = {"prompt has an identity": "(evidence_kind = 'prompt') = (prompt_identity IS NOT NULL)"}


def broken(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """The rows that break a rule, with all rules that each breaks; unknown counts as broken."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(rule), F.lit(False)), name) for name, rule in rules.items()]))
    return df.withColumn("broken", found).filter(F.size("broken") > 0)


def incomplete_people(grid: DataFrame, buckets: int = 144) -> DataFrame:
    """People of a day grid without exactly one row per bucket."""
    n = grid.groupBy("person_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("bucket_at").alias("d"))
    return n.filter((F.col("n") != buckets) | (F.col("d") != buckets))


def beyond_day(grid: DataFrame) -> DataFrame:
    """Buckets that count more sessions of a role than their whole day."""
    return grid.filter("agents > day_agents OR subagents > day_subagents OR others > day_others")


#: What a day grid's rows keep.
GRID = {
    "bucket within day": "agents <= day_agents AND subagents <= day_subagents AND others <= day_others",
    "counts": "least(agents, subagents, others, prompts) >= 0",
    "named": "person_id IS NOT NULL AND display_name IS NOT NULL",
}


class BrokenRules(ValueError):
    """Rules that a result breaks; counts has how many rows break each, -1 for one about the whole."""

    def __init__(self, counts: dict[str, int]):
        super().__init__("broken: " + ", ".join(sorted(counts)))
        self.counts = counts


def published(df: DataFrame, label: str, rules: dict[str, str], whole: dict[str, str] | None = None) -> DataFrame:
    """df, written once and read from there, if all its rows keep `rules` (SQL) and it keeps `whole` (SQL over aggregates); else
    what was written goes, and BrokenRules is raised. Rows are checked as they are written, so nothing is read twice, and
    no one sees a result that breaks a rule."""
    seen, whole = Observation(), whole or {}
    bad = [F.count_if(~F.coalesce(F.expr(rule), F.lit(False))).alias(f"r{i}") for i, rule in enumerate(rules.values())]
    kept = [F.coalesce(F.expr(rule), F.lit(False)).alias(f"w{i}") for i, rule in enumerate(whole.values())]
    path = scratch.write(df.observe(seen, *bad, *kept), label)
    found = seen.get
    counts = {name: found[f"r{i}"] for i, name in enumerate(rules) if found[f"r{i}"]} | {name: -1 for i, name in enumerate(whole) if not found[f"w{i}"]}
    if counts:
        scratch.delete(df.sparkSession, path)
        raise BrokenRules(counts)
    return df.sparkSession.read.schema(df.schema).parquet(path)
