"""Frame evidence: what of a session's events counts in a window, as rows that revisions are kept of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import DAY, MINUTE, SECOND, bucket_start, uuid7_micros
from ..sources.scratch import written
from . import grid
from .canonical import activity, latest_per_key
from .detail import prompt_candidates, prompt_sources
from .pairing import ADJACENT_TOLERANCE, ASSISTANT_TOLERANCE, CONTEXT, PROMPT_TOLERANCE, adjacent_copies, submitted_form, tolerance_pairs, without
from .predicates import is_activity, is_conversation_source, is_prompt, of_versions
from .revisions import diff_revisions, latest_revision
from .sessions import coordinates

COVERED = 26 * 60 * MINUTE
PADDING = 6 * SECOND

EVIDENCE_KEYS = ["evidence_kind", "source_event_id"]
EVIDENCE_VALUES = ["person_id", "session_id", "anchor_observed_at", "observed_at", "actor_role", "event_kind", "event_subtype", "message_role", "message_origin", "prompt_identity", "is_summary_candidate"]


def representation_copies(events: DataFrame, at: str = "effective_at") -> DataFrame:
    """id of activity that only repeats other activity.

    A message recorded in two forms within the tolerance is one: if each has no other partner, the assistant's announced
    form and the user's structured form go. Of two neighbouring records of one submitted message the second goes."""
    e = events.filter(is_conversation_source()).withColumn("said_at", F.col(at))
    structured = lambda role: (F.col("event_kind") == "message") & (F.col("event_subtype") == "message") & (F.col("message_role") == role) & (F.col("native_type") == "response_item") & (F.col("native_payload_type") == "message")
    announced = (F.col("event_kind") == "agent_message") & (F.col("event_subtype") == "agent_message") & (F.col("message_role") == "assistant") & (F.col("native_type") == "event_msg") & (F.col("native_payload_type") == "agent_message") & F.col("native_item_id").isNull()
    submitted = (F.col("event_kind") == "message") & (F.col("message_role") == "user") & submitted_form()
    # Both kinds of pairs are one join: a form's role is a key, and so is how many slots of the tolerance apart they may be.
    of = lambda cond, role: e.filter(cond).select("id", "said_at", *CONTEXT, F.lit(role).alias("__role"))
    exact = [c for c in CONTEXT if c != "scope_key"]
    whole = F.lit(True)
    for c in exact:
        whole &= F.col(c).isNotNull()
    keys = [*CONTEXT, "__role"]
    pair = lambda left, right, tolerance: tolerance_pairs(left.filter(whole), right.filter(whole), keys, tolerance, "said_at", "said_at")
    assistant = pair(of(announced, "assistant"), of(structured("assistant"), "assistant"), ASSISTANT_TOLERANCE).withColumn("gone", F.col("left_id"))
    user = pair(of(submitted, "user"), of(structured("user"), "user"), PROMPT_TOLERANCE).withColumn("gone", F.col("right_id"))
    pairs = assistant.unionByName(user)
    degree = lambda side: F.count(F.lit(1)).over(Window.partitionBy(side))
    twice = pairs.withColumn("a", degree("left_id")).withColumn("b", degree("right_id")).filter("a = 1 AND b = 1").select(F.col("gone").alias("id"))
    said = e.filter(submitted)
    same = ["person_id", "session_id", "actor_role", "stored_actor_role", "content_sha256", "scope_key"]
    again = adjacent_copies(said, "batch_id", "record_index", same, "said_at", ADJACENT_TOLERANCE, "start_offset", "end_offset", ("scope_key",))
    return twice.unionByName(said.join(again, ["batch_id", "record_index"], "left_semi").select("id")).distinct()


def about(events: DataFrame, start: int, end: int, versions: tuple[str, ...]) -> DataFrame:
    """The events that evidence() of [start, end) reads: activity and prompts of the padded window, by any of their times."""
    # Said with one use of the time, as that of a native id is dear to read. The window's end comes too; evidence() cuts it.
    near = lambda c: F.abs(2 * c - (start + end)) <= end - start + 2 * PADDING
    source, native = F.coalesce("occurred_at", "observed_at", "received_at"), uuid7_micros(F.col("native_item_id"))
    return events.filter(of_versions(versions) & (is_activity() | is_prompt()) & (F.coalesce(near(source), F.lit(False)) | near(native)))


def evidence(events: DataFrame, sessions: DataFrame, start: int, end: int, versions: tuple[str, ...]) -> DataFrame:
    """Activity and prompts of [start, end): EVIDENCE_KEYS and EVIDENCE_VALUES.

    Winners are chosen over the padded window, then session starts and copies cut, and the window last, so that what lies
    just outside still takes part in the choice. Prompts are told apart within a session here, across sessions by readers.
    """
    active = written(activity(events, sessions, start - PADDING, end + PADDING, versions), "activity")  # it is read for copies too
    active = without(active, representation_copies(active), ["id"]).filter((F.col("effective_at") >= start) & (F.col("effective_at") < end))
    submitted = (F.col("event_subtype") == "user_message") & (F.col("message_role") == "user") & F.col("message_origin").isin("human", "parent_agent") & F.col("content_excerpt").isNotNull()
    said = prompt_sources(prompt_candidates(events, start, end, versions, PADDING)).filter((F.col("prompt_at") >= start) & (F.col("prompt_at") < end))
    row = lambda kind, anchor, at, identity, candidate: [F.lit(kind).alias("evidence_kind"), F.col("id").alias("source_event_id"), "person_id", "session_id", F.col(anchor).alias("anchor_observed_at"), F.col(at).alias("observed_at"), "actor_role", "event_kind", "event_subtype", "message_role", "message_origin", identity.alias("prompt_identity"), F.coalesce(candidate, F.lit(False)).alias("is_summary_candidate")]
    a = active.select(row("activity", "effective_at", "effective_at", F.lit(None).cast("string"), submitted))
    return a.unionByName(said.select(row("prompt", "source_at", "prompt_at", F.col("prompt_identity"), F.lit(False))))


def projection_run(coordinates: DataFrame, receipts: DataFrame, now: int, projector: str) -> tuple[DataFrame, DataFrame]:
    """(sessions that may be projected, receipts to append) from source coordinates (session_id, last_id, n,
    last_future_id) and the receipts so far. A session with an event in the future is refused until its time has come; a
    receipt that says what the last one said is not written again."""
    start, end = covered(now)
    ready = coordinates.filter(F.col("last_future_id").isNull())
    want = ready.select("session_id", "last_id", "n", F.lit(projector).alias("projector_version"), F.lit(start).alias("covered_from"), F.lit(end).alias("covered_through"))
    values = [c for c in want.columns if c != "session_id"]
    last = latest_per_key(receipts.select("session_id", "receipt_id", *values), ["session_id"], ["receipt_id"]).select("session_id", F.struct(*values).alias("__last"))
    fresh = want.join(last, "session_id", "left").filter(~F.struct(*values).eqNullSafe(F.col("__last"))).drop("__last")
    return ready.select("session_id"), fresh


RECEIPT = "session_id long, last_id long, n long, projector_version string, covered_from long, covered_through long, receipt_id long"
REVISION = "evidence_kind string, source_event_id long, person_id long, session_id long, anchor_observed_at long, observed_at long, actor_role string, event_kind string, event_subtype string, message_role string, message_origin string, prompt_identity string, is_summary_candidate boolean, is_tombstone boolean, revision_id long"


def _store(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(path)
    return rows if before is None else rows.filter(F.col(schema.split()[-2]) < before)


def evidence_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Receipts and revisions of a store. A revision counts once its run has a receipt, so a run that was lost halfway through
    shows nothing."""
    receipts = _store(spark, f"{path}/receipts", RECEIPT)
    done = receipts.select(F.col("receipt_id").alias("revision_id"), "session_id").distinct()
    return receipts, _store(spark, f"{path}/revisions", REVISION).join(done, ["revision_id", "session_id"], "left_semi").select(*[x.strip().split()[0] for x in REVISION.split(",")])


def run_projection(events: DataFrame, sessions: DataFrame, path: str, now: int, versions: tuple[str, ...], run: int, projector: str = "frame.v1") -> DataFrame:
    """One run over all sessions: the receipts that it appends to the store at path, whose run number they bear.

    Sessions with an event after what the run covers are refused until their time has come; one whose last receipt says the
    same is left alone. Of the others the evidence of the covered window is held against the last revisions of that window,
    and what has changed, is new or has gone is appended: first the revisions, then the receipts that make them count. A run
    that is done again replaces its own rows and no other, so it writes the same.
    """
    spark = events.sparkSession
    start, end = covered(now)
    known = events.filter(of_versions(versions))
    read, _ = evidence_store(spark, path)
    read = read.filter(F.col("receipt_id") < run)
    at = coordinates(known, until=end + PADDING)
    _, fresh = projection_run(at, read, now, projector)
    fresh = written(fresh, "fresh")
    mine = lambda df: df.join(fresh.select("session_id"), "session_id", "left_semi")
    # Activity and prompts, and copies of either, are told from these few: the history is read for them once.
    desired = evidence(written(mine(about(events, start, end, versions)), "about"), sessions, start, end, versions)
    before = _store(spark, f"{path}/revisions", REVISION, run).join(read.select(F.col("receipt_id").alias("revision_id"), "session_id").distinct(), ["revision_id", "session_id"], "left_semi")
    last = latest_revision(mine(before), EVIDENCE_KEYS, drop_tombstones=False)
    last = last.filter((F.col("observed_at") >= start) & (F.col("observed_at") < end))
    changes = diff_revisions(desired, last, EVIDENCE_KEYS, EVIDENCE_VALUES)
    # A tombstone says what it ends, so that it is found by session and window.
    ended = last.select(*[F.col(k).alias(f"__{k}") for k in EVIDENCE_KEYS], F.col("session_id").alias("__session"), F.col("observed_at").alias("__at"), F.col("person_id").alias("__person"))
    on = F.col("is_tombstone")
    for k in EVIDENCE_KEYS:
        on &= F.col(k) == F.col(f"__{k}")
    changes = changes.join(ended, on, "left")
    changes = changes.withColumns({"session_id": F.coalesce("session_id", "__session"), "observed_at": F.coalesce("observed_at", "__at"), "person_id": F.coalesce("person_id", "__person"), "revision_id": F.lit(run).cast("long")})
    put = lambda df, name: df.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{path}/{name}")
    put(changes.select(*[F.col(x.strip().split()[0]).cast(x.strip().split()[1]) for x in REVISION.split(",")]), "revisions")
    put(fresh.withColumn("receipt_id", F.lit(run).cast("long")).select(*[F.col(x.strip().split()[0]).cast(x.strip().split()[1]) for x in RECEIPT.split(",")]), "receipts")
    return _store(spark, f"{path}/receipts", RECEIPT).filter(F.col("receipt_id") == run)


def covered(now: int) -> tuple[int, int]:
    """The window that a projection run answers for: the last 26 hours up to the bucket that holds `now`."""
    end = now - now % (10 * MINUTE) + 10 * MINUTE
    return end - COVERED, end


def activation_ready(staleness: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row, ready: nothing is stale and no job blocks."""
    stale = staleness.agg(F.count(F.lit(1)).alias("n_stale"))
    blocking = jobs.filter(F.col("status").isin("ready", "retry", "running", "dead")).agg(F.count(F.lit(1)).alias("n_blocking"))
    return stale.join(blocking, F.lit(True)).withColumn("ready", (F.col("n_stale") == 0) & (F.col("n_blocking") == 0))  # single rows


def day_window(now: int) -> tuple[int, int]:
    """The 24 hours that end with the last whole bucket."""
    end = now - now % (10 * MINUTE)
    return end - DAY, end


def projected_facts(revisions: DataFrame, start: int, end: int, now: int) -> dict[str, DataFrame]:
    """From evidence revisions (revision_id, is_tombstone beside EVIDENCE_KEYS and EVIDENCE_VALUES) what a day grid
    needs: buckets, day, prompts, latest. The last revision of each key counts, and only then do tombstones go; prompts
    are told apart across sessions."""
    last = latest_revision(revisions, EVIDENCE_KEYS)
    active = last.filter("evidence_kind = 'activity'").withColumnRenamed("observed_at", "effective_at")
    first = F.min(F.struct("observed_at", "source_event_id"))["observed_at"].alias("observed_at")
    prompts = last.filter((F.col("evidence_kind") == "prompt") & (F.col("observed_at") >= start) & (F.col("observed_at") < end)).groupBy("person_id", "prompt_identity").agg(first)
    return {
        "buckets": grid.bucket_activity(active, start, end),
        "day": grid.day_totals(active, start, end),
        "prompts": prompts.groupBy("person_id", bucket_start(F.col("observed_at"), anchor=start).alias("bucket_at")).agg(F.count(F.lit(1)).alias("prompts")),
        "latest": grid.latest_activity(active.filter(F.col("effective_at") >= start), now),
    }


def projected_grid(revisions: DataFrame, roster: DataFrame, start: int, end: int, now: int) -> DataFrame:
    """The day grid from projected evidence, as the raw one but for copies of one message, which were left out before."""
    return grid.bucket_grid(roster, list(projected_facts(revisions, start, end, now).values()), start, end)
