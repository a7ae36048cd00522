"""What happened in one interval: work summaries, prompts and pages of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import semantic_role, uuid7_micros
from .canonical import KEYS, canonical, keyed
from .pairing import ADJACENT_TOLERANCE, PROMPT_TOLERANCE, SOURCE, submitted_form
from .predicates import is_prompt, of_versions


def summary(at: str = "effective_at", text: str = "content_excerpt") -> Column:
    """The first shown text that a human or a parent agent submitted."""
    submitted = (F.col("event_subtype") == "user_message") & (F.col("message_role") == "user") & F.col("message_origin").isin("human", "parent_agent") & F.col(text).isNotNull()
    return F.min(F.when(submitted, F.struct(at, "id", text)))[text].alias("summary")


def work_groups(activity: DataFrame, at: str = "effective_at", text: str = "content_excerpt") -> DataFrame:
    """Per person, session and semantic role: first and last time, count and summary."""
    with_role = activity.withColumn("semantic_role", semantic_role(F.col("actor_role")))
    return with_role.groupBy("person_id", "session_id", "semantic_role").agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count(F.lit(1)).alias("n_events"), summary(at, text))


def interval_work(activity: DataFrame, start: int, end: int, most: int = 200, at: str = "effective_at", text: str = "content_excerpt") -> DataFrame:
    """The work of an interval; the first `most` groups and one more, by which a caller sees that there are too many."""
    inside = activity.filter((F.col(at) >= start) & (F.col(at) < end))
    return work_groups(inside, at, text).orderBy("first_at", "session_id", "semantic_role").limit(most + 1)


def work_detail(activity: DataFrame, session_id: Column, role: str, start: int, end: int, cursor: tuple, size: int, at: str = "effective_at", text: str = "content_excerpt") -> DataFrame:
    """One session's work in an interval: its header beside each message of the page after the cursor, or alone where the
    page is empty; the lone header comes first."""
    inside = activity.filter((F.col(at) >= start) & (F.col(at) < end) & (F.col("session_id") == session_id) & (semantic_role(F.col("actor_role")) == role))
    said = F.col("event_kind").isin("message", "agent_message") & ((F.col("message_role") == "assistant") | ((F.col("message_role") == "user") & F.col("message_origin").isin("human", "parent_agent")))
    page = keyset_page(inside.filter(said).select("id", at, "message_role", "content_bytes", text), [at, "id"], cursor, size)
    return header_and_page(work_groups(inside, at, text), page).orderBy(F.col(at).asc_nulls_first(), F.col("id").asc_nulls_first())


def after(cursor: tuple, columns: list[str]) -> Column:
    """Rows after the cursor in the order of columns."""
    return F.struct(*columns) > F.struct(*[F.lit(v).alias(c) for v, c in zip(cursor, columns, strict=True)])


def keyset_page(df: DataFrame, order: list[str], cursor: tuple | None, size: int) -> DataFrame:
    """The next page and one row more. The filter on the leading column reaches the scan; the rest is a top-n."""
    if cursor is not None:
        df = df.filter((F.col(order[0]) >= cursor[0]) & after(cursor, order))
    return df.orderBy(*order).limit(size + 1)


def people_page(people: DataFrame, after_id: str | None, size: int = 20, id_: str = "person_id") -> DataFrame:
    """The next page of people by id, and one more by which a caller sees that there is another page."""
    return keyset_page(people, [id_], None if after_id is None else (after_id,), size)


def capped(df: DataFrame, order: list[str | Column], most: int) -> DataFrame:
    """df in order; an error where it has more than `most` rows. Only one row more than that is looked at."""
    first = df.orderBy(*order).limit(most + 1)
    if first.count() > most:
        raise ValueError(f"more than {most} rows")
    return first


def with_payload(page: DataFrame, payload: DataFrame, key: str) -> DataFrame:
    """Payload columns for the rows of a page: ids are chosen first, and texts are fetched for those only."""
    return payload.join(F.broadcast(page), key)  # a page has at most its size + 1 rows


def header_and_page(header: DataFrame, page: DataFrame) -> DataFrame:
    """One header beside each row of the page, or alone where the page is empty."""
    return header.join(page, F.lit(True), "left")  # one row against a page


def prompt_candidates(events: DataFrame, start: int, end: int, versions: tuple[str, ...], padding: int = PROMPT_TOLERANCE) -> DataFrame:
    """Prompts about a window: by their own time or by that of their native id, with the pairing tolerance around it.
    source_at is the time that the source gives, native_at that of the native id."""
    e = events.filter(is_prompt() & of_versions(versions))
    e = e.withColumn("source_at", F.coalesce("occurred_at", "observed_at", "received_at")).withColumn("native_at", uuid7_micros(F.col("native_item_id")))
    near = lambda c: (F.col(c) >= start - padding) & (F.col(c) < end + padding)
    return e.filter(near("source_at") | near("native_at"))


def _plain() -> Column:
    return F.col("logical_event_key").isNull() & F.col("turn_id").isNull()


def _repeats() -> Column:
    """Whether a submitted prompt without key, turn and native id is what the record before it says, right before it."""
    form = submitted_form() & _plain()
    before = lambda c: F.lag(c).over(Window.partitionBy("batch_id").orderBy("record_index", "id"))
    same = F.struct("session_id", "event_kind", "content_sha256", "scope_key", form.alias("form"))
    follows = (before("record_index") + 1 == F.col("record_index")) & (before("end_offset") == F.col("start_offset"))
    return F.coalesce(form & before(same).eqNullSafe(same) & follows & (F.abs(F.col("source_at") - before("source_at")) <= ADJACENT_TOLERANCE), F.lit(False))


def _paired(prompts: DataFrame, native: DataFrame) -> DataFrame:
    """prompts with paired_native_id and paired_at: of a loose prompt, the one native message that must be the same.

    Partners are counted in a range of time on either side, so pairs are never listed: a prompt with one native message in
    range, which has one prompt in its range, is paired with it. Both lie in one partition of the keys, and both windows share
    its shuffle. Equality is SQL's, so rows with a null among the keys have no partner."""
    keys = ["session_id", "content_sha256", *SOURCE]
    whole = _plain()
    for c in keys:
        whole &= F.col(c).isNotNull()
    sides = prompts.withColumn("__asks", F.col("__loose") & whole).withColumn("__named", F.lit(None).cast("string")).withColumn("__named_at", F.lit(None).cast("long"))
    offers = native.filter(whole).select(*keys, "source_at", F.lit(False).alias("__asks"), F.col("native_item_id").alias("__named"), F.coalesce("native_at", "source_at").alias("__named_at"))
    both = sides.unionByName(offers, allowMissingColumns=True)
    near = Window.partitionBy(*keys).orderBy("source_at").rangeBetween(-PROMPT_TOLERANCE, PROMPT_TOLERANCE)
    counted = both.withColumns({
        "__n_named": F.count("__named").over(near), "__n_asking": F.count(F.when(F.col("__asks"), 1)).over(near), "paired_native_id": F.max("__named").over(near), "paired_at": F.max("__named_at").over(near),
    })
    back = F.max(F.when(F.col("__named").isNotNull(), F.col("__n_asking"))).over(near)
    found = counted.withColumn("__back", back).filter("__named IS NULL")
    one = F.col("__asks") & (F.col("__n_named") == 1) & (F.col("__back") == 1)
    return found.withColumns({c: F.when(one, F.col(c)) for c in ("paired_native_id", "paired_at")}).drop("__asks", "__named", "__named_at", "__n_named", "__n_asking", "__back")


def prompt_sources(candidates: DataFrame) -> DataFrame:
    """The candidates that stand for a prompt, with prompt_identity and prompt_at.

    Of a keyed group the preferred event stands, if any of the group was submitted; its identity is the group's greatest
    native id of a message, else the key. Of other events submitted ones stand that repeat no record; their identity is
    their own native id, their pair's, else the event. Windows only: by key, by batch and by source."""
    group = Window.partitionBy(*KEYS)
    native = F.when(F.col("event_subtype") == "message", F.col("native_item_id"))
    submitted = F.col("event_subtype").eqNullSafe(F.lit("user_message"))
    held = candidates.withColumn("__native", F.when(keyed(), F.max(native).over(group))).withColumn("__submitted", F.max(submitted).over(group))
    chosen = canonical(held).withColumn("__loose", ~keyed() & submitted & ~_repeats())
    e = _paired(chosen, candidates.filter((F.col("event_subtype") == "message") & F.col("native_item_id").isNotNull()))
    stands = e.filter(F.when(keyed(), F.col("__submitted")).otherwise(F.col("__loose")))
    own = F.when(keyed(), F.col("__native")).otherwise(F.coalesce("native_item_id", "paired_native_id"))
    key = F.concat_ws(":", F.lit("logical"), "scope_key", "normalizer_version", "logical_event_key", "event_kind")
    identity = F.coalesce(F.concat(F.lit("native:"), own), F.when(keyed(), key).otherwise(F.concat(F.lit("event:"), F.col("id").cast("string"))))
    at = F.coalesce(F.when(keyed(), uuid7_micros(F.col("__native"))).otherwise(F.coalesce("native_at", "paired_at")), F.col("source_at"))
    return stands.withColumns({"prompt_identity": identity, "prompt_at": at}).drop("__native", "__submitted", "__loose", "paired_native_id", "paired_at")


def ranked_prompts(sources: DataFrame) -> DataFrame:
    """The first of each person's prompts with one identity, across sessions."""
    w = Window.partitionBy("person_id", "prompt_identity").orderBy("prompt_at", "source_at", "id")
    return sources.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def prompts(events: DataFrame, start: int, end: int, versions: tuple[str, ...]) -> DataFrame:
    """A window's prompts, one for each identity of a person."""
    inside = (F.col("prompt_at") >= start) & (F.col("prompt_at") < end)
    return ranked_prompts(prompt_sources(prompt_candidates(events, start, end, versions))).filter(inside)


def visible(df: DataFrame, snapshot: Column, commit: str = "commit_id") -> DataFrame:
    """Rows committed at or before a snapshot: appends carry growing commit numbers."""
    return df.filter(F.col(commit) <= snapshot)
