"""Column functions of the activity model. Times are microseconds since 1970 (long) unless a name says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
BUCKET = 10 * MINUTE
DAY = 24 * 60 * MINUTE

_NATIVE_UUID7 = "^[a-z][a-z0-9]*_[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\\z"
_RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})\z"


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def uuid7_micros(id_: Column) -> Column:
    """The time in a native id, a kind and a lower-case version 7 UUID after an underscore, to the millisecond; null for
    anything else."""
    uuid = F.split_part(id_, F.lit("_"), F.lit(2))
    digits = F.concat(F.substring(uuid, 1, 8), F.substring(uuid, 10, 4))
    return F.when(id_.rlike(_NATIVE_UUID7), F.conv(digits, 16, 10).cast("long") * 1000)


def effective_at(native_id: Column, occurred: Column, observed: Column, received: Column) -> Column:
    return F.coalesce(uuid7_micros(native_id), occurred, observed, received)


def bucket_start(at: Column, width: int = BUCKET, anchor: int = 0) -> Column:
    return at - F.pmod(at - F.lit(anchor), F.lit(width))


def millisecond_floor(at: Column) -> Column:
    return at - F.pmod(at, F.lit(1000))


def rfc3339_micros(text: Column) -> Column:
    """Microseconds of an RFC 3339 time with at most six fraction digits; null for other shapes and impossible dates."""
    return F.when(text.rlike(_RFC3339), F.unix_micros(F.try_to_timestamp(text)))


def rfc3339_text(at: Column) -> Column:
    whole = F.timestamp_seconds(F.floor(at / SECOND))
    return F.concat(F.date_format(F.to_utc_timestamp(whole, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad(F.pmod(at, F.lit(SECOND)).cast("string"), 6, "0"), F.lit("Z"))


def effective_role(role: Column, has_parent: Column) -> Column:
    """An unknown actor with a resolved parent is a worker."""
    return F.when((role == "unknown") & has_parent, "worker").otherwise(role)


def semantic_role(role: Column) -> Column:
    return F.when(role == "primary", "agent").when(role.isin("worker", "guardian"), "subagent").otherwise("unclassified")


def trimmed(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def display_name(name: Column, key: Column) -> Column:
    return F.coalesce(F.nullif(F.btrim(name), F.lit("")), key)


def in_domain(email: Column, domain: str) -> Column:
    return (F.split_part(email, F.lit("@"), F.lit(2)) == domain) & (F.split_part(email, F.lit("@"), F.lit(3)) == "")


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def byte_size(text: Column) -> Column:
    return F.octet_length(text)


def excerpt(text: Column, most: int = 1024) -> Column:
    """The longest start of at most `most` UTF-8 bytes that cuts no character; where three of a character's four bytes would
    fit, U+FFFD, which has three, stands for it."""
    raw = text.cast("binary")
    # A cut character shows at the first byte left out: it continues one. Step back to where it began.
    continues = lambda at: F.substring(F.hex(F.substring(raw, at + 1, 1)), 1, 1).isin("8", "9", "A", "B")
    end = F.lit(most)
    for back in (3, 2, 1):
        steps = continues(F.lit(most))
        for k in range(1, back):
            steps &= continues(F.lit(most - k))
        end = F.when(steps & (end == most), F.lit(most - back)).otherwise(end)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.decode(F.substring(raw, F.lit(1), end), "UTF-8"), F.when(end == most - 3, "\uFFFD").otherwise("")))


def truncated(size: Column, shown: Column) -> Column:
    return size > F.octet_length(shown)


def base64url(data: Column) -> Column:
    return F.rtrim(F.translate(F.base64(data), "+/=\n\r", "-_ "))


def encode_uri_component(text: Column) -> Column:
    out = F.url_encode(text)
    for coded, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def collector_key(prefix: str, email: Column, installation: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.concat(email, F.lit("\0"), installation).cast("binary"), 256), 1, 32))


def tokens(text: Column) -> Column:
    return F.split(F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def has_token(text: Column, token: str) -> Column:
    return F.array_contains(tokens(text), token.lower())


def recency(latest: Column, now: Column) -> Column:
    """How recent a time is; one after now is an error."""
    age = now - latest
    return F.when(age < 0, F.raise_error(F.lit("a time lies after now")).cast("string")).when(age <= 10 * MINUTE, "active").when(age <= 30 * MINUTE, "recent").otherwise("inactive")


def cumulative_usage(total_input: Column, cached: Column, total_output: Column, reasoning: Column, total: Column) -> Column:
    """Token counts as disjoint parts; null where they contradict each other."""
    ok = (cached <= total_input) & (reasoning <= total_output) & (total_input + total_output == total) & (F.least(total_input, cached, total_output, reasoning) >= 0)
    return F.when(ok, F.struct((total_input - cached).alias("input"), cached.alias("cached"), (total_output - reasoning).alias("output"), reasoning.alias("reasoning"), total.alias("total")))


def message_usage(plain: Column, read: Column, created: Column, output: Column) -> Column:
    return F.struct(plain.alias("input"), (read + created).alias("cached"), output.alias("output"), (plain + read + created + output).alias("total"))


def workload_class(hint: Column, last_occurred: Column, committed: Column) -> Column:
    return F.coalesce(hint, F.when(last_occurred < committed - DAY, "backfill").otherwise("live"))


def backoff(attempt: Column, base: int = 5, most: int = 300) -> Column:
    return F.least(F.lit(most), base * F.pow(F.lit(2), attempt - 1)).cast("long")


def json_integer(doc: Column, path: str) -> Column:
    """An integer member; null for text, fractions, true and false, which a cast would let through."""
    found = F.get_json_object(doc, path)
    return F.when(found.rlike(r"^-?\d{1,16}(\.0+)?\z"), F.regexp_replace(found, r"\.0+$", "").cast("long"))


def valid_email(email: Column) -> Column:
    """One @ with something on both sides, no white space or control characters, no dot at the domain's ends."""
    return email.rlike(r"^[^@\s\x00-\x1f]+@[^@\s\x00-\x1f.]([^@\s\x00-\x1f]*[^@\s\x00-\x1f.])?\z")


def workspace_of(email: Column, workspaces: dict[str, str]) -> Column:
    """The workspace that an address's domain belongs to; null where it belongs to none."""
    domain = F.split_part(email, F.lit("@"), F.lit(2))
    out = F.lit(None).cast("string")
    for name, workspace in workspaces.items():
        out = F.when(domain == name, workspace).otherwise(out)
    return out


def lane(active_live: Column, active_backfill: Column, concurrency: int, live_reserved: int) -> Column:
    """What to take next: live work up to its reserve, then backfill up to the rest, then live."""
    return F.when(active_live < live_reserved, "live").when(active_backfill < concurrency - live_reserved, "backfill").otherwise("live")
