"""Line dedup: later copies of repeated line runs are deleted.

Each text is a sequence of line ids (blank lines are left out and left alone). Suffixes of the sequences are ranked by
prefix doubling: ranks by one line, then by two, four and so on, each round ranking pairs of the last round's ranks.
Suffixes of equal rank at depth d are an interval of the suffix array with longest common prefix of at least d, so an
interval's earliest member is the copy that stays and the others start a later copy of d lines.

A run counts if it holds MIN_WORDS words. A line lies in such a run exactly if it lies in one of at most MIN_WORDS lines,
as each line has a word, so doubling ends at that depth: deeper ranks only split intervals that are repeated runs
already. Depths between powers of two are pairs of overlapping ranks.

Lines that stand once leave after the first round, as no repeated run holds them. Ranks need an order over all lines,
but no task sees it whole: equal pairs are folded into counts first, and positions are summed over BUCKETS ranges of
the second rank and then within a range.

Order of copies: doc_id (null last), hash of the text, line. Rows equal in doc_id and text are one document and get the
same result. Null text has no lines and stays null; a text whose lines all go becomes empty. Lines end at \\n only.
An empty table gives an empty table. DataFrame functions only.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, materialize, pack, recording, remove

MIN_WORDS = 5
BUCKETS = 1 << 14
_DOC = ["id", "hash"]


def _position() -> Column:
    return F.struct(F.col("id").isNull().alias("null"), F.col("id"), F.col("hash"), F.col("j"))


def _ranked(classes: DataFrame, group: str, value: str, bucket: Column) -> DataFrame:
    """classes with before: the rows (n) of the group's classes that come before by value. bucket follows the order of
    value and has at most BUCKETS values, so neither window holds more than the classes of one range of one group or
    the ranges of one group."""
    classes = classes.withColumn("__b", bucket)
    ranges = classes.groupBy(group, "__b").agg(F.sum("n").alias("__n"))
    over_ranges = Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col(group).alias("__g"), F.col("__b").alias("__c"), F.coalesce(F.sum("__n").over(over_ranges), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(group, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    own = classes.withColumn("__own", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    both = own.join(ranges, (F.col(group) == F.col("__g")) & (F.col("__b") == F.col("__c")))
    return both.withColumn("before", F.col("__before") + F.col("__own")).drop("__b", "__g", "__c", "__before", "__own")


def _lines(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """id, hash (of the text), j (number among lines with a word), i (number of the line), words, line (its id)."""
    every = F.transform(F.split(F.col(text), "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    slim = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"), F.posexplode(F.filter(every, lambda s: s["x"].rlike(WORD))).alias("j", "s"))
    # The ends of a line with a word can't be words, so its words are one more than the gaps within.
    count = F.size(F.split(F.regexp_replace("s.x", f"^{SPACE}|{SPACE}$", ""), SPACE))
    return slim.select("id", "hash", "j", F.col("s.i").alias("i"), count.alias("words"), F.xxhash64("s.x").alias("line"))


def _suffix_ranks(active: DataFrame, total: int, depth: int) -> DataFrame:
    """active with r0, r1, ...: the rank by 2 ** k lines, null where fewer active lines follow."""
    k = 0
    ahead = lambda c, d: F.first(c).over(Window.partitionBy(*_DOC).orderBy("j").rangeBetween(d, d))
    while 2 ** (k + 1) <= depth:
        pairs = active.withColumn("__next", ahead(f"r{k}", 2**k))
        classes = pairs.filter(F.col("__next").isNotNull()).groupBy(F.col(f"r{k}").alias("a"), F.col("__next").alias("b")).agg(F.count(F.lit(1)).alias("n"))
        classes = _ranked(classes, "a", "b", F.floor(F.col("b") * float(BUCKETS) / (total + 1)).cast("int"))
        classes = classes.select("a", "b", (F.col("a") + F.col("before")).alias(f"r{k + 1}"))
        active = materialize(pairs.join(classes, (F.col(f"r{k}") == F.col("a")) & (F.col("__next") == F.col("b")), "left").drop("a", "b", "__next"), "ranks")
        k += 1
    return active


def repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """id, hash (of the text), gone: sorted numbers of the lines that are later copies, for each text that has any."""
    with recording() as made:
        gone = materialize(_repeated_lines(docs, text, doc_id, min_words), "gone")
    remove(docs.sparkSession, made[:-1])
    return gone


def _repeated_lines(docs: DataFrame, text: str, doc_id: str, min_words: int) -> DataFrame:
    lines = materialize(_lines(docs, text, doc_id), "lines")
    ids = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.min(_position()).alias("first")).filter("n > 1")
    ids = materialize(ids, "ids")
    total = ids.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # Line ids are hashes, spread evenly, so their leading bits are the ranges.
    ranked = _ranked(ids.withColumn("all", F.lit(0)), "all", "line", F.shiftright("line", 64 - (BUCKETS - 1).bit_length()).cast("int"))
    active = lines.join(ranked.select(F.col("line").alias("__l"), F.col("before").alias("r0"), "first"), F.col("line") == F.col("__l")).select("id", "hash", "j", "i", "words", "r0", "first")
    active = materialize(active.dropDuplicates([*_DOC, "j"]), "active")
    found = active.filter((F.col("words") >= min_words) & (_position() > F.col("first"))).select("id", "hash", F.array("i").alias("gone"))

    # Longer runs, for lines too short to count alone.
    suffixes = _suffix_ranks(active.drop("first"), total, min_words)
    ahead = lambda c, d: F.first(c).over(Window.partitionBy(*_DOC).orderBy("j").rangeBetween(d, d)) if d else F.col(c)
    runs = []
    for size in range(2, min_words + 1):
        k = size.bit_length() - 1
        counts = [ahead("words", d) for d in range(size)]
        wanted = (functools.reduce(operator.add, counts) >= min_words) & (F.least(*counts) < min_words)
        x, y = F.col(f"r{k}"), ahead(f"r{k}", size - 2**k)
        runs.append(F.when(wanted & x.isNotNull() & y.isNotNull(), F.struct(F.lit(size).alias("size"), x.alias("x"), y.alias("y"), F.array(*[ahead("i", d) for d in range(size)]).alias("gone"))))
    runs = suffixes.select("id", "hash", "j", F.array(*runs).alias("runs")).select("id", "hash", "j", F.explode(F.array_compact("runs")).alias("run"))
    runs = materialize(runs.select("id", "hash", "j", "run.*"), "runs")
    first = runs.groupBy("size", "x", "y").agg(F.count(F.lit(1)).alias("n"), F.min(_position()).alias("first")).filter("n > 1").drop("n")
    first = materialize(first, "first")  # so that Spark can split the join's side where one run is very common
    found = found.unionByName(runs.join(first, ["size", "x", "y"]).filter(_position() > F.col("first")).select("id", "hash", "gone"))
    return found.groupBy(*_DOC).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))


def _marked(docs: DataFrame, text: str, doc_id: str, min_words: int) -> DataFrame:
    """row (all of docs), id, text, lines and gone for each row of docs."""
    gone = repeated_lines(docs, text, doc_id, min_words).select(F.col("id").alias("of_id"), F.col("hash").alias("of_hash"), "gone")
    packed = pack(docs, id=docs[doc_id].cast("bigint"), hash=F.xxhash64(F.coalesce(docs[text], F.lit(""))), text=text)
    joined = packed.join(gone, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("hash") == F.col("of_hash")), "left")
    return joined.select("row", "id", "text", F.split("text", "\n").alias("lines"), "gone")


def _kept() -> Column:
    rest = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    return F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(rest, lambda i: F.get("lines", i)), "\n"))


def digest(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    marked = _marked(docs.select("doc_id", "text"), "text", "doc_id", min_words)
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    return marked.select(
        F.col("id").alias("doc_id"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_removed"),
        F.size(F.array_except(gone, F.transform(gone, lambda x: x + 1))).cast("long").alias("n_runs"),
        F.sha2(F.coalesce(_kept(), F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later copies of repeated line runs cut out of the text; other columns stay, whatever their names."""
    marked = _marked(docs, text, doc_id, min_words)
    return marked.select(*[_kept().alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


_AHEAD = "\n".join(
    f"UNION ALL SELECT id, j, {n} AS size, list_value({', '.join(f'l{d}' for d in range(n))}) AS k, list_value({', '.join(f'i{d}' for d in range(n))}) AS gone FROM a "
    f"WHERE i{n - 1} IS NOT NULL AND {' + '.join(f'w{d}' for d in range(n))} >= {MIN_WORDS}"
    for n in range(1, MIN_WORDS + 1)
).removeprefix("UNION ALL ")
ORACLE_SQL = rf"""
WITH s AS (SELECT doc_id AS id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x, i: {{'i': i - 1, 'x': x}}), lambda s: regexp_matches(s.x, '[^\x20\x09-\x0D]'))) AS s FROM documents),
b AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY s.i) AS j, s.i AS i, s.x AS l, len(regexp_extract_all(s.x, '[^\x20\x09-\x0D]+')) AS w FROM s),
a AS (SELECT id, j, {", ".join(f"lead({c}, {d}) OVER o AS {c}{d}" for c in "ilw" for d in range(MIN_WORDS))} FROM b WINDOW o AS (PARTITION BY id ORDER BY j)),
r AS ({_AHEAD}),
f AS (SELECT id, gone, row_number() OVER (PARTITION BY size, k ORDER BY id, j) AS nth FROM r),
g AS (SELECT id, list_sort(list_distinct(flatten(list(gone)))) AS gone FROM f WHERE nth > 1 GROUP BY id),
d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines, coalesce(gone, []) AS gone FROM documents LEFT JOIN g ON doc_id = id)
SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(len(gone) AS BIGINT) AS n_removed,
  CAST(len(list_filter(gone, lambda x: NOT list_contains(gone, x - 1))) AS BIGINT) AS n_runs,
  sha256(coalesce(array_to_string(list_filter(lines, lambda x, i: NOT list_contains(gone, i - 1)), chr(10)), '')) AS kept_sha256 FROM d
"""
