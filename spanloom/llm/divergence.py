"""Source divergence audit: how far the word use of each source of a language is from that of the others.

Terms are runs of letters (A-Z lower-cased, other code points above ASCII as they are). Each language keeps the terms in at
least MIN_DOCS of its documents (rows). A group is a language and a source; each gives every kept term a smoothed share p of
a thousand million, in exact integers. Two shares differ by f = floor((p - q) ** 2 / (p + q)).

`pairs` sums f over all kept terms for any two sources of a language. Terms that a source doesn't have all have one share
there, so the sum is that of two baselines, corrected for the terms of one source (by distinct counts) and for the terms of
both (by a join of the counts): work grows with the terms that are there, not with terms times sources.

`terms` gives the terms that stand out in a group against its language, the first TOP of each by radix selection
(`ranking.top_k`), so no group is sorted whole.

Null text, lang and source are read as ''. A group without terms has pairs still; a language without kept terms has pairs of
value 0. Rows are documents, so repeated rows count again. An empty table gives an empty result. Extra columns are not read.
A source may hold any share of the rows: counts combine before they shuffle, and joins have one row per key on one side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, recording, remove
from .ranking import top_k

NOT_LETTERS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 10
TOP = 10
#: Shares are of SCALE = FIRST * SECOND; two steps keep products of counts up to 2 ** 48 within a long.
FIRST, SECOND = 31_250, 32_000
#: f is below SCALE.
BITS = 30


def _div(a: Column, b: Column) -> Column:
    """Integer quotient of longs that aren't negative."""
    return F.call_function("div", a, b)


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exactly; of no meaning where nothing is kept."""
    size, part = F.greatest(total + 2 * kept, F.lit(1)), (count + 2) * FIRST
    return 1 + _div(part, size) * SECOND + _div((part % size) * SECOND, size)


def difference(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _named(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(empty(lang).alias("lang"), empty(source).alias("source"), F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), NOT_LETTERS).alias("words"))


def _tallies(named: DataFrame) -> DataFrame:
    """lang, source, term, count and docs. Words are read twice, all and then each once a row, as arrays that are exploded whole:
    a struct made for each word by a lambda costs more than the rest of the count. A split leaves an empty word at either end."""
    twice = F.array(F.struct(F.col("words").alias("terms"), F.lit(0).alias("once")), F.struct(F.array_distinct("words").alias("terms"), F.lit(1).alias("once")))
    lists = named.select("lang", "source", F.explode(twice).alias("x")).select("lang", "source", "x.once", "x.terms")
    each = lists.select("lang", "source", "once", F.explode("terms").alias("term")).filter("term <> ''")
    return each.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("once")).alias("count"), F.sum("once").alias("docs"))


def count_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """Kept terms that occur in a group: lang, source, term, count, lang_count; and the groups: lang, source, total, kept (terms
    of the language), lang_total. Both are written."""
    named = _named(docs, text, lang, source)
    with recording() as made:
        tallies = materialize(_tallies(named), "tallies")
        kept = tallies.groupBy("lang", "term").agg(F.sum("count").alias("lang_count"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).drop("docs")
        kept = materialize(kept, "kept")
        counts = materialize(tallies.drop("docs").join(kept, ["lang", "term"]).select("lang", "source", "term", "count", "lang_count"), "counts")
        totals = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
        langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_count").alias("lang_total"))
        groups = named.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        groups = materialize(groups.na.fill(0, ["total", "kept", "lang_total"]), "groups")
    remove(docs.sparkSession, [t for t in made if "/tallies-" in t or "/kept-" in t])
    return counts, groups


def pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, other, value for any two different sources of a language, both ways round."""
    base = groups.withColumn("p0", share(F.lit(0).cast("long"), F.col("total"), F.col("kept")))
    # f of a group's terms against a baseline depends on the count only.
    same = counts.groupBy("lang", "source", "count").agg(F.count(F.lit(1)).alias("n")).join(base, ["lang", "source"])
    same = same.select("lang", "source", "p0", "n", share(F.col("count"), F.col("total"), F.col("kept")).alias("p"))
    other = base.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    one = same.join(other, "lang").filter("source <> other")
    one = one.groupBy("lang", "source", "other").agg(F.sum(F.col("n") * (difference(F.col("p"), F.col("q0")) - difference(F.col("p0"), F.col("q0")))).alias("value"))
    # Terms of both: what the two sums above counted against baselines, put right.
    shares = counts.join(base.drop("lang_total"), ["lang", "source"]).select("lang", "term", "source", share(F.col("count"), F.col("total"), F.col("kept")).alias("p"), "p0")
    facing = shares.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    p, q, p0, q0 = map(F.col, ("p", "q", "p0", "q0"))
    right = difference(p, q) - difference(p, q0) - difference(p0, q) + difference(p0, q0)
    both = shares.join(facing, ["lang", "term"]).filter("source < other").groupBy("lang", "source", "other").agg(F.sum(right).alias("value"))
    # Either way round a pair has the sum of all parts of both.
    mine = base.select("lang", "source", "kept", "p0").join(other, "lang").filter("source <> other")
    mine = mine.select("lang", "source", "other", (F.col("kept") * difference(p0, q0)).alias("value"))
    turned = lambda d: d.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value")
    parts = mine
    for d in (one, turned(one), both, turned(both)):
        parts = parts.unionByName(d)
    return parts.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))


def terms(counts: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, term, value, rank: the first terms of each group whose share is above the language's."""
    both = counts.join(groups, ["lang", "source"])
    p, q = share(F.col("count"), F.col("total"), F.col("kept")), share(F.col("lang_count"), F.col("lang_total"), F.col("kept"))
    both = both.select("lang", "source", "term", p.alias("p"), q.alias("q")).filter("p > q")
    return top_k(materialize(both.select("lang", "source", "term", difference(F.col("p"), F.col("q")).alias("value")), "above"), ["lang", "source"], "value", "term", top, BITS)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: all pairs, and the first terms, of each group."""
    counts, groups = count_terms(docs, text, lang, source, min_docs)
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    far = pairs(counts, groups).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    far = far.withColumn("rank", F.row_number().over(by))
    out = terms(counts, groups, top).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return far.unionByName(out)


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{NOT_LETTERS}'), lambda x: x <> '') AS w FROM documents),
o AS (SELECT id, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM o GROUP BY ALL HAVING count(DISTINCT id) >= {MIN_DOCS}),
c AS (SELECT lang, source, term, count(*) AS c FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, CAST(coalesce(n, 0) AS HUGEINT) AS n, CAST(coalesce(v, 0) AS HUGEINT) AS v, CAST(coalesce(ln, 0) AS HUGEINT) AS ln FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN (SELECT lang, count(*) AS v, sum(c) AS ln FROM k GROUP BY ALL) USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + 1000000000 * (coalesce(c.c, 0) + 2) // (g.n + 2 * g.v) AS p, 1 + 1000000000 * (k.c + 2) // (g.ln + 2 * g.v) AS q
  FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b USING (lang) LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source WHERE a.source <> b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= {TOP}
"""
