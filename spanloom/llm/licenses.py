"""License scans by diagonal voting.

Every rolling k-gram of words is joined with the places where it stands in a template. A match votes for the diagonal
document place - template place; diagonals at most DRIFT apart in one document are merged, as a word put in or left
out moves the rest, and a merged run is verified by how many of the template's k-grams it holds: a name must stand whole,
a notice may have changes. Templates are licenses' notices, further paragraphs of them and their names.

The template table is fixed, so it is broadcast; the scan joins in place and only matches (and one row per document,
which carries documents without a match) are shuffled.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII code points. Null text has no words. Rows are
documents of their own, so repeated rows are reported each. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NON_ALNUM, ascii_lower, words

K = 3
DRIFT = 2
#: A verified span holds all k-grams of a template with fewer than SHORT of them, else COVERAGE of them or, from LONG on,
#: all but CHANGED, which two changed words cost.
SHORT, LONG, COVERAGE, CHANGED = 8, 20, 0.8, 2 * K

#: Label and wording. The first three are phrases of which every place counts.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    # Further paragraphs of whole licenses.
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", "the gnu general public license is intended to guarantee your freedom to share and change free software"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    # Names, as short statements give them.
    ("gpl", "gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("gfdl", "gnu free documentation license"),
    ("mpl", "mozilla public license"),
    ("epl", "eclipse public license"),
    ("bsd", "under the bsd license"),
    ("bsd", "bsd 2 clause license"),
    ("bsd", "bsd 3 clause license"),
    ("isc", "under the isc license"),
    ("cc0", "creative commons zero"),
    ("cc0", "cc0 1 0 universal"),
    ("cc-by", "creative commons attribution 2 0"),
    ("cc-by", "creative commons attribution 3 0"),
    ("cc-by", "creative commons attribution 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc-by-sa", "creative commons attribution share alike"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-nc", "creative commons attribution non commercial"),
    ("cc-by-nd", "creative commons attribution noderivatives"),
    ("cc-by-nd", "creative commons attribution noderivs"),
]


#: In whole numbers, for Spark and for the SQL that says the same.
_VERIFIED = f"CASE WHEN grams < {SHORT} THEN held = grams ELSE held * 100 >= {round(100 * COVERAGE)} * grams OR (grams >= {LONG} AND held >= grams - {CHANGED}) END"


def _grams(ws):
    n = F.size(ws)
    return F.when(n >= K, F.transform(F.sequence(F.lit(0), n - K), lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(K)]))).otherwise(F.array().cast("array<bigint>"))


def templates(spark: SparkSession) -> DataFrame:
    """gram, template, place, grams (of the template), phrase, label."""
    rows = [(i, label, text, i < len(PHRASES)) for i, (label, text) in enumerate([*PHRASES, *NOTICES])]
    df = spark.createDataFrame(rows, "template int, label string, text string, phrase boolean")
    df = df.withColumn("__w", words(F.col("text"), NON_ALNUM)).withColumn("__g", _grams(F.col("__w")))
    return df.select("template", "label", "phrase", F.size("__g").alias("grams"), F.posexplode("__g").alias("place", "gram"))


def spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """rid, doc_id, n_words, template, label, phrase, places (of whole phrases), first and last word, coverage and whether
    that verifies it for every merged run; one row with null template for each document besides."""
    known = templates(docs.sparkSession)
    mark = known.limit(1).select(F.lit(-1).alias("template"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("phrase"), F.lit(1).alias("grams"), F.lit(0).alias("place"), F.lit(None).cast("bigint").alias("gram"))
    known = known.unionByName(mark)
    ws = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), words(ascii_lower(F.col(text)), NON_ALNUM).alias("__w"))
    grams = ws.select("rid", "doc_id", F.size("__w").cast("long").alias("n_words"), _grams(F.col("__w")).alias("__g"))
    # The null gram at the end joins the mark and keeps documents without a match.
    rolled = grams.select("rid", "doc_id", "n_words", F.posexplode(F.concat("__g", F.array(F.lit(None).cast("bigint")))).alias("at", "__gram"))
    matches = rolled.join(F.broadcast(known), F.col("__gram").eqNullSafe(F.col("gram")))
    diagonals = matches.groupBy("rid", "doc_id", "n_words", "template", "label", "phrase", "grams", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("found"))
    own = Window.partitionBy("rid", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(own) > DRIFT, F.lit(True)).cast("int")
    runs = diagonals.withColumn("__new", fresh).withColumn("run", F.sum("__new").over(own))
    whole = F.col("phrase") & (F.size("found") == F.col("grams"))
    merged = runs.groupBy("rid", "doc_id", "n_words", "template", "label", "phrase", "grams", "run").agg(
        F.collect_list(F.when(whole, F.col("diagonal"))).alias("places"),
        F.min(F.col("diagonal") + F.array_min("found")).alias("first"),
        F.max(F.col("diagonal") + F.array_max("found") + K - 1).alias("last"),
        F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("held"),
    )
    real = F.col("template") >= 0
    return merged.select(
        "rid", "doc_id", "n_words", F.when(real, F.col("template")).alias("template"), "label", "phrase",
        F.when(real, F.col("places")).alias("places"), F.when(real, F.col("first")).alias("first"), F.when(real, F.col("last")).alias("last"),
        F.when(real, F.col("held") / F.col("grams")).otherwise(F.lit(0.0)).alias("coverage"), (real & F.expr(_VERIFIED)).alias("verified"),
    )


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: its phrases' places and the labels of all verified spans."""
    found = spans(docs, text, doc_id)
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return found.groupBy("rid", "doc_id", "n_words").agg(
        F.coalesce(F.sum(F.size("places")), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.array_min("places")).cast("long").alias("first_word"),
        F.max(F.array_max("places")).cast("long").alias("last_word"),
        joined(F.when(F.size("places") > 0, F.col("label"))).alias("base_labels"),
        joined(F.when(F.col("verified"), F.col("label"))).alias("labels"),
        F.max("coverage").alias("score"),
    ).drop("rid")


def _values() -> str:
    return ", ".join(f"({i}, '{label}', '{text}', {str(i < len(PHRASES)).lower()})" for i, (label, text) in enumerate([*PHRASES, *NOTICES]))


ORACLE_SQL = rf"""
WITH t AS (SELECT * FROM (VALUES {_values()}) AS v(template, label, text, phrase)),
tg AS (SELECT template, label, phrase, len(w) - 2 AS grams, p - 1 AS place, array_to_string(list_slice(w, p, p + 2), ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(w) - 1)) AS p FROM (SELECT *, string_split(text, ' ') AS w FROM t))),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
dg AS (SELECT rid, p - 1 AS pos, array_to_string(list_slice(w, p, p + 2), ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - 1)) AS p FROM d)),
diag AS (SELECT rid, template, label, phrase, grams, pos - place AS diagonal, list(DISTINCT place) AS found FROM dg JOIN tg USING (gram) GROUP BY ALL),
isl AS (SELECT *, sum(CASE WHEN diagonal - prev <= {DRIFT} THEN 0 ELSE 1 END) OVER (PARTITION BY rid, template ORDER BY diagonal) AS run
  FROM (SELECT *, lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) AS prev FROM diag)),
r AS (SELECT rid, template, label, run, list(diagonal) FILTER (phrase AND len(found) = grams) AS places, len(list_distinct(flatten(list(found)))) AS held, any_value(grams) AS grams FROM isl GROUP BY rid, template, label, run),
m AS (SELECT *, held / grams::DOUBLE AS coverage, {_VERIFIED} AS verified FROM r),
s AS (SELECT rid, sum(coalesce(len(places), 0)) AS n_base, min(list_min(places)) AS first_word, max(list_max(places)) AS last_word,
  string_agg(DISTINCT CASE WHEN len(places) > 0 THEN label END, ',' ORDER BY CASE WHEN len(places) > 0 THEN label END) AS base_labels,
  string_agg(DISTINCT CASE WHEN verified THEN label END, ',' ORDER BY CASE WHEN verified THEN label END) AS labels, max(coverage) AS score
  FROM m GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN s USING (rid)
"""
