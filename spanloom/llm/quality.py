"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation estimates how often
each rule is right, and a document is kept when its posterior probability of being good reaches a half.

Everything is DataFrame functions. Rules look at one text each, so features need no shuffle. Votes have at
most 3 ** len(RULES) (59 049) patterns; the corpus is folded to one count per pattern by a map-side combined
aggregation, expectation-maximisation runs over that bounded table, and the verdicts come back by a join on
the pattern's number.

Null text has no words; documents below MIN_WORDS words or with too many repeated windows fail whatever the
votes say. Rows are judged one by one, so repeated rows and null ids get a verdict each, and an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, materialize, pack, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
ROUNDS = 25
#: Documents added to what is counted, for good and for bad ones: votes against, votes for. They say which class is the
#: good one, as rules are better than chance, and keep every probability off 0; the data soon outweigh them.
PRIOR_VOTES = ((0.5, 9.5), (4.0, 6.0))
PRIOR_GOOD, PRIOR_SIZE = 0.8, 10.0

#: name, bad where true, good where true; otherwise the rule abstains. SQL over the features below. Several rules look at
#: one property from different sides, so that a class shows in rules that agree and one rule alone decides little.
RULES = [
    ("symbols", "n_symbols * 10 > n_words", "n_symbols * 100 <= n_words"),
    ("density", "n_symbols * 20 > word_chars", "n_symbols * 200 <= word_chars"),
    ("marked", "n_marked * 10 > n_words", "n_marked * 50 <= n_words"),
    ("letters", "n_letters * 10 < 8 * word_chars", "n_letters * 10 >= 9 * word_chars"),
    ("length", "word_chars > 7 * n_words OR word_chars < 2 * n_words", "word_chars * 2 BETWEEN 6 * n_words AND 13 * n_words"),
    ("repeats", "n_repeat_words * 100 > 15 * n_words", "n_repeat_words * 100 <= 5 * n_words"),
    ("lines", "n_dup_lines * 100 > 20 * n_lines", "n_dup_lines * 100 <= 5 * n_lines"),
    ("variety", "n_words >= 50 AND n_distinct * 100 < 30 * n_words", "n_distinct * 100 >= 50 * n_words"),
    ("capitals", "n_upper * 100 > 20 * word_chars", "n_upper * 100 <= 10 * word_chars"),
    ("shouting", "n_exclaims * 100 > 10 * n_words", "n_exclaims * 100 <= 2 * n_words"),
]
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [*BASE, "n_lines", "n_upper", "n_exclaims", "n_distinct", "n_letters", "n_marked"]


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more. Sorted (hash, place) pairs bring equal windows
    together; then each place covers what the place before has not."""
    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    # A one-element array binds the sorted pairs once; a plain reference would sort again for each element.
    return F.get(
        F.transform(
            F.array(F.sort_array(pairs)),
            lambda s: F.get(
                F.transform(
                    F.array(
                        F.sort_array(
                            F.transform(
                                F.filter(s, lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False))),
                                lambda x: x["i"],
                            )
                        )
                    ),
                    lambda p: F.aggregate(
                        p,
                        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
                        lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")),
                        lambda a: a["n"],
                    ),
                ),
                F.lit(0),
            ),
        ),
        F.lit(0),
    )


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one long column for each of FEATURES; text stays as it is."""
    t = F.coalesce(F.col(text), F.lit(""))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    one = docs.select("*", words(F.col(text)).alias("__w"), lines.alias("__l"))
    two = one.select("*", F.transform("__w", lambda w: F.xxhash64(w)).alias("__h"))
    n = F.size("__h")
    windows = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("__h", i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    three = two.select("*", windows.alias("__v"))
    four = three.select("*", (F.size(F.array_distinct("__v")) < F.size("__v")).alias("__again"))
    return four.select(
        *docs.columns,
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"),
        count("[#*$%&|<>]").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("__again"), _repeat_words(F.col("__v"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        count(r"\p{Lu}").alias("n_upper"),
        (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).cast("long").alias("n_exclaims"),
        F.size(F.array_distinct("__h")).cast("long").alias("n_distinct"),
        count(r"\p{L}").alias("n_letters"),
        F.size(F.filter("__w", lambda w: w.rlike("[#*$%&|<>]"))).cast("long").alias("n_marked"),
    )


def _pattern() -> Column:
    """A number with one digit to base three for each rule: 0 bad, 1 abstains, 2 good."""
    out = F.lit(0)
    for _, bad, good in RULES:
        out = out * 3 + F.expr(f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 2 ELSE 1 END")
    return out


def label_model(patterns: DataFrame) -> DataFrame:
    """pattern, posterior from (pattern, n). A rule that votes does so against a document with one probability for good and
    another for bad documents; `alarm` holds them, good first, and `aggregate` refines it over the collected pattern table,
    whose size 3 ** len(RULES) bounds."""
    k = len(RULES)
    votes = F.array(*[F.floor(F.col("pattern") / 3 ** (k - 1 - j)).cast("int") % 3 - 1 for j in range(k)])
    table = patterns.select("pattern", F.col("n").cast("double").alias("n"), votes.alias("v")).agg(F.sort_array(F.collect_list(F.struct("pattern", "n", "v"))).alias("t"))

    def posterior(v: Column, m: Column) -> Column:
        """An abstention says nothing about the document."""
        alarm = lambda m, j: F.get(m["alarm"], j)
        odds = F.aggregate(
            F.sequence(F.lit(0), F.lit(k - 1)),
            F.log(m["good"] / (1 - m["good"])),
            lambda a, j: a
            + F.when(F.get(v, j) == -1, F.log(alarm(m, j) / alarm(m, j + k)))
            .when(F.get(v, j) == 1, F.log((1 - alarm(m, j)) / (1 - alarm(m, j + k))))
            .otherwise(0.0),
        )
        return 1 / (1 + F.exp(-odds))

    def step(m: Column, _: Column) -> Column:
        scored = F.transform("t", lambda x: F.struct(x["n"].alias("n"), x["v"].alias("v"), posterior(x["v"], m).alias("p")))

        def refit(s: Column) -> Column:
            add = lambda f: F.aggregate(s, F.lit(0.0), lambda a, x: a + f(x))
            mine = [lambda x: x["n"] * x["p"], lambda x: x["n"] * (1 - x["p"])]
            cast = lambda y, j, v: PRIOR_VOTES[y][v > 0] + add(lambda x: F.when(F.get(x["v"], F.lit(j)) == v, mine[y](x)).otherwise(0.0))
            share = lambda y, j: cast(y, j, -1) / (cast(y, j, -1) + cast(y, j, 1))
            alarm = F.array(*[share(y, j) for y in (0, 1) for j in range(k)])
            good = (PRIOR_GOOD * PRIOR_SIZE + add(mine[0])) / (PRIOR_SIZE + add(lambda x: x["n"]))
            return F.struct(alarm.alias("alarm"), good.alias("good"))

        return F.get(F.transform(F.array(scored), refit), F.lit(0))

    start = F.struct(F.array(*[F.lit(a / (a + b)) for a, b in PRIOR_VOTES for _ in range(k)]).alias("alarm"), F.lit(PRIOR_GOOD).alias("good"))
    fitted = table.select("t", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step).alias("m"))
    return fitted.select(F.explode(F.transform("t", lambda x: F.struct(x["pattern"].alias("pattern"), posterior(x["v"], F.col("m")).alias("posterior")))).alias("x")).select("x.*")


def assess(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or only its columns in keep) with FEATURES, base_failed, posterior and kept.

    Features are computed once and written, as both the model and the verdicts read them.
    """
    cols = docs.columns if keep is None else keep
    judged = features(docs, text).withColumn("pattern", _pattern()).select(*cols, *FEATURES, "pattern")
    judged = materialize(judged, "quality")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    # What fails the base has its verdict, so it is no example of what the rules are for; it gets a posterior all the same.
    model = label_model(judged.groupBy("pattern").agg(F.count_if(~failed).alias("n")))
    return (
        judged.join(F.broadcast(model), "pattern")  # at most 3 ** len(RULES) rows
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("posterior") >= 0.5))
        .drop("pattern")
    )


def quality_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, with the columns they came with, whatever their names."""
    return assess(pack(docs, text=text), keep=["row"]).filter("kept").select("row.*")
