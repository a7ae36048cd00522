"""The k greatest rows of each group by radix selection: histograms over digits of the value, then over bytes of the item.

No group is sorted or brought into one task. A round counts each group's rows by the next digit (map-side combined, at most
2 ** BITS rows a group) and follows the digit in which the kth row lies; what lies above is taken. Rows that tie at the kth
value are told apart by their items' UTF-8 bytes in the same way, two bytes a round, skipping bytes that all have in common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Bits of the value in a round.
BITS = 11
#: Rows of a group that may be ordered within a task.
FEW = 1024


def _followed(counts: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Of counts (keys, need, n and what order reads), the row of each group in which its need-th row lies; need is what is
    left to find there."""
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("before", before).filter("before < need AND need <= before + n").withColumn("need", F.col("need") - F.col("before")).drop("before")


def _joined(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    renamed = state.select(*[F.col(c).alias(f"__{c}") for c in state.columns])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
    on = same[0]
    for s in same[1:]:
        on &= s
    return rows.join(renamed, on)


def thresholds(rows: DataFrame, keys: list[str], value: str, k: int, bits: int = 63) -> DataFrame:
    """keys, least (the kth greatest value of the group), need (how many rows of that value are among the k), ties (how many
    there are) and whole: whether the group has k rows at most, which are all taken."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    state = sizes.select(*keys, F.least(F.lit(k), "n").cast("long").alias("need"), F.col("n").alias("ties"), F.lit(0).cast("long").alias("least"), (F.col("n") <= k).alias("whole"))
    state = materialize(state, "digits")
    rounds = -(-bits // BITS)
    for r in reversed(range(rounds)):
        shift = r * BITS
        left = state.filter("NOT whole")
        within = _joined(rows, left, keys).filter(F.shiftright(value, shift + BITS) == F.shiftright("__least", BITS) if r + 1 < rounds else F.lit(True))
        # least so far is that of the digits seen, so the next digit is appended to it.
        counts = within.groupBy(*keys, F.col("__need").alias("need"), F.shiftright(value, shift).alias("digit")).agg(F.count(F.lit(1)).alias("n"))
        found = _followed(counts, keys, F.col("digit").desc())
        found = found.select(*keys, "need", F.col("n").alias("ties"), (F.shiftleft("digit", BITS) if r else F.col("digit")).alias("least"), F.lit(False).alias("whole"))
        state = materialize(state.filter("whole").unionByName(found), "digits")
    return state


def _ties(rows: DataFrame, state: DataFrame, keys: list[str], value: str, item: str) -> DataFrame:
    """keys and prefix of each group whose ties are not all among the k: items that begin below prefix, by bytes, are, and at
    most FEW begin with it."""
    tied = state.filter("NOT whole AND ties > need").select(*keys, "least", "need", "ties", F.lit("").cast("binary").alias("prefix"))
    done, left = tied.filter(F.col("ties") <= FEW), materialize(tied.filter(F.col("ties") > FEW), "tied")
    item_bytes = F.col(item).cast("binary")
    while not left.isEmpty():
        known = F.octet_length("__prefix")
        within = _joined(rows, left, keys).filter((F.col(value) == F.col("__least")) & (F.substring(item_bytes, F.lit(1), known) == F.col("__prefix")))
        counts = within.groupBy(*keys, F.col("__least").alias("least"), F.col("__need").alias("need"), F.substring(item_bytes, F.lit(1), known + 2).alias("prefix"))
        counts = counts.agg(F.count(F.lit(1)).alias("n"), F.min(item_bytes).alias("low"), F.max(item_bytes).alias("high"))
        found = _followed(counts, keys, F.col("prefix").asc())
        # All items of the followed part lie between its least and greatest, so they share what these two share.
        lengths = F.array(*[F.least(F.octet_length("low"), F.octet_length("prefix") + 2**j) for j in range(24)])
        shared = F.filter(lengths, lambda n: F.substring(F.col("low"), F.lit(1), n) == F.substring(F.col("high"), F.lit(1), n))
        prefix = F.substring(F.col("low"), F.lit(1), F.greatest(F.coalesce(F.array_max(shared), F.lit(0)), F.octet_length("prefix")))
        found = materialize(found.select(*keys, "least", "need", F.col("n").alias("ties"), prefix.alias("prefix")), "tied")
        done, left = done.unionByName(found.filter(F.col("ties") <= FEW)), found.filter(F.col("ties") > FEW)
    return done.select(*keys, "prefix")


def top_k(rows: DataFrame, keys: list[str], value: str, item: str, k: int, bits: int = 63) -> DataFrame:
    """rows among the k of their group by value descending, then item by its UTF-8 bytes ascending, with rank from 1.

    value is a long from 0 to 2 ** bits - 1; items are distinct within a group and not null. rows is read several times, so
    it should be a written table. A group of fewer than k rows comes whole; ranks are given to at most k + FEW rows a group.
    """
    state = thresholds(rows, keys, value, k, bits)
    ties = _ties(rows, state, keys, value, item)
    ties = ties.select(*[F.col(c).alias(f"__{c}") for c in keys], "prefix")
    cut = materialize(state.join(ties, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys], "left").select(*keys, "least", "whole", "prefix"), "cut")
    begins = F.substring(F.col(item).cast("binary"), F.lit(1), F.octet_length("__prefix"))
    tie = (F.col(value) == F.col("__least")) & (F.col("__prefix").isNull() | (begins <= F.col("__prefix")))
    taken = _joined(rows, cut, keys).filter(F.col("__whole") | (F.col(value) > F.col("__least")) | tie).select(*rows.columns)
    ranked = taken.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(value).desc(), F.col(item).asc())))
    return ranked.filter(F.col("rank") <= k)
