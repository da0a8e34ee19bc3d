"""Joins whose hot keys are split over many tasks, by as many salts as a key's rows call for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a task takes; a key with more is split.
HOT_KEY = 200_000
#: At most so many keys are split, which bounds what is broadcast: a key is hot if it has more than so small a part of all rows.
MOST_HOT = 9_000
_NULLS = 64


def hot_keys(rows: DataFrame, keys: list[str], number: int, hot: int) -> DataFrame | None:
    """(keys, __salts): the keys with more than `hot` of the `number` rows and how many tasks they call for; None if there are none.

    Frequent keys are counted by a few counters in each task, which misses none and shuffles nothing; only what they
    name is then counted exactly.
    """
    code = F.xxhash64(*keys)
    support = max(1e-4, 0.99 * hot / number)
    named = rows.select(code.alias("__k")).stat.freqItems(["__k"], support).first()
    if named is None or not named[0]:
        return None
    exact = rows.where(code.isin(list(named[0]))).groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > hot)
    found = exact.select(*keys, F.ceil(F.col("__n") / hot).cast("int").alias("__salts")).collect()
    return rows.sparkSession.createDataFrame(found, exact.select(*keys, F.lit(1).alias("__salts")).schema) if found else None


def _any_null(keys: list[str]) -> Column:
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return missing


def split_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", rows: int | None = None, hot: int = HOT_KEY, counted: DataFrame | None = None) -> DataFrame:
    """`left` joined with `right` on the columns `on`; `how` is inner, left, left_semi or left_anti.

    A key with n > `hot` rows on the left gets ceil(n / hot) salts: its left rows spread over them by a hash of the whole
    row, its right rows are repeated for each. The hot keys, MOST_HOT of them at the most, travel by broadcast. Left rows
    with a null key, which match nothing, are spread too if there are many. Without hot keys it is the plain join.
    `rows`, if the caller knows it, is a bound of the left side's rows; if it is at most `hot`, no key can be hot.
    `counted` is a table that has the same keys as `left` but is cheaper to read twice.
    """
    keys = [on] if isinstance(on, str) else list(on)
    narrow = (left if counted is None else counted).select(*keys)
    rows = narrow.count() if rows is None else rows
    if rows <= hot:
        return left.join(right, keys, how)
    hot = max(hot, rows // MOST_HOT)
    heavy = hot_keys(narrow.where(~_any_null(keys)), keys, rows, hot)
    blank = how in ("left", "left_anti") and narrow.where(_any_null(keys)).limit(hot + 1).count() > hot
    if heavy is None and not blank:
        return left.join(right, keys, how)
    spread = F.xxhash64(*left.columns)
    if heavy is None:
        salted, repeated = left.withColumn("__salt", F.lit(0)), right.withColumn("__salt", F.lit(0))
    else:
        salted = left.join(F.broadcast(heavy), keys, "left").withColumn("__salt", F.coalesce(F.pmod(spread, F.col("__salts")), F.lit(0)).cast("int")).drop("__salts")
        salts = F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))
        repeated = right.join(F.broadcast(heavy), keys, "left").withColumn("__salt", salts).drop("__salts")
    salted = salted.withColumn("__salt", F.when(_any_null(keys), F.pmod(spread, F.lit(_NULLS)).cast("int")).otherwise(F.col("__salt")))
    return salted.join(repeated, [*keys, "__salt"], how).drop("__salt")
