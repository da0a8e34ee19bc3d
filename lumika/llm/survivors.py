"""One surviving record for each group of copies, and how far each source is to be trusted.

Every copy states values for the fields of its group: claims. A latent two-sided quality model takes each claimed value
as true or false and each source as having a sensitivity (how often it states a value that is true) and a specificity
(how often it leaves out one that is false); expectation-maximisation estimates both without labels. A single-valued
field has at most one true value, so its claims compete; a multi-valued field keeps every value judged true. Where a
field needs one supplier by a stated order of preference, `survivors` picks it among the claims.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumika.operators.joins import split_join
from lumika.session import Scratch, materialize

#: Rounds end when no source's sensitivity or specificity moves by more than this, after so many at the latest.
TOLERANCE, MOST_ROUNDS = 1e-3, 100
#: Prior means, and their weights as shares of the claims a source could have made, beside ten claims at the least. A source
#: seldom states what is false: without a strong prior for that, with few sources a group, "all is false" explains as much.
PRIOR = {"hit": (0.8, 0.1), "false": (0.1, 0.1), "true": (0.5, 1.0)}
LEAST_PRIOR = 10.0


def _distinct_sources(rows: DataFrame, by: list[str], out: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.sort_array(F.collect_set("source")).alias(out))


def _fit(made: Scratch, contests: DataFrame, sides: DataFrame, tolerance: float) -> tuple[list[tuple], float, int]:
    """The sources' (source, hit, false), the share of true claims, and the rounds it took.

    `contests(contest, single, weight, pattern, n)`: so many facts of a pattern compete in so many alike contests;
    `sides(pattern, source, x)`: whether a source states the facts of a pattern or leaves them out.
    """
    spark = contests.sparkSession
    names = [r[0] for r in sides.select("source").distinct().collect()]  # as many as there are sources
    quality, prior, rounds = {s: (0.8, 0.1) for s in names}, 0.5, 0
    while rounds < MOST_ROUNDS and names:
        rounds += 1
        scored = _posteriors(contests, sides, [(s, *q) for s, q in quality.items()], prior)
        sums = scored.groupBy("pattern").agg(F.sum(F.col("weight") * F.col("n") * F.col("posterior")).alias("w"), F.sum(F.col("weight") * F.col("n") * (1 - F.col("posterior"))).alias("v"))
        sums = made.table(sums)
        w, v, x = F.col("w"), F.col("v"), F.col("x")

        def shrunk(stated, all_, seen, kind: str):
            mean, share = PRIOR[kind]
            weight = LEAST_PRIOR + share * seen
            return (stated + mean * weight) / (all_ + weight)

        seen = F.sum(w + v)
        found = sides.join(sums, "pattern").groupBy("source").agg(shrunk(F.sum(w * x), F.sum(w), seen, "hit").alias("hit"), shrunk(F.sum(v * x), F.sum(v), seen, "false").alias("false")).collect()
        true, untrue = sums.agg(F.sum("w"), F.sum("v")).first()
        before, quality = quality, {r[0]: (r[1], r[2]) for r in found}
        prior = shrunk(true, true + untrue, true + untrue, "true")
        if max(abs(a - b) for s in names for a, b in zip(before[s], quality[s])) < tolerance:
            break
    return [(s, *q) for s, q in quality.items()], prior, rounds


def _posteriors(contests: DataFrame, sides: DataFrame, quality: list[tuple], prior: float) -> DataFrame:
    """`contests` with the posterior of each pattern's facts in each contest."""
    known = contests.sparkSession.createDataFrame(quality, "source string, hit double, false double")
    true = F.sum(F.when(F.col("x") > 0, F.log("hit")).otherwise(F.log(1 - F.col("hit"))))
    false = F.sum(F.when(F.col("x") > 0, F.log("false")).otherwise(F.log(1 - F.col("false"))))
    log_odds = (true + F.log(F.lit(prior))) - (false + F.log(F.lit(1 - prior)))
    odds = sides.join(F.broadcast(known), "source").groupBy("pattern").agg(F.exp(F.greatest(F.lit(-300.0), F.least(F.lit(300.0), log_odds))).alias("odds"))
    rows = contests.join(odds, "pattern")
    totals = rows.groupBy("contest").agg(F.sum(F.col("n") * F.col("odds")).alias("rivals"))
    rows = rows.join(totals, "contest")
    return rows.withColumn("posterior", F.col("odds") / (1 + F.when(F.col("single"), F.col("rivals")).otherwise(F.col("odds"))))


def claim_truth(claims: DataFrame, present: DataFrame, multi: tuple[str, ...] = (), tolerance: float = TOLERANCE) -> DataFrame:
    """(group_id, field_name, value, posterior): how likely each claimed value is true.

    `claims(group_id, field_name, value, source)`; `present(group_id, source)` says which sources could have made a claim
    about a group; `multi` are the fields that may have several true values. Nulls make no claim, repeated claims count
    once, without claims there is no result. Facts with the same stating and silent sources are alike to the model, and so
    are fields in which the same numbers of such facts compete: the rounds run over these patterns, not over the facts.
    """
    with Scratch() as made:
        stated = claims.where("value is not null and source is not null and group_id is not null").select("group_id", "field_name", "value", "source").distinct()
        facts = _distinct_sources(stated, ["group_id", "field_name", "value"], "yes")
        sources = _distinct_sources(present.where("source is not null").select("group_id", "source").distinct(), ["group_id"], "all")
        facts = split_join(made.table(facts), sources, "group_id").select("group_id", "field_name", "value", "yes", F.array_except("all", "yes").alias("no"))
        facts = made.table(facts.withColumn("pattern", F.xxhash64("yes", F.lit("|"), "no")))
        patterns = facts.groupBy("pattern").agg(F.first("yes").alias("yes"), F.first("no").alias("no"))
        side = lambda column, x: F.transform(column, lambda s: F.struct(s.alias("source"), F.lit(x).alias("x")))
        sides = made.table(patterns.select("pattern", F.explode(F.concat(side("yes", 1.0), side("no", 0.0))).alias("s")).select("pattern", "s.source", "s.x"))
        # a field's rivals: how many facts of each pattern; there are no more patterns than sets of sources
        rivals = facts.groupBy("group_id", "field_name", "pattern").agg(F.count("*").alias("n"))
        fields = rivals.groupBy("group_id", "field_name").agg(F.sort_array(F.collect_list(F.struct("pattern", "n"))).alias("rivals"))
        fields = made.table(fields.select("group_id", "field_name", "rivals", (~F.col("field_name").isin(*multi) if multi else F.lit(True)).alias("single")).withColumn("contest", F.xxhash64("rivals", "single")))
        alike = fields.groupBy("contest").agg(F.first("single").alias("single"), F.count("*").alias("weight"), F.first("rivals").alias("rivals"))
        contests = made.table(alike.select("contest", "single", "weight", F.explode("rivals").alias("r")).select("contest", "single", "weight", "r.pattern", "r.n"))
        quality, prior, _ = _fit(made, contests, sides, tolerance)
        scored = _posteriors(contests, sides, quality, prior).select("contest", "pattern", "posterior")
        judged = facts.select("group_id", "field_name", "value", "pattern").join(fields.select("group_id", "field_name", "contest"), ["group_id", "field_name"])
        return materialize(judged.join(scored, ["contest", "pattern"]).select("group_id", "field_name", "value", "posterior"))


def survivors(copies: DataFrame, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(group_id, field_name, photo_id, value): for each group of at least two copies and each field, its supplier.

    `copies(id, h, ...)` has each id once and copies share `h`. A rule gives a field's value, null where the copy
    has none to offer, and the order: the largest wins, then the smallest id. A field that no copy offers has no row.
    """
    sizes = copies.groupBy("h").agg(F.min("id").alias("group_id"), F.count("*").alias("members")).where("members >= 2").select("h", "group_id")
    fields = F.explode(F.array(*[F.struct(F.lit(n).alias("field_name"), v.cast("string").alias("value"), o.cast("double").alias("rank"), o.cast("long").alias("exact")) for n, (v, o) in rules.items()]))
    offered = copies.select("h", F.col("id").alias("photo_id"), fields.alias("f")).select("h", "photo_id", "f.*").where("value is not null")
    best = offered.groupBy("h", "field_name").agg(F.max(F.struct("exact", "rank", (-F.col("photo_id")).alias("id"), "value")).alias("b"))
    return best.join(sizes, "h").select("group_id", "field_name", (-F.col("b.id")).alias("photo_id"), F.col("b.value").alias("value"))


def true_values(claims: DataFrame, present: DataFrame, multi: tuple[str, ...] = (), least: float = 0.5) -> DataFrame:
    """(group_id, field_name, value, posterior, best): every value judged true, at most one of a single-valued field.

    `best` marks the most probable one of each field, the smallest text of equal ones. A field none of whose values is
    more probable than `least` has no row.
    """
    with Scratch() as made:
        truth = made.keep(claim_truth(claims, present, multi)).where(F.col("posterior") > least)
        best = truth.groupBy("group_id", "field_name").agg(F.min(F.struct((-F.col("posterior")).alias("p"), "value")).alias("b"))
        found = truth.join(best, ["group_id", "field_name"])
        return materialize(found.select("group_id", "field_name", "value", "posterior", (F.col("value") == F.col("b.value")).alias("best")))
