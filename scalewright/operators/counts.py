"""Counting operators on response tables (person_id, item_id, x); all of them plain DataFrame plans.

Item statistics have a row per item and are broadcast; persons are only ever grouped by their key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most items whose statistics are broadcast; wider tables join by key.
BROADCAST_ITEMS = 100_000
#: Probabilities of fixed models stay so far from 0 and 1.
CLIP = 1e-10


def _per_item(df: DataFrame, n_items: int) -> DataFrame:
    return F.broadcast(df) if n_items <= BROADCAST_ITEMS else df


def validation_summary(r: DataFrame) -> DataFrame:
    """One row: counts of answers, of values that aren't 0 or 1, of negative values, and the range."""
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    x = F.col("x")
    return r.agg(
        F.count(F.lit(1)).alias("n_rows"), count(x.isNull()).alias("n_missing"), count(~x.isin(0, 1)).alias("n_not_binary"),
        count(x < 0).alias("n_negative"), F.min("x").cast("int").alias("lowest"), F.max("x").cast("int").alias("highest"),
    )


def require_binary(r: DataFrame, allow_missing: bool = False) -> None:
    """Raise ValueError unless all answers are 0 or 1 (and none is missing)."""
    s = validation_summary(r).first()
    if s["n_not_binary"]:
        raise ValueError(f"{s['n_not_binary']} answers are neither 0 nor 1")
    if s["n_missing"] and not allow_missing:
        raise ValueError(f"{s['n_missing']} answers are missing")


def require_valid(r: DataFrame, allow_missing: bool = False) -> str:
    """``binary`` or ``graded``, or ValueError: negative answers, missing ones unless allowed, items without answers or with a gap in them.

    An item of graded answers must have all of 0 to its highest answer, so two at least.
    """
    s = validation_summary(r).first()
    if s["n_rows"] == s["n_missing"]:
        raise ValueError("no answers")
    if s["n_negative"]:
        raise ValueError(f"{s['n_negative']} answers are negative")
    if s["n_missing"] and not allow_missing:
        raise ValueError(f"{s['n_missing']} answers are missing")
    if not s["n_not_binary"]:
        return "binary"
    items = r.select("item_id").distinct().join(category_counts(r), "item_id", "left")
    gaps = [row["item_id"] for row in items.where(~F.coalesce("consecutive", F.lit(False))).orderBy("item_id").limit(10).collect()]
    if gaps:
        raise ValueError(f"answers to items {gaps} don't take all values from 0 to the highest")
    return "graded"


def category_counts(r: DataFrame) -> DataFrame:
    """(item_id, top, n_categories, consecutive): consecutive if 0 to top all occur and top is 1 or more."""
    g = r.where("x is not null").groupBy("item_id").agg(F.max("x").cast("int").alias("top"), F.countDistinct("x").alias("n_categories"))
    return g.withColumn("consecutive", (F.col("n_categories") == F.col("top") + 1) & (F.col("top") >= 1))


def item_facility(r: DataFrame) -> DataFrame:
    """(item_id, n, successes, facility) over observed answers."""
    g = r.groupBy("item_id").agg(F.count("x").alias("n"), F.coalesce(F.sum("x"), F.lit(0)).cast("long").alias("successes"))
    return g.withColumn("facility", F.col("successes") / F.greatest("n", F.lit(1)))


def item_order(r: DataFrame) -> DataFrame:
    """(item_id, rank) from easy to hard; equal means keep the order of ids."""
    return item_facility(r).select("item_id", F.row_number().over(Window.orderBy(F.col("facility").desc(), "item_id")).alias("rank"))


def complete_cases(r: DataFrame, n_items: int) -> DataFrame:
    """Rows of persons who answered all items."""
    whole = r.groupBy("person_id").agg(F.count("x").alias("n")).where(F.col("n") == n_items).select("person_id")
    return r.join(whole, "person_id", "left_semi")


def scores(r: DataFrame, n_items: int, kind: str = "complete") -> DataFrame:
    """(person_id, n_answered, score): the sum, the mean answer, or the sum standardised by item difficulty.

    ``complete`` leaves out persons with missing answers.  ``adjusted`` is (sum - expected) / sd over the
    items that a person answered.
    """
    if kind in ("complete", "facility"):
        per = r.groupBy("person_id").agg(F.count("x").alias("n_answered"), F.sum("x").cast("long").alias("total"))
        if kind == "complete":
            return per.where(F.col("n_answered") == n_items).select("person_id", "n_answered", F.col("total").cast("double").alias("score"))
        return per.where("n_answered > 0").select("person_id", "n_answered", (F.col("total") / F.col("n_answered")).alias("score"))
    if kind != "adjusted":
        raise ValueError(f"no score named {kind}")
    items = _per_item(item_facility(r).select("item_id", "facility"), n_items)
    p = F.col("facility")
    per = r.where("x is not null").join(items, "item_id").groupBy("person_id").agg(F.count("x").alias("n_answered"), F.sum("x").alias("total"), F.sum(p).alias("e"), F.sum(p * (1 - p)).alias("v"))
    return per.select("person_id", "n_answered", ((F.col("total") - F.col("e")) / F.sqrt(F.greatest("v", F.lit(1e-12)))).alias("score"))


def score_groups(r: DataFrame, n_items: int, least: int = 10) -> DataFrame:
    """(score, persons): total scores that at least ``least`` complete persons have."""
    return scores(r, n_items).groupBy(F.col("score").cast("int").alias("score")).agg(F.count(F.lit(1)).alias("persons")).where(F.col("persons") >= max(2, least))


def value_bands(r: DataFrame, n_items: int, kind: str = "facility", least: int = 10) -> DataFrame:
    """(score, band): bands of equal scores that are never split, each of at least the target count.

    The distinct scores and their counts are folded in order; a thin last band joins the one before.  One
    array of distinct scores is folded in one task, since a band's start depends on the one before; persons are
    not gathered.  ``adjusted`` scores are all but unique: round them before, to bound that array.
    """
    s = scores(r, n_items, kind).withColumn("score", F.round("score", 9))
    return _banded(s.groupBy("score").agg(F.count(F.lit(1)).alias("n")), F.lit(n_items + 1), least)


def _banded(counts: DataFrame, parts: Column, least: int) -> DataFrame:
    """(score, band) of a table (score, n), in bands of ``least`` persons and of all persons divided by ``parts`` at least.

    ``parts`` is a number or an aggregate over the table.
    """
    gathered = counts.agg(F.sort_array(F.collect_list(F.struct("score", "n"))).alias("c"), F.sum("n").alias("total"), parts.alias("parts"))
    gathered = gathered.withColumn("target", F.greatest(F.lit(max(2, least)), F.ceil(F.col("total") / F.col("parts"))))
    # The fold keeps what the open band holds and the last score of each closed one.  The last end bounds nothing: what
    # lies above it, an open rest, belongs to the band that it closes.
    fold = """aggregate(c, cast((0L, array()) as struct<held: bigint, ends: array<double>>), (s, v) ->
        named_struct('held', if(s.held + v.n >= target, 0L, s.held + v.n), 'ends', if(s.held + v.n >= target, concat(s.ends, array(v.score)), s.ends)),
        s -> slice(s.ends, 1, greatest(size(s.ends) - 1, 0)))"""
    ends = gathered.select(F.expr(fold).alias("ends"))
    return counts.join(F.broadcast(ends)).select("score", F.size(F.filter("ends", lambda e: e < F.col("score"))).alias("band"))


def prepare_checks(r: DataFrame, n_items: int, least: int = 10) -> DataFrame:
    """(score, item_id, n_total, n_right, rate, facility_rank): attempts and successes per score group and item.

    Persons with missing answers are left out.  Items are ranked by facility, hardest first.  Fewer than three score groups
    are the caller's error to raise, see ``require_groups``.  Responses are grouped by person once; all that follows is
    made from the counts per score and item, a small table.
    """
    person = r.where("x is not null").groupBy("person_id").agg(F.collect_list(F.struct("item_id", "x")).alias("answers"), F.sum("x").cast("int").alias("score"))
    counts = person.where(F.size("answers") == n_items).select("score", F.explode("answers").alias("a")).groupBy("score", F.col("a.item_id").alias("item_id")).agg(F.count(F.lit(1)).alias("n_total"), F.sum("a.x").cast("long").alias("n_right"))
    items = Window.partitionBy("item_id")
    facility = F.sum("n_right").over(items) / F.sum("n_total").over(items)
    # Everyone counted answered every item, so a group's persons are the answers to any of its items.
    cells = counts.withColumn("facility", facility).where(F.col("n_total") >= max(2, least))
    rank = F.dense_rank().over(Window.orderBy("facility", "item_id"))
    return cells.select("score", "item_id", "n_total", "n_right", (F.col("n_right") / F.col("n_total")).alias("rate"), rank.alias("facility_rank"))


def prepare_bands(r: DataFrame, n_items: int, person_order: str = "facility", least: int = 10) -> DataFrame:
    """(band, ability, item_id, n_total, n_right, rate, facility_rank): the same over bands of everyone's mean or adjusted scores.

    Persons with missing answers stay; a cell counts those of its band who answered the item.  A band in which nobody answered
    some item is left out.  ``adjusted`` scores are rounded to 9 places.
    """
    if person_order not in ("facility", "adjusted"):
        raise ValueError(f"no order of persons named {person_order}")
    person = scores(r, n_items, person_order).select("person_id", F.round("score", 9).alias("score"))
    person = person.join(F.broadcast(value_bands(r, n_items, person_order, least)), "score")
    ability = person.groupBy("band").agg(F.avg("score").alias("ability"))
    cells = r.where("x is not null").join(person.select("person_id", "band"), "person_id").groupBy("band", "item_id").agg(F.count(F.lit(1)).alias("n_total"), F.sum("x").cast("long").alias("n_right"))
    items = Window.partitionBy("item_id")
    whole = F.count(F.lit(1)).over(Window.partitionBy("band")) == n_items
    cells = cells.withColumn("facility", F.sum("n_right").over(items) / F.sum("n_total").over(items)).withColumn("whole", whole).where("whole")
    rank = F.dense_rank().over(Window.orderBy("facility", "item_id"))
    return cells.join(F.broadcast(ability), "band").select("band", "ability", "item_id", "n_total", "n_right", (F.col("n_right") / F.col("n_total")).alias("rate"), rank.alias("facility_rank"))


def require_groups(cells: DataFrame, least: int = 3) -> None:
    if cells.select("score").distinct().limit(least).count() < least:
        raise ValueError(f"fewer than {least} score groups")


def collapse_columns(cells: DataFrame) -> DataFrame:
    """Items of equal success totals merged: (score, col_rank, n_items, n_total, n_right)."""
    totals = cells.groupBy("item_id").agg(F.sum("n_right").alias("total"))
    ranked = totals.select("item_id", F.dense_rank().over(Window.orderBy("total")).alias("col_rank"))
    return cells.join(ranked, "item_id").groupBy("score", "col_rank").agg(F.count(F.lit(1)).alias("n_items"), F.sum("n_total").cast("long").alias("n_total"), F.sum("n_right").cast("long").alias("n_right"))


def pattern_frequencies(packed: DataFrame) -> DataFrame:
    """(x, freq) of distinct answer patterns; what every likelihood runs on, whatever the number of persons."""
    return packed.groupBy("x").agg(F.count(F.lit(1)).alias("freq"))


def recode_adjacent(r: DataFrame) -> DataFrame:
    """(person_id, item_id, step, y): 1 if x = step, 0 if x = step - 1, else NULL, for every step of the item."""
    top = r.groupBy("item_id").agg(F.max("x").alias("top")).where("top >= 1")
    steps = r.join(top, "item_id").withColumn("step", F.explode(F.sequence(F.lit(1), F.col("top"))))
    y = F.when(F.col("x") == F.col("step"), 1).when(F.col("x") == F.col("step") - 1, 0)
    return steps.select("person_id", "item_id", F.col("step").cast("int").alias("step"), y.cast("int").alias("y"))


def polytomous_counts(r: DataFrame, n_items: int, least: int = 10) -> DataFrame:
    """(score, item_id, step, n_total, n_right) of the recoded table, for score groups of complete persons."""
    total = scores(r, n_items).select("person_id", F.col("score").cast("int").alias("score"))
    kept = total.groupBy("score").count().where(F.col("count") >= max(2, least)).select("score")
    person = total.join(F.broadcast(kept), "score", "left_semi")
    return recode_adjacent(r).join(person, "person_id").groupBy("score", "item_id", "step").agg(F.count("y").alias("n_total"), F.coalesce(F.sum("y"), F.lit(0)).cast("long").alias("n_right"))


def polytomous_bands(r: DataFrame, n_items: int, person_order: str = "facility", least: int = 10) -> DataFrame:
    """(band, ability, item_id, step, n_total, n_right) of the recoded table over bands of everyone's scores; persons with missing answers stay.

    ``facility`` orders persons by their mean answer, ``adjusted`` by (total - expected) / sd over the items that they answered, from
    the items' means and sample variances.  Bands hold at least ``least`` persons and a share of as many parts as there are totals,
    three at least; equal scores stay together.  Scores are rounded to 9 places.  A cell counts those of its band who gave one of the two answers
    next to its step; one without any is 0 of 0.  Persons without answers are in no band.
    """
    if person_order not in ("facility", "adjusted"):
        raise ValueError(f"no order of persons named {person_order}")
    answered = r.where("x is not null")
    if person_order == "facility":
        person = answered.groupBy("person_id").agg(F.sum("x").cast("long").alias("total"), F.avg("x").alias("score"))
    else:
        items = answered.groupBy("item_id").agg(F.avg("x").alias("mean"), F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("v"))
        person = answered.join(_per_item(items, n_items), "item_id").groupBy("person_id").agg(F.sum("x").cast("long").alias("total"), ((F.sum("x") - F.sum("mean")) / F.sqrt(F.greatest(F.sum("v"), F.lit(1e-12)))).alias("score"))
    person = person.withColumn("score", F.round("score", 9))
    counts = person.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.collect_set("total").alias("totals"))
    n_totals = F.size(F.array_distinct(F.flatten(F.collect_list("totals"))))
    person = person.join(F.broadcast(_banded(counts, F.greatest(F.lit(3), n_totals), least)), "score")
    ability = person.groupBy("band").agg(F.avg("score").alias("ability"))
    cells = recode_adjacent(r).join(person.select("person_id", "band"), "person_id").groupBy("band", "item_id", "step").agg(F.count("y").alias("n_total"), F.coalesce(F.sum("y"), F.lit(0)).cast("long").alias("n_right"))
    return cells.join(F.broadcast(ability), "band").select("band", "ability", "item_id", "step", "n_total", "n_right")


def ranked_steps(cells: DataFrame) -> DataFrame:
    """``polytomous_counts`` with rate and facility_rank: steps of all items together, hardest first, by the share that took them."""
    step = Window.partitionBy("item_id", "step")
    shares = cells.withColumn("facility", F.sum("n_right").over(step) / F.greatest(F.sum("n_total").over(step), F.lit(1)))
    rank = F.dense_rank().over(Window.orderBy("facility", "item_id", "step"))
    rate = F.when(F.col("n_total") > 0, F.col("n_right") / F.col("n_total"))
    return shares.select("score", "item_id", "step", "n_total", "n_right", rate.alias("rate"), rank.alias("facility_rank"))


def rest_score_table(r: DataFrame, n_items: int) -> DataFrame:
    """(easier, harder, rest, n, sum_easier, sum_harder) over persons who answered both items.

    Pairs are formed within the pattern table, so the cost follows the distinct patterns of a table with few
    items and not the persons.
    """
    order = item_order(r)
    facts = r.where("x is not null").join(_per_item(order, n_items), "item_id")
    person = facts.groupBy("person_id").agg(F.sort_array(F.collect_list(F.struct("rank", "item_id", "x"))).alias("answers"), F.sum("x").alias("total"))
    patterns = person.groupBy("answers", "total").agg(F.count(F.lit(1)).alias("n"))
    pairs = patterns.withColumn("a", F.explode("answers")).withColumn("b", F.explode("answers")).where("a.rank < b.rank")
    rest = F.col("total") - F.col("a.x") - F.col("b.x")
    n = F.col("n")
    return pairs.groupBy(F.col("a.item_id").alias("easier"), F.col("b.item_id").alias("harder"), rest.cast("long").alias("rest")).agg(
        F.sum("n").cast("long").alias("n"), F.sum(n * F.col("a.x")).cast("long").alias("sum_easier"), F.sum(n * F.col("b.x")).cast("long").alias("sum_harder")
    )


def manifest_iio(r: DataFrame, n_items: int, least: int = 20) -> DataFrame:
    """(statistic): positive crossings of rest-score curves, weighted by group size and divided by persons."""
    table = rest_score_table(r, n_items).where(F.col("n") >= least)
    crossing = F.greatest(F.lit(0.0), (F.col("sum_harder") - F.col("sum_easier")) / F.col("n")) * F.col("n")
    persons = r.agg(F.countDistinct("person_id").alias("persons"))
    summed = table.agg(F.coalesce(F.sum(crossing), F.lit(0.0)).alias("s"))
    return summed.join(F.broadcast(persons)).select((F.col("s") / F.col("persons")).alias("statistic"))


def mask_ranks(r: DataFrame, n_items: int, ids_per_group: int = 1 << 20) -> DataFrame:
    """(person_id, n_answered, rank): persons by observed mean, by which masks are carried over; blanks last.

    Persons are counted by mean and range of ids, the few counts are summed up in order, and persons are
    numbered within their group, so no task sorts them all.
    """
    s = r.groupBy("person_id").agg(F.count("x").alias("n_answered"), F.avg("x").alias("mean"))
    s = s.withColumn("ids", F.floor(F.col("person_id") / ids_per_group))
    groups = s.groupBy("mean", "ids").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.col("mean").asc_nulls_last(), "ids"))
    groups = groups.select(F.col("mean").alias("of_mean"), F.col("ids").alias("of_ids"), (upto - F.col("n")).alias("before"))
    within = s.withColumn("number", F.row_number().over(Window.partitionBy("mean", "ids").orderBy("person_id")))
    joined = within.join(groups, F.col("mean").eqNullSafe(F.col("of_mean")) & (F.col("ids") == F.col("of_ids")))
    return joined.select("person_id", "n_answered", (F.col("before") + F.col("number")).cast("int").alias("rank"))


def cml_margins(r: DataFrame) -> DataFrame:
    """(item_id, step, reached): how often an answer reaches a step, among persons with neither none nor all steps."""
    top = r.groupBy("item_id").agg(F.max("x").alias("top"))
    facts = r.where("x is not null").join(top, "item_id")
    inner = facts.groupBy("person_id").agg(F.sum("x").alias("s"), F.sum("top").alias("m")).where("s > 0 and s < m").select("person_id")
    steps = facts.join(inner, "person_id", "left_semi").withColumn("step", F.explode(F.expr("sequence(1, greatest(top, 1))")))
    return steps.groupBy("item_id", "step").agg(F.sum((F.col("x") >= F.col("step")).cast("long")).alias("reached"))


def mask_scores(r: DataFrame, n_items: int) -> DataFrame:
    """(answered, score, n): persons by the set of items that they answered and their total."""
    person = r.where("x is not null").groupBy("person_id").agg(F.concat_ws(",", F.sort_array(F.collect_list(F.col("item_id")))).alias("answered"), F.sum("x").cast("long").alias("score"))
    return person.groupBy("answered", "score").agg(F.count(F.lit(1)).alias("n"))


def holm(p_values: DataFrame) -> DataFrame:
    """(name, p, adjusted): Holm's step-down adjustment of a small table (name, p)."""
    by_p = Window.orderBy("p", "name")
    ranked = p_values.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy())).withColumn("rn", F.row_number().over(by_p))
    raised = F.max((F.col("k") - F.col("rn") + 1) * F.col("p")).over(by_p.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.select("name", "p", F.least(F.lit(1.0), raised).alias("adjusted"))


def bootstrap_p(null: DataFrame, observed: float, alpha: float = 0.05, lower: bool = False) -> DataFrame:
    """(replicates, p, percentile, cutoff, reject) of a table (statistic) of null statistics."""
    s = F.col("statistic")
    beyond = F.sum(((s <= observed) if lower else (s >= observed)).cast("long"))
    out = null.where(s.isNotNull()).agg(F.count(F.lit(1)).alias("replicates"), ((1 + beyond) / (F.count(F.lit(1)) + 1)).alias("p"), F.avg((s < observed).cast("double")).alias("percentile"), F.percentile("statistic", F.lit(1 - alpha)).alias("cutoff"))
    return out.withColumn("reject", F.col("p") <= alpha)


def bernoulli_loglik(r: DataFrame) -> DataFrame:
    """(loglik, n_par, n_obs, aic, bic): independent items, the model of one class."""
    f = item_facility(r).where("n > 0")
    p = F.greatest(F.lit(1e-10), F.least(F.lit(1 - 1e-10), F.col("facility")))
    ll = f.agg(F.sum(F.col("successes") * F.log(p) + (F.col("n") - F.col("successes")) * F.log(1 - p)).alias("loglik"), F.count(F.lit(1)).alias("n_par"))
    persons = r.agg(F.countDistinct("person_id").alias("n_obs"))
    return ll.join(F.broadcast(persons)).select("loglik", "n_par", "n_obs", (-2 * F.col("loglik") + 2 * F.col("n_par")).alias("aic"), (-2 * F.col("loglik") + F.col("n_par") * F.log("n_obs")).alias("bic"))


def posteriors(packed: DataFrame, weights: list[float], probs: list[list[float]]) -> DataFrame:
    """``packed`` with loglik and post: Bernoulli mixture of fixed parameters, missing answers left out.

    ``probs`` holds a list per class; probabilities of 0 and 1 are kept off those ends by ``CLIP``.
    """

    def joint(k: int) -> Column:
        p = [min(max(v, CLIP), 1 - CLIP) for v in probs[k]]
        right, wrong = (F.array(*[F.lit(math.log(v)) for v in side]) for side in (p, [1 - v for v in p]))
        logs = F.zip_with(F.zip_with("x", right, lambda v, a: F.struct(v.alias("v"), a.alias("a"))), wrong, lambda s, b: F.when(s.v.isNull(), 0.0).when(s.v == 1, s.a).otherwise(b))
        return F.aggregate(logs, F.lit(math.log(max(weights[k], 1e-300))), lambda s, v: s + v)

    df = packed.withColumn("joint", F.array(*[joint(k) for k in range(len(weights))]))
    df = df.withColumn("loglik", F.expr("array_max(joint) + ln(aggregate(joint, 0D, (s, v) -> s + exp(v - array_max(joint))))"))
    return df.withColumn("post", F.expr("transform(joint, v -> exp(v - loglik))")).drop("joint")


def mstep_sums(scored: DataFrame, n_items: int) -> DataFrame:
    """(class_id, item_id, share, p): weighted means of answers, the update of a mixture; 0.5 without weight."""
    long = scored.select(F.posexplode("post").alias("class_id", "w"), "x").select("class_id", "w", F.posexplode("x").alias("item_id", "v"))
    n = long.groupBy("class_id", "item_id").agg(F.avg("w").alias("share"), F.sum(F.when(F.col("v").isNotNull(), F.col("w"))).alias("weight"), F.sum(F.col("w") * F.col("v")).alias("hits"))
    return n.select("class_id", "item_id", "share", F.when(F.col("weight") > 0, F.col("hits") / F.col("weight")).otherwise(F.lit(0.5)).alias("p"))


def class_assignments(scored: DataFrame) -> DataFrame:
    """(person_id, class_id, certainty): the most probable class, the first of equal ones."""
    return scored.select("person_id", (F.expr("array_position(post, array_max(post))") - 1).cast("int").alias("class_id"), F.array_max("post").alias("certainty"))


def classification_summary(scored: DataFrame, n_classes: int) -> DataFrame:
    """(accuracy, entropy_r2): mean largest posterior, and 1 + sum p log p / (n log classes)."""
    h = F.expr("aggregate(post, 0D, (s, p) -> s + case when p > 0 then p * ln(p) else 0D end)")
    return scored.agg(F.avg(F.array_max("post")).alias("accuracy"), (1 + F.sum(h) / (F.count(F.lit(1)) * F.log(F.lit(float(n_classes))))).alias("entropy_r2"))


def item_fit(residuals: DataFrame, by: str) -> DataFrame:
    """(``by``, outfit, infit) of a table (x, e, v) of answers, expectations and variances."""
    sq = F.pow(F.col("x") - F.col("e"), F.lit(2))
    return residuals.groupBy(by).agg(F.avg(sq / F.col("v")).alias("outfit"), (F.sum(sq) / F.sum("v")).alias("infit"))


def constraint_violations(table: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(kind, class_id, item_id, size): decreases over classes per item, and increases over items per class.

    ``table`` is (class_id, item_id, rank, p), rank counting items from easy to hard.
    """
    mon = table.select(F.lit("monotonicity").alias("kind"), "class_id", "item_id", (F.lag("p").over(Window.partitionBy("item_id").orderBy("class_id")) - F.col("p")).alias("size"))
    iio = table.select(F.lit("item_ordering").alias("kind"), "class_id", "item_id", (F.col("p") - F.lag("p").over(Window.partitionBy("class_id").orderBy("rank"))).alias("size"))
    return mon.unionByName(iio).where(F.col("size") > tolerance)


def dominance_mass(table: DataFrame) -> DataFrame:
    """(lower, upper, mass): mean excess of one class over another over items, for all ordered pairs of classes."""
    a, b = table.select(F.col("class_id").alias("lower"), "item_id", F.col("p").alias("p_lower")), table.select(F.col("class_id").alias("upper"), "item_id", F.col("p").alias("p_upper"))
    return a.join(b, "item_id").where("lower <> upper").groupBy("lower", "upper").agg(F.avg(F.greatest(F.lit(0.0), F.col("p_upper") - F.col("p_lower"))).alias("mass"))
