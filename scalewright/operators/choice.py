"""Choosing how a table of answers is to be read: by properties of classes, by bootstrap tests, and by three routes at once."""

from __future__ import annotations

import math
from itertools import permutations

import numpy as np
from pyspark.errors import PythonException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import counts as C
from . import nulls as N
from . import posets as P
from . import selection as S
from .fanout import kept
from .mixtures import class_table, fit
from .nulls import Refit, resampled
from .omnibus import omnibus_null

#: What a model says about the variable behind the answers.
SCALE = {"UN": "classificatory", "MON": "ordinal", "IIO": "ordinal", "DM": "ordinal", "LCR": "quantitative", "RM": "quantitative"}


def monotone_classes(table: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """(decreases, compared, holds) of (class_id, item_id, p): neighbours among the classes by mean, item by item."""
    mean = table.withColumn("mean", F.avg("p").over(Window.partitionBy("class_id")))
    before = F.lag("p").over(Window.partitionBy("item_id").orderBy("mean", "class_id"))
    steps = mean.select((F.col("p") < before).cast("long").alias("down")).where("down is not null")
    return steps.agg(F.coalesce(F.sum("down"), F.lit(0)).alias("decreases"), F.count(F.lit(1)).alias("compared")).withColumn("holds", F.col("decreases") <= tolerance * F.col("compared"))


def invariant_items(table: DataFrame, tolerance: float = 0.15, slight: float = 0.05) -> DataFrame:
    """(reversals, compared, holds): pairs of items that two classes order differently, both by more than ``slight``."""
    a, b = table.select("class_id", F.col("item_id").alias("i"), F.col("p").alias("pi")), table.select("class_id", F.col("item_id").alias("j"), F.col("p").alias("pj"))
    gaps = a.join(b, "class_id").where("i < j").select("class_id", "i", "j", (F.col("pi") - F.col("pj")).alias("d"))
    other = gaps.select(F.col("class_id").alias("other"), "i", "j", F.col("d").alias("e"))
    pairs = gaps.join(other, ["i", "j"]).where("class_id < other")
    turned = ((F.signum("d") != F.signum("e")) & (F.abs("d") > slight) & (F.abs("e") > slight)).cast("long")
    return pairs.agg(F.coalesce(F.sum(turned), F.lit(0)).alias("reversals"), F.count(F.lit(1)).alias("compared")).withColumn("holds", F.col("reversals") <= tolerance * F.col("compared"))


def additive_classes(table: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """(variation, compared, holds): mean coefficient of variation, over items, of the logit steps between neighbouring classes.

    Steps of a mean up to 0.1 and steps without spread don't count; without any that does, the structure doesn't hold.
    """
    p = F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.col("p")))
    logit = table.withColumn("logit", F.log(p / (1 - p))).withColumn("mean", F.avg("logit").over(Window.partitionBy("class_id")))
    step = F.col("logit") - F.lag("logit").over(Window.partitionBy("item_id").orderBy("mean", "class_id"))
    steps = logit.select("class_id", step.alias("step")).where("step is not null").groupBy("class_id").agg(F.avg("step").alias("m"), F.stddev_samp("step").alias("sd"))
    cv = steps.where((F.col("sd") > 0) & (F.abs("m") > 0.1)).agg(F.avg(F.col("sd") / F.abs("m")).alias("variation"), F.count(F.lit(1)).alias("compared"))
    return cv.withColumn("holds", F.coalesce(F.col("variation") < tolerance, F.lit(False)))


def read_properties(patterns: DataFrame, n_classes: int = 3, tolerance: float = 0.15, rasch_tolerance: float = 0.25, n_starts: int = 5, seed: int = 1) -> DataFrame:
    """(selected, scale, mon, iio, additive, bic_un, bic_lcr, bic_rm): the orders that free classes keep, and what BIC says of Rasch models.

    With both orders a Rasch model needs a lower BIC, by more than 20 if the classes aren't additive.
    """
    spark = patterns.sparkSession
    free = fit(patterns, "UN", n_classes=n_classes, n_starts=n_starts, seed=seed)
    table = class_table(spark, free).where("category > 0").groupBy("class_id", "item_id").agg((F.sum(F.col("category") * F.col("p"))).alias("p"))
    mon, iio = monotone_classes(table, tolerance).first()["holds"], invariant_items(table, tolerance).first()["holds"]
    additive = additive_classes(table, rasch_tolerance).first()["holds"]
    bic = {f.model: N._bic(f) for f in (free, fit(patterns, "LCR", n_classes=n_classes, n_starts=n_starts, seed=seed), fit(patterns, "RM"))}
    rasch = min(("RM", "LCR"), key=lambda m: (bic[m], m))
    margin = bic["UN"] - bic[rasch]
    if mon and iio:
        selected = rasch if margin > (0 if additive else 20) else "DM"
    elif additive and margin > 0:
        selected = rasch
    else:
        selected = "IIO" if iio else "MON" if mon else "UN"
    row = (selected, SCALE[selected], mon, iio, additive, bic["UN"], bic["LCR"], bic["RM"])
    return spark.createDataFrame([row], "selected string, scale string, mon boolean, iio boolean, additive boolean, bic_un double, bic_lcr double, bic_rm double")


TESTS = "step int, test string, statistic double, p double, cutoff double, replicates long, holds boolean, selected string"


class _Record:
    """The tests of a selection, in turn."""

    def __init__(self, patterns: DataFrame):
        self.spark, self.rows = patterns.sparkSession, []

    def add(self, name: str, observed: float, null: DataFrame, alpha: float, least: float = 0.0, lower: bool = False) -> bool:
        """Whether the restricted model stays: not rejected, or both the statistic and what chance gives are under ``least``."""
        t = C.bootstrap_p(null, observed, lower=lower).first()
        if not t["replicates"]:
            raise ValueError(f"no replicate of {name} could be fitted")
        holds = t["p"] > alpha or (t["cutoff"] < least and observed < least)
        self.rows.append((len(self.rows) + 1, name, float(observed), float(t["p"]), float(t["cutoff"]), t["replicates"], holds, None))
        return holds

    def add_posets(self, packed: DataFrame, patterns: DataFrame, n_classes: int, sides: tuple[str, ...], bound: float, alpha: float, options: dict) -> None:
        """A row per side with the pairs shown to be ordered, of how many; its shape is in the name.  Two classes have no partial order."""
        sides = tuple(s for s in sides if s == "item" or n_classes > 2)
        if not sides:
            return
        for r in P.refine(packed, patterns, n_classes, options["replicates"], bound, alpha, options["n_starts"], sides, options["seed"])[1].orderBy("side").collect():
            kind = f" ({r['kind']})" if r["kind"] else ""
            self.rows.append((len(self.rows) + 1, f"{r['side']} poset: {r['shape']}{kind}", float(r["comparable"]), None, float(r["total"]), None, r["comparable"] > 0, None))

    def result(self, selected: str) -> DataFrame:
        return self.spark.createDataFrame([*self.rows, (len(self.rows) + 1, None, None, None, None, None, None, selected)], TESTS)


def _quantitative(packed: DataFrame, patterns: DataFrame, record: _Record, grain: range, alpha: float, least: float, options: dict) -> str:
    """DM, LCR or RM: additive classes against ordered ones, as many as the scores can tell apart, then the Rasch model against classes."""
    top = patterns.select(F.posexplode("x").alias("item", "v")).groupBy("item").agg(F.max("v").alias("top")).agg(F.sum("top")).first()[0]
    bridge = max(2, math.ceil((top + 1) / 2))
    starts, seed = options["n_starts"], options["seed"]
    low, high = (fit(patterns, m, n_classes=bridge, n_starts=starts, seed=seed) for m in ("LCR", "DM"))
    if not record.add("LCR against DM", *N.likelihood_ratio_test(packed, patterns, low, high, **options), alpha, least):
        return "DM"
    sizes = tuple(sorted({c for c in grain if c >= 2} | {bridge}))
    observed, null = N.rasch_against_classes(packed, patterns, fit(patterns, "RM"), sizes, **options)
    return "RM" if record.add("RM against LCR", observed, null, alpha, lower=True) else "LCR"


def select_by_tests(packed: DataFrame, patterns: DataFrame, classes: range = range(1, 7), alpha: float = 0.05, replicates: int = N.REPLICATES, n_starts: int = 5, least: float = 1.0, joint: bool = False, seed: int = 1, reselect: bool = False, severe: bool = False, posets: bool = True, slight: float = 0.01) -> DataFrame:
    """``TESTS``: bootstrap likelihood-ratio tests along the lattice of orders, then the quantitative edge; the last row names the choice.

    MON and IIO are tested against free classes, DM against both if both hold (``joint``: DM against free classes first).
    If both hold and DM doesn't, the likelier of the two is chosen.  The number of classes is that of least BIC, two at least;
    ``reselect`` repeats that choice in every replicate of the tests of order.  With ``severe`` a rejected order stays if ratios
    under the general fit aren't separated from the null's.  Sides whose order doesn't hold are searched for partial orders
    (``posets``), with the tolerance ``slight`` at 1,500 persons and more for fewer.
    """
    with kept(packed) as packed, kept(patterns) as patterns:
        return _by_tests(packed, patterns, classes, alpha, replicates, n_starts, least, joint, seed, reselect, severe, posets, slight)


def _by_tests(packed: DataFrame, patterns: DataFrame, classes: range, alpha: float, replicates: int, n_starts: int, least: float, joint: bool, seed: int, reselect: bool, severe: bool, posets: bool, slight: float) -> DataFrame:
    options = {"replicates": replicates, "n_starts": n_starts, "seed": seed}
    _, best = S.select_n_classes(patterns, classes, n_starts=n_starts, seed=seed)
    c = max(2, len(best.weights))
    fits = {m: fit(patterns, m, n_classes=c, n_starts=n_starts, seed=seed) for m in ("UN", "MON", "IIO", "DM")}
    record = _Record(patterns)
    again = {**options, "reselect": tuple(classes) if reselect else (), "selection": "UN"}

    def holds(low: str, high: str) -> bool:
        observed, null = N.likelihood_ratio_test(packed, patterns, fits[low], fits[high], **again)
        with kept(null) as null:
            stays = record.add(f"{low} against {high}", observed, null, alpha, least)
            if not stays and severe and not N.severity(packed, patterns, fits[low], fits[high], null, **again).first()["separated"]:
                record.rows[-1] = (*record.rows[-1][:6], True, None)
                return True
        return stays

    double = joint and holds("DM", "UN")
    selected = "DM" if double else "UN"
    if not double:
        mon, iio = holds("MON", "UN"), holds("IIO", "UN")
        if mon and iio:
            likelier = "IIO" if fits["IIO"].loglik > fits["MON"].loglik else "MON"
            selected = "DM" if not joint and holds("DM", "IIO") and holds("DM", "MON") else likelier
        elif mon or iio:
            selected = "MON" if mon else "IIO"
    if selected == "DM":
        selected = _quantitative(packed, patterns, record, classes, alpha, least, options)
    elif posets:
        bound = slight * math.sqrt(1500 / max(fits["UN"].n_obs, 1))
        record.add_posets(packed, patterns, c, {"UN": ("class", "item"), "MON": ("item",), "IIO": ("class",)}[selected], bound, alpha, options)
    return record.result(selected)


def least_decrease(p: np.ndarray) -> float:
    """Decreases over classes per item, for the order of classes that has least; more than five classes are ordered by mean."""
    orders = permutations(range(len(p))) if len(p) <= 5 else [tuple(np.argsort(p.mean(1), kind="stable"))]
    return min(float(np.maximum(0, -np.diff(p[list(o)], axis=0)).sum()) for o in orders) / p.shape[1]


def select_by_axes(packed: DataFrame, patterns: DataFrame, n_classes: int = 3, grain: range = range(2, 5), alpha: float = 0.05, replicates: int = 49, n_starts: int = 5, least: float = 1.0, slight: float = 0.01, seed: int = 1, most: int = 999, posets: bool = True, null_classes: range = range(2, 7)) -> DataFrame:
    """``TESTS``: item order by crossings of rest-score curves, class order by the decreases of free classes over resamples.

    The two axes give UN, MON, IIO or DM; DM goes on to the quantitative edge.  The null of item order has as many classes as
    make the BIC least, and goes on to ``most`` replicates where its p-value can't decide.  Class order holds if the 5 % quantile
    of the decreases is at most ``slight`` at 1,500 persons, and more for fewer.  A side whose order is rejected is searched for
    a partial order: a row with the number of pairs shown to be ordered, and its shape in the test's name.
    """
    with kept(packed) as packed, kept(patterns) as patterns:
        return _by_axes(packed, patterns, n_classes, grain, alpha, replicates, n_starts, least, slight, seed, most, posets, null_classes)


def _by_axes(packed: DataFrame, patterns: DataFrame, n_classes: int, grain: range, alpha: float, replicates: int, n_starts: int, least: float, slight: float, seed: int, most: int, posets: bool, null_classes: range) -> DataFrame:
    options = {"replicates": replicates, "n_starts": n_starts, "seed": seed}
    record = _Record(patterns)
    sizes = sorted({n_classes, *(c for c in null_classes if c >= n_classes)})
    ordered = min((fit(patterns, "IIO", n_classes=c, n_starts=n_starts, seed=seed) for c in sizes), key=N._bic)
    observed = N.ordering_null(packed, patterns, ordered, 1, seed=seed)[0]
    null, _ = N.in_stages(lambda first, n: N.ordering_null(packed, patterns, ordered, n, seed=seed, first=first)[1], observed, replicates, most, alpha)
    iio = record.add("item order", observed, null, alpha)
    free = fit(patterns, "UN", n_classes=n_classes, n_starts=n_starts, seed=seed)
    n_cat = free.probs.shape[2]

    few = max(replicates // 2, 20)
    drawn = N.refitted(resampled(packed, few, seed), few, n_cat, {"UN": Refit("UN", n_classes)}, lambda get: least_decrease(get("UN").probs @ np.arange(n_cat)), N.is_large(patterns), n_starts, seed)
    low = drawn.where("not failed").agg(F.percentile("statistic", F.lit(0.05)).alias("low"), F.count(F.lit(1)).alias("n")).first()
    bound = slight * math.sqrt(1500 / max(free.n_obs, 1))
    mon = low["low"] is not None and low["low"] <= bound
    record.rows.append((len(record.rows) + 1, "class order", least_decrease(free.probs @ np.arange(n_cat)), None, low["low"], low["n"], mon, None))
    selected = {(True, True): "DM", (True, False): "MON", (False, True): "IIO", (False, False): "UN"}[mon, iio]
    if selected == "DM":
        selected = _quantitative(packed, patterns, record, grain, alpha, least, options)
    if posets:
        record.add_posets(packed, patterns, n_classes, tuple(side for side, holds in (("class", mon), ("item", iio)) if not holds), bound, alpha, options)
    return record.result(selected)


def check_hierarchy(packed: DataFrame, patterns: DataFrame, levels: tuple[str, ...] = ("single", "double", "triple"), replicates: int = N.REPLICATES, alpha: float = 0.05, seed: int = 1, which: str | int = "all", drawn: DataFrame | None = None) -> DataFrame:
    """(name, statistic, p, adjusted, reject) of the cancellation checks against their nulls, adjusted after Holm.

    All levels check the same replicates, drawn given everyone's total unless others are given as ``drawn``.  They check every
    sub-matrix; fewer than 59 replicates can't reject one of three levels at 0.05.
    """
    rows = []
    with kept(patterns) as patterns, kept(N.conditional_replicates(packed, N.fit_conditional(patterns), replicates, seed) if drawn is None else drawn) as drawn:
        for level in levels:
            observed, null = N.cancellation_null(packed, patterns, level, replicates, seed=seed, which=which, drawn=drawn)
            rows.append((level, float(observed), float(C.bootstrap_p(null, observed).first()["p"])))
    table = patterns.sparkSession.createDataFrame(rows, "name string, statistic double, p double")
    return C.holm(table).join(table.select("name", "statistic"), "name").select("name", "statistic", "p", "adjusted", (F.col("adjusted") <= alpha).alias("reject"))


def verdict(scale: str | None, axioms: list[bool | None]) -> str:
    """The verdict on the model's scale (null if none could be chosen) and the axiom routes (null if one couldn't be run)."""
    votes = [v for v in axioms if v is not None]
    if scale is None and not votes:
        return "INCONCLUSIVE"
    if scale == "classificatory":
        return "CLASSIFICATORY"
    if scale == "quantitative":
        return "QUANT_AXIOMS_UNAVAILABLE" if not votes else "QUANT_WELL_SUPPORTED" if all(votes) else "QUANT_QUALIFIED" if any(votes) else "QUANT_WEAK_AXIOMS"
    if scale == "ordinal":
        return "BORDERLINE" if votes and all(votes) else "ORDINAL"
    return "INCONCLUSIVE"


def full_reading(packed: DataFrame, patterns: DataFrame, classes: range = range(1, 7), replicates: int = N.REPLICATES, draws: int = 10_000, synthetic: int = 100, n_bands: int = 6, n_starts: int = 5, alpha: float = 0.05, seed: int = 1) -> DataFrame:
    """(route, outcome, supports): model selection, cancellation checks and the omnibus test, and the verdict of all three.

    A route that can't be run, for the table or in a task, has a null vote, which counts neither way.
    """
    with kept(packed) as packed, kept(patterns) as patterns:
        return _full_reading(packed, patterns, classes, replicates, draws, synthetic, n_bands, n_starts, alpha, seed)


#: What makes a route unavailable; an error in a task arrives as the second.
UNAVAILABLE = (ValueError, PythonException)


def _reason(error: Exception) -> str:
    """The last line of an error that says something."""
    return next((line.strip() for line in reversed(str(error).splitlines()) if line.strip()), type(error).__name__)


def _full_reading(packed: DataFrame, patterns: DataFrame, classes: range, replicates: int, draws: int, synthetic: int, n_bands: int, n_starts: int, alpha: float, seed: int) -> DataFrame:
    rows: list[tuple[str, str, bool | None]] = []
    try:
        model = select_by_tests(packed, patterns, classes, alpha, replicates, n_starts, seed=seed).where("selected is not null").first()["selected"]
        scale: str | None = SCALE[model]
        rows.append(("models", model, scale == "quantitative"))
    except UNAVAILABLE as error:
        scale = None
        rows.append(("models", _reason(error), None))
    try:
        rejected = [r["name"] for r in check_hierarchy(packed, patterns, replicates=replicates, alpha=alpha, seed=seed).where("reject").collect()]
        rows.append(("cancellation", "rejected: " + ", ".join(sorted(rejected)) if rejected else "holds", not rejected))
    except UNAVAILABLE as error:
        rows.append(("cancellation", _reason(error), None))
    try:
        tested = omnibus_null(packed, patterns, n_bands, replicates, draws, synthetic, seed + 2).select("rep", "statistic").persist()
        observed = tested.where("rep = -1").first()["statistic"]
        reject = C.bootstrap_p(tested.where("rep >= 0"), observed, alpha).first()["reject"]
        tested.unpersist()
        rows.append(("omnibus", "rejected" if reject else "holds", not reject))
    except UNAVAILABLE as error:
        rows.append(("omnibus", _reason(error), None))
    rows.append(("verdict", verdict(scale, [v for route, _, v in rows if route != "models"]), None))
    return patterns.sparkSession.createDataFrame(rows, "route string, outcome string, supports boolean")
