"""Quality rules with risk-controlled cutoffs. DataFrame functions only.

Each rule rejects a document whose feature exceeds a cutoff. Cutoffs come from fixed grids, per stratum (language). The
exact binomial test asks of the labelled documents whether at most ``alpha`` of the good ones are lost to the rules,
base rules aside. Along a path of ever tighter cutoffs the tests run in a fixed order, loosest first, and stop at the
first that fails, so a path as a whole costs one test (fixed-sequence testing). The family-wise error ``delta`` is
shared by Bonferroni over the strata, and within a stratum half of it goes to the path on which all rules tighten
together, the other half to one path per rule. If the common path gets anywhere, its cutoffs hold; else (one rule rejects
good documents however loose) each rule holds as far as its own path got, with its share of ``alpha``, as the
risks of the rules add up. A rule whose path fails at once is not applied in that stratum.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.once import computed_once
from tamarack.llm.common import ascii_strip

SYMBOLS = r"[#*$%&|<>]"
CAPITALS = r"\p{Lu}+"
BLANK_RUN = r"[\x20\x09-\x0D]+"
STRATA = ("de", "en", "es", "fr")
# Feature -> grid of cutoffs, fixed before any label is seen.
GRIDS: Mapping[str, Sequence[float]] = {
    "symbol_share": (0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.4),
    "dup_line_share": (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.9),
    "repeat_share": (0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.6),
    "upper_share": (0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6),
}


@dataclass(frozen=True)
class RiskControl:
    """``alpha``: share of good documents that may be rejected in a stratum; ``delta``: chance that the bound fails.

    ``grids``: cutoffs of each rule, ascending. A stratum needs about 210 good labelled documents before a cutoff can pass.
    """

    alpha: float = 0.025
    delta: float = 0.05
    strata: Sequence[str] = STRATA
    grids: Mapping[str, Sequence[float]] = field(default_factory=lambda: GRIDS)

    def paths(self) -> list[Path]:
        """The common path, then one of each rule. The strata count one more: the other languages."""
        share = self.delta / 2 / (len(self.strata) + 1)
        longest = max(len(g) for g in self.grids.values())
        common = [{r: g[max(len(g) - 1 - i, 0)] for r, g in self.grids.items()} for i in range(longest)]
        alone = [Path(r, [{r: c} for c in reversed(g)], self.alpha / len(self.grids), share / len(self.grids)) for r, g in self.grids.items()]
        return [Path(COMMON, common, self.alpha, share), *alone]


COMMON = "all"


@dataclass(frozen=True)
class Path:
    """Cutoffs (by rule) from the loosest step to the tightest, the risk that each test bounds, and the level of the tests."""

    name: str
    steps: Sequence[Mapping[str, float]]
    alpha: float
    level: float


def text_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines_with_words, n_upper.

    Words are runs of anything but ASCII blanks. All counts are computed inside the row: nothing is exploded or
    shuffled. The positions of repeated 3-word windows come from sorting (hash, position) pairs, so the work is
    n log n in the words of a text. Null text has no words; lines without a word do not count.
    """
    own = list(docs.columns)
    keep = [F.col(f"`{c}`") for c in own]
    text = F.coalesce(F.col("text"), F.lit(""))
    p1 = docs.select(*keep, ascii_strip(text).alias("_t"),
                     F.filter(F.split(text, "\n", -1), lambda x: ascii_strip(x) != "").alias("_lines"))
    p2 = p1.select(*keep, "_t", "_lines", F.when(F.col("_t") == "", F.array().cast("array<string>"))
                   .otherwise(F.split("_t", BLANK_RUN, -1)).alias("_words"))
    p3 = p2.select(
        *keep, F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.char_length("_t") - F.char_length(F.regexp_replace("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines_with_words"),
        (F.char_length("_t") - F.char_length(F.regexp_replace("_t", CAPITALS, ""))).cast("long").alias("n_upper"),
        F.expr("CASE WHEN size(_words) > 3 THEN transform(sequence(0, size(_words) - 3),"
               " i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])) END").alias("_grams"),
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines_with_words", "n_upper"]
    p4 = p3.select(*keep, *counts, F.expr(
        "CASE WHEN size(array_distinct(_grams)) < size(_grams) THEN"
        " sort_array(transform(_grams, (g, i) -> struct(g, i))) END").alias("_sorted"))
    p5 = p4.select(*keep, *counts, F.expr(
        "sort_array(transform(filter(_sorted, (x, i) -> get(_sorted, i - 1).g <=> x.g OR get(_sorted, i + 1).g <=> x.g),"
        " x -> x.i))").alias("_places"))
    covered = F.expr("aggregate(transform(_places, (p, i) -> CASE WHEN i = 0 THEN 3 ELSE least(3, p - _places[i - 1]) END),"
                     " 0, (s, x) -> s + x)")
    whole = p5.select(*keep, *counts, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    # a later filter on the counts must not pull the array work into itself
    return computed_once(whole, {c: F.col(c) for c in [*counts, "n_repeat_words"]})


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def features() -> dict[str, Column]:
    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")), F.lit(0.0))

    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines_with_words"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
    }


def _log_gamma(x: Column) -> Column:
    """ln gamma(x) for x >= 1: Stirling's series at x + 8."""
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7))
    shift = F.lit(0.0)
    for i in range(8):
        shift = shift + F.ln(x + i)
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), exact to double precision where k <= n * p, and 1 beyond.

    The terms fall from ``k`` downwards like a Gaussian of variance below ``n * p``; what lies more than twelve
    deviations (and 60 terms) below is under the precision of a double.
    """
    k, n = k.cast("double"), n.cast("double")
    at_k = F.exp(_log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1)
                 + k * math.log(p) + (n - k) * math.log1p(-p))
    steps = F.least(k, F.ceil(12 * F.sqrt(n * p)) + 60).cast("long")
    grown = F.aggregate(
        F.sequence(F.lit(0).cast("long"), steps), F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")),
        lambda s, j: F.struct((s["term"] * (k - j) / (n - k + j + 1) * ((1 - p) / p)).alias("term"),
                              (s["total"] + s["term"]).alias("total")),
        lambda s: s["total"],
    )
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.least(at_k * grown, F.lit(1.0)))


def stratum(control: RiskControl) -> Column:
    return F.when(F.col("lang").isin(*control.strata), F.col("lang")).otherwise("other")


def risk_controlled_cutoffs(labelled: DataFrame, control: RiskControl) -> DataFrame:
    """One row per stratum that has good labelled documents: _stratum and a map ``_cutoffs`` from rule to cutoff.

    ``labelled`` has lang, good (boolean) and the statistics. At most ``len(strata) + 1`` rows. All labelled rows count.
    """
    rules, paths = features(), control.paths()

    def lost(step: Mapping[str, float]) -> Column:
        """Good documents that only these cutoffs reject."""
        over = F.greatest(F.lit(False), *[rules[r] > c for r, c in step.items()])
        return F.count_if(over & ~base_failed())

    counted = (
        labelled.filter("good").groupBy(stratum(control).alias("_stratum"))
        .agg(F.count(F.lit(1)).alias("_n"), *[F.array(*[lost(step) for step in p.steps]).alias(p.name) for p in paths])
    )

    def reached(p: Path) -> Column:
        """Steps of a path before the first that fails."""
        fails = F.transform(F.col(p.name), lambda k: binomial_tail(k, F.col("_n"), p.alpha) > p.level)
        first = F.array_position(fails, True)
        return F.when(first == 0, F.lit(len(p.steps))).otherwise(first - 1).cast("int")

    # a step is looked up by its number: no step, no cutoff
    far = counted.select("_stratum", *[reached(p).alias(p.name) for p in paths])
    common, *alone = paths
    entries = [
        F.struct(F.lit(p.name).alias("rule"), F.when(
            F.col(common.name) > 0, F.get(F.array(*[F.lit(step[p.name]) for step in common.steps]), F.col(common.name) - 1)
        ).otherwise(F.get(F.array(*[F.lit(step[p.name]) for step in p.steps]), F.col(p.name) - 1)).alias("cutoff"))
        for p in alone
    ]
    return far.select("_stratum", F.map_from_entries(F.filter(F.array(*entries), lambda e: e["cutoff"].isNotNull())).alias("_cutoffs"))


def learn_cutoffs(statistics: DataFrame, labels: DataFrame, control: RiskControl | None = None) -> DataFrame:
    """:func:`risk_controlled_cutoffs` of the documents of ``statistics`` that ``labels`` (doc_id, quality: 1 is good) covers.

    Several labels of a document count as good if one is; labels without a document, null labels and null ids play
    no part. Without good labels there is no cutoff.
    """
    good = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(
        (F.max("quality") == 1).alias("good"))
    return risk_controlled_cutoffs(statistics.join(good, "doc_id"), control or RiskControl())


def judge(statistics: DataFrame, cutoffs: DataFrame, control: RiskControl | None = None) -> DataFrame:
    """``statistics`` (lang and the columns of :func:`text_statistics`) with base_failed, rejected_by and kept.

    A document that exceeds a cutoff of its stratum is rejected; null or unknown languages form the stratum ``other``.
    ``cutoffs`` has a row per stratum at most, so it is broadcast.
    """
    control = control or RiskControl()
    judged = statistics.withColumn("_s", stratum(control)).join(F.broadcast(cutoffs), F.col("_s") == F.col("_stratum"), "left")
    broken = [F.when(v > F.try_element_at("_cutoffs", F.lit(r)), F.lit(r)) for r, v in features().items() if r in control.grids]
    return (
        judged.withColumn("base_failed", base_failed()).withColumn("rejected_by", F.array_compact(F.array(*broken)))
        .withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("_s", "_stratum", "_cutoffs")
    )
