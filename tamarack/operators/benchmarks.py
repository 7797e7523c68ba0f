"""Benchmarks for requests that lack evidence: the most detailed row that a benchmark table has for a customer type and country.

A benchmark row states the value of a metric for a customer type, a country and a currency, any of them null for "all".
A request looks for its own type and country, then for wider levels, down to the row that holds for all. Requests with
equal type, country and currency share one answer, so the levels are looked up once per distinct combination: one
equality join on the keys of all levels, of which the nearest is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.text import has_any, low

BENCHMARKS_DDL = "metric string, customer_type string, country string, currency string, value double, name string"
METRICS = ("customers", "revenue", "serviceable_pct")

# Classes of customer types, by the first rule whose words a type holds. Sizes of firms are asked first
# for numbers of customers, kinds of facilities first for revenues.
_SIZES = (("smb", ("smb", "small", "msme")), ("enterprise", ("enterprise", "large")), ("mid-market", ("mid",)))
_FACILITIES = (("hospital", ("hospital",)), ("laboratory", ("diagnostic", "lab")), ("pharmacy", ("pharmacy",)), ("clinic", ("clinic", "practice")))
CLASSES = {
    "customers": _SIZES + _FACILITIES,
    "revenue": _FACILITIES + (_SIZES[1], _SIZES[2], _SIZES[0]),
}
# Other names of countries.
COUNTRY_NAMES = {
    "us": "united states", "usa": "united states", "u.s.": "united states", "united states of america": "united states",
    "uk": "united kingdom", "great britain": "united kingdom", "uae": "united arab emirates", "bharat": "india",
}
# Levels from the nearest on: the parts of a request that the row must state.
LEVELS = (("type", "country"), ("class", "country"), ("type",), ("class",), ("country",), ())
_ANY = ""


def customer_class(customer_type: Column, metric: str) -> Column:
    """Class of a customer type, null if no rule holds."""
    text, out = low(customer_type), F.lit(None).cast("string")
    for name, words in reversed(CLASSES.get(metric, CLASSES["customers"])):
        out = F.when(has_any(text, words), name).otherwise(out)
    return out


def country_name(country: Column) -> Column:
    """Lower-case name of a country, its common other names replaced."""
    c = low(country)
    names = F.create_map(*[F.lit(x) for pair in COUNTRY_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, c), c)


def _keys(metrics) -> Column:
    """Of a combination (_type, _country, _currency): all keys under which a row may answer it, with their level."""
    keys = []
    for metric in metrics:
        parts = {"type": F.col("_type"), "class": customer_class(F.col("_type"), metric), "country": F.col("_country")}
        for i, level in enumerate(LEVELS):
            who = next((parts[p] for p in level if p != "country"), F.lit(_ANY))
            where = parts["country"] if "country" in level else F.lit(_ANY)
            stated = F.lit(True)
            for p in level:
                stated = stated & F.coalesce(parts[p] != _ANY, F.lit(False))
            for j, currency in enumerate((F.col("_currency"), F.lit(_ANY))):
                exists = stated & (F.col("_currency") != _ANY) if j == 0 else stated
                keys.append(F.when(exists, F.struct(
                    F.lit(metric).alias("metric"), who.alias("_who"), where.alias("_where"), currency.alias("_money"), F.lit(2 * i + j).alias("level"))))
    return F.array_compact(F.array(*keys))


def choose_benchmarks(requests: DataFrame, benchmarks: DataFrame, metrics=METRICS) -> DataFrame:
    """Add ``benchmark_<metric>`` and ``benchmark_<metric>_name`` to requests (customer_type, target_country, currency).

    ``benchmarks`` follows ``BENCHMARKS_DDL``. A row of the request's currency goes before one for all currencies at the
    same level, the level before the currency. Names of types and countries are compared in lower case; a row may also
    name a class of types (``CLASSES``). Of rows with the same key the one with the smallest name, then value, counts;
    rows without a value never do. A metric that no row states stays null.
    """
    missing = {c: F.lit(None).cast("string") for c in ("customer_type", "target_country", "currency") if c not in requests.columns}
    df = requests.withColumns(missing) if missing else requests
    parts = {"_type": low(F.col("customer_type")), "_country": country_name(F.col("target_country")), "_currency": F.upper(low(F.col("currency")))}
    df = df.withColumns(parts)
    rows = benchmarks.filter(F.col("value").isNotNull()).select(
        "metric", low(F.col("customer_type")).alias("_who"), country_name(F.col("country")).alias("_where"),
        F.upper(low(F.col("currency"))).alias("_money"), F.struct("name", "value").alias("row"))
    rows = rows.groupBy("metric", "_who", "_where", "_money").agg(F.min("row").alias("row"))
    asked = df.select(*parts).distinct().withColumn("k", F.explode(_keys(metrics))).select(*parts, "k.*")
    met = asked.join(rows, ["metric", "_who", "_where", "_money"])
    best = [F.min_by(F.when(F.col("metric") == m, F.col("row")), F.when(F.col("metric") == m, F.col("level"))).alias(f"_{m}") for m in metrics]
    chosen = met.groupBy(*parts).agg(*best)
    out = df.join(chosen, list(parts), "left").drop(*parts, *missing)
    return out.withColumns({
        **{f"benchmark_{m}": F.col(f"_{m}.value") for m in metrics}, **{f"benchmark_{m}_name": F.col(f"_{m}.name") for m in metrics},
    }).drop(*[f"_{m}" for m in metrics])
