"""Text to claims.

A document row becomes sentence rows, a sentence row becomes claim rows. Five claim families are tried
in order (range, approximate, money, count, percent); a match is kept only when its span overlaps no
span kept before it. All of it is built-in expressions: regex passes mark matches, higher-order
functions fold over the (few) matches of one sentence, one ``explode`` makes the rows. There is no
shuffle and no Python worker, so the work is split exactly as the scan is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack import terms
from tamarack.functions import text as tx
from tamarack.functions.claim_rules import CONTEXT_TERMS, context_flags, metric_type_in_context
from tamarack.functions.once import compiled_once

_MULT = r"(thousand|million|billion|trillion|crore|lakh|mn|bn|k|b|m)?"
_CUR = r"(?:USD|\$|INR|₹|EUR|€|GBP|£)?"
# Under the flags iU a range of digits is compared in both cases of each character; without i it finds the same digits faster.
_PLAIN = r"((?-i)[0-9]+(?:\.[0-9]+)?)"
# Thousands groups are taken possessively, which the regex engine does in a loop: no number of groups exhausts its
# stack. What could be given back is the last group alone, where something else than a claim follows it: the
# second branch.
_NUMBER = r"(?:[0-9]+(?:,[0-9]+)*+(?:\.[0-9]+)?|[0-9]+(?:,[0-9]+(?=,[0-9]))*+)"
_GROUPED = f"((?-i){_NUMBER})"
# A look ahead of each pattern passes over the places where none of its matches begins, before a word boundary is tested there.
_DIGITS = "0123456789"

RANGE_PATTERN = (
    rf"(?iU)((?=[$₹€£{_DIGITS}]|\s+[{_DIGITS}]|(?=[fbrjiueg])(?:from|between|ranged|jump|increased|grew|rose|usd|inr|eur|gbp))"
    r"\b(?:(?:from|between|ranged from|jump from|increased from|grew from|rose from)\s+)?"
    rf"{_CUR}\s*{_PLAIN}\s*{_MULT}\s*(?:–|-|to|and)\s*{_CUR}\s*{_PLAIN}\s*{_MULT}\s*"
    r"([a-zA-Z%]+(?:\s+[a-zA-Z%]+){0,3})?\b)"
)
# What stands between the numbers of every range: a sentence without it needs no look for the rest.
_RANGE_JOINT = rf"(?U)[0-9](?i)\s*{_MULT}\s*(?:–|-|to|and)\s*{_CUR}\s*[0-9]"
MONEY_PATTERN = (
    rf"(?iU)(?=[vrmwscfpuieg$₹€£{_DIGITS}])"
    r"(?:(?:\b(?:valued at|revenue of|market size of|worth|spending of|cost of|fee of|price of)\s+)?"
    rf"(?:(USD|\$|INR|₹|EUR|€|GBP|£)\s*{_GROUPED}\s*{_MULT}|"
    rf"\b{_GROUPED}\s*{_MULT}\s*(USD|dollars?|INR|rupees?|EUR|euros?|GBP|pounds?))\b)"
)
COUNT_PATTERN = rf"(?iU)(?=[{_DIGITS}])\b{_GROUPED}\s*{_MULT}\s+([a-zA-Z]+(?:\s+[a-zA-Z]+){{0,4}})"
PERCENT_PATTERN = (
    r"(?U)([0-9]+(?:\.[0-9]+)?)(?i)\s*(%|percent|percentage)(?:\s+(?:of\s+)?([a-zA-Z]+(?:\s+[a-zA-Z]+){0,4}))?"
)

# One candidate claim: where it is looked at (s, e), what it would block (rs, re), where place and year
# are read from (ms, me), its content, and what its metric type is decided from.
_CANDIDATE = (
    "struct<family:int,s:int,e:int,rs:int,re:int,ms:int,me:int,metric:string,value:double,raw:string,"
    "unit:string,range_min:double,range_max:double,type_value:double,mult:string,fixed_type:string,"
    "default_type:string,ok:boolean>"
)
_FIELDS = dict(part.split(":") for part in _CANDIDATE[len("struct<"):-1].split(","))
_MONEY_UNITS = ("USD", "INR", "EUR", "GBP")
_PRICE_TITLE, _SIZE_TITLE, _USAGE_TITLE = "annual pricing / ARPU", "market size / revenue", "tariff / usage rate"
_GROWTH_TITLE, _SHARE_TITLE = "growth rate / CAGR", "market share / segment percentage"
FAMILIES = ("range", "approximate", "money", "count", "percent")

# A number has at most one qualifier directly before it, so one pass finds them all. The words that
# follow are only looked at, not consumed: they may hold the next qualifier.
APPROX_PATTERN = (
    rf"(?iU){terms.first_of(terms.QUALIFIERS, ignore_case=True)}\b({terms.prefix_alternation(terms.QUALIFIERS, ignore_case=True)})\s+{_GROUPED}\s*{_MULT}"
    r"(?=(\s+[a-zA-Z%]+(?:\s+[a-zA-Z%]+){0,4})\b)"
)


def _candidate(**given) -> Column:
    cols = [given.get(n, F.lit(None)) for n in _FIELDS]
    cols = [c if isinstance(c, Column) else F.lit(c) for c in cols]
    # field by field: of a field that has its type already nothing is left to do for a row
    return F.struct(*[c.cast(kind).alias(n) for c, (n, kind) in zip(cols, _FIELDS.items())])


def _no_candidates() -> Column:
    return F.array().cast(f"array<{_CANDIDATE}>")


def _bind(rows: Column, **fields) -> Column:
    """Each struct of an array with more fields, computed from it once and then read by name."""
    def more(x):
        return F.struct(x.alias("m"), *[make(x).alias(name) for name, make in fields.items()])

    return F.transform(rows, more)


def _money_code(text: Column) -> Column:
    """Currency written in a raw expression (case-sensitive), null when there is none."""
    return (
        F.when(tx.has_any(text, ("USD", "$", "DOLLAR")), "USD")
        .when(tx.has_any(text, ("INR", "₹", "RUPEE")), "INR")
        .when(tx.has_any(text, ("EUR", "€", "EURO")), "EUR")
        .when(tx.has_any(text, ("GBP", "£", "POUND")), "GBP")
    )


def _last(words: Column) -> Column:
    return F.try_element_at(words, F.lit(-1))


def _macro_multiplier(mult: Column) -> Column:
    return F.coalesce(tx.multiplier_value(mult) >= terms.MACRO_SCALE, F.lit(False)) & mult.isNotNull()


def _is_macro_word(mult: Column) -> Column:
    return F.coalesce(F.lower(mult).isin(*terms.MACRO_MULTIPLIERS), F.lit(False))


def _sentence_flags(s: Column, lowered: Column) -> dict[str, Column]:
    """What the claim families ask of a whole sentence, once for all matches in it."""
    rated = lowered.contains("per")  # what both patterns of a rate begin with
    return {
        **context_flags(lowered),
        "range_per_unit": tx.has_any(lowered, terms.UNIT_SPEND_TERMS) | (rated & s.rlike(terms.PER_UNIT_PATTERN)),
        "range_priced": tx.has_any(lowered, terms.RANGE_PRICE_TERMS) & ~tx.has_any(lowered, terms.RANGE_MACRO_TERMS),
        "growing": tx.has_any(lowered, terms.GROWTH_TERMS),
        "growing_or_scaled": tx.has_any(lowered, terms.GROWTH_TERMS + ("scaled",)),
        "money_per_unit": tx.has_any(lowered, terms.MONEY_UNIT_SPEND_TERMS) | (rated & s.rlike(terms.MONEY_PER_UNIT_PATTERN)),
        "usage_rate": tx.has_any(lowered, terms.USAGE_RATE_TERMS),
        "survey": tx.has_any(lowered, terms.SURVEY_TERMS),
    }


# The terms that a sentence without any of the flags above has none of, but those that hold another one of them.
_FLAG_TERMS = terms.shortest((
    "per", *[w for words in CONTEXT_TERMS.values() for w in words], *terms.UNIT_SPEND_TERMS, *terms.RANGE_PRICE_TERMS, *terms.GROWTH_TERMS,
    "scaled", *terms.MONEY_UNIT_SPEND_TERMS, *terms.USAGE_RATE_TERMS, *terms.SURVEY_TERMS,
))


def _may_match(s: Column, families) -> Column:
    """Whether any family can match at all: of other sentences nothing else need be asked."""
    patterns = {"count": COUNT_PATTERN, "percent": PERCENT_PATTERN, "money": MONEY_PATTERN, "approximate": APPROX_PATTERN, "range": _RANGE_JOINT}
    out = F.lit(False)
    for family, pattern in patterns.items():  # the commonest first
        if family in families:
            out = out | s.rlike(pattern)
    return out


def _range_candidates(s: Column, lowered: Column, seen) -> Column:
    """At most one range per sentence; its value stays null."""
    # One pass: text before the first range, then its groups, between marks.
    marks = "\u0002"
    all_groups = F.split(
        F.regexp_replace(s, r"(?s)^(.*?)" + RANGE_PATTERN + r"(?s:.*)$", marks.join(f"${i}" for i in range(1, 8))),
        marks,
    )

    def g(x, i):
        return F.when(x["p"][i] != "", x["p"][i])

    def is_year(number, mult):
        return mult.isNull() & F.coalesce(number.rlike("^[0-9]+$") & number.try_cast("int").between(1990, 2040), F.lit(False))

    base = F.array(F.struct(all_groups.alias("p")))
    parsed = _bind(
        base,
        start=lambda x: F.length(x["p"][0]),
        end=lambda x: F.length(x["p"][0]) + F.length(x["p"][1]),
        raw=lambda x: tx.strip_all(x["p"][1]),
        a=lambda x: tx.parse_number(g(x, 2), F.coalesce(g(x, 3), g(x, 5))),
        b=lambda x: tx.parse_number(g(x, 4), F.coalesce(g(x, 5), g(x, 3))),
        macro_word=lambda x: _macro_multiplier(g(x, 3)) | _macro_multiplier(g(x, 5)),
        years=lambda x: is_year(g(x, 2), g(x, 3)) | is_year(g(x, 4), g(x, 5)),
        words=lambda x: tx.noun_phrase(tx.split_words(g(x, 6)), terms.RANGE_VERBS, noise_ends=False),
    )
    named = _bind(
        parsed,
        lo=lambda x: F.least(x["a"], x["b"]),
        hi=lambda x: F.greatest(x["a"], x["b"]),
        noun=lambda x: F.when(F.size(x["words"]["np"]) > 0, F.array_join(x["words"]["np"], " ")),
        unit=lambda x: F.coalesce(
            _money_code(x["raw"]), F.when(x["raw"].contains("%"), "%"), _last(x["words"]["np"]), F.lit("units")
        ),
    )
    per_unit_text, priced_text, growing_text = seen["range_per_unit"], seen["range_priced"], seen["growing"]

    def build(x):
        m, unit, hi = x["m"], x["unit"], x["hi"]
        small = hi < terms.MACRO_SCALE
        as_price = (small & (per_unit_text | priced_text)) | ~(m["macro_word"] | ~small)
        is_money = unit.isin(*_MONEY_UNITS)
        growing = growing_text | (hi > 100)
        return _candidate(
            family=0, s=m["start"], e=m["end"], rs=m["start"], re=m["end"], ms=m["start"], me=m["end"], raw=m["raw"],
            metric=F.when(is_money, F.when(as_price, _PRICE_TITLE).otherwise(_SIZE_TITLE))
            .when((unit == "%") & growing, _GROWTH_TITLE)
            .when(unit == "%", F.coalesce(x["noun"], F.lit(_SHARE_TITLE)))
            .otherwise(F.coalesce(x["noun"], unit)),
            unit=unit, range_min=x["lo"], range_max=hi,
            type_value=F.when(is_money, hi),
            fixed_type=F.when(unit == "%", F.when(growing, "growth_rate").otherwise("market_share")),
            default_type=F.when(is_money, F.when(as_price, "average_price").otherwise("market_size")),
            ok=~m["years"] & m["a"].isNotNull() & m["b"].isNotNull()
            & (is_money | (unit == "%") | m["words"]["entity"] | (F.size(m["words"]["np"]) == 0)),
        )

    likely = s.rlike(_RANGE_JOINT)
    return F.when(likely & s.rlike(RANGE_PATTERN), F.transform(named, build)).otherwise(_no_candidates())


def _mentions(lowered: Column, words) -> Column:
    """Plain substring tests: far cheaper than a claim pattern, and usually false."""
    out = F.lit(False)
    for w in words:
        out = out | lowered.contains(w)
    return out


def _approx_candidates(sentence: Column, lowered: Column, seen) -> Column:
    """Qualified numbers ("more than 10 million users") with bounds that follow from the qualifier."""
    parsed = _bind(
        tx.find_all(sentence, APPROX_PATTERN, 4),
        qualifier=lambda m: F.lower(m["g"][1]),
        number=lambda m: tx.group(m, 2),
        mult=lambda m: tx.group(m, 3),
        raw=lambda m: F.concat(m["g"][0], m["g"][4]),
        base=lambda m: tx.parse_number(tx.group(m, 2), tx.group(m, 3)),
        words=lambda m: tx.noun_phrase(tx.split_words(m["g"][4]), terms.TRAILING_VERBS, noise_ends=True),
    )

    def build(x):
        m, qualifier, words, base = x["m"], x["qualifier"], x["words"]["np"], x["base"]
        noun = F.array_join(words, " ")
        loose = qualifier.isin("approximately", "around", "nearly", "about", "estimated")
        exact = F.concat_ws(" ", qualifier, x["number"], x["mult"], noun)
        money = F.when(tx.has_any(x["raw"], ("USD", "$")), "USD").when(tx.has_any(x["raw"], ("INR", "₹")), "INR")
        return _candidate(
            family=1, s=m["s"], e=m["s"] + F.length(x["number"]), rs=m["s"], re=m["s"] + F.length(exact), ms=m["s"],
            me=m["e"] + F.length(m["g"][4]), metric=noun, raw=exact, unit=F.coalesce(money, _last(words)),
            range_min=base * F.when(qualifier.isin("more than", "at least"), 1.0).when(loose, 0.9).otherwise(0.95),
            range_max=base * F.when(qualifier == "up to", 1.0).when(loose, 1.1).otherwise(1.05),
            ok=(F.size(words) > 0) & base.isNotNull() & (x["words"]["entity"] | money.isNotNull()),
        )

    return F.when(_mentions(lowered, terms.QUALIFIERS), F.transform(parsed, build)).otherwise(_no_candidates())


def _money_candidates(sentence: Column, lowered: Column, seen) -> Column:
    per_unit_text, usage = seen["money_per_unit"], seen["usage_rate"]
    parsed = _bind(
        tx.find_all(sentence, MONEY_PATTERN, 6),
        code=lambda m: _money_code(F.upper(F.coalesce(tx.group(m, 1), tx.group(m, 6)))),
        mult=lambda m: F.when(m["g"][1] != "", tx.group(m, 3)).otherwise(tx.group(m, 5)),
        value=lambda m: F.when(m["g"][1] != "", tx.parse_number(m["g"][2], m["g"][3])).otherwise(
            tx.parse_number(m["g"][4], m["g"][5])
        ),
    )

    def build(x):
        m, value = x["m"], x["value"]
        as_price = ~(_is_macro_word(x["mult"]) | (value >= terms.MACRO_SCALE)) | per_unit_text
        return _candidate(
            family=2, s=m["s"], e=m["e"], rs=m["s"], re=m["e"], ms=m["s"], me=m["e"],
            metric=F.when(usage, _USAGE_TITLE).when(as_price, _PRICE_TITLE).otherwise(_SIZE_TITLE),
            value=value, raw=tx.strip_all(m["g"][0]), unit=x["code"], type_value=value, mult=x["mult"],
            default_type=F.when(usage, F.lit(None)).when(as_price, "average_price").otherwise("market_size"),
            ok=value.isNotNull(),
        )

    marks = ("$", "₹", "€", "£", "usd", "inr", "eur", "gbp", "dollar", "rupee", "pound")
    return F.when(_mentions(lowered, marks), F.transform(parsed, build)).otherwise(_no_candidates())


_HEAD_COUNT_TYPES = ("population", "customer_count", "users", "student_count", "households")


def _count_candidates(sentence: Column, lowered: Column, seen) -> Column:
    survey = seen["survey"]
    # a noun phrase that ends before its first word holds no entity: what follows is not asked of such a number
    def may_count(m):
        return ~F.lower(F.split(m["g"][3], r"(?U)\s+", 2)[0]).isin(*terms.STOP_WORDS, *terms.NOISE_WORDS)

    parsed = _bind(
        F.filter(tx.find_all(sentence, COUNT_PATTERN, 3), may_count),
        before=lambda m: F.substring(sentence, m["s"], F.when(m["s"] > 0, 1).otherwise(0)),
        number=lambda m: tx.group(m, 1),
        mult=lambda m: tx.group(m, 2),
        value=lambda m: tx.parse_number(tx.group(m, 1), tx.group(m, 2)),
        words=lambda m: tx.noun_phrase(tx.split_words(m["g"][3]), terms.TRAILING_VERBS, noise_ends=True),
    )
    named = _bind(
        parsed,
        noun=lambda x: F.array_join(x["words"]["np"], " "),
        lowered=lambda x: F.lower(F.array_join(x["words"]["np"], " ")),
        unit=lambda x: F.lower(_last(x["words"]["np"])),
    )

    def build(x):
        p = x["m"]
        m, number, value = p["m"], p["number"], p["value"]
        bare_year = p["mult"].isNull() & F.regexp_replace(number, ",", "").rlike(r"^(?:19[0-9][0-9]|20[0-3][0-9])$")
        kind = metric_type_in_context(
            x["lowered"], x["unit"], seen, F.lit(None).cast("double"), F.lit(None).cast("string")
        )
        tiny = p["mult"].isNull() & (value < 50) & ~survey & F.coalesce(kind.isin(*_HEAD_COUNT_TYPES), F.lit(False))
        raw = F.concat_ws(" ", number, p["mult"], x["noun"])
        return _candidate(
            family=3, s=m["s"], e=m["s"] + F.length(number), rs=m["s"], re=m["s"] + F.length(raw), ms=m["s"], me=m["e"],
            metric=x["noun"], value=value, raw=raw, unit=x["unit"],
            ok=~p["before"].isin("$", "₹", "€", "£") & ~bare_year & value.isNotNull() & p["words"]["entity"] & ~tiny,
        )

    return F.transform(named, build)


def _percent_candidates(sentence: Column, lowered: Column, seen) -> Column:
    growing_text = seen["growing_or_scaled"]
    parsed = _bind(
        tx.find_all(sentence, PERCENT_PATTERN, 3),
        value=lambda m: m["g"][1].try_cast("double"),
        words=lambda m: tx.without_words(tx.split_words(m["g"][3]), terms.PERCENT_DROP_WORDS),
    )

    def build(x):
        m, value = x["m"], x["value"]
        growing = growing_text | (value > 100)
        return _candidate(
            family=4, s=m["s"], e=m["e"], rs=m["s"], re=m["e"], ms=m["s"], me=m["e"],
            metric=F.when(growing, _GROWTH_TITLE).when(F.size(x["words"]) > 0, F.array_join(x["words"], " "))
            .otherwise(_SHARE_TITLE),
            value=value, raw=tx.strip_all(m["g"][0]), unit="%",
            fixed_type=F.when(growing, "growth_rate").otherwise("market_share"), ok=value.isNotNull(),
        )

    return F.when(_mentions(lowered, ("%", "percent")), F.transform(parsed, build)).otherwise(_no_candidates())


# Candidates of a sentence above which overlaps are looked up in blocks.
MANY_CANDIDATES = 200


def _keep_disjoint(candidates: Column, sentence: Column) -> Column:
    """Candidates in order, without those that overlap one kept before.

    In a common sentence a mask marks what is reserved, so that a candidate is tested by one look at its own span. Where
    there are many, that would copy the mask once for each; those are settled family by family instead.
    """
    def step(acc, c):
        taken = F.substring(acc["mask"], c["s"] + 1, c["e"] - c["s"]).contains("1")
        width = c["re"] - c["rs"]
        marked = F.overlay(acc["mask"], F.repeat(F.lit("1"), width), c["rs"] + 1, width)
        return F.when(taken, acc).otherwise(F.struct(marked.alias("mask"), F.concat(acc["kept"], F.array(c)).alias("kept")))

    start = F.struct(F.repeat(F.lit("0"), F.char_length(sentence)).alias("mask"), _no_candidates().alias("kept"))

    def settled(usable):  # one alone overlaps nothing
        few = F.aggregate(usable, start, step, lambda acc: acc["kept"])
        return F.when(F.size(usable) <= 1, usable).when(F.size(candidates) <= MANY_CANDIDATES, few).otherwise(_keep_disjoint_of_many(candidates))

    return F.transform(F.array(F.filter(candidates, lambda c: c["ok"])), settled)[0]


_SPAN = "struct<rs:int,re:int>"
_BLOCKS = f"array<struct<lo:int,hi:int,spans:array<{_SPAN}>>>"


def _span_blocks(kept: Column) -> Column:
    """Reserved spans in blocks of about the square root of their number, with the reach of each block."""
    n = F.size(kept)
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))

    def block(i):
        spans = F.transform(F.slice(kept, i * width + 1, width), lambda k: F.struct(k["rs"].alias("rs"), k["re"].alias("re")))
        return F.struct(F.array_min(F.transform(spans, lambda k: k["rs"])).alias("lo"), F.array_max(F.transform(spans, lambda k: k["re"])).alias("hi"), spans.alias("spans"))

    numbers = F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int"))
    return F.when(n > 0, F.transform(numbers, block)).otherwise(F.array()).cast(_BLOCKS)


def _keep_disjoint_of_many(candidates: Column) -> Column:
    """The same as a fold over the families.

    Within a family candidates come by position, so one that was kept before can only reach into the next from the left: its
    end is all that must be remembered. What earlier families reserved is searched in blocks by their reach.
    """
    kind = f"array<{_CANDIDATE}>"

    def family(acc, number):
        def free(c):
            def meets(x):
                return (x["rs"] < c["e"]) & (x["re"] > c["s"])

            taken = F.exists(acc["blocks"], lambda b: (b["lo"] < c["e"]) & (b["hi"] > c["s"]) & F.exists(b["spans"], meets))
            return c["ok"] & (c["family"] == number) & ~taken

        def step(own, c):
            return F.when(c["s"] < own["end"], own).otherwise(F.struct(F.greatest(own["end"], c["re"]).alias("end"), F.concat(own["kept"], F.array(c)).alias("kept")))

        nothing = F.struct(F.lit(-1).alias("end"), _no_candidates().alias("kept"))
        own = F.aggregate(F.filter(candidates, free), nothing, step, lambda own: own["kept"])
        # bound once: the kept ones are read for the result and for the blocks
        both = F.transform(F.array(F.concat(acc["kept"], own)), lambda k: F.struct(k.alias("kept"), _span_blocks(k).alias("blocks")))
        return F.element_at(both, 1)

    start = F.struct(F.array().cast(kind).alias("kept"), F.array().cast(_BLOCKS).alias("blocks"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(FAMILIES) - 1)), start, family, lambda acc: acc["kept"])


# -- sentences ----------------------------------------------------------------------------------


_MARKS = "‘’‚‛�\u0001\u0002"


def clean_sentence(sentence: Column) -> Column:
    """Trim, plain apostrophes, no control marks."""
    text = F.coalesce(sentence, F.lit(""))
    plain = F.translate(text, _MARKS, "'''''  ")
    return tx.strip_all(F.when(text.rlike(f"[{_MARKS}]"), plain).otherwise(text))


def sentences(documents: DataFrame, content: str = "content") -> DataFrame:
    """One row per sentence: a break follows ``.``, ``!`` or ``?`` and blanks, or is a line end.

    Keeps every other column; ``sentence_no`` counts from 0 within the document.
    """
    rest = [c for c in documents.columns if c != content]
    pieces = F.split(F.coalesce(F.col(content), F.lit("")), r"(?U)(?<=[.!?])\s+|\n+", -1)
    return documents.select(*rest, F.posexplode(pieces).alias("sentence_no", "sentence"))


def may_hold_claims(sentence: Column) -> Column:
    """Cheap test before the claim regexes: ten characters, no listicle, no lone release year."""
    one_number = F.regexp_count(sentence, F.lit(rf"(?U)\b{_NUMBER}\b")) == 1
    first = F.regexp_extract(sentence, rf"(?U)\b{_NUMBER}\b", 0)
    lone_year = (
        sentence.rlike(terms.RELEASE_YEAR_PATTERN)
        & ~tx.has_any(sentence, terms.MONEY_SCALE_MARKS)
        & one_number & first.rlike(r"^(?:19[0-9][0-9]|20[0-3][0-9])$")
    )
    return (
        (F.length(sentence) >= 10) & ~sentence.rlike(terms.LISTICLE_PATTERN) & ~lone_year
    )


def claims_from_sentences(rows: DataFrame, sentence: str = "sentence", families=FAMILIES) -> DataFrame:
    """Claim rows of sentence rows; every other input column is kept on the claim.

    Adds ``family, metric, metric_type, value, raw_value_expression, unit, geography, year,
    is_range_or_approximate, range_min, range_max, source_context, match_start, extraction_confidence,
    lifecycle_stage``. ``families`` may name fewer families, in the same order of precedence.
    """
    rest = [c for c in rows.columns if c != sentence]
    numbered = rows.filter(F.col(sentence).rlike("[0-9]"))
    cleaned = compiled_once(numbered, {"_s": clean_sentence(F.col(sentence))}).filter(may_hold_claims(F.col("_s")) & _may_match(F.col("_s"), families))
    s, lowered = F.col("_s"), F.col("_l")
    flags = _sentence_flags(s, lowered)
    cleaned = compiled_once(cleaned.withColumn("_l", F.lower("_s")), {"_flagged": tx.has_any(lowered, _FLAG_TERMS)})
    # one pass for the terms of all flags: most sentences hold none, and then no flag is looked for by itself
    cleaned = compiled_once(cleaned, {f"_f_{k}": F.col("_flagged") & v for k, v in flags.items()})
    seen = {k: F.col(f"_f_{k}") for k in flags}
    makers = {
        "range": lambda: _range_candidates(s, lowered, seen),
        "approximate": lambda: _approx_candidates(s, lowered, seen),
        "money": lambda: _money_candidates(s, lowered, seen),
        "count": lambda: _count_candidates(s, lowered, seen),
        "percent": lambda: _percent_candidates(s, lowered, seen),
    }
    found = F.concat(_no_candidates(), *[makers[f]() for f in FAMILIES if f in families])
    asked = compiled_once(cleaned, {"_found": found})
    kept = compiled_once(asked, {"_kept": _keep_disjoint(F.col("_found"), s)}).drop("_found").filter(F.size("_kept") > 0)
    whole = compiled_once(kept, {"_place": tx.place_of_text(s), "_years": tx.years_of_text(s), "_chunks": tx.chunks_of(s)})
    looked = compiled_once(whole, {"_kept": F.transform(
        "_kept", lambda c: F.struct(c.alias("c"), tx.around_match(F.col("_chunks"), c["ms"], c["me"]).alias("around")))})
    rows = looked.select(*rest, "_s", *[f"_f_{k}" for k in flags], "_place", "_years", F.inline("_kept"))
    placed = compiled_once(rows, {
        "geography": tx.place_of_match(F.col("around"), F.col("_place")),
        "year": tx.year_of_match(F.col("around"), F.col("c.ms"), F.col("c.me"), F.col("_years")),
    })
    named = F.array(F.struct(F.lower("c.metric").alias("metric"), F.lower("c.unit").alias("unit")))
    typed = compiled_once(placed, {
        "metric_type": F.coalesce(
            F.col("c.fixed_type"),
            F.transform(named, lambda x: metric_type_in_context(
                x["metric"], x["unit"], seen, F.col("c.type_value"), F.lower("c.mult")))[0],
            F.col("c.default_type"),
        ),
    })
    sure = (F.col("c.family") >= 2) & F.col("year").isNotNull() & F.col("geography").isNotNull()
    price_title = F.when(F.col("metric_type") == "subscription_price", "subscription price").otherwise(
        "unit price / average price"
    )
    return typed.select(
        *rest,
        F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), F.col("c.family") + 1).alias("family"),
        F.when((F.col("c.family") == 2) & (F.col("c.metric") == _PRICE_TITLE), price_title)
        .otherwise(F.col("c.metric")).alias("metric"),
        "metric_type",
        F.col("c.value").alias("value"),
        F.col("c.raw").alias("raw_value_expression"),
        F.col("c.unit").alias("unit"),
        "geography",
        "year",
        (F.col("c.family") <= 1).alias("is_range_or_approximate"),
        F.col("c.range_min").alias("range_min"),
        F.col("c.range_max").alias("range_max"),
        F.col("_s").alias("source_context"),
        F.col("c.ms").alias("match_start"),
        F.when(sure, "high").otherwise("medium").alias("extraction_confidence"),
        F.lit("extracted").alias("lifecycle_stage"),
    )


def extract_claims(documents: DataFrame, carry=()) -> DataFrame:
    """Claims of a documents table (``original_url, content``, optional ``source_name, title``).

    ``candidate_id`` is a hash of url, sentence number, family and offset, so a rerun gives the same ids.
    ``request_id`` and the columns named in ``carry`` pass through.
    """
    name = [F.col(c) for c in ("source_name", "title") if c in documents.columns]
    carried = [c for c in ("request_id", *carry) if c in documents.columns]
    docs = documents.select(
        *carried,
        F.col("original_url").alias("source_url"),
        (F.coalesce(*name) if name else F.lit(None).cast("string")).alias("source_name"),
        "content",
    )
    out = claims_from_sentences(sentences(docs))
    claim_id = F.sha2(F.concat_ws("|", "source_url", "sentence_no", "family", "match_start"), 256)
    return out.withColumn("candidate_id", claim_id)


def extraction_status(documents: DataFrame, claims: DataFrame) -> DataFrame:
    """``success`` or ``no_metrics_found`` and the claim count per document url."""
    counts = claims.groupBy(F.col("source_url").alias("original_url")).agg(F.count("*").alias("total_candidates_found"))
    return (
        documents.select("original_url").distinct().join(counts, "original_url", "left")
        .select(
            "original_url",
            F.coalesce("total_candidates_found", F.lit(0)).cast("bigint").alias("total_candidates_found"),
            F.when(F.col("total_candidates_found") > 0, "success").otherwise("no_metrics_found").alias("status"),
        )
    )


def extract_competitors(documents: DataFrame) -> DataFrame:
    """Competitor names listed after "key players include" and the like, first mention per document."""
    hits = None
    for pattern in terms.COMPETITOR_PATTERNS:
        lists = F.regexp_extract_all(F.coalesce(F.col("content"), F.lit("")), F.lit(pattern), F.lit(1))
        arr = F.transform(
            lists, lambda t: F.struct(F.split(tx.strip_all(t), r"(?U),\s*|\s+and\s+|\s*;\s*").alias("items"))
        )
        hits = arr if hits is None else F.concat(hits, arr)
    url = F.coalesce("final_url", "original_url") if "final_url" in documents.columns else F.col("original_url")
    name = [F.col(c) for c in ("source_name", "title") if c in documents.columns]
    carried = [c for c in ("request_id",) if c in documents.columns]
    rows = documents.select(
        *carried,
        url.alias("source_url"),
        (F.coalesce(*name) if name else F.lit(None).cast("string")).alias("source_name"),
        F.posexplode(hits).alias("list_no", "hit"),
    ).select(*carried, "source_url", "source_name", "list_no", F.posexplode("hit.items").alias("item_no", "item"))
    bare = F.regexp_replace(tx.strip_all(F.col("item")), r"(?iU)^(?:and\s+|the\s+|a\s+|such as\s+)", "")
    named = rows.withColumn("name", tx.strip_all(F.regexp_replace(bare, r"[(\[].*?[)\]]", "")))
    usable = named.filter(
        F.length("name").between(2, 50) & ~tx.has_any(F.lower("name"), terms.COMPETITOR_DENY)
    )
    first = F.min_by(F.struct("name", "source_name"), F.struct("list_no", "item_no")).alias("f")
    return (
        usable.groupBy(*carried, "source_url", F.lower("name").alias("name_key")).agg(first)
        .select(*carried, "source_url", F.col("f.source_name").alias("source_name"), F.col("f.name").alias("name"),
                "name_key", F.lit("medium").alias("confidence"))
    )
