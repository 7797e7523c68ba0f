"""Text column functions: cleaning, normalisation, numbers, match spans, places, years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarack import terms

# Private marks put around regex matches; ``clean_sentence`` removes them from the input first.
_OPEN = "\u0002"
_SEP = "\u0001"


def has_any(col: Column, words) -> Column:
    """True when any term occurs in ``col`` (substring test, one regex pass; null counts as empty)."""
    return F.coalesce(col, F.lit("")).rlike(terms.prefix_alternation(words))


def has_any_word(col: Column, words) -> Column:
    """True when any term occurs in ``col`` on word boundaries."""
    return F.coalesce(col, F.lit("")).rlike(r"\b" + terms.prefix_alternation(words) + r"\b")


def is_one_of(col: Column, words) -> Column:
    """True when the whole text is one of many words: one literal pattern instead of a literal per word."""
    return F.coalesce(col, F.lit("")).rlike("^" + terms.prefix_alternation(words) + "$")


def low(col: Column) -> Column:
    """Lower case without outer blanks; null becomes the empty string."""
    return F.lower(F.trim(F.coalesce(col, F.lit(""))))


def blank_to_null(col: Column) -> Column:
    return F.when(F.trim(col) != "", F.trim(col))


def strip_all(col: Column) -> Column:
    """Remove every kind of leading and trailing white space."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def domain_of(url: Column) -> Column:
    """Lower-case authority of a URL, port included; empty when there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1))


def is_http_url(url: Column) -> Column:
    return F.coalesce(url, F.lit("")).rlike(r"^(?i:https?)://[^/?#]")


def on_domain(domain: Column, names, substring: bool = False) -> Column:
    """Domain test on label boundaries (``x.com`` does not match ``fedex.com``).

    ``substring=True`` gives the plain substring test instead.
    """
    if substring:
        return has_any(domain, names)
    return F.coalesce(domain, F.lit("")).rlike(r"(?:^|\.)" + terms.prefix_alternation(names) + r"(?:\.|:|$)")


# -- normalisation ------------------------------------------------------------------------------


def normalize_metric(metric: Column) -> Column:
    lead = r"^(?:total\s+|estimated\s+|approximate\s+|number\s+of\s+|count\s+of\s+)"
    stripped = F.regexp_replace(low(metric), lead, "")
    return F.trim(F.regexp_replace(stripped, r"[\-_/\s]+", " "))


def normalize_unit(unit: Column) -> Column:
    u = low(unit)
    plural = u.endswith("s") & (F.length(u) > 3) & ~u.endswith("ss")
    return (
        F.when(u.isin("$", "dollar", "dollars", "usd"), "usd")
        .when(u.isin("rs", "rs.", "rupee", "rupees", "inr"), "inr")
        .when(u.isin("€", "euro", "euros", "eur"), "eur")
        .when(u.isin(*terms.PERCENT_UNITS), "%")
        .when(plural, F.substring(u, F.lit(1), F.length(u) - 1))
        .otherwise(u)
    )


def normalize_place(place: Column) -> Column:
    return low(place)


def unit_currency(unit: Column) -> Column:
    """Currency code that a unit string stands for; null when it is not money."""
    u = F.upper(unit)
    return (
        F.when(u.isin("USD", "$", "DOLLAR", "DOLLARS"), "USD")
        .when(u.isin("INR", "₹", "RUPEE", "RUPEES", "RS", "RS.", "CRORE", "CRORES", "CR", "LAKH", "LAKHS"), "INR")
        .when(u.isin("EUR", "€", "EURO", "EUROS"), "EUR")
        .when(u.isin("GBP", "£", "POUND", "POUNDS"), "GBP")
    )


def multiplier_value(mult: Column) -> Column:
    values = F.create_map(*[F.lit(part) for pair in terms.MULTIPLIERS.items() for part in pair])
    return F.when(mult != "", F.coalesce(F.try_element_at(values, F.lower(mult)), F.lit(1.0))).otherwise(F.lit(1.0))


def parse_number(number: Column, mult: Column) -> Column:
    """Number text with thousands commas times its multiplier word."""
    return F.regexp_replace(number, ",", "").try_cast("double") * multiplier_value(F.coalesce(mult, F.lit("")))


def key_number(value: Column) -> Column:
    """Stable text of a number rounded to 4 decimals, ``None`` for null: part of a claim key.

    From 1e15 on a double has no decimals to round: there, and for what is not finite, the key is its own text.
    """
    dec = F.round(value, 4).try_cast("decimal(28,4)").cast("string")
    short = F.regexp_replace(F.regexp_replace(dec, r"0+$", ""), r"\.$", ".0")
    return F.coalesce(F.when(F.abs(value) < 1e15, short), value.cast("string"), F.lit("None"))


# -- match spans --------------------------------------------------------------------------------


_BLOCK = 256


def find_all(text: Column, pattern: str, groups: int) -> Column:
    """All matches of ``pattern`` with offsets: ``array<struct<s, e, g: array<string>>>``.

    One regex pass writes marks and the groups around every match; the offsets are running sums of
    piece lengths. ``g[0]`` is the whole match, unmatched groups are empty strings.
    """
    repl = _OPEN + _SEP.join(f"${i}" for i in range(groups + 1)) + _OPEN
    pieces = F.split(F.regexp_replace(text, pattern, repl), _OPEN)
    start = F.struct(
        F.lit(0).alias("pos"),
        F.array().cast("array<struct<s:int,e:int,g:array<string>>>").alias("out"),
    )

    def step(acc, g):
        is_match = F.size(g) > 1
        end = acc["pos"] + F.length(g[0])
        hit = F.struct(acc["pos"].alias("s"), end.alias("e"), g.alias("g"))
        return F.struct(
            end.alias("pos"),
            F.when(is_match, F.concat(acc["out"], F.array(hit))).otherwise(acc["out"]).alias("out"),
        )

    # offsets within blocks of bounded size, then of the blocks: a growing array is copied with each match
    def block(p):
        return F.transform(
            F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _BLOCK).cast("int")),
            lambda i: F.aggregate(F.slice(p, i * _BLOCK + 1, F.lit(_BLOCK)), start, step))

    def in_blocks(p):
        placed = F.aggregate(
            block(p),
            F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<at:int,b:array<struct<s:int,e:int,g:array<string>>>>>").alias("out")),
            lambda acc, b: F.struct(
                (acc["pos"] + b["pos"]).alias("pos"),
                F.concat(acc["out"], F.array(F.struct(acc["pos"].alias("at"), b["out"].alias("b")))).alias("out")),
            lambda acc: acc["out"])
        return F.flatten(F.transform(placed, lambda b: F.transform(b["b"], lambda m: F.struct(
            (b["at"] + m["s"]).alias("s"), (b["at"] + m["e"]).alias("e"), m["g"].alias("g")))))

    # a text of one block, as nearly all are, needs no second level
    def many(pieces):
        split = F.transform(pieces, lambda piece: F.split(piece, _SEP))
        return _bound(split, lambda p: F.when(F.size(p) <= _BLOCK, F.aggregate(p, start, step, lambda acc: acc["out"])).otherwise(in_blocks(p)))

    # texts and matches take turns: one match, as is common, needs no sums
    def one(pieces):
        at = F.length(pieces[0])
        return F.transform(F.array(F.split(pieces[1], _SEP)), lambda g: F.struct(at.alias("s"), (at + F.length(g[0])).alias("e"), g.alias("g")))

    none = F.array().cast("array<struct<s:int,e:int,g:array<string>>>")
    return _bound(pieces, lambda p: F.when(F.size(p) == 3, one(p)).when(F.size(p) == 1, none).otherwise(many(p)))


def group(match: Column, i: int) -> Column:
    """Group ``i`` of a match of :func:`find_all`; null when the group did not take part."""
    return F.when(match["g"][i] != "", match["g"][i])


# -- places and years ---------------------------------------------------------------------------

_PLACE_PATTERN = "(?iU)" + terms.first_of(terms.PLACES, ignore_case=True) + r"\b" + terms.prefix_alternation(terms.PLACES, ignore_case=True) + r"\b"
# The nearest place before a match is the one that starts last: of "Southeast Asia" that is "Asia".
_LAST_PLACES = [p for p in terms.PLACES if p != "Southeast Asia"]
_LAST_PLACE_PATTERN = "(?iU)" + terms.first_of(_LAST_PLACES, ignore_case=True) + r"\b" + terms.prefix_alternation(_LAST_PLACES, ignore_case=True) + r"\b"
_WORLD_SHARE = r"(?iU)^\s*(?:of\s+(?:the\s+)?(?:global|worldwide|world))"
_WORLD_DENOMINATOR = r"(?iU)(?=o)\bof\s+(?:the\s+)?(?:global|worldwide|world)\b"


def _bound(value: Column, make) -> Column:
    """``make`` of a value that is computed once, however often it is read."""
    return F.transform(F.array(value), make)[0]


def canonical_place(place: Column) -> Column:
    aliases = F.create_map(*[F.lit(word) for pair in terms.PLACE_ALIASES.items() for word in pair])
    return _bound(place, lambda p: F.when(p != "", F.coalesce(F.try_element_at(aliases, F.lower(p)), F.initcap(p))))


def first_place(text: Column) -> Column:
    return canonical_place(F.regexp_extract(text, _PLACE_PATTERN, 0))


def place_of_text(text: Column) -> Column:
    """First place of a sentence; a world total that something is a share of comes last."""
    return F.coalesce(first_place(F.regexp_replace(text, _WORLD_DENOMINATOR, "")), first_place(text))


# Characters of a chunk, and of the text around a match that is looked at.
_CHUNK, AROUND = 1024, 60


def chunks_of(text: Column) -> Column:
    """A text in pieces, so that a look at any place in a long one costs no walk from its begin."""
    n = F.char_length(text)
    many = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _CHUNK).cast("int")), lambda i: F.substring(text, i * _CHUNK + 1, F.lit(_CHUNK)))
    return F.when(n <= _CHUNK, F.array(text)).otherwise(many)


def _look(chunks: Column, start: Column, length: Column) -> Column:
    """Characters from ``start`` (from 0) on, at most as many as a chunk."""
    at = F.floor(start / _CHUNK).cast("int")
    two = F.concat(*[F.coalesce(F.try_element_at(chunks, at + i), F.lit("")) for i in (1, 2)])
    return F.substring(two, start - at * _CHUNK + 1, length)


def around_match(chunks: Column, start: Column, end: Column) -> Column:
    """``struct(before, after)``: the text on both sides of a match, from the chunks of its sentence."""
    return F.struct(_look(chunks, F.greatest(start - AROUND, F.lit(0)), F.least(start, F.lit(AROUND))).alias("before"),
                    _look(chunks, end, F.lit(AROUND)).alias("after"))


def place_of_match(around: Column, whole: Column) -> Column:
    """Place of a match: last in the 60 characters before, first in the 60 after, else ``whole`` (:func:`place_of_text`)."""
    before, after = around["before"], around["after"]
    last_before = canonical_place(
        F.try_element_at(F.regexp_extract_all(before, F.lit(_LAST_PLACE_PATTERN), F.lit(0)), F.lit(-1))
    )
    usable_after = _bound(first_place(after), lambda p: F.when(
        p.isNotNull() & ~(p.isin("Global", "Worldwide") & after.rlike(_WORLD_SHARE)), p))
    return F.coalesce(
        last_before,
        usable_after,
        whole,
    )


_YEAR_AFTER = r"(?iU)^\s*(?:in|by|for|during|of|to|target)?\s*\(?(19[0-9][0-9]|20[0-3][0-9])\b"
_YEAR_BEFORE = (
    r"(?iU)(?=[12])\b(19[0-9][0-9]|20[0-3][0-9])\s*"
    r"(?::|market|revenue|size|value|valuation|spending|reached|was|is)?\s*$"
)
_YEAR = r"(?U)(?=[12])\b(199[0-9]|20[0-3][0-9])\b"


def years_of_text(text: Column) -> Column:
    return find_all(text, _YEAR, 1)


def year_of_match(around: Column, start: Column, end: Column, years: Column) -> Column:
    """Year attached after the match, else before it, else the nearest of ``years`` (:func:`years_of_text`)."""
    after, before = F.substring(around["after"], 1, 30), F.right(around["before"], F.lit(30))

    def ranked(y):
        dist = F.when(y["e"] <= start, start - y["e"]).when(y["s"] >= end, y["s"] - end).otherwise(F.lit(0))
        return F.struct(dist.alias("d"), y["s"].alias("s"), y["g"][0].try_cast("int").alias("y"))

    nearest = F.array_min(F.transform(years, ranked))["y"]
    return F.coalesce(
        F.regexp_extract(after, _YEAR_AFTER, 1).try_cast("int"),
        F.regexp_extract(before, _YEAR_BEFORE, 1).try_cast("int"),
        nearest,
    )


# -- entities and noun phrases ------------------------------------------------------------------


def _in(word: str, words) -> str:
    """SQL membership test; long lists become a hash set."""
    return f"{word} in (" + ", ".join("'" + w.replace("'", "\\'") + "'" for w in words) + ")"


_SINGULAR = "substring(x.l, 1, length(x.w) - 1)"
# A recognised market entity, of a word ``x.w`` and its lower case ``x.l``: noise wins, then the word or its form without a final s.
_ENTITY_SQL = (
    f"(not {_in('x.l', terms.NOISE_WORDS)} and ({_in('x.l', terms.ENTITY_TERMS)} or "
    f"(x.l like '%s' and length(x.w) > 3 and {_in(_SINGULAR, terms.ENTITY_TERMS)})))"
)


def without_words(words: Column, dropped) -> Column:
    """The words that are neither noise nor in ``dropped``."""
    return F.call_function("filter", words, F.expr(f"w -> not {_in('lower(w)', (*terms.NOISE_WORDS, *dropped))}"))


def noun_phrase(words: Column, verbs, noise_ends: bool) -> Column:
    """Leading noun phrase of ``words`` as ``struct(np: array, entity: boolean)``.

    Stop words end it and so does a listed verb after the first noun. Noise words are skipped, or with
    ``noise_ends`` clear it; then an entity in second or later place also completes it. ``entity`` tells
    whether the last word is a recognised entity. No word of the phrase is noise.
    """
    tags = (
        f"x -> named_struct('w', x.w, 'stop', {_in('x.l', terms.STOP_WORDS)}, 'verb', {_in('x.l', verbs)}, "
        f"'noise', {_in('x.l', terms.NOISE_WORDS)}, 'entity', {_ENTITY_SQL})"
    )
    lowered = F.transform(words, lambda w: F.struct(w.alias("w"), F.lower(w).alias("l")))
    tagged = F.call_function("transform", lowered, F.expr(tags))
    start = F.expr("named_struct('np', cast(array() as array<string>), 'entity', false, 'done', false)")
    grow = "named_struct('np', concat(acc.np, array(t.w)), 'entity', t.entity, 'done', {done})"
    keep = "named_struct('np', acc.np, 'entity', acc.entity, 'done', {done})"
    ends = "acc.done or t.stop or (t.verb and size(acc.np) > 0)"
    if noise_ends:
        clear = "named_struct('np', cast(array() as array<string>), 'entity', false, 'done', true)"
        step = f"""(acc, t) -> case when {ends} then {keep.format(done='true')} when t.noise then {clear}
                   else {grow.format(done='t.entity and size(acc.np) >= 1')} end"""
    else:
        step = f"""(acc, t) -> case when {ends} then {keep.format(done='true')} when t.noise then {keep.format(done='false')}
                   else {grow.format(done='false')} end"""
    return F.call_function("aggregate", tagged, start, F.expr(step))


def split_words(text: Column) -> Column:
    """White-space words without empty ones."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


# -- display ------------------------------------------------------------------------------------


def _fixed(value: Column) -> Column:
    return F.format_number(value, 2)


def _short(value: Column) -> Column:
    """At most two decimals, no trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_number(F.round(value, 2), 2), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def _indian(value: Column) -> Column:
    """Indian digit grouping (12,34,567.5)."""
    plain = F.regexp_replace(_short(value), ",", "")
    return F.regexp_replace(plain, r"(?<=\d)(?=(?:\d\d)+\d(?:\.|$))(?<!\.\d{0,9})", ",")


def display_value(value: Column, currency: Column, style: str = "long", suffix: str = "") -> Column:
    """Market value as text: crore/lakh for INR, B/M/K for USD, B/M for the rest.

    ``style='short'`` is the report form (``Cr``, no trailing zeros, ``Not calculated`` for null).
    """
    cur = F.upper(F.coalesce(currency, F.lit("INR")))
    size = F.abs(value)
    if style == "short":
        tail = F.lit(f" {suffix}" if suffix else "")
        rupees = (
            F.when(size >= 1e7, F.concat(F.lit("₹"), _indian(value / 1e7), F.lit(" Cr"), tail))
            .when(size >= 1e5, F.concat(F.lit("₹"), _indian(value / 1e5), F.lit(" Lakh"), tail))
            .otherwise(F.concat(F.lit("₹"), _indian(value), tail))
        )
        sign = F.when(cur == "USD", "$").when(cur == "EUR", "€").otherwise(F.concat(cur, F.lit(" ")))
        other = (
            F.when(size >= 1e9, F.concat(sign, _short(value / 1e9), F.lit("B"), tail))
            .when(size >= 1e6, F.concat(sign, _short(value / 1e6), F.lit("M"), tail))
            .otherwise(F.concat(sign, _short(value), tail))
        )
        return (
            F.when(value.isNull() | F.isnan(value), "Not calculated")
            .when(cur.isin("INR", "RS", "RUPEES"), rupees)
            .otherwise(other)
        )
    rupees = (
        F.when(size >= 1e7, F.concat(F.lit("₹"), _fixed(value / 1e7), F.lit(" crore")))
        .when(size >= 1e5, F.concat(F.lit("₹"), _fixed(value / 1e5), F.lit(" lakh")))
        .otherwise(F.concat(F.lit("₹"), _fixed(value)))
    )
    dollars = (
        F.when(size >= 1e9, F.concat(F.lit("$"), _fixed(value / 1e9), F.lit("B")))
        .when(size >= 1e6, F.concat(F.lit("$"), _fixed(value / 1e6), F.lit("M")))
        .when(size >= 1e3, F.concat(F.lit("$"), _fixed(value / 1e3), F.lit("K")))
        .otherwise(F.concat(F.lit("$"), _fixed(value)))
    )
    other = (
        F.when(size >= 1e9, F.concat(cur, F.lit(" "), _fixed(value / 1e9), F.lit("B")))
        .when(size >= 1e6, F.concat(cur, F.lit(" "), _fixed(value / 1e6), F.lit("M")))
        .otherwise(F.concat(cur, F.lit(" "), _fixed(value)))
    )
    return F.when(value.isNotNull(), F.when(cur.isin("INR", "₹"), rupees).when(cur.isin("USD", "$"), dollars).otherwise(other))


def display_number(value: Column) -> Column:
    return F.when(value.isNull() | F.isnan(value), "N/A").otherwise(_short(value))


def display_count(value: Column) -> Column:
    """Whole customer counts; a leading ``~`` when the stored count is not whole."""
    whole = F.round(value, 0)
    return F.when(
        value.isNotNull() & ~F.isnan(value),
        F.concat(F.when(whole == value, "").otherwise("~"), F.format_number(whole, 0)),
    )
