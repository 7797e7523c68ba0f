"""Claims from sentences: literal expectations per family, and invariants over random text."""

import re

import pytest
from pyspark.sql import functions as F

from tamarack import terms
from tamarack.functions import text as tx
from tamarack.operators import extract as ex

SENTENCES = [
    "India has 43 million college students enrolled in universities across the country.",
    "The market was valued at USD 2.5 billion in 2024 with substantial growth projected.",
    "There are 10–15 million developers in Asia contributing to open-source software.",
    "The platform has attracted more than 10 million users across major metro areas.",
    "It was a jump from 128 million to 150 million in 2025.",
    "The base increased from 128 to 150 million users across India.",
    "The sustainable fashion market grew 12.8% year over year.",
    "The brand has a market share of 28% in urban regions.",
    "The sector reached a $128 million market size in India in 2025.",
    "India's pet market was USD 4,300 million in 2025, trailing China's USD 43,400 million in 2025.",
    "Spending grows from USD 93.7 per companion pet in 2025 to USD 167.0 by 2032.",
    "Founded in 2021 by engineers.",
    "The team has 12 users so far.",
    "In a survey of 12 users, nobody left.",
    "Homes pay $0.30 per kWh as tariff.",
    "A study – 2019 to 2024 – covers the sector in France.",
]
LISTICLES = ["5 Trends Shaping 2025 markets", "10 Best CRM tools for 20 teams", "Top 20 tools with 50 features", "7 reasons to hire 30 engineers",
             "6 Factors Propelling 40 companies", "16 best linux distros"]


@pytest.fixture(scope="module")
def claims(spark):
    df = spark.createDataFrame(list(enumerate(SENTENCES + LISTICLES)), "id int, sentence string")
    rows = ex.claims_from_sentences(df).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.id, r.match_start)):
        out.setdefault(r.id, []).append(r)
    return out


def test_count(claims):
    (c,) = claims[0]
    assert (c.family, c.value, c.unit, c.geography, c.year) == ("count", 43e6, "students", "India", None)
    assert c.metric == "college students" and c.metric_type == "student_count"


def test_money(claims):
    (c,) = claims[1]
    assert (c.value, c.unit, c.year, c.metric_type) == (2.5e9, "USD", 2024, "market_size")
    (d,) = claims[8]
    assert (d.value, d.unit, d.geography, d.year, d.extraction_confidence) == (128e6, "USD", "India", 2025, "high")


def test_range_has_no_value(claims):
    (c,) = claims[2]
    assert (c.value, c.range_min, c.range_max, c.geography) == (None, 10e6, 15e6, "Asia")
    assert [(x.range_min, x.range_max) for x in claims[4]] == [(128e6, 150e6)]
    assert claims[4][0].unit != "%"
    assert [(x.range_min, x.range_max, x.unit) for x in claims[5]] == [(128e6, 150e6, "users")]


def test_year_pairs_are_no_range(claims):
    assert all(c.family != "range" for c in claims.get(15, []))


def test_approximate(claims):
    (c,) = claims[3]
    assert c.is_range_or_approximate and c.range_min == 10e6 and c.range_max == pytest.approx(10.5e6)


def test_percent(claims):
    assert [(c.value, c.unit, c.metric_type) for c in claims[6]] == [(12.8, "%", "growth_rate")]
    assert [(c.value, c.unit, c.metric_type) for c in claims[7]] == [(28.0, "%", "market_share")]


def test_place_is_local_to_the_number(claims):
    assert [(c.value, c.geography) for c in claims[9]] == [(4.3e9, "India"), (43.4e9, "China")]


def test_unit_spend_is_a_price(claims):
    assert {c.metric_type for c in claims[10]} == {"average_price"}


def test_guards(claims):
    assert 11 not in claims
    assert 12 not in claims and [c.value for c in claims[13]] == [12.0]
    assert [(c.metric, c.metric_type) for c in claims[14]] == [("tariff / usage rate", None)]
    assert not set(claims) & set(range(len(SENTENCES), len(SENTENCES) + len(LISTICLES)))


def test_find_all_offsets_match_python(spark):
    texts = ["a 12 b345", "", "7", "x", "1 2 3", "ünï 44 – 5", "9" * 30 + " z 1"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.find_all(F.col("t"), r"([0-9])([0-9]*)", 2).alias("m")).collect()
    for r in rows:
        want = [(m.start(), m.end(), m.group(0)) for m in re.finditer(r"([0-9])([0-9]*)", texts[r.i])]
        assert [(m.s, m.e, m.g[0]) for m in r.m] == want


def test_sentences_split_like_the_rule(spark):
    text = "One. Two!  Three?\n\nFour\nfive. "
    got = [r.sentence for r in ex.sentences(spark.createDataFrame([(1, text)], "id int, content string")).orderBy("sentence_no").collect()]
    assert got == re.split(r"(?<=[.!?])\s+|\n+", text)


def test_kept_spans_do_not_overlap_and_rows_do_not_depend_on_order(spark):
    words = ["10", "million", "users", "USD", "5%", "of", "over", "and", "20", "–", "30", "clients", "India", "in", "2024", "tips"]
    texts = [" ".join(words[(i * 7 + j * (i % 5 + 1)) % len(words)] for j in range(12)) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, sentence string")

    def run(d):
        return sorted((r.id, r.family, r.match_start, r.raw_value_expression) for r in ex.claims_from_sentences(d).collect())

    once, again = run(df), run(df.repartition(3).orderBy(F.desc("id")))
    assert once == again and once
    numbers = {}
    for i, _, start, _ in once:
        assert (i, start) not in numbers
        numbers[i, start] = True


def test_long_digit_list_is_harmless(spark):
    text = "Values " + ",".join(["1"] * 20000) + " plus 43 million students in India."
    rows = ex.claims_from_sentences(spark.createDataFrame([(1, text)], "id int, sentence string")).collect()
    assert any(r.value == 43e6 for r in rows)


def test_documents_and_competitors(spark):
    docs = spark.createDataFrame(
        [("https://a.org/1", "A", "Key players include Acme (US), Borealis and the Zeta Corp. India has 5,000 hospitals.\nTop competitors: Foo; Acme, market report"),
         ("https://a.org/2", "B", "nothing here")], "original_url string, source_name string, content string")
    claims = ex.extract_claims(docs)
    status = {r.original_url: (r.status, r.total_candidates_found) for r in ex.extraction_status(docs, claims).collect()}
    assert status == {"https://a.org/1": ("success", 1), "https://a.org/2": ("no_metrics_found", 0)}
    assert len({r.candidate_id for r in claims.collect()}) == 1
    names = {r.name for r in ex.extract_competitors(docs).collect()}
    assert names == {"Acme", "Borealis", "Zeta Corp", "Foo"}


@pytest.mark.parametrize("groups", [71, 20_000])
def test_numbers_of_many_groups_are_taken_whole(spark, groups):
    number = "1" + ",234" * groups
    rows = spark.createDataFrame([(f"There are {number} users of it.",), (f"It is worth USD {number} in all.",), (f"We saw more than {number} students.",)], "sentence string")
    got = ex.claims_from_sentences(rows).collect()
    assert all(number in r.raw_value_expression for r in got)
    if groups == 71:
        assert {r.family for r in got} == {"count", "money", "approximate"}


def test_number_pattern_gives_back_like_a_plain_one(spark):
    plain = r"(?iU)(?:(\$)\s*([0-9]+(?:,[0-9]+)*(?:\.[0-9]+)?)\s*(million|m|k)?)\b"
    mine = plain.replace(r"([0-9]+(?:,[0-9]+)*(?:\.[0-9]+)?)", ex._GROUPED)
    assert mine != plain
    texts = ["$1,234x", "$1,234,567per", "$1,234.5x", "$1,234 mx", "$12m", "$1,2,3,4", "$1,", "$1,,2", "$1.2.3", "$1,234,567.89 million", "$9k,1", "$5,000m2", "$1,2a $3,4"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    both = df.select("t", F.regexp_extract_all("t", F.lit(plain), F.lit(0)).alias("a"), F.regexp_extract_all("t", F.lit(mine), F.lit(0)).alias("b"))
    assert all(r.a == r.b for r in both.collect())


def test_many_and_few_candidates_are_kept_alike(spark, monkeypatch):
    """The blockwise way gives what the mask gives, whatever families meet in a sentence."""
    parts = ["{a} million users", "USD {a} million", "{a}% of buyers in India", "more than {a} million subscribers", "5 to {a} million clients in 2024", "worth $ {a} of {a} firms", "{a} and {a}% users"]
    rows = [(" and ".join(parts[(i * j + i) % len(parts)].format(a=i % 80 + 3) for i in range(2, 14)),) for j in range(40)]
    df = spark.createDataFrame(rows, "sentence string")
    want = sorted(map(str, ex.claims_from_sentences(df).collect()))
    monkeypatch.setattr(ex, "MANY_CANDIDATES", 0)
    assert sorted(map(str, ex.claims_from_sentences(df).collect())) == want and len(want) > 150


def test_thousands_of_matches_in_one_sentence(spark):
    import time

    begun = time.monotonic()
    n = 12_000
    text = "There are " + " and ".join(f"{1000 + i} million users" for i in range(n))
    rows = ex.claims_from_sentences(spark.createDataFrame([(text,)], "sentence string"))
    got = rows.selectExpr("count(*) AS n", "sum(value) AS v", "count(DISTINCT match_start) AS places").first()
    assert (got.n, got.places) == (n, n) and got.v == sum((1000 + i) * 1e6 for i in range(n))
    assert time.monotonic() - begun < 90  # about 15 s on idle cores; it took minutes when each claim walked the sentence


def test_offsets_over_block_borders(spark):
    text = " ".join(str(i) for i in range(1500))
    got = spark.createDataFrame([(text,)], "t string").select(tx.find_all(F.col("t"), "([0-9]+)", 1).alias("m")).first().m
    assert [(m.s, m.e, m.g[0]) for m in got] == [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9]+", text)]


def test_terms_with_shared_beginnings_match_as_a_plain_alternation():
    words = ("asia", "as", "asian", "b$", "a", "b", "US", "usa")
    for ignore_case in (False, True):
        flags = re.IGNORECASE if ignore_case else 0
        plain, shared = terms.alternation(words), terms.prefix_alternation(words, ignore_case)
        for text in ("asian usa b$ a", "xUSA asias b", "", "AsiaUS"):
            for end in ("", r"(?!n)", r"\b"):
                assert re.findall(plain + end, text, flags) == re.findall(shared + end, text, flags)
        assert shared.startswith("(?:(?=[")  # places where no term begins are passed over
    assert terms.prefix_alternation(("", "a")) == terms.alternation(("", "a"))


def test_a_place_is_searched_once(spark):
    df = spark.createDataFrame([("in the USA",), ("new DELHI sells",), ("none",), (None,)], "t string")
    out = df.select("t", tx.first_place(F.col("t")).alias("p"))
    assert {r.t: r.p for r in out.collect()} == {"in the USA": "United States", "new DELHI sells": "Delhi", "none": None, None: None}
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("regexp_extract(") == 1


def test_offsets_over_block_edges(spark):
    texts = ["", "no digit", "7", *[" ".join(str(i % 10) for i in range(n)) for n in (126, 127, 128, 129, 300)]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", tx.find_all(F.col("t"), "([0-9])", 1).alias("m")).collect():
        assert [(m.s, m.e, list(m.g)) for m in r.m] == [(m.start(), m.end(), [m.group(), m.group()]) for m in re.finditer("[0-9]", r.t)]


def test_candidates_are_not_cast_as_a_whole(spark):
    """Fields get their types one by one; a cast of the struct would rebuild every candidate."""
    df = spark.createDataFrame([("It has 12 users.",)], "sentence string")
    plan = ex.claims_from_sentences(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "as struct<" not in plan


_N = r"((?:[0-9]+(?:,[0-9]+)*+(?:\.[0-9]+)?|[0-9]+(?:,[0-9]+(?=,[0-9]))*+))"
_P = r"([0-9]+(?:\.[0-9]+)?)"
_PLAIN_PATTERNS = {  # as they are without a look ahead
    "range": (r"(?iU)(\b(?:(?:from|between|ranged from|jump from|increased from|grew from|rose from)\s+)?"
              rf"{ex._CUR}\s*{_P}\s*{ex._MULT}\s*(?:–|-|to|and)\s*{ex._CUR}\s*{_P}\s*{ex._MULT}\s*([a-zA-Z%]+(?:\s+[a-zA-Z%]+){{0,3}})?\b)", ex.RANGE_PATTERN, 6),
    "money": (r"(?iU)(?:(?:\b(?:valued at|revenue of|market size of|worth|spending of|cost of|fee of|price of)\s+)?"
              rf"(?:(USD|\$|INR|₹|EUR|€|GBP|£)\s*{_N}\s*{ex._MULT}|"
              rf"\b{_N}\s*{ex._MULT}\s*(USD|dollars?|INR|rupees?|EUR|euros?|GBP|pounds?))\b)", ex.MONEY_PATTERN, 6),
    "count": (rf"(?iU)\b{_N}\s*{ex._MULT}\s+([a-zA-Z]+(?:\s+[a-zA-Z]+){{0,4}})", ex.COUNT_PATTERN, 3),
    "percent": (r"(?iU)([0-9]+(?:\.[0-9]+)?)\s*(%|percent|percentage)(?:\s+(?:of\s+)?([a-zA-Z]+(?:\s+[a-zA-Z]+){0,4}))?", ex.PERCENT_PATTERN, 3),
    "approximate": (rf"(?iU)\b({terms.alternation(terms.QUALIFIERS)})\s+{_N}\s*{ex._MULT}(?=(\s+[a-zA-Z%]+(?:\s+[a-zA-Z%]+){{0,4}})\b)", ex.APPROX_PATTERN, 4),
    "place": (r"(?iU)\b" + terms.alternation(terms.PLACES) + r"\b", tx._PLACE_PATTERN, 0),
    "denominator": (r"(?iU)\bof\s+(?:the\s+)?(?:global|worldwide|world)\b", tx._WORLD_DENOMINATOR, 0),
    "year": (r"(?U)\b(199[0-9]|20[0-3][0-9])\b", tx._YEAR, 1),
    "released": (terms.RELEASE_YEAR_PATTERN.replace("(?=[rfepldcsv])", ""), terms.RELEASE_YEAR_PATTERN, 0),
}


def test_patterns_with_a_look_ahead_match_as_without(spark):
    import random

    rng = random.Random(5)
    words = ["from", "Between", "ranged from", "ROSE FROM", "to", "and", "–", "-", "USD", "uſd", "$", "₹", "INR", "ınr", "€", "£", "gbp", "12", "1,234.5", "1,2,", "3", "2024", "٣",
             "million", "mn", "K", "k", "%", "percent", "of the world", "More than", "at least", "eſtimated", "over", "about", "users", "kids ſold", "India", "US", "uk", "Uſa", "ASIA",
             "southeast asia", "worth", "valued at", "price of", "dollars", "ſince", "since", "v.", "version", "é", " ", "\t", "_", ".", ","]
    words += 5 * ["12", "7", "to", "and", "–"] + 2 * ["million", "USD", "more than", "2024"]
    rows = [("".join(rng.choice(words) + rng.choice(["", " ", " ", " ", "  "]) for _ in range(rng.randint(1, 16))),) for _ in range(4000)]
    df = spark.createDataFrame(rows, "t string")
    for name, (plain, mine, groups) in _PLAIN_PATTERNS.items():
        marks = "<" + "|".join(f"${i}" for i in range(groups + 1)) + ">"
        a, b = (F.regexp_replace("t", p, marks) for p in (plain, mine))
        assert plain != mine and ("(?=" in mine or name == "percent"), name
        assert df.filter(a != b).count() == 0 and df.filter(b != F.col("t")).count() > 20, name


def test_flag_terms_find_what_all_terms_find():
    assert terms.shortest(("per user", "per", "aov", "per", "order value")) == ["per", "aov", "order value"]
    held = [*terms.MONEY_UNIT_SPEND_TERMS, *terms.RANGE_PRICE_TERMS, *terms.USAGE_TYPE_TERMS, *terms.SURVEY_TERMS, *terms.GROWTH_TERMS, *terms.FUNDING_TERMS]
    assert all(any(f in w for f in ex._FLAG_TERMS) for w in held) and len(ex._FLAG_TERMS) < len(held)


def test_sentences_without_a_match_are_left_before_anything_else_is_asked(spark):
    df = spark.createDataFrame([("It has 12 users in 2024.",)], "sentence string")
    plan = ex.claims_from_sentences(df, families=("approximate",))._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert any("RLIKE" in line and "estimated"[1:] in line for line in filters)
    assert ex.claims_from_sentences(df, families=("approximate",)).count() == 0 and ex.claims_from_sentences(df, families=()).count() == 0


def test_one_match_needs_no_sums(spark):
    rows = [("a 7",), ("7",), ("7 b",), ("none",), ("",), (None,), ("1 2",)]
    got = spark.createDataFrame(rows, "t string").select("t", tx.find_all(F.col("t"), "([0-9])", 1).alias("m")).collect()
    for r in got:
        want = None if r.t is None else [(m.start(), m.end(), [m.group(), m.group()]) for m in re.finditer("[0-9]", r.t)]
        assert (r.m if r.m is None else [(m.s, m.e, list(m.g)) for m in r.m]) == want
