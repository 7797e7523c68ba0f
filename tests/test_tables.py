"""Taxonomies and source rules as tables: any number of terms, names inside names, hosts and look-alikes."""

import random
import re

from pyspark.sql import functions as F

from tamarack.operators import classify as cls
from tamarack.operators import domain_rules as dr
from tamarack.taxonomy import TAXONOMY, Category


def scores_by_hand(text, taxonomy):
    out = {}
    for cat in taxonomy:
        points = 0.0
        for sub in cat.subcategories:
            bare = re.sub(r"\b(saas|software|platform|system|tools|tool)\b", "", sub.lower()).strip()
            points += 15.0 if sub.lower() in text else 12.0 if len(bare) >= 4 and bare in text else 0.0
        for word in cat.keywords:
            if re.search(rf"\b{re.escape(word.lower())}\b", text):
                points += cls._keyword_points(word.lower())
        if points:
            out[cat.category_id] = points
    return out


def name_by_hand(name, taxonomy):
    text = name.strip().lower()
    synonyms, words = {}, [(k.lower(), c.category_id) for c in taxonomy for k in c.keywords]
    for c in taxonomy:
        for s in c.synonyms:
            synonyms.setdefault(s.lower(), c.category_id)
    for exact in ({c.category_id: c.category_id for c in taxonomy}, {c.name.lower(): c.category_id for c in reversed(taxonomy)}, synonyms):
        if text in exact:
            return exact[text]
    plain = re.sub(r"[^\w\s]", " ", text).strip()
    if plain in synonyms:
        return synonyms[plain]
    for c in taxonomy:
        if any(s.lower() in text for s in c.subcategories):
            return c.category_id
    for pairs in (list(synonyms.items()), words):
        for term, category in sorted(pairs, key=lambda p: -len(p[0])):
            if len(term) >= 3 and re.search(rf"\b{re.escape(term)}\b", text):
                return category
    return None


def texts(taxonomy, n, seed):
    r = random.Random(seed)
    terms = [t for c in taxonomy for t in (*c.subcategories, *c.keywords, *c.synonyms, c.name, c.category_id)]
    glue = [" ", "s ", "-", ", ", "x", " / ", "_", ""]
    made = ["", "   ", "É crm", "crm", "ＣＲＭ", "a crm.b", "crmś"]
    for _ in range(n):
        made.append("".join(r.choice(glue) + r.choice(terms) for _ in range(r.randrange(1, 4))) + r.choice(glue))
    return made


def test_scores_and_names_by_hand(spark):
    rows = list(enumerate(texts(TAXONOMY, 300, 1)))
    df = spark.createDataFrame(rows, "i int, idea string").repartition(3)
    got = {}
    for r in cls.category_scores(df).collect():
        got.setdefault(r.i, {})[r.category_id] = r.score
    assert got == {i: s for i, t in rows if (s := scores_by_hand(t.lower(), TAXONOMY))}
    named = {r.i: r.c for r in df.select("i", cls.normalize_category(F.col("idea")).alias("c")).collect()}
    assert named == {i: name_by_hand(t, TAXONOMY) if t.strip() else None for i, t in rows}
    assert cls.normalize_category(F.lit(None).cast("string")) is not None
    assert df.limit(1).select(cls.normalize_category(F.lit(None).cast("string")).alias("c")).first().c is None


def test_ten_thousand_terms_do_not_grow_the_plan(spark):
    r = random.Random(2)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 8))) for _ in range(4000)]
    large = [Category(f"c{i}", f"Category {i}", (f"{words[i]} {words[-i]} tools",), tuple(r.choice(words) for _ in range(25)), (words[i], f"{words[i]} {words[i + 9]}")) for i in range(1, 360)]
    assert sum(len(c.subcategories) + len(c.keywords) + len(c.synonyms) for c in large) > 10_000
    rows = list(enumerate(texts(large, 60, 3)))
    df = spark.createDataFrame(rows, "i int, idea string")

    def plan(out):
        return len(out._jdf.queryExecution().executedPlan().toString())

    assert plan(cls.classify(df, large)) == plan(cls.classify(df)) and plan(cls.category_scores(df, large)) == plan(cls.category_scores(df))
    got = {}
    for x in cls.category_scores(df, large).collect():
        got.setdefault(x.i, {})[x.category_id] = x.score
    assert got == {i: s for i, t in rows if (s := scores_by_hand(t.lower(), large))}
    best = {x.i: x.category_id for x in cls.classify(df, large).collect() if x.classification_status == "IN_SCOPE" and x.i in got}
    assert all(got[i][c] == max(got[i].values()) for i, c in best.items()) and len(best) > 20
    assert cls.category_scores(df, []).collect() == []


def test_rules_of_a_caller(spark):
    hosts = [("https://a.b.example.com/x", None), ("https://example.com:80", None), ("https://example.com.evil.org", None), ("https://notexample.com", None), ("", None), (None, "Trade Association"),
             ("https://b.example.com", None), ("https://x.gov", None)]
    rows = spark.createDataFrame(hosts, "source_url string, source_name string").withColumn("domain", F.lower(F.regexp_extract(F.coalesce("source_url", F.lit("")), "//([^/]*)", 1)))
    rules = spark.createDataFrame([("example.com", "own", 3, 0.5, "T"), ("b.example.com", "nearer", 1, 0.6, "U"), ("example.com", "later", 9, 0.1, "V"), ("evil.org", "evil", 2, 0.0, "W")], dr.RULES_DDL)
    got = [(r.source_url, r.source_rule.kind) for r in dr.rate_sources(rows, rules).collect()]
    assert sorted(got, key=repr) == sorted([
        ("https://a.b.example.com/x", "nearer"), ("https://example.com:80", "own"), ("https://example.com.evil.org", "evil"), ("https://notexample.com", "general"),
        ("", "general"), (None, "association"), ("https://b.example.com", "nearer"), ("https://x.gov", "general")], key=repr)
    assert [r.source_rule.kind for r in dr.rate_sources(rows.filter("source_url = 'https://x.gov'")).collect()] == ["government"]
    assert dr.rate_sources(rows, rules.limit(0)).filter("source_rule.kind = 'own'").collect() == []
