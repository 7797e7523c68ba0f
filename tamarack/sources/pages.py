"""Raw pages and crawl results to readable documents."""

from __future__ import annotations

import html as html_lib
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack import terms
from tamarack.functions.source_rules import is_safe_url
from tamarack.functions.text import domain_of, low

_TEXT_AND_TITLE = T.StructType([T.StructField("text", T.StringType()), T.StructField("title", T.StringType())])


class _Reader(HTMLParser):
    """Collects text outside ignored elements; block elements become line breaks."""

    def __init__(self) -> None:
        super().__init__()
        self.out: list[str] = []
        self.title: list[str] = []
        self.hidden = 0
        self.titled = False

    def _edge(self, tag: str, opening: bool) -> None:
        if tag in terms.IGNORED_TAGS:
            self.hidden = max(0, self.hidden + (1 if opening else -1))
        elif tag == "title":
            self.titled = opening
        elif tag in terms.BLOCK_TAGS:
            self.out.append("\n")

    def handle_starttag(self, tag, attrs):
        self._edge(tag, True)

    def handle_endtag(self, tag):
        self._edge(tag, False)

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)
            if self.titled:
                self.title.append(data)


def _read(page: str | None) -> tuple[str, str]:
    reader = _Reader()
    try:
        reader.feed(page or "")
        reader.close()
    except Exception:  # malformed beyond the parser: strip tags instead
        bare = re.sub(r"(?is)<script.*?</script>|<style.*?</style>", "", page or "")
        return " ".join(html_lib.unescape(re.sub(r"<[^>]+>", " ", bare)).split()), ""
    lines = (re.sub(r"[ \t]+", " ", line).strip() for line in html_lib.unescape("".join(reader.out)).splitlines())
    return "\n".join(line for line in lines if line), html_lib.unescape(" ".join(reader.title)).strip()


@F.pandas_udf(_TEXT_AND_TITLE)
def html_text(pages: pd.Series) -> pd.DataFrame:
    """Readable text and title of HTML, parsed in Arrow batches: the one place where Python workers run."""
    return pd.DataFrame([_read(p) for p in pages], columns=["text", "title"])


# Entities that the all-SQL variant decodes (fixed values); ``&amp;`` last.
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def html_text_regex(page: Column) -> Column:
    """Tag stripping by regular expressions only: stays in the JVM, ignores document structure."""
    out = F.regexp_replace(page, r"(?is)<script.*?</script>", "")
    out = F.regexp_replace(out, r"(?is)<style.*?</style>", "")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for entity, char in _ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[\s ]+", " "))


def mime_type(content_type: Column) -> Column:
    return F.trim(F.split(F.lower(F.coalesce(content_type, F.lit(""))), ";")[0])


def fetch_status(crawl: DataFrame, max_bytes: int = terms.MAX_FETCH_BYTES) -> Column:
    """Outcome of a recorded fetch: url, http_status, content_type, content_length_bytes, error."""
    mime, error = mime_type(F.col("content_type")), low(F.col("error"))
    supported = mime.isin(*terms.HTML_TYPES, *terms.TEXT_TYPES, *terms.JSON_TYPES)
    return (
        F.when(~is_safe_url(F.col("url")), "blocked")
        .when(error.rlike("time[d ]*out"), "timeout")
        .when((error != "") | (F.col("http_status") >= 400), "fetch_failed")
        .when(~supported, "unsupported_content")
        .when(F.col("content_length_bytes") > max_bytes, "oversized")
        .otherwise("success")
    )


def route_content(crawl: DataFrame, body: str = "body") -> DataFrame:
    """Crawl rows to documents: status, text by MIME type, title, redirect flags, effective source name.

    Rows that did not succeed keep no content. ``crawl``: ``url, final_url, title, source_name, http_status,
    content_type, content_length_bytes, error`` and the body text.
    """
    df = crawl.withColumn("fetch_status", fetch_status(crawl)).withColumn("content_type", mime_type(F.col("content_type")))
    good = F.col("fetch_status") == "success"
    is_html, is_json = F.col("content_type").isin(*terms.HTML_TYPES), F.col("content_type").isin(*terms.JSON_TYPES)
    df = df.withColumn("_h", html_text(F.when(good & is_html, F.col(body))))
    pretty = F.to_json(F.try_parse_json(F.col(body)), {"pretty": "true"})
    content = F.when(is_html, F.col("_h.text")).when(is_json, F.coalesce(pretty, F.col(body))).otherwise(F.trim(F.col(body)))
    before, after = domain_of(F.col("url")), domain_of(F.coalesce("final_url", "url"))
    crossed = (before != "") & (after != "") & (before != after)
    page_title = F.when(F.col("_h.title") != "", F.col("_h.title"))
    return df.select(
        F.col("url").alias("original_url"), F.coalesce("final_url", "url").alias("final_url"),
        F.when(crossed, F.coalesce(page_title, F.col("title"))).otherwise(F.coalesce("title", page_title)).alias("title"),
        F.when(good, content).alias("content"), "content_type", "http_status", "content_length_bytes", "fetch_status",
        F.when(~crossed, F.col("source_name")).alias("source_name"), F.when(after != "", after).otherwise(before).alias("domain"),
        F.coalesce(F.col("final_url") != F.col("url"), F.lit(False)).alias("is_redirected"), crossed.alias("is_cross_domain_redirect"),
        F.lit("fetched").alias("lifecycle_stage"),
    )
