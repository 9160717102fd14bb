"""Responses to links, texts and page events: the checks in the order of a crawl step."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import html, rules, simhash, text, urls


def with_outcome(responses: DataFrame) -> DataFrame:
    """``responses`` (url, status, raw) with outcome: bad-status, no-body, redirect, too-large,
    bad-headers or page."""
    raw = F.col("raw")
    outcome = (
        F.when(~rules.status_ok(F.col("status")), "bad-status")
        .when(raw.isNull(), "no-body")
        .when(rules.is_redirect(F.col("status")), "redirect")
        .when(~rules.size_ok(raw["content"]), "too-large")
        .when(~rules.headers_ok(raw["headers"]), "bad-headers")
        .otherwise("page")
    )
    return responses.withColumn("outcome", outcome)


def redirects(checked: DataFrame, *keys: str) -> DataFrame:
    """(keys, target) of redirects; target is null where the location is missing or invalid."""
    moved = checked.where("outcome = 'redirect'")
    place = F.nullif(rules.header(F.col("raw.headers"), "location"), F.lit(""))
    joined = moved.select(*keys, html.resolve(F.col("url"), place).alias("to"))
    return joined.select(*keys, urls.normalized(F.col("to"))["fetch_url"].alias("target"))


def parsed_pages(checked: DataFrame, *keys: str) -> DataFrame:
    """(keys, links, text): link candidates and visible text of the pages."""
    pages = checked.where("outcome = 'page'")
    got = pages.select(*keys, html.page(F.col("raw.content"), F.coalesce("raw.url", "url")).alias("p"))
    return got.select(*keys, "p.links", "p.text")


def links(pages: DataFrame, key: str) -> DataFrame:
    """(key, pos, link): normalised links, the first of equals, in order of appearance."""
    each = pages.select(key, F.posexplode("links").alias("at", "raw")).select(key, "at", urls.normalized(F.col("raw"))["fetch_url"].alias("link"))
    first = each.where("link is not null").groupBy(key, "link").agg(F.min("at").alias("at"))
    order = Window.partitionBy(key).orderBy("at")  # bounded by the links of one page
    return first.select(key, (F.row_number().over(order) - 1).alias("pos"), "link")


def page_events(responses: DataFrame, seq: str) -> DataFrame:
    """(host, pattern, seq, status, simhash, n_features): what each response registers."""
    checked = with_outcome(responses).withColumn("_n", urls.normalized(F.col("url"))).where("_n.netloc is not null")
    base = checked.select(F.col(seq).alias("seq"), F.col("_n.netloc").alias("host"), F.explode("_n.bucket_keys").alias("pattern"), "status")
    seen = parsed_pages(checked, seq).select(
        F.col(seq).alias("seq"), simhash.text_simhash("text").alias("simhash"), F.size(text.features(F.col("text"))).alias("n_features")
    )
    return base.join(seen, "seq", "left").select("host", "pattern", "seq", "status", "simhash", "n_features")
