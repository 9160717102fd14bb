"""Corpus statistics of a page log: pages, longest pages, words, subdomains.

``pages``: seq (input order), fetch_url, text. Rows without a valid URL are skipped. A page is
known by its host (without ``www.``) and path without trailing slashes and query; of equal
pages the first counts. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill import conf
from gristmill.functions import text, urls


def page_key(n: Column) -> Column:
    return F.concat(n["netloc"], urls.dedup_path(n["path"]))


def first_pages(pages: DataFrame, seq: str = "seq", url: str = "fetch_url") -> DataFrame:
    """(seq, page_key, host, url, text) of the first row of each page.

    The winners are found by a partial aggregate over keys and sequence numbers alone; texts
    are joined to the winners only.
    """
    named = pages.select(F.col(seq).alias("seq"), urls.normalized(F.col(url)).alias("n"))
    keyed = named.where("n.netloc is not null").select("seq", page_key(F.col("n")).alias("page_key"), F.col("n.netloc").alias("host"), F.col("n.fetch_url").alias("url"))
    first = keyed.groupBy("page_key").agg(F.min(F.struct("seq", "host", "url")).alias("f"))
    first = first.select("f.seq", "page_key", "f.host", "f.url")
    if "text" not in pages.columns:
        return first
    return first.join(pages.select(F.col(seq).alias("seq"), "text"), "seq")


def word_counts(first: DataFrame) -> DataFrame:
    return first.select("seq", "url", F.size(text.words(F.col("text"))).alias("word_count"))


def longest_page(first: DataFrame) -> DataFrame:
    """The page with most words, the first of equals; no row where no page has a word."""
    return word_counts(first).where("word_count > 0").orderBy(F.desc("word_count"), "seq").limit(1).select("url", "word_count")


def largest_pages(first: DataFrame, n: int = 10) -> DataFrame:
    """The n largest pages with their rank; of equals the greater URL comes first."""
    top = word_counts(first).orderBy(F.desc("word_count"), F.desc("url")).limit(n)
    return top.select(F.row_number().over(Window.orderBy(F.desc("word_count"), F.desc("url"))).alias("rank"), "url", "word_count")


def word_frequencies(first: DataFrame, stop_words: DataFrame) -> DataFrame:
    """(word, n, first_seq, first_pos) of words of two letters or more that are no stop words.

    Stop words are whole lines, compared as they are; Spark broadcasts them below its checked
    threshold.
    """
    found = first.select("seq", F.posexplode(text.words(F.col("text"))).alias("pos", "word")).where(F.length("word") > 1)
    counts = found.groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct("seq", "pos")).alias("f"))
    months = first.sparkSession.createDataFrame([(m,) for m in conf.MONTHS], "word string")
    stops = stop_words.select("word").union(months).distinct()
    return counts.join(stops, "word", "left_anti").select("word", "n", F.col("f.seq").alias("first_seq"), F.col("f.pos").alias("first_pos"))


def top_words(frequencies: DataFrame, n: int = 50) -> DataFrame:
    """The n most frequent words with their rank; of equals the one met first."""
    order = [F.desc("n"), F.asc("first_seq"), F.asc("first_pos")]
    top = frequencies.orderBy(*order).limit(n)
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "word", "n")


def pages_by_host(first: DataFrame) -> DataFrame:
    return first.groupBy("host").agg(F.count("*").alias("n_pages"))


def report(first: DataFrame, stop_words: DataFrame) -> str:
    """The statistics as a text report; everything collected is a count, a top list or one row
    per host."""
    out = [f"Unique pages: {first.count()}", "", "Longest page (by word count):"]
    longest = longest_page(first).first()
    out += [f"  {longest.url}", f"  {longest.word_count} words"] if longest else ["  (none)"]
    out += ["", "Top 10 largest pages:"]
    out += [f"  {r.url}, {r.word_count} words" for r in largest_pages(first).orderBy("rank").collect()]
    out += ["", "Top 50 words:"]
    out += [f"  {r.word}, {r.n}" for r in top_words(word_frequencies(first, stop_words)).orderBy("rank").collect()]
    hosts = pages_by_host(first).orderBy("host").collect()
    return "\n".join([*out, "", f"Subdomains ({len(hosts)}):", *(f"  {r.host}, {r.n_pages}" for r in hosts)]) + "\n"


def write_report(lines: str, path: str | Path = "crawler_stats.txt") -> None:
    Path(path).write_text(lines, encoding="utf-8")


def stop_word_lines(lines: Iterable[str]) -> list[str]:
    """Stop words of a file: its lines as they are, with the months."""
    return sorted({x.rstrip("\n") for x in lines} | set(conf.MONTHS))
