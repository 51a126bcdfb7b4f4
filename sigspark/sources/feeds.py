"""Feed and article readers over landed raw payloads.

Raw payloads arrive as files (one record per ``rowTag`` element) or as a
string column; both are parsed by Spark's XML support with an explicit
schema (no inference pass). Network fetching is out of scope: jobs start
from landed files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import parse_date_any
from ..functions.text import html_to_text

#: Items of both feed kinds: plain texts, or (entries) attributes of link and
#: category and a named author.
FEED_ITEM_SCHEMA = ("struct<title: string, "
                    "link: array<struct<_VALUE: string, _href: string, _rel: string>>, "
                    "pubDate: string, published: string, updated: string, "
                    "summary: string, description: string, content: struct<_VALUE: string>, "
                    "category: array<struct<_VALUE: string, _term: string>>, "
                    "author: struct<_VALUE: string, name: string>>")

FEED_DATE_FORMATS = ["rfc822", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss'Z'",
                     "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]


def parse_feed_items(raw: DataFrame, xml_col: str = "xml", feed_col: str = "feed",
                     order_col: str | None = "pos", max_per_feed: int | None = None) -> DataFrame:
    """XML items -> (feed, title, link, published, summary, tags, author).

    Fallbacks: published <- pubDate / published / updated; summary <-
    summary / description, HTML stripped only when it contains a tag.
    ``max_per_feed`` keeps the first N items of each feed in feed order (the
    group limit runs before the shuffle, N rows per feed per task).
    """
    p = raw.select(feed_col, *([order_col] if order_col else []),
                   F.from_xml(F.col(xml_col), FEED_ITEM_SCHEMA).alias("i"))
    return items_to_rows(p, feed_col, order_col, max_per_feed)


def items_to_rows(p: DataFrame, feed_col: str, order_col: str | None,
                  max_per_feed: int | None) -> DataFrame:
    i = lambda c: F.col(f"i.{c}")
    summary = F.coalesce(i("summary"), i("description"), i("content._VALUE"))
    summary = F.when(summary.contains("<"), html_to_text(summary)).otherwise(summary)
    raw_date = F.coalesce(i("pubDate"), i("published"), i("updated"))
    links = F.filter(i("link"), lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    link = F.get(F.transform(links, lambda x: F.coalesce(x["_href"], F.trim(x["_VALUE"]))), 0)
    tags = F.filter(F.transform(i("category"), lambda x: F.coalesce(x["_term"], F.trim(x["_VALUE"]))),
                    lambda x: F.coalesce(x, F.lit("")) != "")
    out = p.select(
        F.col(feed_col).alias("feed"), *([F.col(order_col)] if order_col else []),
        F.trim(i("title")).alias("title"), link.alias("link"),
        raw_date.alias("published_raw"),
        parse_date_any(raw_date, FEED_DATE_FORMATS).alias("published"),
        summary.alias("summary"),
        F.coalesce(tags, F.array().cast("array<string>")).alias("tags"),
        F.coalesce(i("author.name"), F.trim(i("author._VALUE"))).alias("author"))
    if max_per_feed is not None and order_col:
        w = Window.partitionBy("feed").orderBy(order_col)
        out = out.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max_per_feed).drop("_rn")
    return out


_DAY = "struct<Year: string, Month: string, Day: string>"
ARTICLE_SCHEMA = (
    "struct<MedlineCitation: struct<PMID: struct<_VALUE: string, _Version: string>, Article: struct<"
    "ArticleTitle: string, Abstract: struct<AbstractText: array<struct<_Label: string, _VALUE: string>>>, "
    f"ArticleDate: {_DAY}, Journal: struct<Title: string, JournalIssue: struct<PubDate: {_DAY}>>, "
    "AuthorList: struct<Author: array<struct<LastName: string, ForeName: string, "
    "AffiliationInfo: array<struct<Affiliation: string>>>>>>>>")

_MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def month_number(m: Column) -> Column:
    """Month as a number from '3', '03' or a month name ('Mar')."""
    by_name = F.array_position(F.array(*[F.lit(x) for x in _MONTHS]), F.initcap(F.substring(m, 1, 3)))
    return F.coalesce(m.try_cast("int"), F.when(by_name > 0, by_name.cast("int")))


def parse_articles(raw: DataFrame, xml_col: str = "xml", max_authors: int | None = 5) -> DataFrame:
    """S3: article XML -> id, title, labelled abstract, date (article date,
    else issue date), journal, first authors, country of the first affiliation."""
    from ..functions.text import affiliation_country
    c = raw.select(F.from_xml(F.col(xml_col), ARTICLE_SCHEMA).alias("a")).select("a.MedlineCitation.*")
    a = c.select(F.coalesce(F.trim("PMID._VALUE"), F.lit("")).alias("pmid"), "Article.*")
    parts = F.transform("Abstract.AbstractText", lambda x: F.concat(
        F.when(F.coalesce(x["_Label"], F.lit("")) != "", F.concat(x["_Label"], F.lit(": "))).otherwise(""),
        F.coalesce(x["_VALUE"], F.lit(""))))
    named = F.filter("AuthorList.Author", lambda x: F.coalesce(x["LastName"], F.lit("")) != "")
    names = F.transform(named, lambda x: F.trim(F.concat_ws(" ", x["LastName"], x["ForeName"])))
    names = F.coalesce(names, F.array().cast("array<string>"))
    places = F.flatten(F.transform("AuthorList.Author", lambda x: F.coalesce(
        x["AffiliationInfo"]["Affiliation"], F.array().cast("array<string>"))))
    day = F.coalesce("ArticleDate", "Journal.JournalIssue.PubDate")
    year = day["Year"].try_cast("int")
    month = F.when(day["Month"].isNull(), 1).otherwise(F.coalesce(month_number(day["Month"]), F.lit(1)))
    dom = F.when(day["Day"].isNull(), 1).otherwise(day["Day"].try_cast("int"))
    return a.select(
        F.concat(F.lit("PMID:"), "pmid").alias("external_id"),
        F.coalesce("ArticleTitle", F.lit("Untitled")).alias("title"),
        F.coalesce(F.array_join(parts, " "), F.lit("")).alias("abstract"),
        F.when(year.isNotNull() & dom.isNotNull(),
               F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, dom), "yyyy-MM-dd")).alias("publish_date"),
        F.coalesce("Journal.Title", F.lit("")).alias("journal"),
        F.array_join(F.slice(names, 1, max_authors) if max_authors else names, ", ").alias("authors"),
        F.coalesce(affiliation_country(F.get(places, 0)), F.lit("")).alias("country"))


def to_document(items: DataFrame, source_id: int, document_type: str, language: str = "en",
                country: str | None = None) -> DataFrame:
    """P1 + P6: normalise parsed feed items to the common document row."""
    from ..functions.text import content_hash
    ext = F.concat(F.lit(f"src{source_id}-"), F.sha2(F.coalesce(F.col("link"), F.col("title")), 256).substr(1, 16))
    return items.select(
        F.lit(source_id).alias("source_id"), ext.alias("external_id"), F.col("title"),
        F.col("link").alias("url"), F.col("published").alias("publish_date"),
        F.lit(language).alias("language"), F.col("summary").alias("full_text"),
        F.lit(country).cast("string").alias("country"), F.lit(document_type).alias("document_type"),
    ).withColumn("content_hash", content_hash("title", "external_id", "url"))
