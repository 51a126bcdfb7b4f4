"""Registered queries: payload readers over records made from the given
tables, and sinks (S1, S4-S6, S11, S12, K3, K5, K7, K8). Readers are tested
on hand-made samples in the layouts of real payloads; here they run over every
document."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sinks as K
from ..bindings import read, trends_view
from ..functions.text import content_hash
from ..operators import alerts as AL
from ..sources import feeds as FD
from ..sources import payloads as PL
from ..sources import tables as TB
from . import sqlviews as V
from .model import model
from .registry import register

CTRL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
CLEAN_SQL = "trim(regexp_replace(regexp_replace({x}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '\\s+', ' ', 'g'))"


def _clean(c):
    return F.trim(F.regexp_replace(F.regexp_replace(c, CTRL, ""), r"\s+", " "))


# ------------------------------------------------------------------ S1 --
@register("feed_items", V.with_(V.D_DOCS) + f"""
SELECT source AS feed, document_id AS pos, {CLEAN_SQL.format(x='title')} AS title, url AS link,
       publish_date AS published, {CLEAN_SQL.format(x='full_text')} AS summary,
       language || '|' || source AS tags, source AS author
FROM d_docs""")
def feed_items(spark, sf_dir):
    """S1 + P2: feed items of both kinds (odd documents as entries with link
    and category attributes) parsed with their fallbacks, all items kept."""
    d = model(spark, sf_dir).D
    day = F.date_format("publish_date", "EEE, dd MMM yyyy HH:mm:ss '+0000'")
    title, text = _clean(F.col("title")), _clean(F.col("full_text"))
    none = F.lit(None).cast("string")

    def attr(value, name, other):
        return F.struct(F.when(~other, value).alias("_VALUE"), F.when(other, value).alias(name))
    entry = F.col("document_id") % 2 == 1
    item = F.struct(
        title.alias("title"),
        F.array(attr(F.col("url"), "_href", entry)).alias("link"),
        F.when(~entry, day).alias("pubDate"),
        F.when(entry, F.date_format("publish_date", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("updated"),
        F.when(entry, text).alias("summary"), F.when(~entry, text).alias("description"),
        F.array(attr(F.col("language"), "_term", entry), attr(F.col("source"), "_term", entry)).alias("category"),
        F.struct(F.when(~entry, F.col("source")).alias("_VALUE"), F.when(entry, F.col("source")).otherwise(none).alias("name")).alias("author"))
    raw = d.select(F.col("source").alias("feed"), F.col("document_id").alias("pos"),
                   F.to_xml(item, {"rowTag": "item"}).alias("xml"))
    rows = FD.parse_feed_items(raw, "xml", "feed", "pos")
    return rows.select("feed", "pos", "title", "link", "published", "summary",
                       F.array_join("tags", "|").alias("tags"), "author")


# ------------------------------------------------------------------ S4 --
@register("trials_parsed", V.with_(V.D_DOCS) + """
, t AS (SELECT *, document_id // 2 AS study, CASE WHEN country IS NULL THEN ['Kenya'] WHEN country = 'Kenya' THEN ['Kenya']
                     ELSE [country, 'Kenya'] END AS places,
               row_number() OVER (PARTITION BY document_id // 2 ORDER BY document_id) AS k
        FROM d_docs WHERE NOT (document_id % 2 = 0 AND document_id % 7 = 0))
SELECT 'NCT' || lpad(CAST(study AS VARCHAR), 8, '0') AS external_id,
       CASE WHEN document_id % 5 = 0 THEN 'Untitled' ELSE title END AS title,
       CASE WHEN document_id % 4 = 0 THEN publish_date ELSE CAST(date_trunc('month', publish_date) AS DATE) END AS start_date,
       CASE WHEN document_id % 3 = 0 THEN 'PHASE2, PHASE3' ELSE 'N/A' END AS phase,
       language || '|' || source AS conditions, 'drug ' || source AS interventions,
       array_to_string(places, '|') AS countries, places[1] AS country,
       source AS sponsor, n_chars AS enrollment, upper(language) AS status, full_text
FROM t WHERE k = 1""")
def trials_parsed(spark, sf_dir):
    """Nested trial JSON -> flat trial rows (distinct countries in
    document order, first one as the country; 'Y-m-d' then 'Y-m' dates; two
    records share an id; of some pairs the first has none, and the second is
    returned)."""
    d = model(spark, sf_dir).D
    i = F.col("document_id")
    start = F.when(i % 4 == 0, F.date_format("publish_date", "yyyy-MM-dd")) \
             .otherwise(F.date_format("publish_date", "yyyy-MM"))
    locs = F.array(F.struct(F.col("country").alias("country")), F.struct(F.lit("Kenya").alias("country")),
                   F.struct(F.col("country").alias("country")))
    first = i % 2 == 0
    payload = F.struct(F.struct(
        F.struct(F.when(~(first & (i % 7 == 0)), F.concat(F.lit("NCT"), F.lpad(F.floor(i / 2).cast("string"), 8, "0"))).alias("nctId"),
                 F.when(i % 5 != 0, F.col("title")).alias("briefTitle")).alias("identificationModule"),
        F.struct(F.upper("language").alias("overallStatus"),
                 F.struct(start.alias("date")).alias("startDateStruct")).alias("statusModule"),
        F.struct(F.when(i % 3 == 0, F.array(F.lit("PHASE2"), F.lit("PHASE3"))).alias("phases"),
                 F.struct(F.col("n_chars").alias("count")).alias("enrollmentInfo")).alias("designModule"),
        F.struct(F.col("full_text").alias("briefSummary")).alias("descriptionModule"),
        F.struct(F.struct(F.col("source").alias("name")).alias("leadSponsor")).alias("sponsorCollaboratorsModule"),
        F.struct(locs.alias("locations")).alias("contactsLocationsModule"),
        F.struct(F.array(F.struct(F.concat(F.lit("drug "), F.col("source")).alias("name"))).alias("interventions")).alias("armsInterventionsModule"),
        F.struct(F.array("language", "source").alias("conditions")).alias("conditionsModule"),
    ).alias("protocolSection"))
    raw = d.select(i.alias("pos"), F.to_json(payload).alias("payload"))
    t = PL.parse_trials(raw, order_col="pos")
    return t.select("external_id", "title", "start_date", "phase", F.array_join("conditions", "|").alias("conditions"),
                    F.array_join("interventions", "|").alias("interventions"),
                    F.array_join("countries", "|").alias("countries"), "country", "sponsor",
                    "enrollment", "status", "full_text")


# ------------------------------------------------------------------ S5 --
@register("drucksachen_parsed", V.with_(V.D_DOCS) + """
SELECT 'BT-20/' || CAST(document_id AS VARCHAR) AS external_id,
       CASE WHEN document_id % 6 = 0 THEN 'Ohne Titel' ELSE title END AS title, publish_date,
       'Drucksache (' || CASE language WHEN 'de' THEN 'Gesetzentwurf' ELSE 'Antrag' END || ')' AS document_type,
       CAST(document_id AS VARCHAR) AS dip_id, 20 AS wahlperiode,
       CASE WHEN language = 'de' THEN 'BT' ELSE 'BR' END AS institution,
       'Fraktion ' || upper(language) || ', Gruppe ' || CAST(source_id AS VARCHAR) AS urheber, full_text
FROM d_docs WHERE language IN ('de', 'fr')""")
def drucksachen_parsed(spark, sf_dir):
    """Parliamentary JSON -> document rows + child struct, type filter;
    every record comes twice."""
    d = model(spark, sf_dir).D
    typ = F.when(F.col("language") == "de", "Gesetzentwurf") \
           .when(F.col("language") == "fr", "Antrag").otherwise("Kleine Anfrage")
    i = F.col("document_id")
    payload = F.struct(
        i.cast("string").alias("id"), typ.alias("drucksachetyp"),
        F.date_format("publish_date", "yyyy-MM-dd").alias("datum"),
        F.array(F.struct(F.concat(F.lit("Fraktion "), F.upper("language")).alias("titel")),
                F.struct(F.concat(F.lit("Gruppe "), F.col("source_id").cast("string")).alias("titel"))).alias("urheber"),
        F.when(i % 6 != 0, F.col("title")).alias("titel"), F.col("full_text").alias("text"),
        F.concat(F.lit("20/"), i.cast("string")).alias("dokumentnummer"),
        F.lit(20).alias("wahlperiode"),
        F.when(F.col("language") != "de", "BR").alias("herausgeber"))
    raw = d.select(i.alias("pos"), F.to_json(payload).alias("payload"))
    raw = raw.withColumn("pos", F.explode(F.array(F.col("pos") * 2, F.col("pos") * 2 + 1)))
    p = PL.parse_drucksachen(raw, types=["Gesetzentwurf", "Antrag"], order_col="pos")
    return p.select("external_id", "title", "publish_date", "document_type", "extra.dip_id",
                    "extra.wahlperiode", "extra.institution", "extra.urheber", "full_text")


# ------------------------------------------------------------------ S6 --
PROP = "array<struct<type:struct<coding:array<struct<code:string>>>,valueCode:array<struct<code:string>>>>"


@register("device_catalog", V.with_(V.D_DOCS) + """
SELECT CAST(document_id AS VARCHAR) AS device_id,
       CASE WHEN document_id % 9 = 0 THEN 'Unknown' WHEN title = '' THEN 'x' ELSE title END AS app_name,
       'maker-' || CAST(source_id AS VARCHAR) AS manufacturer, language AS indication, 'IIa' AS risk_class,
       CASE document_id % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'permanent' WHEN 2 THEN 'provisional' ELSE 'unknown' END AS listing_status,
       CASE WHEN document_id % 4 = 0 THEN NULL ELSE publish_date END AS listing_date,
       contains(lower(CASE WHEN document_id % 9 = 0 THEN 'Unknown' WHEN title = '' THEN 'x' ELSE title END || ' ' || language || ' maker-' || CAST(source_id AS VARCHAR)), 'keit') AS neuro_relevant
FROM d_docs""")
def device_catalog(spark, sf_dir):
    """S6 + J6: FHIR-like bundles (device + catalogue entry) split by
    resource kind and left-joined; missing entries get 'unknown'."""
    d = model(spark, sf_dir).D
    i = F.col("document_id")

    def res(kind, id_=None, names=None, maker=None, note=None, ref=None, status=None, start=None, prop=None):
        n = lambda t: F.lit(None).cast(t)
        return F.struct(
            F.lit(kind).alias("resourceType"),
            (id_ if id_ is not None else n("string")).alias("id"),
            (names if names is not None else n("array<struct<type:string,name:string>>")).alias("deviceName"),
            (maker if maker is not None else n("string")).alias("manufacturerString"),
            (note if note is not None else n("array<struct<text:string>>")).alias("note"),
            F.struct(F.lit(kind == "none").cast("string").alias("display")).alias("manufacturerReference"),
            (prop if prop is not None else n(PROP)).alias("property"),
            F.struct((ref if ref is not None else n("string")).alias("reference")).alias("referencedItem"),
            (status if status is not None else n("string")).alias("status"),
            F.struct((start if start is not None else n("string")).alias("start")).alias("validityPeriod"))
    dev = res("DeviceDefinition", id_=i.cast("string"),
              names=F.when(i % 9 != 0, F.array(F.struct(F.lit("other").alias("type"), F.lit("x").alias("name")),
                                               F.struct(F.lit("udi-label-name").alias("type"), F.col("title").alias("name")))),
              maker=F.concat(F.lit("maker-"), F.col("source_id").cast("string")),
              note=F.array(F.struct(F.lit("").alias("text")), F.struct(F.col("language").alias("text"))),
              prop=F.array(F.struct(F.struct(F.array(F.struct(F.lit("riskClass").alias("code"))).alias("coding")).alias("type"),
                                    F.array(F.struct(F.lit("IIa").alias("code"))).alias("valueCode"))))
    cat = res("CatalogEntry", ref=F.concat(F.lit("DeviceDefinition/"), i.cast("string")),
              status=F.when(i % 4 == 1, "active").when(i % 4 == 2, "draft").otherwise("other"),
              start=F.date_format("publish_date", "yyyy-MM-dd'T'00:00:00"))
    entries = F.when(i % 4 == 0, F.array(F.struct(dev.alias("resource")))) \
               .otherwise(F.array(F.struct(dev.alias("resource")), F.struct(cat.alias("resource"))))
    raw = d.select(F.to_json(F.struct(entries.alias("entry"))).alias("payload"))
    p = PL.parse_device_catalog(raw, neuro_terms=("keit",))
    return p.select("device_id", "app_name", "manufacturer", "indication", "risk_class", "listing_status",
                    "listing_date", "neuro_relevant")


# ------------------------------------------------------------ S11, S12 --
@register("pages_absent_titles", r"""
WITH t AS (SELECT trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title,
                  page_id <= (SELECT avg(page_id) FROM pages) AS stored FROM pages)
SELECT title FROM t GROUP BY title HAVING NOT bool_or(stored)""")
def pages_absent_titles(spark, sf_dir):
    """Titles of the later half of the pages, appended only when absent
    among those of the earlier half."""
    from ..functions.text import html_title
    p = read(spark, sf_dir, "pages").select("page_id", html_title("html").alias("title"))
    half = p.agg(F.avg("page_id").alias("half"))  # one row
    p = p.crossJoin(F.broadcast(half)).withColumn("stored", F.col("page_id") <= F.col("half"))
    return TB.append_absent(p.filter("stored").select("title"), p.filter("not stored").select("title"), ["title"])


@register("events_since_mark", """
WITH marks AS (SELECT event_type, max(ts) AS mark FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00'
               AND event_type <> 'signup' GROUP BY 1)
SELECT e.event_type, count(*) AS n_new
FROM events e LEFT JOIN marks m USING (event_type)
WHERE e.ts >= coalesce(m.mark, TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAY) GROUP BY 1""")
def events_since_mark(spark, sf_dir):
    """Rows since each source's high-water mark, else a 30-day lookback
    (the 'signup' source has no mark here)."""
    e = read(spark, sf_dir, "events")
    marks = TB.high_water_marks(e.filter((F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
                                         & (F.col("event_type") != "signup")), "event_type", "ts")
    s = TB.since(e, marks, "event_type", "ts", "2024-01-31 00:00:00", 30)
    return s.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_new"))


# ------------------------------------------------------------------ K8 --
@register("run_stats", """
WITH h AS (SELECT source, doc_id, sha256(coalesce(text, 'None')) AS hsh FROM documents),
f AS (SELECT source, count(*) AS fetched, count(*) FILTER (WHERE n_chars >= 20) AS parsed, max(doc_id) AS mark FROM documents GROUP BY 1),
firsts AS (SELECT hsh, min(doc_id) AS doc_id FROM h GROUP BY hsh),
n AS (SELECT h.source, count(*) AS new FROM h JOIN firsts USING (hsh, doc_id) GROUP BY 1)
SELECT f.source, fetched, parsed, coalesce(n.new, 0) AS new, fetched - parsed AS errors, f.mark AS high_water_mark
FROM f LEFT JOIN n USING (source)""")
def q_run_stats(spark, sf_dir):
    """K8: per-source fetched / parsed (>= 20 chars) / new (first copy of
    each content hash) / errors."""
    d = read(spark, sf_dir, "documents")
    h = d.select("source", "doc_id", "n_chars", content_hash("text").alias("hsh"))
    return K.run_stats(h, "source", F.col("n_chars") >= 20, "hsh", "doc_id", mark="doc_id")


# ------------------------------------------------------------------ K3 --
@register("trends_upsert", """
WITH t AS (SELECT event_type AS keyword, 'G' || CAST(user_id % 31 AS VARCHAR) AS geography,
                  CAST(ts AS DATE) AS date, value AS interest_score, event_id FROM events WHERE event_id % 11 <> 0),
tgt AS (SELECT keyword, geography, date, max(interest_score) AS interest_score FROM t
        WHERE date < DATE '2024-01-20' GROUP BY 1, 2, 3),
upd AS (SELECT keyword, geography, date, arg_max(interest_score * 2.0, event_id) AS interest_score FROM t
        WHERE date >= DATE '2024-01-15' GROUP BY 1, 2, 3)
SELECT * FROM tgt WHERE NOT EXISTS (SELECT 1 FROM upd u WHERE u.keyword = tgt.keyword
                                    AND u.geography = tgt.geography AND u.date = tgt.date)
UNION ALL SELECT * FROM upd""")
def trends_upsert(spark, sf_dir):
    """K3: upsert by (keyword, geography, date); last update per key wins."""
    t = trends_view(spark, sf_dir).filter(~F.col("is_rising"))
    tgt = t.filter(F.col("date") < F.lit("2024-01-20").cast("date")) \
           .groupBy("keyword", "geography", "date").agg(F.max("interest_score").alias("interest_score"))
    upd = t.filter(F.col("date") >= F.lit("2024-01-15").cast("date")) \
           .select("keyword", "geography", "date", (F.col("interest_score") * 2.0).alias("interest_score"), "event_id")
    return K.upsert(tgt, upd, ["keyword", "geography", "date"], "event_id")


# ------------------------------------------------------------------ K5 --
@register("notes_after_delete", """
SELECT conv_id AS document_id, count(*) AS n_notes FROM conversations
WHERE conv_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1""")
def notes_after_delete(spark, sf_dir):
    """K5: delete documents flagged toxic and cascade to their notes."""
    from ..bindings import notes_view
    n = notes_view(spark, sf_dir)
    gone = read(spark, sf_dir, "labels").filter(F.col("toxic") == 1).select(F.col("doc_id").alias("document_id"))
    return K.delete_keys(n, gone, "document_id").groupBy("document_id").agg(F.count(F.lit(1)).alias("n_notes"))


# ------------------------------------------------------------------ K7 --
@register("alert_rows", V.with_(*V.SCORED_CHAIN) + f"""
, sel AS (SELECT * FROM scored WHERE strategic_score >= 6.0 AND scraped_at >= {V.AS_OF} - INTERVAL 12 HOUR
          ORDER BY strategic_score DESC, document_id, keyword_id LIMIT 20)
SELECT 'immediate' AS kind, substr(title, 1, 80) AS subject, CAST(1 AS BIGINT) AS n_signals FROM sel
WHERE strategic_score >= 8.0
UNION ALL
SELECT 'digest', 'Signals of this run: ' || CAST(count(*) AS VARCHAR), count(*)
FROM sel WHERE strategic_score < 8.0 HAVING count(*) > 0""")
def alert_rows(spark, sf_dir):
    """K7: one row per immediate alert plus one digest row."""
    m = model(spark, sf_dir)
    return AL.alert_rows(AL.select_alerts(m.scored, m.as_of))


