"""JSON payload parsers (S4 trials, S5 parliamentary papers, S6 device
catalogue bundles). Explicit schemas, nested projections, no inference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRIAL_SCHEMA = (
    "struct<protocolSection: struct<"
    "identificationModule: struct<nctId: string, briefTitle: string, officialTitle: string>, "
    "statusModule: struct<overallStatus: string, startDateStruct: struct<date: string>>, "
    "designModule: struct<phases: array<string>, enrollmentInfo: struct<count: bigint>>, "
    "descriptionModule: struct<briefSummary: string>, "
    "sponsorCollaboratorsModule: struct<leadSponsor: struct<name: string>>, "
    "contactsLocationsModule: struct<locations: array<struct<country: string>>>, "
    "armsInterventionsModule: struct<interventions: array<struct<name: string>>>, "
    "conditionsModule: struct<conditions: array<string>>>>")


def first_per_id(rows: DataFrame, id_col: str, order: str) -> DataFrame:
    """Rows with an id, the first one of each: the smallest order value is
    found first (it combines before its shuffle), then joined back."""
    rows = rows.filter(F.coalesce(F.col(id_col), F.lit("")) != "")
    first = rows.groupBy(id_col).agg(F.min(order).alias(order))
    return rows.join(first, [id_col, order], "left_semi").dropDuplicates([id_col])


def parse_trials(raw: DataFrame, json_col: str = "payload", order_col: str | None = None) -> DataFrame:
    """Trial JSON -> id, title ('Untitled' if none), start date ('Y-m-d'
    then 'Y-m'), phase ('N/A' if none), conditions, interventions, countries
    (distinct, document order), first country, sponsor, status, enrollment,
    summary. Studies without an id go; with ``order_col`` the first study of
    an id stays."""
    keep = [order_col] if order_col else []
    p = raw.select(*keep, F.from_json(F.col(json_col), TRIAL_SCHEMA).alias("t")).select(*keep, "t.protocolSection.*")
    start = F.col("statusModule.startDateStruct.date")
    countries = F.array_distinct(F.filter("contactsLocationsModule.locations.country",
                                          lambda c: F.coalesce(c, F.lit("")) != ""))
    none = F.array().cast("array<string>")
    phases = F.coalesce("designModule.phases", none)
    out = p.select(
        *keep, F.col("identificationModule.nctId").alias("external_id"),
        F.coalesce("identificationModule.briefTitle", F.lit("Untitled")).alias("title"),
        F.coalesce(F.try_to_date(start, "yyyy-MM-dd"), F.try_to_date(start, "yyyy-MM")).alias("start_date"),
        F.when(F.size(phases) > 0, F.array_join(phases, ", ")).otherwise("N/A").alias("phase"),
        F.coalesce("conditionsModule.conditions", none).alias("conditions"),
        F.transform(F.coalesce("armsInterventionsModule.interventions.name", none),
                    lambda x: F.coalesce(x, F.lit(""))).alias("interventions"),
        F.coalesce(countries, none).alias("countries"),
        F.coalesce(F.get(countries, 0), F.lit("")).alias("country"),
        F.coalesce("sponsorCollaboratorsModule.leadSponsor.name", F.lit("")).alias("sponsor"),
        F.coalesce("statusModule.overallStatus", F.lit("")).alias("status"),
        F.col("designModule.enrollmentInfo.count").alias("enrollment"),
        F.coalesce("descriptionModule.briefSummary", F.lit("")).alias("full_text"))
    if order_col:
        return first_per_id(out, "external_id", order_col)
    return out.filter(F.coalesce("external_id", F.lit("")) != "")


PAPER_SCHEMA = ("struct<id: string, drucksachetyp: string, datum: string, "
                "urheber: array<struct<titel: string>>, dokumentnummer: string, titel: string, "
                "text: string, wahlperiode: int, herausgeber: string>")


def parse_drucksachen(raw: DataFrame, json_col: str = "payload", types: list[str] | None = None,
                      order_col: str | None = None) -> DataFrame:
    """Parliamentary paper JSON -> document row + child struct. Papers
    without an id go; with ``order_col`` the first paper of an id stays (before
    the type filter)."""
    keep = [order_col] if order_col else []
    p = raw.select(*keep, F.from_json(F.col(json_col), PAPER_SCHEMA).alias("d")).select(*keep, "d.*")
    p = first_per_id(p, "id", order_col) if order_col else p.filter(F.coalesce("id", F.lit("")) != "")
    if types:
        p = p.filter(F.col("drucksachetyp").isin(*types))
    number = F.coalesce("dokumentnummer", F.lit(""))
    return p.select(
        F.concat(F.lit("BT-"), number).alias("external_id"),
        F.coalesce("titel", F.lit("Ohne Titel")).alias("title"),
        F.try_to_date(F.col("datum"), "yyyy-MM-dd").alias("publish_date"),
        F.concat(F.lit("Drucksache ("), F.coalesce("drucksachetyp", F.lit("")), F.lit(")")).alias("document_type"),
        F.coalesce("text", F.lit("")).alias("full_text"),
        F.struct(F.col("id").alias("dip_id"), F.col("drucksachetyp").alias("drucksache_type"),
                 F.coalesce("wahlperiode", F.lit(0)).alias("wahlperiode"),
                 F.coalesce("herausgeber", F.lit("BT")).alias("institution"),
                 F.coalesce(F.array_join("urheber.titel", ", "), F.lit("")).alias("urheber"),
                 number.alias("doc_nummer")).alias("extra"))


# Listing status of a catalogue entry
LISTING_STATUS = {"active": "permanent", "draft": "provisional", "retired": "delisted", "unknown": "unknown"}

_CODE = "struct<code: string>"
BUNDLE_SCHEMA = (
    "struct<entry: array<struct<resource: struct<resourceType: string, id: string, "
    "deviceName: array<struct<type: string, name: string>>, manufacturerString: string, "
    "manufacturerReference: struct<display: string>, note: array<struct<text: string>>, "
    f"property: array<struct<type: struct<coding: array<{_CODE}>>, valueCode: array<{_CODE}>>>, "
    "referencedItem: struct<reference: string>, status: string, "
    "validityPeriod: struct<start: string>>>>>")


def _given(c):
    return F.when(F.coalesce(c, F.lit("")) != "", c)


def parse_device_catalog(raw: DataFrame, json_col: str = "payload",
                         neuro_terms: tuple[str, ...] = ()) -> DataFrame:
    """S6 + J6: split devices and catalogue entries (one pass over the
    payloads), joined by 'DeviceDefinition/<id>'; a missing entry is 'unknown'.

    Name: the label name, else the first one, else 'Unknown'. Indication: the
    first note with text. Risk class: the first property with that code. A
    device is relevant if its name, indication or maker holds a term.
    """
    e = raw.select(F.explode(F.from_json(F.col(json_col), BUNDLE_SCHEMA)["entry"]).alias("e")).select("e.resource.*")
    label = F.get(F.filter("deviceName", lambda d: d["type"] == "udi-label-name"), 0)["name"]
    risk = F.get(F.filter("property", lambda p: F.get(p["type"]["coding"], 0)["code"] == "riskClass"), 0)
    kind = F.when(F.col("resourceType") == "CatalogEntry", "entry").when(_given(F.col("id")).isNotNull(), "device")
    status = F.create_map(*[F.lit(x) for kv in LISTING_STATUS.items() for x in kv])
    rows = e.select(
        kind.alias("kind"),
        F.when(kind == "entry", F.regexp_extract("referencedItem.reference", "^DeviceDefinition/(.+)$", 1))
         .otherwise(F.col("id")).alias("device_id"),
        F.coalesce(_given(label), _given(F.get("deviceName", 0)["name"]), F.lit("Unknown")).alias("app_name"),
        F.coalesce(_given(F.col("manufacturerString")), _given(F.col("manufacturerReference.display")),
                   F.lit("")).alias("manufacturer"),
        F.coalesce(F.get(F.filter("note.text", lambda t: F.coalesce(t, F.lit("")) != ""), 0), F.lit("")).alias("indication"),
        F.coalesce(F.get(risk["valueCode"], 0)["code"], F.lit("")).alias("risk_class"),
        F.coalesce(status[F.col("status")], F.lit("unknown")).alias("listing_status"),
        F.try_to_date(F.substring("validityPeriod.start", 1, 10), "yyyy-MM-dd").alias("listing_date"))
    # a device and its entry meet in one group; of repeated ones the last by date, then name
    def last(kind_, *cols):
        key = F.when(F.col("kind") == kind_, F.struct("listing_date", *cols))
        return F.max(key)
    g = rows.filter("kind is not null").groupBy("device_id").agg(
        last("device", "app_name", "manufacturer", "indication", "risk_class").alias("d"),
        last("entry", "listing_status").alias("c")).filter("d is not null")
    out = g.select("device_id", "d.app_name", "d.manufacturer", "d.indication", "d.risk_class",
                   F.coalesce("c.listing_status", F.lit("unknown")).alias("listing_status"),
                   F.col("c.listing_date").alias("listing_date"))
    both = F.lower(F.concat_ws(" ", "app_name", "indication", "manufacturer"))
    hit = F.lit(False)
    for t in neuro_terms:
        hit = hit | both.contains(t)
    return out.withColumn("neuro_relevant", hit)
