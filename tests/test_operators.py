"""Hand fixtures: one row per branch of the rule chains, parsers on raw
samples, sinks, and streaming = batch."""

from __future__ import annotations

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from sigspark import lexicon as L
from sigspark.functions import text as T
from sigspark.functions.dates import parse_date_any
from sigspark.operators import classify as C
from sigspark.operators import relational as RL
from sigspark.operators import scoring as SC
from sigspark.operators import tagging as TG


def _docs(spark, rows):
    return spark.createDataFrame(rows, "document_id long, source_id int, title string, full_text string, "
                                       "publish_date date, scraped_at timestamp, country string, "
                                       "document_type string, url string")


def test_exact_tag_head_and_body(spark):
    body = "x" * 300 + " license here"
    d = _docs(spark, [(1, 0, "License news", "text", None, None, None, "news", None),
                      (2, 0, "other", body, None, None, None, "news", None),
                      (3, 0, "none", "nothing", None, None, None, "news", None)])
    k = spark.createDataFrame([(1, "License", 2, "c", True)], "keyword_id int, keyword string, level int, "
                                                               "cluster string, active boolean")
    got = {(r.document_id, r.match_score) for r in TG.tag_exact(d, k).collect()}
    assert got == {(1, 9.5), (2, 8.0)}


def test_whole_text_is_matched_unless_capped(spark):
    d = _docs(spark, [(1, 0, "t", "y" * 3100 + " token", None, None, None, "news", None)])
    k = spark.createDataFrame([(3, "token", 1, "b", True)], "keyword_id int, keyword string, level int, "
                                                             "cluster string, active boolean")
    assert TG.tag_exact(d, k).count() == 1
    assert TG.tag_exact(d, k, cap=3000).count() == 0


def test_lexicon_of_any_size(spark):
    rows = [(i, f"term{i}x", 1, "c", True) for i in range(2500)] + [(9000, "one two three", 1, "c", True)]
    k = spark.createDataFrame(rows, "keyword_id int, keyword string, level int, cluster string, active boolean")
    d = _docs(spark, [(1, 0, "one two thre", "term7x and term2499x", None, None, None, "news", None)])
    got = {(r.keyword_id, r.match_kind) for r in TG.tag(d, k).collect()}
    assert got == {(7, "exact"), (2499, "exact"), (9000, "fuzzy")}


def test_indel_ratio_known_values(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("abc", "abc"), ("abc", "xyz"),
                                ("and attion of", "and attion to")], "a string, b string")
    got = [round(r.r, 4) for r in df.select(T.indel_ratio("a", "b").alias("r")).collect()]
    # 100 * 2 * LCS / (la + lb)
    assert got == [round(200 * 4 / 13, 4), 100.0, 0.0, round(200 * 12 / 26, 4)]


def test_bounded_ratio_never_drops_a_match(spark):
    pairs = [("released under mit", "released undr mit"), ("abcdef", "abcdxf"), ("aaaa", "bbbbbbbb")]
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select(T.indel_ratio("a", "b").alias("r"), F.when(T.fuzzy_possible("a", "b", 85), T.indel_ratio("a", "b")).alias("rb")).collect()
    for r in rows:
        if r.r >= 85:
            assert r.rb == r.r
        else:
            assert r.rb is None or r.rb < 85


def test_lcs_length_equals_the_table(spark):
    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    r = random.Random(11)
    sizes = [0, 1, 2, 7, 30, 61, 62, 63, 64, 123, 124, 125, 190]
    rows = [("".join(r.choices(al, k=n)), "".join(r.choices(al, k=r.choice(sizes)))) for al in ("ab", "abcdef gh", "aé日😀\n ") for n in sizes]
    rows += [(x, x) for x in ("a" * 62, "a" * 63, "ab" * 62, "😀" * 125)] + [(None, "a"), ("a", None)]
    got = spark.createDataFrame(rows, "a string, b string").withColumn("n", T.lcs_length("a", "b")).collect()
    for x in got:
        assert x.n == (None if x.a is None or x.b is None else table(x.a, x.b)), x


def test_fuzzy_first_window_wins(spark):
    # no exact hit; windows of 3 words, step 3: [foo bar baz] [and attion to] [and xttion of]
    d = _docs(spark, [(1, 0, "foo", "bar baz and attion to and xttion of", None, None, None, "news", None)])
    k = spark.createDataFrame([(101, "and attion of", 1, "fz", True)], "keyword_id int, keyword string, "
                                                                       "level int, cluster string, active boolean")
    rows = TG.tag_fuzzy(d, k).collect()
    assert len(rows) == 1
    assert rows[0].match_score == pytest.approx(200 * 12 / 26 / 100 * 7)


def test_relevance_and_impact_branches(spark):
    df = spark.createDataFrame(
        [(9.5, 5, 5, "Germany", "Drucksache (Gesetzentwurf)", "x"),
         (8.0, 1, 9, None, "clinical_trial", "a phase iii study"),
         (8.0, 3, 3, "EU", "clinical_trial", "phase 2"),
         (8.0, 3, 1, "Kenya", "", None)],
        "match_score double, trust_level int, level int, country string, document_type string, full_text string")
    rows = df.select(SC.relevance_expr().alias("r"), SC.impact_expr().alias("i")).collect()
    assert rows[0].r == pytest.approx(min(9.5 * .4 + 5 / 5 * 10 * .25 + 9.5 * .2 + 1.0 * 10 * .15, 10))
    assert rows[1].r == pytest.approx(8 * .4 + 1 / 5 * 10 * .25 + 5.0 * .2 + .3 * 10 * .15)
    assert rows[0].i == pytest.approx(10 * .4 + 5 / 5 * 10 * .15 + 5 * .25 + 5 * .2)
    assert rows[1].i == pytest.approx(7 * .4 + 1 / 5 * 10 * .15 + 5 * .25 + 9 * .2)
    assert rows[2].i == pytest.approx(7 * .4 + 3 / 5 * 10 * .15 + 9 * .25 + 7 * .2)
    assert rows[3].i == pytest.approx(4 * .4 + 3 / 5 * 10 * .15 + 5 * .25 + 5 * .2)


def test_urgency_boundaries(spark):
    df = spark.createDataFrame([(8.0,), (7.99,), (6.0,), (4.0,), (3.99,)], "strategic_score double")
    got = [r.u for r in df.select(SC.urgency_expr().alias("u")).collect()]
    assert got == ["immediate", "short_term", "short_term", "medium_term", "informational"]


def test_rarity_steps(spark):
    df = spark.createDataFrame([(1,), (3,), (4,), (10,), (30,), (31,)], "n long")
    got = [r.p for r in df.select(SC.rarity_points("n").alias("p")).collect()]
    assert got == [3.0, 3.0, 2.0, 2.0, 1.0, 0.0]


def test_strategic_no_flags_and_flags(spark):
    df = spark.createDataFrame(
        [(6.0, 8.0, 2.5, "Kenya", True, False, False, False, False, False),
         (6.0, 8.0, 2.5, "Kenya", False, False, False, False, False, False),
         (6.0, 8.0, 2.5, "Germany", True, True, True, False, True, False)],
        "relevance_score double, impact_score double, novelty_score double, country string, has_flags boolean, "
        "is_regulatory boolean, is_scientific boolean, is_parliamentary boolean, is_lmic boolean, "
        "is_reimbursement boolean")
    got = [r.s for r in df.select(SC.strategic_expr().alias("s")).collect()]
    assert got[0] == pytest.approx(min(6 * .5 * .35 + 6 * .5 * .25 + 2.5 * .2 + 3.0 * 10 * .2, 10))
    assert got[1] == pytest.approx(7.0)
    assert got[2] == pytest.approx(8 * .35 + 8 * .25 + 2.5 * .2 + 8 * .2)


def test_country_alias(spark):
    df = spark.createDataFrame([("Deutschland",), ("U.S.",), ("Kenya",), (None,)], "c string")
    assert [r.n for r in df.select(TG.normalize_country("c").alias("n")).collect()] == \
        ["Germany", "USA", "Kenya", None]


def test_classify_multi_first_entities(spark):
    df = spark.createDataFrame([("that pour license",), ("nothing",)], "t string")
    rows = df.select(C.classify_multi("t", L.TEST_TOPICS, "General").alias("m"),
                     C.classify_first("t", L.TEST_THREATS, "Other").alias("f"),
                     C.extract_entities("t", {"pour": "Pourville", "that": "Thatham",
                                              "lic": "Lic (region)"}).alias("e")).collect()
    assert rows[0].m == ["English prose", "French prose", "Licensing"]
    assert rows[1].m == ["General"]
    assert rows[0].f == "Licence" and rows[1].f == "Other"
    assert rows[0].e == ["Pourville", "Thatham"] and rows[1].e == []


def test_tags_round_trip(spark):
    df = spark.createDataFrame([("[Tags: a, b ,] rest of text",), ("plain",)], "x string")
    tags, rest = T.split_tags("x")
    rows = df.select(tags.alias("t"), rest.alias("r")).collect()
    assert rows[0].t == ["a", "b"] and rows[0].r == "rest of text"
    assert rows[1].t == [] and rows[1].r == "plain"
    built = spark.createDataFrame([(["a", "b"], "txt")], "t array<string>, x string") \
                 .select(T.join_tags("t", "x").alias("j")).first().j
    assert built == "[Tags: a, b] txt"


def test_parse_date_any(spark):
    df = spark.createDataFrame([("2024-03-05",), ("Tue, 05 Mar 2024 10:00:00 +0000",), ("2024-03",),
                                ("junk",)], "s string")
    got = [str(r.d) for r in df.select(
        parse_date_any("s", ["yyyy-MM-dd", "rfc822", "yyyy-MM"]).alias("d")).collect()]
    assert got == ["2024-03-05", "2024-03-05", "2024-03-01", "None"]


def test_html_to_text_and_urls(spark):
    html = '<html><head><title> T </title><script>var a="<p>";</script></head>' \
           '<body><a href="/x">X</a> &amp; <b>bold</b></body></html>'
    df = spark.createDataFrame([(html, "https://h.example.com/p?q=1#top")], "h string, u string")
    r = df.select(T.html_to_text("h").alias("t"), T.html_title("h").alias("ti"),
                  T.html_links("h").alias("l"), T.clean_url("u").alias("c"), T.url_host("u").alias("o")).first()
    assert r.t == "T X & bold" and r.ti == "T" and r.l == ["/x"]
    assert r.c == "https://h.example.com/p" and r.o == "h.example.com"


def test_feed_parser_fallbacks(spark):
    from sigspark.sources.feeds import parse_feed_items
    items = [
        ("f1", 1, "<item><title>A</title><link>l1</link><pubDate>Tue, 05 Mar 2024 10:00:00 +0000</pubDate>"
                  "<description>&lt;b&gt;Sum&lt;/b&gt;</description><category>x</category></item>"),
        ("f1", 2, "<item><title>B</title><updated>2024-03-06</updated><summary>plain</summary></item>"),
        ("f1", 3, "<item><title>C</title></item>"),
    ]
    raw = spark.createDataFrame(items, "feed string, pos int, xml string")
    rows = parse_feed_items(raw, max_per_feed=2).orderBy("pos").collect()
    assert [r.title for r in rows] == ["A", "B"]
    assert str(rows[0].published) == "2024-03-05" and rows[0].summary == "Sum" and rows[0].tags == ["x"]
    assert str(rows[1].published) == "2024-03-06" and rows[1].summary == "plain"


def test_atom_entries(spark):
    from sigspark.sources.feeds import parse_feed_items
    xml = ("<entry><title>T</title><link rel=\"self\" href=\"https://a/self\"/><link href=\"https://a/x\"/>"
           "<updated>2024-03-06T10:00:00Z</updated><category term=\"news\"/><category term=\"eu\"/>"
           "<author><name>Jo</name></author><content>long &lt;b&gt;text&lt;/b&gt;</content></entry>")
    r = parse_feed_items(spark.createDataFrame([("f", 1, xml)], "feed string, pos int, xml string")).first()
    assert (r.link, r.tags, r.author, str(r.published)) == ("https://a/x", ["news", "eu"], "Jo", "2024-03-06")


def test_article_parser(spark):
    from sigspark.sources.feeds import parse_articles

    def article(extra="", authors="", pmid="<PMID Version=\"1\">42</PMID>"):
        return (f"<PubmedArticle><MedlineCitation>{pmid}<Article><Journal><Title>J</Title><JournalIssue><PubDate>"
                f"<Year>2023</Year><Month>Mar</Month></PubDate></JournalIssue></Journal>{extra}"
                f"<AuthorList>{authors}</AuthorList></Article></MedlineCitation></PubmedArticle>")
    full = article("<ArticleTitle>Study</ArticleTitle><Abstract><AbstractText Label=\"BACKGROUND\">bg</AbstractText>"
                   "<AbstractText>rest</AbstractText></Abstract><ArticleDate><Year>2024</Year><Month>05</Month>"
                   "<Day>07</Day></ArticleDate>",
                   "<Author><CollectiveName>Group</CollectiveName></Author><Author><LastName>Doe</LastName>"
                   "<ForeName>Jo</ForeName><AffiliationInfo><Affiliation>Dept, Uni, Kenya.</Affiliation>"
                   "</AffiliationInfo></Author><Author><LastName>Roe</LastName></Author>")
    rows = parse_articles(spark.createDataFrame([(1, full), (2, article())], "k int, xml string")).collect()
    r = next(x for x in rows if x.title == "Study")
    assert (r.external_id, r.abstract, r.journal) == ("PMID:42", "BACKGROUND: bg rest", "J")
    assert (str(r.publish_date), r.authors, r.country) == ("2024-05-07", "Doe Jo, Roe", "Kenya")
    r = next(x for x in rows if x.title != "Study")
    assert (r.title, r.abstract, str(r.publish_date), r.authors, r.country) == ("Untitled", "", "2023-03-01", "", "")


def test_trial_parser(spark):
    import json
    from sigspark.sources.payloads import parse_trials

    def study(nct, **mods):
        return json.dumps({"protocolSection": {"identificationModule": {"nctId": nct, "briefTitle": "B"}, **mods}})
    rows = [(1, study("N1", designModule={"phases": ["PHASE1", "PHASE2"], "enrollmentInfo": {"count": 7}},
                      statusModule={"overallStatus": "OPEN", "startDateStruct": {"date": "2024-05"}},
                      armsInterventionsModule={"interventions": [{"name": "x"}, {"type": "y"}]},
                      conditionsModule={"conditions": ["c1", "c2"]},
                      contactsLocationsModule={"locations": [{"country": "DE"}, {}, {"country": "FR"}, {"country": "DE"}]})),
            (2, study("N1")), (3, study("")), (4, "{}"), (5, study("N2")), (6, "not json")]
    got = {r.external_id: r for r in parse_trials(spark.createDataFrame(rows, "pos int, payload string"),
                                                  order_col="pos").collect()}
    assert set(got) == {"N1", "N2"}
    a, b = got["N1"], got["N2"]
    assert (a.phase, a.enrollment, str(a.start_date), a.interventions) == ("PHASE1, PHASE2", 7, "2024-05-01", ["x", ""])
    assert (a.conditions, a.countries, a.country, a.status) == (["c1", "c2"], ["DE", "FR"], "DE", "OPEN")
    assert (b.phase, b.start_date, b.conditions, b.country, b.full_text) == ("N/A", None, [], "", "")


def test_trials_parsed_returns_every_study(spark):
    """Every document is parsed: where a pair's first record has no id, its
    second one is the study's row."""
    from __spark_entry__ import queries
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars").collect()):
        if not (r.doc_id % 2 == 0 and r.doc_id % 7 == 0):
            want.setdefault(f"NCT{r.doc_id // 2:08d}", r.n_chars)
    got = [(r.external_id, r.enrollment) for r in queries()["trials_parsed"](spark, sf).collect()]
    assert sorted(got) == sorted(want.items())


def test_third_page_of_ids_with_gaps(spark, tmpdir_path):
    import os
    from __spark_entry__ import queries
    sf = "/root/testdata/sf0.001"
    for name in os.listdir(sf):
        if name != "documents.parquet":
            os.symlink(f"{sf}/{name}", f"{tmpdir_path}/{name}")
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id * 3 + 50 as doc_id", "* except (doc_id)")
    docs.write.parquet(f"{tmpdir_path}/documents.parquet")
    got = [r.document_id for r in queries()["docs_page_2"](spark, tmpdir_path).collect()]
    assert got == sorted(r.doc_id for r in docs.select("doc_id").collect())[24:36]


def test_paper_and_device_parsers(spark):
    import json
    from sigspark.sources.payloads import parse_device_catalog, parse_drucksachen
    papers = [(1, {"id": "1", "drucksachetyp": "Antrag", "dokumentnummer": "20/1", "urheber": [{"titel": "A"}, {"titel": "B"}]}),
              (2, {"id": "1", "drucksachetyp": "Antrag", "dokumentnummer": "20/9"}), (3, {"drucksachetyp": "Antrag"})]
    r, = parse_drucksachen(spark.createDataFrame([(i, json.dumps(x)) for i, x in papers], "pos int, payload string"),
                           types=["Antrag"], order_col="pos").collect()
    assert (r.external_id, r.title, r.full_text, r.extra.institution) == ("BT-20/1", "Ohne Titel", "", "BT")
    assert (r.extra.urheber, r.extra.wahlperiode) == ("A, B", 0)
    risk = [{"type": {"coding": [{"code": "other"}]}}, {"type": {"coding": [{"code": "riskClass"}]}, "valueCode": [{"code": "I"}]}]
    entries = [
        {"resourceType": "DeviceDefinition", "id": "d1", "deviceName": [{"type": "z", "name": "n"}, {"type": "udi-label-name", "name": "Brainy"}],
         "manufacturerString": "", "manufacturerReference": {"display": "Maker"}, "note": [{"text": ""}, {"text": "use"}], "property": risk},
        {"resourceType": "CatalogEntry", "referencedItem": {"reference": "DeviceDefinition/d1"}, "status": "active",
         "validityPeriod": {"start": "2024-02-03T00:00:00"}},
        {"resourceType": "DeviceDefinition", "id": "d2"}, {"resourceType": "DeviceDefinition"}]
    raw = spark.createDataFrame([(json.dumps({"entry": [{"resource": e} for e in entries]}),)], "payload string")
    got = {r.device_id: r for r in parse_device_catalog(raw, neuro_terms=("brain",)).collect()}
    a, b = got["d1"], got["d2"]
    assert set(got) == {"d1", "d2"}
    assert (a.app_name, a.manufacturer, a.indication, a.risk_class) == ("Brainy", "Maker", "use", "I")
    assert (a.listing_status, str(a.listing_date), a.neuro_relevant) == ("permanent", "2024-02-03", True)
    assert (b.app_name, b.manufacturer, b.listing_status, b.listing_date, b.neuro_relevant) == ("Unknown", "", "unknown", None, False)


def test_sources_and_ids(spark):
    from sigspark.sources.tables import load_lexicon, load_sources, with_source_ids
    have = spark.createDataFrame([(4, "a")], "source_id int, source_name string")
    new = load_sources(spark, [{"name": "a", "source_type": "x"}, {"name": "b", "source_type": "y"},
                               {"name": "b", "source_type": "z", "trust_level": 5}], have).collect()
    assert [(r.source_name, r.source_type, r.trust_level, r.refresh_hours) for r in new] == [("b", "y", 3, 24)]
    rows = spark.createDataFrame([(1, "a"), (2, "c"), (3, "b"), (4, "c")], "k int, source_name string")
    with_ids, every = with_source_ids(rows, have)
    assert {(r.k, r.source_id) for r in with_ids.collect()} == {(1, 4), (2, 6), (3, 5), (4, 6)}
    assert every.count() == 3
    k = load_lexicon(spark, {"s": [{"keyword": "x"}, {"keyword": "x"}, {"keyword": "y"}]}, {"s": 2},
                     spark.createDataFrame([("y", 2)], "keyword string, level int"))
    assert [r.keyword for r in k.collect()] == ["x"]


def test_writers(spark, tmpdir_path):
    """K1, K2 and K6: appends with default flags, child rows, CSV."""
    from sigspark import sinks as K
    d = _docs(spark, [(1, 0, "t", "x", None, None, None, "news", None)]).withColumn("extra", F.struct(F.lit(7).alias("n")))
    K.write_documents(d.drop("extra").withColumn("scraped_at", F.lit("2024-03-01 00:00:00").cast("timestamp")),
                      tmpdir_path + "/d", tmpdir_path + "/f")
    assert spark.read.parquet(tmpdir_path + "/d").first().publish_month == "2024-03"
    flags = spark.read.parquet(tmpdir_path + "/f").first()
    assert flags.document_id == 1 and not any(flags[f] for f in L.FLAG_NAMES)
    K.write_child(d, tmpdir_path + "/c")
    assert tuple(spark.read.parquet(tmpdir_path + "/c").first()) == (1, 7)
    K.export_csv(d.select("document_id", "title"), tmpdir_path + "/csv")
    assert spark.read.option("header", True).csv(tmpdir_path + "/csv").first().title == "t"


def test_documents_from_items(spark):
    """P1 + P6: parsed items become document rows."""
    from sigspark.sources.feeds import to_document
    items = spark.createDataFrame([("T", "l", None, "S"), ("T2", None, None, None)],
                                  "title string, link string, published date, summary string")
    rows = to_document(items, 3, "news").collect()
    assert all(r.external_id.startswith("src3-") and r.content_hash for r in rows) and len({r.external_id for r in rows}) == 2


def test_filters_and_first_rows(spark):
    df = spark.createDataFrame([(1, "k", ["a"], 2), (2, "k", ["b", "c"], 1), (3, None, [], 1), (4, None, ["c"], 0)],
                               "id int, k string, tags array<string>, o int")
    assert [r.id for r in df.filter(RL.has_any("tags", ["c", "z"])).orderBy("id").collect()] == [2, 4]
    assert df.filter(RL.has_any("tags", [])).count() == 4
    assert {(r.k, r.id) for r in RL.first_per(df, ["k"], ["o", "id"]).collect()} == {("k", 2), (None, 4)}
    seen = spark.createDataFrame([("k",)], "k string")
    assert [r.id for r in RL.new_only(df, seen, ["k"], ["o", "id"]).collect()] == [4]
    dim = spark.createDataFrame([("k", "label")], "k string, name string")
    assert {r.name for r in RL.left_lookup(df, dim, "k", {"name": "-"}).collect()} == {"label", "-"}
    flags = spark.createDataFrame([(1, True), (2, False)], "document_id int, f boolean")
    assert [r.document_id for r in RL.by_flag(df.withColumnRenamed("id", "document_id"), flags, "f").collect()] == [1]


def test_links_in_any_quotes(spark):
    h = """<a class=x href='/one'>1</a><A HREF="/two">2</A><a href=/three>3</a><a name="n">4</a>"""
    r = spark.createDataFrame([(h,)], "h string").select(T.html_links("h").alias("l")).first()
    assert r.l == ["/one", "/two", "/three"]


def test_small_forms(spark, tmpdir_path):
    """P12, S7 and X7."""
    from sigspark import sinks as K
    from sigspark.operators.series import parse_blacklist
    from sigspark.streaming import jobs
    df = spark.createDataFrame([(["x", "yy", "zzz"],), ([],)], "a array<string>")
    got = [r.f for r in df.select(T.first_match("a", lambda w: F.length(w) > 1, "-").alias("f")).collect()]
    assert got == ["yy", "-"]
    raw = spark.createDataFrame([('{"data": [{"ipAddress": "1", "countryCode": "DE", "abuseConfidenceScore": 90}, '
                                  '{"ipAddress": "2"}]}',), ("bad",)], "payload string")
    assert {tuple(r) for r in parse_blacklist(raw).collect()} == {("1", "DE", 90.0), ("2", "??", 0.0)}
    run = jobs.upsert_batches(tmpdir_path + "/u", ["k"], "o", 4)
    for epoch in (0, 0, 1):
        run(spark.createDataFrame([("a", "p1", epoch)], "k string, p string, o int"), epoch)
    assert [r.o for r in K.read_latest(spark, tmpdir_path + "/u", ["k"], 4).collect()] == [1]


def test_only_unscored_signals(spark):
    """Scored keys count for novelty and are not scored again."""
    d = _docs(spark, [(i, 1, "t", "x", None, None, "USA", "news", None) for i in (1, 2, 3)])
    k = spark.createDataFrame([(1, "x", 2, "c", True)], "keyword_id int, keyword string, level int, cluster string, active boolean")
    s = spark.createDataFrame([(1, "s", 3)], "source_id int, source_name string, trust_level int")
    g = spark.createDataFrame([(i, 1, 8.0) for i in (1, 2, 3)], "document_id long, keyword_id int, match_score double")
    every = {r.document_id: r for r in SC.score(g, d, k, s, None).collect()}
    rest = SC.score(g, d, k, s, None, already=spark.createDataFrame([(1, 1)], "document_id long, keyword_id int")).collect()
    assert {r.document_id for r in rest} == {2, 3}
    assert all(r.novelty_score == every[r.document_id].novelty_score for r in rest)


def test_scored_batches_repeat(spark, tmpdir_path):
    """A retried batch replaces its output; a missing table holds nothing."""
    from sigspark.streaming import jobs
    d = _docs(spark, [(i, 1, "license", "text", None, None, "USA", "news", "u") for i in (1, 2)])
    k = spark.createDataFrame([(1, "license", 2, "c", True)], "keyword_id int, keyword string, level int, cluster string, active boolean")
    s = spark.createDataFrame([(1, "s", "news", 3)], "source_id int, source_name string, source_type string, trust_level int")
    run = jobs.score_batches(tmpdir_path + "/g", tmpdir_path + "/o", k, s, L.AS_OF)
    for epoch, ids in ((0, [1]), (1, [2]), (1, [2])):
        run(d.filter(F.col("document_id").isin(ids)), epoch)
    out = {r.document_id: r.kw_signals for r in spark.read.parquet(tmpdir_path + "/o").collect()}
    assert out == {1: 1, 2: 2} and spark.read.parquet(tmpdir_path + "/o").count() == 2
    assert jobs.new_against_table(d, tmpdir_path + "/none", "title", ["document_id"]).first().document_id == 1
    d.select("title").write.parquet(tmpdir_path + "/seen")
    assert jobs.new_against_table(d, tmpdir_path + "/seen", "title", ["document_id"]).count() == 0


def test_union_distinct_and_latest(spark):
    a = spark.createDataFrame([(1, "k1", "a")], "id int, k string, v string")
    b = spark.createDataFrame([(2, "k1", "b"), (3, "k2", "c")], "id int, k string, v string")
    got = {(r.k, r.v) for r in RL.union_distinct([a, b], ["k"], ["id"]).collect()}
    assert got == {("k1", "a"), ("k2", "c")}
    n = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "doc int, turn int, t string")
    assert {(r.doc, r.t) for r in RL.latest_per(n, ["doc"], "turn").collect()} == {(1, "y"), (2, "z")}


def test_upsert_and_delete(spark):
    from sigspark import sinks as K
    tgt = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    upd = spark.createDataFrame([("b", 5.0, 1), ("b", 6.0, 2), ("c", 7.0, 1)], "k string, v double, o int")
    got = {(r.k, r.v) for r in K.upsert(tgt, upd, ["k"], "o").collect()}
    assert got == {("a", 1.0), ("b", 6.0), ("c", 7.0)}
    assert K.delete_keys(tgt, spark.createDataFrame([("a",)], "k string"), "k").count() == 1


def test_overwrite_day_is_idempotent(spark, tmpdir_path):
    from sigspark import sinks as K
    p = os.path.join(tmpdir_path, "flows")
    day = spark.createDataFrame([("2024-01-01", "C1", 3)], "date string, origin string, n int")
    K.overwrite_day(day, p)
    K.overwrite_day(day, p)
    other = spark.createDataFrame([("2024-01-02", "C2", 1)], "date string, origin string, n int")
    K.overwrite_day(other, p)
    assert spark.read.parquet(p).count() == 2


def test_stream_tagging_equals_batch(spark, tmpdir_path):
    """X1 + X3: a drained stream gives the batch result."""
    from sigspark.streaming import jobs
    src = os.path.join(tmpdir_path, "landed")
    docs = spark.createDataFrame([(1, 0, "the license", "x", "news"), (2, 0, "keit und", "y", "law"),
                                  (3, 0, "none", "z", None)],
                                 "document_id long, source_id int, title string, full_text string, document_type string")
    docs.write.parquet(src)
    k = spark.createDataFrame([(4, "license", 2, "c", True), (8, "keit", 3, "e", True)],
                              "keyword_id int, keyword string, level int, cluster string, active boolean")
    s = spark.createDataFrame([(0, "news")], "source_id int, source_type string")
    batch = {tuple(r) for r in jobs.tag_stream(spark.read.parquet(src), k, s).collect()}
    out = os.path.join(tmpdir_path, "out")
    jobs.run_available(jobs.tag_stream(jobs.ingest_stream(spark, src, docs.schema), k, s), "tag-test", out)
    streamed = {tuple(r) for r in spark.read.parquet(out).collect()}
    assert streamed == batch and len(batch) == 2


def test_no_python_udf_in_flagship_plan(spark):
    from __spark_entry__ import entry
    plan = entry(spark)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "CartesianProduct" not in plan


def test_crosstab_works_its_rows_out_once(spark):
    from sigspark.operators import textstats as TS
    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row
    rows = [("x", "de"), ("x", "en"), ("x", "de"), ("y", None), (None, "en")]
    d = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(seen), "label string, lang string")
    got = {tuple(r) for r in TS.crosstab(d, "label", "lang").collect()}
    assert read.value == len(rows)
    assert {("x", "de", 2), ("x", "en", 1), ("y", "de", 0), ("y", "en", 0)} <= got and len(got) == 9


def test_default_label_in_a_single_look(spark):
    d = spark.createDataFrame([("a b",), ("zz",), (None,)], "t string")
    labels = C.classify_multi("t", [("A", ["a"]), ("B", ["b"])], "none")
    out = d.select("t", labels.alias("l"))
    assert {r.t: r.l for r in out.collect()} == {"a b": ["A", "B"], "zz": ["none"], None: ["none"]}
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("contains(") == 2


def test_a_text_is_matched_once(spark):
    """No filter on the hits repeats the matching below the matching."""
    from sigspark.bindings import lexicon_view
    d = _docs(spark, [(1, 0, "and attion of", "x", None, None, None, "news", None)])
    k = lexicon_view(spark, L.TEST_LEXICON + L.TEST_FUZZY_TERMS)
    for g in (TG.tag(d, k), TG.tag_exact(d, k), TG.tag_fuzzy(d, k)):
        plan = g._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("lower(concat_ws(") == 1


def test_fuzzy_budget_covers_every_length(spark):
    d = spark.range(1, 80).select(F.col("id").cast("int").alias("la")).crossJoin(
        spark.range(0, 400).select(F.col("id").cast("int").alias("lb")))
    for threshold in (50, 85, 99):
        share = 1.0 - threshold / 100.0
        own = F.floor(share * (F.col("la") + F.col("lb")) + 1e-9).cast("int")
        fits = d.filter(F.abs(F.col("la") - F.col("lb")) <= own)  # else no ratio reaches the threshold
        assert fits.filter(own > T.fuzzy_budget(F.col("la"), threshold)).count() == 0


@pytest.mark.parametrize("ids", [range(10), [0], [5, None, 6, 7, 7], range(0, 1000, 7), []])
def test_batches_land_by_bounds_of_their_key(spark, tmpdir_path, ids, monkeypatch):
    """Each row lands in the batch floor(id * 3 / (max + 1)); a scan may take the bounds."""
    from sigspark.plans import streams
    landed, path = [], os.path.join(tmpdir_path, "landed")

    def drained(_stream, _name, foreach_batch=None):
        landed.append(sorted(r.id for r in spark.read.schema("id long").parquet(path).collect()))
    monkeypatch.setattr(streams.jobs, "run_available", drained)
    spark.createDataFrame([(i,) for i in ids], "id long").write.mode("overwrite").parquet(path + "-in")
    rows = spark.read.parquet(path + "-in")
    monkeypatch.setattr(type(rows), "crossJoin", None)  # bounds of a joined row would not reach the scan
    streams._landed(rows, "none", path, "id")
    known = [i for i in ids if i is not None]
    assert landed == [sorted(i for i in known if i * 3 // (max(known) + 1) <= k) for k in range(3)]
    plan = rows.filter((F.col("id") >= 0) & (F.col("id") < 4))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,0)" in plan


def test_windows_are_cut_from_the_text(spark):
    """Windows are those of the words, whatever stands between them, and no array of words is built for them."""
    from sigspark.bindings import lexicon_view
    texts = ["", " ", "one two", "\n one\ttwo \r\n three\x0bfour  five\x0csix seven ", "and  attion\nof x all rights\treservd",
             "x and attion of", "all rights reserved and\n\nattion  of", "größe 😀 😀 and attion oof   all"]
    kws = ["and attion to", "all rights reserved too", "größe 😀 😀"]
    d = _docs(spark, [(i, 0, "", t, None, None, None, "news", None) for i, t in enumerate(texts)])
    k = lexicon_view(spark, [(i, w, 1, "a") for i, w in enumerate(kws)])
    got = TG.tag_fuzzy(d, k)
    assert "array_join(" not in got._jdf.queryExecution().optimizedPlan().toString()

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
            row = new
        return row[-1]
    want = {}
    for i, t in enumerate(texts):
        for n, w in enumerate(kws):
            ws, m = [x for x in re.split(r"[ \t\n\x0b\f\r]+", t.lower()) if x], len(w.split())
            if w not in " " + t.lower():
                for s in range(0, len(ws) - m + 1, m):
                    c = " ".join(ws[s:s + m])
                    ratio = 200.0 * lcs(w, c) / (len(w) + len(c))
                    if ratio >= 85:
                        want[i, n] = ratio / 100 * 7
                        break
    assert {(r.document_id, r.keyword_id): pytest.approx(r.match_score) for r in got.collect()} == want and len(want) >= 2


@pytest.mark.parametrize("threshold", [50, 85, 99])
def test_a_window_that_reaches_the_threshold_holds_a_part(spark, threshold):
    r = random.Random(threshold)
    terms = ["a b c", "and attion to", "all rights reserved", "größe der straße 😀 und mehr"]
    pairs = []
    for _ in range(3000):
        w = list(kw := r.choice(terms))
        for _ in range(r.randrange(len(kw))):
            at = r.randrange(len(w) + 1)
            w[at:at + r.randrange(2)] = r.choice(["", *kw])
        pairs.append((kw, "".join(w)))
    k = spark.createDataFrame([(i, w, 1, "a", True) for i, w in enumerate(terms)],
                              "keyword_id int, keyword string, level int, cluster string, active boolean")
    t = TG.lexicon_row(k, threshold).select(F.explode("terms").alias("t"))
    d = spark.createDataFrame(pairs, "kw string, c string").join(F.broadcast(t), F.col("kw") == F.col("t.kw"))
    kept = F.size(TG.fitting(F.array("c"), F.col("kw"), F.col("t.fit"))) == 1
    good = d.filter(T.indel_ratio("kw", "c") >= threshold)
    assert good.count() > 100 and good.filter(~kept).count() == 0
    assert d.filter(kept & ~T.fuzzy_possible("kw", "c", threshold)).count() == 0


def test_texts_are_matched_by_short_scans(spark, monkeypatch):
    from sigspark.plans import streams
    from sigspark.session import short_scans
    key, seen = "spark.sql.files.maxPartitionBytes", []
    before = spark.conf.get(key)
    monkeypatch.setattr(streams.jobs, "run_available", lambda *a, **b: seen.append(spark.conf.get(key)))
    streams._scored_stream(spark, "/root/testdata/sf0.001")
    with short_scans(spark, "1m"):
        with short_scans(spark):
            seen.append(spark.conf.get(key))
    assert seen == ["16m", "1m"] and spark.conf.get(key) == before
