"""Dictionaries and constants.

Everything in the "fixed values" blocks must equal the studied system's
values for results to agree (weights, thresholds, ordered dictionaries).
They are stated once, here, in their natural order. Operators receive them
as arguments, so a caller can pass its own.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Scoring and tagging constants
# ---------------------------------------------------------------------------
FUZZY_THRESHOLD = 85
EXACT_HEAD_CHARS = 200          # a hit inside this prefix scores higher
EXACT_HEAD_SCORE = 9.5
EXACT_BODY_SCORE = 8.0
FUZZY_MIN_TERM_WORDS = 3
FUZZY_SCALE = 7.0

# Country aliases (lower-case alias -> canonical name)
COUNTRY_ALIASES = {
    "united states": "USA", "us": "USA", "u.s.": "USA", "america": "USA",
    "united kingdom": "UK", "uk": "UK", "england": "UK", "britain": "UK",
    "people's republic of china": "China", "prc": "China", "cn": "China",
    "federal republic of germany": "Germany", "deutschland": "Germany",
    "brd": "Germany", "de": "Germany",
    "republic of korea": "South Korea", "south korea": "South Korea",
    "republic of india": "India",
}

# Document-type terms per flag (tested against the lower-cased type)
DOC_TYPE_FLAGS = {
    "regulatory": ["guidance", "regulation", "directive", "act", "law"],
    "parliamentary": [],
}

# Keyword level -> flag set by a match; clusters setting is_diga
LEVEL_FLAGS = {2: "is_regulatory", 3: "is_neuro", 4: "is_lmic", 5: "is_reimbursement"}
DIGA_CLUSTERS = ("diga", "dipa")
FLAG_NAMES = ("is_regulatory", "is_scientific", "is_neuro", "is_lmic",
              "is_parliamentary", "is_reimbursement", "is_diga")

# Impact score per document type, first contained entry wins
DOC_TYPE_IMPACT = [
    ("Gesetzentwurf", 10.0),
    ("Beschlussempfehlung", 9.5),
    ("Richtlinie", 9.0),
    ("guidance", 8.5),
    ("final_rule", 9.0),
    ("regulation", 9.0),
    ("G-BA Beschluss", 9.0),
    ("G-BA Nutzenbewertung", 8.5),
    ("law", 9.5),
    ("clinical_trial", 7.0),
    ("journal_article", 5.0),
    ("policy_update", 6.0),
    ("news", 3.0),
    ("hta_report", 7.5),
    ("Drucksache (Antrag)", 6.0),
    ("Drucksache (Kleine Anfrage)", 5.5),
    ("Drucksache (Große Anfrage)", 7.0),
    ("Drucksache (Unterrichtung)", 5.0),
]
DEFAULT_TYPE_IMPACT = 4.0

# Priority countries (relevance / strategic geography weight)
PRIORITY_COUNTRIES = {
    "Germany": 1.0, "USA": 1.0, "EU": 1.0,
    "China": 0.9, "Israel": 0.9,
    "UK": 0.8, "France": 0.8, "Italy": 0.8,
    "Japan": 0.7, "South Korea": 0.7, "Singapore": 0.7, "India": 0.7,
}
DEFAULT_GEO_RELEVANCE = 0.3
DEFAULT_GEO_NEED = 3.0          # strategic default (x10 -> 30, see README)
WIDE_COVERAGE = ("EU", "International", "Global")

# Focus score by keyword level (else 5.0)
FOCUS_BY_LEVEL = {1: 6.0, 2: 8.0, 3: 9.0, 4: 7.0, 5: 9.5}
DEFAULT_FOCUS = 5.0

# Strategic weights
STRATEGIC_WEIGHTS = {
    "regulatory": 0.35,
    "scientific": 0.25,
    "market_trend": 0.20,
    "country_need": 0.20,
}
LMIC_NEED = 8.0

# Urgency thresholds, highest first
URGENCY = [(8.0, "immediate"), (6.0, "short_term"), (4.0, "medium_term")]
URGENCY_DEFAULT = "informational"

# Alert selection
ALERT_MIN_SCORE = 6.0
ALERT_IMMEDIATE = 8.0
ALERT_LOOKBACK_HOURS = 12
ALERT_MAX = 20

# Novelty rarity steps (count <= bound -> points)
RARITY_STEPS = [(3, 3.0), (10, 2.0), (30, 1.0)]
NOVELTY_RECENT_DAYS = 30
NOVELTY_FIRST_POINTS = 2.5
NOVELTY_NEW_SOURCE_POINTS = 1.5

# Terms in a parliamentary paper that set a further flag
PAPER_DIGA_TERMS = ["diga", "digitale gesundheit", "telemedizin", "epa", "gematik",
                    "gesundheitsdaten", "e-health"]
PAPER_REIMBURSEMENT_TERMS = ["erstattung", "nutzenbewertung", "amnog", "krankenversicherung",
                             "sgb v", "leistung"]

# ---------------------------------------------------------------------------
# Test lexicon bound to the driver's synthetic documents (see FIXTURES.md §3).
# The prose is invented, so real health terms never hit; these terms do.
# (keyword_id, keyword, level, cluster)
# ---------------------------------------------------------------------------
TEST_LEXICON = [
    (1, "the of", 1, "a"),
    (2, "that", 1, "a"),
    (3, "token", 1, "b"),
    (4, "license", 2, "c"),
    (5, "apache", 2, "c"),
    (6, "mit license", 2, "d"),
    (7, "all rights reserved", 2, "d"),
    (8, "keit", 3, "e"),
    (9, "para", 4, "f"),
    (10, "pour", 5, "diga"),
    (11, "and attion to", 5, "g"),
    (12, "als", 3, "h"),
]

# Terms that only match fuzzily (three or more words) plus one negative.
TEST_FUZZY_TERMS = [
    (101, "and attion of", 1, "fz"),
    (102, "attion to thanedbles", 2, "fz"),
    (103, "onblea of anon", 3, "fz"),
    (104, "esndha redes ha", 4, "fz"),
    (105, "released under mit license", 2, "fz"),
]

AS_OF = "2025-01-01 00:00:00"

# Driver-binding dictionaries (deterministic derivation of the document view)
TEST_COUNTRIES = ["Germany", "USA", "EU", "China", "UK", "Italy", "India",
                  "Kenya", None, "Deutschland"]
TEST_DOC_TYPES = ["clinical_trial", "journal_article", "Drucksache (Gesetzentwurf)",
                  "regulatory_update", "news", "hta_report", "G-BA Richtlinie",
                  "cyber_alert"]
TEST_SOURCE_TYPES = ["regulatory", "scientific", "trends", "news", "telecom",
                     "parliamentary", "hta"]
TEST_REGIONS = ["Europe", "North America", "Asia", "Middle East", "Global"]

# Test dictionaries for the classification operators on the driver's
# invented prose (ordered; label -> contained terms).
TEST_TOPICS = [
    ("English prose", ["that", "with"]),
    ("German prose", ["keit", "sich", "und "]),
    ("French prose", ["pour", "elle", "que "]),
    ("Spanish prose", ["para ", "los "]),
    ("Licensing", ["license", "apache", "rights reserved"]),
    ("Credentials", ["token", "@"]),
]
TEST_TOPIC_DEFAULT = "General"

TEST_ENTITIES = {
    "ther": "Thera", "orre": "Orrestad", "keit": "Keitburg", "pour": "Pourville",
    "los ": "Los Altos", "elle": "Elle (region)", "sich": "Sichheim", "rewh": "Rewh (region)",
}
TEST_ENTITY_GROUPS = {"Thera": "North", "Orrestad": "North", "Keitburg": "East",
                      "Pourville": "West"}
TEST_THREATS = [
    ("Licence", ["license", "apache"]),
    ("Identity", ["token", "@"]),
    ("Germanic", ["keit", "sch"]),
    ("Romance", ["que", "para"]),
]
TEST_THREAT_DEFAULT = "Other"
TEST_POST_TYPES = [("Mobile", ["://m."]), ("Paged", ["page="]), ("Anchored", ["#top"]),
                   ("Secure", ["https"])]
TEST_POST_DEFAULT = "Post"
STOP_WORDS = ["the", "and", "for", "that", "with", "this", "from", "are", "was", "but",
              "not", "you", "all", "any", "can", "has", "have", "our", "out"]
