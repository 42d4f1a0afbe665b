"""Fixed values.

Everything in this module is data that results depend on (word lists, lookup
tables, thresholds, patterns, formats, message texts).  It is stated as plain
text in natural order; no processing logic lives here.
"""

# --- fixed values: identity -------------------------------------------------
FUZZY_THRESHOLD = 0.85
# Shares of title and company in the weighted similarity of two postings.
DUPLICATE_WEIGHTS = (0.6, 0.4)
DEFAULT_COMPANY = "Unbekannt"
UNKNOWN_COMPANY_LABEL = "Unknown"
IN_APPLICATION_STATUSES = ["applying", "applied", "interview", "offer"]
NOT_SCORED_STATUSES = ["expired", "ignored"]

# --- fixed values: order in which sources are fetched -----------------------
SOURCE_ORDER = [
    "service_bund",
    "arbeitsagentur",
    "interamt",
    "arbeitnow",
    "stellenmarkt",
    "adzuna",
    "jooble",
    "jobboerse",
    "kimeta",
]

# --- fixed values: character classes (Java regex) ---------------------------
# Whitespace as Python's str.isspace / re \s sees it.
WS = r"[\s\p{Z}\x1c-\x1f\x85]"
# Everything that is neither a word character nor whitespace.
NON_WORD = r"[^\p{L}\p{N}_\s\p{Z}\x1c-\x1f\x85]"

# --- fixed values: German federal states ------------------------------------
FEDERAL_STATES = [
    "Baden-Württemberg",
    "Bayern",
    "Berlin",
    "Brandenburg",
    "Bremen",
    "Hamburg",
    "Hessen",
    "Mecklenburg-Vorpommern",
    "Niedersachsen",
    "Nordrhein-Westfalen",
    "Rheinland-Pfalz",
    "Saarland",
    "Sachsen",
    "Sachsen-Anhalt",
    "Schleswig-Holstein",
    "Thüringen",
]

# --- fixed values: work-model keywords --------------------------------------
REMOTE_KEYWORDS = [
    "100% remote",
    "vollständig remote",
    "deutschlandweit",
    "bundesweit",
    "homeoffice",
    "home office",
    "remote",
]
HYBRID_KEYWORDS = [
    "tage vor ort",
    "tage im büro",
    "2-3 tage",
    "teilweise homeoffice",
    "teilweise remote",
    "flexible arbeitsort",
    "hybrid",
]
ONSITE_KEYWORDS = [
    "in unserem büro",
    "am standort",
    "on-site",
    "präsenz",
    "vor ort",
]

# --- fixed values: office days per week -------------------------------------
HYBRID_RANGE = r"(?iu)(\d)\s*[-–]\s*(\d)\s*Tage?\s*(pro\s+Woche|/\s*Woche|wöchentlich)"
HYBRID_SINGLE = r"(?iu)(\d)\s*Tage?\s*(pro\s+Woche|/\s*Woche|im\s+Büro)"
HYBRID_PER_WEEK = r"(?iu)(\d)x\s*/?s*Woche"

# --- fixed values: work-model weights and score -----------------------------
WEIGHT_REMOTE = 0.0
WEIGHT_HYBRID_1 = 0.2
WEIGHT_HYBRID_2_3 = 0.5
WEIGHT_HYBRID_4_5 = 0.8
WEIGHT_ONSITE = 1.0
WEIGHT_UNKNOWN = 0.6
MAX_COMMUTE_MINUTES = 60
SCORE_WITHOUT_MINUTES = 0.5
HOME_ADDRESS = "Frankfurt, Germany"
DEPARTURE_TIME = "08:00"
DEPARTURE_WEEKDAY = "tuesday"
TRANSIT_TTL_DAYS = 90

# --- fixed values: search settings ------------------------------------------
TARGET_LOCATIONS = ["Frankfurt", "Wiesbaden", "Darmstadt", "Remote"]
MAX_AGE_DAYS = 2

# --- fixed values: source names and types -----------------------------------
SOURCE_TYPES = {
    "service_bund": "portal",
    "stellenmarkt": "aggregator",
    "arbeitsagentur": "portal",
    "arbeitnow": "aggregator",
    "adzuna": "aggregator",
    "jooble": "aggregator",
    "kimeta": "aggregator",
    "jobboerse": "portal",
    "interamt": "portal",
}
SECTOR_PUBLIC = "public"
SECTOR_PUBLIC_LABEL = "Öffentlicher Dienst"
PUBLIC_SECTOR_VALUES = ["public", "öffentlicher dienst"]

# --- fixed values: labelled feed fields -------------------------------------
FEED_EMPLOYER = r"(?i)Arbeitgeber:\s*<strong>(.*?)</strong>"
FEED_PLACE = r"(?i)Ort:\s*<strong>(.*?)</strong>"
FEED_DEADLINE = r"(?i)Bewerbungsfrist:\s*<strong>(.*?)</strong>"
FEED_ID = r"(?i)-(\d+)\.html$"

# --- fixed values: category feeds, in fetch order ---------------------------
CATEGORY_FEEDS = [
    "consulting",
    "einkauf",
    "finanzen",
    "produktion",
    "ingenieure",
    "it",
    "bildung",
    "marketing",
    "medizin",
    "personal",
    "recht",
    "vertrieb",
    "sonstige",
    "verwaltung",
    "design",
]

# --- fixed values: URLs -----------------------------------------------------
AGENCY_JOB_URL = "https://www.arbeitsagentur.de/jobsuche/jobdetail/{id}"
LISTING_BASE_URL = "https://www.xn--jobbrse-d1a.de"
LISTING_URL_PATTERN = r"/stellenanzeige/(\d+)/"
TABLE_JOB_URL = "https://interamt.de/koop/app/stelle?id={id}"
DETAIL_FRAME_PREFIX = "https://www.kimeta.de/iframe/"
IMPRINT_PATHS = ["/impressum", "/imprint", "/about/impressum"]

# --- fixed values: detail-page selectors, in order of preference ------------
LISTING_SELECTORS = [".stellenbeschreibung", ".job-description", ".description", "article", "main"]
TABLE_SELECTORS = [
    ".ia-e-stellenangebot__beschreibung",
    ".ia-e-detail",
    ".ia-e-content",
    "main",
    "article",
]
ENCODED_SELECTORS = [".job-description", ".description", "article", "main"]
MIN_MAIN_TEXT = 100

# --- fixed values: imprint address ------------------------------------------
IMPRINT_PLACE = r"(\d{5})\s+([A-ZÄÖÜ][a-zäöüß]+(?:\s+[a-zäöüß]+)*(?:\s+am\s+[\p{L}\p{N}_]+)?)"
IMPRINT_STREET = (
    r"([A-ZÄÖÜ][a-zäöüß]+(?:straße|str\.|weg|platz|allee|gasse|ring|damm|ufer)\s*\d+\s*[a-zA-Z]?)"
)

# --- fixed values: RFC 2822 zone names --------------------------------------
ZONE_OFFSETS = {
    "UT": "+0000",
    "UTC": "+0000",
    "GMT": "+0000",
    "Z": "+0000",
    "EST": "-0500",
    "EDT": "-0400",
    "CST": "-0600",
    "CDT": "-0500",
    "MST": "-0700",
    "MDT": "-0600",
    "PST": "-0800",
    "PDT": "-0700",
}

# --- fixed values: report texts ---------------------------------------------
MSG_LOCATION = (
    "%.1f%% der Jobs ohne Location. Quellen ohne vollständige Location: %s. "
    "Extraktion aus raw_text empfohlen."
)
MSG_LOCATION_SOURCE = "Quelle '%s' liefert keine Locations. Parser oder Scraper anpassen."
MSG_WORK_MODEL = "Work-Model-Erkennung aus raw_text implementieren (detect_work_model_from_text)"
MSG_TEXT = "Quellen %s liefern keinen Volltext. Detail-Fetching verbessern."
MSG_TEXT_SOURCE = "Quelle '%s' liefert keinen Volltext."
MSG_SALARY = "Gehaltsdaten spärlich (%.1f%%). Ggf. Salary-Extraktion aus Volltext."
MSG_ADDRESS = "Firmen-Adressen fast vollständig unaufgelöst. Location Pipeline implementieren."
TEXT_NULL = "NULL"
TEXT_EMPTY = "leer"
TEXT_SHORT = "sehr_kurz (<50)"
TEXT_OK = "ok"
TEXT_TOTAL = "GESAMT"
SHORT_TEXT_CHARS = 50
TOP_LOCATIONS = 20
COVERAGE_WEEKS = 12

# --- fixed values: recommendation thresholds (percent) ----------------------
LOCATION_HIGH = 90.0
LOCATION_MEDIUM = 95.0
WORK_MODEL_HIGH = 50.0
WORK_MODEL_MEDIUM = 20.0
TEXT_HIGH = 80.0
TEXT_MEDIUM = 95.0
SALARY_LOW = 20.0
ADDRESS_HIGH = 90.0
COVERAGE_WARN = 50.0

# --- fixed values: design-document weights ----------------------------------
# skills, level, domain, location, potential in percent
DIMENSION_WEIGHTS = {
    "skills": 35,
    "level": 25,
    "domain": 20,
    "location": 15,
    "potential": 5,
}
