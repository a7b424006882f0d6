"""Values every result depends on: word lists, weights, thresholds, formats.

Everything in this module is a fixed value of the domain (not logic).  The rest of the package turns these
values into Column expressions, so changing a rule means changing data here or passing another set in.
"""

# --- fixed values: text normalisation ---------------------------------------------------------------------------
TITLE_STOP_WORDS = ["the", "a", "an", "at", "of", "and", "&", "live", "in", "presents", "official"]
UNKNOWN_TIME_WORDS = ["tbc", "tba", "tbd", "unknown", ""]
PLACEHOLDER_VENUES = ["tbd", "tba", "tbc", "venue tbc", "to be confirmed"]
STATUS_WORDS = {
    "onsale": "SCHEDULED", "scheduled": "SCHEDULED", "eventscheduled": "SCHEDULED", "live": "SCHEDULED",
    "offsale": "SCHEDULED", "cancelled": "CANCELLED", "canceled": "CANCELLED", "eventcancelled": "CANCELLED",
    "postponed": "POSTPONED", "eventpostponed": "POSTPONED", "rescheduled": "RESCHEDULED",
    "eventrescheduled": "RESCHEDULED", "movedonline": "SCHEDULED", "completed": "COMPLETED",
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
LOCAL_ZONE = "Europe/London"

# --- fixed values: statuses, confidence, levels -----------------------------------------------------------------
ACTIVE_STATUSES = ["SCHEDULED", "RESCHEDULED", "CONFIRMED", "SOLD_OUT"]
LISTING_STATUSES = ["SCHEDULED", "RESCHEDULED"]
DEAD_STATUSES = ["CANCELLED", "POSTPONED", "COMPLETED"]
CONFIDENCE_RANK = {"OFFICIAL": 4, "CURATED": 3, "TRUSTED": 3, "SECONDARY": 2, "UNVERIFIED": 1}
QUALITY_RANK = {"LOW": 0, "MEDIUM": 1, "HIGH": 2}
OPEN_ACTION_STATUSES = ["NEW", "PLANNED", "SCHEDULED", "IN_PROGRESS"]
DEFAULT_SERVICE_AREA = ["London", "Manchester", "Birmingham", "Leeds", "Liverpool"]

# --- fixed values: validation -----------------------------------------------------------------------------------
MIN_TITLE_CHARS = 3
MAX_PAST_DAYS = 2
MAX_FUTURE_DAYS = 400
NON_EVENT_TITLE_PATTERNS = [
    "to be announced v", "v to be announced", "tbc v tbc", "pre-order", "refundable", "deposit", "gift voucher",
    "gift card", "membership", "season announcement", "secret seats", "car park", "parking", "donation",
]

# --- fixed values: keyword classifier, in rule order ------------------------------------------------------------
CATEGORY_RULES = [
    ("sports", "ice_hockey", ["ice hockey", "manchester storm", "sheffield steelers", "nottingham panthers", "cardiff devils",
                              "belfast giants", "glasgow clan", "guildford flames", "coventry blaze", "dundee stars", "fife flyers"]),
    ("sports", "football", [" v ", " vs ", "premier league", "championship", "fa cup", "football", "efl", "league one", "league two"]),
    ("sports", "rugby", ["rugby", "premiership rugby", "six nations"]),
    ("sports", "cricket", ["cricket", "t20", "the hundred", "test match"]),
    ("sports", "horse_racing", ["horse_racing", "horse racing", "racecourse", "raceday", "race day", "race night", "racing",
                                "the april meeting", "festival trials day", "cheltenham festival", "grand national", "the derby",
                                "guineas", "royal ascot"]),
    ("sports", "other", ["sportsevent", "boxing", "ufc", "wrestling", "darts", "snooker", "tennis", "athletics", "marathon",
                         "motorsport", "grand prix", "horse racing", "racecourse", "ice hockey", "hockey", "laver cup", "davis cup",
                         "netball", "basketball", "gymnastics", "swimming championships"]),
    ("community", "tour", ["guided tour", "walking tour", "tour of", "trail", "heritage open", "open day", "open days"]),
    ("music", "concert", ["musicevent", "concert", "live music", " tour ", " tour:", "gig", "in concert", "orchestra", "symphony",
                          "philharmonic", "live at", "world tour", "arena tour"]),
    ("music", "festival", ["music festival", "festival stage"]),
    ("education", "university", ["freshers", "fresher's", "graduation", "open day", "university", "matriculation", "convocation"]),
    ("education", "school", ["school concert", "school play", "prom night", "school"]),
    ("festival", "food", ["food festival", "street food", "beer festival", "wine festival"]),
    ("festival", "general", ["festival", "carnival", "fair", "fireworks", "bonfire", "parade", "christmas market"]),
    ("theatre", "show", ["theatre", "theater", "musical", "west end", "ballet", "opera", "pantomime", "play"]),
    ("comedy", "standup", ["comedy", "comedian", "stand-up", "stand up"]),
    ("conference", "business", ["conference", "expo", "summit", "exhibition", "trade show", "convention", "comic con",
                                "wedding show", "wedding fair", "careers fair", "jobs fair"]),
    ("nightlife", "club", ["club night", "dj set", "rave", "nightclub"]),
    ("family", "attraction", ["family", "kids", "disney on ice", "circus", "half term", "half-term", "toddler", "baby show",
                              "cbeebies", "peppa pig", "bluey"]),
    ("arts", "exhibition", ["exhibition", "gallery", "museum", "art show", "painting", "drawing", "sculpture", "photography"]),
    ("community", "market", ["market", "fair", "fete", "car boot", "craft"]),
    ("community", "talk", ["talk", "lecture", "workshop", "class", "course", "seminar", "book club", "reading group"]),
    ("community", "general", ["community", "charity", "fundrais", "volunteer", "parade", "fireworks", "bonfire", "christmas lights",
                              "carnival", "christmas party", "celebrate christmas", "party night", "afternoon tea", "sunday lunch"]),
]
DEFAULT_CATEGORY = ("other", "general")
WEAK_HINT_PREFIX = "fallback:"
HINT_CONFIDENCE, TITLE_CONFIDENCE, TEXT_CONFIDENCE, WEAK_CONFIDENCE, DEFAULT_CONFIDENCE = 1.0, 0.9, 0.6, 0.5, 0.3
CATEGORY_FACTORS = {
    "music": 1.0, "sports": 0.95, "festival": 0.85, "nightlife": 0.8, "theatre": 0.7, "comedy": 0.65, "education": 0.6,
    "conference": 0.55, "family": 0.5, "arts": 0.4, "community": 0.35, "other": 0.3,
}
DEFAULT_CATEGORY_FACTOR = 0.3

# --- fixed values: demand score ---------------------------------------------------------------------------------
SCORE_WEIGHTS = {"event_scale": 20, "venue_scale": 20, "timing": 15, "location": 15, "transport": 10, "category": 10,
                 "tourism": 5, "duration": 5}
DEMAND_LEVELS = [("VERY_HIGH", 80), ("HIGH", 65), ("MEDIUM", 50), ("MODERATE", 35), ("LOW", 0)]
MARKETING_PRIORITIES = [("P1", 80), ("P2", 65), ("P3", 50)]
CAPACITY_BANDS = [(50000, 1.0), (30000, 0.82), (15000, 0.62), (8000, 0.45), (3000, 0.3), (1000, 0.2), (0, 0.1)]
FILL_RATES = {"sports": 0.9, "music": 0.85, "festival": 0.7, "theatre": 0.75, "comedy": 0.7, "education": 0.6,
              "conference": 0.5, "nightlife": 0.7, "family": 0.6, "other": 0.4}
DEFAULT_FILL_RATE = 0.5
EVENING_HOUR, NOON_HOUR, LATE_FINISH_HOUR = 17, 12, 22
WEEKEND_BONUS, FRIDAY_BONUS, LATE_BONUS, UNKNOWN_TIME_FACTOR = 0.25, 0.15, 0.15, 0.5
PRE_EVENT_MINUTES, POST_EVENT_MINUTES, PEAK_MINUTES = 180, 150, 20
DEFAULT_DURATION_HOURS = {"sports": 2.25, "music": 3.0, "festival": 8.0, "theatre": 2.5, "comedy": 2.0, "education": 4.0,
                          "conference": 8.0, "nightlife": 5.0, "family": 2.0, "other": 3.0}
FALLBACK_DURATION_HOURS = 3.0

# --- fixed values: quality, freshness, status -------------------------------------------------------------------
CONFIDENCE_POINTS = {"OFFICIAL": 40, "TRUSTED": 32, "SECONDARY": 20, "UNVERIFIED": 8, "CURATED": 30}
QUALITY_POINTS = {"has_time": 12, "has_venue_matched": 12, "has_venue_named": 6, "has_city": 8, "has_official_url": 8,
                  "has_postcode_or_coords": 5, "category_classified": 5, "multi_source_bonus": 10,
                  "school_event_penalty": -20, "stale_penalty": -15}
QUALITY_LEVELS = [("HIGH", 75), ("MEDIUM", 45), ("LOW", 0)]
STALE_BELOW = 40
DECAY_DAYS, FRESHNESS_FLOOR, SILENT_AFTER_DAYS = 14, 10, 21
CONFIRM_SOURCES = 2
CANCELLED_KEYWORDS = ["cancelled", "canceled", "called off", "abandoned"]
POSTPONED_KEYWORDS = ["postponed", "new date tbc", "date tbc"]
RESCHEDULED_KEYWORDS = ["rescheduled", "new date"]

# --- fixed values: opportunities and actions --------------------------------------------------------------------
OPPORTUNITY_MIN_SCORE = 35
OPPORTUNITY_WEIGHTS = {"demand": 55, "quality": 20, "freshness": 10, "service_area": 15}
OPPORTUNITY_FACTORS = {"HOME_TO_VENUE": 0.9, "VENUE_TO_HOME": 1.0, "STATION_TO_VENUE": 0.75, "VENUE_TO_STATION": 0.75,
                       "HOTEL_TO_VENUE": 0.65, "VENUE_TO_HOTEL": 0.65, "AIRPORT_TO_VENUE": 0.6, "VENUE_TO_AIRPORT": 0.55,
                       "LATE_NIGHT_RETURN": 0.95, "PRE_BOOKING": 0.8}
UNKNOWN_FRESHNESS = 50
HOTEL_MIN_TOURISM, AIRPORT_MAX_KM, LATE_START_HOUR = 0.5, 20, 18
GATE_MIN_SCORE, GATE_MIN_LEVEL, GATE_MIN_DAYS, GATE_MAX_DAYS = 65, "MEDIUM", 0, 30
PARTNERSHIP_MIN_CAPACITY, PARTNERSHIP_MIN_SCORE = 15000, 70

# --- fixed values: duplicate confidence -------------------------------------------------------------------------
MERGE_THRESHOLD = 0.88
TITLE_WEIGHT, VENUE_WEIGHT, CITY_WEIGHT = 0.6, 0.25, 0.15
UNKNOWN_VENUE_SIMILARITY, OTHER_CITY_SIMILARITY = 0.5, 0.3
SAME_TITLE_RATIO = 80
VENUE_FUZZY_RATIO, CITY_FUZZY_RATIO = 90, 88
SESSION_GAP_MINUTES, SAME_SOURCE_GAP_MINUTES = 120, 1

# --- fixed values: bookings -------------------------------------------------------------------------------------
BOOKING_FIELDS = ["booking_id", "booking_created_at", "pickup_datetime", "dropoff_datetime", "pickup_postcode", "dropoff_postcode",
                  "pickup_lat", "pickup_lon", "dropoff_lat", "dropoff_lon", "fare", "status", "vehicle_type"]
RADIUS_KM, PRE_MINUTES, AFTER_MINUTES, EVENT_MINUTES = 1.0, 180, 240, 150
DROPOFF_LATEST_MINUTES = 30
MIN_LABELLED_EVENTS, MIN_CATEGORY_SAMPLE = 200, 10
EARTH_RADIUS_KM, KM_PER_DEGREE = 6371.0, 111.0

# --- fixed values: coverage and health --------------------------------------------------------------------------
HORIZON_DAYS = [("today", 0), ("7d", 7), ("30d", 30), ("90d", 90)]
TARGET_WEIGHTS = {"source": 3.0, "venue": 1.0, "council": 1.0, "tourism": 1.0, "university": 0.5, "college": 0.25, "school": 0.25}
HEALTH_RUNS, HEALTH_RECENT, HEALTH_SILENT_DAYS, HEALTH_AVERAGE_DAYS = 20, 3, 3, 7
REGRESSION_MIN_EVENTS, REGRESSION_RATIO = 10, 0.5
STALE_RUN_HOURS, FRESH_RUN_HOURS = 3, 26
RETENTION_DAYS = {"raw_event": 30, "event_snapshot": 180, "run_log": 60, "run": 365}

# --- fixed values: landed page shapes ---------------------------------------------------------------------------
LD_JSON_SCRIPT = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
FEED_START = r"^\s*(?:<\?[^>]*>|<!--(?s:.*?)-->|<![^>]*>|\s)*(?:<rss\b|<feed\b|<rdf:RDF\b)"
FEED_LINK = r"(?i)<link\b(?=[^>]*\btype\s*=\s*[\x22'](?:application/(?:rss|atom)\+xml|text/calendar))[^>]*\bhref\s*="
CALENDAR_LINK = r"(?i)\bhref\s*=\s*[\x22'][^\x22']+\.ics\b"
FREE_DATE = r"(\d{1,2}(?:st|nd|rd|th)?\s+\w+\s+\d{4}|\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4})"
LINK_HREF = r"href=[\"']([^\"'#?]+)"
EVENT_TYPES = ["Event", "MusicEvent", "SportsEvent", "Festival", "TheaterEvent", "EducationEvent", "BusinessEvent", "ComedyEvent",
               "ExhibitionEvent", "DanceEvent", "ScreeningEvent", "SocialEvent", "ChildrensEvent", "LiteraryEvent", "FoodEvent",
               "VisualArtsEvent"]
NESTED_EVENT_KEYS = ["@graph", "subEvent", "itemListElement", "mainEntity"]
BLOCKED_HOSTS = ["localhost", "localhost.localdomain", "metadata.google.internal", "instance-data"]
CATEGORY_SOURCES = {
    "sports": ["football_fixtures", "venue_pages", "ticketmaster"],
    "concerts": ["venue_pages", "ticketmaster", "jambase"],
    "music": ["venue_pages", "ticketmaster", "jambase"],
    "education": ["universities", "colleges", "schools", "curated"],
    "festivals": ["councils", "tourism", "ticketmaster"],
    "community": ["councils", "tourism"],
}
