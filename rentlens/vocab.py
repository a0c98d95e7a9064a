"""Vocabularies, thresholds and patterns used as parameter defaults.

Operators take these as arguments, so another market or site passes its own.
"""

# --- fixed values: cleaned property types (trimmed lower-case text -> name) ---
CLEAN_TYPES = {
    "flat": "Flat",
    "house": "House",
    "villa": "Villa",
    "twin villa": "Twin Villa",
    "link house": "Link House",
    "shophouse": "Shophouse",
    "condo": "Condo",
    "apartment": "Apartment",
}
CLEAN_TYPE_DEFAULT = "Other"

# --- fixed values: model property types and their aliases ---
MODEL_TYPES = [
    "Flat",
    "Flat House",
    "House",
    "Link Villa",
    "Room",
    "Shop",
    "Shophouse",
    "Single Villa",
    "Twin Villa",
    "Unclassified",
    "Villa",
]
MODEL_TYPE_DEFAULT = "Unclassified"
TRAIN_ALIASES = {
    "apartment": "Flat",
    "condo": "Flat",
    "link house": "House",
    "townhouse": "House",
    "other": "Unclassified",
}
SERVE_ALIASES = {
    "apartment": "Flat",
    "condo": "Flat",
    "flat": "Flat",
    "townhouse": "House",
    "link house": "House",
    "link villa": "Link Villa",
    "single villa": "Single Villa",
    "twin villa": "Twin Villa",
    "shophouse": "Shophouse",
    "shop house": "Shophouse",
    "shop": "Shop",
    "room": "Room",
    "house": "House",
    "villa": "Villa",
    "flat house": "Flat House",
    "unclassified": "Unclassified",
}

# --- fixed values: defaults (bedrooms, bathrooms, size) by property type ---
TYPE_DEFAULTS = {
    "Room": (1, 1, 25),
    "Flat": (2, 1, 55),
    "Flat House": (2, 2, 70),
    "House": (3, 3, 120),
    "Villa": (4, 4, 220),
    "Twin Villa": (4, 4, 180),
    "Single Villa": (5, 5, 280),
    "Link House": (3, 3, 110),
    "Link Villa": (3, 3, 120),
    "Townhouse": (3, 3, 140),
    "Shophouse": (3, 3, 130),
    "Condo": (2, 2, 75),
    "Apartment": (2, 2, 80),
}
OTHER_TYPE_DEFAULTS = (2, 2, 90)

# --- fixed values: furnishing keywords, matched as written, in priority order ---
FURNISHED_KEYWORDS = [
    ("Fully Furnished", [
        "មានសម្ភារៈស្រាប់", "មានគ្រឿងសង្ហារឹម",
        "fully furnished", "Fully Furnished",
    ]),
    ("Partly Furnished", [
        "មានសម្ភារៈខ្លះ", "partly furnished", "Partly Furnished",
        "semi furnished", "Semi Furnished",
    ]),
    ("Unfurnished", ["គ្មានសម្ភារៈ", "unfurnished", "Unfurnished", "un-furnished"]),
]
# --- fixed values: the same for the portal site ---
PORTAL_FURNISHED_KEYWORDS = [
    ("Fully Furnished", ["Fully Furnished", "fully furnished", "Fully furnished"]),
    ("Partly Furnished", ["Partly Furnished", "Semi Furnished", "partly furnished"]),
    ("Unfurnished", ["Unfurnished", "unfurnished"]),
]
FURNISHED_DEFAULT = "Unknown"
FURNISHED_YES = ["furnished", "fully furnished"]

# --- fixed values: attribute patterns for descriptions, first match wins ---
DESCRIPTION_PATTERNS = {
    "bedrooms": [
        r"បន្ទប់គេង\s*:?\s*(\d+)",
        r"(\d+)\s*បន្ទប់គេង",
        r"(?i)(\d+)\s*bed(?:room)?s?",
        r"(?i)bed(?:room)?s?\s*:?\s*(\d+)",
    ],
    "bathrooms": [
        r"បន្ទប់ទឹក\s*:?\s*(\d+)",
        r"(\d+)\s*បន្ទប់ទឹក",
        r"(?i)(\d+)\s*bath(?:room)?s?",
        r"(?i)bath(?:room)?s?\s*:?\s*(\d+)",
    ],
    "size_sqm": [
        r"(?i)(\d+\.?\d*\s*m\s*x\s*\d+\.?\d*\s*m)",
        r"(?i)(\d+\.?\d*\s*x\s*\d+\.?\d*\s*m)",
        r"(\d+\.?\d*\s*m²)",
    ],
}

# --- fixed values: attribute patterns for titles ---
TITLE_PATTERNS = {
    "bedrooms": [r"(?i)(\d+(?:\.\d+)?)\s*(?:bed|bedroom)s?"],
    "bathrooms": [r"(?i)(\d+(?:\.\d+)?)\s*(?:bath|bathroom|wc)s?"],
    "size_sqm": [r"(?i)(\d+(?:\.\d+)?)\s*(?:m2|m²|sqm|sq\.?m)"],
}
DIMENSIONS_PATTERN = r"(?i)(\d+(?:\.\d+)?)\s*[xX]\s*(\d+(?:\.\d+)?)"

# --- fixed values: place text ---
GEO_STOPWORDS = ["khan", "sangkat", "district", "city", "province"]
SCOPE_TOKEN_GROUPS = [
    ["chroy", "chrouy"],
    ["changva", "changvar", "chongva", "chongvar"],
]
SALE_PATTERN = r"\bsale\b|\bsell\b"
FUZZY_CUTOFF = 0.72

# --- fixed values: numeric thresholds ---
CLEAN_RENT_RANGE = (50.0, 50000.0)
MODEL_RENT_RANGE = (50.0, 500000.0)
POSSIBLE = {
    "size_sqm": (5.0, 5000.0),
    "bedrooms": (None, 20.0),
    "bathrooms": (None, 20.0),
}
BOUNDS = {
    "size_sqm": (8.0, 2000.0),
    "bedrooms": (0.0, 20.0),
    "bathrooms": (1.0, 20.0),
}
MIN_SQM_PER_ROOM = 8.0

# --- fixed values: dashboard price bands, right-open ---
BAND_EDGES = [0, 200, 400, 600, 800, 1000, 1500, 2000, 3000, 5000, 999999]
BAND_LABELS = [
    "<$200", "$200-400", "$400-600", "$600-800", "$800-1k",
    "$1k-1.5k", "$1.5k-2k", "$2k-3k", "$3k-5k", ">$5k",
]

# --- fixed values: columns ---
TARGET = "rent_price_usd"
STRUCTURAL = ["size_sqm", "bedrooms", "bathrooms"]
ADMIN_COLUMNS = ["furnished", "posted_date", "title", "source_url"]
LEAKAGE_COLUMNS = ["log_rent", "price_per_sqm", "log_price_per_sqm"]
EDA_REQUIRED = [
    "listing_id", "city", "district", "location", "property_type",
    "rent_price_usd", "size_sqm", "bedrooms", "bathrooms",
]
EDA_NUMERIC = ["rent_price_usd", "size_sqm", "bedrooms", "bathrooms", "price_per_sqm"]
MODEL_FEATURES = [
    "size_sqm",
    "bedrooms",
    "bathrooms",
    "size_sqm_sq",
    "log_size_sqm",
    "bath_per_bed",
    "total_rooms",
    "size_per_room",
    "room_density",
    "size_room_balance",
    "bedroom_share",
    "bathroom_share",
    "room_value_proxy",
    "bed_bath_interaction",
    "furnished_score",
    "district_freq",
    *[f"type_{t}" for t in MODEL_TYPES],
    "size_sqm_was_missing",
    "bedrooms_was_missing",
    "bathrooms_was_missing",
    "post_month",
    "post_dayofweek",
    "post_quarter",
]
BASELINE_FEATURES = ["size_sqm", "bedrooms", "bathrooms"]
COMPARISON_FEATURES = [
    "size_sqm", "bedrooms", "bathrooms", "log_size_sqm", "bath_per_bed",
    "total_rooms", "size_per_room", "district_freq",
    *[f"type_{t}" for t in MODEL_TYPES],
]

# --- fixed values: logical -> physical names of an extracted listing ---
COLUMN_NAMES = {
    "price": "rent_price_usd",
    "city": "city",
    "location": "district",
    "type": "property_type",
    "size": "size_sqm",
    "bedrooms": "bedrooms",
    "bathrooms": "bathrooms",
    "furnished": "furnished",
}

# --- fixed values: context used when the market table is empty ---
CONTEXT_DEFAULTS = {
    "overall_price": 1000.0,
    "overall_pps": 12.0,
    "overall_size": 60.0,
    "overall_bed": 2.0,
    "overall_bath": 2.0,
    "post_month": 6.0,
    "post_dayofweek": 3.0,
    "post_quarter": 2.0,
    "pps_low": 1.0,
    "pps_high": 30.0,
    "dominant_type": "House",
}

# --- fixed values: serving ---
ANCHOR_WEIGHTS = {"market": 0.30, "type": 0.30, "bedrooms": 0.20, "bathrooms": 0.20}
CURVE_SIZES = [30, 50, 75, 100, 150]
IMPACT_LABELS = ["Property Type", "Size (sqm)", "Bedrooms", "Bathrooms"]
DEFAULT_IMPACTS = [
    ("Size (sqm)", 35.0),
    ("Property Type", 30.0),
    ("Bedrooms", 20.0),
    ("Bathrooms", 15.0),
]
SAMPLE_REGIONS = [("Sample A", 1.10), ("Sample B", 1.00), ("Sample C", 0.90), ("Sample D", 0.80)]
FORM_MIN_SIZE = 6.0

# --- fixed values: search spaces of tuned models ---
TUNE_SPACES = {
    "Random Forest": {
        "numTrees": [300, 500, 700],
        "maxDepth": [30, 10, 14, 18],
        "minInstancesPerNode": [1, 2, 4],
        "featureSubsetStrategy": ["sqrt", "log2", "0.8"],
    },
    "Extra Trees": {
        "numTrees": [400, 600, 800],
        "maxDepth": [0, 12, 18, 24],
        "minSplit": [2, 4, 8],
        "minInstancesPerNode": [1, 2, 4],
        "featureSubsetStrategy": ["sqrt", "log2", "0.8"],
    },
    "Gradient Boosting": {
        "maxIter": [300, 500, 700],
        "stepSize": [0.03, 0.05, 0.08],
        "maxDepth": [3, 4, 5],
        "subsamplingRate": [0.7, 0.85, 1.0],
        "minInstancesPerNode": [1, 3, 5],
    },
    "Histogram Gradient Boosting": {
        "stepSize": [0.03, 0.05, 0.08],
        "maxDepth": [0, 8, 12],
        "maxIter": [300, 500, 700],
        "maxLeaves": [31, 63],
        "l2": [0.0, 0.1, 0.5],
    },
    "Support Vector Regression": {
        "c": [30.0, 60.0, 100.0, 150.0],
        "epsilon": [0.03, 0.05, 0.08, 0.12],
    },
}
LOW_FIT = 0.5
MAX_ROOMS = 10_000  # a request with more bedrooms or bathrooms is rejected: every layout of it would be scored
