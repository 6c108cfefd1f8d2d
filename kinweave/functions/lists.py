"""Word lists, code tables and patterns that normalised records depend on."""

COUNTRY = {
    "united states": "us",
    "united states of america": "us",
    "usa": "us",
    "u.s.": "us",
    "u.s.a.": "us",
    "us": "us",
    "india": "india",
    "in": "india",
    "france": "france",
    "fr": "france",
}

ABBREVIATIONS = {
    "us": {
        "corp": "corporation", "inc": "incorporated", "llc": "limited liability company", "co": "company", "ltd": "limited",
        "st": "street", "rd": "road", "ave": "avenue", "blvd": "boulevard", "ste": "suite", "apt": "apartment", "bldg": "building", "hwy": "highway",
    },
    "india": {
        "pvt": "private", "ltd": "limited", "llp": "limited liability partnership", "rd": "road", "st": "street", "opp": "opposite", "nr": "near",
        "nagar": "nagar", "colony": "colony",
    },
    "france": {
        "sarl": "societe a responsabilite limitee", "sas": "societe par actions simplifiee", "sa": "societe anonyme",
        "eurl": "entreprise unipersonnelle a responsabilite limitee", "sci": "societe civile immobiliere",
        "av": "avenue", "bd": "boulevard", "ste": "sainte", "st": "saint",
    },
}

LEGAL_SUFFIXES = {
    "us": ["corporation", "incorporated", "limited liability company", "company", "limited"],
    "india": ["private limited", "private", "limited", "limited liability partnership"],
    "france": [
        "societe a responsabilite limitee", "societe par actions simplifiee", "societe anonyme", "entreprise unipersonnelle a responsabilite limitee",
        "entreprise unipersonnelle", "societe civile immobiliere",
    ],
}

STOPWORDS = [
    "the", "and", "of", "a", "an", "for", "to", "in", "on", "at", "by",
    "services", "solutions", "enterprises", "group", "holdings", "international", "global", "systems", "technologies",
]

POSTAL = {"us": r"\b\d{5}(?:-\d{4})?\b", "india": r"\b\d{6}\b", "france": r"\b\d{5}\b"}

STATES = {
    "us": [
        "al", "ak", "az", "ar", "ca", "co", "ct", "de", "fl", "ga", "hi", "id", "il", "in", "ia", "ks", "ky", "la", "me", "md",
        "ma", "mi", "mn", "ms", "mo", "mt", "ne", "nv", "nh", "nj", "nm", "ny", "nc", "nd", "oh", "ok", "or", "pa", "ri", "sc",
        "sd", "tn", "tx", "ut", "vt", "va", "wa", "wv", "wi", "wy", "dc",
        "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida", "georgia", "hawaii", "idaho",
        "illinois", "indiana", "iowa", "kansas", "kentucky", "louisiana", "maine", "maryland", "massachusetts", "michigan", "minnesota",
        "mississippi", "missouri", "montana", "nebraska", "nevada", "new hampshire", "new jersey", "new mexico", "new york",
        "north carolina", "north dakota", "ohio", "oklahoma", "oregon", "pennsylvania", "rhode island", "south carolina", "south dakota",
        "tennessee", "texas", "utah", "vermont", "virginia", "washington", "west virginia", "wisconsin", "wyoming", "district of columbia",
    ],
    "india": [
        "andhra pradesh", "arunachal pradesh", "assam", "bihar", "chhattisgarh", "goa", "gujarat", "haryana", "himachal pradesh", "jharkhand",
        "karnataka", "kerala", "madhya pradesh", "maharashtra", "manipur", "meghalaya", "mizoram", "nagaland", "odisha", "punjab", "rajasthan",
        "sikkim", "tamil nadu", "telangana", "tripura", "uttar pradesh", "uttarakhand", "west bengal", "delhi", "jammu and kashmir", "ladakh",
        "chandigarh", "puducherry", "andaman and nicobar islands", "dadra and nagar haveli and daman and diu", "lakshadweep",
        "ap", "up", "mp", "wb", "tn", "mh", "ka", "gj", "rj", "pb", "hr", "hp", "jk", "uk", "jh", "od", "as", "br",
    ],
    "france": [
        "auvergne rhone alpes", "bourgogne franche comte", "bretagne", "centre val de loire", "corse", "grand est", "hauts de france", "ile de france",
        "normandie", "nouvelle aquitaine", "occitanie", "pays de la loire", "provence alpes cote d azur",
        "paris", "lyon", "marseille", "toulouse", "nice", "nantes", "strasbourg", "montpellier", "bordeaux", "lille",
    ],
}

STREET_TYPES = [
    "street", "st", "drive", "dr", "road", "rd", "avenue", "ave", "av", "boulevard", "blvd", "bd", "lane", "ln", "way", "court", "ct",
    "place", "pl", "highway", "hwy", "suite", "ste", "apartment", "apt", "building", "bldg", "parkway", "pkwy", "circle", "cir", "terrace",
    "ter", "square", "sq", "trail", "trl", "loop", "route", "rt",
]

LEGAL_FORMS = (
    r"(?i)\b(private\s+limited|pvt\s+ltd|pvt\s+limited|private\s+ltd|private|limited|ltd|pvt|llp|"
    r"limited\s+liability\s+partnership|limited\s+liability\s+company|llc|inc|incorporated|corp|corporation|co|company|"
    r"praiveta\s+limiteda|praiveta\s+limited|praiveta|limiteda|praivet\s+limited|praivet|praivarr\s+limirrad|praivatu\s+limitada|"
    r"praivett\s+limitett|pra\s+li|pra|li|elaelapi|el\s+el\s+pi|elelbhi|elelpi|el\s+el\s+bhi)\b"
)
ADDRESS_NOISE = (
    r"(?i)\b(near|opp|opposite|road|rd|street|st|lane|marg|nagar|colony|sector|block|phase|district|dist|pin|floor|building|bldg|plot|flat|no|"
    r"behind|beside|circle|chowk|cross|main|industrial|area|estate|complex|tower|bazaar|market|post|taluk|tehsil)\b"
)
DOMAIN = r"^[a-z0-9][a-z0-9-]*(\.[a-z0-9-]+){1,3}$"

#: First code points of the Unicode blocks of nine Indic scripts; each block has 128 code points.
INDIC_BLOCKS = {
    "devanagari": 0x0900, "bengali": 0x0980, "gurmukhi": 0x0A00, "gujarati": 0x0A80, "oriya": 0x0B00,
    "tamil": 0x0B80, "telugu": 0x0C00, "kannada": 0x0C80, "malayalam": 0x0D00,
}
