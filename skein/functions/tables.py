"""Lookup tables and word lists that results depend on."""

# Legal forms and business words, token -> canonical token.
LEGAL_SUFFIXES = {
    "corp": "corporation", "corpn": "corporation", "corpo": "corporation",
    "inc": "incorporated", "incorp": "incorporated", "incorported": "incorporated",
    "ltd": "limited", "lmtd": "limited", "limted": "limited",
    "pvt": "private", "pvte": "private", "prvt": "private", "pte": "private", "prv": "private",
    "co": "company", "comp": "company", "cmpny": "company", "cie": "company", "compagnie": "company",
    "intl": "international",
    "assoc": "association", "assn": "association", "asso": "association",
    "mfg": "manufacturing", "svc": "services", "svcs": "services",
    "bros": "brothers", "grp": "group", "mgmt": "management",
    "ctr": "center", "cntr": "center", "centre": "center",
    "dept": "department", "univ": "university", "hosp": "hospital",
    "ets": "etablissements", "etabl": "etablissements",
}

# Legal words of Indic scripts after transliteration and collapsing of repeated letters.
TRANSLITERATED = {
    "praivet": "private", "praibhet": "private", "piraivet": "private", "praivr": "private",
    "pra": "private", "limited": "limited", "limitet": "limited", "limird": "limited",
    "li": "limited", "elelpi": "llp", "kmpni": "company", "kampni": "company",
}

# Legal phrases.
LEGAL_PHRASES = {
    "limited liability company": "llc",
    "limited liability partnership": "llp",
    "limited partnership": "lp",
    "professional limited liability company": "pllc",
    "doing business as": "dba",
    "trading as": "ta",
}

# Address abbreviations, and those that a country has instead.
ADDRESS_WORDS = {
    "rd": "road", "st": "street", "str": "street", "strt": "street",
    "ave": "avenue", "av": "avenue", "avn": "avenue", "aven": "avenue",
    "blvd": "boulevard", "bd": "boulevard", "boul": "boulevard", "bvd": "boulevard",
    "dr": "drive", "drv": "drive", "ln": "lane", "ct": "court", "crt": "court",
    "cir": "circle", "pl": "place", "plz": "plaza", "pkwy": "parkway", "pky": "parkway",
    "hwy": "highway", "fwy": "freeway", "expy": "expressway", "sq": "square",
    "ter": "terrace", "terr": "terrace", "trl": "trail", "tr": "trail", "cres": "crescent",
    "xing": "crossing", "mt": "mount", "ft": "fort", "pt": "point",
    "apt": "apartment", "apts": "apartments", "ste": "suite", "fl": "floor", "flr": "floor",
    "bldg": "building", "blk": "block", "rm": "room", "dept": "department",
    "n": "north", "s": "south", "e": "east", "w": "west",
    "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest",
    "opp": "opposite", "nr": "near", "nagar": "nagar", "mkt": "market",
    "no": "no", "num": "no", "number": "no", "hno": "house no", "dno": "door no",
    "po": "po", "pob": "po box",
}
ADDRESS_WORDS_BY_COUNTRY = {
    "france": {
        "st": "saint", "ste": "sainte",
        "r": "rue", "ch": "chemin", "che": "chemin", "imp": "impasse", "rte": "route",
        "fg": "faubourg", "fbg": "faubourg", "qu": "quai", "qua": "quai", "crs": "cours",
        "pass": "passage", "res": "residence", "lot": "lotissement",
        "zi": "zone industrielle", "za": "zone artisanale",
    },
}

# Parts of an address that say nothing.
PLACEHOLDERS = ("null", "none", "nan", "n/a", "na", "nil", "-", "--", "unknown", "not available")

# Ordinal words.
ORDINALS = {
    "first": "1", "second": "2", "third": "3", "fourth": "4", "fifth": "5", "sixth": "6",
    "seventh": "7", "eighth": "8", "ninth": "9", "tenth": "10", "eleventh": "11", "twelfth": "12",
}

# Regions and their codes, by country.
REGIONS = {
    "us": {
        "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca",
        "colorado": "co", "connecticut": "ct", "delaware": "de", "florida": "fl", "georgia": "ga",
        "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia",
        "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md",
        "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms",
        "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv",
        "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny",
        "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok",
        "oregon": "or", "pennsylvania": "pa", "rhode island": "ri", "south carolina": "sc",
        "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt",
        "virginia": "va", "washington": "wa", "west virginia": "wv", "wisconsin": "wi",
        "wyoming": "wy", "district of columbia": "dc", "puerto rico": "pr",
    },
    "india": {
        "andhra pradesh": "ap", "arunachal pradesh": "ar", "assam": "as", "bihar": "br",
        "chhattisgarh": "cg", "goa": "ga", "gujarat": "gj", "haryana": "hr",
        "himachal pradesh": "hp", "jharkhand": "jh", "karnataka": "ka", "kerala": "kl",
        "madhya pradesh": "mp", "maharashtra": "mh", "manipur": "mn", "meghalaya": "ml",
        "mizoram": "mz", "nagaland": "nl", "odisha": "od", "orissa": "od", "punjab": "pb",
        "rajasthan": "rj", "sikkim": "sk", "tamil nadu": "tn", "tamilnadu": "tn",
        "telangana": "tg", "tripura": "tr", "uttar pradesh": "up", "uttarakhand": "uk",
        "west bengal": "wb", "delhi": "dl", "nct of delhi": "dl", "jammu and kashmir": "jk",
        "chandigarh": "ch", "puducherry": "py", "pondicherry": "py", "ladakh": "la",
    },
}

# Regions in their own script.
NATIVE_REGIONS = {
    "महाराष्ट्र": "mh", "दिल्ली": "dl", "उत्तर प्रदेश": "up", "ಕರ್ನಾಟಕ": "ka",
    "தமிழ்நாடு": "tn", "পশ্চিমবঙ্গ": "wb", "ગુજરાત": "gj", "తెలంగాణ": "tg",
    "हरियाणा": "hr", "राजस्थान": "rj", "കേരളം": "kl", "बिहार": "br",
    "मध्य प्रदेश": "mp", "ఆంధ్రప్రదేశ్": "ap", "ਪੰਜਾਬ": "pb", "ଓଡ଼ିଶା": "od",
}

# Tokens of legal forms, and words that an initialism may leave out.
LEGAL_TOKENS = (
    "corporation", "incorporated", "limited", "private", "company", "llc", "llp", "lp",
    "pllc", "plc", "pc", "pa", "ltda", "gmbh", "ag", "bv", "nv", "sa", "sas", "sasu",
    "sarl", "eurl", "sci", "snc", "scop", "dba", "ta", "the", "opc",
)
INITIALISM_STOP = ("and", "of", "the", "for", "a", "an", "de", "des", "du", "la", "le", "et")

# Sounds of letters, by script, and of symbols. The Brahmic scripts, Hangul and Kana follow from the letters' Unicode names.
SOUNDS = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l",
    "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch",
    "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "iu", "я": "ia", "є": "ie", "і": "i", "ґ": "g", "ј": "j",
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m",
    "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
    "ا": "a", "ب": "b", "ت": "t", "ث": "th", "ج": "j", "ح": "h", "خ": "kh", "د": "d", "ذ": "dh", "ر": "r", "ز": "z", "س": "s",
    "ش": "sh", "ص": "s", "ض": "d", "ط": "t", "ظ": "z", "ع": "", "غ": "gh", "ف": "f", "ق": "q", "ك": "k", "ل": "l", "م": "m",
    "ن": "n", "ه": "h", "و": "w", "ي": "y", "ة": "h", "ى": "y", "ء": "", "پ": "p", "چ": "ch", "ژ": "zh", "گ": "g", "ک": "k", "ی": "y",
    "א": "a", "ב": "b", "ג": "g", "ד": "d", "ה": "h", "ו": "v", "ז": "z", "ח": "kh", "ט": "t", "י": "y", "ך": "k", "כ": "k",
    "ל": "l", "ם": "m", "מ": "m", "ן": "n", "נ": "n", "ס": "s", "ע": "", "ף": "p", "פ": "p", "ץ": "ts", "צ": "ts", "ק": "q",
    "ר": "r", "ש": "sh", "ת": "t",
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i",
    "°": "deg", "™": "tm", "€": "EUR", "£": "PS", "–": "-", "—": "-", "…": "...", "«": "<<", "»": ">>", "“": '"', "”": '"',
}
# Signs of the Brahmic scripts, by the last word of their names.
BRAHMIC_SIGNS = {"VIRAMA": "", "ANUSVARA": "n", "CANDRABINDU": "n", "VISARGA": "h", "NUKTA": ""}

# Abbreviations with slashes between their letters.
SLASHED = {"d/b/a": "dba", "t/a": "ta", "c/o": "careof", "s/o": "sonof"}
