"""Vocabularies and thresholds. All of these are fixed values, which results depend on."""

# Month words, English and French, full and short.
MONTHS = {
    "jan": 1, "january": 1, "janv": 1, "janvier": 1,
    "feb": 2, "february": 2, "fev": 2, "fév": 2, "fevr": 2, "févr": 2, "fevrier": 2, "février": 2,
    "mar": 3, "march": 3, "mars": 3,
    "apr": 4, "april": 4, "avr": 4, "avril": 4,
    "may": 5, "mai": 5,
    "jun": 6, "june": 6, "juin": 6,
    "jul": 7, "july": 7, "juil": 7, "juillet": 7,
    "aug": 8, "august": 8, "aout": 8, "août": 8,
    "sep": 9, "sept": 9, "september": 9, "septembre": 9,
    "oct": 10, "october": 10, "octobre": 10,
    "nov": 11, "november": 11, "novembre": 11,
    "dec": 12, "december": 12, "déc": 12, "decembre": 12, "décembre": 12,
}
# Month words that may stand without a year under a banner that has one.
BARE_MONTHS = {
    "janvier": 1, "février": 2, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "août": 8, "aout": 8,
    "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12, "decembre": 12,
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8,
    "september": 9, "october": 10, "november": 11, "december": 12,
}
MONTHS_SHOWN = {
    "fr": ["janv.", "févr.", "mars", "avr.", "mai", "juin", "juil.", "août", "sept.", "oct.", "nov.", "déc."],
    "en": ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"],
}
ERROR_LITERALS = ["#div/0!", "#n/a", "#name?", "#null!", "#num!", "#ref!", "#value!", "#error!"]
NULLISH = ["", "none", "nan", "null"]

# Patterns are Java's; (?iuU) folds accents and takes \b and \s as Unicode.
ROLES = [
    ("price", r"\bprix\b|\bprice\b|tarif"),
    ("revenue", r"revenu|chiffre.?d.affaires|recettes?\b|produits?\s+d.exploitation|\bsales\b|\bventes?\b|\bincome\b|turnover"),
    ("capex", r"capex|investissement|immobilisations?"),
    ("budget", r"budget|pr[ée]vision(nel)?s?\b|pr[ée]vus?\b|forecast"),
    ("opex", r"opex|charges?\b|co[uû]ts?\s+(d.)?(op[ée]rat\w*|exploitation|production|fonctionnement)|operating\s+(costs?|expenses?)|frais\s+(g[ée]n[ée]raux|de\s+fonctionnement)"),
    ("headcount", r"effectifs?\b|employ[ée]s?\b|salari[ée]s?\b|personnel\b|headcount|\bstaff\b"),
    ("volume", r"(?<![a-z0-9])(?:cpo|ffb)(?![a-z0-9])|production|tonnage|\bvolume\b|quantit[ée]s?|r[ée]coltes?\b|harvest|\boutput\b|unit[ée]s?\s+(vendues|produites)|units\s+sold"),
    ("area", r"hectare|\bha\b|surface|superficie|acres?\b|m²"),
]
DERIVED_SERIES = r"total|cumul|sous.?tot|grand.?tot"
RATE_SERIES = r"(/|\bper\b|\bpar\b)\s*\(?\s*(t|tonnes?|kg|km|l|unit[ée]?s?|ha|hectares?|m²|jour|day|head|t[êe]te)s?\b"
PLAN_SHEET = r"budget|pr[ée]vision(nel)?s?|forecast|\bplan\b|projections?"
PLAN_TOKEN = r"^(pr[ée]vu[es]?|pr[ée]vision\w*|plan\w*|budget\w*|forecast\w*|projet[ée]?[es]?)$"
TOTAL_LABEL = r"\b(total|totaux|totales?|somme|cumul|sum)\b"
TARGET_NAME = r"(montant|prix|co[uû]t|salaire|revenu|somme|valeur|budget|d[eé]pense|price|total|amount|revenue|sales|value|cost|income|profit|balance|payment)"
INVENTORY = r"stock|inventaire|inventor|on.?hand"
CHANGE = r"growth|change|variation|croissance|[ée]volution|delta|Δ|\bmom\b|\byoy\b|cagr|vs.?prev"
RATIO = r"%|percent|\bpct\b|margin|marge|ratio|score|index|indice|\brate\b|taux"
ID_NAME = r"(?:^|[_\s.\-])id(?:entifiant)?$|^id$|(?:^|[_\s.\-])code(?:$|[_\s.\-])"
RANK_NAME = r"(?:^|[_\s.\-])(?:rank|rang|classement)$"
MEAN_ONLY = r"(?:^|[_\s.\-])(?:age|âge)$|ancien+et[ée]"
UNIT_NAME = r"unit|unitaire|/|per\b|par\b|price|prix|rate|taux"
SECTIONS = [("capex", r"capex|invest|replant"), ("overhead", r"dgo|head\s*office|si[eè]ge"), ("opex", r"opex|admin|plantation|mill|technique")]
STOP_WORDS = """
les des une dans pour avec sont est nos vos votre notre nous vous elle ils par sur vers jour jours mois annee annees comment
quel quelle quels quelles lequel laquelle plus moins tres bien peut evolue evoluent descend rupture
the and for our are is how which what who does most least best worst much many per day days month months year years trending
down toward out are
""".split()
INTENTS = [
    ("stock", r"stock|inventaire|inventor|rupture|out of stock|shortage|p[ée]nurie", r"^low_stock$"),
    ("trend", r"trend|tendance|[ée]volu|over time|au fil|progress|croissance|how is .* (doing|going)|comment", r"^(trend|mom|yoy)$"),
    ("performance", r"best|worst|top|bottom|perform|meilleur|pire|classement|rank|produits?|products?|entreprises?|compan(y|ies)", r"^(movers$|avg_)"),
    ("breakdown", r"where|o[uù]\b|r[ée]gion|by |par |split|r[ée]partition|breakdown|which|quel(le)?s?", r"^by_"),
    ("amount", r"revenu|revenue|ventes|sales|chiffre|montant|total|how much|combien", r"^(headline$|by_)"),
]
GENERIC_INTENTS = ["breakdown", "amount"]

# Journal codes that are never a cost, and tolerances of a match.
NEUTRAL_CODES = ["REPORT", "Banque", "AR"]
MATCH_USD, MATCH_CDF = 0.5, 1200.0
UNMAPPED = "UNMAPPED"

# Layout
DATE_RUN, AXIS_SHARE, INTERIOR_SHARE, SCAN_ROWS = 3, 0.6, 0.5, 15
YEAR_MIN, YEAR_MAX, YEAR_COVERAGE = 1990, 2100, 0.7
HEADER_SCAN, BANNER_SHARE = 25, 0.8
# Profiles
DOMINANT, DISTINCT_CAP, TOP_VALUES = 0.6, 1000, 5
# Audit
SUPPORT_ROWS, SUPPORT_SHARE, PRODUCT_HITS, TOLERANCE, PRODUCT_COLUMNS, LISTED, FIX_SHARE = 3, 0.7, 5, 0.01, 30, 10, 0.8
TOTAL_COVERAGE, TOTAL_HITS = 0.6, 2
