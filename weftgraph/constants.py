"""Fixed values that results depend on: word lists, weights and patterns."""

SEARCH_STOP = ["the", "and", "or", "for", "with", "from", "about", "this", "that", "what", "when", "where", "how", "filetype", "pdf", "doc", "docx", "official", "reports", "analysis", "relationship", "influence", "on"]
KEYWORD_STOP = ["the", "and", "for", "with", "from", "about", "this", "that", "what", "when", "where", "how"]
URL_STOP = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by"]
COMMON_WORDS = ["the", "be", "to", "of", "and", "a", "in", "that", "have", "i", "it", "for", "not", "on", "with", "he", "as", "you", "do", "at", "this", "but", "his", "by", "from", "they", "we", "say", "her", "she"]
INVALID_WORDS = ["a", "an", "the", "of", "in", "on", "at", "to", "for", "with", "by", "from", "about", "as", "into", "and", "or", "but", "is", "are", "was", "were", "who", "what", "where", "when", "why", "how", "which", "that", "this", "read", "edit", "view", "history", "see", "also", "external", "links"]
CORPORATE_WORDS = ["about", "team", "leadership", "management", "board", "executive", "investor", "investors", "governance", "contact", "contacts", "company", "corporate", "people", "despre", "echipa", "conducere", "equipe", "direction", "equipo", "direccion", "contacto", "leitung", "kontakt"]
NAV_WORDS = [
    "menu", "navigation", "subscribe", "copyright", "cookie", "privacy policy", "terms of service", "all rights reserved", "sign in", "log in", "register",
    "follow us", "share", "tweet", "facebook", "twitter", "instagram", "related articles", "you may also like", "recommended for you", "advertisement", "sponsored",
    "loading...", "click here", "meniu", "navigare", "abonare", "drepturi rezervate", "politica de confidentialitate", "termeni si conditii", "termeni și condiții",
    "autentificare", "inregistrare", "înregistrare", "urmareste", "distribuie", "articole similare", "publicitate", "droits réservés", "politique de confidentialité",
    "conditions d'utilisation", "derechos reservados", "política de privacidad", "términos de servicio", "alle rechte vorbehalten", "datenschutz", "nutzungsbedingungen",
]
LABEL_PRIORITY = {"PERSON": 5, "ORG": 4, "GPE": 3, "LOC": 3, "EVENT": 2, "WORK_OF_ART": 2, "PRODUCT": 2, "DATE": 1, "EMAIL": 1, "PHONE": 1, "SOCIAL": 1, "DOCUMENT": 1, "UNKNOWN": 0}
DISCOVERY_WEIGHT = {"PERSON": 3.0, "ORG": 2.5, "GPE": 2.0, "EVENT": 1.8, "NORP": 1.5, "FAC": 1.2, "LOC": 1.0}
DOCUMENT_EXTENSIONS = [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".odt", ".ods", ".rtf", ".csv", ".txt"]
SOURCE_PRIORITY = {"seed": 0, "google": 1, "bing": 2, "ddg": 3}
#: (relation, triggers, pattern, unordered label pairs)
RELATION_PATTERNS = [
    ("employment", ["ceo", "cto", "cfo", "president", "director", "founder", "employee", "works", "worked"], r"\b(ceo|cto|cfo|president|director|founder|chairman|executive|manager|employee)\s+(of|at|for)\b", [("PERSON", "ORG")]),
    ("employment", ["works at", "employed by", "hired by", "joined", "position at"], r"\b(works?|worked|employed|hired|joined|position)\s+(at|by|with)\b", [("PERSON", "ORG")]),
    ("location", ["based in", "located in", "headquarters", "headquartered", "office in"], r"\b(based|located|headquartered|headquarters|office|offices)\s+(in|at)\b", [("ORG", "GPE"), ("ORG", "LOC")]),
    ("location", ["lives in", "resides in", "born in", "from"], r"\b(lives?|lived|resides?|resided|born|from)\s+(in|at)\b", [("PERSON", "GPE"), ("PERSON", "LOC")]),
    ("education", ["graduated from", "studied at", "attended", "alumnus", "student at"], r"\b(graduated?|studied|attended|alumnus|student|degree)\s+(from|at|in)\b", [("PERSON", "ORG")]),
    ("family", ["son of", "daughter of", "father", "mother", "parent", "child", "brother", "sister"], r"\b(son|daughter|father|mother|parent|child|brother|sister|spouse|wife|husband)\s+(of)?\b", [("PERSON", "PERSON")]),
    ("ownership", ["founded", "established", "created", "started", "launched", "owns", "acquired"], r"\b(founded|established|created|started|launched|owns?|owned|acquired)\b", [("PERSON", "ORG"), ("ORG", "ORG")]),
    ("temporal", ["founded in", "established in", "created in", "born on", "died on"], r"\b(founded|established|created|born|died|occurred|happened)\s+(in|on|at)\b", [("PERSON", "DATE"), ("ORG", "DATE"), ("EVENT", "DATE")]),
    ("membership", ["member of", "part of", "affiliated with", "associated with", "belongs to"], r"\b(member|part|affiliated|associated|belongs?)\s+(of|to|with)\b", [("PERSON", "ORG"), ("PERSON", "NORP"), ("ORG", "ORG")]),
]
#: relation -> (verbs, nouns, prepositions); order decides ties.
RELATION_TYPES = {
    "is_CEO_of": (["is", "serves", "works"], ["ceo", "chief executive", "chief executive officer"], ["of", "at", "for"]),
    "is_founder_of": (["founded", "established", "created", "started", "co-founded"], ["founder", "co-founder"], ["of"]),
    "is_president_of": (["is", "serves", "elected"], ["president", "chairman", "chair"], ["of", "at"]),
    "is_director_of": (["directs", "heads", "leads", "manages"], ["director", "head", "leader", "manager"], ["of", "at"]),
    "works_for": (["works", "employed", "serves", "hired"], ["employee", "staff", "worker"], ["for", "at", "in"]),
    "owns": (["owns", "possesses", "holds"], ["owner", "ownership"], ["of"]),
    "acquired": (["acquired", "bought", "purchased"], ["acquisition", "purchase"], ["by", "from"]),
    "sold_to": (["sold", "divested"], ["sale", "divestiture"], ["to", "by"]),
    "located_in": (["located", "based", "situated", "headquartered"], ["location", "headquarters", "office", "base"], ["in", "at"]),
    "born_in": (["born"], ["birth", "birthplace"], ["in", "at"]),
    "lives_in": (["lives", "resides", "stays"], ["residence", "home"], ["in", "at"]),
    "married_to": (["married", "wed"], ["spouse", "wife", "husband", "partner"], ["to", "with"]),
    "parent_of": (["fathered", "mothered"], ["father", "mother", "parent", "dad", "mom"], ["of"]),
    "child_of": (["born"], ["son", "daughter", "child"], ["of", "to"]),
    "studied_at": (["studied", "attended", "graduated"], ["student", "graduate", "alumnus", "alumni"], ["at", "from"]),
    "graduated_from": (["graduated"], ["graduate", "degree", "diploma"], ["from", "at"]),
    "elected_to": (["elected", "appointed", "nominated"], ["election", "appointment"], ["to", "as"]),
    "member_of": (["joined", "member"], ["member", "membership"], ["of", "in"]),
    "partnered_with": (["partnered", "collaborated", "cooperated"], ["partner", "partnership", "collaboration"], ["with", "between"]),
    "competes_with": (["competes", "rivals"], ["competitor", "rival", "competition"], ["with", "against"]),
}
#: Reliability of entity types, and pairs of types that are strongly or weakly related.
TYPE_CONFIDENCE = {"PERSON": 0.3, "ORG": 0.3, "GPE": 0.25, "LOC": 0.25, "DATE": 0.2, "EVENT": 0.2, "FAC": 0.2, "PRODUCT": 0.15, "WORK_OF_ART": 0.15, "NORP": 0.15, "MONEY": 0.1, "QUANTITY": 0.1, "ORDINAL": 0.05, "CARDINAL": 0.05}
STRONG_PAIRS = [("PERSON", "ORG"), ("PERSON", "GPE"), ("PERSON", "NORP"), ("ORG", "GPE"), ("PERSON", "EVENT"), ("ORG", "EVENT")]
WEAK_PAIRS = [("ORG", "ORG"), ("GPE", "GPE"), ("NORP", "NORP")]
SCORED_PAIRS = [("PERSON", "ORG"), ("PERSON", "GPE"), ("ORG", "GPE")]
COMPATIBLE_PAIRS = [("PERSON", "ORG"), ("PERSON", "GPE"), ("PERSON", "EVENT"), ("ORG", "GPE"), ("ORG", "EVENT"), ("ORG", "PRODUCT")]
STRONG_RELATIONS = ["employment", "family", "ownership", "education"]
#: Pronouns by what they stand for.
PRONOUNS = {"person": ["he", "him", "his", "himself", "she", "her", "hers", "herself"], "thing": ["it", "its", "itself"], "many": ["they", "them", "their", "theirs", "themselves"]}
TEMPORAL_WORDS = {"before": "before", "after": "after", "during": "during", "since": "since", "until": "until", "while": "during", "when": "at", "founded": "founded", "established": "established", "created": "created", "born": "born", "died": "died"}
DATE_PATTERNS = [("year", r"\b(?:since|from|in|during|on)\s+(\d{4})\b"), ("range", r"\b((?:between|from)\s+\d{4}\s+(?:and|to)\s+\d{4})\b"), ("month_year", r"\b([A-Z][a-z]+\.?\s+\d{4})\b"), ("full_date", r"\b(\d{4}[-/]\d{2}[-/]\d{2})\b")]
FACT_WORDS = ["born", "founded", "established", "died", "created"]
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
PHONE_PATTERN = r"\+?\d[\d\s().-]{6,}\d"
SOCIAL_PATTERN = r"https?://(?:www\.)?(?:linkedin\.com/(?:in|company)/|x\.com/|twitter\.com/|facebook\.com/|instagram\.com/|github\.com/)[^\s\]\[)(<>\"']{2,}"
DATE_LIKE = r"^(?:(?:19|20)\d{2}[-/.](?:0?[1-9]|1[0-2])[-/.](?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/.](?:0?[1-9]|1[0-2])[-/.](?:19|20)\d{2}|(?:19|20)\d{2}[-/.](?:0?[1-9]|1[0-2])|(?:19|20)\d{2}\s*[-/]\s*(?:19|20)\d{2}|(?:19|20)\d{2}(?:19|20)\d{2})$"
