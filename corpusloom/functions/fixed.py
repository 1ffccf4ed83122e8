"""Word lists, patterns and labels that results depend on, stated as they have to be."""

# fixed values: words that never become search terms
STOP_WORDS = """the a an of to in on for and or but is are be was were been shall must may can as by with without under where which that this
these those its their any all each such not no nor should might would could will at from into between among upon per via does do have has had
member states union european regulation directive decision commission applies""".split()

# fixed values: spans of a text that stay one term, instrument numbers and acronyms
INSTRUMENT_SPAN = r"\b\d{4}/\d{2,5}(?:/\w{2,3})?\b"
ACRONYM_SPAN = r"\b[A-Z][A-Z0-9]{1,}\b"

# fixed values: dates, in the order in which their forms are listed
DATE_FORMS = [
    r"\d{1,2}\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}",
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"(?<!\d)\d{1,2}\.\d{1,2}\.\d{4}(?!\d)",
]

# fixed values: marks of structure in markdown
ARTICLE_LINE = r"(?i)^[ \t]*(#{1,6})?[ \t]*([*_`]{1,4}[ \t]*)?article[ \t]+(\d+[a-z]?)(?:\(\d+\))?(?![0-9a-z])(?:[ \t]*[-–—:][ \t]+([^\n]{3,160}?))?((?:\*{1,3}|_{1,3})(?!\w)[ \t]*)?$"
HEADING_LINE = r"^\s*(#{1,6})\s+(.+?)\s*$"
LETTERED_PARA = r"^[ \t]*(?:[-*][ \t]*)?\([a-z]\)[ \t]*\S"
NUMBERED_PARA = r"^[ \t]*\d+[.)][ \t]*\S"
CHAPTER_LINE = r"(?i)^[ \t]*#{0,6}[ \t]*(chapter|title|part)[ \t]+([ivx]+|\d+|[a-z])\b"
RECITAL_LINE = r"^[ \t]*(?:[-*][ \t]*)?\((\d+)\)[ \t]+[A-Z\"'‘(]"
TABLE_LINE = r"^\|.+\|[ \t]*$"
TABLE_RULE = r"^\|[\s\-:|]+\|\s*$"

# fixed values: units of measure that are counted, by what they measure
UNITS = {"power": r"\b(MW|GW|kW)\b", "energy": r"\b(MWh|GWh|GJ)\b", "price": r"\b(EUR|€)\s*/\s*(MWh|GJ|kWh)\b"}
#: Recitals of a document that are listed at most.
MOST_RECITALS = 500

# fixed values: references between articles and instruments
ARTICLE_MENTION = r"\bArticles?\s+(\d+[a-z]?)\b"
LIST_GOES_ON = r"\s*(?:to,?|--?|,|and(?:\s+the)?)\s*(\d+[a-z]?)\b"
CONNECTOR = r"(?i)\b(?:of|under|pursuant\s+to|according\s+to|provided\s+in|laid\s+down\s+in|referred\s+to)\s"
CONNECTED_NUMBER = r"(?:\s|[A-Za-z()’'-]){0,24}(?:No\.?\s)*(\d{4}/\d{2,5})"
INSTRUMENT_NAME = r"(?:Regulation|Directive|Decision|Commission)(?:\s*\((?:EU|EC|EURI|EUR|EEA)\))?"
AMENDING = r"(?i)\b(?:amend(?:s|ed|ing|ment)s?|amended by|amends)\b.{0,200}?(?:Regulation|Directive|Decision|Commission\s+Implementation|Commission\s+Implementing)(?:\s*\(EU?\))?\s*(?:No\.?\s*)?(\d{4}/\d{3,5}(?:/\w{0,3})?)"
IMPLEMENTING = rf"(?i){INSTRUMENT_NAME}\s*(?:No\.?\s*)?(\d{{4}}/\d{{2,5}})\b.{{0,80}}?\b(?:implements?|implemented (?:through|by)\b|is implemented (?:by|in)\b|Commission\s+Implement(?:ing|ation)\s+(?:Regulation|Decision)).{{0,180}}?{INSTRUMENT_NAME}\s*(?:No\.?\s*)?(\d{{4}}/\d{{3,5}}(?:/\w{{0,3}})?)"
SUPERSEDING = rf"(?i){INSTRUMENT_NAME}\s*(?:No\.?\s*)?(\d{{4}}/\d{{2,5}})\b.{{0,160}}?\b(?:repeals?|replaces?|has (?:replaced|superseded)\b).{{0,160}}?{INSTRUMENT_NAME}\s*(?:No\.?\s*)?(\d{{4}}/\d{{2,5}})"
SCOPE_ANCHOR = r"(?i)\b(?:applies? to|apply to|is addressed to|shall apply (?:to|in)|applied to|is applicable to|addressed to the|addressed to)\b"
QUOTED_TERM = [r"(?i)\"([^\"]{3,50})\"\s+means\b", r"(?i)‘([^’]{3,50})’\s+means\b"]
BARE_TERM = r"\b([A-Z][A-Za-z0-9-]{2,40})\s+means\b"

# fixed values: entities that scope phrases name, label and pattern
ENTITIES = [
    ("wholesale energy market participants", r"wholesale\s+energy\s+market\s+participants"), ("balance responsible parties", r"balance[-\s]?responsible\s+parties"),
    ("balance managers", r"balance[-\s]?managers"), ("digital service providers", r"digital\s+service\s+providers"),
    ("providers of essential services", r"providers?\s+of\s+essential\s+services"), ("transmission system operators", r"transmission\s+system\s+operators?"),
    ("distribution system operators", r"distribution\s+system\s+operators?"), ("national regulatory authorities", r"national\s+regulator(?:y|ies)"),
    ("critical digital infrastructure entities", r"critical\s+digital\s+infrastructure"), ("market participants", r"market\s+participants"),
    ("energy service companies", r"energy\s+service\s+companies"), ("energy companies", r"energy\s+companies"), ("energy suppliers", r"energy\s+suppliers"),
    ("market operators", r"market\s+operators"), ("undertakings", r"undertakings"), ("aggregators", r"aggregators"), ("end users", r"end[-\s]?users"),
    ("consumers", r"consumers"), ("investors", r"investors"), ("traders", r"traders"), ("operators", r"[a-z]\s+operators?"), ("providers", r"[a-z]\s+providers?"),
    ("entities", r"\bentities\b"), ("companies", r"\bcompanies\b"), ("member states", r"member\s+states"),
]

# fixed values: labels of relations seen from their source and from their target
OUT_LABEL = {"CROSS_REFERENCES": "CITES", "AMENDS": "AMENDS", "DEFINED_IN": "DEFINES", "APPLIES_TO": "APPLIES_TO", "PART_OF": "PART_OF", "IMPLEMENTS": "IMPLEMENTS", "SUPERSEDES": "SUPERSEDES"}
IN_LABEL = {"CROSS_REFERENCES": "CITED_BY", "AMENDS": "AMENDED_BY", "DEFINED_IN": "DEFINES", "APPLIES_TO": "APPLIED_TO", "PART_OF": "CONTAINS", "IMPLEMENTS": "IMPLEMENTED_BY", "SUPERSEDES": "SUPERSEDED_BY"}
