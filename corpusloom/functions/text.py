"""Text functions as column expressions: they compile into the scan stage and need no Python worker."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _m(pattern: str) -> str:
    return "(?m)" + pattern


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def article_numbers(c: Column) -> Column:
    """Distinct article numbers that a text names, shorter ones first, then by value."""
    found = F.array_distinct(_all(c, r"\bArticle\s+(\d+[a-z]?)\b", 1))
    return F.transform(F.array_sort(F.transform(found, lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))), lambda s: s["x"])


def dates(c: Column, most: int = 8) -> Column:
    """Distinct dates, all of the first form before those of the next, at most ``most``."""
    return F.slice(F.array_distinct(F.concat(*[_all(c, p) for p in fixed.DATE_FORMS])), 1, most)


def publication_date(c: Column) -> Column:
    """First of ``dates``, as written; null if there is none."""
    return F.get(dates(c), F.lit(0))


def definitions(c: Column, most: int = 6) -> Column:
    """Distinct terms that the text defines by 'X means', quoted forms first; 4 to 59 characters."""
    found = F.concat(_all(c, r'(?i)"([^"]+)"\s+means\b', 1), _all(c, r"(?i)'([^']+)'[\s]*means\b", 1), _all(c, r"(?i)‘([^’]+)’\s+means\b", 1), _all(c, r"\b([A-Z][\w\- ]{2,40})\s+means\b", 1))
    sized = F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: (F.length(x) > 3) & (F.length(x) < 60))
    return F.slice(F.array_distinct(sized), 1, most)


def table_count(c: Column) -> Column:
    """Rule lines of pipe tables, or a third of the lines with three pipes if that is more."""
    piped = F.size(F.filter(F.split(c, "\n"), lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"))) >= 3))
    return F.greatest(F.size(_all(c, _m(r"^\|[ \t\-:|]+\|[ \t]*$"))), F.floor(piped / 3).cast("int"))


def table_headers(c: Column, most: int = 3) -> Column:
    """Cells of the lines right above a rule line, joined by ' | '."""
    lines = F.split(c, "\n")
    pairs = F.filter(F.arrays_zip(lines.alias("a"), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))).alias("b")), lambda p: p["b"].rlike(r"^\s*\|[\s\-:|]+\|\s*$") & (F.length(p["a"]) - F.length(F.replace(p["a"], F.lit("|"))) >= 3))
    cells = lambda a: F.filter(F.transform(F.split(F.btrim(a, F.lit("|")), "\\|"), lambda x: F.trim(x)), lambda x: x != "")
    return F.slice(F.filter(F.transform(pairs, lambda p: F.array_join(cells(p["a"]), " | ")), lambda x: x != ""), 1, most)


def headings(c: Column, most: int = 10) -> Column:
    return F.slice(F.transform(_all(c, _m(r"^#{1,6}[ \t]+(.+)$"), 1), lambda x: F.trim(x)), 1, most)


def numbered_items(c: Column, most: int = 10) -> Column:
    return F.slice(_all(c, _m(r"^[ \t]*(?:\d+\.|\d+|[a-z]\)|[A-Z]\))[ \t].+$")), 1, most)


def paragraph_count(c: Column) -> Column:
    """Blocks between blank lines with more than 50 characters."""
    return F.size(F.filter(F.split(c, "\n\n"), lambda p: F.length(F.btrim(p, F.lit(" \t\r\n"))) > 50))


def obligation_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?i)\b(shall|must|is\s+required\s+to)\b"))


def derogation_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?i)\b(notwithstanding|except\s+(where|when|if|as)|without\s+prejudice\s+to)\b"))


def instrument(c: Column) -> Column:
    """Kind, region and number of the first instrument that a text names, e.g. 'Regulation (EU) 2016/679'; null if none."""
    full = r"(?i)(Regulation|Directive|Decision)[*_ ]*\(?[ ]*(EU|EC|EURATOM)[*_ ]*\)?[*_ ]*(?:No[._ ]*)?[*_ ]*(\d{4})[ ]*/[ ]*(\d+)(?:\s*/\s*(EC|EEC))?"
    bare = r"(?i)(Regulation|Directive|Decision)[*_ ]*No?[._ ]*[*_ ]*(\d{4})[\s/]+(\d+)"
    g = lambda p, i: F.regexp_extract(c, p, i)
    tail = F.when(g(full, 5) != "", F.concat(F.lit("/"), g(full, 5))).otherwise("")
    return F.when(g(full, 1) != "", F.concat(g(full, 1), F.lit(" ("), g(full, 2), F.lit(") "), g(full, 3), F.lit("/"), g(full, 4), tail)).when(g(bare, 1) != "", F.concat(g(bare, 1), F.lit(" "), g(bare, 2), F.lit("/"), g(bare, 3)))


def celex(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\b3\d{10}\b", 0), F.lit(""))


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def snippet(c: Column, start: Column | int = 0, length: Column | int | None = None, most: int = 120) -> Column:
    """Slice of a text with blanks collapsed, cut to ``most`` characters; ``start`` counts from 0."""
    start = start if isinstance(start, Column) else F.lit(start)
    part = F.substring(c, start + 1, length if isinstance(length, Column) else F.lit(length if length is not None else 2**30))
    return F.substring(F.trim(F.regexp_replace(part, r"\s+", " ")), 1, most)


_OPEN, _CLOSE = "\u0001", "\u0002"


def raw_tokens(c: Column) -> Column:
    """Words and numbers of a text, instrument numbers and acronyms whole and marked; ``search_term`` makes terms of them."""
    marked = F.regexp_replace(F.translate(text_or_empty(c), _OPEN + _CLOSE, "  "), f"({fixed.INSTRUMENT_SPAN}|{fixed.ACRONYM_SPAN})", f"{_OPEN}$1{_CLOSE}")
    return _all(marked, f"{_OPEN}[^{_CLOSE}]+{_CLOSE}|[A-Za-z]+|\\d+")


def tokenize(c: Column) -> Column:
    """Search terms: instrument numbers and acronyms whole, other words in lower case without stop words and single letters, all numbers."""
    whole = F.transform(raw_tokens(c), lambda t: F.when(~t.startswith(_OPEN), F.lower(t)).otherwise(F.when(t.rlike("^.[0-9]"), F.lower(F.btrim(t, F.lit(_OPEN + _CLOSE)))).otherwise(F.concat(F.lit(_OPEN), F.btrim(t, F.lit(_OPEN + _CLOSE))))))
    stop = F.array(*[F.lit(w) for w in sorted(set(fixed.STOP_WORDS))])
    kept = F.filter(whole, lambda t: t.startswith(_OPEN) | (~F.array_contains(stop, t) & ((F.length(t) > 1) | t.rlike("^[0-9]"))))
    return F.transform(kept, lambda t: F.ltrim(F.translate(t, _OPEN, "")))


_STOP = frozenset(fixed.STOP_WORDS)


def search_term(raw: str) -> str | None:
    """The term that ``tokenize`` makes of one of the ``raw_tokens``, None where it leaves it out. For workers, which look at each distinct token once."""
    t = raw.strip(_OPEN + _CLOSE)
    if raw.startswith(_OPEN) and not t[:1].isdigit():
        return t
    t = t.lower()
    return t if t not in _STOP and (len(t) > 1 or t[:1].isdigit()) else None


def plain_tokens(c: Column, least: int = 3) -> Column:
    """Distinct lower-case runs of letters and digits of at least ``least`` characters."""
    return F.array_distinct(F.filter(_all(F.lower(text_or_empty(c)), "[a-z0-9]+"), lambda t: F.length(t) >= least))


def overlap_score(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(plain_tokens(a), plain_tokens(b)))


def answer_form(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z0-9]+", " "))


def exact_match(a: Column, b: Column) -> Column:
    """1.0 if two answers agree but for case and punctuation, else 0.0; two empty ones agree."""
    return (answer_form(a) == answer_form(b)).cast("double")


def token_f1(a: Column, b: Column) -> Column:
    """F1 of the sets of words of two answers; 0.0 if either has none."""
    words = lambda c: F.array_distinct(F.filter(F.split(answer_form(c), " "), lambda t: t != ""))
    x, y = words(a), words(b)
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0) | (both == 0), 0.0).otherwise(2.0 * both / (F.size(x) + F.size(y)))


def stable_hash(*parts: Column) -> Column:
    return F.sha1(F.concat(*[p.cast("string") for p in parts]))


def doc_of(lineage: Column) -> Column:
    """Document of a lineage: what precedes ':article:', else what precedes the first colon."""
    return F.when(lineage.contains(":article:"), F.substring_index(lineage, ":article:", 1)).otherwise(F.substring_index(lineage, ":", 1))


def article_num_of(lineage: Column) -> Column:
    """Digits of a lineage's article number (its letter is left out); null without one."""
    return F.nullif(F.regexp_extract(lineage, r":article:(\d+)", 1), F.lit("")).cast("int")


def article_refs(c: Column) -> Column:
    """(num, letter) of the articles that a question names; a letter counts if attached or in brackets."""
    raw = F.array_distinct(_all(c, r"(?i)\barticles?\s+(\d+(?:[a-z]\b|\s?\([a-z]\))?)", 1))
    return F.transform(raw, lambda x: F.struct(F.regexp_extract(x, r"^(\d+)", 1).cast("int").alias("num"), F.lower(F.regexp_extract(x, r"([A-Za-z])", 1)).alias("letter")))


def cites_target(answer: Column, doc_id: Column, article: Column) -> Column:
    """Whether an answer names a document (a part of its id of 3 letters or more) or the article."""
    tokens = F.filter(F.split(F.lower(doc_id), "[_ ]+"), lambda t: F.length(t) >= 3)
    low = F.lower(text_or_empty(answer))
    named = F.exists(tokens, lambda t: low.contains(t))
    by_number = F.when(article.isNotNull(), F.concat(F.lit(" "), F.array_join(_all(low, r"\barticle\s+(\d+[a-z]?)", 1), " "), F.lit(" ")).contains(F.concat(F.lit(" "), article.cast("string"), F.lit(" ")))).otherwise(F.lit(False))
    return F.coalesce(named, F.lit(False)) | by_number


def truncate(c: Column, most: int) -> Column:
    """Blanks collapsed; longer texts end in an ellipsis within ``most`` characters."""
    x = F.trim(F.regexp_replace(text_or_empty(c), r"\s+", " "))
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.rtrim(F.substring(x, 1, most - 1)), F.lit("…")))


def node_label(kind: Column, title: Column, term: Column, art_number: Column, lineage: Column, most: int = 80) -> Column:
    """How a node is named to a reader: its title, term or label, else what its place in the structure says."""
    low = F.lower(F.coalesce(kind, F.lit("node")))
    named = F.coalesce(F.nullif(F.trim(term), F.lit("")), F.nullif(F.trim(title), F.lit("")))
    return truncate(F.when((low == "article") & art_number.isNotNull(), F.concat(F.lit("Article "), art_number, F.when(named.isNotNull(), F.concat(F.lit(" "), named)).otherwise(F.lit("")))).otherwise(F.coalesce(named, F.when(low == "preamble", F.lit("Preamble")), F.concat(F.initcap(low), F.lit(" "), F.element_at(F.split(lineage, ":"), -1)), lineage)), most)


def search_text(kind: Column, title: Column, term: Column, art_number: Column, doc_id: Column) -> Column:
    """Text by which a node is embedded, by kind; null for kinds that are not searched."""
    low = F.lower(kind)
    return F.when(low == "term", F.concat_ws(" ", term, doc_id)).when(low == "article", F.concat_ws(" ", F.concat(F.lit("Article "), art_number), title, doc_id)).when(low.isin("preamble", "document", "entity"), F.concat_ws(" ", title, doc_id))


def edge_label(kinds: Column, hop: Column) -> Column:
    """'A;B@2hop' of the kinds on the way; 'seed' at hop 0."""
    return F.when(hop == 0, F.lit("seed")).otherwise(F.concat(F.array_join(kinds, ";"), F.lit("@"), hop.cast("string"), F.lit("hop")))


def clean_html(c: Column) -> Column:
    """Text of an HTML page: breaks and paragraphs become lines, list items dashes, other tags go, entities are resolved."""
    x = text_or_empty(c)
    for pattern, to in ((r"(?i)<br\s*/?>", "\n"), (r"(?i)<p\b[^>]*>", ""), (r"(?i)</p>", "\n"), (r"(?i)<li\b[^>]*>", "- "), (r"(?i)</li>", "\n"), (r"<[^>]+>", "")):
        x = F.regexp_replace(x, pattern, to)
    for entity, to in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(to))
    return F.btrim(F.regexp_replace(x, r"\n{3,}", "\n\n"), F.lit(" \t\r\n"))


def sample_windows(c: Column, n: int = 6, chars: int = 2500) -> Column:
    """[start, end] of up to ``n`` windows: head, one right after (a third in at most), evenly spaced ones, and the tail."""
    size = F.length(c)
    last = F.greatest(size - chars, F.lit(0))
    if n <= 2:
        starts = F.array(F.lit(0), last) if n == 2 else F.array(F.lit(0))
    else:
        second = F.least(F.lit(chars), F.floor(size / 3).cast("int"))
        inner = [F.floor(second + (last - second) * k / (n - 2)).cast("int") for k in range(1, n - 2)]
        starts = F.array(F.lit(0), second, *inner, last)
    kept = F.array_sort(F.array_distinct(F.transform(starts, lambda s: F.least(s, last))))
    return F.when(size > 0, F.transform(kept, lambda s: F.struct(s.alias("start"), F.least(s + chars, size).alias("end"))))


def title_heuristic(c: Column) -> Column:
    """Title among the first 20 lines: a heading with an instrument number, a line that names an instrument, the first fair heading, any fair line."""
    skip = r"(?i)official journal|^\s*L\s*\d+/\d+\b|\bEN\b|\bFR\b|\bDE\b|legislative acts|^\s*[IVX]+\s*$|^\d{1,2}[./]\d{1,2}[./]\d{4}\b|abstract|index terms|^\s*(REGULATIONS|DIRECTIVES|DIRECTIVE ACTS|NETWORK CODES|ANNEXES?)\s*$|^\s*of\s+\d{1,2}\s"
    numbered = r"(?i)\b(REGULATION|DIRECTIVE|DECISION)[\s*_]?\(?[ ]?(EU|EC|EURATOM)?[ )_]*(?:No[.\s_]*)?(\d{4})\s*/\s*(\d+)"
    named = r"(?i)\b(REGULATION|DIRECTIVE|DECISION)\s*\(?(EU|EC|EURATOM)\)?"
    lines = F.slice(F.split(c, "\r?\n"), 1, 20)
    heads = F.transform(F.filter(lines, lambda x: x.rlike(r"^#{1,6}\s+.+$")), lambda x: F.btrim(F.regexp_extract(x, r"^#{1,6}\s+(.+)$", 1), F.lit("*_ |\t")))
    heads = F.filter(heads, lambda x: F.length(x).between(10, 200) & ~x.rlike(skip))
    plain = F.transform(lines, lambda x: F.btrim(x, F.lit("#* _|\t")))
    first = lambda a: F.get(a, F.lit(0))
    return F.coalesce(first(F.filter(heads, lambda x: x.rlike(numbered))), first(F.filter(plain, lambda x: F.length(x).between(15, 160) & ~x.rlike(skip) & x.rlike(named))), first(heads), first(F.filter(plain, lambda x: F.length(x).between(25, 160) & ~x.rlike(r"\.\s") & ~x.rlike(skip))))


def weaken(c: Column) -> Column:
    """The first 'shall' of an obligation becomes 'may', or else the first 'must' 'should'."""
    first = lambda w, to: F.concat(F.substring(c, F.lit(1), F.locate(w, c) - 1), F.lit(to), F.substring(c, F.locate(w, c) + len(w), F.length(c)))
    return F.when(F.locate("shall", c) > 0, first("shall", "may")).when(F.locate("must", c) > 0, first("must", "should"))


def change_number(c: Column, double: bool = False) -> Column:
    """A statement with its first number before a unit halved or doubled (half to even); null without one."""
    p = r"(\d+)(\s*(?:%|per\s+cent|days?|months?|years?|hours?|weeks?|units?|megawatts?|[kMG]W))"
    whole, number = F.regexp_extract(c, p, 0), F.regexp_extract(c, p, 1)
    new = F.bround(number.cast("double") * (2.0 if double else 0.5), 0).cast("long").cast("string")
    at = F.call_function('locate', whole, c)
    return F.when(whole != "", F.concat(F.substring(c, F.lit(1), at - 1), new, F.regexp_extract(c, p, 2), F.substring(c, at + F.length(whole), F.length(c))))


def closeness(a: Column, b: Column) -> Column:
    """1 - |a - b| / max(1, b), within [0, 1]; 1 without an expected value."""
    return F.when(b.isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(F.coalesce(a, F.lit(0)) - b) / F.greatest(F.lit(1), b))))


def lenient_match(found: Column, expected: Column) -> Column:
    """1.0 if one text contains the other but for case and punctuation, or nothing is expected."""
    a, b = answer_form(found), answer_form(expected)
    return F.when(b == "", 1.0).when(a == "", 0.0).otherwise((a.contains(b) | b.contains(a)).cast("double"))


def obligation_sentences(c: Column) -> Column:
    """Sentences of 61 to 599 characters that say shall or must."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda s: F.length(s).between(61, 599) & s.rlike("(?i)shall|must"))
