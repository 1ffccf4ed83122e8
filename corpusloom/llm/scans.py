"""Repair of texts from scanned pages: page furniture, broken words, misread characters."""
from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..keys import norm_key
from ..scale import running_totals, write_table
from .perceptron import BREAKS, CONFUSIONS, CharacterEditor, Perceptron, one_edit

#: Every clean word that occurs LEX_LEAST times is known. Those that are at least one in LEX_SHARE of all words go to all workers (so at
#: most LEX_SHARE entries); a page gets the rarer ones that it may contain by a join.
LEX_SHARE, LEX_LEAST = 200_000, 3
#: A rare word stands for itself unless an edit leads to a word that is this many times as frequent.
FAR_MORE = 1000
#: Outermost lines of a page that may be furniture, at its top and its foot; lines and words of a page that its neighbours see.
TOP_LINES, FOOT_LINES = 3, 4
ZONE_TOP, ZONE_FOOT, ZONE_FIRSTS, ZONE_LASTS = 2, 3, 5, 8
#: Clean texts, at most, from which synthetic pages are made to train the line tagger, and words that train the editor.
TRAIN_TEXTS, TRAIN_WORDS = 500, 2500
#: Corrections a Python worker keeps in memory.
MEMO = 200_000

TAGS = ["body", "header", "page_number", "footnote"]
_ROMAN = re.compile(r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})", re.I)
_DIGITS = str.maketrans({"l": "1", "I": "1", "|": "1", "!": "1", "i": "1", "O": "0", "o": "0", "S": "5", "s": "5", "B": "8", "Z": "2", "z": "2", "b": "6", "g": "9", "q": "9"})
#: Characters of the longest page number, such as "Page 1234 of 12345", without what frames it.
NUMBER_CHARS = 20
FRAME = " \t\r\f-–—_=~*#.,;:[](){}<>/\\'\"«»•·…"
_NUMBER_LINE = re.compile(r"^(?:(?:page|p|pg|seite|s|no)\b\.?\s*)?\W*([0-9lIi|!OoSsBZzbgq]{1,5}|[ivxlcdm]{1,7})\s*(?:(?:of|/|von|sur|de)\s*[0-9lIi|!OoSsBZzbgq]{1,5})?$", re.I)
_NOTE = re.compile(r"^\s*(?:\((\d{1,2})\)|\[(\d{1,2})\]|(\d{1,2})\))\s+\S")
_SIDE = re.compile(r"^\s*[\[(]?\w{1,5}[\])]?\s{2,}(\S.*)$|^\s*(\S.*?)\s{2,}[\[(]?\w{1,5}[\])]?\s*$")


@lru_cache(maxsize=100_000)
def number_value(line: str) -> int | None:
    """The number that a line of nothing but a (possibly misread) page number shows."""
    core = line.strip(FRAME)
    m = _NUMBER_LINE.match(core) if len(core) <= NUMBER_CHARS and not line.rstrip().endswith((".", ";", ":", ",")) else None
    if not m:
        return None
    s = m[1]
    if any(c.isdigit() for c in s) or (len(s) <= 3 and all(c in "lIO|!" for c in s) and len(s) > 1):
        d = s.translate(_DIGITS)
        return int(d) if d.isdigit() else None
    if s and _ROMAN.fullmatch(s):
        v = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
        n = [v[c] for c in s.lower()]
        return sum(-a if a < b else a for a, b in zip(n, [*n[1:], 0]))
    d = s.translate(_DIGITS)
    return int(d) if d.isdigit() else None


@lru_cache(maxsize=100_000)
def skeleton(line: str) -> str:
    """Letters of a line in lower case, a number at either side taken off: what a running title keeps from page to page."""
    m = _SIDE.match(line)
    if m:
        line = m[1] or m[2] or line
    return re.sub(r"[^a-z]+", "", line.lower())


@lru_cache(maxsize=100_000)
def _pairs_of(a: str) -> frozenset[str]:
    return frozenset(a[i : i + 2] for i in range(len(a) - 1))


@lru_cache(maxsize=200_000)
def alike(a: str, b: str) -> float:
    """Share of equal letter pairs of two skeletons."""
    if not a or not b or abs(len(a) - len(b)) > 4:
        return 0.0
    if a == b:
        return 1.0
    x, y = _pairs_of(a), _pairs_of(b)
    return 2 * len(x & y) / max(len(x) + len(y), 1)


@dataclass
class Zone:
    """What the neighbours of a page need of it: its outermost lines, first words of its top and last words of its foot."""

    top: list[str] = field(default_factory=list)
    foot: list[str] = field(default_factory=list)
    firsts: list[str] = field(default_factory=list)
    lasts: list[str] = field(default_factory=list)

    @staticmethod
    def of(text: str) -> "Zone":
        nb = [x for x in text.split("\n") if x.strip()]
        return Zone(nb[:ZONE_TOP], nb[-ZONE_FOOT:], [x.split()[0] for x in nb[:ZONE_FIRSTS]], [x.split()[-1] for x in nb[-ZONE_LASTS:]])


class LineTagger:
    """Perceptron that tags the lines of a page from the top: body, header, page_number or footnote."""

    def __init__(self, common: list[str] = ()):
        self.model = Perceptron()
        self.common = frozenset(common)  # the commonest words, of which titles have few

    def page_facts(self, lines: list[str], near: dict[int, Zone]):
        """(line index, number, note, edge, features) of the lines that are not blank; features are a function, as most lines need none."""
        nb = [i for i, x in enumerate(lines) if x.strip()]
        width = sorted(len(lines[i]) for i in nb)[int(len(nb) * 0.8)] if nb else 0
        text = "\n".join(lines)
        edges = {k: [skeleton(x) for x in z.top + z.foot] for k, z in near.items()}
        values = {k: {v for x in z.top + z.foot if (v := number_value(x)) is not None} for k, z in near.items()}

        def features(k: int, v: int | None, m) -> list[str]:
            i = nb[k]
            line, s = lines[i], lines[i].strip()
            up, down = min(k, 3), min(len(nb) - 1 - k, 9)
            edge = "top" if up < 2 else "foot" if down < 3 else "mid"
            f = [f"up{up}", f"down{min(down, 4)}", f"edge{edge}"]
            if v is not None:
                agree = sum(v + d in values[d] for d in values)
                f += [f"num{edge}", f"num{up}.{min(down, 3)}", f"agree{min(agree, 2)}/{min(len(near), 2)}", f"agree{min(agree, 2)}{edge}", f"agree{min(agree, 2)}/{min(len(near), 4)}{s.isdigit()}", f"plain{s.isdigit()}{edge}", f"plain{s.isdigit()}{min(agree, 2)}"]
                # nearer to the edge there may be a number of the same form
                outer = nb[:k] if up < 2 else nb[k + 1 :]
                f.append(f"outer{any(number_value(lines[j]) is not None for j in outer[-3:]) if edge != 'mid' else 'mid'}")
            sk = skeleton(line)
            same = [max([alike(sk, o) for o in e], default=0.0) for e in edges.values()] if edge != "mid" and len(sk) > 5 else []
            best, many = max(same, default=0.0), sum(x > 0.7 for x in same)
            short = len(s) < 0.85 * width
            stop = s[-1] in ".;:,!?" or s[-1] in BREAKS
            gap_below = i + 1 >= len(lines) or not lines[i + 1].strip()
            gap_above = i == 0 or not lines[i - 1].strip()
            lower_next = k + 1 < len(nb) and lines[nb[k + 1]].strip()[:1].islower()
            title = s[:1].isupper() and not stop and short and v is None
            side = bool(_SIDE.match(line)) and not line.startswith("   ")
            words = re.findall(r"[a-z]+", s.lower())
            plain = sum(w in self.common for w in words)
            f += [f"common{min(plain, 3)}{edge}", f"common{min(plain, 3)}{title}{many > 0}{edge}", f"ends{bool(words) and words[-1] in self.common}{edge}", f"starts{bool(words) and words[0] in self.common}{title}{edge}"]
            f += [f"like{int(best * 5)}{edge}", f"many{min(many, 2)}{edge}", f"title{title}{edge}", f"title{title}{edge}{many > 0}", f"title{title}{edge}{gap_below}{gap_above}", f"title{title}{up}{lower_next}", f"lone{many > 0}{min(len(near), 3)}{title}{edge}", f"upper{s.isupper() and v is None}{edge}", f"stop{stop}{edge}", f"side{side}{edge}{title}"]
            if m:
                mark = m[1] or m[2] or m[3]
                cited = len(re.findall(rf"(?<=\S)\s?[(\[]{mark}[)\]]", text)) > 0
                f += ["note", f"note{cited}", f"note{down < 9}", f"note{cited}{gap_above}", f"noteafter{edge}"]
            f += [f"indent{min(len(line) - len(line.lstrip()), 4)}", f"gap{gap_above}{min(down, 4)}"]
            return f

        for k, i in enumerate(nb):
            s = lines[i].strip()
            v = number_value(s) if len(s.strip(FRAME)) <= NUMBER_CHARS else None
            m = _NOTE.match(s) if s[0] in "([" or s[0].isdigit() else None
            yield i, v is not None, m is not None, k < TOP_LINES or k >= len(nb) - FOOT_LINES, (lambda k=k, v=v, m=m: features(k, v, m))

    @staticmethod
    def with_past(f: list[str], before: str, gap: bool) -> list[str]:
        x = f"{before}{'|' if gap else '.'}"
        note = "n" if "note" in f else ""
        num = "v" if any(y.startswith("agree") for y in f) else ""
        return f + ["b" + x, "b" + x + note + num, "b" + x + f[1]]

    @staticmethod
    def possible(number: bool, note: bool, edge: bool, before: str, gap: bool) -> list[str]:
        """Tags that a line can have: numbers and titles stand near the page's edges, a note has a mark or goes on from one."""
        note = note or (before == "footnote" and not gap and not number)
        return ["body"] + (["page_number" if number else "header"] if edge else []) + (["footnote"] if note else [])

    def tag(self, lines: list[str], near: dict[int, Zone]) -> dict[int, str]:
        out: dict[int, str] = {}
        before, last = "start", -1
        for i, number, note, edge, features in self.page_facts(lines, near):
            tags = self.possible(number, note, edge, before, i - last > 1)
            before = self.model.best(self.with_past(features(), before, i - last > 1), tags) if len(tags) > 1 else "body"
            out[i], last = before, i
        return out

    def train(self, pages: list[tuple[list[str], dict[int, Zone], dict[int, str]]], rounds: int = 5, seed: int = 3) -> "LineTagger":
        rng = random.Random(seed)
        facts = [([(i, number, note, edge, features() if edge or note or tags[i] == "footnote" else None) for i, number, note, edge, features in self.page_facts(lines, near)], tags) for lines, near, tags in pages]
        for r in range(rounds):
            rng.shuffle(facts)
            for page, tags in facts:
                before, last = "start", -1
                for i, number, note, edge, f in page:
                    can = self.possible(number, note, edge, before, i - last > 1)
                    guess = "body"
                    if f is not None and len(can) > 1:
                        x = self.with_past(f, before, i - last > 1)
                        guess = self.model.best(x, can)
                        self.model.update(tags[i], guess, x)
                    before, last = (tags[i] if r < 2 else guess), i
        self.model.average()
        return self


def synthetic_documents(texts: list[str], seed: int = 11) -> list[tuple[list[str], dict[int, Zone], dict[int, str]]]:
    """Labelled pages made from clean texts: lines, the neighbours' zones, the tag of each line that is not blank."""
    rng = random.Random(seed)
    out = []
    sentences = [s for t in texts for s in re.split(r"(?<=[.;])\s+", re.sub(r"[#*|]+", " ", t)) if 20 < len(s) < 300]
    words_ = [re.findall(r"[A-Za-z]+", s) for s in sentences]
    titles = [" ".join(w[at : at + n]) for w in words_ for at, n in [(rng.randint(0, 3), rng.randint(1, 6))] if w[at : at + n]] or ["General report"]
    noise = lambda s: "".join(rng.choice([b for a, b in CONFUSIONS if a == c] or [c]) if rng.random() < 0.03 else c for c in s)

    def number(style: int, n: int, last: int) -> str:
        roman = "".join(x * k for x, k in zip(("x", "ix", "v", "iv", "i"), (n // 10, n % 10 == 9, n % 10 in (5, 6, 7, 8), n % 10 == 4, n % 10 % 5 if n % 10 not in (4, 9) else 0)))
        s = [f"{n}", f"- {n} -", f"[{n}]", f"Page {n} of {last}", f"p. {n}", f"{n}/{last}", roman, f"({n})", f"Page {n}"][style]
        if rng.random() < 0.12:
            s = re.sub("1", "l", s) if rng.random() < 0.5 else re.sub("0", "O", s)
        return " " * rng.choice([0, 0, 0, 8, 20]) + s

    for _ in range(max(40, min(len(texts), TRAIN_TEXTS)) if sentences else 0):
        width, n_pages, offset = rng.randint(58, 82), rng.choice([1, 2, 2, 3, 4, 6, 10]), rng.choice([0, 0, 0, 4, 60, 117])
        style, at_foot, numbered, indent = rng.choice([0, 0, 1, 2, 3, 4, 5, 6, 8]), rng.random() < 0.6, rng.random() < 0.85, rng.random() < 0.25
        number_first = rng.random() < 0.5
        style_of = rng.choice([str.capitalize, str.capitalize, str.title])
        title, other = (style_of(rng.choice(titles)) + (rng.choice([", ", ": ", " - ", " – ", "; ", " | "]) + style_of(rng.choice(titles)) if rng.random() < 0.3 else "") for _ in range(2))
        headed, two, foot_title, shout, beside = rng.random() < 0.75, rng.random() < 0.25, rng.random() < 0.35, rng.random() < 0.25, rng.random() < 0.2
        noted, square, spaced, first_too = rng.random() < 0.5, rng.random() < 0.3, rng.random() < 0.6, rng.random() < 0.3
        pages = []
        for p in range(1, n_pages + 1):
            body: list[tuple[str, str]] = []
            line, notes = "", 0
            for _ in range(rng.randint(2, 6)):
                words = " ".join(rng.choice(sentences) for _ in range(rng.randint(1, 4))).split()
                if noted and rng.random() < 0.5 and notes < 3:
                    notes += 1
                    words[-1] += f"[{notes}]" if square else f"({notes})"
                if rng.random() < 0.1:
                    words += f"{rng.choice(sentences)[:20]} {title}.".split()
                if rng.random() < 0.25:
                    words.insert(0, rng.choice(["1.", "(a)", "(ii)", "2.", "-", "(b)"]))
                line = "   " if indent else ""
                for w in words:
                    if len(line) + len(w) + 1 > width:
                        body.append((line, "body"))
                        line = ""
                    line += (" " if line.strip() else "") + w
                body.append((line, "body"))
                if not indent:
                    body.append(("", ""))
            if rng.random() < 0.7:  # the page breaks inside a paragraph
                body = body[rng.randint(0, 1) : max(4, len(body) - rng.randint(1, 3))]
            while body and not body[-1][0]:
                body.pop()
            if rng.random() < 0.2:  # numbers of a list or a table
                at = rng.choice([0, len(body) // 2, len(body) // 2, len(body)])
                body[at:at] = [("", "")] * (at > 0) + [(str(rng.randint(2, 400)), "body") for _ in range(rng.randint(1, 3))] + [("", "")]
            foot: list[tuple[str, str]] = []
            for k in range(1, notes + 1):
                foot.append(((" " * rng.choice([0, 0, 1])) + (f"[{k}] " if square else f"({k}) ") + rng.choice(["See ", "Cf. ", ""]) + rng.choice(sentences)[: width - 12].rstrip(".,") + rng.choice([";", ".", ""]), "footnote"))
                if rng.random() < 0.4:
                    foot.append((rng.choice(["as last amended by ", "and "]) + rng.choice(sentences)[: width // 2].lower() + ".", "footnote"))
            num = [(number(style, p + offset, n_pages + offset), "page_number")] if numbered and rng.random() < 0.95 else []
            name = noise(other if two and p % 2 else title)
            name = name.upper() if shout else name
            head = []
            if headed and (p > 1 or first_too):
                if beside and numbered and style in (0, 1, 2):
                    name, num = (f"{p + offset}    {name}" if p % 2 else f"{name}    {p + offset}"), []
                head = [(name, "header")]
            gap = [("", "")] if spaced and rng.random() < 0.8 else []
            top = (head if not foot_title else []) + (num if not at_foot else [])
            low = (head if foot_title else []) + (num if at_foot else [])
            if number_first:
                top, low = top[::-1], low[::-1]
            pages.append((top + (gap if top else []) + body + (gap if rng.random() < 0.7 else []) + foot + (gap if foot and rng.random() < 0.5 else []) + low))
        texts_ = ["\n".join(x for x, _ in p) for p in pages]
        for p, page in enumerate(pages):
            near = {d: Zone.of(texts_[p + d]) for d in (-2, -1, 1, 2) if 0 <= p + d < len(pages)}
            lines = [x for x, _ in page]
            out.append((lines, near, {i: t for i, (x, t) in enumerate(page) if x.strip()}))
    return out


_EDGE = re.compile(r"^[\[({\"'„“”«‘]*(.*?)[.,;:)\]}\"'“”»’…?]*$", re.S)
_REFS = re.compile(r"(?:[.,;:]?[(\[]\d{1,2}[)\]])+[.,;:]?$")
_ENUM = re.compile(r"^[(\[]?(?:[a-zA-Z]|[ivxIVX]{1,5}|\d{1,3}[a-z]?)[)\].]+[.,;:]?$")
_MIXED_OK = re.compile(r"^\d+(?:st|nd|rd|th|[a-hj-k])?$")
_NUMERIC = re.compile(r"^[0-9lIO|!oSBZ]+$")


class Repairer:
    """Everything a worker needs: lexicon, tagger, editor; corrections are remembered."""

    def __init__(self, lex: dict[str, int], tagger: LineTagger, editor: CharacterEditor):
        self.lex, self.tagger, self.editor = lex, tagger, editor
        self.memo: dict[str, tuple[str, list[int]] | None] = {}
        self.known: dict[str, list[tuple[str, int]]] = {}
        self.plain: set[str] = set()  # tokens of which nothing is to be known
        self.prefixes: set[str] | None = None
        self._heads: set[str] | None = None

    def fix(self, word: str) -> tuple[str, list[int]] | None:
        """(right form, places of wrong characters) of a word that no lexicon has, or None if no edit leads to a known word."""
        if word in self.memo:
            return self.memo[word]
        if self.prefixes is None:
            self.prefixes = {w[:i] for w in self.lex if "-" not in w for i in range(len(w) + 1)}
        out = None
        digits = sum(c.isdigit() for c in word)
        if digits and 2 * digits >= len(word) and _NUMERIC.match(word):
            out = self.editor.edits(word, lambda s: not s or s.isdigit(), str.isdigit)
        elif len(word) > 1:
            low, most = word.lower(), 1 + (len(word) - 1) // 5  # one edit for every five characters begun
            out = self.editor.edits(low, self.prefixes.__contains__, self.lex.__contains__, most=most)
            if out is None and low != word:  # capitals that were read for digits or small letters
                out = self.editor.edits(word, lambda s: s.lower() in self.prefixes, lambda s: s.lower() in self.lex, most=most)
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[word] = out
        return out

    def heads(self) -> set[str]:
        """First parts of the lexicon's hyphenated words."""
        if self._heads is None:
            self._heads = {w.rsplit("-", 1)[0].rsplit("-", 1)[-1] for w in self.lex if "-" in w}
        return self._heads

    def parts(self, token: str) -> list[tuple[str, int]]:
        """``unknown_parts`` of a token, remembered."""
        out = self.known.get(token)
        if out is None:
            if len(self.known) >= MEMO:
                self.known.clear()
            out = self.known[token] = self.unknown_parts(token)
            if not out and token[-1] not in BREAKS:
                if len(self.plain) >= MEMO:
                    self.plain.clear()
                self.plain.add(token)
        return out

    def unknown_parts(self, token: str) -> list[tuple[str, int]]:
        """Words and numbers of a token that are to be known, with their places; list marks, note marks and known words are left out."""
        if _ENUM.match(token):
            return []
        token_ = _REFS.sub("", token)
        m = _EDGE.match(token_)
        core, at = m[1], m.start(1)
        if at and token_[at - 1] == "(" and ")" not in token_ and core.lower() not in self.lex and not any(p in self.lex for p in re.split(r"[-/]", core.lower())):
            core, at = token_[at - 1 :].rstrip(".,;:"), at - 1  # a bracket may be a misread letter
        out, i = [], 0
        for part in re.split(r"([-‐‑/–—])", core):
            if part and part not in "-‐‑/–—":
                w = part.strip("\xad¬").removesuffix("'s").removesuffix("’s")
                bare = w.rstrip("!|)(") if w.rstrip("!|)(").lower() in self.lex else w
                low = bare.lower()
                if len(bare) > 1 and low not in self.lex and not _MIXED_OK.match(bare) and any(c.isalnum() for c in bare):
                    out.append((bare, at + i))
            i += len(part)
        return out

    def fix_here(self, word: str, rare: dict[str, tuple[int | None, str | None]]) -> tuple[str, list[int]] | None:
        """``fix`` on a page with the rare words ``rare``: such a word is right unless it would become one that is FAR_MORE frequent."""
        out = self.fix(word)
        n, other = rare.get(word.lower(), (None, None))
        if n is not None and not (out and self.lex.get(out[0].lower(), 0) >= FAR_MORE * n):
            return None
        return out or ((other, [i for i in range(len(word)) if word[i : i + 1].lower() != other[i : i + 1]]) if other else None)

    def page(self, text: str | None, near: dict[int, Zone], rare: dict[str, tuple[int | None, str | None]] | None = None, with_text: bool = True) -> tuple[list[tuple[int, str]], list[str], bool]:
        """(line number, kind) of all noise of a page; its paragraphs (none without ``with_text``); whether the last goes on on the next page.

        ``rare``: of words on this page that the lexicon lacks, how often they occur in clean texts, or the rare word that
        one confusion turned into them.
        """
        rare = rare or {}
        if not text or not text.strip():
            return [], [], False
        lines = text.split("\n")
        tags = self.tagger.tag(lines, near)
        found = [(i + 1, t) for i, t in tags.items() if t != "body"]
        body = [i for i, t in tags.items() if t == "body"]
        tokens = {i: lines[i].split() for i in body}
        repaired = {i: list(tokens[i]) for i in body}
        bad: set[int] = set()
        joined: dict[int, str] = {}

        def end_word(token: str) -> tuple[str, str] | None:
            return (_EDGE.match(token[:-1])[1].lower(), token[-1]) if len(token) > 1 and token[-1] in BREAKS and token[-2].isalnum() | (token[-2] in "|!(") else None

        def first_word(token: str) -> str:
            return _EDGE.match(_REFS.sub("", token))[1].lower()

        def link(a: str, b: str, mark: str, edit: bool = True) -> tuple[str, list[int], int]:
            """Operation between two halves, places of wrong characters, and where the second half begins."""
            left, right = a.rsplit("-", 1)[-1], b.split("-", 1)[0]
            op = self.editor.join(a, b, mark, self.lex)
            whole = left + right
            if op == "join" and whole in self.lex:
                return "join", [], len(left)
            if op == "hyphen" or (left in self.lex and right in self.lex and mark == "-"):
                return "hyphen", [], len(left)
            if whole in self.lex or rare.get(whole, (None,))[0] is not None:
                return "join", [], len(left)
            fixed = self.fix_here(whole, rare) if edit and right[:1].isalpha() or right[:1] in "|!(01569" else None
            if fixed and not any(c.isdigit() for c in fixed[0]):
                return "join", fixed[1], len(left)
            return "open", [], len(left)

        skip_first: dict[int, list[tuple[str, list[int]]]] = {}
        skip: set[tuple[int, str]] = set()
        for n, i in enumerate(body):
            e = end_word(tokens[i][-1])
            if not e:
                continue
            if n + 1 < len(body):
                nxt = [first_word(tokens[body[n + 1]][0])]
            else:
                nxt = [first_word(x) for x in near[1].firsts] if 1 in near else []
            choice = ("open", [], 0)
            for w, edit in [(w, edit) for edit in ((True,) if len(nxt) == 1 else (False, True)) for w in nxt]:
                if choice[0] != "open":
                    break
                got = link(e[0], w, e[1], edit)
                if got[0] == "join" and (choice[0] != "join" or len(got[1]) < len(choice[1])):
                    choice = got
                elif got[0] == "hyphen" and choice[0] == "open":
                    choice = got
            op, places, cut = choice
            if op == "open" and n + 1 == len(body) and e[0].isalpha() and e[0] not in self.heads():
                op = "join"  # what follows cannot be read; half a word is left, and no compound begins with it
            if op == "join":
                found.append((i + 1, "hyphen"))
                skip.add((i, "last"))
                if any(p < cut for p in places):
                    bad.add(i)
                if n + 1 < len(body):
                    skip.add((body[n + 1], "first"))
                    if any(p >= cut for p in places):
                        bad.add(body[n + 1])
            joined[i] = op
            if op == "join" and n + 1 < len(body):
                left, right = e[0].rsplit("-", 1)[-1], first_word(tokens[body[n + 1]][0]).split("-", 1)[0]
                if places and (f := self.fix_here(left + right, rare)):
                    head, rest = tokens[i][-1][: len(tokens[i][-1]) - 1 - len(left)], tokens[body[n + 1]][0][len(right) :]
                    repaired[i][-1] = head + _like(f[0], tokens[i][-1][len(head) :])
                    repaired[body[n + 1]][0] = rest
                else:
                    repaired[i][-1] = tokens[i][-1][:-1]
        # the first word of the page may end one that began on the page before
        if body and -1 in near:
            w = first_word(tokens[body[0]][0])
            for x in reversed(near[-1].lasts):
                e = end_word(x)
                if not e:
                    continue
                op, places, cut = link(e[0], w, e[1])
                if op == "join":
                    skip.add((body[0], "first"))
                    if any(p >= cut for p in places):
                        bad.add(body[0])
                    break
        for i in body:
            if self.plain.issuperset(tokens[i]):
                continue
            last = len(tokens[i]) - 1
            for k, token in enumerate(tokens[i]):
                t = token
                if k == last and t[-1:] and t[-1] in BREAKS and len(t) > 1:
                    t = t[:-1]
                ps = self.parts(t)
                if k == 0 and (i, "first") in skip and ps and ps[0][1] <= len(t) - len(t.lstrip("([\"'")):
                    ps = ps[1:]
                if k == last and ((i, "last") in skip or joined.get(i) == "open"):
                    ps = [p for p in ps if p[1] + len(p[0]) < len(t)]
                new = repaired[i][k]
                for w, at in ps:
                    f = self.fix_here(w, rare)
                    if f:
                        bad.add(i)
                        new = new.replace(w, _like(f[0], w), 1)
                repaired[i][k] = new
        found += [(i + 1, "misread") for i in bad]
        return sorted(set(found)), *(self._paragraphs(lines, body, repaired, joined, tags) if with_text else ([], False))

    @staticmethod
    def _paragraphs(lines, body, repaired, joined, tags) -> tuple[list[str], bool]:
        out: list[str] = []
        before = None
        for i in body:
            line = " ".join(x for x in repaired[i] if x)
            fresh = before is None or any(not lines[j].strip() for j in range(before + 1, i)) or lines[i].startswith("   ")
            if before is not None and joined.get(before) in ("join", "hyphen"):
                out[-1] += ("" if joined[before] == "join" or out[-1][-1:] == "-" else "-") + line
            elif fresh:
                out.append(line)
            else:
                out[-1] += " " + line
            before = i
        ends = bool(out) and not re.search(r"[.;:!?](?:[(\[]\d{1,2}[)\]])*$", out[-1])
        return out, ends


def _like(word: str, shape: str) -> str:
    return word.upper() if shape.isupper() and len(shape) > 1 else word.capitalize() if shape[:1].isupper() else word


def word_counts(chunks: DataFrame) -> tuple[DataFrame, int]:
    """(w, n) of the words of the clean chunks (no page_no) that occur LEX_LEAST times, and the count from which a word goes to all workers.

    Hyphenated words count whole and in parts. Letters in brackets, truncated and coded strings are no words.
    """
    x = chunks.filter("page_no is null and text is not null").select(F.explode(F.split(F.lower("text"), "\\s+")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    x = x.filter(~F.col("w").rlike("^[(\\[].[)\\]]")).select(F.regexp_extract("w", "^[(\\[\"'„“«]*(\\p{L}+(?:-\\p{L}+)*)[.,;:)\\]\"'“”»?!]*$", 1).alias("w"), "n").filter("w != ''")
    forms = F.when(F.col("w").contains("-"), F.concat(F.array("w"), F.split("w", "-"))).otherwise(F.array("w"))
    counts, _ = write_table(x.select(F.explode(forms).alias("w"), "n").groupBy("w").agg(F.sum("n").alias("n")), "lexicon")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.filter(F.col("n") >= LEX_LEAST), max(LEX_LEAST, -(-total // LEX_SHARE))


def lexicon(chunks: DataFrame) -> dict[str, int]:
    """The words that go to all workers, with their counts; a bounded number (see LEX_SHARE), whatever the corpus holds."""
    counts, least = word_counts(chunks)
    return {r["w"]: r["n"] for r in counts.filter(F.col("n") >= least).collect()}


@dataclass
class Trained:
    """What ``train`` learns: the repairer, and the words that are known but too rare for all workers (None: there can be none)."""

    repairer: Repairer
    tail: DataFrame | None = None


def train(chunks: DataFrame) -> Trained:
    """Lexicon and models from the clean chunks; the labelled samples are bounded by TRAIN_TEXTS and TRAIN_WORDS."""
    counts, least = word_counts(chunks)
    lex = {r["w"]: r["n"] for r in counts.filter(F.col("n") >= least).collect()}
    some = chunks.filter("page_no is null and length(text) between 200 and 20000").select("chunk_id", "text").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(TRAIN_TEXTS).collect()
    words = [w for w in lex if "-" not in w and len(w) > 1]
    words = sorted(words, key=lambda w: (-lex[w], w))[:TRAIN_WORDS]
    years = [str(y) for y in range(2000, 2060)] + [str(n) for n in range(10, 130)]
    editor = CharacterEditor().train(words + years, lex, TRAIN_WORDS)
    tagger = LineTagger(sorted(lex, key=lambda w: (-lex[w], w))[:40]).train(synthetic_documents([r["text"] for r in some]))
    return Trained(Repairer(lex, tagger, editor), counts.filter(F.col("n") < least) if least > LEX_LEAST else None)


def _variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(w, v, v == w) for w in pdf["w"] for v in {w} | one_edit(w)]
        yield pd.DataFrame(rows, columns=["w", "v", "own"])


def rare_words(pages: DataFrame, trained: Trained) -> DataFrame:
    """(doc_key, page_no, w, n, other): for each page, its words that are beyond the lexicon of all workers but known, or one confusion from such a word.

    Distinct words are looked up once, in all their forms; words broken at a line's end count in one piece as well.
    """
    spark = pages.sparkSession
    head = spark.createDataFrame([(w,) for w in trained.repairer.lex], "w string")  # bounded: LEX_SHARE words
    marked = F.split(F.regexp_replace(F.lower("text"), f"[{BREAKS}][ \\t]*\\n\\s*", "\x01"), "[^\\p{L}\\p{N}|!(\x01]+")
    token = F.col("t")
    words = F.when(token.contains("\x01"), F.concat(F.array(F.translate(token, "\x01", "")), F.split(token, "\x01"))).otherwise(F.array(token))
    on_page = pages.filter("text is not null").select("doc_key", "page_no", F.explode(F.array_distinct(marked)).alias("t")).select("doc_key", "page_no", F.explode(words).alias("w")).select("doc_key", "page_no", F.rtrim("w", F.lit("!|(")).alias("w"))
    on_page, _ = write_table(on_page.filter("length(w) > 1 and not w rlike '^[0-9]+$'").join(F.broadcast(head), "w", "left_anti"), "unknown")
    forms = on_page.select("w").distinct().mapInPandas(_variants, "w string, v string, own boolean")
    hits = forms.join(trained.tail.select(F.col("w").alias("v"), "n"), "v").groupBy("w").agg(F.max(F.when(F.col("own"), F.col("n"))).alias("n"), F.max_by("v", F.struct("n", "v")).alias("other"))
    return on_page.join(hits, "w").select("doc_key", "page_no", "w", "n", "other")


def _zone(text: Column) -> Column:
    blank = F.lit(" \t\r")
    lines = F.split(F.btrim(text, F.lit(" \t\r\n")), "\\n\\s*")
    end = lambda k: F.greatest(F.size(lines) - k + 1, F.lit(1))
    cut = lambda a: F.transform(a, lambda x: F.rtrim(x, blank))
    firsts = F.transform(F.slice(lines, 1, ZONE_FIRSTS), lambda x: F.substring_index(F.translate(x, "\t\r", "  "), " ", 1))
    lasts = F.transform(F.slice(lines, end(ZONE_LASTS), F.lit(ZONE_LASTS)), lambda x: F.substring_index(F.rtrim(F.translate(x, "\t\r", "  ")), " ", -1))
    return F.struct(cut(F.slice(lines, 1, ZONE_TOP)).alias("top"), cut(F.slice(lines, end(ZONE_FOOT), F.lit(ZONE_FOOT))).alias("foot"), firsts.alias("firsts"), lasts.alias("lasts"))


def pages_with_neighbours(chunks: DataFrame, trained: Trained) -> DataFrame:
    """Pages with the zones of the two pages before and after (of several scans of a neighbour the latest serves), and their rare words.

    Neighbours and words meet the pages by (doc_id, page_no) in one join, so a document of any number of pages is spread
    over all tasks and texts are shuffled once. Scans of one page share their rare words; a page without doc_id has its own.
    """
    at = F.coalesce("ingested_at", F.lit("0001-01-02").cast("timestamp"))
    pages = chunks.filter("page_no is not null and chunk_id is not null").select("chunk_id", norm_key(F.col("doc_id")).alias("doc_id"), "page_no", "text", at.alias("at"))
    pages = pages.withColumn("doc_key", F.coalesce("doc_id", F.concat(F.lit("\x01"), F.col("chunk_id").cast("string"))))
    some = pages.filter("text is not null and doc_id is not null").select("doc_key", "page_no", "at", "chunk_id", _zone(F.col("text")).alias("zone")).groupBy("doc_key", "page_no").agg(F.max_by("zone", F.struct("at", "chunk_id")).alias("zone"))
    near = some.select("doc_key", F.explode(F.array(*[F.lit(k) for k in (-2, -1, 1, 2)])).alias("d"), (F.col("page_no") - F.col("d")).alias("page_no"), "zone")
    near = near.select("doc_key", "page_no", F.struct("d", "zone.top", "zone.foot", "zone.firsts", "zone.lasts").alias("z"), F.lit(None).cast(RARE).alias("r"))
    if trained.tail is not None:
        near = near.unionByName(rare_words(pages, trained).select("doc_key", "page_no", F.lit(None).cast(near.schema["z"].dataType).alias("z"), F.struct("w", "n", "other").cast(RARE).alias("r")))
    side = near.groupBy("doc_key", "page_no").agg(F.collect_list("z").alias("near"), F.collect_set("r").alias("rare"))
    return pages.join(side, ["doc_key", "page_no"], "left").drop("doc_key")


RARE = "struct<w:string,n:bigint,other:string>"


def _rare(rows) -> dict[str, tuple[int | None, str | None]]:
    return {r["w"]: (r["n"], r["other"]) for r in (rows if rows is not None else [])}


def _near(rows) -> dict[int, Zone]:
    return {int(r["d"]): Zone(*([x for x in (r[k] if r[k] is not None else []) if x is not None] for k in ("top", "foot", "firsts", "lasts"))) for r in (rows if rows is not None else [])}


def page_noise(chunks: DataFrame, trained: Trained | None = None) -> DataFrame:
    """(chunk_id, line_no, noise) of all pages: header, page_number, footnote, hyphen, misread.

    Lines count from 1 and blank lines count; null and empty pages have no noise. Of rows sent again (same chunk_id) the
    latest counts; other scans of a page are pages of their own. Rows without chunk_id are left out, rows without doc_id
    have no neighbours.
    """
    spark = chunks.sparkSession
    trained = trained or train(chunks)
    shared = spark.sparkContext.broadcast(trained.repairer)  # bounded: LEX_SHARE words, models over them

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = shared.value
        for pdf in batches:
            rows = [(c, a, n, k) for c, a, t, z, w in zip(pdf["chunk_id"], pdf["at"], pdf["text"], pdf["near"], pdf["rare"]) for n, k in r.page(t, _near(z), _rare(w), with_text=False)[0]]
            yield pd.DataFrame(rows, columns=["chunk_id", "at", "line_no", "noise"])

    rows = pages_with_neighbours(chunks, trained).select("chunk_id", F.unix_micros("at").alias("at"), "text", "near", "rare").mapInPandas(run, "chunk_id long, at long, line_no long, noise string")
    last = chunks.filter("page_no is not null").select("chunk_id", F.unix_micros(F.coalesce("ingested_at", F.lit("0001-01-02").cast("timestamp"))).alias("at")).groupBy("chunk_id").agg(F.max("at").alias("at"))
    return rows.join(last, ["chunk_id", "at"]).select("chunk_id", "line_no", "noise").distinct()


def running_text(chunks: DataFrame, trained: Trained | None = None) -> DataFrame:
    """(doc_id, para_no, page_no, text): the repaired paragraphs of each scanned document in reading order.

    Of several scans of a page the latest serves. A paragraph that a page break cuts is put together again; page_no is
    where it begins. Furniture is left out, broken words are joined, wrong characters replaced.
    """
    spark = chunks.sparkSession
    trained = trained or train(chunks)
    shared = spark.sparkContext.broadcast(trained.repairer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = shared.value
        for pdf in batches:
            rows = []
            for d, p, t, z, w in zip(pdf["doc_id"], pdf["page_no"], pdf["text"], pdf["near"], pdf["rare"]):
                _, paras, ends = r.page(t, _near(z), _rare(w))
                rows += [(d, p, k, x, ends and k == len(paras) - 1) for k, x in enumerate(paras)]
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "part", "text", "goes_on"])

    pages = pages_with_neighbours(chunks, trained).filter("doc_id is not null")
    newest = pages.groupBy("doc_id", "page_no").agg(F.max(F.struct("at", "chunk_id")).alias("m")).select("doc_id", "page_no", "m.at", "m.chunk_id")
    pages = pages.join(newest, ["doc_id", "page_no", "at", "chunk_id"], "left_semi").dropDuplicates(["doc_id", "page_no"])
    parts = pages.select("doc_id", "page_no", "text", "near", "rare").mapInPandas(run, "doc_id string, page_no int, part int, text string, goes_on boolean")
    parts, _ = write_table(parts, "parts")
    opened = parts.filter("goes_on").select("doc_id", (F.col("page_no") + 1).alias("page_no"), F.lit(0).alias("part"), F.lit(0).alias("starts"))
    x = parts.join(opened, ["doc_id", "page_no", "part"], "left").withColumn("starts", F.coalesce("starts", F.lit(1)))
    x = running_totals(x, ["doc_id"], ["page_no", "part"], "starts", "before")
    x = x.withColumn("para_no", F.greatest(F.col("before") + F.col("starts"), F.lit(1)))
    x = x.groupBy("doc_id", "para_no").agg(F.min("page_no").alias("page_no"), F.sort_array(F.collect_list(F.struct("page_no", "part", "text"))).alias("p"))
    glued = F.aggregate("p.text", F.lit(""), lambda a, b: F.when(a == "", b).when(a.rlike(f"\\p{{L}}[{BREAKS}]$"), F.concat(F.regexp_replace(a, f"[{BREAKS}]$", ""), b)).otherwise(F.concat(a, F.lit(" "), b)))
    return x.select("doc_id", F.col("para_no").cast("long").alias("para_no"), "page_no", glued.alias("text"))
