"""An averaged perceptron over sparse string features, and a character editor built on it."""
from __future__ import annotations

import random
from collections import defaultdict


class Perceptron:
    """Multi-class averaged perceptron; weights are kept by feature, then by label."""

    def __init__(self):
        self.w: dict[str, dict[str, float]] = {}
        self._sum: dict[tuple[str, str], float] = defaultdict(float)
        self._at: dict[tuple[str, str], int] = defaultdict(int)
        self.steps = 0

    def scores(self, features: list[str], labels) -> dict[str, float]:
        out = dict.fromkeys(labels, 0.0)
        for f in features:
            own = self.w.get(f)
            if own:
                for y, v in own.items():
                    if y in out:
                        out[y] += v
        return out

    def best(self, features: list[str], labels) -> str:
        s = self.scores(features, labels)
        return max(labels, key=lambda y: (s[y], y))

    def update(self, truth: str, guess: str, features: list[str]) -> None:
        self.steps += 1
        if truth == guess:
            return
        for f in features:
            own = self.w.setdefault(f, {})
            for y, d in ((truth, 1.0), (guess, -1.0)):
                k = (f, y)
                self._sum[k] += (self.steps - self._at[k]) * own.get(y, 0.0)
                self._at[k] = self.steps
                own[y] = own.get(y, 0.0) + d

    def average(self) -> "Perceptron":
        """Replaces the weights by their mean over all steps and forgets the training state."""
        for f, own in self.w.items():
            for y in list(own):
                k = (f, y)
                v = (self._sum[k] + (self.steps - self._at[k]) * own[y]) / max(self.steps, 1)
                if abs(v) > 1e-3:
                    own[y] = round(v, 4)
                else:
                    del own[y]
        self.w = {f: own for f, own in self.w.items() if own}
        self._sum, self._at = defaultdict(float), defaultdict(int)
        return self


# fixed values: usual confusions of print recognition, clean text -> what is read
CONFUSIONS = [
    ("e", "c"), ("e", "f"), ("c", "e"), ("c", "("), ("a", "o"), ("o", "a"), ("o", "0"), ("l", "1"), ("l", "|"), ("l", "i"), ("i", "l"), ("i", "!"), ("i", "1"), ("i", "j"),
    ("t", "f"), ("t", "l"), ("f", "t"), ("h", "b"), ("b", "h"), ("b", "6"), ("g", "9"), ("g", "q"), ("q", "g"), ("s", "5"), ("s", "8"), ("z", "2"), ("y", "v"), ("v", "y"),
    ("n", "ri"), ("n", "u"), ("u", "n"), ("u", "ii"), ("m", "rn"), ("m", "nn"), ("w", "vv"), ("d", "cl"), ("cl", "d"), ("li", "h"), ("rn", "m"), ("ri", "n"), ("fi", "h"), ("k", "lc"),
    ("0", "O"), ("0", "o"), ("1", "l"), ("1", "I"), ("1", "|"), ("1", "!"), ("5", "S"), ("8", "B"), ("2", "Z"), ("6", "b"), ("9", "g"), ("9", "q"),
]
_PAIRS = {(b, a) for a, b in CONFUSIONS if len(b) == 2}
_TWO = {b for b, _ in _PAIRS}


def corrupt(word: str, rng: random.Random, most: int = 2) -> list[tuple[str, str]]:
    """(read character, what it stands for) pairs of a word read with up to ``most`` errors."""
    spots = [(i, a, b) for a, b in CONFUSIONS for i in range(len(word) - len(a) + 1) if word.startswith(a, i)]
    rng.shuffle(spots)
    hit: dict[int, tuple[str, str]] = {}
    used: set[int] = set()
    for i, a, b in spots[: rng.choice([1] * 3 + [most])] if spots else []:
        span = set(range(i, i + len(a)))
        if not span & used:
            used |= span
            hit[i] = (a, b)
    out, i = [], 0
    while i < len(word):
        if i in hit:
            a, b = hit[i]
            out.append((b[0], a))
            out += [(c, "") for c in b[1:]]
            i += len(a)
        else:
            out.append((word[i], word[i]))
            i += 1
    return out


# fixed values: marks that may stand where a line breaks off inside a word
BREAKS = "-‐‑\xad¬"
#: Operations at a line's end mark: the two halves are one word and the mark goes, the mark stays as a hyphen, or nothing is known.
JOINS = ["join", "hyphen", "open"]


def one_edit(token: str) -> set[str]:
    """All forms that one confusion may have turned into ``token``."""
    return {token[:i] + a + token[i + len(b) :] for a, b in CONFUSIONS for i in range(len(token) - len(b) + 1) if token.startswith(b, i)}


class CharacterEditor:
    """Predicts for each character what it stands for: itself (keep), another one (replace), nothing (delete), or more (insert); and at
    the mark that ends a line, which line-join operation (JOINS) it is. One model holds all operations."""

    def __init__(self):
        self.model = Perceptron()
        self.labels: dict[str, list[str]] = {}

    @staticmethod
    def features(s: str, i: int) -> list[str]:
        p2, p1 = s[i - 2] if i > 1 else "^", s[i - 1] if i else "^"
        c = s[i]
        n1, n2 = s[i + 1] if i + 1 < len(s) else "$", s[i + 2] if i + 2 < len(s) else "$"
        kind = lambda x: "9" if x.isdigit() else "a" if x.isalpha() else x
        return ["c" + c, "p" + p1 + c, "n" + c + n1, "w" + p1 + c + n1, "P" + p2 + p1 + c, "N" + c + n1 + n2, "W" + p2 + p1 + c + n1 + n2, "k" + kind(p1) + c + kind(n1), "K" + kind(p2) + kind(p1) + c + kind(n1) + kind(n2)]

    @staticmethod
    def join_features(a: str, b: str, mark: str, lex: dict[str, int]) -> list[str]:
        """Of a line's last word without its mark, and the next line's first."""
        left, right, whole = a.rsplit("-", 1)[-1], b.split("-", 1)[0], a + b
        one, pair = left + right in lex, f"{left}-{right}" in lex
        f = [f"one{one}{pair}", f"one{one}{left in lex}{right in lex}", f"pair{pair}", f"mark{mark == '-'}{one}{pair}", f"letters{right.isalpha()}", f"more{lex.get(left + right, 0) > lex.get(left + '-' + right, 0)}{one}{pair}", f"len{min(len(left), 3)}{min(len(right), 3)}{one}", f"has{whole in lex}"]
        return ["\n" + x for x in f]

    def join(self, a: str, b: str, mark: str, lex: dict[str, int]) -> str:
        """The line-join operation between ``a`` and ``b``."""
        return self.model.best(self.join_features(a, b, mark, lex), JOINS)

    def train(self, words: list[str], lex: dict[str, int] | None = None, most: int = 2500, seed: int = 7, rounds: int = 3) -> "CharacterEditor":
        """From clean ``words``, of which errors are made, and the words of ``lex`` (``most`` at most), which are broken at line ends."""
        rng = random.Random(seed)
        data: list[tuple] = []
        for w in words:
            data.append(([(c, c) for c in w],))
            data.append((corrupt(w, rng),))
        for (pairs,) in data:
            for c, y in pairs:
                own = self.labels.setdefault(c, [c])
                if y not in own:
                    own.append(y)
        for a, b in CONFUSIONS:  # an error that no sampled word had can still be undone
            for c, y in [(b[0], a)] + [(c, "") for c in b[1:]]:
                own = self.labels.setdefault(c, [c])
                if y not in own:
                    own.append(y)
        whole = sorted(w for w in lex or () if len(w) > 3 and "-" not in w)
        pairs_ = sorted(w for w in lex or () if "-" in w)
        broken: list[tuple] = []
        for w in rng.sample(whole, min(len(whole), most)):
            at = rng.randint(2, len(w) - 1)
            broken.append((w[:at], w[at:], rng.choice(BREAKS + "---"), "join"))
            odd = list(w)
            odd[rng.randrange(len(w))] = rng.choice("|0159")
            broken.append(("".join(odd[:at]), "".join(odd[at:]), rng.choice(BREAKS), "open"))
        for w in rng.sample(pairs_, min(len(pairs_), most)) * max(1, len(broken) // (4 * max(min(len(pairs_), most), 1))):
            a, b = w.rsplit("-", 1)
            broken.append((a, b, rng.choice(BREAKS + "---"), "hyphen"))
        data += broken
        for _ in range(rounds):
            rng.shuffle(data)
            for row in data:
                if len(row) == 4:
                    f = self.join_features(*row[:3], lex)
                    self.model.update(row[3], self.model.best(f, JOINS), f)
                    continue
                s = "".join(c for c, _ in row[0])
                for i, (c, y) in enumerate(row[0]):
                    f = self.features(s, i)
                    self.model.update(y, self.model.best(f, self.labels[c]), f)
        self.model.average()
        return self

    def edits(self, token: str, prefixes, accept, width: int = 24, most: int = 3) -> tuple[str, list[int]] | None:
        """The best-scored edited form that ``accept`` takes, with the places edited; beam search over known prefixes.

        ``prefixes``: whether a string can still become an accepted form. At most ``most`` characters are edited.
        """
        beam: list[tuple[float, str, tuple[int, ...]]] = [(0.0, "", ())]
        for i, c in enumerate(token):
            labels = self.labels.get(c, [c])
            s = self.model.scores(self.features(token, i), labels)
            keep = s[c] if c in s else 0.0
            step = []
            for score, out, at in beam:
                for y in labels:
                    if y == "" and not (at and at[-1] == i - 1 and (token[i - 1 : i + 1], out[-1:]) in _PAIRS):
                        continue  # only the second half of a letter that was read as two goes
                    new = out + y
                    if (y == c or y == "" or len(at) < 2 * most) and prefixes(new):
                        step.append((score + s[y] - keep, new, at if y == c else (*at, i)))
            step.sort(key=lambda x: -x[0])
            beam = step[:width]
            if not beam:
                return None
        for _, out, at in beam:
            if at and accept(out) and len(at) - sum((token[i - 1 : i + 1] in _TWO and i - 1 in at) for i in at) <= most:
                return out, list(at)
        return None
