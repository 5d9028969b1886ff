"""Personal data in texts: fixed patterns, and a semi-Markov conditional random field over what they leave.

The base spans follow four patterns with checks and are always kept. Where they fail although something is there (a phone
number that runs into a card number, ``name (at) host (dot) org``, IPv6, a number without a country code), a field decides.
It sees windows around digit chains and address marks, as tokens (digit runs, letter runs, single characters; a base span
is one token with a fixed label). A candidate segment has up to ``MAX_TOKENS`` tokens and passes the gate of its kind;
its score is a weight vector of the kind times features of the *whole* span (digit and group counts, separators, Luhn sum,
octets, what touches it on either side, cue words before it), plus a transition weight. Viterbi over the segments chooses
boundaries and kinds jointly. The weights are fitted to the labelled table of ``labelled()`` by exact likelihood
(forward-backward over the same lattice); the table is made by rule and does not depend on the input.

Work is linear in the text and memory bounded beside it: entities have at most MAX_TOKENS tokens and MAX_CHARS characters,
a window of more than WINDOW characters is decoded in parts that overlap by several entities (a span belongs to the part it
begins in), and the patterns are matched without retries from within a run.

Defined results: null and empty texts have no span; repeated rows are answered each; a null doc_id is passed on; an empty
table gives none; other columns of the input are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import whole_text

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS, MAX_CHARS, AROUND, WINDOW = 32, 160, 100, 50_000

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    return (sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns, by kind, then start."""
    out, at, since = [], text.find("@"), 0
    while at >= 0:  # the name before an @ reaches back to the last match or @: no character is read twice
        name = at - len(before := text[since:at]) + len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at) if name < at else None
        if m:
            out.append((0, name, m.end()))
        since = m.end() if m else at + 1
        at = text.find("@", since)
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGITS.sub("", m.group())) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGITS.sub("", m.group())) <= 15]
    return out


# -- the lattice of a window ------------------------------------------------------------------------------------------

_TRIGGERS = (re.compile(r"[0-9](?:[ ().+/\-]{0,3}[0-9]){6,}"), re.compile(r"[\[({<] ?(?:[aA][tT]|[dD][oO][tT]|\.) ?[\])}>]"), re.compile(r"\b[dD][oO][tT]\b"), re.compile(r":[0-9A-Fa-f]{0,4}:"))
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^\W\d_A-Za-z]+|.", re.DOTALL)
DIGITS, LETTERS, SPACE, POINT, HYPHEN, PLUS, OPEN, CLOSE, SLASH, COLON, AT, LINK, OTHER, FIXED = range(14)
_CLASS = {" ": SPACE, ".": POINT, "-": HYPHEN, "+": PLUS, "(": OPEN, "[": OPEN, "{": OPEN, "<": OPEN, ")": CLOSE, "]": CLOSE, "}": CLOSE, ">": CLOSE, "/": SLASH, ":": COLON, "@": AT, "_": LINK, "%": LINK}

# Cue words in four languages, by what follows them.
CUES = (
    frozenset("email mail contact write courriel correo schreiben reply address adresse".split()),
    frozenset("ip ipv host server gateway router dns node serveur servidor peer".split()),
    frozenset("card visa mastercard amex credit debit carte karte tarjeta kreditkarte payment".split()),
    frozenset("phone tel telephone call fax mobile cell telefon handy anruf appel appelez telefono dial ring sms whatsapp".split()),
    frozenset("order invoice isbn issn version serial ticket ref reference id no number nr token password key hash build account iban date chapter page part pages batch article".split()),
)


class Lattice:
    """The tokens of one window as arrays: places, classes and running sums, from which whole-span features follow."""

    def __init__(self, text: str, begin: int, end: int, fixed: list[tuple[int, int, int]]):
        cuts, kinds, pos = [], [], begin
        for kind, s, e in [*fixed, (-1, end, end)]:
            for m in _TOKEN.finditer(text, pos, s):
                cuts.append(m.start())
                c = m.group()
                kinds.append(DIGITS if "0" <= c[0] <= "9" else _CLASS.get(c) if c in _CLASS else LETTERS if c[0].isalpha() else SPACE if c.isspace() else OTHER)
            if kind >= 0:
                cuts.append(s)
                kinds.append(FIXED)
            pos = e
        self.text, self.n = text, len(cuts)
        self.label = dict(zip((t for t, k in enumerate(kinds) if k == FIXED), (k for k, _, _ in fixed), strict=True))
        self.at = np.array([*cuts, end], np.int64)
        self.kind = np.array(kinds, np.int8)
        self.size = np.diff(self.at)
        if fixed:  # a token before a fixed one ends where that begins; a fixed one has its own end
            self.size[list(self.label)] = [e - s for _, s, e in fixed]
        words = [text[a:b].lower() if k == LETTERS else "" for a, b, k in zip(cuts, self.at[1:], kinds, strict=True)]
        self.at_word, self.dot_word = np.array([w == "at" for w in words], bool), np.array([w == "dot" for w in words], bool)
        self.cue = np.zeros((self.n, len(CUES)), bool)
        for t, w in enumerate(words):
            if w:
                self.cue[t] = [w in c for c in CUES]
        k, near = self.kind, self._near
        digit = k == DIGITS
        hexa = digit | np.array([0 < len(w) <= 4 and not w.strip("abcdef") for w in words], bool)
        octet = digit & (self.size <= 3)
        octet[octet] = [int(text[a : a + n]) <= 255 for a, n in zip(self.at[:-1][octet], self.size[octet], strict=True)]
        mark = self.at_word | self.dot_word | (k == AT) | (k == OPEN) | (k == CLOSE)
        alone = (k == SPACE) & ~near(mark, -1) & ~near(mark, 1)
        boxed = self.at_word & ((near(k == OPEN, -1) & near(k == CLOSE, 1)) | (near(k == OPEN, -2) & near(k == CLOSE, 2)))
        double = near(~digit, 1) & near(~digit, 2) & near(~digit, 3) & ~digit
        sep = ~digit
        counted = {
            "digits": self.size * digit, "groups": digit, "letters": k == LETTERS, "points": k == POINT, "hyphens": k == HYPHEN, "spaces": k == SPACE, "slashes": k == SLASH, "plus": k == PLUS, "open": k == OPEN, "close": k == CLOSE, "colons": k == COLON,
            "v6colons": (k == COLON) & near(k == COLON, 1), "at": k == AT, "at_word": self.at_word, "boxed": boxed, "dot_word": self.dot_word, "alone": alone, "stray": (k == OTHER) | (k == FIXED), "links": k == LINK,
            "fours": digit & (self.size == 4), "threes": digit & (self.size == 3), "octets": octet, "hexa": hexa & (self.size <= 4), "long": double, "twosep": sep & near(sep, 1),
        }
        self.sums = {name: np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for name, x in counted.items()}
        self._luhn_sums(text, digit)

    def _near(self, x: np.ndarray, step: int) -> np.ndarray:
        out = np.zeros_like(x)
        if abs(step) < len(x):
            if step > 0:
                out[:-step] = x[step:]
            else:
                out[-step:] = x[:step]
        return out

    def _luhn_sums(self, text: str, digit: np.ndarray) -> None:
        """Running Luhn sums over all digits, doubled at even and at odd places: the sum of any span is a difference."""
        every = "".join(text[a : a + n] for a, n in zip(self.at[:-1][digit].tolist(), self.size[digit].tolist(), strict=True))
        d = np.frombuffer(every.encode(), np.uint8).astype(np.int64) - 48
        twice, even = 2 * d - 9 * (d > 4), np.arange(len(d)) % 2 == 0
        self.luhn = [np.concatenate([[0], np.cumsum(np.where(even == (p == 0), twice, d))]) for p in (0, 1)]

    def candidates(self, begin: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, kind) of all segments that begin in [begin, stop) and pass the gate of a kind."""
        found = []
        for length in range(1, MAX_TOKENS + 1):
            s = np.arange(begin, min(stop, self.n - length + 1))
            if not len(s):
                break
            e = s + length
            n = {k: v[e] - v[s] for k, v in self.sums.items()}
            first, last = self.kind[s], self.kind[e - 1]
            fits = (n["stray"] == 0) & (self.at[e - 1] + self.size[e - 1] - self.at[s] <= MAX_CHARS)
            plain = fits & (last == DIGITS) & (n["letters"] + n["colons"] + n["at"] + n["links"] + n["long"] == 0)
            opens = (first == DIGITS) | (first == PLUS) | (first == OPEN)
            phone = plain & opens & (n["digits"] >= 7) & (n["digits"] <= 15) & (n["groups"] <= 7) & (n["plus"] == (first == PLUS)) & (n["open"] == n["close"]) & (n["open"] <= 1)
            card = plain & (first == DIGITS) & (n["digits"] >= 13) & (n["digits"] <= 19) & (n["groups"] <= 5) & (n["plus"] + n["open"] + n["close"] + n["slashes"] + n["twosep"] == 0)
            four = fits & (first == DIGITS) & (last == DIGITS) & (n["groups"] == 4) & (n["octets"] == 4) & (n["points"] == 3) & (n["letters"] + n["spaces"] + n["hyphens"] + n["colons"] + n["plus"] + n["slashes"] + n["at"] + n["links"] == 0) & (n["open"] == n["close"])
            six = fits & (n["colons"] >= 2) & (n["colons"] <= 7) & (n["hexa"] + n["colons"] >= length) & ((n["colons"] == 7) ^ (n["v6colons"] == 1)) & (n["hexa"] >= 2)
            ats = n["at"] + n["at_word"]
            inner = (n["alone"] == 0) & (n["colons"] + n["slashes"] == 0) & (n["open"] == n["close"])
            dotted = n["points"] + n["dot_word"] >= 1
            spoken = (n["at"] == 1) | (n["boxed"] == 1) | (n["dot_word"] >= 1)
            word_ends = ((first == LETTERS) | (first == DIGITS)) & ~self.at_word[s] & ~self.dot_word[s] & (last == LETTERS) & (self.size[e - 1] >= 2) & ~self.at_word[e - 1] & ~self.dot_word[e - 1]
            for kind, ok in ((0, fits & word_ends & (ats == 1) & inner & dotted & spoken), (1, four | six), (2, card), (3, phone)):
                hit = np.flatnonzero(ok)
                found.append((s[hit], e[hit], np.full(len(hit), kind)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3

    def features(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """A row of whole-span features for each segment."""
        n = {k: v[e] - v[s] for k, v in self.sums.items()}
        d = n["digits"]
        d0, d1 = self.sums["digits"][s], self.sums["digits"][e]
        parity = d1 % 2  # the last digit, at place d1 - 1, is not doubled: digits of the parity of d1 are
        luhn_sum = np.where(parity == 0, self.luhn[0][d1] - self.luhn[0][d0], self.luhn[1][d1] - self.luhn[1][d0])
        before, after = self._beside(s - 1, -1), self._beside(e, 1)
        cue = np.zeros((len(s), len(CUES)), bool)
        for back in range(1, 7):
            t = s - back
            cue |= self.cue[np.maximum(t, 0)] & (t >= 0)[:, None]
        dot_end = self.dot_word[np.maximum(e - 2, 0)] | (self.kind[np.maximum(e - 2, 0)] == POINT)
        columns = [
            np.ones(len(s)), d <= 9, (d >= 10) & (d <= 12), (d >= 13) & (d <= 15), d >= 16,
            n["groups"] == 1, (n["groups"] >= 2) & (n["groups"] <= 3), n["groups"] == 4, n["groups"] >= 5,
            n["plus"] == 1, self.kind[s] == OPEN, n["open"] >= 1, n["points"] >= 1, n["hyphens"] >= 1, n["spaces"] >= 1, n["slashes"] >= 1,
            (n["points"] > 0) * 1 + (n["hyphens"] > 0) + (n["spaces"] > 0) > 1, (luhn_sum % 10 == 0) & (d >= 13), (n["fours"] >= 3) & (d >= 13), (n["threes"] >= 2) & (d == 10),
            n["threes"] + n["fours"] == n["groups"], n["v6colons"] == 1, n["colons"] == 7, n["at"] == 1, n["boxed"] == 1, (n["dot_word"] >= 1) & (n["at_word"] + n["at"] == 1), dot_end & (self.size[e - 1] <= 4),
            *before, *after, *cue.T,
        ]
        return np.stack([np.asarray(c, np.float64) for c in columns], axis=1)

    def _beside(self, t: np.ndarray, step: int) -> list[np.ndarray]:
        """What touches a side: a digit, a letter, a mark with a digit or letter behind it, a space with a digit behind it, a bracket."""
        inside = (t >= 0) & (t < self.n)
        k = np.where(inside, self.kind[np.clip(t, 0, self.n - 1)], SPACE)
        u = t + step
        k2 = np.where((u >= 0) & (u < self.n), self.kind[np.clip(u, 0, self.n - 1)], SPACE)
        tight = np.isin(k, (POINT, HYPHEN, SLASH, COLON, LINK, AT, PLUS))
        return [k == DIGITS, k == LETTERS, tight & ((k2 == DIGITS) | (k2 == LETTERS)), (k == SPACE) & (k2 == DIGITS), np.isin(k, (OPEN, CLOSE))]


# -- the field --------------------------------------------------------------------------------------------------------


class Field:
    """Weights: a vector per kind and a transition matrix over (outside, kinds)."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def decode(self, lattice: Lattice) -> list[tuple[int, int, int]]:
        """The best segmentation: (kind, start, end) in characters, fixed tokens left out."""
        n, moves = lattice.n, self.moves.tolist()
        s, e, k = lattice.candidates(0, n)
        if not len(s):
            return []
        by_start: dict[int, list] = {}
        scores = (lattice.features(s, e) * self.weights[k]).sum(axis=1)
        for a, b, kind, x in zip(s.tolist(), e.tolist(), k.tolist(), scores.tolist(), strict=True):
            by_start.setdefault(a, []).append((b, kind + 1, x))
        best = [[-1e18] * 5 for _ in range(n + 1)]
        back: list[list] = [[None] * 5 for _ in range(n + 1)]
        best[0][0] = 0.0
        for t in range(n):
            here = best[t]
            for end, label, x in [(t + 1, lattice.label[t] + 1, 0.0)] if t in lattice.label else [(t + 1, 0, 0.0), *by_start.get(t, ())]:
                y = max(range(5), key=lambda p: here[p] + moves[p][label])
                v = here[y] + moves[y][label] + x
                if v > best[end][label]:
                    best[end][label], back[end][label] = v, (t, y)
        out, t = [], n
        y = max(range(5), key=best[n].__getitem__)
        while t:
            begin, y0 = back[t][y]
            if y and begin not in lattice.label:
                out.append((y - 1, int(lattice.at[begin]), int(lattice.at[t - 1] + lattice.size[t - 1])))
            t, y = begin, y0
        return out[::-1]


def _places(text: str, blocks: list[list[int]]) -> list[list[int]]:
    """The stretches around triggers that no base span holds, merged."""
    hits = [(m.start(), m.end(), 40, 6) for m in _TRIGGERS[0].finditer(text)]
    at = text.find("@")
    while at >= 0:
        hits.append((at, at + 1, AROUND, AROUND))
        at = text.find("@", at + 1)
    for p in _TRIGGERS[1:3] if "dot" in text or "Dot" in text or "DOT" in text or "[" in text or "(" in text or "{" in text or "<" in text else ():
        hits += [(m.start(), m.end(), AROUND, AROUND) for m in p.finditer(text)]
    if ":" in text:
        hits += [(m.start(), m.end(), 40, 40) for m in _TRIGGERS[3].finditer(text)]
    out: list[list[int]] = []
    b = 0
    for s, e, left, right in sorted(hits):
        while b < len(blocks) and blocks[b][2] <= s:
            b += 1
        if b < len(blocks) and blocks[b][1] <= s and e <= blocks[b][2]:
            continue
        s, e = max(0, s - left), min(len(text), e + right)
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _windows(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, list[tuple[int, int, int]]]]:
    """(begin, end, where the next part begins, fixed blocks): overlapping base spans are one block, and no cut is inside one."""
    blocks: list[list[int]] = []
    for kind, s, e in sorted(base, key=lambda x: (x[1], x[2])):
        if blocks and s < blocks[-1][2]:
            blocks[-1][2] = max(blocks[-1][2], e)
        else:
            blocks.append([kind, s, e])
    starts = [s for _, s, _ in blocks]
    for first, last in _places(text, blocks):
        at = first
        while at < last:
            stop = last if last - at <= WINDOW else at + WINDOW
            s, e = max(first, at - 2 * MAX_CHARS), min(last, stop + 2 * MAX_CHARS)
            b = max(0, bisect_right(starts, s) - 1)
            inside = []
            while b < len(blocks) and blocks[b][1] < e:
                if blocks[b][2] > s:
                    inside.append(tuple(blocks[b]))
                b += 1
            if inside:
                s, e = min(s, inside[0][1]), max(e, inside[-1][2])
            yield s, e, stop, inside
            at = stop


def find(text: str, model: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, added spans), each (kind, start, end) by kind, then start."""
    base = base_spans(text)
    added: list[tuple[int, int, int]] = []
    for s, e, stop, fixed in _windows(text, base):
        for x in model.decode(Lattice(text, s, e, fixed)):
            if x[1] < stop and (not added or x[1] >= added[-1][2]):
                added.append(x)
    return base, sorted(added)


# -- training ---------------------------------------------------------------------------------------------------------


def labelled(seed: int = 11, rounds: int = 12) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The labelled table: texts with (kind, start, end), made by rule from forms, cues and fillers. Forms that look alike
    but are none (versions, dates, prices, book numbers, hashes, digit chains without a valid sum) carry no label."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    name = lambda: "".join(pick("bcdfglmnprst") + pick("aeiou") for _ in range(int(rng.integers(1, 4)))) + pick(("", "n", "r"))

    def card(valid: bool = True, n: int = 16) -> str:
        head = pick("3456") + num(n - 2)
        good = next(c for c in "0123456789" if luhn(head + c))
        d = head + (good if valid else str((int(good) + int(rng.integers(1, 10))) % 10))
        return pick((d, d, " ".join(re.findall("....|.+", d)), "-".join(re.findall("....|.+", d))))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return pick((f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+49 {num(3)} {num(7)}", f"+33 {pick('1679')} {num(2)} {num(2)} {num(2)} {num(2)}"))

    def mail() -> str:
        u, h, t = pick((name(), f"{name()}.{num(2)}", f"{name()}_{name()}")), name(), pick(("com", "org", "net", "de", "fr", "es"))
        return pick((f"{u} (at) {h} (dot) {t}", f"{u}[at]{h}[dot]{t}", f"{u} at {h} dot {t}", f"{u} [at] {h}.{t}", f"{u} @ {h}.{t}", f"{u}@{h} dot {t}", f"{u}@{h}ü.{t}", f"{u}@é{h}.{t}"))

    def six() -> str:
        g = [f"{int(x):x}" for x in rng.integers(16, 65536, 8)]
        return pick((":".join(g), f"{g[0]}:{g[1]}::{g[2]}:{g[3]}", f"fe80::{g[1]}:{g[2]}", f"2001:db8::{g[0]}"))

    def defanged() -> str:
        return "[.]".join(str(int(x)) for x in rng.integers(0, 256, 4))

    def nothing() -> str:
        year = str(1900 + int(rng.integers(130)))
        return pick((
            f"{year}-0{pick('123456789')}-1{pick('0123456789')} 12:3{num(1)}:{num(2)}", f"978-{pick('0123')}-{num(2)}-{num(6)}-{num(1)}", f"v{num(1)}.{num(2)}.{num(1)}.{num(2)}.{num(3)}", f"{num(1)},{num(3)},{num(3)}.{num(2)}", card(False), card(False), card(False), num(24), num(10), num(8), num(12),
            " ".join(num(4) for _ in range(7)), "-".join(num(3) for _ in range(8)), " ".join(num(2) for _ in range(9)), f"a{num(9)}f{num(12)}c{num(3)}", f"{num(4)}-{num(4)}", f"{num(3)}.{num(3)}.{num(3)}.{num(3)}.{num(2)}", f"0{num(1)}:3{num(1)}:4{num(1)}", f"{name()} at {name()} . {name().title()} dot", f"{name()}@{name()}", f"{num(5)} / {num(5)}", f"{year} - {year} ({num(3)})",
        ))

    makers = ((0, mail), (1, six), (1, defanged), (2, card), (3, phone))
    cued = {0: ("mail", "contact", "e-mail:"), 1: ("server", "ip", "host"), 2: ("card", "visa", "carte"), 3: ("call", "tel", "phone:"), 4: ("order", "isbn", "version", "ref", "token =", "no", "date")}
    table = []
    for _ in range(rounds):
        for plan in [(m,) for m in makers] + [((-1, nothing),)] * 9 + [(makers[4], makers[3]), (makers[4], makers[3]), (makers[3], makers[4]), (makers[4], (-1, lambda: num(5))), (makers[3], makers[3]), (makers[4], makers[4])]:
            text, spans = " ".join(name() for _ in range(int(rng.integers(1, 4)))) + pick((" ", ". ", ", ")), []
            for kind, make in plan:
                if rng.random() < 0.3:
                    text += pick(cued[kind if kind >= 0 else 4]) + " "
                value = make()
                if kind >= 0:
                    spans.append((kind, len(text), len(text) + len(value)))
                text += value + " "
            text = text[:-1] + pick((" ", ". ", ", ", "%%% ")) + " ".join(name() for _ in range(int(rng.integers(1, 4))))
            table.append((text, spans))
    return table


@lru_cache(maxsize=1)
def trained(steps: int = 80, rate: float = 0.25, decay: float = 2e-3) -> Field:
    """The field fitted to the labelled table: exact gradients of the likelihood of whole segmentations, Adam steps."""
    paths, lattices = [], []
    for text, spans in labelled():
        lat = Lattice(text, 0, len(text), [])
        s, e, k = lat.candidates(0, lat.n)
        ends = lat.at[e - 1] + lat.size[e - 1] if len(e) else e
        gold = [(kind, a, b) in spans for kind, a, b in zip(k.tolist(), lat.at[s].tolist(), ends.tolist(), strict=True)]
        if sum(gold) == len(spans):  # a text whose label no candidate reaches teaches nothing
            lattices.append((lat.n, s.tolist(), e.tolist(), k, lat.features(s, e), np.array(gold, bool)))
            paths.append(spans)
    width = next(x[4].shape[1] for x in lattices if len(x[3]))
    weights, moves = np.zeros((4, width)), np.zeros((5, 5))
    moment = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, moves)]
    seen_w, seen_m = np.zeros_like(weights), np.zeros_like(moves)
    for n, s, e, k, f, gold in lattices:
        np.add.at(seen_w, k[gold], f[gold])
        starts = {s[i]: (e[i], int(k[i]) + 1) for i in np.flatnonzero(gold)}
        t, y = 0, 0
        while t < n:
            end, label = starts.get(t, (t + 1, 0))
            seen_m[y, label] += 1
            t, y = end, label
    for step in range(1, steps + 1):
        grad_w, grad_m = seen_w.copy(), seen_m.copy()
        for n, s, e, k, f, _ in lattices:
            _expected(n, s, e, k, f, weights, moves, grad_w, grad_m)
        for x, g, m in zip((weights, moves), (grad_w, grad_m), moment, strict=True):
            g = g / len(lattices) - decay * x
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            x += rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    return Field(weights, moves)


def _expected(n: int, s: list[int], e: list[int], k: np.ndarray, f: np.ndarray, weights: np.ndarray, moves: np.ndarray, grad_w: np.ndarray, grad_m: np.ndarray) -> float:
    """Takes the expected features and transitions of one lattice from the gradients (forward-backward); the log partition."""
    score = np.exp((f * weights[k]).sum(axis=1)) if len(s) else np.zeros(0)
    step = np.exp(moves)
    labels = (k + 1).tolist()
    after: list[list[int]] = [[] for _ in range(n + 1)]
    for i, a in enumerate(s):
        after[a].append(i)
    alpha, beta = np.zeros((n + 1, 5)), np.zeros((n + 1, 5))
    alpha[0, 0], beta[n] = 1.0, 1.0
    for t in range(n):
        into = alpha[t] @ step
        alpha[t + 1, 0] += into[0]
        for i in after[t]:
            alpha[e[i], labels[i]] += into[labels[i]] * score[i]
    for t in range(n - 1, -1, -1):
        out = step[:, 0] * beta[t + 1, 0]
        for i in after[t]:
            out = out + step[:, labels[i]] * (score[i] * beta[e[i], labels[i]])
        beta[t] = out
    total = alpha[n].sum()
    into = alpha[:-1] @ step
    grad_m[:, 0] -= (alpha[:-1] * beta[1:, :1]).sum(axis=0) * step[:, 0] / total
    for i, a in enumerate(s):
        p = into[a, labels[i]] * score[i] * beta[e[i], labels[i]] / total
        grad_w[k[i]] -= p * f[i]
        grad_m[:, labels[i]] -= alpha[a] * step[:, labels[i]] * score[i] * beta[e[i], labels[i]] / total
    return float(np.log(total))


# -- the operator -----------------------------------------------------------------------------------------------------


def personal_data(docs: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, spans: array of (kind, start, end, base) by kind as listed in KINDS, then start; places count code points, the
    end is exclusive. A row of ``docs`` gives a row."""
    held = docs.sparkSession.sparkContext.broadcast(trained())
    slim = docs.select("doc_id", whole_text(column).alias("text"))
    id_type = slim.schema["doc_id"].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            out = []
            for text in batch.column(1):
                base, added = find(text.as_py(), model)
                rows = sorted([(*x, True) for x in base] + [(*x, False) for x in added])
                out.append([{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in rows])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(item))], names=["doc_id", "spans"])

    return slim.mapInArrow(run, f"doc_id {id_type}, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, the digest of the base spans, and all spans as text."""
    found = personal_data(docs)
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["base"])
    counted = lambda kind: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == F.lit(kind)))).cast("long").alias(f"n_{kind}")
    counts = [counted(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
