"""PII (2): a semi-Markov conditional random field over candidate segments.

A run is neighbouring white-space words that each may be part of an entity: they hold a decimal
digit of any script or an @, or `LONG` letters, digits or key marks in a row, or three groups of an
address between colons, or follow a credential's name and a colon or equals sign. A run is cut into
tokens; every admissible segment of up to `MOST_TOKENS` of them is scored as a whole for each type
by features of its full shape, checks (address, checksums, octets), borders, numbers beside it and
the words before it, with learned transitions; the best segmentation is found by dynamic programming
over segments of bounded length, which settles borders and types at once. A segment is admissible if
one of its words could open a run and, where it holds white space, if it is made of digits and the
marks of dialled numbers (20 digits at most) or looks like an account number. Weights are learned
here, by gradient ascent on the conditional likelihood of generated examples.

Decoding keeps only segments that some path could prefer to leaving them out, a bound that follows
from the model's own transitions, so it is exact for every model; tokens that no such segment covers
part a run into pieces that are decoded one by one. A run's scores are never held at once.

Types: EMAIL, PHONE, CARD, IP (both versions), SSN, IBAN and SECRET (keys, tokens, passwords).
`redact` puts [TYPE] for each. Names and postal addresses are not covered.

Defined cases: a null or empty text has no entities; offsets count characters; equal rows give
equal results; texts of any length are processed whole; a null doc_id stays null; an empty table
gives an empty result; other columns are ignored or passed on, whatever their names; `redact`
sets an integer column n_chars, if there is one, to the new length of a text that it changed.
"""

from __future__ import annotations

import bisect
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadledger.llm import base

TYPES = ("O", "EMAIL", "PHONE", "CARD", "IP", "SSN", "SECRET", "IBAN")
MOST_TOKENS = 24
#: Characters in a row that make a word without digits worth looking at.
LONG = 16
#: Generated examples and passes over them that the weights are learned from.
EXAMPLES, PASSES, RATE = 2000, 4, 0.5
#: Scored shapes that a worker remembers.
REMEMBERED = 200_000
TOKEN = re.compile(r"[A-Za-z0-9+/]{16,}={0,2}|\w+|\s+|[^\w\s]")
EMAIL = re.compile(r"[\w.+%-]+@[\w-]+(\.[\w-]+)*\.[^\W\d_]{2,}")
HEX = re.compile(r"[0-9A-Fa-f]+")
IPV6 = re.compile(r"(?=.*::|(?:[^:]*:){7}[^:]*$)[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}")
IBAN = re.compile(r"[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")
NUMERIC = re.compile(r"[^\w\s]*\d[\d.,:/%-]*[^\w\s]*")
KEYED = re.compile(r"(?:gh[oprsu]_|github_pat_|glpat-|sk-|sk_|pk_|rk_|xox[abps]-|AKIA|ASIA|AIza|ya29|hf_|npm_|eyJ)")
CUES = re.compile(r"token|key|secret|passw|pwd|auth|bearer|credential|ssn|social|phone|tel|call|fax|mobile|card|visa|iban|konto|account|ip|mail|version|isbn|order|rufen|appel", re.I)
#: What precedes the value of a credential.
ASSIGNED = r"""(?:passw(?:or)?[dt]|passphrase|passwd|passcode|kennwort|contrase\w+a|mot de passe|pwd|secret|token|key|auth|bearer|credential)\w{0,12}["']?\s{0,2}[:=]\s{0,2}["'`(<]?"""
ASSIGNED_END = re.compile(f"(?:{ASSIGNED})$", re.I)
VALUE = re.compile(rf"(?:{ASSIGNED})(?=\S)", re.I)
#: Words that can be part of an entity hold one of these; RE2 patterns, the quick ones first.
SIGN, ROW, GROUPS = r"[\p{Nd}@]", rf"[\pL\pN_+/=-]{{{LONG}}}", r"(?:[0-9A-Fa-f]{0,4}:){3}"
#: A word that names a credential, and what all of them hold.
NAMING = r"(?i)(?:passw(?:or)?[dt]|passphrase|passwd|passcode|kennwort|contrase[\pL\pN_]+a|passe|pwd|secret|token|key|auth|bearer|credential)[\pL\pN_]{0,12}[\"']?(?:[:=]|$)"
NAMED = r"(?i)pass|kennwort|contrase|pwd|secret|token|key|auth|bearer|credential"
#: Four capitals after the country and check digits of an account number.
BANK = re.compile(r"(?<!\S)[A-Z]{2}\d\d ([A-Z]{4})(?= [A-Z0-9]{4}\b)")
SPACE = re.compile(r"\s")
SPANS = "array<struct<start:int,end:int,type:string>>"
#: Every decimal digit is read as 0, so that a shape is scored once.
MASK = {c: "0" for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"}


def luhn(digits: str) -> bool:
    values = [int(c) for c in digits]
    return (sum(values[-1::-2]) + sum(sum(divmod(2 * v, 10)) for v in values[-2::-2])) % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number's checksum is right."""
    plain = re.sub(r"\s", "", account)
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def checks(span: str, digits: int) -> str:
    """What the digits' values tell: all else about a segment follows from its masked text."""
    if digits >= 4 and span.count(".") == 3 and re.fullmatch(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", span):
        return "octets" if all(int(p) < 256 for p in span.split(".")) else "no octets"
    if 13 <= digits <= 19 and not re.search(r"[^\d\s-]", span):
        return "luhn" if luhn(re.sub(r"\D", "", span)) else "no luhn"
    if digits >= 8 and span[0].isalpha() and span.isascii() and IBAN.fullmatch(span):
        return "mod97" if mod97(span) else "no mod97"
    return ""


def shape(span: str) -> str:
    """Letters and digits as runs, digits with their count where no letter is about."""
    runs = re.sub(r"[^\W\d_]+", "a", span)
    if "a" in runs:
        return re.sub(r"\d+", "d", runs)
    return re.sub(r"\d+", lambda m: f"d{min(len(m[0]), 20)}", runs)


def border(char: str) -> str:
    return "end" if not char else "space" if char.isspace() else "word" if char.isalnum() or char == "_" else char if char in "\"'.,;:()<>@-+/=" else "mark"


def features(left2: str, span: str, right2: str, check: str, cue: str, assigned: bool, beside: int) -> list[str]:
    """Of a segment as a whole: its masked text, the two characters on either side, what its digits tell, the words before it."""
    address, colons = "@" in span and bool(EMAIL.fullmatch(span)), ":" in span and bool(IPV6.fullmatch(span))
    octets, account = check.endswith("octets"), check.endswith("mod97")
    form = "octets" if octets else "account" if account else "address" if address else "colons" if colons else shape(span)
    digits = 0 if octets or account or address or colons else span.count("0")
    left, right = border(left2[-1:]), border(right2[:1])
    spaced = any(c.isspace() for c in span)
    out = ["bias", f"shape {form}" if len(form) <= 24 else "shape long", f"left {left}", f"right {right}", f"both {left} {right}", f"first {border(span[0])}", f"last {border(span[-1])}", f"digits {min(digits, 22)}", f"beside {beside} {spaced}"]
    if beside:
        out.append(f"beside {beside} {form}" if len(form) <= 24 else f"beside {beside} long")
    if left == "word" or right == "word":
        out.append("cut")
    if check:
        out.append(f"check {check}")
    if "@" in span:
        out.append("address" if address else "at")
        if right in ".@-" and right2[1:].isalnum():
            out.append("address goes on")
        if left in ".+-" and left2[:1].isalnum():
            out.append("address began")
    elif spaced:
        out.append("spaced")
    plain = not re.search(r"[^\d\s()+./-]", span)
    if 13 <= digits <= 19 and plain:
        out += ["long number", f"long {digits}"]
    if 7 <= digits <= 15 and plain:
        sep = bool(re.search(r"\d[\s.)/-]+\d", span))
        out += ["dialled" + " +" * span.startswith("+") + " ()" * ("(" in span and ")" in span) + " sep" * sep, f"dialled {beside}"]
        if span[0] == "0" and sep and re.fullmatch(r"\d\d(?:[ .]\d\d){4}", span):
            out.append("five pairs")
    if left in "-.(+:/" and left2.strip("-.(+:/") or left in "+(":
        out.append("number began")
    if right in "-.:/" and right2[1:].isalnum():
        out.append("number goes on")
    if not spaced and len(span) >= 6 and "@" not in span:
        letters = sum(c.isalpha() for c in span)
        kind = "digits" if not letters else "mixed" if digits else "letters" if letters == len(span) else "marked"
        size = min(len(span) // 4, 12)
        if assigned:
            out += ["assigned", f"assigned {kind} {size}", f"assigned {left} {right}"]
        if KEYED.match(span):
            out += ["keyed", f"keyed {size}"]
        if len(span) >= 12 and kind != "digits" and re.fullmatch(r"[\w+/=-]+", span):
            out += ["hex" if HEX.fullmatch(span) else "token", f"{kind} {size}", f"{kind} {left} {right}"]
            if kind != "mixed":
                out.append(f"{kind} {'hex' if HEX.fullmatch(span) else ''}")
            turns = len(re.findall(r"[a-z][A-Z]", span))
            out.append(f"turns {kind} {min(turns, 4)}")
            vowels = sum(c in "aeiouyäöüéèáíóúAEIOUYÄÖÜÉ" for c in span) / max(1, letters)
            out.append(f"vowels {kind} {min(int(vowels * 8), 5)}")
            if re.search(r"[-_/]", span):
                out.append(f"parts {kind} {min(len(re.split('[-_/]', span)), 5)}")
            if cue:
                out.append(f"{kind} cue")
    if cue:
        out.append(f"cue {cue}")
    return out


class Lattice:
    """Candidate segments of one run's tokens; before: the text ahead of the run."""

    def __init__(self, run: str, before: str):
        self.raw, self.run, self.before = run, run.translate(MASK), before.translate(MASK)
        tokens = [(m.start(), m.end()) for m in TOKEN.finditer(run)]
        self.bounds = [a for a, _ in tokens] + [len(run)]
        self.size = len(tokens)
        self.blank = [run[a].isspace() for a, _ in tokens]
        self.digits = [0]
        for a, b in tokens:
            self.digits.append(self.digits[-1] + self.run.count("0", a, b))
        self.dialled = [bool(re.fullmatch(r"\d+|[^\S\t]+|[()+./-]", run[a:b])) for a, b in tokens]
        words = [(m.start(), m.end(), bool(NUMERIC.fullmatch(m[0]))) for m in re.finditer(r"\S+", run)]
        word, at = [], 0
        for a, _ in tokens:
            while at + 1 < len(words) and words[at + 1][0] <= a:
                at += 1
            word.append(at)
        self.word, self.numeric = word, [False, *(w[2] for w in words), False]
        self._ahead: dict[int, tuple[str, bool]] = {}

    def ahead(self, i: int) -> tuple[str, bool]:
        """(the last cue before a token, whether it is a credential's value)."""
        if i not in self._ahead:
            a = self.bounds[i]
            text = f"{self.before} {self.run[max(0, a - 32) : a]}"[-32:]
            cues = CUES.findall(text[-24:])
            if len(self._ahead) > 4 * MOST_TOKENS:
                self._ahead.clear()
            self._ahead[i] = (cues[-1].lower() if cues else "", bool(ASSIGNED_END.search(text)))
        return self._ahead[i]

    def pairs(self) -> Iterator[tuple[int, int]]:
        """Admissible segments (i, j), by i."""
        bounds, blank, digits, size = self.bounds, self.blank, self.digits, self.size
        for i in range(size):
            if blank[i]:
                continue
            spaced, dialled, at_sign, account = False, True, False, None
            assigned = self.ahead(i)[1]
            for j in range(i + 1, min(size, i + MOST_TOKENS) + 1):
                if blank[j - 1]:
                    spaced = True
                dialled &= self.dialled[j - 1]
                a, b = bounds[i], bounds[j]
                if spaced and not (dialled and digits[j] - digits[i] <= 20):
                    if account is None:
                        account = bool(re.match(r"[A-Z]{2}\d\d\s?[A-Z0-9]{4}\b", self.run[a : a + 12]))
                    if not account or b - a > 42:
                        break
                    if blank[j - 1] or not IBAN.fullmatch(self.run[a:b]):
                        continue
                if blank[j - 1]:
                    continue
                at_sign = at_sign or self.run[bounds[j - 1]] == "@"
                if digits[j] > digits[i] or at_sign or assigned or b - a >= LONG or self.run.count(":", a, b) > 2:
                    yield i, j

    @property
    def segments(self) -> list[tuple[int, int]]:
        return sorted(self.pairs(), key=lambda s: (s[1], s[0]))

    def key(self, i: int, j: int) -> tuple:
        """All that the features depend on."""
        a, b = self.bounds[i], self.bounds[j]
        check = checks(self.raw[a:b], self.digits[j] - self.digits[i])
        beside = int(self.numeric[self.word[i]]) + int(self.numeric[self.word[j - 1] + 2])
        return (self.run[max(0, a - 2) : a], self.run[a:b], self.run[b : b + 2], check, *self.ahead(i), beside)

    @property
    def names(self) -> list[list[str]]:
        return [features(*self.key(i, j)) for i, j in self.segments]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


class Model:
    """Feature weights for each type (O has none) and transitions between types."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, len(TYPES)))
        self.trans = np.zeros((len(TYPES), len(TYPES)))
        self._known: dict[tuple, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_known": {}}

    def score(self, key: tuple) -> np.ndarray:
        found = self._known.get(key)
        if found is None:
            found = self.weights[[self.index[f] for f in features(*key) if f in self.index]].sum(0)
            if len(key[1]) <= 64:
                if len(self._known) >= REMEMBERED:
                    self._known.clear()
                self._known[key] = found
        return found

    def scores(self, lattice: Lattice) -> np.ndarray:
        return np.array([self.score(lattice.key(i, j)) for i, j in lattice.segments]).reshape(-1, len(TYPES))

    def cuts(self) -> np.ndarray:
        """[length, type]: a segment with less than this can't be on the best path: the path with O in its place is better."""
        before = (self.trans[:, :1] - self.trans).min(0)
        after = np.minimum(0, (self.trans[0] - self.trans).min(1))  # 0: nothing follows the last segment
        return before + after + np.arange(-1, MOST_TOKENS)[:, None] * self.trans[0, 0]

    def best(self, lattice: Lattice) -> list[tuple[int, int, str]]:
        """(start, end, type) of the best segmentation's entities, in characters of the run."""
        cuts = self.cuts() - 1e-9
        out: list[tuple[int, int, str]] = []
        piece: list[tuple[int, int, np.ndarray]] = []
        end = 0
        for i, j in lattice.pairs():
            score = self.score(lattice.key(i, j))
            if (score[1:] >= cuts[j - i, 1:]).any():
                if piece and i > end:
                    out += self._decoded(lattice, piece, end)
                    piece = []
                piece.append((i, j, score))
                end = max(end, j)
        return out + self._decoded(lattice, piece, end) if piece else out

    def _decoded(self, lattice: Lattice, piece: list[tuple[int, int, np.ndarray]], end: int) -> list[tuple[int, int, str]]:
        """The entities among segments between tokens that are O on every path."""
        begin, many = piece[0][0], len(TYPES)
        size = end - begin
        ending: list[list[int]] = [[] for _ in range(size + 1)]
        for k, (_, j, _) in enumerate(piece):
            ending[j - begin].append(k)
        value, into = np.full(many, -np.inf), np.empty((size + 1, many))
        came, back = np.zeros((size + 1, many), np.int8), np.full((size + 1, many), -1, np.int32)
        value[0] = 0
        for j in range(size + 1):
            if j:
                value = np.full(many, -np.inf)
                value[0] = into[j - 1, 0]
                for k in ending[j]:
                    gain = into[piece[k][0] - begin] + piece[k][2]
                    more = gain > value
                    more[0] = False
                    value[more], back[j, more] = gain[more], k
            reach = value[:, None] + self.trans
            came[j], into[j] = reach.argmax(0), reach.max(0)
        # a piece inside the run is followed by O
        y, j = int((value if end == lattice.size else value + self.trans[:, 0]).argmax()), size
        out = []
        while j:
            if y:
                i, k_end, _ = piece[back[j, y]]
                out.append((lattice.bounds[i], lattice.bounds[k_end], TYPES[y]))
                i -= begin
            else:
                i = j - 1
            y, j = int(came[i, y]), i
        return out[::-1]

    def learn(self, examples: list[tuple[Lattice, dict[tuple[int, int], int]]], passes: int, seed: int) -> None:
        """Adaptive stochastic gradient ascent on the conditional likelihood, with shrinkage."""
        named = [(lattice, lattice.segments, lattice.names, gold) for lattice, gold in examples]
        for _, _, names, _ in named:
            for own in names:
                for f in own:
                    self.index.setdefault(f, len(self.index))
        self.weights = np.zeros((len(self.index), len(TYPES)))
        seen, seen_trans = np.full(self.weights.shape, 1e-2), np.full(self.trans.shape, 1e-2)
        ready = []
        for lattice, segments, names, gold in named:
            sizes = [len(n) for n in names]
            flat = np.array([self.index[f] for n in names for f in n])
            starts = np.cumsum(sizes) - sizes
            target = np.zeros((len(sizes), len(TYPES)))
            for k, seg in enumerate(segments):
                if seg in gold:
                    target[k, gold[seg]] = 1
            follow, at, y = np.zeros_like(self.trans), 0, 0
            ends = {i: (j, t) for (i, j), t in gold.items()}
            while at < lattice.size:
                nxt, t = ends.get(at, (at + 1, 0))
                follow[y, t] += 1
                at, y = nxt, t
            ready.append((lattice.size, segments, flat, starts, np.array(sizes), target, follow))
        rng = np.random.default_rng(seed)
        for _ in range(passes):
            for e in rng.permutation(len(ready)):
                size, segments, flat, starts, sizes, target, follow = ready[e]
                scores = np.add.reduceat(self.weights[flat], starts, axis=0)
                chance, pairs = self.expected(size, segments, scores)
                rows, place = np.unique(flat, return_inverse=True)
                wrong = np.repeat(target - chance, sizes, axis=0)
                step = np.stack([np.bincount(place, wrong[:, y], len(rows)) for y in range(len(TYPES))], 1) - 1e-3 * self.weights[rows]
                step[:, 0] = 0
                seen[rows] += step * step
                self.weights[rows] += RATE * step / np.sqrt(seen[rows])
                step = follow - pairs - 1e-3 * self.trans
                seen_trans += step * step
                self.trans += RATE * step / np.sqrt(seen_trans)

    def expected(self, size: int, segments: list[tuple[int, int]], scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of segments with types, and expected transitions, by forward-backward."""
        many = len(TYPES)
        low, follow = -1e30, np.exp(self.trans)
        ahead, into = np.full((size + 1, many), low), np.full((size + 1, many), low)
        ahead[0, 0] = 0
        by_end: list[list[int]] = [[] for _ in range(size + 1)]
        by_start: list[list[int]] = [[] for _ in range(size + 1)]
        for k, (i, j) in enumerate(segments):
            by_end[j].append(k)
            by_start[i].append(k)
        begins, ends_at = np.array([s[0] for s in segments]), np.array([s[1] for s in segments])
        for j in range(size + 1):
            if j:
                ahead[j, 0] = into[j - 1, 0]
                if by_end[j]:
                    ahead[j, 1:] = _logsum((into[begins[by_end[j]]] + scores[by_end[j]])[:, 1:], 0)
            top = ahead[j].max()
            into[j] = np.log(np.exp(ahead[j] - top) @ follow) + top
        behind, out_of = np.zeros((size + 1, many)), np.full((size + 1, many), low)
        for i in range(size - 1, -1, -1):
            out_of[i, 0] = behind[i + 1, 0]  # given that a segment of this type starts at i
            if by_start[i]:
                out_of[i, 1:] = _logsum((behind[ends_at[by_start[i]]] + scores[by_start[i]])[:, 1:], 0)
            top = out_of[i].max()
            behind[i] = np.log(follow @ np.exp(out_of[i] - top)) + top
        total = _logsum(ahead[size], 0)
        chance = np.exp(into[begins] + scores + behind[ends_at] - total)
        chance[:, 0] = 0
        top = ahead[:size].max(1, keepdims=True)
        pairs = follow * (np.exp(ahead[:size] - top).T @ np.exp(out_of[:size] + top - total))
        return chance, pairs


def _flags(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whether each word can be part of an entity, and whether it names a credential."""

    def some(of: np.ndarray, pattern: str) -> np.ndarray:
        at = np.flatnonzero(of)
        out = np.zeros(len(words), bool)
        out[at] = pc.match_substring_regex(words.take(pa.array(at)), pattern).to_numpy(zero_copy_only=False)
        return out

    telling = pc.match_substring_regex(words, SIGN).to_numpy(zero_copy_only=False)
    telling = telling | some(~telling & (pc.utf8_length(words).to_numpy() >= LONG), ROW)
    telling |= some(~telling & (pc.count_substring(words, ":").to_numpy() > 2), GROUPS)
    return telling, some(pc.match_substring_regex(words, NAMED).to_numpy(zero_copy_only=False), NAMING)


def runs(texts: pa.Array) -> Iterator[tuple[int, int, str, str]]:
    """(row, start, run, text before) of each run; start in characters."""
    offsets, codes, words = base.split_words(texts)
    if not len(codes):
        return
    telling, naming = (flags[codes] for flags in _flags(words))
    row_of = np.searchsorted(offsets, np.flatnonzero(telling | naming), side="right") - 1
    for row in np.unique(row_of).tolist():
        text, told, more, at = texts[row].as_py(), [], [], 0
        own = slice(offsets[row], offsets[row + 1])
        for code in codes[own][telling[own]].tolist():
            word = words[code].as_py()
            at = text.index(word, at)
            while at and not text[at - 1].isspace() or not text[at + len(word) : at + len(word) + 1].isspace() and at + len(word) < len(text):
                at = text.index(word, at + 1)
            told.append((at, at + len(word)))
            at += len(word)
        starts = [a for a, _ in told]
        last = 0
        for m in VALUE.finditer(text) if naming[own].any() else ():
            at = m.end()
            k = bisect.bisect_right(starts, at) - 1
            if at < last or k >= 0 and at < told[k][1]:
                continue  # in a word that is found already
            a = at
            while a and not text[a - 1].isspace():
                a -= 1
            b = SPACE.search(text, at)
            last = b.start() if b else len(text)
            more.append((a, last))
        if told:
            more += [m.span(1) for m in BANK.finditer(text)]
        told = sorted(told + more)
        k = 0
        while k < len(told):
            start, end = told[k]
            k += 1
            while k < len(told) and text[end : told[k][0]].isspace():
                end = told[k][1]
                k += 1
            yield row, start, text[start:end], text[max(0, start - 48) : start]


def entities(model: Model, texts: pa.Array) -> dict[int, list[tuple[int, int, str]]]:
    """Entities of each row that has any."""
    out: dict[int, list[tuple[int, int, str]]] = {}
    for row, start, run, before in runs(texts):
        for a, b, kind in model.best(Lattice(run, before)):
            out.setdefault(row, []).append((start + a, start + b, kind))
    return out


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for a, b, kind in spans:
        parts += [text[at:a], f"[{kind}]"]
        at = b
    return "".join(parts) + text[at:]


WORDS = "the of and to for with from this that was are have der die das und nicht mit ein les des pour dans avec los las una para como more about report house river summer question please write meeting team garden".split()
LONGER = ("Versicherungsgesellschaft", "Geschwindigkeitsbegrenzung", "Datenschutzgrundverordnung", "responsabilidades", "internationalization", "disproportionately", "incomprehensibles", "gouvernementalement", "misunderstandings", "electroencephalogram", "Rechtsschutzversicherungen", "state-of-the-art-design", "father-in-law-to-be-soon", "getElementsByTagName", "addEventListenerOnce", "very_long_variable_name", "and/or/neither/nothing", "application/octet-stream", "counterrevolutionaries", "Krankenversicherungskarte")


def example(rng: np.random.Generator) -> tuple[str, list[tuple[int, int, str]]]:
    """A generated line, list or table with entities and look-alikes, and where the entities are."""
    pick = lambda *x: x[rng.integers(len(x))]
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    letters = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzéüñ"), n, p=[0.035] * 26 + [0.03] * 3))
    plain = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    mixed = lambda n, more="": "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + more), n))
    hexes = lambda n, of="0123456789abcdef": "".join(rng.choice(list(of), n))
    word = lambda: letters(int(rng.integers(1, 10))) if rng.random() < 0.6 else pick(*WORDS)
    octets = lambda: ".".join(str(rng.integers(0, pick(10, 100, 256, 256))) for _ in range(4))

    def account() -> str:
        country, inner = pick("DE", "FR", "ES", "GB", "NL"), number(int(rng.integers(14, 20)))
        inner = pick("", plain(4).upper()) + inner
        check = 98 - int("".join(str(int(c, 36)) for c in inner + country + "00")) % 97
        joint = f"{country}{check:02d}{inner}"
        return pick(joint, " ".join(joint[k : k + 4] for k in range(0, len(joint), 4)))

    def phone() -> str:
        return pick(f"+{number(1)} ({number(3)}) {number(3)}-{number(4)}", f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"+{number(2)} {number(2)} {number(4)} {number(4)}", f"{number(3)}.{number(3)}.{number(4)}", f"+1-{number(3)}-{number(3)}-{number(4)}", f"+{number(2)} {number(3)} {number(6)}", f"+{number(11)}", f"+1 {number(3)} {number(3)} {number(4)}", f"+{number(1)} ({number(3)}) {number(3)}-{number(4)}", f"01{number(2)} {number(int(rng.integers(6, 9)))}", f"0{number(2)}/{number(7)}", f"0{number(3)}-{number(6)}", f"+{number(2)} {number(1)} {number(2)} {number(2)} {number(2)} {number(2)}", f"+{number(2)} {number(3)} {number(3)} {number(3)}", f"6{number(2)} {number(3)} {number(3)}", f"0{number(4)} {number(6)}")

    def french() -> str:
        mark = pick(" ", " ", ".")
        return mark.join([f"0{int(rng.integers(1, 10))}", *(number(2) for _ in range(4))])

    def secret() -> tuple[str, bool]:
        """A key, and whether it goes without a name before it."""
        kind = rng.random()
        n = int(pick(16, 20, 24, 32, 32, 40, 40, 40, 48, 64))
        if kind < 0.45:
            return hexes(n - 2) + number(1) + pick("a", "f", "c"), n >= 32
        if kind < 0.6:
            return mixed(n - 2, "0123456789") + number(2), n >= 32
        if kind < 0.66:
            return hexes(max(n, 32), "abcdef"), True
        if kind < 0.74:
            return pick("ghp_", "gho_", "sk-", "sk_live_", "hf_", "glpat-", "npm_") + mixed(int(rng.integers(20, 41)), pick("", "0123456789")), True
        if kind < 0.78:
            return "AKIA" + mixed(16, "0123456789").upper(), True
        if kind < 0.86:
            return mixed(int(rng.integers(32, 65)), "0123456789+/" * 2) + pick("", "=", "=="), True
        if kind < 0.9:
            return mixed(int(rng.integers(16, 33))), False
        if kind < 0.95:
            return "".join(pick(*WORDS, plain(5), plain(6)) for _ in range(4)) + plain(5), False
        return pick(plain(5).title() + number(3) + pick("!", "#", "$"), pick("P@ss", "S3cr3t!", "p4ss-") + plain(4) + number(2), plain(6) + number(4)), False

    def entity(kind: str) -> str:
        if kind == "EMAIL":
            name = pick(plain(int(rng.integers(1, 9))), f"{plain(4)}.{plain(5)}", f"{letters(6)}.{number(2)}", f"{plain(5)}{number(3)}", f"{plain(3)}_{plain(4)}", f"{plain(4)}+{plain(3)}", f"{plain(4)}-{plain(3)}", f"{letters(5)}.{letters(3)}.{number(1)}", f"{plain(9)}.{plain(9)}")
            return f"{name}@{pick(plain(6), 'mail' + number(1), plain(4) + '.' + plain(5), plain(3) + '-' + plain(4), 'mail' + number(1) + '.' + plain(7))}.{pick('com', 'org', 'net', 'co.uk', 'de', 'io', 'fr', 'es')}"
        if kind == "PHONE":
            return french() if rng.random() < 0.15 else phone()
        if kind == "CARD":
            n = [number(4) for _ in range(4)]
            return pick("".join(n), "".join(n), " ".join(n), "-".join(n), f"3{number(3)} {number(6)} {number(5)}")
        if kind == "IP":
            if rng.random() < 0.45:
                groups = [hexes(int(rng.integers(1, 5))) for _ in range(8)]
                at, cut = int(rng.integers(1, 4)), int(rng.integers(2, 5))
                return pick(":".join(groups), ":".join(groups[:at]) + "::" + ":".join(groups[at + cut :][:3]))
            return octets() if rng.random() < 0.7 else near()
        return f"{number(3)}-{number(2)}-{number(4)}"

    def near() -> str:
        return pick(f"10.0.{rng.integers(0, 10)}.{rng.integers(1, 100)}", f"192.168.{rng.integers(0, 30)}.{rng.integers(1, 255)}", "127.0.0.1", f"172.16.{rng.integers(0, 9)}.{rng.integers(1, 20)}")

    def other() -> str:
        return pick(number(4), f"{number(1)}.{number(1)}", f"{number(1)}.{number(1)}.", f"{number(1)}.", f"version {number(1)}.", f"v{number(1)}.{number(2)}.{number(1)}", f"{number(3)},{number(3)}", f"20{number(2)}-0{number(1)}-1{number(1)}", f"1{number(1)}/0{number(1)}/20{number(2)}", f"{number(2)}:{number(2)}", f"${number(3)}.{number(2)}", f"{number(2)}%", f"@{plain(6)}", word() + number(2), f"order {number(int(rng.integers(5, 9)))}", f"({number(4)})", f"{number(1)}x{number(2)}", f"#{number(3)}", f"{number(3)} {number(2)}", f"{number(6)}", f"{number(3)}.{number(2)}", "a@b", f"{number(1)}.{number(1)}.{number(1)}", f"[{number(2)}]", f"{number(4)}-{number(4)}", f"{number(2)}{plain(2)}", f"978-{number(1)}-{number(4)}-{number(4)}-{number(1)}", f"{number(3)}.{300 + int(number(2))}.{number(1)}.{number(2)}",
            f"https://www.{plain(7)}.com/{plain(5)}/{number(4)}/{number(2)}/{plain(6)}-{plain(5)}", f"http://{plain(6)}.org/{plain(8)}?id={number(5)}", f"img_20{number(6)}_{number(6)}.jpg", f"20{number(2)}-0{number(1)}-1{number(1)}T{number(2)}:{number(2)}:{number(2)}Z", f"{number(2)}:{number(2)}:{number(2)}", f"{number(1)},{number(3)},{number(3)}", f"{number(1)} {number(3)} {number(3)}", f"19{number(2)}-20{number(2)}", f"{number(1)}.{number(4)}e-{number(2)}", f"{number(1)}.{number(int(rng.integers(4, 15)))}", f"-{number(2)}.{number(6)}", f"#{hexes(6)}", hexes(6) + number(1), f"pp. {number(3)}-{number(3)}", f"{number(2)}/{number(2)}", f"{plain(6)}_{plain(5)}_{plain(7)}_{number(2)}", f"§ {number(3)} {number(1)}", f"{number(2)} x {number(2)} x {number(2)}", pick(*LONGER), pick(*LONGER), pick(*LONGER) + ",", f"{pick('key', 'token', 'secret', 'password', 'Key')}: {pick(*WORDS)}", f"{pick('key', 'token', 'auth', 'Password')}: {plain(int(rng.integers(3, 10)))}", f"the {pick('key', 'secret', 'token')} = {pick('none', 'true', 'null', 'value', 'string')}", f"{number(2)}.{number(3)}.{number(3)}", f"ISO {number(4)}-{number(1)}:20{number(2)}", f"{number(1)}:{number(2)}:{number(2)}:{number(1)}")

    text, spans = "", []
    plan = rng.random()
    if plan < 0.14:  # a table of numbers
        cell = pick(lambda: number(5), lambda: number(int(rng.integers(1, 8))), lambda: f"{number(2)}.{number(2)}", lambda: number(3), lambda: number(4), lambda: number(10), lambda: f"{number(3)}-{number(2)}", lambda: f"-{number(1)}.{number(3)}", lambda: f"20{number(2)}", lambda: number(2), lambda: number(int(pick(12, 13, 18))))
        mark, wide = pick(" ", " ", "\t", "  "), int(rng.integers(2, 7))
        rows = [mark.join(cell() for _ in range(wide)) for _ in range(int(rng.integers(1, 5)))]
        return pick("", word() + " ", f"{word()} {word()}\n") + "\n".join(rows) + pick("", "\n" + word()), []
    if plan < 0.2:  # a list of entities of one kind
        kind = pick("EMAIL", "PHONE", "PHONE", "CARD", "IP", "SSN")
        for _ in range(int(rng.integers(2, 5))):
            text += pick("", "- ", f"{word()} ")
            made = entity(kind)
            while re.fullmatch(r"[\d /]+", made) and " " in made:  # plain numbers beside others are a table
                made = entity(kind)
            spans.append((len(text), len(text) + len(made), kind))
            text += made + "\n"
        return text + word(), spans
    marks = pick("", "", "", "!!", "%%%", "&&&", "***", "###", "$$$", " |")
    upper = marks == "!!" and rng.random() < 0.8
    for _ in range(int(rng.integers(1, 4))):
        text += " ".join(word() + pick("", "", "", ",", ".") + marks for _ in range(int(rng.integers(1, 4)))) + " "
        if rng.random() < 0.62:
            kind = TYPES[int(rng.integers(1, len(TYPES)))]
            lead, tail = pick("", "", "", "", "", "(", '"', "<"), ""
            if kind == "SECRET":
                made, alone = secret()
                lead = pick('token = "', 'TOKEN = "', 'token = "', 'api_key="', "key: ", 'secret = "', "password=", 'auth_token: "', "password: ", 'password = "', "pwd=", "Passwort: ", "api_key=", "'secret': '", "Authorization: Bearer ", "key=") if not alone or rng.random() < 0.6 else lead
                if lead.endswith(("Bearer ", "Passwort: ")) and len(made) < 20:
                    lead = "password: "
            elif kind == "IBAN":
                made, lead = account(), pick("", "", "IBAN ", "IBAN: ", "Konto ")
            else:
                made = entity(kind)
            upper &= kind not in ("SECRET", "IBAN") or kind == "SECRET" and made.lower() == made
            tail = {"(": ")", '"': '"', "<": ">", "'": "'"}.get(lead[-1:], "") + pick("", "", "", ".", ",", ";", "!") * (not marks) + marks
            if kind == "IP" and rng.random() < 0.2:
                lead = "ip "
            if kind == "PHONE" and rng.random() < 0.25:
                lead = pick("tel. ", "call ", "phone: ", "Tel.: ", "mobile ", "fax ", "appelez ")
            text += lead
            spans.append((len(text), len(text) + len(made), kind))
            text += made
            if kind not in ("SECRET", "IBAN") and " " not in made and rng.random() < 0.12:  # said twice
                text += " "
                spans.append((len(text), len(text) + len(made), kind))
                text += made
            text += tail
        else:
            text += other() + marks
        text += pick(" ", " ", " ", "\n")
    text += word()
    text = text.upper() if upper and len(text.upper()) == len(text) else text
    if rng.random() < 0.04 and all(kind != "IBAN" for _, _, kind in spans):  # digits of another script
        text = text.translate({48 + k: chr(0x660 + k) for k in range(10)})
    return text, spans


_trained: dict[int, Model] = {}


def train(seed: int = 11) -> Model:
    """The model learned from generated examples; once in a process."""
    if seed in _trained:
        return _trained[seed]
    rng = np.random.default_rng(seed)
    made = [example(rng) for _ in range(EXAMPLES)]
    examples = []
    for row, start, run, before in runs(pa.array([t for t, _ in made])):
        lattice = Lattice(run, before)
        at = {b: k for k, b in enumerate(lattice.bounds)}
        gold = {(at[a - start], at[b - start]): TYPES.index(kind) for a, b, kind in made[row][1] if a - start in at and b - start in at and start <= a and b <= start + len(run)}
        if set(gold) <= set(lattice.segments) and lattice.segments:
            examples.append((lattice, gold))
    model = Model()
    model.learn(examples, PASSES, seed)
    _trained[seed] = model
    return model


def _list(found: list[list[tuple[int, int, str]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b, "type": t} for a, b, t in spans] for spans in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string())])))


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, spans, redacted) of the documents that hold personal data."""
    model = model or train()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in base.sized(batches, "text"):
            found = entities(model, batch.column(1))
            some = batch.take(pa.array(list(found), pa.int64()))
            spans = list(found.values())
            yield pa.RecordBatch.from_arrays([some.column(0), _list(spans), pa.array([masked(t, s) for t, s in zip(some.column(1).to_pylist(), spans)], pa.string())], ["doc_id", "spans", "redacted"])

    return base.mapped(texts, run, f"doc_id bigint, spans {SPANS}, redacted string")


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs, all columns, with each entity in `text` replaced by its type in brackets."""
    model = model or train()
    place = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, (T.LongType, T.IntegerType)) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in base.sized(batches, "text"):
            found = entities(model, batch.column(place))
            if found:
                columns = batch.columns
                texts = columns[place].to_pylist()
                for k, spans in found.items():
                    texts[k] = masked(texts[k], spans)
                columns[place] = pa.array(texts, columns[place].type)
                if count is not None:
                    sizes = columns[count].to_pylist()
                    for k in found:
                        sizes[k] = len(texts[k])
                    columns[count] = pa.array(sizes, columns[count].type)
                batch = pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
            yield batch

    return base.mapped(docs, run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(base.table(spark, sf_dir, "documents"))


QUERIES = {"op2_pii": op2_pii}
ORACLE: dict[str, str] = {}
