"""Repair of text from scanned pages by a noisy channel: heads and page numbers out, cut words joined, misread words corrected.

Language model: word and word-pair counts over all chunks of documents with a text layer: all that are seen LEAST_COUNT times and make LEAST_SHARE of all
words (a share bounds their number whatever the corpus; a pair takes 12 bytes of a broadcast). Channel: character confusions (a right string and what it is read as) with probabilities estimated
from the corpus: all tokens of scanned chunks that are no words are aligned with the words they may be misread from, in ROUNDS passes of expectation
and maximisation over their counts, in the cluster (channel_of). Every line is decoded by Viterbi: the candidates of a word are itself and the words of the model that
become it by one or two confusions; the path with the best product of channel and word-pair probabilities is taken. Words that are not in the
model (names) are corrected only where their letters are impossible: a letter-pair model of rare words decides.

Running heads: lines are told apart by a key in which confusable strings coincide, so misread forms have the same key. A pattern is a line
with its rare words replaced by a blank. Patterns whose lines come back in their documents, in many documents, are
those of heads; a head is a line without a sentence end that has such a pattern, or whose key stands REPEATS times in its document. Keys
that stand in a share of SHARED of the documents are notices of the site, not heads; a share bounds their number by the lines of a document over it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import current_manifest, cut, process_state, small

#: Documents whose numbers and flags (9 bytes each) are broadcast at most.
NARROW_ROWS = 1_000_000
#: Occurrences of a word or pair of the model: at least so many, and this share of all words.
LEAST_COUNT, LEAST_SHARE = 5, 1e-7
#: Documents that may share the key of a running head: so many, and this share of the scanned documents.
SHARED_HEAD, SHARED = 8, 0.002
#: Passes in which the channel is estimated, and its probability before anything is seen.
ROUNDS, PRIOR = 4, 0.004
HEAD_LENGTH = 100
REPEATS = 5
#: Most words of a head with a pattern.
PATTERN_WORDS = 12
#: Longer tokens are codes or addresses.
LONGEST_WORD = 32

#: Right strings and what scans turn them into.
CONFUSIONS = (
    ("o", "0"), ("i", "1"), ("l", "1"), ("s", "5"), ("g", "9"), ("b", "6"), ("b", "8"), ("z", "2"), ("t", "f"), ("e", "c"), ("d", "cl"),
    ("n", "ri"), ("h", "li"), ("m", "rn"), ("u", "ii"), ("w", "vv"), ("l", "i"), ("i", "l"), ("cl", "d"), ("rn", "m"), ("a", "o"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("ff", "ﬀ"), ("ffi", "ﬃ"), ("ffl", "ﬄ"),
    ("ti", "\x00"), ("tt", "\x00"), ("ft", "\x00"), ("fi", "\x00"), ("fl", "\x00"), ("ff", "\x00"),
    ("भ", "म"), ("म", "भ"), ("ध", "घ"), ("घ", "ध"), ("ब", "व"), ("व", "ब"), ("क", "फ"), ("ष", "प"), ("ड", "ङ"), ("थ", "य"), ("य", "थ"), ("प", "ष"), ("फ", "क"),
)
_PLACE = {c: i for i, c in enumerate(CONFUSIONS)}
#: Letters read for digits.
DIGITS = {"o": "0", "O": "0", "D": "0", "Q": "0", "l": "1", "I": "1", "i": "1", "|": "1", "Z": "2", "z": "2", "S": "5", "s": "5", "b": "6", "G": "6", "T": "7", "B": "8", "g": "9", "q": "9"}
_LOST = ("ti", "fi", "fl", "ff", "tt", "ft", "ffi")
_KEEP = math.log(0.98)

_HYPHEN_END = regex.compile(r"([\p{L}\p{M}\p{Nd}\x00ﬀ-ﬄ]+(?:[-'’][\p{L}\p{M}\p{Nd}]+)*)[-‐‑¬\xad]\s*$")
_WORD_START = regex.compile(r"^\s*([\p{L}\p{M}\p{Nd}\x00ﬀ-ﬄ]+(?:[-'’][\p{L}\p{M}\p{Nd}]+)*)")
_EDGE = regex.compile(r"^[^\p{L}\p{M}\p{Nd}\x00]+|[^\p{L}\p{M}\p{Nd}\x00]+$")
_NUMBER = regex.compile(r"^(?=.*\d)(?=.*[A-Za-z|])[\dA-Za-z|]+(?:[,.][\dA-Za-z|]+)*$")
_NUM = r"[\dlIOoSB]{1,5}"
_PAGE = regex.compile(
    rf"^(?:{_NUM}\s*/\s*{_NUM}|[-–—]\s*{_NUM}\s*[-–—]|\[\s*{_NUM}\s*\]|\(\s*\d{{1,5}}\s*\)|~\s*{_NUM}\s*~|(?=.*\d)\d{{1,4}}|"
    rf"p\s*a\s*[g9]\s*[ec]\s*[|:]?\s*{_NUM}(?:\s+[o0][ft]\s+{_NUM})?|p[.]?\s*{_NUM}|p[ūu]rishth?\s*{_NUM}|[पष]ृ[षप]्ठ\s*{_NUM}(?:\s*,?\s*[कफ]ुल\s*{_NUM})?|"
    rf"पान\s*{_NUM}|[ivxl]{{1,6}})$",
    regex.IGNORECASE,
)
_ROMAN = regex.compile(r"^(?:x{0,3})(?:ix|iv|v?i{0,3})$", regex.IGNORECASE)
_CLOSING, _HYPHENS = "\"'”’)]", "-‐‑¬\xad"
_PLAIN = regex.compile(r"^(?:[a-zA-Z]+|[ऀ-ॣ॰-ॿ]+)$")


def canonical(text: str) -> str:
    """The letters of a line in a form in which confusable strings coincide, word by word."""
    out = []
    for w in text.split():
        c = _CANONICAL.get(w)
        if c is None:
            if len(_CANONICAL) > 500_000:
                _CANONICAL.clear()
            c = w.lower()
            for right, read in (("m", "rn"), ("d", "cl"), ("n", "ri"), ("h", "li"), ("u", "ii"), ("w", "vv"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("ff", "ﬀ")):
                c = c.replace(read, right)
            c = _CANONICAL[w] = _NO_LETTER.sub("", c.translate(_CANON))
        out.append(c)
    return "".join(out)


_CANONICAL: dict[str, str] = {}
_CORES: dict[str, str] = {}
_NO_LETTER = regex.compile(r"[^\p{L}\p{M}]+")
_SIDE_NUMBER = regex.compile(r"^\d{1,4}\s{2,}|\s{2,}\d{1,4}$")
_TWO_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]")
_BULLET = regex.compile(r"^[\(\[]?\w{1,4}[\)\].]")
_DIGIT = regex.compile(r"\d")
_MISREAD_PAGES = regex.compile(r"[lIO]\s*/|/\s*[lIO]")
_NOT_LETTERS = regex.compile(r"^\P{L}*")
_FIRST_TOKEN = regex.compile(r"\S*")
_CANON = str.maketrans({"a": "o", "0": "o", "1": "l", "i": "l", "5": "s", "9": "g", "6": "b", "8": "b", "c": "e", "f": "t", "2": "z", "म": "भ", "घ": "ध", "ब": "व", "फ": "क", "प": "ष", "ङ": "ड", "थ": "य"})


def _hash(text: str) -> int:
    x = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)  # as Spark's xxhash64
    return x - (1 << 64) if x >> 63 else x


def core(token: str) -> str:
    """A token in lower case without punctuation around it."""
    c = _CORES.get(token)
    if c is None:
        if len(_CORES) > 500_000:
            _CORES.clear()
        c = _CORES[token] = _EDGE.sub("", token).lower()
    return c


def is_page_number(line: str) -> bool:
    s = line.strip()
    if not s or len(s) > 24 or not _PAGE.match(s):
        return False
    return bool(_DIGIT.search(s)) or bool(_ROMAN.match(s)) or bool(_MISREAD_PAGES.search(s))


def head_candidate(line: str) -> str | None:
    """The line without a page number at either end, if it may be a running head."""
    s = line.strip()
    if not 3 < len(s) <= HEAD_LENGTH or s[0] == "|" or s.rstrip(_CLOSING)[-1:] in ".?!।॥:;,":
        return None
    if "  " in s:
        s = _SIDE_NUMBER.sub("", s)
    return s if _TWO_LETTERS.search(s) and not _BULLET.match(s) else None


def correctable(word: str) -> bool:
    """Words of common length that are mostly letters; codes and numbers are no misread words."""
    return len(word) <= LONGEST_WORD and 2 * sum(c.isalpha() or c == "\x00" or "ऀ" <= c <= "ॣ" for c in word) > len(word)


class Pairs:
    """Counts of word pairs by hash, 12 bytes each."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]

    def get(self, pair: tuple[str, str], other: int = 0) -> int:
        h = _hash(f"{pair[0]}\t{pair[1]}")
        at = self.hashes.searchsorted(h)
        return int(self.counts[at]) if at < len(self.hashes) and self.hashes[at] == h else other


class Model:
    """Words, word pairs and letter pairs, and the decoding with them."""

    def __init__(self, words: dict[str, int], pairs: Pairs | dict[tuple[str, str], int], letters: dict[str, int], channel: dict[tuple[str, str], float] | None = None):
        self.words, self.pairs = words, pairs
        #: Log probability of each confusion.
        self.channel = {c: math.log((channel or {}).get(c, PRIOR)) for c in CONFUSIONS}
        self.total = float(sum(words.values())) or 1.0
        self.letters, self.letter_total = letters, float(sum(letters.values())) or 1.0
        self.seen: dict[str, list[tuple[str, float]]] = {}
        self.respelt: dict[str, str] = {}
        by_read: dict[str, list[str]] = {}
        for right, read in CONFUSIONS:
            by_read.setdefault(read, []).append(right)
        self.by_read = by_read
        self.reads = sorted(by_read, key=len, reverse=True)
        self.known = frozenset(canonical(w) for w in words)
        self.parts: dict[str, tuple[str, bool]] = {}
        #: Words of the model that no other word of it is mistaken for, and tokens, as they stand in texts, of such words.
        self.sure = frozenset(w for w in words if len(self.candidates(w)) == 1)
        self.clean: set[str] = set()
        self.numbers: dict[str, str | None] = {}
        self.logs: dict[tuple[str, str], float] = {}

    def undo(self, word: str) -> dict[str, float]:
        """Strings that one confusion turns into the word, with the log probability of the likeliest."""
        out: dict[str, float] = {}
        for read in self.reads:
            at = word.find(read)
            while at >= 0:
                for right in self.by_read[read]:
                    w, p = word[:at] + right + word[at + len(read) :], self.channel[right, read]
                    if p > out.get(w, -99.0):
                        out[w] = p
                at = word.find(read, at + 1)
        return out

    def sources(self, word: str) -> list[tuple[str, tuple[str, str]]]:
        """(word of the model, confusion) by which the word may have come about."""
        found = []
        for read in self.reads:
            at = word.find(read)
            while at >= 0:
                found += [(w, (right, read)) for right in self.by_read[read] if (w := word[:at] + right + word[at + len(read) :]) in self.words]
                at = word.find(read, at + 1)
        return found

    def candidates(self, word: str) -> list[tuple[str, float]]:
        """(word, log channel probability): itself and the words of the model one or two confusions away."""
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) > 300_000:
                self.seen.clear()
            found = self.seen[word] = [(word, _KEEP)]
            if not correctable(word):
                return found
            once = self.undo(word)
            found += [(w, p) for w, p in once.items() if w in self.words and w != word]
            if len(found) == 1 and word not in self.words and len(word) > 3:
                twice: dict[str, float] = {}
                for w, p in once.items():
                    for x, q in self.undo(w).items():
                        if x in self.words and x != word and p + q > twice.get(x, -99.0):
                            twice[x] = p + q
                found += twice.items()
            self.seen[word] = found
        return found

    def log_p(self, before: str, word: str) -> float:
        known = self.logs.get((before, word))
        if known is None:
            if len(self.logs) > 500_000:
                self.logs.clear()
            p = 0.3 * (self.words.get(word, 0) + 0.02) / self.total
            b = self.words.get(before, 0)
            if b:
                p += 0.7 * self.pairs.get((before, word), 0) / b
            known = self.logs[before, word] = math.log(p)
        return known

    def spelling(self, word: str) -> float:
        """Log probability of a word's letter pairs among rare words."""
        padded = f"^{word}$"
        return sum(math.log((self.letters.get(padded[i : i + 2], 0) + 0.05) / self.letter_total) for i in range(len(padded) - 1))

    def rare(self, word: str) -> str:
        """A word outside the model, respelt where its letters are all but impossible."""
        if len(word) < 4 or word in self.words or not correctable(word):
            return word
        if word in self.respelt:
            return self.respelt[word]
        if len(self.respelt) > 300_000:
            self.respelt.clear()
        self.respelt[word] = right = self._rare(word)
        return right

    def _rare(self, word: str) -> str:
        padded = f"^{word}$"
        if _PLAIN.match(word) and all(padded[i : i + 2] in self.letters for i in range(len(padded) - 1)):
            return word
        best, score, step = word, self.spelling(word) / (len(word) + 1), 0
        frontier = {word}
        for step in range(2):
            frontier = {w for x in frontier for w in self.undo(x)}
            for w in frontier:
                if _PLAIN.match(w):
                    s = self.spelling(w) / (len(w) + 1) - 0.05 * (step + 1)
                    if s > score:
                        best, score = w, s
            if best != word:
                break
        if best == word:
            return word
        strange = not _PLAIN.match(word)
        return best if strange or score - self.spelling(word) / (len(word) + 1) > 0.8 else word

    def decode(self, tokens: list[str], before: str = "") -> list[str]:
        """Viterbi over the candidates of the cores of a line's tokens."""
        columns: list[list[tuple[str, float, int]]] = []
        last: list[tuple[str, float]] = [(before, 0.0)]
        for t in tokens:
            options = self.candidates(t) if t else [(t, 0.0)]
            column = []
            for w, channel in options:
                score, back = max((s + self.log_p(p, w), i) for i, (p, s) in enumerate(last))
                column.append((w, score + channel, back))
            columns.append(column)
            last = [(w, s) for w, s, _ in column]
        out, at = [], max(range(len(last)), key=lambda i: last[i][1]) if columns else 0
        for column in reversed(columns):
            out.append(column[at][0])
            at = column[at][2]
        return out[::-1]

    def number(self, token: str) -> str | None:
        """The number of a token, with whatever stands around it, of digits with misread ones among them, else null."""
        if token not in self.numbers:
            if len(self.numbers) > 300_000:
                self.numbers.clear()
            self.numbers[token] = self._number(_EDGE.sub("", token))
        return self.numbers[token]

    def _number(self, token: str) -> str | None:
        if not _NUMBER.match(token) or any(c.isalpha() and c not in DIGITS for c in token):
            return None
        if token.lower() in self.words:
            return None
        digits = sum(c.isdigit() for c in token)
        letters = sum(c.isalpha() or c == "|" for c in token)
        return "".join(DIGITS.get(c, c) for c in token) if digits >= letters else None


def repair(text: str, model: Model, heads: frozenset[int], patterns: frozenset[int], notices: frozenset[int], head_words: frozenset[str]) -> tuple[str, list[tuple[str, str]]]:
    """(paragraphs, fixes): the repaired text and the (fix, item) of every repair."""
    fixes: list[tuple[str, str]] = []
    body: list[str] = []
    for line in text.split("\n"):
        if is_page_number(line):
            fixes.append(("line", line.strip()))
            continue
        head = head_candidate(line)
        if head is not None:
            key = _hash(canonical(head))
            if key not in notices and (key in heads or len(head.split()) <= PATTERN_WORDS and _hash(pattern(canonical_words(head, model), head_words)) in patterns):
                fixes.append(("line", line.strip()))
                continue
        body.append(line)
    # Join the words cut at line ends; blank lines between the halves came from what was left out.
    lines: list[str] = []
    i = 0
    while i < len(body):
        line = body[i]
        while line.rstrip()[-1:] in _HYPHENS and line.strip() and (m := _HYPHEN_END.search(line)) is not None:
            j = i + 1
            while j < len(body) and not body[j].strip():
                j += 1
            n = _WORD_START.match(body[j]) if j < len(body) else None
            if n is None:
                break
            a, b = m.group(1), n.group(1)
            plain, kept = core(a + b), core(f"{a}-{b}")
            hyphen = model.words.get(kept, 0) > model.words.get(plain, 0) or plain not in model.words and b[0].isupper() and not a.isupper()
            joined = f"{a}-{b}" if hyphen else a + b
            lead, rest = line[: m.start(1)], body[j][n.end(1) :]
            token = _FIRST_TOKEN.match(rest).group()
            whole = core((lead[lead.rfind(" ") + 1 :] + joined + token).strip())
            right = model.decode([whole], "")[0]
            if right not in model.words and not hyphen:
                right = model.rare(right)
            fixes.append(("join", right))
            # The rest of the next line stays a line of its own, so its end is looked at in turn.
            line = lead + joined + token
            body[j] = rest[len(token) :].lstrip()
            if body[j].strip():
                break
            i = j
        lines.append(line)
        i += 1
    out, before = [], ""
    for line in lines:
        raw = line.split()
        if not raw:
            out.append("")
            before = ""
            continue
        if model.clean.issuperset(raw):
            out.append(" ".join(raw))
            before = core(raw[-1])
            continue
        cores = [_CORES.get(t) or core(t) for t in raw]
        if model.sure.issuperset(cores):
            if len(model.clean) > 500_000:
                model.clean.clear()
            model.clean.update(raw)
            out.append(" ".join(raw))
            before = cores[-1]
            continue
        for k, t in enumerate(raw):  # numbers first: they are no words of the model
            n = model.number(t) if cores[k] not in model.words else None
            if n is not None:
                fixes.append(("char", n.lower()))
                raw[k] = t.replace(_EDGE.sub("", t), n)
                cores[k] = n.lower()
        k = 0
        while k + 1 < len(raw):  # a lost ligature leaves a gap inside the word
            a, b = cores[k], cores[k + 1]
            if a and b and (a not in model.words or b not in model.words) and raw[k][-1:].isalpha() and raw[k + 1][:1].isalpha():
                whole = max((a + x + b for x in _LOST if a + x + b in model.words), key=model.words.get, default=None)
                if whole is not None and not (a in model.words and len(model.candidates(b)) > 1):
                    fixes.append(("char", whole))
                    lead = _NOT_LETTERS.match(raw[k]).group()
                    tail = raw[k + 1][len(raw[k + 1].rstrip(".,;:)]\"'।")) :]
                    raw[k : k + 2] = [lead + whole + tail]
                    cores[k : k + 2] = [whole]
            k += 1
        right = cores if all(c in model.sure or len(model.candidates(c)) == 1 for c in cores if c) else model.decode(cores, before)
        for k, (c, w) in enumerate(zip(cores, right)):
            if w == c and (not c or c in model.words):
                continue
            if c and w == c and not c[0].isdigit() and "/" not in c:
                w = model.rare(c)
            if w != c:
                fixes.append(("char", w))
                bare = _EDGE.sub("", raw[k])
                raw[k] = raw[k].replace(bare, w[:1].upper() + w[1:] if bare[:1].isupper() else w)
        before = right[-1]
        out.append(" ".join(raw))
    paragraphs, current = [], []
    for line in [*out, ""]:
        if line:
            current.append(line)
        elif current:
            paragraphs.append(" ".join(current))
            current = []
    return "\n\n".join(paragraphs), fixes


def canonical_words(head: str, model: Model) -> list[tuple[str, bool]]:
    """The canonical form of each word of a head, and whether the model has the word."""
    out = []
    for w in head.split():
        p = model.parts.get(w)
        if p is None:
            if len(model.parts) > 500_000:
                model.parts.clear()
            c = canonical(w)
            p = model.parts[w] = (c, core(w) in model.words or c in model.known)
        out.append(p)
    return out


def pattern(words: list[tuple[str, bool]], head_words: frozenset[str] = frozenset()) -> str:
    """A head with the words that are not in the model replaced by a blank; without a known and an unknown word, no pattern.

    Heads wholly of words that running text has not are told by the words that heads of many documents share.
    """
    if not any(k for _, k in words):
        words = [(w, w in head_words) for w, _ in words]
    known = sum(k for _, k in words)
    return " ".join(w if k else "*" for w, k in words) if 0 < known < len(words) else ""


def aligned(model: Model, strange: Iterable[tuple[str, int]]) -> Counter:
    """How often strange tokens have the same sources: by (places of the confusions in CONFUSIONS, counts of their words). The count of a single word tells nothing."""
    out: Counter = Counter()
    for t, n in strange:
        if correctable(t) and (of := sorted((_PLACE[c], model.words[w]) for w, c in model.sources(t))):
            out[tuple(c for c, _ in of), tuple(k for _, k in of) if len(of) > 1 else (1,)] += n
    return out


def shares(rows: Iterable[tuple[tuple, tuple, int]], channel: dict[tuple[str, str], float]) -> dict[tuple[str, str], float]:
    """How often each confusion was seen, if every strange token (confusions, counts, times) is shared out by word frequency and the confusions' probabilities."""
    seen = dict.fromkeys(CONFUSIONS, 0.0)
    for confusions, counts, n in rows:
        options = [CONFUSIONS[c] for c in confusions]
        weights = [channel[c] * k for c, k in zip(options, counts)]
        total = sum(weights)
        for c, w in zip(options, weights):
            seen[c] += n * w / total
    return seen


def channel_of(model: Model, strange: dict[str, int] | Callable[[dict], dict], scanned: float) -> dict[tuple[str, str], float]:
    """Probability of each confusion. strange: tokens of scanned text that are no words of the model, with their counts, or a function that shares them out as `shares` does; scanned: tokens of scanned text over those the model was counted in.

    Each strange token is shared out among the words it may be a misreading of, by word frequency and the confusions' present probabilities; a confusion's
    share over the places where its right string was printed is its new probability. PRIOR counts as much as 50 places.
    """
    if isinstance(strange, dict):
        rows = [(c, k, n) for (c, k), n in aligned(model, strange.items()).items()]
        strange = lambda channel: shares(rows, channel)
    places = dict.fromkeys(CONFUSIONS, 0.0)
    for right in {r for r, _ in CONFUSIONS}:
        n = scanned * sum(c * w.count(right) for w, c in model.words.items() if right in w)
        for c in CONFUSIONS:
            if c[0] == right:
                places[c] = n
    channel = dict.fromkeys(CONFUSIONS, PRIOR)
    for _ in range(ROUNDS):
        seen = strange(channel)
        channel = {c: min(max((seen.get(c, 0.0) + 50 * PRIOR) / (places[c] + seen.get(c, 0.0) + 50), 1e-5), 0.2) for c in CONFUSIONS}
    return channel


def _count(clean: DataFrame) -> tuple[dict[str, int], Pairs, dict[str, int], int]:
    """Words, pairs and the letter pairs of rare words, over all the texts, and the number of words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: Counter = Counter()
        singles: Counter = Counter()

        def rows() -> Iterator[pa.RecordBatch]:
            for kind, c in ((0, singles), (1, pairs)):
                items = list(c.items())
                for i in range(0, len(items), 100_000):
                    part = items[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([w if kind == 0 else f"{w[0]}\t{w[1]}" for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64()), pa.array([kind] * len(part), pa.int32())], ["w", "n", "kind"])
                c.clear()

        known: dict[str, str] = {}
        for b in batches:
            for text in b.column("text").to_pylist():
                tokens = []
                for t in text.split():
                    c = known.get(t)
                    if c is None:
                        if len(known) > 400_000:
                            known.clear()
                        c = known[t] = _EDGE.sub("", t).lower()
                    if c:
                        tokens.append(c)
                singles.update(tokens)
                pairs.update(zip(tokens, tokens[1:]))
            if len(pairs) > 600_000:
                yield from rows()
        yield from rows()

    counted = clean.select("text").mapInArrow(run, "w string, n long, kind int").groupBy("kind", "w").agg(F.sum("n").alias("n")).where((F.col("n") >= LEAST_COUNT) | (F.col("kind") == 0))
    counted = cut(counted)
    total = counted.where(F.col("kind") == 0).agg(F.sum("n")).first()[0] or 0
    seldom = max(LEAST_COUNT, math.ceil(total * LEAST_SHARE))
    often = counted.where(F.col("n") >= seldom)
    found = often.where((F.col("kind") == 0) & F.col("w").rlike(r"^[^\d]+$")).select("w", "n").orderBy(F.desc("n"), "w").toArrow()
    words = dict(zip(found.column("w").to_pylist(), found.column("n").to_pylist()))
    found = often.where(F.col("kind") == 1).select(F.xxhash64("w").alias("h"), F.least("n", F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    pairs = Pairs(found.column("h").to_numpy(), found.column("n").to_numpy())
    # Names repeat little: words seen a few times only, wholly of letters, tell which letter pairs there are.
    rare = counted.where((F.col("kind") == 0) & F.col("w").rlike(r"^[a-z]{4,}$|^[ऀ-ॣ]{3,}$"))
    padded = F.concat(F.lit("^"), "w", F.lit("$"))
    grams = rare.select(F.explode(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2)))).alias("g")).groupBy("g").count().collect()
    letters = {r["g"]: r["count"] for r in grams}
    # A handful of strays (misprints) should not make a pair possible.
    least = max(2, sum(letters.values()) // 20_000)
    return words, pairs, {g: n for g, n in letters.items() if n >= least}, total


def _model(shared) -> Model:
    """The model of a broadcast, built once per worker process."""
    state, value = process_state("scanned"), shared.value
    if state.get("of") is not value:
        state["of"], state["model"] = value, Model(*value)
    return state["model"]


def _strange(tokens: DataFrame, model) -> Callable[[dict], dict]:
    """The function by which channel_of shares out all strange tokens (token, times) in the cluster."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(model)
        for b in batches:
            rows = aligned(m, zip(b.column("token").to_pylist(), b.column("times").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([list(c) for c, _ in rows], pa.list_(pa.int32())), pa.array([list(k) for _, k in rows], pa.list_(pa.int64())), pa.array(list(rows.values()), pa.int64())], ["c", "k", "n"])

    rows = cut(tokens.mapInArrow(align, "c array<int>, k array<bigint>, n long").groupBy("c", "k").agg(F.sum("n").alias("n")))

    def share(channel: dict[tuple[str, str], float]) -> dict[tuple[str, str], float]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                seen = shares(zip(*(b.column(x).to_pylist() for x in ("c", "k", "n"))), channel)
                yield pa.RecordBatch.from_arrays([pa.array([_PLACE[c] for c in seen], pa.int32()), pa.array(list(seen.values()), pa.float64())], ["c", "n"])

        found = rows.mapInArrow(run, "c int, n double").groupBy("c").agg(F.sum("n").alias("n")).collect()
        return {CONFUSIONS[r["c"]]: r["n"] for r in found}

    return share


class Repairer:
    """Model and heads of a corpus; `fixes` and `texts` repair its scanned chunks."""

    def __init__(self, chunks: DataFrame, manifest: DataFrame):
        """Counts over all chunks of documents with a text layer, heads over all of those without."""
        spark = chunks.sparkSession
        held = cut(current_manifest(manifest.select("id", "line_no", "has_text_layer")).select(F.xxhash64("id").alias("_doc"), F.coalesce("has_text_layer", F.lit(False)).alias("_layer")))
        flagged = chunks.where(F.col("text").isNotNull() & F.col("document_id").isNotNull()).select("chunk_id", "text", F.xxhash64("document_id").alias("_doc")).join(small(held, NARROW_ROWS), "_doc")
        self.scanned = flagged.where(~F.col("_layer")).select("chunk_id", "_doc", "text")
        words, pairs, letters, total = _count(flagged.where("_layer"))
        self.model = spark.sparkContext.broadcast((words, pairs, letters, None))
        self._heads(total)

    def _heads(self, total: int) -> None:
        """Heads, and the channel, from one pass over all scanned texts."""
        model, spark = self.model, self.scanned.sparkSession

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = _model(model)
            for b in batches:
                docs, keys, pats, texts = [], [], [], []
                tokens = Counter(chain.from_iterable(map(str.split, b.column("text").to_pylist())))
                strange: Counter = Counter()
                for t, n in tokens.items():
                    if (c := core(t)) and c not in m.words and m.sources(c):
                        strange[c] += n
                for doc, text in zip(b.column("_doc").to_pylist(), b.column("text").to_pylist()):
                    for line in text.split("\n"):
                        head = head_candidate(line)
                        if head is not None:
                            docs.append(doc)
                            keys.append(_hash(canonical(head)))
                            words = canonical_words(head, m)
                            p = pattern(words) if len(words) <= PATTERN_WORDS else ""
                            pats.append(_hash(p) if p else 0)
                            texts.append(" ".join(w for w, _ in words) if 1 < len(words) <= PATTERN_WORDS and not any(k for _, k in words) else None)
                # A row without a document is a strange token (words) with its count (pat); one without words has the number of all tokens.
                n = len(strange) + 1
                docs += [None] * n
                keys += [_hash(t) for t in strange] + [0]
                pats += [*strange.values(), sum(tokens.values())]
                texts += [*strange, None]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(keys, pa.int64()), pa.array(pats, pa.int64()), pa.array(texts, pa.string())], ["_doc", "key", "pat", "words"])

        found = self.scanned.mapInArrow(run, "_doc long, key long, pat long, words string")
        mine = F.when(F.col("_doc").isNotNull(), F.col("pat"))
        per = cut(found.groupBy("_doc", "key", F.when(F.col("_doc").isNull(), F.col("words")).alias("token")).agg(F.count("*").alias("n"), F.max(mine).alias("pat"), F.max("words").alias("words"), F.sum(F.when(F.col("_doc").isNull(), F.col("pat"))).alias("times")))
        seen = per.where(F.col("_doc").isNull())
        here = seen.where(F.col("token").isNull()).agg(F.sum("times")).first()[0] or 0
        self.channel = channel_of(Model(*model.value), _strange(seen.where(F.col("token").isNotNull()).select("token", "times"), model), here / max(total, 1))
        self.model = spark.sparkContext.broadcast((*model.value[:3], self.channel))
        per = per.where(F.col("_doc").isNotNull())
        least = max(SHARED_HEAD, math.ceil(SHARED * per.select("_doc").distinct().count()))
        shared = per.groupBy("key").agg(F.count("*").alias("docs")).where(F.col("docs") > least)
        own = per.join(small(cut(shared.select("key"))), "key", "left_anti")
        notices = frozenset(r["key"] for r in shared.select("key").collect())
        # Words of heads that running text does not have: those of repeated lines of many documents.
        strange = own.where((F.col("n") > 1) & F.col("words").isNotNull()).select("_doc", F.explode(F.split("words", " ")).alias("w")).where(F.col("w") != "")
        shared_words = strange.distinct().groupBy("w").agg(F.count("*").alias("docs")).where(F.col("docs") > least)
        head_words = [r["w"] for r in shared_words.collect()]
        listed = F.array(*map(F.lit, head_words)) if head_words else F.array().cast("array<string>")
        filled = F.array_join(F.transform(F.split("words", " "), lambda w: F.when(F.array_contains(listed, w), w).otherwise(F.lit("*"))), " ")
        has_both = filled.contains("*") & filled.rlike(r"[^* ]")
        own = own.withColumn("pat", F.when((F.col("pat") == 0) & F.col("words").isNotNull() & has_both, F.xxhash64(filled)).otherwise(F.col("pat")))
        pats = own.where(F.col("pat") != 0).groupBy("pat").agg(F.count("*").alias("docs"), F.count_if(F.col("n") > 1).alias("again"))
        good = pats.where((F.col("again") >= 3) & (F.col("again") >= 0.3 * F.col("docs")))
        patterns = frozenset(r["pat"] for r in good.select("pat").collect())
        self.heads = cut(own.where(F.col("n") >= REPEATS).groupBy("_doc").agg(F.collect_set("key").alias("_heads")))
        self.sets = self.scanned.sparkSession.sparkContext.broadcast((patterns, notices, frozenset(head_words)))

    def _run(self, schema: str, row) -> DataFrame:
        model, sets = self.model, self.sets

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = _model(model)
            known_heads = sets.value
            for b in batches:
                out = []
                for chunk, text, heads in zip(b.column("chunk_id").to_pylist(), b.column("text").to_pylist(), b.column("_heads").to_pylist()):
                    out += row(chunk, *repair(text, m, frozenset(heads or ()), *known_heads))
                yield pa.RecordBatch.from_pylist(out, schema=target)

        target = pa.schema([(n, pa.int64() if k == "long" else pa.string()) for n, k in (c.split() for c in schema.split(", "))])
        return self.scanned.join(small(self.heads), "_doc", "left").select("chunk_id", "text", "_heads").mapInArrow(run, schema)

    def fixes(self) -> DataFrame:
        """chunk_id, fix, item: every join, misread word or number and line left out, each once per chunk."""
        return self._run("chunk_id long, fix string, item string", lambda c, _, fixes: [{"chunk_id": c, "fix": f, "item": i} for f, i in dict.fromkeys(fixes) if i]).distinct()

    def texts(self) -> DataFrame:
        """chunk_id, repaired: continuous paragraphs. Chunks with null text have no row; blank ones an empty text."""
        return self._run("chunk_id long, repaired string", lambda c, t, _: [{"chunk_id": c, "repaired": t}]).dropDuplicates(["chunk_id"])
