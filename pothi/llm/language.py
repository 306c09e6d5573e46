"""Languages of documents and passages by hyperdimensional n-gram profiles.

Every letter has a fixed random +1/-1 vector of DIM components. A trigram is bound as
roll(a, 2) * roll(b, 1) * c; a text is the bundle (sum) of its trigrams, a language prototype the
bundle of its training texts. A passage gets the language whose prototype has the greatest cosine.

A bundle is linear, so the dot product of a passage with a prototype is the sum of its
trigrams' dot products. Each worker computes those once per distinct trigram, and passage scores are
differences of running sums over the text: exact, whatever the text's length. The passage's own length, needed
for the cosine but not for the ranking, is estimated by the root of its trigram count (trigram vectors are near orthogonal).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import current_manifest, language_name, process_state

LANGUAGES = ("en", "hi", "hinglish", "mr")
DIM = 2048
#: Labelled rows from which prototypes are bundled, at most; the classifier's bounded sample.
SAMPLE_ROWS = 5_000
#: Words and trigrams a sentence needs to be told: fewer do not tell a language from another.
LEAST_WORDS, LEAST_TRIGRAMS = 4, 12
#: Characters whose sentences are told together.
CHARACTERS = 1 << 20
_OTHER = 32
_LETTERS = 1 + 26 + 128 + _OTHER  # boundary, Latin, the Devanagari block, 32 classes for all other letters

#: Abbreviations whose full stop ends no sentence.
_ABBREVIATIONS = frozenset(("Rs", "RS", "rs", "No", "Sec", "Dr", "रु", "सं", "क्र"))
_CLOSING = "\"'”’)]"
_ENDS = re.compile("[.?!।॥]+[" + re.escape(_CLOSING) + r"]*(?=\s|\Z)|\n[^\S\n]*\n")
_SPACE = np.array([chr(cp).isspace() for cp in range(65536)])
_ALPHA = np.array([chr(cp).isalpha() for cp in range(65536)])
_DIGIT = np.array([chr(cp).isdigit() for cp in range(65536)])


def _letter_ids() -> np.ndarray:
    ids = np.zeros(65536, np.uint8)
    for cp in range(65536):
        ch = chr(cp)
        if "a" <= ch.lower() <= "z" and len(ch.lower()) == 1:
            ids[cp] = ord(ch.lower()) - 96
        elif 0x900 <= cp < 0x980:
            ids[cp] = 0 if cp in (0x964, 0x965) or 0x966 <= cp <= 0x96F else 27 + cp - 0x900
        elif ch.isalpha():
            ids[cp] = 27 + 128 + cp % _OTHER
    return ids


def _letter_vectors() -> np.ndarray:
    rng = np.random.default_rng(20_231)
    return rng.choice(np.array([-1, 1], np.int8), size=(_LETTERS, DIM))


class Profiles:
    """Trigram counts per language to prototypes, and scores of texts against them."""

    def __init__(self, prototypes: np.ndarray | None = None):
        self.ids = _letter_ids()
        v = _letter_vectors()
        self.a, self.b, self.c = np.roll(v, 2, 1), np.roll(v, 1, 1), v
        self.row = np.full(_LETTERS**3, -1, np.int32)
        self.prototypes = prototypes
        self.scores = np.zeros((0, len(LANGUAGES)), np.float32)

    def codes(self, text: str, blank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Trigram codes of a text, and the position in the text at which each ends. blank: characters that count as no letters."""
        cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        ids = self.ids[np.minimum(cps, 65535)]
        if blank is not None:
            ids = np.where(blank, 0, ids)
        keep = np.ones(len(ids), bool)
        keep[1:] = (ids[1:] != 0) | (ids[:-1] != 0)
        at = np.flatnonzero(keep)
        ids = ids[at].astype(np.int32)
        if len(ids) < 3:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        return (ids[:-2] * _LETTERS + ids[1:-1]) * _LETTERS + ids[2:], at[2:]

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        a, rest = np.divmod(codes, _LETTERS * _LETTERS)
        b, c = np.divmod(rest, _LETTERS)
        return self.a[a] * self.b[b] * self.c[c]

    def bundle(self, counts: dict[int, float]) -> np.ndarray:
        codes = np.fromiter(counts, np.int64, len(counts))
        n = np.fromiter(counts.values(), np.float64, len(counts))
        out = np.zeros(DIM)
        for i in range(0, len(codes), 4096):
            out += n[i : i + 4096] @ self.vectors(codes[i : i + 4096])
        return out / max(np.linalg.norm(out), 1e-9)

    def running(self, text: str, blank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions of trigram ends, and running sums of their products with the prototypes (one row more)."""
        codes, at = self.codes(text, blank)
        rows = self.row[codes]
        if len(rows) and rows.min() < 0:
            new = np.unique(codes[rows < 0])
            self.row[new] = np.arange(len(self.scores), len(self.scores) + len(new))
            for i in range(0, len(new), 4096):
                self.scores = np.concatenate([self.scores, (self.vectors(new[i : i + 4096]).astype(np.float32) @ self.prototypes.T.astype(np.float32))])
            rows = self.row[codes]
        sums = np.zeros((len(codes) + 1, len(LANGUAGES)))
        np.cumsum(self.scores[rows], axis=0, out=sums[1:])
        return at, sums


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences and of the unfinished stretches between paragraph ends."""
    spans, start = [], 0
    for m in _ENDS.finditer(text):
        at, end = m.span()
        if text[at] == "." and text[max(text.rfind(" ", 0, at), text.rfind("\n", 0, at), start - 1) + 1 : at].lstrip("(") in _ABBREVIATIONS:
            continue
        spans.append((start, end))
        start = end
    if start < len(text):
        spans.append((start, len(text)))
    return spans


def is_whole(piece: str) -> bool:
    """Whether a stripped stretch ends as a sentence does: with a word (no number) and its mark."""
    bare = piece.rstrip(_CLOSING)
    word = bare.rstrip(".?!।॥").rstrip(_CLOSING)
    return len(word) < len(bare) and bool(word) and (word[-1].isalpha() or "ऀ" <= word[-1] <= "ॣ")


def without_tables(text: str) -> str:
    """The text with its table rows blanked (same length)."""
    if "|" not in text:
        return text
    return "\n".join(" " * len(x) if x.count("|") >= 2 and x.lstrip().startswith("|") else x for x in text.split("\n"))


def _gather(rows: list[tuple[int, str]], profiles: Profiles, agree: bool) -> list[dict[int, float]]:
    """Trigram counts per language, of whole texts or only of the sentences told to be of their label's language."""
    parts: list[list[np.ndarray]] = [[] for _ in LANGUAGES]
    for k, text in rows:
        codes, at = profiles.codes(text)
        if not agree:
            parts[k].append(codes)
            continue
        at, sums = profiles.running(text)
        for s, e in sentence_spans(text):
            i, j = np.searchsorted(at, (s, e))
            if j - i >= 12 and int((sums[j] - sums[i]).argmax()) == k:
                parts[k].append(codes[i:j])
    counts = []
    for p in parts:
        code, n = np.unique(np.concatenate(p), return_counts=True) if p else (np.zeros(0, int), np.zeros(0, int))
        counts.append(dict(zip(code.tolist(), n.tolist())))
    return counts


def train(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Prototypes (languages x DIM) from columns `label` and `text`, of which at most `rows` rows are used, each with its whole text.

    Labels may be wrong for some rows: after a first bundling, twice only those sentences are bundled
    that the prototypes give the label's own language. Prototypes are taken relative to their mean.
    """
    labelled = labelled.where(F.col("label").isin(*LANGUAGES) & F.col("text").isNotNull()).select("label", "text")
    total = labelled.count()
    share = min(1.0, 1.2 * rows / max(total, 1))
    pdf = (labelled if share >= 1 else labelled.sample(share, 7)).limit(rows).toPandas()
    texts = [(LANGUAGES.index(k), without_tables(x)) for k, x in zip(pdf["label"], pdf["text"])]
    profiles = Profiles()
    for step in range(3):
        counts = _gather(texts, profiles, agree=step > 0)
        for c in counts:  # damp the few very frequent trigrams
            for code in c:
                c[code] = c[code] ** 0.5
        bundles = np.array([profiles.bundle(c) if c else np.zeros(DIM) for c in counts])
        known = np.array([bool(c) for c in counts])
        centred = np.where(known[:, None], bundles - bundles[known].mean(0) if known.any() else bundles, 0)
        norms = np.linalg.norm(centred, axis=1, keepdims=True)
        profiles = Profiles(np.where(norms > 0, centred / np.maximum(norms, 1e-9), 0))
        if known.sum() < 2:
            break
    return profiles.prototypes


def _profiles(prototypes: np.ndarray) -> Profiles:
    """One per worker process and set of prototypes."""
    state, key = process_state("languages"), hashlib.sha256(prototypes.tobytes()).digest()
    if key not in state:
        state.clear()
        state[key] = Profiles(prototypes)
    return state[key]


class Told:
    """The sentences of some texts that could be told, as arrays: row, start and end in the text, language, confidence, whole (ends as a sentence), trigrams."""

    def __init__(self, texts: list[str], profiles: Profiles):
        clean = list(map(without_tables, texts))
        joined = "\n\n".join(clean)
        spans = np.array(sentence_spans(joined), np.int64).reshape(-1, 2)
        bounds = np.cumsum(np.fromiter(map(len, clean), np.int64, len(clean)) + 2)
        row = np.searchsorted(bounds, spans[:, 1] - 1, "right")
        cps = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), 65535)
        # Words: tokens of two characters or more that begin with a letter and have no digit. Tokens with a digit (codes, amounts) tell no language.
        change = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[cps], [True]])))
        begins, ends = change[::2], change[1::2]
        digits = np.concatenate([[0], np.cumsum(_DIGIT[cps])])
        coded = digits[ends] > digits[begins]
        spoken = _ALPHA[cps[begins]] & (ends - begins > 1) & ~coded
        edge = np.zeros(len(cps) + 1, np.int8)
        np.add.at(edge, begins[coded], 1)
        np.add.at(edge, ends[coded], -1)
        at, sums = profiles.running(joined, np.cumsum(edge[:-1]) > 0)
        words = np.concatenate([[0], np.cumsum(np.bincount(begins[spoken], minlength=len(cps)))])
        edges = np.searchsorted(at, spans)
        n = edges[:, 1] - edges[:, 0]
        told = np.flatnonzero((n >= LEAST_TRIGRAMS) & (words[spans[:, 1]] - words[spans[:, 0]] >= LEAST_WORDS))
        spans, n, d = spans[told], n[told], sums[edges[told, 1]] - sums[edges[told, 0]]
        self.row, self.n, self.lang = row[told], n, d.argmax(1) if len(d) else np.zeros(0, np.int64)
        # The confidence is a softmax over the cosines, sharpened with the passage's length.
        cos = d / np.sqrt(DIM * np.maximum(n, 1))[:, None]
        x = np.exp(np.maximum((cos - cos.max(1, keepdims=True, initial=-1)) * (10 + 0.2 * np.minimum(n, 200))[:, None], -50))
        self.confidence = x.max(1, initial=0) / np.maximum(x.sum(1), 1e-30)
        self.whole = np.fromiter((is_whole(joined[max(s, e - 64) : e].rstrip()) for s, e in spans.tolist()), np.int64, len(spans))
        first = (bounds - np.fromiter(map(len, clean), np.int64, len(clean)) - 2)[self.row] if len(self.row) else np.zeros(0, np.int64)
        self.start, self.end = np.maximum(spans[:, 0] - first, 0), spans[:, 1] - first


def told_of(texts: list[str], profiles: Profiles) -> Iterator[tuple[int, Told]]:
    """(first row, sentences) of stretches of the texts of some CHARACTERS; a text is never cut."""
    part, size, first = [], 0, 0
    for i, text in enumerate(texts):
        if part and size + len(text) > CHARACTERS:
            yield first, Told(part, profiles)
            part, size, first = [], 0, i
        part.append(text)
        size += len(text)
    if part:
        yield first, Told(part, profiles)


def passages(df: DataFrame, prototypes: np.ndarray, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """One row per run of neighbouring sentences in one language: key, start, end, lang, confidence, sentences (whole ones).

    Null, blank or wordless text gives no row; stretches of fewer than LEAST_WORDS words or LEAST_TRIGRAMS trigrams are not told.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = _profiles(prototypes)
        for b in batches:
            for first, t in told_of(b.column("text").to_pylist(), profiles):
                if not len(t.row):
                    continue
                new = np.flatnonzero(np.concatenate([[True], (t.row[1:] != t.row[:-1]) | (t.lang[1:] != t.lang[:-1])]))
                last = np.concatenate([new[1:], [len(t.row)]]) - 1
                n = np.add.reduceat(t.n, new)
                conf = np.add.reduceat(t.confidence * t.n, new) / n
                keys = b.column("k").take(pa.array(t.row[new] + first))
                yield pa.RecordBatch.from_arrays([keys, pa.array(t.start[new].astype(np.int32)), pa.array(t.end[last].astype(np.int32)), pa.array([LANGUAGES[g] for g in t.lang[new]], pa.string()), pa.array(conf), pa.array(np.add.reduceat(t.whole, new).astype(np.int32))], [key, "start", "end", "lang", "confidence", "sentences"])

    return df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, start int, end int, lang string, confidence double, sentences int")


def scores(df: DataFrame, prototypes: np.ndarray, keys: tuple[str, ...] = ("chunk_id", "document_id"), text: str = "text") -> DataFrame:
    """One row per row of df and language told in it: keys, lang, sentences (whole ones), weight (trigrams), confidence."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = _profiles(prototypes)
        for b in batches:
            for first, t in told_of(b.column(len(keys)).to_pylist(), profiles):
                if not len(t.row):
                    continue
                cell, at = np.unique(t.row * len(LANGUAGES) + t.lang, return_inverse=True)
                n = np.bincount(at, t.n)
                take = pa.array(cell // len(LANGUAGES) + first)
                langs = pa.array([LANGUAGES[g] for g in cell % len(LANGUAGES)], pa.string())
                yield pa.RecordBatch.from_arrays([*[b.column(i).take(take) for i in range(len(keys))], langs, pa.array(np.bincount(at, t.whole).astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(np.bincount(at, t.confidence * t.n) / n)], [*keys, "lang", "sentences", "weight", "confidence"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", lang string, sentences int, weight long, confidence double"
    return df.where(F.col(text).isNotNull()).select(*[F.col(k) for k in keys], F.col(text)).mapInArrow(run, schema)


def text_language(text: str, profiles: Profiles) -> str | None:
    """The language of a whole text; null where it has fewer than a dozen trigrams."""
    _, sums = profiles.running(text)
    return LANGUAGES[int(sums[-1].argmax())] if len(sums) > LEAST_TRIGRAMS else None


def document_prototypes(documents: DataFrame, rows: int = 1500) -> np.ndarray:
    """Prototypes from a bounded sample of documents under their own labels."""
    return train(documents.select(language_name(F.col("lang")).alias("label"), "text"), rows=rows)


def chunk_prototypes(chunks: DataFrame, manifest: DataFrame) -> np.ndarray:
    """Prototypes from a bounded sample of chunks under their manifest rows' labels."""
    held = current_manifest(manifest.select("id", "line_no", "language")).select(F.col("id").alias("_id"), language_name(F.col("language")).alias("label")).where(F.col("label").isNotNull())
    total = chunks.count()
    some = chunks.select("document_id", "text").sample(min(1.0, 1.6 * SAMPLE_ROWS / max(total, 1)), 11).limit(2 * SAMPLE_ROWS)
    return train(some.join(held, F.col("document_id") == F.col("_id")).select("label", "text"))


def documents_of_chunks(chunk_scores: DataFrame) -> DataFrame:
    """document_id, lang, confidence, shares of the languages: summed over the document's chunks, combined before the shuffle."""
    per = chunk_scores.where(F.col("document_id").isNotNull()).groupBy("document_id", "lang").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("confidence")).alias("c"))
    return per.groupBy("document_id").agg(
        F.max(F.struct("w", "lang"))["lang"].alias("lang"),
        (F.max(F.struct("w", "c"))["c"] / F.sum("w")).alias("confidence"),
        F.count("*").alias("languages"),
    )
