"""Missing or wrong language labels: hierarchical discrimination with linear support vector machines.

A passage is first assigned a language family by one linear SVM, then one-versus-one SVMs inside
the family vote for the language. Features are hashed words and character n-grams with word ends.
The models are linear and counts are averaged, so a passage's score is the mean of its words'
scores. A batch's distinct words are scored once; sums by passage, votes and confidences are array
operations over the whole batch.

Fitting reads at most `sample` labelled posts, the first in order of a hash of doc_id, and of those
at most `per_post` passages a post and `per_language` passages a language (6,000, 12 and 2,000). It
is repeated on the passages on which the first fit agrees with the label, since labels are partly
wrong. Prediction covers every post and its whole text where it lies; there is no shuffle.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Languages, their families and the notations that name them.
FAMILIES = {"germanic": ("en", "de", "nl"), "romance": ("fr", "es", "pt")}
NAMES = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
}
LANGUAGES = tuple(x for f in FAMILIES.values() for x in f)
PAIRS = tuple((a, b) for f in FAMILIES.values() for i, a in enumerate(f) for b in f[i + 1 :])
BITS = 16

BLOCK = re.compile(r"</?(?:p|br|div|blockquote|li|ul|ol|pre|h\d|hr|table|tr|td)\b[^<>]*>|\[/?quote[^\]]*\]", re.I)
DROP = re.compile(r"\[img\].*?\[/img\]|(?:https?://|www\.)\S+|\S+@\S+|<[^<>]*>|\[/?[a-z]+(?:=[^\]]*)?\]", re.I)
QUOTED = re.compile(r"^(?:\s*[>|])+\s?")
SIGNATURE = re.compile(r"^\s*(?:--|_{3,}|-{3,})\s*$")
NOISE = re.compile(r"^\s*(?:@\S+|\S+ (?:wrote|schrieb|a écrit|escribió|escreveu|schreef) ?:|\*\*\*.*)\s*$", re.I)
SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)]*\s+|\s{2,}")
WORD = re.compile(r"[^\W\d_]+")


def label_language(label: Column) -> Column:
    """Language a label names, whatever its notation or region; NULL if it names none of ours."""
    table = F.create_map(*[F.lit(x) for code, names in NAMES.items() for n in names for x in (n, code)])
    return F.try_element_at(table, F.regexp_extract(F.lower(F.trim(label)), r"^([^-_ ]*)", 1))


def passages(text: str | None) -> list[str]:
    """Sentences of a post, quotes included: markup, links, names and signatures taken out."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    text = BLOCK.sub("\n\n", text)
    if "<" in text or "[" in text or "http" in text or "@" in text:
        text = DROP.sub(" ", text)
    blocks: list[list[str]] = [[]]
    was_quote = skipping = False
    for line in text.splitlines():
        quote = QUOTED.match(line)
        body = line[quote.end() :] if quote else line
        if SIGNATURE.match(body):
            skipping = True
        elif not body.strip():
            skipping = False
            blocks.append([])
        if quote and not was_quote:
            skipping = False
        if skipping or NOISE.match(body):
            was_quote = bool(quote)
            continue
        if not (quote and was_quote):  # only quoted lines are wrapped
            blocks.append([])
        blocks[-1].append(body)
        was_quote = bool(quote)
    return [s.strip() for b in blocks if b for s in SENTENCE.split(" ".join(b).replace("  \n", "\n")) if s and s.strip()]


def word_features(word: str) -> list[int]:
    w = f"^{word}$"
    grams = [w] + [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)]
    return [zlib.crc32(g.encode()) & ((1 << BITS) - 1) for g in grams]


def _vector(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    ids, n = np.unique(np.fromiter((f for w in words for f in word_features(w)), dtype=np.int64), return_counts=True)
    return ids, n / n.sum()


def _svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 6, reg: float = 1e-6, seed: int = 7) -> np.ndarray:
    """Averaged linear SVM by stochastic subgradient descent on the hinge loss; last entry is the bias."""
    w, total = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    rng, t, seen = np.random.default_rng(seed), 0, 0.0
    scale = 40.0  # averaged features are small; this sets the margin's unit
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, v = rows[i]
            t += 1
            step = 1.0 / (1 + 0.002 * t)
            if y[i] * (w[ids] @ v * scale + w[-1]) < 1:
                w[ids] += step * y[i] * v * scale
                w[-1] += step * y[i] * 0.1
                total[ids] += t * step * y[i] * v * scale
                total[-1] += t * step * y[i] * 0.1
        w *= 1 - reg
        seen = t
    averaged = w - total / max(1.0, seen)
    averaged[:-1] *= scale
    return averaged.astype(np.float32)


class Model:
    """Family SVM and one-versus-one SVMs as one weight matrix (features x machines)."""

    def __init__(self, weights: np.ndarray, most: int = 500_000):
        self.w, self.most = weights, most
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, weights.shape[1] + 1))

    def _row(self, word: str) -> int:
        """Row of a word in the table: the sums of its features' weights, and how many they are."""
        at = self.rows.setdefault(word, len(self.rows))
        if at == len(self.rows) - 1:
            if at >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            f = word_features(word)
            self.table[at, :-1], self.table[at, -1] = self.w[f].sum(axis=0, dtype=np.float64), len(f)
        return at

    def predict(self, words: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language numbers and confidences of passages: `words` of all, `sizes` (at least 1) of each.

        The confidence is the family's probability times that of the winner's weakest duel.
        """
        if not len(sizes):
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        if len(self.rows) > self.most:
            self.rows.clear()
        codes, distinct = pd.factorize(np.asarray(words, dtype=object))
        known = np.fromiter((self._row(w) for w in distinct), dtype=np.int64, count=len(distinct))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        sums = np.add.reduceat(self.table[known[codes]], starts, axis=0)
        s = sums[:, :-1] / np.maximum(1.0, sums[:, -1:]) + self.w[-1]
        wins, weakest = np.zeros((len(s), len(LANGUAGES))), np.full((len(s), len(LANGUAGES)), np.inf)
        for k, pair in enumerate(PAIRS, start=1):
            for x, margin in zip(map(LANGUAGES.index, pair), (s[:, k], -s[:, k]), strict=True):
                wins[:, x] += margin > 0
                weakest[:, x] = np.minimum(weakest[:, x], margin)
        family = np.array([x in FAMILIES["germanic"] for x in LANGUAGES])
        wins[(s[:, :1] > 0) != family] = -1.0
        # Most duels won, then the best weakest duel, then the first language.
        best = np.where(wins == wins.max(axis=1, keepdims=True), weakest, -np.inf).argmax(axis=1)
        sure = lambda m: 1 / (1 + np.exp(-np.clip(3 * m, -30.0, 30.0)))
        return best, sure(np.abs(s[:, 0])) * sure(weakest[np.arange(len(s)), best])


def _fit_once(rows: list, langs: np.ndarray) -> np.ndarray:
    germanic = np.isin(langs, FAMILIES["germanic"])
    machines = [_svm(rows, np.where(germanic, 1.0, -1.0))]
    for a, b in PAIRS:
        mine = np.nonzero((langs == a) | (langs == b))[0]
        machines.append(_svm([rows[i] for i in mine], np.where(langs[mine] == a, 1.0, -1.0)))
    return np.stack(machines, axis=1)


def fit(sample: list[tuple[str, str]], per_language: int = 2000, per_post: int = 12, min_words: int = 4) -> np.ndarray:
    """Weights from (language, text) pairs; fitted again on the passages the first fit agrees with."""
    data: dict[str, list[list[str]]] = {x: [] for x in LANGUAGES}
    for lang, text in sample:
        if len(data[lang]) < per_language:
            for p in passages(text)[:per_post]:
                words = WORD.findall(p.lower())
                if len(words) >= min_words:
                    data[lang].append(words)
    pairs = [(x, w) for x in LANGUAGES for w in data[x][:per_language]]
    if not pairs:
        return np.zeros(((1 << BITS) + 1, 1 + len(PAIRS)), dtype=np.float32)
    langs = np.array([x for x, _ in pairs])
    vectors = [_vector(w) for _, w in pairs]
    weights = _fit_once(vectors, langs)
    said, _ = Model(weights).predict([w for _, ws in pairs for w in ws], np.array([len(ws) for _, ws in pairs]))
    keep = np.array(LANGUAGES)[said] == langs
    return _fit_once([v for v, k in zip(vectors, keep, strict=True) if k], langs[keep])


def fit_documents(documents: DataFrame, sample: int = 6000) -> np.ndarray:
    """Weights fitted on at most `sample` labelled posts of 40 characters or more, the first by a hash of doc_id."""
    known = documents.select("doc_id", "text", label_language(F.col("lang")).alias("label")).filter(F.col("label").isNotNull() & (F.length("text") >= 40))
    # About twice the sample passes the hash's bound, so that only so many texts are ordered.
    share = min(1.0, 2.0 * sample / max(1, documents.select("doc_id").count()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    rows = known.filter(place < int(math.ceil(share * 1_000_000))).orderBy(place, "doc_id", F.xxhash64("text")).limit(sample)
    return fit([(r["label"], r["text"]) for r in rows.select("label", "text").collect()])


def _passages_of(texts, least: int) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """(text number, passage number, words, sizes) of all passages of a batch with at least `least` words."""
    rows, numbers, flat, sizes = [], [], [], []
    for r, t in enumerate(texts):
        for i, p in enumerate(passages(t)):
            words = WORD.findall(p.lower())
            if len(words) >= least:
                rows.append(r)
                numbers.append(i)
                flat += words
                sizes.append(len(words))
    return np.array(rows, dtype=np.int64), np.array(numbers, dtype=np.int64), flat, np.array(sizes, dtype=np.int64)


def segments(documents: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, seg_no, n_words, lang, confidence) of every passage that holds a word; null and wordless posts have none."""
    shipped = documents.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, names = Model(shipped.value), np.array(LANGUAGES, dtype=object)
        for b in batches:
            rows, numbers, flat, sizes = _passages_of(b["text"], 1)
            best, sure = model.predict(flat, sizes)
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[rows], "seg_no": numbers, "n_words": sizes, "lang": names[best], "confidence": sure})

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id bigint, seg_no int, n_words int, lang string, confidence double")


def post_languages(documents: DataFrame, weights: np.ndarray, min_words: int = 5, least: float = 0.5) -> DataFrame:
    """(doc_id, label, lang, confidence, share): languages in which a post holds a whole sentence.

    `label` is the language its label names, if any; `share` is the language's part of the words.
    Passages under `min_words` words or `least` confidence decide nothing.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, names = Model(shipped.value), np.array(LANGUAGES, dtype=object)
        for b in batches:
            rows, _, flat, sizes = _passages_of(b["text"], min_words)
            best, sure = model.predict(flat, sizes)
            use = sure >= least
            keys, back = np.unique(rows[use] * len(LANGUAGES) + best[use], return_inverse=True)
            row, lang = keys // len(LANGUAGES), keys % len(LANGUAGES)
            words, top = np.zeros(len(keys)), np.zeros(len(keys))
            np.add.at(words, back, sizes[use])
            np.maximum.at(top, back, sure[use])
            total = np.zeros(len(b))
            np.add.at(total, row, words)
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[row], "label": b["label"].to_numpy()[row], "lang": names[lang], "confidence": top, "share": words / total[row]})

    source = documents.select("doc_id", "text", label_language(F.col("lang")).alias("label"))
    return source.mapInPandas(run, "doc_id bigint, label string, lang string, confidence double, share double")


def mislabelled(documents: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """(doc_id, lang): every post whose languages aren't exactly the one its label names, a row per language."""
    weights = fit_documents(documents) if weights is None else weights
    found = post_languages(documents, weights)
    # A post's rows come out of one task together; share = 1 says that it has one language only.
    right = (F.col("share") > 1 - 1e-9) & F.col("label").eqNullSafe(F.col("lang"))
    return found.filter(~right).select("doc_id", "lang")
