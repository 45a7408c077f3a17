"""Languages of texts and of the stretches of mixed texts (problem 3).

Nearest-centroid classification: texts become TF-IDF vectors of character
n-grams and whole words, each language has several centroids (its sample texts
clustered by cosine, so that two scripts or spellings of one language do not
blur each other), and a text goes to the language of the centroid with the
largest cosine, or to none if even that is below ``REJECT``.

A vector's product with the centroids is the sum over its words, so each
distinct word is scored once per worker; texts are then sums of cached rows. The
length of a vector is no such sum, as words share n-grams: it is taken from the n-grams of all
words counted together. A text is cut into stretches by the cheapest path through languages, word by
word, in which every change of language has a price.

The model is fitted on the trusted samples only, at most ``MAX_SAMPLES`` of them.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.text import strip
from tidegraph.session import ship

LANGUAGES = ("en", "fa", "ar", "es", "pt", "tr", "de", "fr", "id")
MAX_SAMPLES = 50_000
CENTROIDS = 4
#: Least cosine with the nearest centroid.
REJECT = 0.06
MIN_WORDS = 5
#: Price of a change of language, in units of a word's advantage.
SWITCH = 2.0
CACHED_WORDS = 100_000

#: Other names of the languages (fixed values): two- and three-letter codes and English names.
NAMES = {
    "en": "en eng english",
    "fa": "fa fas per prs farsi persian",
    "ar": "ar ara arabic",
    "es": "es spa spanish castilian",
    "pt": "pt por portuguese",
    "tr": "tr tur turkish",
    "de": "de deu ger german",
    "fr": "fr fra fre french",
    "id": "id in ind indonesian",
}
_CODES = {n: code for code, names in NAMES.items() for n in names.split()}

#: Longest quotation that is taken for a title (characters); longer ones are text of their own.
MAX_TITLE = 120
_DROPPED = re.compile(rf"https?://\S+|www\.\S+|<[^<>\s]+>|(?<![\w.+%-])[\w.+%-]++ ?[@＠] ?[\w-]+(?:\.[\w-]+)+|(?<!\w)[@#][\w‌]+|\"[^\"\n]{{1,{MAX_TITLE}}}\"|«[^»\n]{{1,{MAX_TITLE}}}»|“[^”\n]{{1,{MAX_TITLE}}}”|\d[\d.,:/-]*")
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ًͯ-ٕ'])*")
_ANY_WORD = re.compile(r"[^\W_]+")


def label_code(c: Column) -> Column:
    """The language an upstream label names, as one of the nine codes, or NULL.

    Case, white space, region ('en-US', 'pt_BR') and the usual spellings do not matter.
    """
    head = F.regexp_extract(F.lower(strip(c)), r"^([a-z]+)(?:[-_ ].*)?$", 1)
    pairs = [x for n, code in _CODES.items() for x in (F.lit(n), F.lit(code))]
    return F.element_at(F.create_map(*pairs), F.nullif(head, F.lit("")))


def content_words(text: str) -> list[str]:
    """The words that show a language, in order and lower case: no handles, hashtags, quoted titles, addresses or numbers."""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return _WORD.findall(_DROPPED.sub(" ", text.lower()))


def grams(word: str) -> list[str]:
    """Character n-grams of a word with its ends, one to four long, and the word itself."""
    w = f" {word} "
    out = list(word)
    for n in (2, 3, 4):
        out += [w[i : i + n] for i in range(len(w) - n + 1)]
    return [*out, f"={word}"]


class Model:
    """Centroids of the languages over hashed-out n-gram columns."""

    def __init__(self, samples: list[tuple[str, str]], centroids: int = CENTROIDS) -> None:
        """``samples``: (language code, text) pairs; the result does not depend on their order."""
        samples = sorted({(lang, t) for lang, t in samples if lang in LANGUAGES and t})
        if not samples:
            raise ValueError("no language samples")
        bags = [Counter(g for w in content_words(t) for g in grams(w)) for _, t in samples]
        seen = Counter(g for b in bags for g in b)
        self.column = {g: i for i, g in enumerate(sorted(seen))}
        n = len(bags)
        self.idf = np.array([np.log((1 + n) / (1 + seen[g])) + 1 for g in self.column])
        self.unseen = float(np.log(1 + n) + 1)
        sparse = []  # (columns, values) of each sample at unit length
        for bag in bags:
            at = np.fromiter((self.column[g] for g in bag), dtype=np.int64, count=len(bag))
            values = np.fromiter(bag.values(), dtype=np.float64, count=len(bag)) * self.idf[at]
            sparse.append((at, values / (np.linalg.norm(values) or 1.0)))
        rows, self.owner = [], []
        for i, lang in enumerate(LANGUAGES):
            own = [sparse[k] for k, (code, _) in enumerate(samples) if code == lang]
            for c in _clusters(own, centroids, len(self.column)) if own else []:
                rows.append(c)
                self.owner.append(i)
        self.centroids = np.array(rows)
        self.owner = np.array(self.owner)
        self.start = np.searchsorted(self.owner, np.arange(len(LANGUAGES)))
        self.known = np.unique(self.owner)
        self.cache: dict[str, tuple] = {}

    def word(self, w: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a word: its row (scores by language, then products with all centroids), its n-grams and their weights."""
        hit = self.cache.get(w)
        if hit is None:
            if len(self.cache) >= CACHED_WORDS:
                self.cache.clear()
            gs = Counter(grams(w))
            # n-grams without a column get a number beyond all columns, so that they can be counted over words too
            ids = np.array([self.column.get(g, -1) for g in gs], dtype=np.int64)
            new = ids < 0
            ids[new] = [len(self.column) + zlib.crc32(g.encode()) for g, x in zip(gs, new) if x]
            counts = np.array(list(gs.values()), dtype=np.float64)
            weights = counts * np.where(new, self.unseen, self.idf[np.where(new, 0, ids)])
            products = self.centroids[:, ids[~new]] @ weights[~new]
            square = float((weights**2).sum())
            by_language = np.full(len(LANGUAGES), -1.0)
            by_language[self.known] = np.maximum.reduceat(products, self.start[self.known]) / (np.sqrt(square) or 1.0)
            hit = self.cache[w] = (np.concatenate([by_language * 10.0, products]), ids, weights)
        return hit

    def _length(self, hits: list[tuple]) -> float:
        """Length of the vector of all words: weights are added per n-gram before they are squared."""
        ids = np.concatenate([h[1] for h in hits])
        weights = np.concatenate([h[2] for h in hits])
        order = ids.argsort()
        ids = ids[order]
        starts = np.concatenate(([0], (ids[1:] != ids[:-1]).nonzero()[0] + 1))
        sums = np.add.reduceat(weights[order], starts)
        return float(np.sqrt(sums @ sums)) or 1.0

    def classify(self, words: list[str]) -> tuple[int, float, float]:
        """Language index, cosine and confidence of the words taken as one text; -1 if rejected.

        Confidence is the lead over the second language, as a share of the cosine.
        """
        hits = [self.word(w) for w in words]
        if not hits:
            return -1, 0.0, 0.0
        return self._nearest(hits, np.sum([h[0] for h in hits], axis=0)[len(LANGUAGES) :])

    def _nearest(self, hits: list[tuple], products: np.ndarray) -> tuple[int, float, float]:
        best = np.full(len(LANGUAGES), -1.0)
        best[self.known] = np.maximum.reduceat(products, self.start[self.known])
        first = int(best.argmax())
        top = float(best[first])
        best[first] = -1.0
        rival = max(float(best.max()), 0.0)
        cosine = top / self._length(hits)
        if cosine < REJECT:
            return -1, cosine, 0.0
        return first, cosine, min(1.0, max(0.0, (top - rival) / top))

    def stretches(self, words: list[str], min_words: int = MIN_WORDS, switch: float = SWITCH) -> list[tuple[int, int, int]]:
        """(language, first word, end) of the stretches in order; each has ``min_words`` words or is the only one."""
        if not words:
            return []
        scores = np.array([self.word(w)[0] for w in words])[:, : len(LANGUAGES)]
        if _one_language(scores, len(words), min_words, switch):
            return [(int(scores.sum(axis=0).argmax()), 0, len(words))]
        cost = np.zeros(len(LANGUAGES))
        back = np.empty(scores.shape, dtype=np.int64)
        here = np.arange(len(LANGUAGES))
        for i, row in enumerate(scores):
            top = int(cost.argmax())
            change = cost[top] - switch > cost
            back[i] = np.where(change, top, here)
            cost = np.where(change, cost[top] - switch, cost) + row
        path = [int(cost.argmax())]
        for i in range(len(words) - 1, 0, -1):
            path.append(int(back[i][path[-1]]))
        path.reverse()
        runs = _runs(path)
        while len(runs) > 1 and min(b - a for _, a, b in runs) < min_words:
            k = min(range(len(runs)), key=lambda i: (runs[i][2] - runs[i][1], i))
            _, a, b = runs[k]
            sides = [runs[j][0] for j in (k - 1, k + 1) if 0 <= j < len(runs)]
            path[a:b] = [max(sides, key=lambda lang: scores[a:b, lang].sum())] * (b - a)
            runs = _runs(path)
        return runs


def _one_language(scores: np.ndarray, n: int, min_words: int, switch: float) -> bool:
    """Whether no path with a change can beat the one best language: the words lose less in it than a change costs."""
    if n < 2 * min_words:
        return True
    lead = int(scores.sum(axis=0).argmax())
    return float((scores.max(axis=1) - scores[:, lead]).sum()) <= switch


def _runs(path: list[int]) -> list[tuple[int, int, int]]:
    out, a = [], 0
    for i in range(1, len(path) + 1):
        if i == len(path) or path[i] != path[a]:
            out.append((path[a], a, i))
            a = i
    return out


def _clusters(rows: list[tuple[np.ndarray, np.ndarray]], k: int, width: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means of sparse rows from far-apart first centres; unit centroids, fewer than ``k`` for few rows.

    Only the centroids are dense, so the memory needed does not grow with the number of rows.
    """

    def mean(members: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros(width)
        for at, values in members:
            out[at] += values
        return out / len(members)

    def products(centre: np.ndarray) -> np.ndarray:
        return np.array([centre[at] @ values for at, values in rows])

    chosen = [int(products(mean(rows)).argmin())]
    near = np.full(len(rows), -np.inf)
    while len(chosen) < min(k, len(rows)):
        near = np.maximum(near, products(mean([rows[chosen[-1]]])))
        chosen.append(int(near.argmin()))
    c = np.array([mean([rows[i]]) for i in chosen])
    for _ in range(rounds):
        own = np.array([products(centre) for centre in c]).argmax(axis=0)
        c = np.array([mean([rows[i] for i in (own == j).nonzero()[0]]) if (own == j).any() else c[j] for j in range(len(c))])
        norms = np.linalg.norm(c, axis=1, keepdims=True)
        c = c / np.where(norms == 0, 1, norms)
    return c


def fit(samples: DataFrame, centroids: int = CENTROIDS) -> Model:
    """The model of a table (lang, text) of trusted samples, whose size is checked before it is collected."""
    rows = samples.select(label_code(F.col("lang")).alias("lang"), "text").where("lang is not null and text is not null").limit(MAX_SAMPLES + 1).collect()
    if len(rows) > MAX_SAMPLES:
        raise ValueError(f"more than {MAX_SAMPLES} language samples")
    return Model([(r.lang, r.text) for r in rows], centroids)


def describe(model: Model, text: str | None, min_words: int = MIN_WORDS) -> list[tuple[int, str, float, int]]:
    """(segment_no, lang, confidence, words) of the stretches of ``text``; [] for fewer than ``min_words`` words or no language."""
    if not text or len(_ANY_WORD.findall(text)) < min_words:
        return []
    words = content_words(text)
    if not words:
        return []
    out: list[list] = []
    hits = [model.word(w) for w in words]
    rows = np.array([h[0] for h in hits])
    n = len(LANGUAGES)
    if _one_language(rows[:, :n], len(words), min_words, SWITCH):
        runs = [(0, 0, len(words))]
    else:
        runs = model.stretches(words, min_words)
    for _, a, b in runs:
        lang, _, confidence = model._nearest(hits[a:b], rows[a:b, n:].sum(axis=0))
        if lang < 0:
            continue
        if out and out[-1][0] == lang:
            out[-1][1], out[-1][2] = min(out[-1][1], confidence), out[-1][2] + b - a
        else:
            out.append([lang, confidence, b - a])
    return [(i + 1, LANGUAGES[lang], confidence, n) for i, (lang, confidence, n) in enumerate(out)]


_SEGMENT = pa.struct([("segment_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("words", pa.int32())])
_SEGMENTS = "array<struct<segment_no:int,lang:string,confidence:double,words:int>>"


def detect(df: DataFrame, text: str, samples: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``df`` with ``segments``: the stretches of ``text`` in order, each with language, confidence and words.

    Texts that are NULL, too short or of no known language have an empty array.
    Texts are read whole; rows are neither moved nor merged.
    """
    shipped = ship(df.sparkSession).sparkContext.broadcast(fit(samples))

    @F.arrow_udf(_SEGMENTS)
    def segments(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shipped.value
        for batch in batches:
            ends, flat = [0], []
            for t in batch.to_pylist():
                flat += describe(model, t, min_words)
                ends.append(len(flat))
            columns = zip(*flat) if flat else ([], [], [], [])
            values = pa.StructArray.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _SEGMENT)], fields=list(_SEGMENT))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    # as non-deterministic it is not evaluated once more for a filter on its result
    return df.withColumn("segments", segments.asNondeterministic()(F.col(text)))


def both_sources(events: DataFrame, records: DataFrame) -> DataFrame:
    """source_table, row_id, text and the language its label names (NULL where there is none)."""
    return events.select(
        F.lit("graph_events").alias("source_table"), F.col("event_id").alias("row_id"), F.col("cleaned_text").alias("text"), label_code(F.col("lang")).alias("label")
    ).unionAll(
        records.select(F.lit("normalized_records").alias("source_table"), F.col("record_id").alias("row_id"), F.col("text_normalized").alias("text"), F.lit(None).cast("string").alias("label"))
    )


def unlabelled(events: DataFrame, records: DataFrame, samples: DataFrame) -> DataFrame:
    """The stretches of all texts whose label is missing, wrong or too simple: one row per stretch.

    A text in one language whose label names that language gives no row.
    """
    rows = detect(both_sources(events, records), "text", samples)
    agrees = (F.size("segments") == 1) & F.coalesce(F.get("segments", F.lit(0))["lang"] == F.col("label"), F.lit(False))
    return rows.where(~agrees).select("source_table", "row_id", F.explode("segments").alias("s")).select("source_table", "row_id", "s.*")
