"""Toxicity of documents by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text.
A window (one word, in front of a fixed carrier that both dictionaries hold, so
that even a short word is compressed) is a hit if the toxic dictionary saves at
least a calibrated share of the bytes it takes with the ordinary one. A
document's score is a logistic function of how many hits it has and of their
share of its windows, fitted on labelled documents that the dictionaries under
test were not trained on.

Labels mark whole documents, most of whose words are ordinary. So the toxic
dictionary is trained on those words of toxic documents that recur among them
and are many times as common there as in ordinary ones, the ordinary dictionary
on the words of ordinary documents. Both are raw-content dictionaries with the
most frequent words at their end, where matches are cheapest.

Fitting takes a bounded sample of labelled documents on the driver; scoring is
one pass over all of them, without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import quoted, worker_memory

#: Labelled documents of each class that a model is fitted on at most, and the longest of them in characters.
SAMPLE_DOCS = 3000
SAMPLE_CHARS = 60_000
DICTIONARY_BYTES = 16_384
#: Support of a toxic training word: documents, share of the toxic documents, times its share of ordinary ones.
MIN_DOCS, MIN_SHARE, MIN_LIFT = 3, 0.012, 8.0
CUTS = (0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65)
#: What the window's word stands in front of; long enough that the word is searched for matches.
CARRIER = b"0123456789 ~ this closes the window ~ 9876543210"
#: Words that a Python worker remembers.
CACHE_WORDS = 250_000

_WORDS = re.compile(r"[^\W\d_]+")


def windows(text: str) -> list[str]:
    """The windows of a text: its words of letters, in lower case."""
    return _WORDS.findall(text.lower())


@dataclass(frozen=True)
class Model:
    """Two dictionaries, the share of bytes from which a window is a hit, and the logistic's weights.

    weights: intercept, hits (log), hits in a hundred windows (log). Without
    dictionaries every text's score is the intercept's.
    """

    toxic: bytes
    ordinary: bytes
    cut: float
    weights: tuple[float, float, float]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        strategy=zstandard.STRATEGY_LAZY,
        min_match=6,
        window_log=17,
        chain_log=14,
        hash_log=14,
        search_log=4,
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
    )
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


class Distance:
    """By how much of its bytes a window is nearer to the toxic dictionary; remembers words."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = _compressor(toxic).compress, _compressor(ordinary).compress
        self.bare = len(self.toxic(CARRIER)), len(self.ordinary(CARRIER))
        self.known: dict[str, float] = {}

    def saved(self, word: str) -> float:
        window = b" " + word.encode("utf-8", "replace") + b" " + CARRIER
        near, far = len(self.toxic(window)) - self.bare[0], len(self.ordinary(window)) - self.bare[1]
        return (far - near) / far if far > 0 else 0.0

    def hits(self, words: list[str], cut: float) -> int:
        known = self.known
        new = set(words).difference(known)
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = set(words)
        for w in new:
            known[w] = self.saved(w)
        return sum(x >= cut for x in map(known.__getitem__, words))


def _content(words: Counter[str]) -> bytes:
    """A dictionary of words, the most frequent last, and the carrier."""
    ranked = [w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))]
    parts, size = [], 0
    for w in ranked:
        part = b" " + w.encode("utf-8", "replace")
        size += len(part)
        if size > DICTIONARY_BYTES:
            break
        parts.append(part)
    return b"".join(reversed(parts)) + b" " + CARRIER


def train(toxic: list[list[str]], ordinary: list[list[str]]) -> tuple[bytes, bytes] | None:
    """The two dictionaries' contents from documents' windows; None if no word is typical of the toxic ones."""
    if not toxic or not ordinary:
        return None
    here = Counter(w for words in toxic for w in set(words))
    there = Counter(w for words in ordinary for w in set(words))
    least = max(MIN_DOCS, MIN_SHARE * len(toxic))
    typical = Counter(
        {
            w: n
            for w, n in here.items()
            if n >= least and n / len(toxic) >= MIN_LIFT * (there[w] + 0.5) / len(ordinary)
        }
    )
    common = Counter({w: n for w, n in there.items() if n >= 2 and w not in typical})
    return (_content(typical), _content(common)) if typical and common else None


def _features(hits: int, n: int) -> tuple[float, float, float]:
    return 1.0, math.log1p(hits), math.log1p(100.0 * hits / max(1, n))


def _logistic(rows: np.ndarray, marks: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression, with a small ridge, by Newton's steps."""
    ridge = np.diag([1e-6, 0.05, 0.05])
    w = np.zeros(rows.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        gradient = rows.T @ (marks - p) - ridge @ w
        step = np.linalg.solve((rows * (p * (1 - p) + 1e-9)[:, None]).T @ rows + ridge, gradient)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _area(values: np.ndarray, marks: np.ndarray) -> float:
    """The area under the curve, ties half."""
    ranks = pd.Series(values).rank().to_numpy()
    n1 = int(marks.sum())
    n0 = len(marks) - n1
    return (ranks[marks == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) if n1 and n0 else 0.5


def fit_texts(toxic: list[str], ordinary: list[str], toxic_share: float) -> Model:
    """A model from labelled texts in a random order; toxic_share: of all labelled documents.

    Cut and weights are fitted on three folds, each scored by dictionaries
    that are trained on the other two; those of the result are trained on all.
    """
    base = math.log(max(toxic_share, 1e-4) / max(1 - toxic_share, 1e-4))
    same: dict[str, str] = {}  # each distinct word is held once
    texts = [[[same.setdefault(w, w) for w in windows(t)] for t in side] for side in (toxic, ordinary)]
    both = train(*texts)
    if both is None:
        return Model(b"", b"", 1.0, (base, 0.0, 0.0))
    rows: dict[float, list[tuple[float, float, float]]] = {cut: [] for cut in CUTS}
    marks: list[int] = []
    for fold in range(3):
        pair = train(*[[w for k, w in enumerate(side) if k % 3 != fold] for side in texts])
        if pair is None:
            continue
        distance = Distance(*pair)
        for mark, side in ((1, texts[0]), (0, texts[1])):
            for words in side[fold::3]:
                marks.append(mark)
                for cut in CUTS:
                    rows[cut].append(_features(distance.hits(words, cut), len(words)))
    y = np.array(marks)
    if not 0 < y.sum() < len(y):
        return Model(b"", b"", 1.0, (base, 0.0, 0.0))
    tables = {cut: np.array(x) for cut, x in rows.items()}
    cut = max(CUTS, key=lambda c: (round(_area(tables[c][:, 2], y), 4), c))
    w = _logistic(tables[cut], y)
    # the sample's share of toxic documents isn't that of all
    w[0] += base - math.log(len(toxic) / len(ordinary))
    return Model(*both, cut, (float(w[0]), float(w[1]), float(w[2])))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_docs: int = SAMPLE_DOCS,
    sample_chars: int = SAMPLE_CHARS,
) -> Model:
    """A model from ``docs`` that ``labels`` (id, 0 or 1) marks.

    The sample is the first ``sample_docs`` labelled ids of either class in the
    order of a hash of theirs, without texts of over ``sample_chars``
    characters or null, so what comes to the driver is bounded whatever the
    tables' sizes. A document with differing labels is toxic; null labels and
    ids are left out. Without documents of both classes, or without words
    typical of the toxic ones, every score is the share of toxic labels.
    """
    marks = (
        labels.select(quoted(id_col).alias("id"), quoted(label_col).cast("int").alias("mark"))
        .dropna()
        .groupBy("id")
        .agg(F.max("mark").alias("mark"))
    )
    counts = {r["mark"]: r["n"] for r in marks.groupBy("mark").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model(b"", b"", 1.0, (math.log(1e-4), 0.0, 0.0))
    order = [F.xxhash64("id"), F.col("id")]
    sample = [marks.filter(F.col("mark") == k).orderBy(*order).limit(sample_docs) for k in (0, 1)]
    chosen = F.broadcast(sample[0].unionAll(sample[1]))
    rows = (
        docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
        .filter(F.length("text") <= sample_chars)
        .join(chosen, "id")
        .groupBy("id", "mark")
        .agg(F.min("text").alias("text"))
        .select(F.xxhash64("id").alias("h"), "id", "mark", "text")
        .toPandas()
        .sort_values(["h", "id"])
    )
    toxic, ordinary = (rows.loc[rows["mark"] == k, "text"].tolist() for k in (1, 0))
    return fit_texts(toxic, ordinary, counts.get(1, 0) / sum(counts.values()))


def _distance(model: Model) -> Distance:
    """This worker's compressors for a model."""
    return worker_memory((model.toxic, model.ordinary), lambda: Distance(model.toxic, model.ordinary))


def score_of(text: str | None, model: Model, distance: Distance | None) -> float:
    """The score of one text."""
    if distance is None:
        z = model.weights[0]
    else:
        words = windows(text or "")
        z = sum(w * x for w, x in zip(model.weights, _features(distance.hits(words, model.cut), len(words)), strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def scores(text: Column, model: Model) -> Column:
    """The toxicity, 0 to 1, of each whole text of a column; null and empty texts have that of a text without hits."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        distance = _distance(model) if model.toxic else None
        for batch in batches:
            yield pd.Series([score_of(t, model, distance) for t in batch], dtype="float64")

    return run(text)
