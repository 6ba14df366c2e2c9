"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, with exception phrases.

Folding lower-cases, strips accents and invisible characters and maps homoglyphs and digit substitutions to Latin
letters, at either end of a word too. The lexicon holds word beginnings and whole words of the folded training texts with the lower end of their log-odds
between toxic and clean documents; exception phrases are pairs of neighbouring words that hold a lexicon word and yet are no
likelier in toxic documents, and take the weight of the word inside back. The sum of weights, normalised by length,
goes through a logistic curve fitted on the same rows.

Scale: learning reads a seeded hash sample of about ``MAX_TRAIN`` labelled rows (their ids, bounded, are broadcast, so
texts are not shuffled, unless the ids are too large for that); word counts are summed inside each partition first. Lexicon
and phrases hold every term that passes the tests, so the bounded sample bounds them too; they are broadcast. Scoring is one pass
without a shuffle over whole texts.

Edge cases: null and empty texts score as texts without a hit. Contradictory labels of an id count as toxic. Without
labels of both kinds nothing is learned and every score is 0. Null ids are scored but never learned from. Ids of any type
come out unchanged; rows that repeat give a row each. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, held_out, share_below, with_columns

#: Expected number of labelled rows that learning reads at most.
MAX_TRAIN = 40_000
MIN_TOXIC_DOCS = 4
#: Least log-odds of a term, at the lower end of its 95 % interval.
MIN_WEIGHT = 1.5
SHORTEST, LONGEST = 4, 10

# Characters that look like Latin letters, and digits and signs that stand for them.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w", "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k",
    "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l",
    "ß": "ss", "ø": "o", "đ": "d", "ł": "l", "æ": "ae", "œ": "oe",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}

_LETTERS = re.compile(r"[^\W\d_]+")
#: Letters and the signs for them; digits only as a whole number, so that none that stands for no letter is next to them.
_RUN = re.compile(r"(?:[^\W\d_]+|(?<!\d)[0134578]+(?!\d)|[@$!|€])+")
_CLOSING = "!|"
_SIGNS = str.maketrans(DIGITS)


class Model(NamedTuple):
    terms: dict[str, float]  # " begin" or " whole " to weight
    phrases: dict[str, float]  # " two words " to the weight that it takes back
    curve: tuple[float, float, float]  # intercept, slope of the normalised sum, slope of log length


class _Folding(dict):
    """Code point to its folded letters, filled as characters are met."""

    def __missing__(self, code: int) -> str:
        c = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x) and unicodedata.category(x) != "Cf")
        out = self[code] = "".join(HOMOGLYPHS.get(x, x) for x in c.lower())
        return out


_FOLDING = _Folding()


def _plain(run: str) -> str:
    """The run as letters, without closing punctuation and what opens with it."""
    if run.isalpha():
        return run
    bare = run.rstrip(_CLOSING)
    return (bare.lstrip(_CLOSING) if bare != run and run[0] in _CLOSING else bare).translate(_SIGNS)


def fold(text: str | None) -> list[str]:
    """The words of the text as plain Latin letters."""
    if not text:
        return []
    text = text.lower() if text.isascii() else text.translate(_FOLDING).lower()
    return [_plain(w) for w in _RUN.findall(text) if _LETTERS.search(w)]


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_train: int, seed: int) -> DataFrame:
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(~held_out(F.col("doc_id")))
    share = max_train / max(marks.count(), 1)
    chosen = marks.where(share_below(F.col("doc_id").cast("string"), share, seed)).toDF("id", "toxic")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.join(broadcast_if_small(chosen), F.col("doc_id") == F.col("id")).select("text", (F.col("toxic") > 0).alias("toxic"))


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN, seed: int = 12) -> Model:
    """Lexicon, exception phrases and curve from (doc_id, toxic) labels of rows that are not held out."""
    rows = _sample(docs, labels, id_col, text_col, max_train, seed)

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a: Counter = Counter()
        b: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                (a if toxic else b).update({"": 1, **dict.fromkeys(fold(text), 1)})
        yield pd.DataFrame({"word": list(a | b)}, dtype=object).assign(toxic=lambda x: [a[w] for w in x["word"]], clean=lambda x: [b[w] for w in x["word"]])

    counts = rows.mapInPandas(words, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = counts.persist()
    try:
        totals = counts.where("word = ''").first()
        if totals is None or not totals["toxic"] or not totals["clean"]:
            return Model({}, {}, (-math.inf, 0.0, 0.0))
        n_toxic, n_clean = totals["toxic"], totals["clean"]
        size = F.length("word")
        starts = F.transform(F.sequence(F.lit(SHORTEST), F.lit(LONGEST)), lambda i: F.when(size >= i, F.concat(F.lit(" "), F.expr("word").substr(F.lit(1), i))))
        terms = counts.where("word <> ''").select(F.explode(F.concat(starts, F.array(F.concat(F.lit(" "), "word", F.lit(" "))))).alias("term"), "toxic", "clean")
        terms = terms.where("term IS NOT NULL").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        weight = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
        error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
        kept = terms.withColumn("weight", weight - 1.96 * error).where(f"toxic >= {MIN_TOXIC_DOCS} AND weight >= {MIN_WEIGHT}")
        found = kept.collect()  # bounded by the words of the sample
    finally:
        counts.unpersist()
    lexicon = _lexicon({r["term"]: (r["weight"], r["toxic"]) for r in found})
    phrases = _exceptions(rows, lexicon, n_toxic, n_clean)
    return Model(lexicon, phrases, _curve(rows, lexicon, phrases))


def _lexicon(found: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Term to weight from term to (weight, toxic documents), without what other terms make needless.

    A beginning goes if a longer beginning has nine tenths of its documents, so that it is no vaguer than it must be;
    then a term goes if a shorter beginning of it is left with three quarters of its weight.
    """
    vague = set()
    for t, (_, n) in found.items():
        if not t.endswith(" "):
            for k in range(SHORTEST + 1, len(t)):
                if found.get(t[:k], (0.0, n + n))[1] * 0.9 <= n:
                    vague.add(t[:k])
    left = {t: w for t, (w, _) in found.items() if t not in vague}

    def covered(t: str) -> bool:
        return any(left.get(t[:k], -1.0) >= 0.75 * left[t] for k in range(SHORTEST + 1, len(t)))

    return {t: w for t, w in left.items() if not covered(t)}


def automaton(model_terms: dict[str, float], phrases: dict[str, float]) -> ahocorasick.Automaton | None:
    found = ahocorasick.Automaton()
    for t, w in model_terms.items():
        found.add_word(t, (False, len(t), w))
    for t, w in phrases.items():
        found.add_word(t, (True, len(t), w))
    if not len(found):
        return None
    found.make_automaton()
    return found


def hits(found: ahocorasick.Automaton | None, folded: list[str]) -> tuple[float, list[tuple[int, int, float]]]:
    """(sum of the weights, spans in the folded text): the strongest term of each word, less the exceptions."""
    if found is None or not folded:
        return 0.0, []
    text = f" {' '.join(folded)} "
    terms: dict[int, tuple[int, float]] = {}
    spans = []
    for end, (exception, n, w) in found.iter(text):
        start = end - n + 1
        if exception:
            spans.append((start, end))
        elif w > terms.get(start, (0, 0.0))[1]:
            terms[start] = (end, w)
    kept = [(s, e, w) for s, (e, w) in sorted(terms.items()) if not any(a <= s and e <= b for a, b in spans)]
    return sum(w for _, _, w in kept), kept


def _exceptions(rows: DataFrame, lexicon: dict[str, float], n_toxic: int, n_clean: int) -> dict[str, float]:
    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = automaton(lexicon, {})
        a: Counter = Counter()
        b: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                folded = fold(text)
                _, spans = hits(found, folded)
                starts, at = {}, 0
                for k, w in enumerate(folded):
                    starts[at] = k
                    at += len(w) + 1
                seen = set()
                for s, _, _ in spans:
                    k = starts[s]
                    seen |= {f" {folded[i]} {folded[i + 1]} " for i in (k - 1, k) if 0 <= i < len(folded) - 1}
                (a if toxic else b).update(seen)
        yield pd.DataFrame({"phrase": list(a | b)}, dtype=object).assign(toxic=lambda x: [a[w] for w in x["phrase"]], clean=lambda x: [b[w] for w in x["phrase"]])

    counted = rows.mapInPandas(pairs, "phrase string, toxic long, clean long").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    likely = (F.col("clean") + 0.5) / (n_clean + 1) >= (F.col("toxic") + 0.5) / (n_toxic + 1)
    best = counted.where(likely & (F.col("clean") >= 3)).collect()  # bounded by the pairs of words in the sample
    return {r["phrase"]: 0.0 for r in sorted(best)}


def normalised(total: float, n_words: int) -> float:
    """Grows with the weight found and shrinks slowly with the length of the text."""
    return total / math.sqrt(1.0 + math.log1p(n_words / 50.0))


def _curve(rows: DataFrame, lexicon: dict[str, float], phrases: dict[str, float]) -> tuple[float, float, float]:
    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = automaton(lexicon, phrases)
        for batch in batches:
            folded = [fold(t) for t in batch["text"]]
            x = [round(min(normalised(hits(found, f)[0], len(f)), 20.0), 2) for f in folded]
            yield pd.DataFrame({"x": x, "n": [round(math.log1p(len(f)), 1) for f in folded], "y": batch["toxic"].astype(float)})

    # Rounded as they are, the features take a bounded number of values, however many rows there are.
    counted = rows.mapInPandas(features, "x double, n double, y double").groupBy("x", "n", "y").agg(F.count(F.lit(1)).alias("rows"))
    pdf = counted.toPandas().sort_values(["x", "n", "y"])
    X = np.column_stack([np.ones(len(pdf)), pdf["x"], pdf["n"]])
    y, weight, beta = pdf["y"].to_numpy(), pdf["rows"].to_numpy(dtype=float), np.zeros(3)
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(X @ beta, -30, 30)))
        step = np.linalg.solve((X * (weight * p * (1 - p))[:, None]).T @ X + 1e-2 * np.eye(3), X.T @ (weight * (y - p)) - 1e-2 * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def score_text(model: Model, found: ahocorasick.Automaton | None, text: str | None) -> tuple[float, int, int]:
    """(probability, number of hits, number of words)."""
    folded = fold(text)
    total, spans = hits(found, folded)
    b0, b1, b2 = model.curve
    z = b0 + b1 * min(normalised(total, len(folded)), 20.0) + b2 * math.log1p(len(folded)) if math.isfinite(b0) else -math.inf
    return (0.0 if z < -700 else 1 / (1 + math.exp(-z))), len(spans), len(folded)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, hits, words) for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start() -> tuple[Model, ahocorasick.Automaton | None]:
        return shared.value, automaton(shared.value.terms, shared.value.phrases)

    def run(given: dict[str, list], state: tuple) -> dict[str, list]:
        rows = [score_text(*state, t) for t in given["text"]]
        return {name: [r[i] for r in rows] for i, name in enumerate(("score", "hits", "words"))}

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return with_columns(rows, run, "score double, hits long, words long", start=start)
