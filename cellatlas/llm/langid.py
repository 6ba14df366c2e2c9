"""Language identification: multinomial naive Bayes over hashed character n-grams.

Character n-grams of orders 1 to 3 of the lower-cased text are hashed into a fixed number of buckets. Counts per
(language, bucket) of the training rows give a smoothed log-probability matrix of bounded size (languages x buckets),
which is broadcast; scoring hashes the n-grams of many documents at once, gathers one matrix row per occurrence and sums
the rows of each document, all in numpy.

Scale: training reads a seeded hash sample of about ``MAX_TRAIN`` labelled rows, whole texts (a documented bound); its
counts are summed inside each partition before the shuffle. Scoring is one pass without a shuffle; texts are joined, and
long ones cut, into stretches of bounded length, so memory does not grow with the length of a text.

Edge cases: text null, empty or without a letter: lang_pred ``und``, score 0. Without training rows every prediction is
``und``. Ties go to the smaller language code. Null languages are never learned. Ids of any type come out unchanged; rows
that repeat give a row each. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, share_below, with_columns

ORDERS = (1, 2, 3)
BUCKETS = 1 << 14
#: Expected number of labelled rows that training reads at most.
MAX_TRAIN = 40_000
SMOOTHING = 0.5
_PIECE = 1 << 18
_MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def ngrams(codes: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each position of an array of code points."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    h = np.full(n, order, dtype=np.uint64)
    for i in range(order):
        h = (h ^ codes[i : i + n]) * _MULT[i % 3]
        h ^= h >> np.uint64(29)
    return ((h * _MULT[1]) >> np.uint64(50)).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _pieces(text: str) -> Iterator[np.ndarray]:
    """The code points in overlapping pieces, so that each n-gram is in exactly one for its order."""
    codes = _codes(text)
    for i in range(0, len(codes), _PIECE):
        yield codes[i : i + _PIECE + max(ORDERS) - 1]


def _ids(piece: np.ndarray) -> Iterator[np.ndarray]:
    for order in ORDERS:
        yield ngrams(piece[: _PIECE + order - 1], order)


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN, seed: int = 11) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages in order, log-probabilities [bucket, language], log-priors) from rows that are not held out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    eligible = rows.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = eligible.select("lang").count()
    sample = eligible.where(share_below(F.col("doc_id").cast("string"), max_train / max(n, 1), seed)).select("text", "lang")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b["text"], b["lang"]):
                row = sums.setdefault(lang, np.zeros(BUCKETS + 1, dtype=np.int64))
                row[BUCKETS] += 1
                for piece in _pieces(text):
                    for ids in _ids(piece):
                        row[:BUCKETS] += np.bincount(ids, minlength=BUCKETS)
        for lang, row in sums.items():
            ids = np.flatnonzero(row)
            yield pd.DataFrame({"lang": np.full(len(ids), lang, dtype=object), "bucket": ids, "n": row[ids]})

    counted = sample.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    pdf = counted.toPandas()  # at most languages x (BUCKETS + 1) rows
    langs = sorted(pdf["lang"].unique())
    table = np.zeros((BUCKETS + 1, len(langs)))
    table[pdf["bucket"].to_numpy(dtype=np.int64), pdf["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=np.int64)] = pdf["n"]
    priors, table = table[BUCKETS], table[:BUCKETS] + SMOOTHING
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32), np.log((priors + 1) / (priors.sum() + max(len(langs), 1)))


def _stretches(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code points, lengths, owners) of pieces of texts that are scored together; owners: positions in ``texts``."""
    codes, owners, size = [], [], 0
    for i, t in enumerate(texts):
        for piece in _pieces(t):
            codes.append(piece)
            owners.append(i)
            size += len(piece)
            if size >= _PIECE:
                yield np.concatenate(codes), np.array([len(c) for c in codes]), np.array(owners)
                codes, owners, size = [], [], 0
    if codes:
        yield np.concatenate(codes), np.array([len(c) for c in codes]), np.array(owners)


def log_likelihoods(matrix: np.ndarray, texts: list[str]) -> np.ndarray:
    """For each text, the sum of the matrix rows of its n-grams."""
    out = np.zeros((len(texts), matrix.shape[1]))
    for codes, sizes, owners in _stretches(texts):
        starts = np.cumsum(sizes) - sizes
        inside = np.arange(len(codes)) - np.repeat(starts, sizes)
        for order in ORDERS:
            own = np.clip(sizes - order + 1, 0, _PIECE)  # n-grams that start in a piece and belong to it
            ids = ngrams(codes, order)
            ids = ids[(inside < np.repeat(own, sizes))[: len(ids)]]
            some = own > 0
            if len(ids):
                ends = np.cumsum(own[some])
                np.add.at(out, owners[some], np.add.reduceat(matrix[ids], ends - own[some], axis=0, dtype=np.float64))
    return out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): the most likely language and its posterior probability."""
    langs, logp, priors = model
    shared = docs.sparkSession.sparkContext.broadcast(logp)

    def run(given: dict[str, list]) -> dict[str, list]:
        best, score = ["und"] * len(given["text"]), [0.0] * len(given["text"])
        rows = [i for i, letters in enumerate(given["letters"]) if letters] if langs else []
        if rows:
            sums = priors + log_likelihoods(shared.value, [given["text"][i] for i in rows])
            k = np.argmax(sums, axis=1)
            p = 1.0 / np.exp(sums - sums[np.arange(len(k)), k][:, None]).sum(axis=1)
            for i, j, x in zip(rows, k.tolist(), p.tolist()):
                best[i], score[i] = langs[j], x
        return {"lang_pred": best, "score": score}

    letters = F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), letters.alias("letters"))
    return with_columns(rows, run, "lang_pred string, score double")
