"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

The best segmentation of a text under the model's piece scores is found word by word, a word being a run of spaces with
the characters up to the next space: no piece holds a space after another character, so the best path never crosses
from one word into the next. Distinct words of equal length advance together. Hashes of all substrings up to the
longest piece probe the sorted hashes of the pieces; at each position the maximum over the piece lengths is taken for
all words at once and stored as a backpointer. Characters that no piece covers become their UTF-8 bytes.

The library writes a space as U+2581; a text that holds this character itself gets its bytes here, so that it is kept.

Ties go to the longer last piece, as in the library's own unigram search. A unigram model's scores are log-probabilities and
are used as they are. The scores of a merge-order (BPE) model are ranks, whose sums mean nothing; in their place stand
the log-probabilities of Zipf's law over the ranks, log(1 / (rank + 2.7)) up to a constant. No tokenizer is trained. The
result is the library's own for a unigram model of these pieces and scores; it is not the merge order's result, though mostly
equal to it (README). Decoding is exact in either case.

Scale: one pass over the documents without a shuffle. A worker keeps the segmentations of at most ``CACHE`` distinct
words; words that are equal are segmented once per batch at most. Of a long word, only the best piece that ends at each
character is kept, and ``_BLOCK`` characters are worked on at a time. The model (bounded: its vocabulary) is broadcast,
read from a local path on the driver.

Edge cases: a null text has null ids, an empty text no ids. A text of any length and any characters decodes to itself.
Ids of any type come out unchanged; rows that repeat give a row each. An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_columns

#: Path of the model that the registered query uses.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
CACHE = 500_000
#: Words longer than this are not kept in the cache.
LONGEST_CACHED = 64
#: Code points of the words that are segmented in one go.
_BATCH = 1 << 13
#: Characters of a long word that are worked on at a time.
_BLOCK = 1 << 13
#: Zipf's law, as Mandelbrot shifted it, for the scores of models that only rank their pieces.
ZIPF_SHIFT = 2.7
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: A word: spaces, then characters up to the next space, cut after line ends so that lines do not make long words.
_WORD = re.compile(r" *[^ \n]*\n?")


class Model(NamedTuple):
    pieces: list[str | None]  # by id, with plain spaces; None: not a normal piece
    hashes: np.ndarray  # of the normal pieces, sorted
    seen: np.ndarray  # by the first 20 bits of a hash: a piece may have it
    ids: np.ndarray  # in the order of hashes
    scores: np.ndarray  # in the order of hashes
    byte_ids: np.ndarray  # ids of the 256 bytes
    longest: int
    unknown: float  # score of a character without a piece
    prefix: bool  # a space is put before the text
    joined: np.ndarray  # neighbouring characters within pieces (first << 32 | second), sorted


def load(path: str = MODEL_PATH) -> Model:
    """Reads a model file whose normaliser is the identity; other normalisers are not supported."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    spec = proto.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("only models with the identity normaliser are supported")
    normal = [(i, p.piece.replace(SPACE, " "), p.score) for i, p in enumerate(proto.pieces) if p.type == 1]
    if any(" " in p.lstrip(" ") or "\n" in p[:-1] for _, p, _ in normal):
        raise ValueError("a piece reaches across words")
    hashes = np.array([_hash(p) for _, p, _ in normal], dtype=np.uint64)
    order = np.argsort(hashes)
    if len(np.unique(hashes)) < len(hashes):
        raise ValueError("two pieces share a hash")
    pieces: list[str | None] = [None] * len(proto.pieces)
    for i, p, _ in normal:
        pieces[i] = p
    byte_ids = np.full(256, -1)
    for i, p in enumerate(proto.pieces):
        if p.type == 6:
            byte_ids[int(p.piece[1:-1], 16)] = i
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte fallback")
    scores = np.array([s for _, _, s in normal])
    if proto.trainer_spec.model_type == 2:  # ranks: the pieces in the order of their merges, then the single characters
        ranks = np.argsort(np.argsort(-scores, kind="stable"), kind="stable")
        scores = -np.log(ranks + ZIPF_SHIFT).astype(np.float32).astype(np.float64)  # their sums are exact, so that ties are ties
    seen = np.zeros(1 << 20, dtype=bool)
    seen[hashes >> np.uint64(44)] = True
    return Model(
        pieces, hashes[order], seen, np.array([i for i, _, _ in normal])[order], scores[order], byte_ids,
        max(len(p) for _, p, _ in normal), float(scores.min()) - UNKNOWN_PENALTY, spec.add_dummy_prefix,
        np.array(sorted({ord(a) << 32 | ord(b) for _, p, _ in normal for a, b in zip(p, p[1:])}), dtype=np.uint64),
    )


def _finish(h: np.ndarray, size: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27)) ^ np.uint64(size * 0x10001)


def _hash(piece: str) -> np.uint64:
    h = np.zeros(1, dtype=np.uint64)
    for c in piece:
        h = h * _BASE + np.uint64(ord(c) + 1)
    return _finish(h, len(piece))[0]


def _pieces_ending(model: Model, codes: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the pieces that end at each position but the first ``reach - 1``, by their length less 1."""
    n, size = codes.shape
    wanted = size - reach + 1
    score = np.full((reach, wanted, n), -np.inf)
    piece = np.full((reach, wanted, n), -1, dtype=np.int32)
    plain = np.ascontiguousarray(codes.T).astype(np.uint64)
    h = np.zeros((size + 1, n), dtype=np.uint64)
    for k in range(reach):
        # The hash of the k + 1 characters that end at each position, from that of k characters one position before.
        h = h[:-1] * _BASE + plain[k:]
        probe = _finish(h[reach - 1 - k :], k + 1)
        likely = np.flatnonzero(model.seen[probe >> np.uint64(44)])
        probe = probe.ravel()[likely]
        at = np.minimum(np.searchsorted(model.hashes, probe), len(model.hashes) - 1)
        hit = model.hashes[at] == probe
        likely, at = likely[hit], at[hit]
        score[k].reshape(-1)[likely] = model.scores[at]
        piece[k].reshape(-1)[likely] = model.ids[at]
    score[0][piece[0] < 0] = model.unknown
    return score, piece


def _segment_equal(model: Model, codes: np.ndarray) -> list[bytes]:
    """Ids (the bytes of int32) for words of one length, given as rows of code points."""
    n, size = codes.shape
    reach = min(model.longest, size)
    plain = np.concatenate([np.zeros((n, reach - 1), dtype=np.uint64), codes.astype(np.uint64) + np.uint64(1)], axis=1)  # no piece holds a 0
    best = np.full((size + reach, n), -np.inf)
    best[reach - 1] = 0.0  # the position before the first; those before it cannot be reached
    back, chosen = np.empty((size, n), dtype=np.int8 if reach < 128 else np.int64), np.empty((size, n), dtype=np.int32)
    words = np.arange(n)
    for start in range(0, size, _BLOCK):
        end = min(start + _BLOCK, size)
        score, piece = _pieces_ending(model, plain[:, start : end + reach - 1], reach)
        score, piece = score[::-1], piece[::-1]  # the longest first
        for i in range(start, end):
            total = best[i : i + reach] + score[:, i - start]
            k = np.argmax(total, axis=0)
            best[i + reach] = total[k, words]
            back[i] = reach - 1 - k
            chosen[i] = piece[k, i - start, words]
    # All words walk back together; a step's pieces are written from the right.
    ids = np.full((n, size), -1, dtype=np.int32)
    active, position, column = words, np.full(n, size - 1), size
    lost = np.zeros(n, dtype=bool)
    starts = np.full(n, size)
    while len(active):
        column -= 1
        found = chosen[position, active]
        ids[active, column] = found
        lost[active[found < 0]] = True
        starts[active] = column
        position = position - back[position, active] - 1
        going = position >= 0
        active, position = active[going], position[going]
    flat, row = ids.tobytes(), 4 * size
    out = [flat[w * row + 4 * s : (w + 1) * row] for w, s in enumerate(starts.tolist())]
    for w in np.flatnonzero(lost):
        parts, i = [], size - 1
        while i >= 0:
            p = chosen[i, w]
            parts.append([p] if p >= 0 else model.byte_ids[list(chr(codes[w, i]).encode())])
            i -= int(back[i, w]) + 1
        out[w] = np.concatenate(parts[::-1]).astype(np.int32).tobytes()
    return out


def segment(model: Model, words: list[str]) -> dict[str, bytes]:
    """Ids of distinct words; words of equal length advance together, in groups of bounded size."""
    out: dict[str, bytes] = {}
    by_size: dict[int, list[str]] = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    for size, same in by_size.items():
        step = max(1, _BATCH // size)
        for i in range(0, len(same), step):
            group = same[i : i + step]
            codes = np.frombuffer("".join(group).encode("utf-32-le"), dtype=np.uint32).reshape(len(group), size)
            out.update(zip(group, _segment_equal(model, codes)))
    return out


def split(model: Model, text: str) -> list[str]:
    if not text:
        return []
    return [part for w in _WORD.findall(" " * model.prefix + text) if w for part in ([w] if len(w) <= LONGEST_CACHED else _cut(model, w))]


def _cut(model: Model, word: str) -> list[str]:
    """The word cut wherever no piece holds the two neighbouring characters: the best path has an end there."""
    codes = np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    pairs = codes[:-1] << np.uint64(32) | codes[1:]
    at = np.minimum(np.searchsorted(model.joined, pairs), len(model.joined) - 1)
    ends = [0, *(np.flatnonzero(model.joined[at] != pairs) + 1).tolist(), len(word)]
    return [word[a:b] for a, b in zip(ends, ends[1:])]


class Encoder:
    """Encodes batches of texts, keeping the segmentations of recent words."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for start in range(0, len(texts), 256):
            rows = [split(self.model, t) for t in texts[start : start + 256]]
            new = {w for r in rows for w in r}.difference(self.known)
            fresh = segment(self.model, list(new))
            known = self.known
            if len(known) + len(fresh) > CACHE:
                for r in rows:  # words of these texts stay until their rows are done
                    for w in r:
                        if w in known:
                            fresh[w] = known[w]
                known.clear()
            known.update(fresh)
            out += [np.frombuffer(b"".join([known[w] for w in r]), dtype=np.int32) for r in rows]
            for w in new:
                if len(w) > LONGEST_CACHED:
                    del known[w]
        return out


class Decoder:
    def __init__(self, model: Model):
        table = [p.encode() if p is not None else b"" for p in model.pieces]
        for b, i in enumerate(model.byte_ids):
            table[i] = bytes((b,))
        self.table, self.prefix = table, model.prefix

    def decode(self, ids) -> str:
        table = self.table
        text = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def encode(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) for every whole text; round_trip: the ids decode to the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start() -> tuple[Encoder, Decoder]:
        return Encoder(shared.value), Decoder(shared.value)

    def run(given: dict[str, list], state: tuple[Encoder, Decoder]) -> dict[str, list]:
        encoder, decoder = state
        texts = [t or "" for t in given["text"]]
        ids = encoder.encode(texts)
        same = [decoder.decode(x.tolist()) == t for x, t in zip(ids, texts)]
        return {"ids": [None if t is None else x for x, t in zip(ids, given["text"])], "n_tokens": [len(x) for x in ids], "round_trip": same}

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return with_columns(rows, run, "ids array<int>, n_tokens long, round_trip boolean", start=start)


def decode(tokens: DataFrame, model: Model) -> DataFrame:
    """(doc_id, ids) to (doc_id, text)."""
    shared = tokens.sparkSession.sparkContext.broadcast(model)

    def run(given: dict[str, list], decoder: Decoder) -> dict[str, list]:
        return {"text": [None if x is None else decoder.decode(x) for x in given["ids"]]}

    return with_columns(tokens.select("doc_id", "ids"), run, "text string", start=lambda: Decoder(shared.value))
