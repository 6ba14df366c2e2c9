"""Quality classifier: an interpolated modified Kneser-Ney bigram model of trusted text, joined by sharded counts.

Trusted documents (label 1) outside the held-out fold train the model: the counts of all their words and word pairs, known
by hashes of 16 bits more than the logarithm of the number of words, so that one lookup in 65,536 at most meets another
word's counts, at any size. A document's bits per word come from the counts of its pairs and words; words never met share
what the lower order leaves them; its perplexity is two to these bits. Short texts vary more, so they are allowed ``SPREAD``
bits over the root of their length. Trusted documents of the held-out fold give each language its limit, a quantile of their
bits less what their length allows; documents above the limit of their language are rejected. There is no lower limit: copies
of what the model has learned from have few bits too.

Scale: texts are read once and never shuffled. Their words, numbered by frequency within a chunk and compressed, are kept in
chunks of a bounded number of words, bucketed by chunk where they are made: a chunk lies in one bucket. Which documents of a
chunk are trusted is joined by ids alone. Each chunk asks for the counts of its distinct pairs and words only,
packed by shard and in ``PASSES`` ranges one after the other; model rows and requests of a shard meet in one streaming pass,
and the answers meet the chunk in a join that moves only answers, so a task holds one shard of the model and one chunk; shards grow in number with the words.
The documents are scored in ``PASSES`` parts of the chunks, so that only one part's answers are moved at a time.
Only sums of counts and one limit per language reach the driver. The ids of trusted documents and those of rejected ones are
broadcast while they are measured to be small and joined otherwise.

Edge cases: a null text, or one without words, has no bits and is kept. Contradictory labels of an id count as not
trusted; a null id is never trusted. Ids of any type with a text form come out unchanged. A null language is one of its own; a
language with fewer than ``LEAST`` held-out trusted documents takes the limit of all together; without any, all is kept, and
without training documents there are no bits either. Rows that repeat give a row each. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, bucketed, held_out, partitions, release, release_memory, small_batches, stored, trimmed
from .hashing import TOGETHER, word_hashes

START = np.uint64(0)
CHUNK = 1 << 20
#: Documents of a chunk at most.
CHUNK_DOCS = 50_000
#: Words of all texts for each shard.
SHARD = 1 << 24
#: Shards at least, where there are as many partitions; each chunk has a row for each of them, so more would only be smaller.
SHARDS = 64
#: Ranges of shards, and parts of the chunks, that are dealt with one after the other, so that only one's rows are on disk.
PASSES = 3
#: Bits of a hash beyond the logarithm of the number of words.
SPARE_BITS = 16
QUANTILE = 0.995
#: Bits, divided by the root of the number of words, that a short text may be beyond a limit: two standard errors.
SPREAD = 12.0
LEAST = 50


class Model(NamedTuple):
    discount: np.ndarray  # of pairs by count: 0, 1, 2, 3 or more
    cut: np.ndarray  # of words by the number of words before them: 0, 1, 2, 3 or more
    before: int  # distinct pairs
    unseen: float  # lower-order probability of a word never met


class Layout(NamedTuple):
    bits: int  # of a key
    shards: int


def _trust(chunks: DataFrame, labels: DataFrame) -> DataFrame:
    """(chunk, trust) of the chunks with labelled documents: arrays of (at, trust), with trust 1 for training and 2 for the limits.

    All documents that are not named have trust 0."""
    good = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    good = good.select(F.col("doc_id").cast("string").alias("good"), F.when(held_out(F.col("doc_id")), 2).otherwise(1).alias("trust"))
    ids = chunks.select("chunk", F.posexplode("doc_ids").alias("at", "doc_id"))
    return ids.join(broadcast_if_small(good), F.col("doc_id") == F.col("good")).groupBy("chunk").agg(F.collect_list(F.struct("at", "trust")).alias("trust"))


def _trust_of(row: dict, documents: int) -> np.ndarray:
    out = np.zeros(documents, dtype=np.int8)
    for x in row["trust"] if row["trust"] is not None else ():
        out[x["at"]] = x["trust"]
    return out


def _packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _pack_planes(a: np.ndarray) -> bytes:
    """Whole numbers byte by byte: the high bytes of small ones are zero."""
    return _packed(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def _unpack_planes(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(_unpacked(data), dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    """Differences of neighbours, which are small where the keys are sorted."""
    return _pack_planes(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack_planes(data, np.uint64), dtype=np.uint64)


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted, each once. ``np.unique`` puts them in a hash table first, which takes 60 times as long as this."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, where each comes first, number of each key among them), by a sort that need not be stable."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(keys) else np.empty(0, dtype=bool)
    starts = np.flatnonzero(new)
    where = np.empty(len(keys), dtype=np.int64)
    where[order] = np.cumsum(new) - 1
    return ordered[starts], np.minimum.reduceat(order, starts) if len(starts) else starts, where


def _pack(values: np.ndarray) -> bytes:
    """Rows of counts in the smallest type that holds them; the first byte is its size."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if values.size == 0 or values.max() <= np.iinfo(k).max)
    return bytes((np.dtype(kind).itemsize,)) + _packed(values.astype(kind).tobytes())


def _unpack(data: bytes, kinds: int) -> np.ndarray:
    return np.frombuffer(_unpacked(data[1:]), dtype=f"u{data[0]}").reshape(kinds, -1).astype(np.int64)


_CHUNK = "chunk string, doc_ids array<string>, langs array<string>, hs binary, sizes binary, words binary, tokens binary, n long"


def _chunks(rows: DataFrame) -> DataFrame:
    def chunk(ids: list, langs: list, hs: list, hashes: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
        tokens, counts = np.concatenate(hashes), np.concatenate(sizes).astype(np.int64)
        distinct, _, where = _numbered(tokens)
        order = np.lexsort((distinct, -np.bincount(where, minlength=len(distinct))))
        number = np.empty(len(order), dtype=np.uint32)
        number[order] = np.arange(len(order), dtype=np.uint32)
        row = [uuid.uuid4().hex[:20], ids, langs, np.array(hs, dtype=np.int64).tobytes(), counts.tobytes(), _pack_keys(distinct[order]), _pack_planes(number[where]), len(tokens)]
        kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.binary()] * 4, pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=[x.split()[0] for x in _CHUNK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: tuple[list, ...] = ([], [], [], [], [])
        n = 0
        for b in batches:
            texts = [(t or "").encode() for t in b.column("text").to_pylist()]
            rest = [b.column(c).to_pylist() for c in ("doc_id", "lang", "h")]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and size < TOGETHER:
                    size += len(texts[end])
                    end += 1
                hashes, counts = word_hashes(texts[at:end], lower=False)
                for values, part in zip(own, rest):
                    values.extend(part[at:end])
                own[3].append(np.maximum(hashes, np.uint64(1)))
                own[4].append(counts)
                n += len(hashes)
                at = end
                if n >= CHUNK or len(own[0]) >= CHUNK_DOCS:
                    yield chunk(*own)
                    own, n = ([], [], [], [], []), 0
        if own[0]:
            yield chunk(*own)

    return rows.mapInArrow(trimmed(run), _CHUNK)


def _words_of(row: dict, bits: int) -> np.ndarray:
    return _unpack_keys(row["words"]) >> np.uint64(64 - bits)


def _tokens(row: dict, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys of the distinct words, position of each token's word among them, number of tokens of each document)."""
    return _words_of(row, bits), _unpack_planes(row["tokens"], np.uint32), np.frombuffer(row["sizes"], dtype=np.int64)


def _pairs(tokens: np.ndarray, sizes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The word before each word, or the start of its document, and the key of both."""
    before = np.empty(len(tokens), dtype=np.uint64)
    before[1:] = tokens[:-1]
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    before[starts] = START
    h = (before ^ (before >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + tokens * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return before, (h ^ (h >> np.uint64(32))) >> np.uint64(64 - bits)


def _by_shard(keys: np.ndarray, layout: Layout) -> Iterator[tuple[int, slice]]:
    """(shard, where it is) in sorted distinct keys."""
    edges = np.array([-(-(i << layout.bits) // layout.shards) for i in range(1, layout.shards)], dtype=np.uint64)
    ends = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    for i, (a, b) in enumerate(zip(ends, ends[1:])):
        if a < b:
            yield i, slice(a, b)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their sums of the rows of values."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, dtype=np.int64)
    return keys[first], np.add.reduceat(values[:, order], first, axis=1) if len(first) else values


_MODEL = "shard int, keys binary, values binary"


def _parted(keys: np.ndarray, values: np.ndarray, layout: Layout) -> pd.DataFrame:
    rows = [(i, _pack_keys(keys[at]), _pack(values[:, at])) for i, at in _by_shard(keys, layout)]
    return pd.DataFrame(rows, columns=["shard", "keys", "values"])


def _merged(parts: DataFrame, layout: Layout, kinds: int) -> DataFrame:
    """One row for each shard, with the sums of ``kinds`` values for each key.

    Parts wait until they are as many keys as the sum so far, so that a key is sorted a logarithmic number of times."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def total(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            return _summed(np.concatenate([k for k, _ in parts]), np.concatenate([v for _, v in parts], axis=1))

        for b in batches:
            for i, k, v in zip(b["shard"], b["keys"], b["values"]):
                own = waiting.setdefault(i, [])
                own.append((_unpack_keys(k), _unpack(v, kinds)))
                if len(own) > 1 and sum(len(x) for x, _ in own[1:]) >= len(own[0][0]):
                    waiting[i] = [total(own)]
        for i, own in waiting.items():
            keys, values = total(own)
            yield pd.DataFrame({"shard": [i], "keys": [_pack_keys(keys)], "values": [_pack(values)]})

    return parts.repartition(layout.shards, "shard").mapInPandas(trimmed(add), _MODEL)


def _counts(chunks: DataFrame, trust: DataFrame, layout: Layout) -> DataFrame:
    """The pairs of the training documents with their counts, by shard."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.to_dict("records"):
                words, tokens, sizes = _tokens(row, layout.bits)
                use = _trust_of(row, len(sizes)) == 1
                w = words[tokens[np.repeat(use, sizes)]]
                if len(w):
                    keys, k = np.unique(_pairs(w, sizes[use], layout.bits)[1], return_counts=True)
                    yield _parted(keys, k[None, :].astype(np.int64), layout)

    known = chunks.select("chunk", "sizes", "words", "tokens").join(trust, "chunk").select("trust", "sizes", "words", "tokens")
    return _merged(known.mapInPandas(trimmed(count), _MODEL), layout, 1)


class _Chunk:
    """A chunk with the answers to it."""

    def __init__(self, row: dict, layout: Layout):
        self.row, self.layout = row, layout
        self.answered = {(a["what"], a["shard"]): a["values"] for a in row["answers"]}
        distinct, tokens, self.sizes = _tokens(row, layout.bits)
        pairs, first, self.where = _numbered(_pairs(distinct[tokens], self.sizes, layout.bits)[1])
        self.words, _, place = _numbered(np.append(distinct, START))
        start = np.zeros(len(tokens), dtype=bool)
        start[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = True
        #: Where the words of each pair stand among all words.
        self.before, self.after = np.where(start[first], place[-1], place[tokens[first - 1]]), place[tokens[first]]
        told = self._values("pairs", pairs, 1)[0]
        self.counts, self.owned = told >> 1, (told & 1) == 1

    def _values(self, what: str, keys: np.ndarray, kinds: int) -> np.ndarray:
        out = np.zeros((kinds, len(keys)), dtype=np.int64)
        for i, at in _by_shard(keys, self.layout):
            out[:, at] = _unpack(self.answered[what, i], kinds)
        return out

    def of_words(self) -> tuple[np.ndarray, np.ndarray]:
        """What the model has of the first and of the second word of each pair."""
        stats = self._values("words", self.words, 5)
        return stats[:, self.before], stats[:, self.after]


def _answered(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """The chunks with all answers to each; the chunks stay where they are."""
    own = answers.groupBy("chunk").agg(F.collect_list(F.struct("what", "shard", "values")).alias("answers"))
    return chunks.join(own, "chunk")


def _words(chunks: DataFrame, answers: DataFrame, layout: Layout) -> DataFrame:
    """For each word, by shard: pairs that begin with it, its followers met once, twice, more often, and the words before it.

    Each pair counts in the one chunk that owns it, as only chunks know the words of a pair."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.to_dict("records"):
                c = _Chunk(row, layout)
                n, u, w = c.counts[c.owned], c.before[c.owned], c.after[c.owned]
                added = [np.bincount(u, x, len(c.words)) for x in (n, n == 1, n == 2, n > 2)]  # whole numbers far below 2 ** 53
                stats = np.stack([*added, np.bincount(w, minlength=len(c.words))]).astype(np.int64)
                met = stats.any(axis=0)
                yield _parted(c.words[met], stats[:, met], layout)

    met = _answered(chunks.select("chunk", "sizes", "words", "tokens"), answers)
    return _merged(met.mapInPandas(trimmed(run), _MODEL), layout, 5)


def _discounts(of: dict[int, int]) -> np.ndarray:
    """The three discounts of modified Kneser-Ney from how many counts are 1, 2, 3 and 4."""
    n1, n2, n3, n4 = (of.get(i, 0) for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    return np.array([0.0, *np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0.05, [0.95, 1.95, 2.95])])


def _times(model: DataFrame, kind: int, kinds: int) -> dict[int, int]:
    """How many keys have 0, 1, 2, 3, 4 of a kind of value, and under -1 the sum of all values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for v in b["values"]:
                n = _unpack(v, kinds)[kind]
                yield pd.DataFrame({"i": range(-1, 6), "n": [int(n.sum()), *np.bincount(np.minimum(n, 5), minlength=6).tolist()]})

    return dict(model.mapInPandas(trimmed(run), "i int, n long").groupBy("i").agg(F.sum("n")).collect())


def _fit(counts: DataFrame, words: DataFrame) -> Model | None:
    of, kinds = _times(counts, 0, 1), _times(words, 4, 5)
    if not of:
        return None
    cut, before = _discounts(kinds), kinds[-1]
    left = float(cut[1] * kinds[1] + cut[2] * kinds[2] + cut[3] * (kinds[3] + kinds[4] + kinds[5]))
    met = sum(kinds[i] for i in range(1, 6))
    return Model(_discounts(of), cut, before, left / before / (met + 1))


def _asked(row: dict, bits: int, what: str, low: int, high: int) -> np.ndarray:
    """The distinct pairs or words of a chunk from ``low`` to before ``high``, in order."""
    if what == "pairs":
        words, tokens, sizes = _tokens(row, bits)
        keys = _pairs(words[tokens], sizes, bits)[1]
    else:
        keys = np.append(_words_of(row, bits), START)
    return _distinct(keys[(keys >= np.uint64(low)) & (keys <= np.uint64(high - 1))])


def _requests(chunks: DataFrame, layout: Layout, what: str, first: int, last: int) -> DataFrame:
    """(shard, chunk, keys): the distinct pairs or words of every chunk, in the shards from ``first`` to before ``last``."""
    low, high = (-(-(i << layout.bits) // layout.shards) for i in (first, last))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.to_dict("records"):
                keys = _asked(row, layout.bits, what, low, high)
                rows = [(i, row["chunk"], _pack_keys(keys[at])) for i, at in _by_shard(keys, layout)]
                yield pd.DataFrame(rows, columns=["shard", "chunk", "keys"], dtype=object)

    columns = ("chunk", "sizes", "words", "tokens") if what == "pairs" else ("chunk", "words")
    return chunks.select(*columns).mapInPandas(trimmed(ask), "shard int, chunk string, keys binary")


def _answers(chunks: DataFrame, table: DataFrame, layout: Layout, what: str, kinds: int, shards: tuple[int, int]) -> DataFrame:
    """(chunk, what, shard, values) for some of the shards: in each shard the model's row comes first and the requests stream past it.

    Of a pair comes twice its count, and one more to the first chunk that asks: it owns the pair."""

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, own, values = -1, np.empty(0, dtype=np.uint64), np.empty((kinds, 0), dtype=np.int64)
        for b in batches:
            rows = []
            for shard, kind, chunk, k, v in zip(b["shard"], b["kind"], b["chunk"], b["keys"], b["values"]):
                if kind == 0:
                    at, own, values = shard, _unpack_keys(k), _unpack(v, kinds)
                    values = 2 * values + 1 if what == "pairs" else values
                    continue
                keys = _unpack_keys(k)
                found = np.zeros((kinds, len(keys)), dtype=np.int64)
                if at == shard:
                    i = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                    met = own[i] == keys
                    i = i[met]
                    found[:, met] = values[:, i]
                    if what == "pairs":
                        values[0, i] &= ~1
                rows.append((chunk, what, shard, _pack(found)))
            yield pd.DataFrame(rows, columns=["chunk", "what", "shard", "values"], dtype=object)

    first, last = shards
    model = table.where((F.col("shard") >= first) & (F.col("shard") < last)).select("shard", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("chunk"), "keys", "values")
    both = model.union(_requests(chunks, layout, what, first, last).select("shard", F.lit(1), "chunk", "keys", F.lit(None).cast("binary")))
    return both.repartition(layout.shards, "shard").sortWithinPartitions("shard", "kind").mapInPandas(trimmed(answer), "chunk string, what string, shard int, values binary")


def _bits(model: Model, counts: np.ndarray, before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Bits of each pair: its count, and what the model has of its two words."""
    n = word[4]
    lower = (n - model.cut[np.minimum(n, 3)]) / model.before + model.unseen
    total = np.maximum(before[0], 1)
    left = (model.discount[1:, None] * before[1:4]).sum(axis=0) / total
    high = (counts - model.discount[np.minimum(counts, 3)]) / total + left * lower
    return -np.log2(np.where(before[0] > 0, high, lower))


def _scores(chunks: DataFrame, trust: DataFrame, answers: DataFrame, model: Model, layout: Layout, part: int) -> DataFrame:
    """(doc_id, lang, h, trust, n_words, bits) of every document of every chunk of one of ``PASSES`` parts."""
    shared = chunks.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "lang", "h", "trust", "n_words", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                c = _Chunk(row, layout)
                ends = np.concatenate([[0.0], np.cumsum(_bits(shared.value, c.counts, *c.of_words())[c.where])])
                stop = np.cumsum(c.sizes)
                mean = (ends[stop] - ends[stop - c.sizes]) / np.maximum(c.sizes, 1)
                trust = _trust_of(row, len(c.sizes)).astype(np.int32)
                columns = [pa.array(row["doc_ids"], pa.string()), pa.array(row["langs"], pa.string()), pa.array(np.frombuffer(row["hs"], dtype=np.int64)), pa.array(trust), pa.array(c.sizes), pa.array(mean, mask=c.sizes == 0)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    own = F.pmod(F.xxhash64("chunk"), F.lit(PASSES)) == part
    known = _answered(chunks.drop("n").where(own), answers.where(own)).join(trust.where(own), "chunk", "left")
    return known.mapInArrow(trimmed(run), "doc_id string, lang string, h long, trust int, n_words long, bits double")


def _limits(scores: DataFrame, quantile: float) -> DataFrame:
    """The scores with ``limit``, that of each document's language, and ``allowance``."""
    # Null without words: a division by zero is an error in ANSI mode, and may run for rows that no limit is compared with.
    scores = scores.withColumn("allowance", F.when(F.col("n_words") > 0, F.lit(SPREAD) / F.sqrt("n_words")))
    end = F.percentile_approx(F.col("bits") - F.col("allowance"), quantile, 10_000)
    fair = scores.where("trust = 2 AND bits IS NOT NULL")
    each = fair.groupBy(F.col("lang").alias("of")).agg(end.alias("own"), F.count(F.lit(1)).alias("fair")).where(f"fair >= {LEAST}")
    joined = scores.join(each, F.col("lang").eqNullSafe(F.col("of")), "left")
    return joined.withColumn("limit", F.coalesce("own", F.lit(fair.agg(end).first()[0]).cast("double")))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, n_words, perplexity, bits, allowance, limit, kept) for every document.

    Kept are those with bits <= limit + allowance."""
    found = _judged(docs, labels, id_col, text_col, lang_col, quantile)
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType)).drop("h")


def _judged(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, quantile: float) -> DataFrame:
    """The rows of :func:`classify`, ids as strings, with ``h``, a hash of the text."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    with small_batches(spark):
        chunks = bucketed(_chunks(rows.withColumn("h", F.xxhash64("text"))), "chunks", "chunk", partitions(spark))
    trust = stored(_trust(chunks, labels), "trust")
    n = chunks.agg(F.sum("n")).first()[0] or 0
    layout = Layout(min(64, n.bit_length() + SPARE_BITS), max(min(partitions(spark), SHARDS), n // SHARD))
    spans = [(i * layout.shards // PASSES, (i + 1) * layout.shards // PASSES) for i in range(PASSES)]
    with small_batches(spark, 4):
        counts = stored(_counts(chunks, trust, layout), "counts")
        release_memory(spark)
        model = None
        if counts.limit(1).count():
            told = []
            for span in spans:
                told.append(stored(_answers(chunks, counts, layout, "pairs", 1, span), "told"))
                release_memory(spark)
            words = stored(_words(chunks, reduce(DataFrame.union, told), layout), "words")
            release_memory(spark)
            model = _fit(counts, words)
            release(counts)
            for span in spans:
                told.append(stored(_answers(chunks, words, layout, "words", 5, span), "told"))
                release_memory(spark)
            release(words)
            answers, parts = reduce(DataFrame.union, told), []
            for i in range(PASSES):
                parts.append(stored(_scores(chunks, trust, answers, model, layout, i), "scores"))
                release_memory(spark)
            scores = reduce(DataFrame.union, parts)
            release(*told)
    if model is None:
        size = F.when(F.col("text").isNotNull(), F.regexp_count("text", F.lit(WORD))).otherwise(0).cast("long")
        scores = rows.select("doc_id", "lang", F.xxhash64("text").alias("h"), F.lit(0).alias("trust"), size.alias("n_words"), F.lit(None).cast("double").alias("bits"))
        release(counts)
    release(chunks, trust)
    joined = _limits(scores, quantile)
    kept = F.coalesce(F.col("bits") - F.col("allowance") <= F.col("limit"), F.lit(True))
    return joined.select("doc_id", "h", "lang", "n_words", F.pow(F.lit(2.0), "bits").alias("perplexity"), "bits", "allowance", "limit", kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, each judged by its own text and language, with columns of any name."""
    mark = uuid.uuid4().hex
    rejected = _judged(docs, labels, id_col, text_col, lang_col, quantile).where("NOT kept").select("doc_id", "h", "lang").distinct()
    gone = rejected.toDF(f"i_{mark}", f"h_{mark}", f"l_{mark}")
    own = (F.col(f"`{id_col}`").cast("string"), F.xxhash64(F.col(f"`{text_col}`")), F.col(f"`{lang_col}`").cast("string"))
    alike = [a.eqNullSafe(F.col(b)) for a, b in zip(own, gone.columns)]
    return docs.join(broadcast_if_small(gone), alike[0] & alike[1] & alike[2], "left_anti")
