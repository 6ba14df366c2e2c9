"""N-gram Jaccard join: a grouped prefix join over sets of word shingles, and the components of its links.

Documents with the same set are one key from the start. The shingles of a set are put in one global order, rarest first;
two sets can only be similar enough if their prefixes (n - ceil(t n) + 1 shingles) meet. Shingles that only one key has in
its prefix are dropped, and keys with the same remaining prefix and the same size are collapsed into one group. Two groups
are a candidate pair if they share a prefix shingle, their sizes fit, and at that shingle both have enough shingles left to
reach the similarity (the positional filter). Candidate pairs of groups are expanded into members, and pairs of members
are verified on whole texts.

The work does not grow with the square of a family of near copies, and nothing is capped:

* Members of a group are compared with its smallest key only. Those that are not similar to it leave for a group of their own,
  so that a group is linked within itself and the similarity of each member to the group's key is known.
* Then come rounds in which every group is compared with one other, of another component: the one that most of its lists
  propose, where a list proposes a group of the component that it holds most of (to this component itself, one that it holds
  least of). Components merge between rounds, and lists that hold one component only drop out. The rounds end when few of
  the comparisons (``SETTLED``) find a link.
* The last round takes all pairs of groups that are left: those that share a list, can be similar by size and position,
  and are in different components still. It has no limit, so the components are exact. Where two sketches of ``SKETCH`` bits (a
  bit tells whether an odd number of shingles fall on it) differ in d bits, the sets differ in d shingles at least: pairs that are too far
  apart by this, their groups' radii allowed for, are dropped in the join itself. The others are compared. Pairs of members beyond the
  groups' keys follow only where the triangle inequality of the Jaccard distance leaves room: d(x, y) >= d(p, q) - d(x, p) -
  d(y, q).

Passages that many unlike documents share stand at the end of the global order. There the positional filter lets through
just the pairs whose common passage makes them similar, so such lists don't give all their pairs either.

The order needs only counts of shingles in a fixed number of hash buckets over all documents; the result is exact for any order.

Scale: counting sends 4 MB a task. The prefixes are a quarter of the shingles, counted with map-side sums and joined by
their key (Spark splits skewed lists), in ``PASSES`` parts one after the other. The texts of keys that share a prefix shingle are stored once, bucketed by key, and
a comparison moves the text of one side, and of the other once for ``SPLIT`` comparisons with it. A Bloom filter of at most
2 ** ``MAX_BLOOM_BITS`` bits picks these texts before they are shuffled; beyond that size a join does. Every iteration cuts
its lineage with a table in the shared folder.

Edge cases: a null text, or one without words, has size 0 and no links; a text with fewer words than a shingle is one
shingle. A null id takes part through its text, and is never a component's id unless all ids there are null. Rows that
repeat, ids included, give a row each. An empty table gives an empty result. Other columns are ignored. Shingles and
whole sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, bucketed, collect_garbage, partitions, release, small_batches, stored, trimmed, with_columns
from .graph import components
from .hashing import TOGETHER, mixed, word_hashes

WORDS = 5
#: The similarity as a fraction: numerator, denominator.
SIMILARITY = (75, 100)
#: Hash buckets in which shingles are counted to order them, as a power of two, and the slices that tasks exchange.
COUNT_BITS, SLICES = 20, 64
#: Parts of the shingles that are looked for in other prefixes one after the other, so that only one's rows are moved at a time.
PASSES = 2
#: Bits of the Bloom filter of texts that are compared, as a power of two: 16 for each at least, and these at most.
MAX_BLOOM_BITS = 27
#: Tokens before a shared one that tell whether a pair has met already.
RECENT = 8
#: Comparisons with one key that are made in one task.
SPLIT = 1024
#: The rounds of single comparisons end when a smaller share of them finds a link.
SETTLED = 0.15
#: Bits of the sketch of a set.
SKETCH = 1024
_FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64)) for i in range(16)]


def shingle_sets(texts: Iterable[str | None], n: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the n-word shingles of each text, A-Z lower-cased; texts are hashed together."""
    together: list[bytes] = []
    size = 0
    for t in texts:
        together.append((t or "").encode())
        size += len(together[-1]) + 1
        if size > TOGETHER:
            yield from _shingled(together, n)
            together, size = [], 0
    yield from _shingled(together, n)


def _shingled(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    h, counts = word_hashes(texts, lower=True)
    sizes = counts.tolist()
    full = np.full(max(len(h) - n + 1, 0), n, dtype=np.uint64)
    for i in range(n):
        full += h[i : i + len(full)] * _FACTORS[i]
    full = mixed(full)
    at = 0
    for size in sizes:
        if size >= n:
            own = np.sort(full[at : at + size - n + 1])
        elif size:
            own = mixed(np.array([(size + sum(int(x) * int(f) for x, f in zip(h[at : at + size], _FACTORS))) & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))
        else:
            own = np.empty(0, dtype=np.uint64)
        at += size
        yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) > 1 else own


def prefix_length(n: int, similarity: tuple[int, int] = SIMILARITY) -> int:
    num, den = similarity
    return n - -(-num * n // den) + 1 if n else 0


def _digest(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many documents have a shingle, by hash bucket; 2 ** COUNT_BITS numbers reach the driver."""
    width = (1 << COUNT_BITS) // SLICES

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(1 << COUNT_BITS, dtype=np.uint32)
        part, size = [], 0
        for b in batches:
            for s in shingle_sets(b["text"]):
                part.append(_bucket(s))
                size += len(s)
                if size > 1 << COUNT_BITS:
                    sums += np.bincount(np.concatenate(part), minlength=1 << COUNT_BITS).astype(np.uint32)
                    part, size = [], 0
        if part:
            sums += np.bincount(np.concatenate(part), minlength=1 << COUNT_BITS).astype(np.uint32)
        yield pd.DataFrame({"slice": range(SLICES), "counts": [sums[i * width : (i + 1) * width].tobytes() for i in range(SLICES)]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, counts in zip(b["slice"], b["counts"]):
                part = np.frombuffer(counts, dtype=np.uint32)
                sums[i] = sums[i] + part if i in sums else part.astype(np.uint64)
        yield pd.DataFrame({"slice": list(sums), "counts": [x.tobytes() for x in sums.values()]})

    schema = "slice int, counts binary"
    rows = texts.mapInPandas(trimmed(count), schema).repartition(SLICES, "slice").mapInPandas(trimmed(add), schema).collect()
    out = np.zeros(1 << COUNT_BITS, dtype=np.uint64)
    for r in rows:
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counts"], dtype=np.uint64)
    return np.minimum(out, np.uint64((1 << 24) - 1)).astype(np.uint32)


def _prefixes(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """(doc_id, h, n, key, prefix) of every row; ``prefix`` in the global order."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(given: dict[str, list]) -> dict[str, list]:
        order, out = shared.value, {"n": [], "key": [], "prefix": []}
        for s in shingle_sets(given["text"]):
            rank = (order[_bucket(s)].astype(np.uint64) << np.uint64(40)) | (s & np.uint64((1 << 40) - 1))
            out["n"].append(len(s))
            out["key"].append(_digest(s))
            out["prefix"].append(s[np.argsort(rank, kind="stable")[: prefix_length(len(s))]].view(np.int64))
        return out

    return with_columns(docs, run, "n long, key long, prefix array<long>", keep=("doc_id", "h"))


def _bloom(hashes: DataFrame) -> np.ndarray | None:
    """Bits of a Bloom filter over a column ``h`` of 64-bit hashes; None where it would be too large."""
    bits = max(16 * hashes.count(), 1 << 10).bit_length()
    if bits > MAX_BLOOM_BITS:
        return None
    mask = (1 << bits) - 1
    spots = F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseAND(mask))
    words = hashes.select(F.explode(spots).alias("p")).select(F.shiftright("p", 5).alias("word"), F.expr("shiftleft(1L, cast(p & 31 as int))").alias("bit"))
    pdf = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # at most 2 ** (MAX_BLOOM_BITS - 5) rows
    out = np.zeros(1 << (bits - 5), dtype=np.uint32)
    out[pdf["word"].to_numpy(dtype=np.int64)] = pdf["bits"].to_numpy(dtype=np.int64).astype(np.uint32)
    return out


def _likely(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """(h, text) of the rows that may be needed, each text at most once a task."""
    found = _bloom(needed)
    if found is None:
        return texts
    shared = texts.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        mask = np.uint64(32 * len(bits) - 1)
        for b in batches:
            h = b.column("h").to_numpy(zero_copy_only=False).astype(np.int64)
            x = h.view(np.uint64)
            there = np.ones(len(x), dtype=bool)
            for spot in (x & mask, (x >> np.uint64(32)) & mask):
                there &= (bits[(spot >> np.uint64(5)).astype(np.int64)] >> (spot & np.uint64(31)).astype(np.uint32)) & 1 == 1
            rows = []
            for i in np.flatnonzero(there).tolist():
                if h[i] not in seen:
                    seen.add(h[i])
                    rows.append(i)
            yield b.take(pa.array(rows, pa.int64()))

    return texts.mapInArrow(trimmed(run), "h long, text string")


def _texts(rows: DataFrame, ids: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, text) of the keys, bucketed by key; any text of a key will do."""
    needed = stored(ids.join(keys, "key", "left_semi").groupBy("key").agg(F.min("h").alias("h")), "needed")
    found = _likely(rows.where("text IS NOT NULL").select("h", "text"), needed.select("h"))
    out = bucketed(found.join(broadcast_if_small(needed), "h").select("key", "text").dropDuplicates(["key"]), "texts", "key", partitions(rows.sparkSession))
    release(needed)
    collect_garbage(rows.sparkSession)
    return out


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (x, p, and columns of longs) with ``common``, the number of shingles in both keys' sets.

    A key may stand in any number of pairs as ``p``: its text goes to one task for each ``SPLIT`` of them."""
    columns = pairs.columns
    often = pairs.groupBy("p").agg((F.floor(F.count(F.lit(1)) / SPLIT) + 1).alias("tasks"))
    of_p = often.select(F.col("p").alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("part")).join(texts, "key")
    of_x = pairs.join(often, "p").withColumn("part", F.pmod(F.xxhash64("x"), F.col("tasks"))).join(texts.toDF("x", "text_x"), "x")
    both = of_x.join(of_p.toDF("p", "part", "text_p"), ["p", "part"]).select(*columns, "text_x", "text_p")
    schema = ", ".join(f"{c} long" for c in [*columns, "common"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for b in batches:
            p, text_p = b.column("p").to_pylist(), b.column("text_p")
            new = {k: i for i, k in enumerate(p) if k not in known}
            known = {k: known[k] for k in set(p) - new.keys()}
            known.update(zip(new, shingle_sets(text_p[i].as_py() for i in new.values())))
            common = []
            for k, own in zip(p, shingle_sets(b.column("text_x").to_pylist())):
                met = np.concatenate([own, known[k]])
                met.sort()
                common.append(int(np.count_nonzero(met[1:] == met[:-1])))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(common, pa.int64())], names=[*columns, "common"])

    return both.mapInArrow(trimmed(run), schema)


def _fits(n: Column, m: Column) -> Column:
    num, den = SIMILARITY
    return F.least(n, m) * den >= F.greatest(n, m) * num


def _reaches(left: Column, left2: Column, n: Column, m: Column) -> Column:
    """Both have as many shingles, from the shared one on, as two sets of these sizes must have in common."""
    num, den = SIMILARITY
    return F.least(left, left2) * (num + den) >= (n + m) * num


def _similar(common: Column, n: Column, m: Column) -> Column:
    num, den = SIMILARITY
    return common * den >= (n + m - common) * num


def _postings(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token, key, n, left) of prefix shingles that two keys or more share, and (doc_id, h, key, n) of every row.

    left: how many shingles of the set the order has from this one on."""
    spark = rows.sparkSession
    base = stored(_prefixes(rows, bucket_counts(rows.select("text"))), "prefixes")
    ids = stored(base.select("doc_id", "h", F.when(F.col("n") > 0, F.col("key")).alias("key"), "n"), "ids")
    parts = []
    for i in range(PASSES):
        posts = base.select("key", "n", F.posexplode("prefix").alias("at", "token")).where(F.pmod("token", F.lit(PASSES)) == i)
        met = stored(posts.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("token"), "met")
        collect_garbage(spark)
        parts.append(stored(posts.join(met, "token").select("token", "key", "n", (F.col("n") - F.col("at")).alias("left")).distinct(), "shared"))
        release(met)
        collect_garbage(spark)
    release(base)
    shared = reduce(DataFrame.union, parts)
    several = shared.groupBy("token").agg(F.count(F.lit(1)).alias("keys")).where("keys > 1").select("token")
    out = stored(shared.join(several, "token").select("token", "key", "n", "left"), "postings")
    release(*parts)
    collect_garbage(spark)
    return out, ids


def _groups(posts: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, grp, n, common) of every key that shares a shingle, and the lists (token, grp, n, left, comp) of the groups.

    A group's members have the same size and the same remaining prefix and are similar to its key ``grp``, with which they
    have ``common`` shingles. Who is not similar to the smallest key is tried once more with the smallest of those left,
    and else stands alone."""
    same = posts.groupBy("key", "n").agg(F.xxhash64(F.sort_array(F.collect_list("token"))).alias("prefix"))
    same = stored(same, "effective")
    loose = stored(same.join(same.groupBy("n", "prefix").agg(F.min("key").alias("grp")), ["n", "prefix"]).select("key", "grp", "n"), "loose")
    release(same)
    settled, done = [], [loose]
    for _ in range(2):
        pairs = loose.where("key <> grp").select(F.col("key").alias("x"), F.col("grp").alias("p"), "n")
        found = stored(_compared(pairs, texts), "in-groups")
        good = _similar(F.col("common"), F.col("n"), F.col("n"))
        settled += [loose.where("key = grp").select("key", "grp", "n", F.col("n").alias("common")), found.where(good).select(F.col("x").alias("key"), F.col("p").alias("grp"), "n", "common")]
        rest = found.where(~good)
        again = rest.groupBy("p").agg(F.min("x").alias("grp"))
        loose = stored(rest.join(again, "p").select(F.col("x").alias("key"), "grp", "n"), "loose")
        done += [found, loose]
        if not loose.limit(1).count():
            break
    settled.append(loose.select("key", F.col("key").alias("grp"), "n", F.col("n").alias("common")))
    members = stored(reduce(DataFrame.union, settled), "members")
    release(*done)
    collect_garbage(posts.sparkSession)
    lists = posts.join(members.select("key", "grp"), "key").groupBy("token", "grp").agg(F.first("n").alias("n"), F.max("left").alias("left"))
    return members, stored(lists.withColumn("comp", F.col("grp")), "lists")


def _ends(lists: DataFrame, seed: int) -> DataFrame:
    """For every list with two components or more: a group of the one with most groups in it, and one of another with fewest.

    Among equals, the seed decides: ids are ordered by what an exclusive or with a number of the seed makes of them."""
    turn = F.lit((seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
    each = lists.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(F.col("grp").bitwiseXOR(turn).alias("g"), "n", "left")).alias("g"))
    by = F.struct("c", F.col("comp").bitwiseXOR(turn).alias("k"), "g.g", "g.n", "g.left")
    ends = each.groupBy("token").agg(F.max(by).alias("most"), F.min(by).alias("least")).where("most.k <> least.k")
    named = [F.struct(F.col(f"{e}.k").bitwiseXOR(turn).alias("comp"), F.col(f"{e}.g").bitwiseXOR(turn).alias("grp"), F.col(f"{e}.n").alias("n"), F.col(f"{e}.left").alias("left")).alias(e) for e in ("most", "least")]
    return ends.select("token", *named)


def _proposed(lists: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """The lists that hold several components, and one pair (x, p, n, m, comp, comp2) at most for every group in them."""
    other = F.when(F.col("comp") == F.col("most.comp"), F.col("least")).otherwise(F.col("most"))
    met = lists.join(_ends(lists, seed), "token").select("token", "grp", "n", "left", "comp", other.alias("o"))
    live = stored(met.select("token", "grp", "n", "left", "comp", F.col("o.grp").alias("grp2"), F.col("o.n").alias("n2"), F.col("o.left").alias("left2"), F.col("o.comp").alias("comp2")), "lists")
    able = live.where(_fits(F.col("n"), F.col("n2")) & _reaches(F.col("left"), F.col("left2"), F.col("n"), F.col("n2")))
    each = able.groupBy("grp", "grp2").agg(F.count(F.lit(1)).alias("c"), F.first(F.struct("n", F.col("n2").alias("m"), "comp", "comp2")).alias("o"))
    best = each.groupBy("grp").agg(F.max(F.struct("c", F.xxhash64("grp2", F.lit(seed)).alias("h"), F.col("grp2").alias("p"), "o")).alias("b"))
    pairs = best.select(F.col("grp").alias("x"), "b.p", "b.o.n", "b.o.m", "b.o.comp", "b.o.comp2")
    once = pairs.groupBy(F.least("x", "p"), F.greatest("x", "p")).agg(F.min(F.struct(*pairs.columns)).alias("s")).select("s.*")
    return live, stored(once, "pairs")


def _renamed(df: DataFrame, labels: DataFrame, name: str = "comp") -> DataFrame:
    """``df`` with the component in ``name`` replaced by its label, where it has one."""
    named = labels.select(F.col("node").alias("was"), F.col("label").alias("now"))
    return df.join(named, F.col(name) == F.col("was"), "left").withColumn(name, F.coalesce("now", name)).drop("was", "now")


def _links(found: DataFrame) -> DataFrame:
    """(a, b): components that a link joins."""
    return found.where(_similar(F.col("common"), F.col("n"), F.col("m"))).select(F.col("comp").alias("a"), F.col("comp2").alias("b"))


def _with_recent(lists: DataFrame) -> DataFrame:
    """``lists`` with the ``RECENT`` tokens that come before each in its group, in the global order."""
    own = lists.groupBy("grp", "n", "comp").agg(F.sort_array(F.collect_list(F.struct("left", "token")), asc=False).alias("own"))
    own = own.select("grp", "n", "comp", "own.token", F.posexplode("own").alias("at", "t"))
    start = F.greatest(F.col("at") + 1 - RECENT, F.lit(1))
    return own.select(F.col("t.token").alias("token"), "grp", "n", F.col("t.left").alias("left"), "comp", F.slice("token", start, F.col("at") + 1 - start).alias("recent"))


def _sketch(shingles: np.ndarray) -> bytes:
    """Which of ``SKETCH`` bits an odd number of the shingles fall on."""
    return np.packbits((np.bincount((shingles % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1).astype(np.uint8)).tobytes()


def _sketches(groups: DataFrame, members: DataFrame, texts: DataFrame) -> DataFrame:
    """(grp, radius, s0, s1, ...) of the groups: the distance of the farthest member, and the sketch of the group's key as longs."""
    words = SKETCH // 64
    names = ["grp", *(f"s{i}" for i in range(words))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = np.frombuffer(b"".join(map(_sketch, shingle_sets(b.column("text").to_pylist()))), dtype=np.int64).reshape(-1, words)
            yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(words))], names=names)

    own = texts.join(groups.select(F.col("grp").alias("key")), "key", "left_semi").mapInArrow(trimmed(run), ", ".join(f"{c} long" for c in names))
    far = members.groupBy("grp").agg(F.max(1 - F.col("common") / (2 * F.col("n") - F.col("common"))).alias("radius"))
    return stored(own.join(far, "grp").select("grp", "radius", *names[1:]), "sketches")


def _near_enough(n: Column, m: Column, radii: Column, other: str) -> Column:
    """Whether members of two groups can be similar by the sketches ``s0``, ... and those with ``other`` behind their names."""
    num, den = SIMILARITY
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"s{i}{other}"))) for i in range(SKETCH // 64)])
    common = (n + m - apart) / 2  # at most
    return 1 - common / (n + m - common) <= 1 - num / den + 1e-9 + radii


def _met(lists: DataFrame, tested: list[DataFrame], members: DataFrame, texts: DataFrame) -> DataFrame:
    """All pairs (x, p, n, m, comp, comp2) of groups of different components that can be similar and have not been compared.

    In each list, the groups outside its largest component meet all others. A pair is made where it first shares a token;
    of the lists that it shares later, those whose ``RECENT`` tokens before show this do not make it again."""
    most = stored(_ends(lists, 0).select("token", F.col("most.comp").alias("top")), "most")
    several = stored(lists.join(most, "token", "left_semi"), "lists")
    sketches = _sketches(several.select("grp").distinct(), members, texts)
    live = stored(_with_recent(several).join(sketches, "grp"), "live")
    words = [f"s{i}" for i in range(SKETCH // 64)]
    others = live.join(most, "token").where(F.col("comp") != F.col("top")).select(F.col("token").alias("t2"), F.col("grp").alias("p"), F.col("n").alias("m"), F.col("left").alias("left2"), F.col("comp").alias("comp2"), F.col("recent").alias("recent2"), "top", F.col("radius").alias("radius2"), *[F.col(w).alias(f"{w}_2") for w in words])
    able = _fits(F.col("n"), F.col("m")) & _reaches(F.col("left"), F.col("left2"), F.col("n"), F.col("m"))
    once = (F.col("comp") == F.col("top")) | (F.col("grp") < F.col("p"))
    near = _near_enough(F.col("n"), F.col("m"), F.col("radius") + F.col("radius2"), "_2")
    met = live.join(others, (F.col("token") == F.col("t2")) & (F.col("comp") != F.col("comp2")) & once & able & near & ~F.arrays_overlap("recent", "recent2"))
    swap = F.col("grp") > F.col("p")
    pairs = met.select(*[F.when(swap, F.col(b)).otherwise(F.col(a)).alias(c) for a, b, c in (("grp", "p", "x"), ("p", "grp", "p"), ("n", "m", "n"), ("m", "n", "m"), ("comp", "comp2", "comp"), ("comp2", "comp", "comp2"))]).distinct()
    before = reduce(DataFrame.union, [t.select(F.least("x", "p").alias("u"), F.greatest("x", "p").alias("v")) for t in tested])
    out = stored(pairs.join(before, (F.col("x") == F.col("u")) & (F.col("p") == F.col("v")), "left_anti"), "pairs")
    release(live, most, several, sketches)
    return out


def _expanded(tested: list[DataFrame], merged: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (x, p, n, m, comp, comp2) of members of compared groups, of different components, that can still be similar."""
    num, den = SIMILARITY
    many = members.groupBy("grp").agg(F.max(1 - F.col("common") / (2 * F.col("n") - F.col("common"))).alias("radius"), F.count(F.lit(1)).alias("size"))
    room = F.lit(1 - num / den + 1e-9)
    failed = reduce(DataFrame.union, tested).where(~_similar(F.col("common"), F.col("n"), F.col("m")))
    failed = failed.withColumn("d", 1 - F.col("common") / (F.col("n") + F.col("m") - F.col("common")))
    of = lambda c: many.select(F.col("grp").alias(c), F.col("radius").alias(f"r_{c}"), F.col("size").alias(f"s_{c}"))
    open_pairs = failed.join(of("x"), "x").join(of("p"), "p").where((F.col("s_x") + F.col("s_p") > 2) & (F.col("d") <= room + F.col("r_x") + F.col("r_p")))
    apart = _renamed(_renamed(open_pairs.select("x", "p", "n", "m", "comp", "comp2", "d"), merged), merged, "comp2").where("comp <> comp2")
    far = members.select("key", "grp", (1 - F.col("common") / (2 * F.col("n") - F.col("common"))).alias("far"))
    with_x = apart.join(far.toDF("kx", "x", "fx"), "x")
    pairs = with_x.join(far.toDF("kp", "p", "fp"), "p").where((F.col("d") <= room + F.col("fx") + F.col("fp")) & ((F.col("kx") != F.col("x")) | (F.col("kp") != F.col("p"))))
    return pairs.select(F.col("kx").alias("x"), F.col("kp").alias("p"), "n", "m", "comp", "comp2").distinct()


def _group_components(members: DataFrame, lists: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, label) of the groups that are linked with others."""
    spark, tested, seed = lists.sparkSession, [], 0
    links = []
    while True:
        seed += 1
        live, pairs = _proposed(lists, seed)
        found = stored(_compared(pairs, texts), "compared")
        made = stored(_links(found).distinct(), "links")
        tested.append(found)
        links.append(made)
        n_pairs, n_links = found.agg(F.count(F.lit(1)), F.count(F.when(_similar(F.col("common"), F.col("n"), F.col("m")), 1))).first()
        going = n_links > SETTLED * n_pairs
        # Between rounds one step of joining will do; before the last one, components must be whole.
        merged = components(made, most=1) if going else components(reduce(DataFrame.union, links))
        release(lists, pairs)
        lists = stored(_renamed(live.select("token", "grp", "n", "left", "comp"), merged), "lists")
        release(live)
        collect_garbage(spark)
        if not going:
            break
        release(merged)
    rest = _met(lists, tested, members, texts)
    used = [lists, rest]
    if rest.limit(1).count():
        found = stored(_compared(rest, texts), "compared")
        made = stored(_links(found).distinct(), "links")
        tested.append(found)
        links.append(made)
        if made.limit(1).count():
            release(merged)
            merged = components(reduce(DataFrame.union, links))
    if members.where("key <> grp").limit(1).count():
        inside = stored(_expanded(tested, merged, members), "pairs")
        used.append(inside)
        if inside.limit(1).count():
            more = stored(_compared(inside, texts), "compared")
            used.append(more)
            release(merged)
            merged = components(reduce(DataFrame.union, links).union(_links(more)))
    release(*used, *tested, *links)
    collect_garbage(spark)
    return merged


def similar_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id): class_id is the smallest id with the same set."""
    return _components(docs, id_col, text_col).select("doc_id", "n_shingles", "component_id", "class_id")


def _components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of :func:`similar_components` with ``h``, a hash of the text, and ``comp``, which is null without shingles."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).withColumn("h", F.xxhash64("text"))
    with small_batches(docs.sparkSession):
        posts, ids = _postings(rows)
        texts = _texts(rows, ids, posts.select("key").distinct())
        members, lists = _groups(posts, texts)
        release(posts)
        merged = _group_components(members, lists, texts)
        comps = stored(_renamed(members.select("key", F.col("grp").alias("comp")), merged), "components")
        release(texts, members, merged)
    smallest = ids.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("class_id")).join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    smallest = stored(smallest, "classes")
    low = smallest.groupBy("comp").agg(F.min("class_id").alias("low"))
    named = ids.join(smallest, "key", "left").join(low, "comp", "left")
    return named.select("doc_id", "h", F.col("n").alias("n_shingles"), F.coalesce("low", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"), "comp")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, and all rows without shingles, which are linked with nothing.

    The row with the smallest id stays (a null id is the largest); of several texts under that id, one; of rows alike in
    both, the one whose other columns are smallest. Columns of any name are kept; where rows are alike in id and text,
    their types must have an order."""
    mark = uuid.uuid4().hex
    i, t, h = f"`{id_col}`", f"`{text_col}`", f"h_{mark}"
    each = _components(docs, id_col, text_col).where("comp IS NOT NULL").groupBy("comp", "doc_id", "h").agg(F.count(F.lit(1)).alias("rows"))
    each = stored(each, "rows")
    first = each.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h")).alias("f"))
    chosen = F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("h") == F.col("f.h"))
    marked = each.join(first, "comp").select(F.col("doc_id").alias(f"i_{mark}"), F.col("h").alias(f"t_{mark}"), chosen.alias(f"c_{mark}"), "rows")
    marked = stored(marked.where(f"NOT c_{mark} OR rows > 1").drop("rows"), "gone")
    release(each)
    rows = docs.withColumn(h, F.xxhash64(F.col(t)))
    same = lambda other: F.col(i).eqNullSafe(other[f"i_{mark}"]) & F.col(h).eqNullSafe(other[f"t_{mark}"])
    kept = rows.join(broadcast_if_small(marked), same(marked), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    twice = marked.where(f"c_{mark}")
    if not twice.limit(1).count():
        return kept
    one = rows.join(broadcast_if_small(twice), same(twice), "left_semi").groupBy(F.col(i).alias(f"i_{mark}"), F.col(h).alias(f"t_{mark}")).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row"))
    return kept.union(one.select("row.*"))
