import datetime as dt
import os
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellatlas.llm import common, jaccard, langid, mixing, neighbours, ogg, quality, secrets, sentencepiece_codec, toxicity, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n):
    r = np.random.default_rng(seed)
    return ["".join(r.choice(list("abcdefgh"), 5)) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    a = words(1, 60)
    rows = [(0, " ".join(a), "en", "s1"), (1, " ".join(a), "en", "s1"), (2, " ".join([*a[:-1], "changed"]), "en", "s2"), (3, " ".join(words(2, 60)), "de", None)]
    rows += [(4, "", "en", "s1"), (5, None, None, None), (6, "one TWO", "en", "s3"), (7, "ONE two", "en", "s3"), (None, " ".join(a), "en", "s1"), (3, " ".join(words(2, 60)), "de", None), (9, "é🏽▁ x\n" * 3000, "fr", "s2")]
    return spark.createDataFrame([(*r, 1) for r in rows], DOCS).selectExpr("*", "1 AS key", "2 AS n", "3 AS size", "4 AS comp", "5 AS place")


def test_jaccard(docs, spark):
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_shingles, r.component_id) for r in jaccard.similar_components(docs).collect())
    assert got == [(-1, 56, 0), (0, 56, 0), (1, 56, 0), (2, 56, 0), (3, 56, 3), (3, 56, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 6), (9, 2, 9)]
    assert jaccard.similar_components(docs.limit(0)).count() == 0


def test_jaccard_chain_against_brute_force(spark):
    base, rows = words(3, 80), []
    for i in range(30):
        t = list(base)
        for j in range(i % 7):
            t[(11 * i + 13 * j) % 80] = f"w{i}x{j}"
        rows.append((i, " ".join(t), "en", "s", 1))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(76)} for i, t, *_ in rows}
    parent = {i: i for i in sets}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for i in sets:
        for j in sets:
            if i < j and 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {r.doc_id: r.component_id for r in jaccard.similar_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: find(i) for i in sets}


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(r.taken <= 3 * r.size and r.target <= 3 * r.source_size for r in rows)
    targets = {r.source: r.target for r in rows}
    assert abs(sum(targets.values()) - sum(r.size for r in rows)) < 1e-6
    assert rows == mixing.mix(docs).collect() and mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mixed(docs).columns == docs.columns


def test_url_filter(spark):
    day = dt.date
    entries = spark.createDataFrame([("l", "bad.com", day(2024, 1, 1), "add"), ("l", "bad.com", day(2024, 2, 1), "drop"), ("m", "x.bad.com", None, "add")], "list string, domain string, effective date, action string")
    caps = [("http://a.BAD.com:80/x", day(2024, 1, 1)), ("http://bad.com", day(2024, 2, 1)), ("https://u@x.bad.com./", None), ("notbad.com", day(2024, 1, 2)), (None, None), ("http://notbad.com", day(2024, 1, 2))]
    got = [r.lists for r in urlfilter.filter_urls(spark.createDataFrame(caps, "url string, fetched date"), entries).collect()]
    assert sorted(got) == ["", "", "", "", "l", "m"]


@pytest.mark.parametrize("text", [None, "", "a", "x" * 64, "é" * 70_000])
def test_ogg_round_trip(text):
    media = ogg.store(text)
    data, n, streams = ogg.restore(media)
    assert (data, n) == ogg.payload(text) and len(streams) == 2
    for at in (5, 30, len(media) - 1):
        broken = media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :]
        with pytest.raises(ogg.OggError):
            ogg.demux(broken)


def test_ogg_checksum():
    crc = 0
    for byte in b"OggS and more":
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    assert ogg.checksum(b"OggS and more") == crc


def test_sentencepiece(docs):
    model = sentencepiece_codec.load()
    rows = sentencepiece_codec.encode(docs, model).collect()
    assert all(r.round_trip for r in rows) and any(r.ids is None for r in rows)
    scores = dict(zip(model.hashes.tolist(), model.scores.tolist()))
    for w in (" the", " Erthen", "unbelievable", " ünïcode"):
        best = [0.0] + [-np.inf] * len(w)
        for i in range(1, len(w) + 1):
            for j in range(max(0, i - model.longest), i):
                s = scores.get(int(sentencepiece_codec._hash(w[j:i])), model.unknown if i - j == 1 else -np.inf)
                best[i] = max(best[i], best[j] + s)
        ids = np.frombuffer(sentencepiece_codec.segment(model, [w])[w], dtype=np.int32)
        value = dict(zip(model.ids.tolist(), model.scores.tolist()))
        lost = sum(c not in {p for p in model.pieces if p} for c in w)
        assert sum(value.get(i, 0.0) for i in ids.tolist()) + lost * model.unknown == pytest.approx(best[-1])


def test_secrets(docs):
    forest = secrets.train()
    text = 'so token = "5aad00685accefdd91653537b82ad0dab34e35e3" and 7086638319846192 end'
    (found,) = secrets.scan_texts(forest, [text], [None])
    assert [p >= 0.5 for *_, p in found] == [True, False]
    assert secrets.redact_text(text, found) == 'so token = "<SECRET>" and 7086638319846192 end'
    assert secrets.redact(docs, forest).columns == docs.columns and secrets.scan(docs, forest).count() == docs.count()


def test_language(spark):
    rows = [(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de", "s", 1) for i in range(40)] + [(99, "123", "en", "s", 1), (98, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, langid.train(df)).collect()}
    assert got[99] == got[98] == "und" and all(got[i] == ("en" if i % 2 else "de") for i in range(40))
    assert {r.lang_pred for r in langid.identify(df, langid.train(df.limit(0))).collect()} == {"und"}


def test_toxicity(spark):
    assert toxicity.fold("Ѕtup1d ｉｄｉｏｔ 12:30") == ["stupid", "idiot"]
    rows = [(i, f"alpha beta {'moronic' if i % 3 == 0 else 'gentle'} gamma", "en", "s", 1) for i in range(300)]
    df = spark.createDataFrame([*rows, (999, None, None, None, None)], DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(df, toxicity.learn(df, labels)).collect()}
    assert all((got[i] >= 0.5) == (i % 3 == 0) for i in range(300)) and got[999] < 0.5
    assert {r.score for r in toxicity.score(df, toxicity.learn(df, labels.limit(0))).collect()} == {0.0}


def test_folding_of_substitutions_at_either_end():
    assert toxicity.fold("1d10t w0rthl355 7r45h a$$ !d10t |oser 8ad") == ["idiot", "worthless", "trash", "ass", "idiot", "loser", "bad"]
    assert toxicity.fold("idiot! |cell| 100 12:30 $5 covid19 !!!") == ["idiot", "cell", "covid"]


def test_quality(docs, spark):
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, labels).count() == docs.count()
    assert quality.keep_good(docs, labels.limit(0)).count() == docs.count()


def test_quality_knows_every_word(spark):
    """More words than any fixed vocabulary held: documents of known rare words must cost less than those of unknown ones."""
    known = [f"w{i}" for i in range(12_000)]
    rows = [(i, " ".join(known[40 * i : 40 * i + 40]), "en", "s", 1) for i in range(300)]
    rows += [(1000 + i, " ".join(known[40 * i + k] for k in (3, 1, 4, 15, 9, 2, 6, 5)), "en", "s", 1) for i in range(300)]
    rows += [(2000 + i, " ".join(f"x{40 * i + k}" for k in (3, 1, 4, 15, 9, 2, 6, 5)), "en", "s", 1) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    bits = {r.doc_id: r.bits for r in quality.classify(df, labels).collect()}
    trained = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5]
    assert max(bits[1000 + i] for i in trained) < min(bits[2000 + i] for i in range(300))


def test_quality_counts_against_brute_force(spark):
    """Bits of every document by the same model counted in plain dictionaries."""
    r = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{int(x)}" for x in r.zipf(1.4, 30) % 500), "en", "s", 1) for i in range(200)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    got = {g.doc_id: g.bits for g in quality.classify(spark.createDataFrame(rows, DOCS), labels).collect()}
    pairs = Counter(p for i, t, *_ in rows if i < 150 and zlib.crc32(str(i).encode()) % 5 for p in zip(["", *t.split()], t.split()))
    before, total = Counter(w for _, w in pairs), Counter()
    for (u, _), n in pairs.items():
        total[u] += n
    d, e = quality._discounts(Counter(pairs.values())), quality._discounts(Counter(before.values()))
    unseen = sum(e[min(n, 3)] for n in before.values()) / len(pairs) / (len(before) + 1)
    left = Counter()
    for (u, _), n in pairs.items():
        left[u] += d[min(n, 3)]
    for i, t, *_ in rows:
        bits = []
        for u, w in zip(["", *t.split()], t.split()):
            low = (before[w] - e[min(before[w], 3)]) / len(pairs) + unseen
            bits.append(-np.log2((pairs[u, w] - d[min(pairs[u, w], 3)] + left[u] * low) / total[u] if total[u] else low))
        assert got[i] == pytest.approx(np.mean(bits))


def test_neighbours(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(120, 8)).round(3)
    x[7] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8), (203, [None] * 8), (204, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for g in neighbours.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(g.query_id, []).append((g.rank, g.vec_id))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 50, 100):
        s = u @ u[q]
        s[q] = -9
        assert [v for _, v in sorted(got[q])] == np.lexsort((np.arange(120), -s))[:5].tolist()
    assert set(got) == {0, 50, 100}


def recall(got, x, queries, k=5):
    """Share of the k nearest by brute force that are among the found (query_id, vec_id)."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in queries:
        s = u @ u[q]
        s[q] = -9
        hits += len({(q, int(i)) for i in np.argsort(-s)[:k]} & got)
    return hits / (k * len(queries))


def test_neighbours_rounds_and_beam_follow_the_table(spark, monkeypatch):
    """From small blocks and a narrow first beam, lists and search must still become good."""
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "BEAM", 10)
    x = np.random.default_rng(8).normal(size=(4000, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    nodes = neighbours._nodes(neighbours._valid(df, "vec_id", "embedding").drop("dim"))[0]
    nodes = nodes.persist()
    lists = {(r.node, r.other) for r in neighbours.build(nodes, 4000).collect()}
    nodes.unpersist()
    assert recall(lists, x, range(0, 4000, 20)) >= 0.9
    found = neighbours.nearest(df, df.where("vec_id % 100 = 0")).collect()
    assert recall({(r.query_id, r.vec_id) for r in found}, x, range(0, 4000, 100)) >= 0.9


def test_neighbours_rounds_compare_only_what_is_new(spark, monkeypatch):
    """Every round's lists are those of comparing all members of every hub, and later rounds make few rows."""
    n, k = 400, neighbours.K
    x = np.random.default_rng(12).normal(size=(n, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    nodes = neighbours._nodes(neighbours._valid(df, "vec_id", "embedding").drop("dim"))[0].persist()
    codes = neighbours._decoded([r.code for r in nodes.orderBy("node").collect()])
    sims = neighbours._cosines(codes, codes)
    rows, whole = spark.sparkContext.accumulator(0), type(df).mapInPandas

    def counted(self, run, schema):
        def each(batches):
            for b in run(batches):
                rows.add(len(b))
                yield b

        return whole(self, each if self.columns == ["m"] else run, schema)

    monkeypatch.setattr(type(df), "mapInPandas", counted)
    first = neighbours._best(neighbours._block_lists(nodes, 1, 8), "node", k)
    edges = common.stored(first.withColumn("new", F.lit(True)).withColumn("met", F.lit(False)), "first")
    lists, made = {}, []
    for r in edges.collect():
        lists.setdefault(r.node, set()).add(r.other)
    for _ in range(6):
        hubs = {h: {h, *own} for h, own in lists.items()}
        for h in range(n):
            hubs[h].update(sorted((i for i in range(n) if h in lists[i]), key=lambda i: (-sims[i, h], i))[: neighbours.REVERSE])
        met = {i: set().union(*(m for m in hubs.values() if i in m)) - {i} for i in range(n)}
        lists = {i: set(sorted(lists[i] | met[i], key=lambda j: (-sims[i, j], j))[:k]) for i in range(n)}
        before = rows.value
        edges = common.stored(neighbours._descend(edges, nodes), "round")
        made.append(rows.value - before)
        got = {}
        for r in edges.collect():
            got.setdefault(r.node, set()).add(r.other)
        assert got == lists
    nodes.unpersist()
    assert made[-1] < made[0] / 4


@pytest.mark.parametrize("spread, n", [(0.004, 1000), (1e-4, 300)])
def test_neighbours_in_tight_clusters(spark, spread, n):
    """Vectors closer to one another than the rounding to 8 bits, the second ones mostly of equal codes."""
    r = np.random.default_rng(9)
    centre = r.normal(size=64)
    x = centre / np.linalg.norm(centre) + r.normal(size=(n, 64)) * spread
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = neighbours.nearest(df, df.where("vec_id % 25 = 0")).collect()
    assert recall({(g.query_id, g.vec_id) for g in found}, x, range(0, n, 25)) >= 0.99


def test_quality_finds_distinct_pairs_by_sorting():
    """The requests of a chunk are those of numpy's unique, which puts them in a hash table and takes 60 times as long as a sort."""
    r = np.random.default_rng(5)
    distinct, tokens = np.unique(r.integers(1, 1 << 64, 200_000, dtype=np.uint64)), r.integers(0, 190_000, 1 << 20).astype(np.uint32)
    sizes = np.array([0, 5, 0, len(tokens) - 5], dtype=np.int64)
    row = {"words": quality._pack_keys(distinct), "tokens": quality._pack_planes(tokens), "sizes": sizes.tobytes(), "answers": []}
    before, pairs = quality._pairs(distinct[tokens] >> np.uint64(18), sizes, 46)

    def cpu(run):
        began = time.process_time()
        run()
        return time.process_time() - began

    ask = lambda: quality._asked(row, 46, "pairs", 0, 1 << 46)
    assert min(cpu(ask) for _ in range(3)) < 0.5 * min(cpu(lambda: np.unique(pairs)) for _ in range(3))
    assert (ask() == np.unique(pairs)).all()
    row["answers"] = [{"what": "pairs", "shard": 0, "values": quality._pack(np.zeros((1, len(ask())), dtype=np.int64))}]
    c = quality._Chunk(row, quality.Layout(46, 1))
    met, first, where = np.unique(pairs, return_index=True, return_inverse=True)
    assert (c.where == where).all() and (c.words[c.before] == before[first]).all() and (c.words[c.after] == (distinct[tokens] >> np.uint64(18))[first]).all()


def test_quality_moves_no_texts(spark, monkeypatch):
    made = []
    monkeypatch.setattr(common, "MAX_BROADCAST", 0)  # as with very many trusted documents
    monkeypatch.setattr(quality, "bucketed", lambda df, *a: made.append(df) or common.bucketed(df, *a))
    docs = spark.createDataFrame([(i, "a b c d e f" if i % 2 else "x y z", "en", "s", 0) for i in range(40)], DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 40 and all(r.bits is not None for r in rows)
    assert "Exchange" not in made[0]._jdf.queryExecution().executedPlan().toString()


def test_quality_has_executors_collect_garbage(spark, monkeypatch):
    """Beside the driver's own collections, which the same process does here, tasks collect garbage where the executors are."""
    for module in (common, quality):
        monkeypatch.setattr(module, "collect_garbage", lambda spark: None, raising=False)
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if b.getName() in ("G1 Old Generation", "MarkSweepCompact", "PS MarkSweep"))
    docs = spark.createDataFrame([(i, "a b c d e f" if i % 2 else "x y z", "en", "s", 0) for i in range(40)], DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    before = full()
    assert quality.classify(docs, labels).count() == 40
    assert full() >= before + 10


def test_stored_leaves_no_shuffle_files(spark):
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: {f for top in manager.localDirsString() for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}
    before = files()
    back = common.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "few")
    for _ in range(50):  # Spark deletes them in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert back.count() == 7
    common.release(back)


def test_near_copies_stay_without_moving_texts(spark, monkeypatch):
    """The rows that go are broadcast by their measured size, also where Spark's own estimate of it would shuffle all texts."""
    monkeypatch.setattr(common, "MAX_BROADCAST", 1 << 20)
    docs = spark.createDataFrame([(i, " ".join(words(i // 2, 30)), "en", "s", 0) for i in range(40)], DOCS)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = jaccard.one_of_each(docs)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 40, 2))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_shared_shingles_are_found_in_parts(spark, monkeypatch):
    """No write of shared shingles moves the shingles of all prefixes at once, and the lists are the same in any number of parts."""
    rows = spark.createDataFrame([(i, " ".join([*words(i // 4, 40), f"w{i}", *words(90, 12)])) for i in range(60)], "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    found, sizes = [], {}
    for n in (1, 3):
        sizes[n] = []
        monkeypatch.setattr(jaccard, "PASSES", n, raising=False)
        monkeypatch.setattr(jaccard, "stored", lambda df, name, own=sizes[n]: (own.append(df.count()) if name == "shared" else None) or common.stored(df, name))
        posts, _ = jaccard._postings(rows)
        found.append(sorted(tuple(r) for r in posts.collect()))
    assert found[0] == found[1] and len(found[0]) > 0
    assert len(sizes[3]) == 3 and sum(sizes[3]) == sizes[1][0] and max(sizes[3]) < 0.6 * sizes[1][0]


def test_last_round_drops_pairs_that_sketches_tell_apart(spark, monkeypatch):
    """A family below the threshold: 60 sets of 400 words , most pairs of which are far below it."""
    rng, met = np.random.default_rng(5), []
    base = [f"w{i}" for i in range(400)]
    texts = []
    for k in range(60):
        words, at = list(base), int(rng.integers(0, 380))
        for i in range(16):
            words[(at + 23 * i) % 400] = f"v{k}x{i}"
        texts.append(" ".join(words))
    sets = [set(s.tolist()) for s in jaccard.shingle_sets(texts)]
    flips = lambda a, b: bin(int.from_bytes(jaccard._sketch(a), "big") ^ int.from_bytes(jaccard._sketch(b), "big")).count("1")
    arrays = [np.array(sorted(s), dtype=np.uint64) for s in sets]
    assert all(flips(arrays[0], b) <= len(sets[0] ^ t) for b, t in zip(arrays, sets))
    monkeypatch.setattr(jaccard, "_met", lambda *a, f=jaccard._met: met.append((out := f(*a)).count()) or out)
    monkeypatch.setattr(jaccard, "SETTLED", 2.0)  # one round of single comparisons
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.component_id for r in jaccard.similar_components(docs).collect()}
    parent = list(range(60))
    for i in range(60):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = parent[i], parent[j]
                parent = [min(a, b) if c in (a, b) else c for c in parent]
    assert got == dict(enumerate(parent))
    far = sum(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) < 0.6 for i in range(60) for j in range(i))
    assert far > 1000 and met[0] < 60 * 59 / 2 - far


def test_few_queries_are_searched_once(spark, monkeypatch):
    """More than are checked, and a beam that is wide enough: the checked ones are not searched a second time."""
    searches, search = [], neighbours._search
    monkeypatch.setattr(neighbours, "CHECKED", 10)
    monkeypatch.setattr(neighbours, "_search", lambda queries, *a: searches.append(queries.count()) or search(queries, *a))
    x = np.random.default_rng(3).normal(size=(600, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for together in (800, 5):
        searches.clear()
        monkeypatch.setattr(neighbours, "TOGETHER", together)
        found = neighbours.nearest(df, df.where("vec_id % 20 = 0")).collect()
        assert recall({(g.query_id, g.vec_id) for g in found}, x, range(0, 600, 20)) >= 0.99
        assert sum(searches) == 30


@pytest.mark.parametrize("kind", ["float", "double"])
def test_neighbours_graph_is_bounded_and_holds_every_vector(spark, monkeypatch, kind):
    """Most vectors are no nodes of the graph but are searched; queries go in chunks; near and equal copies keep their order."""
    sizes, build = [], neighbours.build
    monkeypatch.setattr(neighbours, "PIVOTS", 200, raising=False)
    monkeypatch.setattr(neighbours, "BEAM", 20)
    monkeypatch.setattr(neighbours, "MAX_BROADCAST", 2000, raising=False)
    monkeypatch.setattr(neighbours, "build", lambda nodes, n: sizes.append(n) or build(nodes, n))
    r = np.random.default_rng(21)
    x = r.normal(size=(2500, 16)).astype(np.float32 if kind == "float" else np.float64)
    x[100:160] = x[100] + r.normal(size=(60, 16)) * 1e-4
    x[200:230] = x[200]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>").repartition(3)
    found = neighbours.nearest(df, df.where("vec_id % 50 = 0")).collect()
    assert len(found) == 250 and sizes == [200]
    assert recall({(g.query_id, g.vec_id) for g in found}, x.astype(np.float64), range(0, 2500, 50)) >= 0.9
    got = {(g.query_id, g["rank"]): g for g in found}
    assert [got[200, i].vec_id for i in range(1, 6)] == [201, 202, 203, 204, 205]
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    for q in range(0, 2500, 50):
        own = [got[q, i] for i in range(1, 6)]
        assert all(abs(g.score - u[q] @ u[g.vec_id]) < 1e-12 for g in own) and own == sorted(own, key=lambda g: (-g.score, g.vec_id))
    s = u @ u[100]
    s[100] = -9
    assert [got[100, i].vec_id for i in range(1, 6)] == np.argsort(-s, kind="stable")[:5].tolist()
