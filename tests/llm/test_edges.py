"""Every operator against a plain version of itself, and on nulls, large and string ids, repeats, long texts, empty tables and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from cellatlas.llm import common, jaccard, langid, mixing, neighbours, ogg, quality, queries, secrets, sentencepiece_codec, toxicity, urlfilter

SF = "/root/testdata/sf0.001"
BIG = [2**60 + 1, None, 2**60 + 3, 7, 7]
TEXTS = ["the cat sat on the mat with a hat and a bat", None, "the cat sat on the mat with a hat and a rat", "", 'key = "5aad00685accefdd91653537b82ad0dab34e35e3" ' + "x y z " * 40_000]
CLASH = "1 AS `h`, 2 AS n, 3 AS size, 4 AS comp, 5 AS place, 6 AS trust, 7 AS letters, 8 AS path, 9 AS findings, 10 AS ids, 11 AS media, 12 AS score, 13 AS times, 14 AS key, 15 AS `a.b`, 16 AS kept"


def odd(spark, ids, kind):
    rows = [(i, t, "en" if k % 2 else None, "s" if k else None) for k, (i, t) in enumerate(zip(ids, TEXTS))]
    return spark.createDataFrame(rows, f"doc_id {kind}, text string, lang string, source string").selectExpr("*", *CLASH.split(", "))


def run_all(spark, docs, kind):
    """Each operator's result over the documents, by name."""
    labels = spark.createDataFrame([(None if i is None else str(i), 1, k % 2) for k, i in enumerate([2**60 + 3, 7, None, 5])], "doc_id string, quality int, toxic int")
    labels = labels.selectExpr(f"CAST(doc_id AS {kind}) AS doc_id", "quality", "toxic")
    forest, pieces = secrets.train(secrets.generated_findings(200)), sentencepiece_codec.load()
    yield "quality", quality.classify(docs, labels)
    yield "toxicity", toxicity.score(docs, toxicity.learn(docs, labels))
    yield "secrets", secrets.scan(docs, forest, path_col="source")
    yield "jaccard", jaccard.similar_components(docs)
    yield "language", langid.identify(docs, langid.train(docs))
    yield "media", ogg.probe(ogg.media(docs))
    yield "mixing", mixing.mix(docs)
    yield "pieces", sentencepiece_codec.encode(docs, pieces)
    for name, kept in (("good", quality.keep_good(docs, labels)), ("one", jaccard.one_of_each(docs)), ("redacted", secrets.redact(docs, forest)), ("mixed", mixing.mixed(docs))):
        assert kept.columns == docs.columns, name
        yield name, kept


@pytest.mark.parametrize("kind", ["long", "string"])
def test_ids_come_out_unchanged(spark, kind):
    ids = [None if i is None else i if kind == "long" else f"id-{i}" for i in BIG]
    docs = odd(spark, ids, kind)
    for name, found in run_all(spark, docs, kind):
        got = Counter(r.doc_id for r in found.select("doc_id").collect())
        if name not in ("mixed", "one"):
            assert got == Counter(ids), name
        assert set(got) <= set(ids), name


def test_empty_tables(spark):
    docs = odd(spark, BIG, "long").limit(0)
    for name, found in run_all(spark, docs, "long"):
        assert found.count() == 0, name
    pages = spark.createDataFrame([], "url string, fetched date")
    assert urlfilter.filter_urls(pages, urlfilter.entries_frame(spark)).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert neighbours.nearest(vectors, vectors).count() == 0


def plain_sets(texts):
    def of(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    return {k: of(t) for k, t in texts.items()}


def plain_components(sets):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    items = sorted(sets)
    for a, i in enumerate(items):
        for j in items[a + 1 :]:
            n, m = len(sets[i]), len(sets[j])
            if n and m and 100 * min(n, m) >= 75 * max(n, m):
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (n + m - both):
                    x, y = sorted((find(i), find(j)))
                    parent[y] = x
    return {i: find(i) for i in sets}


def family(seed, n, words, changes, name):
    """Copies of one text, each with so many words changed: most are near the threshold to one another."""
    r = random.Random(seed)
    base = [f"{name}{r.randrange(10**6)}" for _ in range(words)]
    for i in range(n):
        t = list(base)
        for _ in range(r.randint(0, changes)):
            t[r.randrange(words)] = f"{name}x{r.randrange(10**9)}"
        yield " ".join(t)


def test_large_families_and_chains_against_all_pairs(spark):
    """500 near copies, three chains, a passage that unlike documents share, equal prefixes of unlike texts, small texts."""
    r, texts = random.Random(1), list(family(2, 500, 120, 5, "f"))
    for c in range(3):
        t = [f"c{c}w{i}" for i in range(100)]
        for step in range(40):
            t = list(t)
            t[(7 * step) % 100] = f"c{c}s{step}"
            texts.append(" ".join(t))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{' '.join(f'u{i}k{k}' for k in range(r.choice((2, 5, 9, 20, 40))))} {passage}" for i in range(60)]
    texts += [f"a{i % 9} b c d" for i in range(30)] + ["", "one", "ONE", " two\x0bwords ", "two words"]
    r.shuffle(texts)
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = plain_sets(dict(rows))
    want = plain_components(sets)
    got = {g.doc_id: (g.n_shingles, g.component_id) for g in jaccard.similar_components(docs).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_members_beyond_their_groups_keys_are_compared(spark, monkeypatch):
    """Groups whose keys are unlike although members of them are alike must still be joined."""
    members = spark.createDataFrame([(1, 1, 100, 100), (2, 1, 100, 86), (5, 5, 100, 100), (6, 5, 100, 90)], "key long, grp long, n long, common long")
    tested = spark.createDataFrame([(1, 5, 100, 100, 1, 5, 80), (1, 9, 100, 100, 1, 9, 20)], "x long, p long, n long, m long, comp long, comp2 long, common long")
    merged = spark.createDataFrame([], "node long, label long")
    got = {(r.x, r.p) for r in jaccard._expanded([tested], merged, spark.createDataFrame([*members.collect(), (9, 9, 100, 100)], members.schema)).collect()}
    assert got == {(1, 6), (2, 5), (2, 6)}  # the first pair has room, the second has none


def test_one_row_of_each_component_stays(spark):
    a, b = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(1, a, 1), (1, a, 2), (2, a, 3), (None, b, 4), (None, b, 5), (5, "", 6), (5, "", 7), (6, None, 8), (1, b + " u", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int").selectExpr("*", *CLASH.split(", "))
    got = sorted((r.doc_id or 0, r.text or "", r.k) for r in jaccard.one_of_each(docs).collect())
    assert got == [(0, "", 0)][:0] + [(1, a, 1), (1, b + " u", 9), (5, "", 6), (5, "", 7), (6, "", 8)]


def test_lexicon_hits_against_a_search_word_by_word():
    r = random.Random(4)
    stems = ["moro", "idio", "trash", "stupid"]
    terms = {f" {s}": 2.0 + i for i, s in enumerate(stems)} | {" ass ": 1.7, " moron ": 9.0}
    phrases = {" trash can ": 0.0, " the ass ": 0.0}
    found = toxicity.automaton(terms, phrases)
    vocabulary = ["moron", "moronic", "idiot", "trash", "can", "the", "ass", "assess", "kind", "stupidly", "words"]
    for _ in range(300):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 12))]
        want = 0.0
        for i, w in enumerate(words):
            best = max([v for t, v in terms.items() if (t.endswith(" ") and t.strip() == w) or (not t.endswith(" ") and w.startswith(t.strip()))], default=0.0)
            pairs = {f" {words[k]} {words[k + 1]} " for k in (i - 1, i) if 0 <= k < len(words) - 1}
            want += 0.0 if pairs & set(phrases) else best
        assert toxicity.hits(found, words)[0] == pytest.approx(want)


def test_language_against_naive_counts(spark):
    rows = [(i, t, lang, "s", 1) for i, (t, lang) in enumerate([("der Hund und die Katze", "de"), ("the dog and the cat", "en"), ("le chien et le chat", "fr")] * 30)]
    rows += [(900, "Katze the", "en", "s", 1), (901, "x" * 600_000 + " und die Katze", None, None, 1), (902, "?!", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long")

    def grams(t):
        padded = f" {t.lower()} "
        return [padded[i : i + o] for o in (1, 2, 3) for i in range(len(padded) + 1 - o)]

    seen, n = {}, Counter()
    for i, t, lang, *_ in rows:
        if zlib.crc32(str(i).encode()) % 5 and lang:
            seen.setdefault(lang, Counter()).update(grams(t))
            n[lang] += 1
    buckets = {g: int(langid.ngrams(np.array([ord(c) for c in g], dtype=np.uint64), len(g))[0]) for c in seen.values() for g in c} | {g: int(langid.ngrams(np.array([ord(c) for c in g], dtype=np.uint64), len(g))[0]) for _, t, *_ in rows for g in set(grams(t))}
    counts = {lang: Counter() for lang in seen}
    for lang, c in seen.items():
        for g, k in c.items():
            counts[lang][buckets[g]] += k
    total = {lang: sum(c.values()) + langid.SMOOTHING * langid.BUCKETS for lang, c in counts.items()}
    got = {r.doc_id: r for r in langid.identify(docs, langid.train(docs)).collect()}
    for i, t, *_ in rows:
        if i == 902:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        own = Counter(buckets[g] for g in grams(t))
        sums = {lang: math.log((n[lang] + 1) / (sum(n.values()) + len(n))) + sum(k * math.log((counts[lang][b] + langid.SMOOTHING) / total[lang]) for b, k in own.items()) for lang in counts}
        best = min(sums, key=lambda x: (-sums[x], x))
        assert got[i].lang_pred == best and got[i].score == pytest.approx(1 / sum(math.exp(v - sums[best]) for v in sums.values()), rel=1e-3)


def test_media_of_every_document(spark):
    docs = odd(spark, BIG, "long")
    want = Counter()
    for i, t in zip(BIG, TEXTS):
        raw = (t or "").encode()
        full = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
        want[i, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])] += 1
    stored = ogg.media(docs)
    rows = ogg.probe(stored).collect()
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want and all(r.error is None for r in rows)
    sizes = Counter((r.doc_id, len(r.media), hashlib.sha256(r.media).hexdigest()) for r in stored.collect())
    assert sizes == Counter((r.doc_id, r.media_bytes, r.media_sha256) for r in rows)
    broken = spark.createDataFrame([(1, b"OggS"), (2, None)], "doc_id long, media binary")
    assert [bool(r.error) for r in ogg.probe(broken).collect()] == [True, True]


def test_secrets_are_judged_by_their_whole_value(spark):
    forest = secrets.train()
    text = 'so token = "5aad00685accefdd91653537b82ad0dab34e35e3", postgres://bob:Xk9!vQ2zT7@db/x and 7086638319846192 end'
    found = secrets.scan_texts(forest, [text, None, ""], ["conf/.env", None, None])
    assert [text[s:e] for s, e, _ in found[0]] == ["5aad00685accefdd91653537b82ad0dab34e35e3", "Xk9!vQ2zT7", "7086638319846192"] and found[1:] == [[], []]
    assert secrets._coverage("ab" * 5000 + "password" * 2500, forest.words) == pytest.approx(20000 / 30000, abs=0.02)
    index = 11  # the feature that says that a value is all hexadecimal
    assert secrets.features("ab12" * 100, "", "", None, forest.transitions, forest.words)[index + 1] == 1.0
    assert secrets.features("ab12" * 100 + "g", "", "", None, forest.transitions, forest.words)[index + 1] == 0.0
    fresh = secrets.generated_findings(1500, seed=77)
    X = np.array([secrets.features(v, b, a, p, forest.transitions, forest.words) for v, b, a, p, _ in fresh])
    assert ((secrets.judge(forest, X) >= 0.5) == np.array([f[-1] for f in fresh])).mean() >= 0.98
    docs = odd(spark, BIG, "long")
    rows = {(r.doc_id, len(r.findings)) for r in secrets.scan(docs, forest).collect()}
    assert (7, 1) in rows and (None, 0) in rows


@pytest.fixture(scope="module")
def unigram():
    """The operator's pieces and scores as a unigram model of the library."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model, proto = sentencepiece_codec.load(), sentencepiece_model_pb2.ModelProto()
    with open(sentencepiece_codec.MODEL_PATH, "rb") as f:
        proto.ParseFromString(f.read())
    for i, s in zip(model.ids.tolist(), model.scores.tolist()):
        proto.pieces[i].score = s
    proto.trainer_spec.model_type = 1
    return model, sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def test_pieces_are_those_of_the_library(unigram):
    """On the texts of a whole table; where the library's 32-bit sums choose otherwise, the sums must be equal but for rounding."""
    model, library = unigram
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    score = dict(zip(model.ids.tolist(), model.scores.tolist()))
    ours, theirs = sentencepiece_codec.Encoder(model).encode(texts), library.encode(texts)
    differ = [(a.tolist(), b) for a, b in zip(ours, theirs) if a.tolist() != b]
    assert len(differ) <= 0.03 * len(texts)
    for a, b in differ:
        assert len(a) == len(b) and sum(score.get(i, 0) for i in a) >= sum(score.get(i, 0) for i in b) - 1e-6


def test_pieces_of_long_words_and_decoding(spark, unigram):
    model, _ = unigram
    long = "".join(random.Random(3).choice("abcdeéß中文") for _ in range(60_000))
    docs = spark.createDataFrame([(2**60 + 1, long), (None, None), (3, ""), (4, "▁ a\n\n  b▁")], "doc_id long, text string")
    tokens = sentencepiece_codec.encode(docs, model)
    assert all(r.round_trip for r in tokens.collect())
    assert {(r.doc_id, r.text) for r in sentencepiece_codec.decode(tokens, model).collect()} == {(2**60 + 1, long), (None, None), (3, ""), (4, "▁ a\n\n  b▁")}
    word = long[:3000].replace("中", "c").replace("文", "d")
    whole = np.frombuffer(sentencepiece_codec.segment(model, [word])[word], dtype=np.int32)
    small = sentencepiece_codec._BLOCK
    try:
        sentencepiece_codec._BLOCK = 100
        assert (np.frombuffer(sentencepiece_codec.segment(model, [word])[word], dtype=np.int32) == whole).all()
    finally:
        sentencepiece_codec._BLOCK = small
    cut = np.concatenate([np.frombuffer(sentencepiece_codec.segment(model, [p])[p], dtype=np.int32) for p in sentencepiece_codec._cut(model, word)])
    assert (cut == whole).all()


@pytest.mark.parametrize("rows", [
    [(1, "a b c d", "x")] * 100 + [(2, "e f", "y"), (3, "g", "z")],
    [(i, "", "x") for i in range(20)] + [(99, "a b", "x"), (100, "c d e f g h", "y")] + [(7, None, None)] * 3,
    [(i, "a " * (i % 7), "x") for i in range(50)] + [(None, "q r s", "x")] * 5,
])
def test_mixing_of_repeated_rows_against_sql(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", *CLASH.split(", "))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    want = con.sql(f"SELECT doc_id, source, size, source_size, weight, target, repetitions, taken FROM ({mixing.ORACLE})").fetchall()
    got = [tuple(r) for r in mixing.mix(docs).select("doc_id", "source", "size", "source_size", "weight", "target", "repetitions", "taken").collect()]
    assert Counter(got) == Counter(want)
    largest = {s: max(len((t or "").split()) for _, t, x in rows if x == s) for *_, s in rows}
    for s in largest:
        assert abs(sum(r[7] for r in got if r[1] == s) - next(r[5] for r in got if r[1] == s)) <= largest[s]
    times = Counter()
    for r in got:
        times[r[0]] += r[6]
    assert Counter(r.doc_id for r in mixing.mixed(docs).collect()) == +times


@pytest.mark.parametrize("clusters, size", [(60, 50), (20, 150)])
def test_recall_in_many_tight_clusters(spark, clusters, size):
    r = np.random.default_rng(clusters)
    x = np.repeat(r.normal(size=(clusters, 64)), size, axis=0) + r.normal(size=(clusters * size, 64)) * 0.02
    ids = r.permutation(clusters * size)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = {(g.query_id, g.vec_id) for g in neighbours.nearest(df, df.where("vec_id % 50 = 0")).collect()}
    u, hits, asked = x / np.linalg.norm(x, axis=1, keepdims=True), 0, 0
    for k in np.flatnonzero(ids % 50 == 0):
        s = u @ u[k]
        s[k] = -9
        hits += len({(int(ids[k]), int(ids[j])) for j in np.argsort(-s)[:5]} & got)
        asked += 5
    assert hits >= 0.9 * asked


def test_descent_runs_at_every_size_and_each_length_is_searched(spark, monkeypatch):
    rounds = []
    descend = neighbours._descend
    monkeypatch.setattr(neighbours, "_descend", lambda *a: rounds.append(1) or descend(*a))
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=8).tolist()) for i in range(60)] + [(100 + i, r.normal(size=3).tolist()) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, df.where("vec_id % 50 = 0")).collect()
    assert len(rounds) >= 2 and {g.vec_id for g in got if g.query_id == 100} == {101, 102, 103}


def test_a_run_deletes_only_its_own_tables(spark):
    before = common.scratch_paths()
    mix = queries.op8_mixing(spark, SF)
    own = common.scratch_paths() - before
    rows = corpus_pipeline.run(spark, SF)
    left = common.scratch_paths() - before - own
    assert len(left) == 1 and mix.count() == 200 and rows.count() > 0


def test_quality_limits_and_held_out_rows(spark):
    """The perplexity is two to the bits, and no held-out document is learned from."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).toPandas()
    some = rows[rows.bits.notna()]
    assert np.allclose(some.perplexity, 2**some.bits) and (some.perplexity > 1).all()
    assert (some.kept == (some.bits - some.allowance <= some.limit)).all() and rows[rows.bits.isna()].kept.all()
    held = [i for i in rows.doc_id if zlib.crc32(str(i).encode()) % 5 == 0]
    changed = labels.where(f"doc_id NOT IN ({', '.join(map(str, held))})")
    again = quality.classify(docs, changed).toPandas()
    pd.testing.assert_series_equal(rows.sort_values("doc_id").bits.reset_index(drop=True), again.sort_values("doc_id").bits.reset_index(drop=True))


def test_quality_keeps_texts_without_words_beside_a_model(spark):
    """All columns are read here: a count alone leaves out those whose arithmetic may fail."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    bare = spark.createDataFrame([(10**6, "", "en", "x", 0), (10**6 + 1, None, "en", "x", 0), (10**6 + 2, " \n ", None, None, 3)], docs.schema)
    rows = {r.doc_id: r for r in quality.classify(docs.union(bare), labels).collect()}
    assert len(rows) == docs.count() + 3 and rows[0].bits is not None
    assert all((rows[i].n_words, rows[i].bits, rows[i].allowance, rows[i].kept) == (0, None, None, True) for i in range(10**6, 10**6 + 3))
    good = {r.doc_id: r.text for r in quality.keep_good(docs.union(bare), labels).collect()}
    assert [good[i] for i in range(10**6, 10**6 + 3)] == ["", None, " \n "]
