import re
from collections import Counter

import corpus_pipeline
import duckdb
import pandas as pd
from cellatlas.llm import mixing, secrets, sentencepiece_codec

SF = "/root/testdata/sf0.001"


def shingles(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def one_of_each(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) > 0:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i for i in sets if find(i) == i}


def test_run_against_brute_force(spark, monkeypatch):
    """Every stage of run() on what the one before kept; of the first, only that it keeps rows as they are, most of them good."""
    came = []

    def noted(f):
        def stage(spark, docs, sf_dir):
            came.append([tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()])
            return f(spark, docs, sf_dir)

        return stage

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, noted(f)) for n, f in corpus_pipeline.STAGES])
    out = corpus_pipeline.run(spark, SF).select("doc_id", "ids", "n_tokens", "round_trip").collect()
    start, good, single, clean, mix = came

    quality = dict(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect())
    assert not Counter(good) - Counter(start)
    kept = {r[0] for r in good}
    assert sum(i in kept for i in quality if quality[i] == 1) >= 0.95 * sum(v == 1 for v in quality.values())

    left = one_of_each({r[0]: r[1] for r in good})
    assert Counter(single) == Counter(r for r in good if r[0] in left)

    forest = secrets.train()
    found = secrets.scan_texts(forest, [r[1] for r in single], [r[3] for r in single])
    assert Counter(clean) == Counter((r[0], secrets.redact_text(r[1], f), *r[2:]) for r, f in zip(single, found))

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(clean, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    times = dict(con.sql(f"SELECT doc_id, repetitions FROM ({mixing.ORACLE})").fetchall())
    assert Counter(mix) == Counter({r: times[r[0]] for r in clean if times[r[0]]})

    texts, decoder = dict((r[0], r[1]) for r in mix), sentencepiece_codec.Decoder(sentencepiece_codec.load())
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in mix)
    assert all(r.round_trip and r.n_tokens == len(r.ids or []) and decoder.decode(r.ids or []) == (texts[r.doc_id] or "") for r in out)
