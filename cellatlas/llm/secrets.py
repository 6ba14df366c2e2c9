"""Secret scans: candidates from patterns, false positives removed by a random forest.

Candidates are long runs of key characters that hold a digit, values assigned to a name such as ``token``, and passwords
in URLs. The forest judges each from its length, character classes and transitions, dictionary coverage, the path of its
document and the neighbouring words. The dictionary is given: by default the word pieces of a public tokenizer's vocabulary. It is trained from labelled findings: (value, before, after, path, is_secret). The default set
is generated from a seed by rules for well-known key formats and for what is commonly mistaken for them; a reviewed set
can be given in its place, of which ``MAX_FINDINGS`` are used (a documented bound).

Scale: training data and forest are of bounded size; the forest is broadcast. Scanning is one pass without a shuffle
over whole texts, and a batch's candidates are judged together in numpy.

Edge cases: a null or empty text has no findings. Overlapping candidates are joined into the longer. Paths may be null.
Equal texts with equal paths have equal findings, and rows that repeat give a row each. Ids of any type come out unchanged. An
empty table gives an empty result. Other columns, of any name, are ignored, or kept by :func:`redact`.
"""

from __future__ import annotations

import base64
import math
import random
import re
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_columns

MAX_FINDINGS = 20_000
TREES, DEPTH, THRESHOLDS = 24, 8, 16
THRESHOLD = 0.5
#: Characters on either side that count as neighbourhood.
NEAR = 48

# Names that secrets are assigned to, words that speak against one, and common words of code and prose.
SECRET_WORDS = "token secret password passwd pwd apikey api_key key auth credential bearer private access".split()
HARMLESS_WORDS = "example sample test dummy placeholder changeme your sha sha256 md5 checksum hash commit digest uuid guid revision etag integrity fixture".split()
DICTIONARY = (
    "about account after also application array base before build cache call case change check class client code column config connect content copy count "
    "create data database date default delete document error event example false field file find first format from function group have header hello here "
    "host http image index info input item json label layer length level library line list load local main make match message method mode model module more "
    "name network node none null number object open option order other output page parameter password path place process project public query read record "
    "release request response result return root sample schema search select server session source start state status stream string style system table test "
    "text that their there this time token true type update user value version view water when where which width window with word work world write your"
).split()

_RUN = re.compile(r"[A-Za-z0-9_+/=\-]{16,}")
_DIGIT = re.compile(r"\d")
_ASSIGNED = re.compile(rf"(?:{'|'.join(sorted(SECRET_WORDS, key=len, reverse=True))})['\"]?[ ]{{0,3}}(?:=>|:=|=|:)[ ]{{0,3}}['\"]?([^\s'\"]{{8,}})", re.IGNORECASE)
_IN_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://[^\s/:@]+:([^\s/@]{3,})@")
_WORDS = re.compile(r"[A-Za-z_]{3,}|\d+")
_SECRET = frozenset(SECRET_WORDS)
_HARMLESS = frozenset(HARMLESS_WORDS)
_HEX = re.compile(r"[0-9a-fA-F]+")
#: The vocabulary file whose word pieces are the default dictionary.
DICTIONARY_PATH = "/opt/tokenizers/piece_bpe_32k.model"
_CLASS = np.zeros(128, dtype=np.int8)
for _c in range(128):
    _CLASS[_c] = 0 if chr(_c).islower() else 1 if chr(_c).isupper() else 2 if chr(_c).isdigit() else 3
_SYMBOLS = 28


class Forest(NamedTuple):
    feature: np.ndarray  # tree x node, -1 at a leaf
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    transitions: np.ndarray  # log-odds of neighbouring symbols, secrets against others
    words: re.Pattern  # the dictionary, longest words first


def find(text: str) -> list[tuple[int, int]]:
    """Spans of candidates in order, overlapping ones joined."""
    spans = [m.span() for m in _RUN.finditer(text) if _DIGIT.search(m[0])]
    spans += [m.span(1) for rule in (_ASSIGNED, _IN_URL) for m in rule.finditer(text)]
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _symbols(value: str) -> np.ndarray:
    """Letters without case 0-25, digits 26, anything else 27."""
    c = np.frombuffer(value.lower().encode("ascii", "replace"), dtype=np.uint8).astype(np.int64)
    return np.where((c >= 97) & (c <= 122), c - 97, np.where((c >= 48) & (c <= 57), 26, 27))


def load_dictionary(path: str = DICTIONARY_PATH) -> list[str]:
    """Words of four letters or more from a vocabulary file: its pieces that begin a word, and the words of ``DICTIONARY``."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    words = {p.piece[1:].lower() for p in proto.pieces if p.piece.startswith("▁")}
    return sorted({w for w in words if len(w) >= 4 and w.isascii() and w.isalpha()} | {w for w in DICTIONARY if len(w) >= 4})


def _pattern(words: list[str]) -> re.Pattern:
    """Matches the longest word at a place, by a tree of the words' letters."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def of(node: dict) -> str:
        ways = [re.escape(c) + of(child) for c, child in sorted(node.items()) if c]
        if not ways:
            return ""
        one = ways[0] if len(ways) == 1 and "" not in node else f"(?:{'|'.join(ways)})"
        return one + "?" * ("" in node)

    return re.compile(of(tree) or r"(?!)")


def _coverage(value: str, words: re.Pattern) -> float:
    """Share of the characters that lie in dictionary words."""
    return sum(m.end() - m.start() for m in words.finditer(value.lower())) / max(len(value), 1)


def features(value: str, before: str, after: str, path: str | None, transitions: np.ndarray, words: re.Pattern) -> list[float]:
    raw = np.frombuffer(value.encode("ascii", "replace"), dtype=np.uint8)
    kinds = _CLASS[np.minimum(raw, 127)]
    n = len(raw)
    share = np.bincount(kinds, minlength=4) / n
    counts = np.bincount(raw, minlength=128)
    p = counts[counts > 0] / n
    changes = np.flatnonzero(np.diff(raw))
    longest = int(np.diff(np.concatenate([[-1], changes, [n - 1]])).max())
    steps = np.abs(np.diff(raw.astype(np.int16)))
    symbols = _symbols(value)
    near = [w.lower() for w in _WORDS.findall(before)[-6:]]
    then = [w.lower() for w in _WORDS.findall(after)[:3]]
    where = (path or "").lower()
    tail = before.rstrip("'\"` ")
    return [
        math.log(n), *share[:4].tolist(), float((np.diff(kinds) != 0).mean()) if n > 1 else 0.0,
        float(transitions[symbols[:-1], symbols[1:]].mean()) if n > 1 else 0.0,
        float(-(p * np.log2(p)).sum()), (counts > 0).sum() / min(n, 64), longest / n, float((steps == 1).mean()) if n > 1 else 0.0,
        _coverage(value, words), float(bool(_HEX.fullmatch(value))), float(value.count("-") == 4 and n == 36),
        float(bool(_SECRET.intersection(near))), float(bool(_SECRET.intersection(near[-1:]))), float(bool(_HARMLESS.intersection(near + then))),
        float(tail[-1:] in "=:" and tail != ""), float(before[-1:] in "'\"`" and before != ""),
        float(any(w in where for w in ("test", "example", "doc", "fixture", "mock"))), float(any(w in where for w in (".env", "config", "secret", ".pem", "deploy"))),
        float(any(w in value.lower() for w in ("example", "xxxx", "your", "changeme", "placeholder"))),
    ]


def generated_findings(n: int = 4000, seed: int = 13) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings from rules: half of them secrets, in the settings in which either kind is met."""
    r = random.Random(seed)
    pick = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda: r.choice(DICTIONARY)
    prose = lambda: " ".join(pick("aeiounrstlhd", r.randint(2, 9)) for _ in range(4))
    out = []
    for i in range(n):
        secret = i % 2
        if secret:
            value = r.choice([
                lambda: pick(hexa, r.choice((24, 32, 40, 40, 48, 64))), lambda: pick(hexa.upper(), r.choice((32, 40, 64))), lambda: pick(alnum, r.randint(20, 64)),
                lambda: pick(alnum + "+/", r.choice((40, 44, 64))) + r.choice(("", "=")), lambda: "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16),
                lambda: "ghp_" + pick(alnum, 36), lambda: "sk-" + pick(alnum, 48), lambda: "xoxb-" + pick("0123456789", 12) + "-" + pick(alnum, 24),
                lambda: base64.b64encode(r.randbytes(r.randint(18, 48))).decode(), lambda: pick(alnum + "!#%&*?", r.randint(8, 16)),
            ])()
            name = r.choice(SECRET_WORDS)
            name = r.choice((name, name.upper(), f"{word()}_{name}", name.title()))
            before = prose() + " " + name + r.choice((' = "', "=", ": ", ' : "', "='", ' => "', ": '", ' "'))
            path = r.choice(("", "", "src/config.py", "deploy/.env", "app/settings.yml"))
        else:
            kind = r.randrange(10)
            before, path = prose() + " ", r.choice(("", "", "docs/guide.md", "tests/test_api.py", "src/main.go"))
            if kind == 0:
                value, before = pick(hexa, r.choice((32, 40, 64))), before + r.choice(HARMLESS_WORDS) + r.choice((" ", ": ", " = ", "="))
            elif kind == 1:
                value = "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))
            elif kind == 2:
                value = r.choice("_-/").join(word() for _ in range(r.randint(3, 6))) + pick("0123456789", r.randint(1, 3))
            elif kind == 3:
                value, before = r.choice(("your", "example", "changeme", "placeholder", "xxxx")) + r.choice("_-") + word() + "_" + word() + pick("0123456789", 2), before + r.choice(SECRET_WORDS) + ' = "'
            elif kind == 4:
                value, before = r.choice("x0a*") * r.randint(16, 40) + "1", before + r.choice(SECRET_WORDS) + "="
            elif kind == 5:
                value = pick("0123456789", r.randint(16, 30))
            elif kind == 6:
                value = "".join(w.title() for w in (word() for _ in range(r.randint(3, 6)))) + pick("0123456789", 2)
            elif kind == 7:
                value, before = "0123456789abcdef"[: r.randint(10, 16)] * 2, before + r.choice(SECRET_WORDS + HARMLESS_WORDS) + "="
            elif kind == 8:  # a word that happens to follow such a name
                value, before = r.choice([w for w in DICTIONARY if len(w) > 6]) + r.choice((",", ".", "", "()", "_" + word())), before + r.choice(SECRET_WORDS) + r.choice((": ", " = ", "="))
                value = value if len(value) >= 8 else value + word()
            else:
                value = "".join(pick("aeiounrstlhd", r.randint(2, 5)) for _ in range(6)) + pick("0123456789", 1)
        out.append((value, before, r.choice(('" ', "' ", " ", "\n")) + prose(), path, secret))
    return out


def _tree(X: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> list[list[float]]:
    """Nodes (feature or -1, threshold, left, right, share of secrets) of one tree on a bootstrap sample."""
    nodes: list[list[float]] = []

    def grow(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, at, at, (y[rows].sum() + 0.5) / (len(rows) + 1)])
        if depth == DEPTH or len(rows) < 8 or y[rows].min() == y[rows].max():
            return at
        best = (0.0, -1, 0.0)
        mean = y[rows].mean()
        for f in rng.choice(X.shape[1], max(2, int(math.sqrt(X.shape[1]))), replace=False):
            x = X[rows, f]
            for t in np.unique(np.quantile(x, np.linspace(0.03, 0.97, THRESHOLDS))):
                low = x <= t
                k = int(low.sum())
                if 0 < k < len(rows):
                    a, b = y[rows][low].mean(), y[rows][~low].mean()
                    gain = mean * (1 - mean) - (k * a * (1 - a) + (len(rows) - k) * b * (1 - b)) / len(rows)
                    if gain > best[0] + 1e-12:
                        best = (gain, f, t)
        if best[1] >= 0:
            low = X[rows, best[1]] <= best[2]
            nodes[at][:2] = best[1:]
            nodes[at][2] = grow(rows[low], depth + 1)
            nodes[at][3] = grow(rows[~low], depth + 1)
        return at

    grow(rng.integers(0, len(X), len(X)), 0)
    return nodes


def train(findings: list[tuple[str, str, str, str, int]] | DataFrame | None = None, *, seed: int = 13, dictionary: list[str] | None = None) -> Forest:
    """A forest from labelled findings; a frame has the columns value, before, after, path and is_secret."""
    words = _pattern(load_dictionary() if dictionary is None else dictionary)
    if findings is None:
        findings = generated_findings(seed=seed)
    elif isinstance(findings, DataFrame):
        rows = findings.where("value <> '' AND is_secret IS NOT NULL").orderBy(F.xxhash64("value", "before"), "value").limit(MAX_FINDINGS)
        findings = [(r.value, r.before or "", r.after or "", r.path or "", int(r.is_secret)) for r in rows.collect()]
    counts = np.ones((2, _SYMBOLS, _SYMBOLS))
    for value, *_, secret in findings:
        s = _symbols(value)
        np.add.at(counts[int(secret)], (s[:-1], s[1:]), 1)
    logs = np.log(counts / counts.sum(axis=2, keepdims=True))
    X = np.array([features(v, b, a, p, logs[1] - logs[0], words) for v, b, a, p, _ in findings])
    y = np.array([f[-1] for f in findings], dtype=float)
    rng = np.random.default_rng(seed)
    trees = [np.array(_tree(X, y, rng)) for _ in range(TREES)]
    size = max(map(len, trees))
    padded = np.stack([np.concatenate([t, np.tile([-1.0, 0, 0, 0, 0], (size - len(t), 1))]) for t in trees])
    return Forest(padded[:, :, 0].astype(np.int64), padded[:, :, 1], padded[:, :, 2].astype(np.int64), padded[:, :, 3].astype(np.int64), padded[:, :, 4], logs[1] - logs[0], words)


def judge(forest: Forest, X: np.ndarray) -> np.ndarray:
    """The mean share of secrets in the leaves that each row of features reaches."""
    trees = np.arange(len(forest.feature))[:, None]
    at = np.zeros((len(forest.feature), len(X)), dtype=np.int64)
    rows = np.arange(len(X))[None, :]
    for _ in range(DEPTH):
        f = forest.feature[trees, at]
        low = X[rows, np.maximum(f, 0)] <= forest.threshold[trees, at]
        at = np.where(f < 0, at, np.where(low, forest.left[trees, at], forest.right[trees, at]))
    return forest.value[trees, at].mean(axis=0)


def scan_texts(forest: Forest, texts: list[str | None], paths: list[str | None]) -> list[list[tuple[int, int, float]]]:
    """(start, end, probability) of every candidate of every text."""
    spans = [find(t) if t else [] for t in texts]
    rows = [features(t[s:e], t[max(0, s - NEAR) : s], t[e : e + NEAR], p, forest.transitions, forest.words) for t, p, own in zip(texts, paths, spans) for s, e in own]
    scores = iter(np.concatenate([judge(forest, np.array(rows[i : i + 4096])) for i in range(0, len(rows), 4096)]).tolist() if rows else ())
    return [[(s, e, next(scores)) for s, e in own] for own in spans]


_FINDINGS = "findings array<struct<start:int,end:int,score:double,secret:boolean>>"


def scan(docs: DataFrame, forest: Forest, *, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """(doc_id, findings) with every candidate of every whole text and whether it is a secret."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(given: dict[str, list]) -> dict[str, list]:
        found = scan_texts(shared.value, given["text"], given["path"])
        return {"findings": [[{"start": s, "end": e, "score": p, "secret": p >= THRESHOLD} for s, e, p in own] for own in found]}

    path = F.col(f"`{path_col}`") if path_col else F.lit(None)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), path.cast("string").alias("path"))
    return with_columns(rows, run, _FINDINGS)


def redact_text(text: str | None, findings: list[tuple[int, int, float]], mark: str = "<SECRET>") -> str | None:
    for s, e, p in reversed(findings):
        if p >= THRESHOLD:
            text = text[:s] + mark + text[e:]
    return text


def redact(docs: DataFrame, forest: Forest, *, text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """``docs`` with every secret in the text replaced by a mark; all other columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("string")
    def redacted(texts: pd.Series, paths: pd.Series) -> pd.Series:
        kept, where = list(texts), list(paths)
        return pd.Series([redact_text(t, f) for t, f in zip(kept, scan_texts(shared.value, kept, where))], dtype=object)

    path = F.col(f"`{path_col}`") if path_col else F.lit(None)
    return docs.withColumn(text_col, redacted(F.col(f"`{text_col}`"), path.cast("string")))
