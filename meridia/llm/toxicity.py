"""Toxic spans by a linear-chain conditional random field.

Each word has one of two tags. Features are the lower-cased word, its prefixes and its shape,
and the words beside it; tags of neighbouring words share a 2x2 table. Forward-backward gives each word's marginal, words
over one half are offending spans, and a logistic function of the marginals scores the text.

Labels are of documents. Words of toxic training documents are labelled toxic where one of
their letters' features is much more frequent (by documents) in toxic than in clean documents; all
words of clean documents are labelled clean, so the field unlearns what both have.
"""

from __future__ import annotations

import math
import pickle
import re
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, arrow_words, parts

#: at most so many labelled documents of each class are read for training
SAMPLE_PER_CLASS = 1200
ROUNDS, RATE, DECAY, BESIDE_DECAY, PIECE = 60, 0.3, 2e-4, 2e-3, 256
#: words whose tag pairs are counted at once
AT_ONCE = 65_536
#: marks of the word before and of the word after, among features
BEFORE, AFTER = ">", "<"
REMEMBERED = 200_000
#: bytes of text scored at once; a longer text is one part
PART = 4 << 20
PREFIXES = (4, 5, 6, 7)
EDGES = "\"'`.,;:!?()[]{}<>*&%$#@~|/\\-_=+…«»“”‘’¡¿"


def bare(word: str) -> str:
    return word.lower().strip(EDGES)


class _Kinds(dict):
    """A character's kind, by its code point: A, a, 9 or another."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = self[code] = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else "."
        return kind


_KINDS, _WORD, _RUN = _Kinds(), re.compile(WORD), re.compile(r"(.)\1+")


def features(word: str) -> list[str]:
    """A word's own features; '^' marks a prefix, '#' a shape: runs of capitals, small letters, digits, others."""
    w = bare(word)
    if not w:
        return []
    return [w, *["^" + w[:k] for k in PREFIXES if len(w) > k], "#" + _RUN.sub(r"\1", word.translate(_KINDS))[:8]]


def marginals(e: np.ndarray, starts: np.ndarray, params: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log odds of tag 1 of each word, and the forward and backward log odds.

    e: emission log odds of all texts' words, one text after another from ``starts`` (one
    entry more than texts). All texts step together, longest first. params: log weights
    of tag pairs 00, 01, 10, 11, and of a text that starts with 1.
    """
    a00, a01, a10, a11, begin = params
    n = len(e)
    x, z = np.empty(n), np.zeros(n)
    length = np.diff(starts)
    order = np.argsort(-length, kind="stable")
    at, length = starts[:-1][order], length[order]
    active = int((length > 0).sum())
    if not active:
        return x + z, x, z
    x[at[:active]] = cur = e[at[:active]] + begin
    # of each step, how many texts are longer
    longer = np.searchsorted(-length, -np.arange(length[0]), side="left")
    w00, w01, w10, w11 = np.exp((a00, a01, a10, a11))
    for t in range(1, int(length[0])):
        m = longer[t]
        odds = np.exp(np.clip(cur[:m], -60, 60))
        i = at[:m] + t
        cur = e[i] + np.log((w01 + w11 * odds) / (w00 + w10 * odds))
        x[i] = cur
    end = at + length - 1
    for t in range(1, int(length[0])):
        m = longer[t]
        i = end[:m] - t
        odds = np.exp(np.clip(e[i + 1] + z[i + 1], -60, 60))
        z[i] = np.log((w10 + w11 * odds) / (w00 + w01 * odds))
    return x + z, x, z


def _sigmoid(v):
    return 1 / (1 + np.exp(-np.clip(v, -60, 60)))


def text_features(odds: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each text: highest log odds, log of 1 + expected toxic words, expected share."""
    p, n = _sigmoid(odds), np.diff(starts)
    total = np.concatenate([[0.0], np.cumsum(p)])
    total = total[starts[1:]] - total[starts[:-1]]
    top = np.full(len(n), -12.0)
    full = n > 0
    if full.any():
        top[full] = np.maximum.reduceat(odds, starts[:-1][full])
    return np.stack([np.clip(top, -12, 12) / 4, np.log1p(np.maximum(total, 0)), total / np.maximum(n, 1)], axis=1)


class Model:
    def __init__(self, weights: dict[str, float], bias: float, params: np.ndarray, scale: np.ndarray):
        self.weights, self.bias, self.params, self.scale = weights, bias, params, scale
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        #: of each numbered word: its own log odds, and what it adds to those of the next and the last word
        self.values, self.fresh = np.empty((3, 0)), []

    def _learn(self, word: str) -> int:
        known, own, some = self.weights.get, self.bias, features(word)
        for f in some:
            own += known(f, 0.0)
        w = some[0] if some else ""
        self.fresh.append((own, known(BEFORE + w, 0.0), known(AFTER + w, 0.0)))
        got = self.number[word] = len(self.number)
        return got

    def odds(self, texts: pa.Array | list) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of tag 1 of each word, and where each text's begin (one entry more than texts)."""
        if len(self.number) > REMEMBERED:
            self._forget()
        words, starts = arrow_words(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        coded = words.dictionary_encode()
        number, learn = self.number, self._learn
        at = np.array([number[w] if w in number else learn(w) for w in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
        if self.fresh:
            self.values, self.fresh = np.concatenate([self.values, np.array(self.fresh).T], axis=1), []
        own, before, after = (v[at] for v in self.values)
        e, inner = own, inside(starts)
        e[inner] += before[inner - 1]
        e[inner - 1] += after[inner]
        return marginals(e, starts, self.params)[0], starts

    def score(self, odds: np.ndarray, starts: np.ndarray) -> np.ndarray:
        f = text_features(odds, starts)
        return _sigmoid(f @ self.scale[1:] + self.scale[0])

    def spans(self, text: str, odds: np.ndarray) -> list[dict]:
        """Runs of words over one half, as character offsets."""
        out, last = [], -2
        for i, w in enumerate(_WORD.finditer(text)):
            if odds[i] > 0:
                if last == i - 1:
                    out[-1]["end"] = w.end()
                else:
                    out.append({"start": w.start(), "end": w.end()})
                last = i
        return out


def inside(starts: np.ndarray) -> np.ndarray:
    """The places that do not begin a text."""
    out = np.ones(starts[-1], bool)
    out[starts[:-1][starts[:-1] < starts[-1]]] = False
    return np.flatnonzero(out).astype(np.int32)


def _step(w, grad, state, rate):
    """Adam."""
    m, v, t = state
    m[:] = 0.9 * m + 0.1 * grad
    v[:] = 0.999 * v + 0.001 * grad * grad
    w += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


def fit(texts: list[str], labels: list[int]) -> Model:
    """Train on labelled texts; the same rows in the same order give the same model."""
    y = np.array(labels)
    if not len(texts) or y.min() == y.max():
        share = float(y.mean()) if len(texts) else 0.0
        bias = math.log((share + 1e-3) / (1 - share + 1e-3))
        return Model({}, -6.0, np.zeros(5), np.array([bias, 0, 0, 0]))
    # words and features as numbers: no list of words is kept
    kinds: dict[str, int] = {}
    rows = [np.fromiter((kinds.setdefault(w, len(kinds)) for w in _WORD.findall(t or "")), np.int32) for t in texts]
    word = np.concatenate(rows)
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    # the chain is trained on pieces of at most PIECE words, so that texts of all lengths step together
    cuts = np.unique(np.concatenate([starts, *(np.arange(a, b, PIECE) for a, b in zip(starts[:-1], starts[1:]))])).astype(np.int64)
    # features as hashes: their strings would be most of the memory, and few of them are used
    hashes, ends = array("Q"), array("q", [0])
    for w in kinds:
        hashes.extend(map(xxhash.xxh64_intdigest, features(w)))
        ends.append(len(hashes))
    ends = np.frombuffer(ends, np.int64)
    known, flat = np.unique(np.frombuffer(hashes, np.uint64), return_inverse=True)
    flat = flat.astype(np.int32)
    last = ends[1:][np.diff(ends) > 0] - 1
    del hashes
    pair_kind = np.repeat(np.arange(len(ends) - 1, dtype=np.int32), np.diff(ends))
    seen = np.zeros((2, len(known)), np.int32)
    for r, label in zip(rows, y):
        own = np.unique(r)
        if len(own):
            seen[label, np.unique(np.concatenate([flat[ends[k] : ends[k + 1]] for k in own]))] += 1
    del rows
    n0, n1 = int((y == 0).sum()), int((y == 1).sum())
    shapes = np.zeros(len(known), bool)
    shapes[flat[last]] = True  # a word's last feature
    telling = ~shapes & (seen[1] >= max(4, 0.004 * n1)) & (np.log((seen[1] + 0.1) / n1) - np.log((seen[0] + 0.5) / n0) > 2.3)
    hot = np.bincount(pair_kind, telling[flat], minlength=len(ends) - 1) > 0
    # only features of three texts or more have weights
    use = seen.sum(0) >= 3
    number = np.cumsum(use) - 1
    n_names = int(use.sum())
    kept = use[flat]
    pair_kind, pair_name = pair_kind[kept], number[flat[kept]]
    n_kinds = len(ends) - 1
    # the word that a neighbour sees: a kind's first feature, or none (the last number)
    seen_as = np.full(n_kinds, n_names, np.int32)
    some = np.flatnonzero(np.diff(ends) > 0)
    seen_as[some] = np.where(use[flat[ends[some]]], number[flat[ends[some]]], n_names)
    beside, next_to = seen_as[word], inside(starts)
    names: dict[str, int] = {}
    place = dict(zip(known[use].tolist(), range(n_names)))
    for w in kinds:
        for f in features(w):
            i = place.get(xxhash.xxh64_intdigest(f))
            if i is not None:
                names[f] = i
    del kinds, known, place, flat
    tag = hot[word] & np.repeat(y == 1, np.diff(starts))
    w, bias, params = np.zeros(n_names), np.array([-3.0]), np.zeros(5)
    w_before, w_after = np.zeros(n_names + 1), np.zeros(n_names + 1)
    states = [(np.zeros_like(a), np.zeros_like(a)) for a in (w, bias, params, w_before, w_after)]
    first = cuts[:-1]
    inner = np.ones(len(word), bool)
    inner[first] = False
    inner = np.flatnonzero(inner).astype(np.int32)
    seen_pairs = np.bincount(tag[inner - 1] * 2 + tag[inner], minlength=4).astype(float)
    positive = max(1.0, tag.sum())
    for t in range(1, ROUNDS + 1):
        kind_e = bias[0] + np.bincount(pair_kind, w[pair_name], minlength=n_kinds)
        e = kind_e[word]
        e[next_to] += w_before[beside[next_to - 1]]
        e[next_to - 1] += w_after[beside[next_to]]
        odds, x, z = marginals(e, cuts, params)
        p = _sigmoid(odds)
        by_side = []
        miss = tag - p
        for v, it, seen_by in ((w_before, next_to - 1, next_to), (w_after, next_to, next_to - 1)):
            g = np.bincount(beside[it], miss[seen_by], minlength=len(v)) / positive - BESIDE_DECAY * v
            g[-1] = 0.0
            by_side.append(g)
        per_kind = np.bincount(word, miss, minlength=n_kinds)
        grad_w = np.bincount(pair_name, per_kind[pair_kind], minlength=len(w)) / positive - DECAY * w
        grad_b = np.array([miss.sum() / positive])
        # expected tag pairs: forward odds of the left word, the pair's weight, emission and backward odds of the right
        pairs = np.zeros(4)
        for i in range(0, len(inner), AT_ONCE):
            here = inner[i : i + AT_ONCE]
            left, right = x[here - 1], e[here] + z[here]
            logs = np.stack([np.full(len(here), params[0]), params[1] + right, params[2] + left, params[3] + left + right])
            share = np.exp(logs - logs.max(0))
            pairs += (share / share.sum(0)).sum(1)
        grad_p = np.append((seen_pairs - pairs) / positive, (tag[first] - p[first]).sum() / positive) - 1e-3 * params
        for a, g, s in zip((w, bias, params, w_before, w_after), (grad_w, grad_b, grad_p, *by_side), states):
            _step(a, g, (*s, t), RATE)
    weights = {mark + f: float(v[i]) for mark, v in (("", w), (BEFORE, w_before), (AFTER, w_after)) for f, i in names.items() if abs(v[i]) > 0.03}
    model = Model(weights, float(bias[0]), params, np.zeros(4))
    f = text_features(*model.odds(texts))
    design, scale = np.concatenate([np.ones((len(f), 1)), f], axis=1), np.zeros(4)
    state, weight = (np.zeros(4), np.zeros(4)), 1 / len(y)
    for t in range(1, 1501):
        _step(scale, design.T @ ((y - _sigmoid(design @ scale)) * weight) - 1e-4 * scale, (*state, t), 0.05)
    model.scale = scale
    return model


def held_out(id_col) -> F.col:
    """Rows whose crc32(id as text) mod 5 is 0; never learned from. False for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fit, in one task, on at most ``per_class`` labelled, not held-out documents of each class,
    those with the least hash of their id; only texts and labels are read. Of labels that contradict
    each other 1 counts; of rows that repeat an id the least text; of texts alike the label of
    the least id. Labels of null ids and other values than 0 and 1 do not count."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).alias("label"))
    picked = None
    for label in (0, 1):
        some = known.where(F.col("label") == label).orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    # 2 * per_class rows at most, so the join may broadcast them, and one task fits on them
    rows = df.select(id_col, F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), id_col).groupBy(id_col, "label").agg(F.min("text").alias("text"))

    def learn(batches):
        got = sorted((r for b in batches for r in zip(*(b.column(c).to_pylist() for c in (id_col, "label", "text")))), key=lambda r: r[0], reverse=True)
        # copies would count a text's words more than once
        unique = {text: label for _, label, text in got if text is not None}
        texts = sorted(unique)
        del got
        m = fit(texts, [int(unique[t]) for t in texts])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((m.weights, m.bias, m.params, m.scale))], pa.binary())], names=["model"])

    found = rows.repartition(1).mapInArrow(learn, "model binary").collect()
    return Model(*pickle.loads(found[0].model)) if found else fit([], [])


_local: dict = {}


def _scored(df: DataFrame, model: Model, text_col: str):
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast((model.weights, model.bias, model.params, model.scale))

    def score(texts: pa.Array, tell: bool) -> tuple[np.ndarray, list]:
        if _local.get("id") != id(sent.value):
            _local.update(id=id(sent.value), model=Model(*sent.value), keep=sent.value)
        m = _local["model"]
        odds, starts = m.odds(texts)
        hot = np.concatenate([[0], np.cumsum(odds > 0)])
        ends = starts.tolist()
        spans = [m.spans(texts[i].as_py(), odds[a:b]) if hot[b] > hot[a] else [] for i, (a, b) in enumerate(zip(ends, ends[1:]))] if tell else []
        return m.score(odds, starts), spans

    return score


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted, spans) of each row: spans are the offending
    runs of words as character offsets. Null and blank texts get the score of no words.
    Repeated rows each get a result; other columns are ignored. There is no shuffle."""
    run_score = _scored(df, model, text_col)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for b in (part for whole in batches for part in parts(whole, 2, PART)):
            scores, spans = run_score(b.column(2), True)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32)), pa.array(spans, span)], names=["id", "held_out", "score", "predicted", "spans"])
        _local.clear()  # the worker may serve another operator next

    kind = df.select(id_col).schema[0].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int>>")
    return out.withColumnRenamed("id", id_col)


def drop_toxic(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose score is below 0.5, all columns as they are."""
    run_score, place = _scored(df, model, text_col), df.columns.index(text_col)

    def run(batches):
        for b in (part for whole in batches for part in parts(whole, place, PART)):
            yield b.filter(pa.array(run_score(b.column(place), False)[0] < 0.5))
        _local.clear()

    return df.mapInArrow(run, df.schema)
