"""Quality of texts: a factorization machine over hashed words, structure statistics and metadata.

A text has three kinds of features: the hashes of its different words (each
with weight 1/sqrt(their number)), its structure statistics and its metadata
(lengths), cut into steps, one feature for each statistic and step.  Besides a
weight, every feature has ``FACTORS`` hidden factors; a pair of features acts
on the score by the product of their factors.  All pairs together cost linear
time: half of the squared sum less the sum of squares, for each factor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutebook.llm import labelled
from minutebook.llm import wordhash as W
from minutebook.llm.common import ship, text_bytes

ship(W.__name__)
ship(labelled.__name__)
ship(__name__)

BITS = 16
FACTORS = 8
STEPS = 12
FIT_ROWS = 2000
# Ranges of the statistics; each is cut into STEPS equal steps.
RANGES = (
    ("log2 of bytes", 0.0, 18.0), ("log2 of words", 0.0, 15.0), ("log2 of lines", 0.0, 12.0),
    ("bytes per word", 1.0, 13.0), ("words per line, log2", 0.0, 10.0), ("share of different words", 0.0, 1.0),
    ("share of repeated neighbors", 0.0, 0.5), ("share of capitals", 0.0, 0.6), ("share of digits", 0.0, 0.3),
    ("share of marks", 0.0, 0.3), ("share of marks other than stops", 0.0, 0.15), ("share of bytes beyond ASCII", 0.0, 0.3),
    ("stops per word", 0.0, 0.3), ("share of different lines", 0.0, 1.0), ("share of words that end in a mark", 0.0, 1.0),
    ("share of one-sign words", 0.0, 0.5),
)
FEATURES = (1 << BITS) + len(RANGES) * STEPS


def _table(signs: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(signs)] = 1
    return out


_STOPS = b".,;:!?"
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_CLASSES = (_table(bytes(range(65, 91))), _table(bytes(range(48, 58))), _table(_MARKS),
            _table(bytes(set(_MARKS) - set(b".,"))), _table(bytes(range(128, 256))), _table(_STOPS), _table(b"\n"))


def features(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of all texts, by text."""
    t = W.Texts(bodies)
    n, begins = len(bodies), np.concatenate([[0], np.cumsum([len(b) + 1 for b in bodies])])[:-1].astype(np.int64)
    sizes = np.array([len(b) for b in bodies], np.float64)
    words = np.diff(t.bounds).astype(np.float64)
    byte_of = np.append(t.buffer, 32)  # a last sign for the sums

    def per_text(sign_table):
        sums = np.concatenate([[0], np.cumsum(sign_table[byte_of])])
        return (sums[begins + sizes.astype(np.int64)] - sums[begins]).astype(np.float64)

    capitals, digits, marks, odd, beyond, stops, breaks = map(per_text, _CLASSES)
    order = np.lexsort((t.words, t.doc))
    doc, word = t.doc[order], t.words[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])
    doc, word = doc[new], word[new]
    different = np.bincount(doc, minlength=n).astype(np.float64)
    twin = np.zeros(len(t.words), bool)
    twin[1:] = (t.words[1:] == t.words[:-1]) & (t.doc[1:] == t.doc[:-1])
    last = byte_of[t.ends - 1] if len(t.ends) else np.zeros(0, np.int64)
    ended = np.bincount(t.doc, _CLASSES[2][last], n)
    single = np.bincount(t.doc, (t.ends - t.starts) == 1, n)
    lines = [b.split(b"\n") for b in bodies]
    distinct_lines = np.array([len(set(x)) / len(x) for x in lines]) if bodies else np.zeros(0)
    some, sized = np.maximum(words, 1), np.maximum(sizes, 1)
    stats = np.stack([
        np.log2(sizes + 1), np.log2(words + 1), np.log2(breaks + 1), sizes / some, np.log2(words / (breaks + 1) + 1),
        different / some, np.bincount(t.doc, twin, n) / some, capitals / sized, digits / sized, marks / sized, odd / sized,
        beyond / sized, stops / some, distinct_lines, ended / some, single / some], axis=1) if n else np.zeros((0, len(RANGES)))
    low, high = (np.array([r[k] for r in RANGES]) for k in (1, 2))
    step = np.clip(((stats - low) / (high - low) * STEPS).astype(np.int64), 0, STEPS - 1)
    stat_feature = (1 << BITS) + np.arange(len(RANGES)) * STEPS + step
    text = np.concatenate([doc, np.repeat(np.arange(n), len(RANGES))])
    feature = np.concatenate([(word >> W.U(64 - BITS)).astype(np.int64), stat_feature.ravel()])
    value = np.concatenate([1 / np.sqrt(different[doc]), np.full(n * len(RANGES), 0.5)])
    order = np.argsort(text, kind="stable")
    return text[order], feature[order], value[order]


def _margin(count: int, text, feature, value, constant, weight, factors):
    """Score before the logistic curve, and the sums of each factor."""
    linear = np.bincount(text, weight[feature] * value, count) + constant
    sums = np.stack([np.bincount(text, factors[f][feature] * value, count) for f in range(len(factors))])
    squares = sum(np.bincount(text, (factors[f][feature] * value) ** 2, count) for f in range(len(factors)))
    return linear + 0.5 * ((sums ** 2).sum(axis=0) - squares), sums


def fit(bodies: list[bytes], labels: list[int], shares: list[float], rounds: int = 80, penalty: float = 1e-4) -> bytes:
    """Model of a sample of labelled texts: constant, weights, factors, as 32-bit floats."""
    y = np.array(labels, np.float64)
    weight, factors = np.zeros(FEATURES), np.zeros((FACTORS, FEATURES))
    if not 0 < y.sum() < len(y):
        share = (y.sum() + 1) / (len(y) + 2)
        return np.concatenate([[np.log(share / (1 - share))], weight, factors.ravel()]).astype("<f4").tobytes()
    found = [(first, features(some)) for first, some in W.batches(bodies)]
    text = np.concatenate([f[0] + first for first, f in found])
    feature, value = (np.concatenate([f[k] for _, f in found]) for k in (1, 2))
    used, feature = np.unique(feature, return_inverse=True)
    w, constant = np.zeros(len(used)), 0.0
    v = np.random.default_rng(5).normal(0, 0.05, (FACTORS, len(used)))
    parts = [np.zeros(len(used) * (FACTORS + 1) + 1) for _ in range(2)]
    balance = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    for step in range(1, rounds + 1):
        z, sums = _margin(len(y), text, feature, value, constant, w, v)
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance / len(y)
        push = error[text] * value
        slopes = [np.bincount(feature, push, len(used)) + penalty * w]
        square = np.bincount(feature, push * value, len(used))
        for f in range(FACTORS):
            slopes.append(np.bincount(feature, push * sums[f][text], len(used)) - v[f] * square + penalty * v[f])
        slope = np.concatenate([*slopes, [error.sum()]])
        parts[0] = 0.9 * parts[0] + 0.1 * slope
        parts[1] = 0.99 * parts[1] + 0.01 * slope ** 2
        move = 0.03 * (parts[0] / (1 - 0.9 ** step)) / (np.sqrt(parts[1] / (1 - 0.99 ** step)) + 1e-8)
        w, constant = w - move[:len(used)], constant - move[-1]
        v = v - move[len(used):-1].reshape(FACTORS, len(used))
    true_odds = max((s for s, t in zip(shares, y) if t == 1), default=0.5)
    constant += np.log(true_odds / max(1e-6, 1 - true_odds))
    weight[used], factors[:, used] = w, v
    return np.concatenate([[constant], weight, factors.ravel()]).astype("<f4").tobytes()


def scores(bodies: list[bytes], model: np.ndarray) -> np.ndarray:
    constant, weight, factors = model[0], model[1:FEATURES + 1], model[FEATURES + 1:].reshape(FACTORS, FEATURES)
    out = np.zeros(len(bodies))
    for first, some in W.batches(bodies):
        z = _margin(len(some), *features(some), constant, weight, factors)[0]
        out[first:first + len(some)] = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    return out


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 4,
                  fold: int = 2, fit_rows: int = FIT_ROWS, threshold: float = 0.7) -> DataFrame:
    """One row per text: id_col, held_out, score (0 to 1), predicted.

    The model is fitted on at most ``fit_rows`` labelled texts of either label
    outside the held-out fold, chosen by hash of their id; shares of the
    labels are counted over all.  Null texts count as empty and are scored
    like any other.  Without labels, or with one label only, every text gets
    the smoothed share of good rows.  Every row is scored, repeated ids too;
    other columns are not looked at.
    """
    model = np.frombuffer(labelled.fitted(
        labelled.training_rows(docs, labels, "quality", folds, fold, fit_rows, id_col, text_col), fit), "<f4")

    def run(parts):
        for part in parts:
            value = scores(part.column("_body").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(value)], ["_id", "score"])

    rows = docs.select(F.col(id_col).alias("_id"), text_bytes(text_col).alias("_body"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, score double").select(
        F.col("_id").alias(id_col), labelled.held_out("_id", folds, fold).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
