"""Toxicity of texts: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the hashed n-grams (3 to 5 characters, lower case, across word
edges).  Each is scaled by the log ratio of its shares among toxic and among
other labelled texts, smoothed towards the share among all; logistic
regression then learns a weight for each scaled feature.

A toxic text gives itself away in a few words, in any amount of other text.
So a text scores as its most suspicious stretch of ``SPAN`` characters, and
regression is trained on the most suspicious stretch of every labelled text,
found with the ratios alone.  With running sums all stretches of a text cost
one pass, so texts are scored whole, whatever their length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutebook.llm import labelled
from minutebook.llm.common import ship, text_bytes

ship(labelled.__name__)
ship(__name__)

ORDERS = (3, 4, 5)
BITS = 20
SPAN = 240
PRIOR = 100.0
FIT_ROWS = 3000
_STEP = 1 << 19


def _characters(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in lower case, white space as one sign, a space on either side; bounds of the texts."""
    texts = [f" {b.decode().lower()} " for b in bodies]
    signs = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.where(signs <= 32, np.uint32(32), signs), bounds


def _grams(signs: np.ndarray, bounds: np.ndarray):
    """For each order the feature number at every character; -1 where the n-gram would leave its text."""
    value = signs * np.uint32(0x9E3779B1)
    value ^= value >> np.uint32(15)
    rolling, ends = value, bounds[1:]
    sizes = np.diff(bounds)
    for n in range(2, max(ORDERS) + 1):
        after = np.zeros_like(value)
        after[:max(0, len(value) - n + 1)] = value[n - 1:]
        rolling = rolling * np.uint32(0x01000193) + after
        if n in ORDERS:
            mixed = (rolling ^ np.uint32(n * 0x1C6EF372)) * np.uint32(0x85EBCA6B)
            mixed ^= mixed >> np.uint32(13)
            number = ((mixed * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)).astype(np.int32)
            for k in range(1, n):
                number[(ends - k)[sizes >= k]] = -1
            yield number


def _pieces(bodies: list[bytes]):
    at, size = 0, 0
    for i, b in enumerate(bodies):
        if i > at and size + len(b) > _STEP:
            yield at, bodies[at:i]
            at, size = i, 0
        size += len(b)
    if at < len(bodies):
        yield at, bodies[at:]


def _best(bodies: list[bytes], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Highest sum of weights over a stretch of each text, where the stretch starts, characters and bounds."""
    signs, bounds = _characters(bodies)
    total = np.zeros(len(signs) + 1)
    padded = np.append(weights, np.float32(0))
    worth = np.zeros(len(signs), np.float32)
    for number in _grams(signs, bounds):
        worth += padded[number]
    np.cumsum(worth, out=total[1:])
    top, where = np.zeros(len(bodies)), np.zeros(len(bodies), np.int64)
    ends = np.minimum(np.arange(len(signs)) + SPAN, np.repeat(bounds[1:], np.diff(bounds)))
    sums = total[ends] - total[:-1]
    for k in range(len(bodies)):
        lo, hi = bounds[k], max(bounds[k] + 1, bounds[k + 1] - SPAN + 1)
        where[k] = lo + int(np.argmax(sums[lo:hi]))
        top[k] = sums[where[k]]
    return top, where, signs, bounds


def fit(bodies: list[bytes], labels: list[int], shares: list[float], rounds: int = 120, penalty: float = 1e-3) -> bytes:
    """Model of a sample of labelled texts: 2^BITS weights and a constant, as 32-bit floats."""
    y = np.array(labels, np.float64)
    size = 1 << BITS
    if not 0 < y.sum() < len(y):
        share = (y.sum() + 1) / (len(y) + 3)
        return np.append(np.zeros(size), np.log(share / (1 - share))).astype("<f4").tobytes()
    counts = np.zeros((2, size))
    for first, some in _pieces(bodies):
        signs, bounds = _characters(some)
        numbers = list(_grams(signs, bounds))
        for k in range(len(some)):
            own = np.unique(np.concatenate([n[bounds[k]:bounds[k + 1]] for n in numbers]))
            counts[int(y[first + k]), own[own >= 0]] += 1
    texts = np.array([(y == 0).sum(), (y == 1).sum()], float)
    share = counts.sum(axis=0) / texts.sum()
    q, p = ((counts[c] + PRIOR * share + 1e-9) / (texts[c] + PRIOR) for c in (0, 1))
    ratio = np.where(share > 0, np.log(p / q), 0.0).astype(np.float32)
    rows = []
    for first, some in _pieces(bodies):
        _, where, signs, bounds = _best(some, ratio)
        numbers = list(_grams(signs, bounds))
        for k in range(len(some)):
            rows.append(np.concatenate([n[where[k]:min(where[k] + SPAN, bounds[k + 1])] for n in numbers]))
    text = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.concatenate(rows)
    text, feature = text[feature >= 0], feature[feature >= 0]
    used, feature = np.unique(feature, return_inverse=True)
    scale = ratio[used].astype(np.float64)
    weight, constant = np.full(len(used), 0.1), 0.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    balance = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    for step in range(1, rounds + 1):
        z = np.bincount(text, (weight * scale)[feature], len(rows)) + constant
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance / len(y)
        slope = np.append(np.bincount(feature, error[text], len(used)) * scale + penalty * weight / len(y), error.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope ** 2
        move = 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
        weight, constant = weight - move[:-1], constant - move[-1]
    true_odds = max((s for s, t in zip(shares, y) if t == 1), default=0.5)
    constant += np.log(true_odds / max(1e-6, 1 - true_odds))
    out = np.zeros(size + 1)
    out[used], out[-1] = weight * scale, constant
    return out.astype("<f4").tobytes()


def scores(bodies: list[bytes], model: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bodies))
    for first, some in _pieces(bodies):
        top = _best(some, model[:-1])[0]
        out[first:first + len(some)] = 1 / (1 + np.exp(-np.clip(top + model[-1], -50, 50)))
    return out


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, folds: int, fold: int, fit_rows: int,
            keep: list[str]) -> DataFrame:
    """_id, score and the columns to keep as c0, c1, ..."""
    model = np.frombuffer(labelled.fitted(
        labelled.training_rows(docs, labels, "toxic", folds, fold, fit_rows, id_col, text_col), fit), "<f4")

    def run(parts):
        for part in parts:
            value = scores(part.column("_body").to_pylist(), model)
            names = [n for n in part.schema.names if n != "_body"]
            yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + [pa.array(value)], names + ["score"])

    rows = docs.select(F.col(id_col).alias("_id"), text_bytes(text_col).alias("_body"),
                       *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "_body")
    return rows.mapInArrow(run, f"{kinds}, score double")


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5,
                   fold: int = 0, fit_rows: int = FIT_ROWS, threshold: float = 0.5) -> DataFrame:
    """One row per text: id_col, held_out, score (0 to 1), predicted.

    The model is fitted on at most ``fit_rows`` labelled texts of either label
    outside the held-out fold, chosen by hash of their id; shares of the
    labels are counted over all.  Null and empty texts get the score of an
    empty stretch.  Without labels, or with one label only, every text gets
    the smoothed share of toxic rows.  Every row is scored, repeated ids too;
    other columns are not looked at.
    """
    return _scored(docs, labels, id_col, text_col, folds, fold, fit_rows, []).select(
        F.col("_id").alias(id_col), labelled.held_out("_id", folds, fold).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5,
               fold: int = 0, fit_rows: int = FIT_ROWS, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that score below the threshold, columns unchanged."""
    names = docs.columns
    return (_scored(docs, labels, id_col, text_col, folds, fold, fit_rows, names).where(F.col("score") < threshold)
            .select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names))))
