"""Document quality from a linear-chain conditional random field over lines.

Each line that isn't blank is good or bad. What a line says for itself are its own measures and those of the lines
beside it; what its neighbours' labels say is in the chain's transitions. Forward-backward gives the probability that
a line is good, and a document's score is their mean, weighted by length. The field is fitted by gradient ascent on
at most ``max_documents`` labelled documents, each of whose lines bears the document's label; only their measures
reach the driver, never texts. Scoring is one pass over all texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roundcast.llm.common import BYTE_CODE, LOWER, VISIBLE, chunks, prefix_sums, slice_hash, table, words_of

THRESHOLD = 0.3
MAX_DOCUMENTS = 4000
#: Lines of the training sample, of 39 measures each.
MAX_LINES = 1_000_000
FOLDS = 5
ROUNDS = 120
_IN_LINE = np.ones(256, bool)
_IN_LINE[10] = False


def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


_UPPER, _DIGIT = _bytes((65, 90)), _bytes((48, 57))
_LETTER = _bytes((65, 90), (97, 122), (128, 191))
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>~^{}[]=\\@_")] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(b"!?")] = True
_POINTS = np.zeros(256, bool)
_POINTS[list(b".,;:")] = True
MEASURES = 12


class Lines(NamedTuple):
    """Measures of lines, their visible bytes, and each text's first line, with the end."""

    x: np.ndarray
    size: np.ndarray
    of: np.ndarray


def line_measures(data: np.ndarray, starts: np.ndarray) -> Lines:
    """Shares of kinds of characters, words and repeats in each line that isn't blank."""
    first, last, _ = words_of(data, starts, _IN_LINE)
    word, end, _ = words_of(data, starts, VISIBLE)
    begin = np.searchsorted(word, first)
    count = np.searchsorted(word, last) - begin
    full = count > 0
    first, last, begin, count = first[full], last[full], begin[full], count[full]
    n = len(first)
    of = np.searchsorted(first, starts)
    if not n:
        return Lines(np.zeros((0, MEASURES), np.float32), np.zeros(0), of)

    def share(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(flags, out=sums[1:])
        return sums[last] - sums[first]

    visible = share(VISIBLE[data])
    capital = _UPPER[data]
    # capital letters of Latin-1 in UTF-8
    capital[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    letters = np.maximum(share(_LETTER[data]), 1)
    line = np.searchsorted(first, word, "right") - 1
    codes = slice_hash(prefix_sums(BYTE_CODE[LOWER[data]]), word, end)
    same = np.zeros(len(word), bool)
    same[1:] = (codes[1:] == codes[:-1]) & (line[1:] == line[:-1])
    seen = np.sort((line.astype(np.uint64) << np.uint64(40)) | (codes >> np.uint64(24)))
    new = np.ones(len(word), bool)
    new[1:] = seen[1:] != seen[:-1]
    of_line = (seen >> np.uint64(40)).astype(np.int64)
    distinct = np.bincount(of_line[new], minlength=n)
    after = np.bincount(line[same], minlength=n)
    symbols = share(_SYMBOLS[data])
    x = np.stack(
        [
            np.log1p(visible),
            np.log1p(count),
            np.minimum(visible / count, 40) / 10,
            share(capital) / letters,
            letters / visible,
            symbols / visible,
            np.minimum(symbols / count, 3),
            np.minimum(share(_MARKS[data]) / count, 3),
            np.minimum(share(_POINTS[data]) / count, 3),
            share(_DIGIT[data]) / visible,
            1 - distinct / count,
            after / count,
        ],
        axis=1,
    ).astype(np.float32)
    return Lines(x, visible.astype(np.float64), of)


def with_neighbours(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Own measures, those of the lines before and after in the same text, whether there are such, and one."""
    n = len(x)
    text = np.repeat(np.arange(len(of) - 1), np.diff(of))
    before = np.zeros((n, x.shape[1] + 1), np.float32)
    after = before.copy()
    if n > 1:
        joined = (text[1:] == text[:-1])[:, None]
        before[1:, :-1], before[1:, -1] = x[:-1] * joined, joined[:, 0]
        after[:-1, :-1], after[:-1, -1] = x[1:] * joined, joined[:, 0]
    return np.concatenate([x, before, after, np.ones((n, 1), np.float32)], axis=1)


class Chains(NamedTuple):
    """Texts by number of lines, longest first: step t of the chains are the first active[t] texts."""

    order: np.ndarray
    start: np.ndarray
    size: np.ndarray
    active: np.ndarray


def chains(of: np.ndarray) -> Chains:
    size = np.diff(of)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    steps = size[order]
    longest = int(steps[0]) if len(steps) else 0
    active = len(steps) - np.searchsorted(steps[::-1], np.arange(longest), "right")
    return Chains(order, of[:-1][order], steps, active)


def marginals(gain: np.ndarray, moves: np.ndarray, c: Chains) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line, expected counts of the four moves, and the sum of log partition functions.

    gain: log odds of good from a line's measures. moves[a, b]: weight of label b after label a.
    """
    n = len(gain)
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    for t, k in enumerate(c.active.tolist()):
        i = c.start[:k] + t
        if t:
            f = forward[i - 1]
            forward[i, 0] = np.logaddexp(f[:, 0] + moves[0, 0], f[:, 1] + moves[1, 0])
            forward[i, 1] = np.logaddexp(f[:, 0] + moves[0, 1], f[:, 1] + moves[1, 1])
        forward[i, 1] += gain[i]
    for t in range(len(c.active) - 1, 0, -1):
        i = c.start[: c.active[t]] + t
        b0, b1 = backward[i, 0], backward[i, 1] + gain[i]
        backward[i - 1, 0] = np.logaddexp(moves[0, 0] + b0, moves[0, 1] + b1)
        backward[i - 1, 1] = np.logaddexp(moves[1, 0] + b0, moves[1, 1] + b1)
    total = np.logaddexp(*(forward + backward).T)
    good = np.exp(forward[:, 1] + backward[:, 1] - total)
    inner = np.ones(n, bool)
    inner[c.start] = False
    j = np.flatnonzero(inner)
    expected = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            expected[a, b] = np.exp(forward[j - 1, a] + moves[a, b] + gain[j] * b + backward[j, b] - total[j]).sum()
    return good, expected, float(total[c.start].sum())


class Field(NamedTuple):
    """A fitted field. prior: the score of a text without lines."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    moves: np.ndarray
    prior: float

    def scores(self, lines: Lines) -> np.ndarray:
        out = np.full(len(lines.of) - 1, self.prior)
        if len(lines.x):
            x = (with_neighbours(lines.x, lines.of) - self.mean) / self.scale
            good, _, _ = marginals(x @ self.weight, self.moves, chains(lines.of))
            first = lines.of[:-1]
            full = np.flatnonzero(np.diff(lines.of))
            good = good if self.weight.any() else np.full(len(good), self.prior)
            out[full] = np.add.reduceat(good * lines.size, first[full]) / np.add.reduceat(lines.size, first[full])
        return np.clip(out, 0, 1)


def fit(x: np.ndarray, of: np.ndarray, label: np.ndarray, rounds: int = ROUNDS, ridge: float = 1e-3) -> Field:
    """Ascent (Adam) on the likelihood of the labels, averaged over lines; the same input gives the same field."""
    wide = MEASURES * 3 + 3
    neutral = Field(np.zeros(wide), np.ones(wide), np.zeros(wide), np.zeros((2, 2)), float(label.mean()) if len(label) else 0.5)
    if not len(x) or label.min() == label.max():
        return neutral if not len(x) else neutral._replace(weight=np.eye(1, wide, wide - 1)[0] * (8 if label[0] else -8))
    x = with_neighbours(x, of).astype(np.float64)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[-1] = 0
    scale[scale < 1e-6] = 1
    x = (x - mean) / scale
    c, n = chains(of), len(x)
    y = np.repeat(label, np.diff(of)).astype(np.float64)
    inner = np.ones(n, bool)
    inner[c.start] = False
    seen = np.zeros((2, 2))
    seen[0, 0], seen[1, 1] = (1 - y[inner]).sum(), y[inner].sum()
    theta, m, v = np.zeros(wide + 4), np.zeros(wide + 4), np.zeros(wide + 4)
    for t in range(1, rounds + 1):
        weight, moves = theta[:wide], theta[wide:].reshape(2, 2)
        good, expected, _ = marginals(x @ weight, moves, c)
        slope = np.concatenate([x.T @ (y - good), (seen - expected).ravel()]) / n - ridge * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta = theta + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Field(mean, scale, theta[:wide], theta[wide:].reshape(2, 2), neutral.prior)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo the folds; a null id as an empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, doc_id: str, text_col: str, label: str, max_documents: int, max_lines: int = MAX_LINES) -> Field:
    """A field from at most ``max_documents`` labelled documents outside fold 0, chosen by a hash of their ids. Of these,
    in that order, those whose lines add up to ``max_lines`` at most; of several texts with one id, one."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("double").alias("y")).where("doc_id is not null and y is not null")
    known = known.where(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.avg("y").alias("y"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents)
    # at most max_documents rows of two numbers
    text = F.col(text_col).cast("string")
    met = docs.select(F.col(doc_id).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key")).join(F.broadcast(some), "doc_id")
    lines = met.select("doc_id", "y", F.struct("key", F.greatest(F.size(F.split("text", "\n")), F.lit(1)).alias("lines")).alias("one"))
    lines = lines.groupBy("doc_id", "y").agg(F.min("one").alias("one")).select("doc_id", "y", "one.key", "one.lines")
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    # at most max_documents rows again
    some = lines.withColumn("sum", F.sum("lines").over(before)).where(F.col("sum") <= max_lines).select("doc_id", "key")
    met = met.join(F.broadcast(some.where("key is not null")), ["doc_id", "key"]).dropDuplicates(["doc_id"]).select("doc_id", "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, starts in chunks(batch["text"]):
                lines = line_measures(data, starts)
                own = [lines.x[a:b].tobytes() for a, b in zip(lines.of[:-1], lines.of[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(low, high - low).cast(pa.string()), batch["y"].slice(low, high - low), pa.array(own, pa.binary())],
                    names=["doc_id", "y", "x"],
                )

    rows = met.mapInArrow(run, "doc_id string, y double, x binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.x))
    own = [np.frombuffer(r.x, np.float32).reshape(-1, MEASURES) for r in rows]
    of = np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int64)
    x = np.concatenate(own) if own else np.zeros((0, MEASURES), np.float32)
    return fit(x, of, np.array([r.y >= 0.5 for r in rows]))


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text_col: str = "text",
    label: str = "quality",
    max_documents: int = MAX_DOCUMENTS,
    max_lines: int = MAX_LINES,
    carry: tuple[str, ...] = (),
    keep_text: bool = False,
) -> DataFrame:
    """Score of each row of ``docs``: 0 to 1, higher for a likelier label 1.

    Returns ``doc_id``, ``score``, the text if ``keep_text``, and the columns of ``docs`` named in ``carry`` as c0, c1 ... Labels of ids whose crc32
    modulo 5 is 0 aren't used; null ids and labels neither, and several labels of an id count as their majority. Only
    texts are scored: equal texts score alike. A null, empty or blank text has the share of label 1 as its score,
    0.5 if there are no labels. Repeated rows and null ids give a row each; no rows give no rows.
    """
    field = train(docs, labels, doc_id, text_col, label, max_documents, max_lines)
    along = [F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *along)
    names = [c for c in slim.columns if keep_text or c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [field.scores(line_measures(data, starts)) for _, _, data, starts in chunks(batch["text"])]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in names), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[*names, "score"]
            )

    kinds = ", ".join(f"{c} {slim.schema[c].dataType.simpleString()}" for c in names)
    return slim.mapInArrow(run, f"{kinds}, score double")


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's score, with who was held out."""
    scored = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )
