"""A linear classifier over character n-grams with naive Bayes scaling.

Features are the n-grams of characters of the lower-cased text, hashed into a
table. A feature's value is its log-count ratio, the logarithm of how much more
often documents of a class hold it than others, times the logarithm of one plus
its count; a ridge logistic regression over these values gives the weights.
N-grams whose ratio is not surely apart from zero are left out, so a text of any
length is scored by what it holds and not by how much it holds.

The executors count the n-grams of the labelled rows; the driver gets the
counts, picks the features, and solves the regression over the rows' features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import cut

ORDERS, TABLE_BITS = (3, 4, 5, 6), 20
_MIX = np.uint32(0x9E3779B1)
#: Characters that are hashed at a time; a longer text takes several steps.
STEP = 1 << 20


@dataclass(frozen=True)
class Model:
    slots: np.ndarray  # hashed n-gram -> feature number, 0 for none
    weights: np.ndarray  # feature number, class -> weight, scaled by the log-count ratio; number 0 weighs nothing
    bias: np.ndarray  # by class


def grams(data: np.ndarray) -> Iterator[np.ndarray]:
    """Hashed n-grams by order; the one at i starts at character i."""
    value = np.zeros(len(data), np.uint32)
    done = 0
    for n in ORDERS:
        while done < n:
            if len(data) <= done:
                return
            size = len(data) - done
            value = (value[:size] + data[done:] + np.uint32(1)) * _MIX
            value ^= value >> np.uint32(15)
            done += 1
        yield ((value + np.uint32(n)) * _MIX) >> np.uint32(32 - TABLE_BITS)


def fold(text: bytes) -> np.ndarray:
    """Lower case, with a space before and after, as code points."""
    lowered = f" {text.decode('utf-8', 'replace').lower()} "
    return np.frombuffer(lowered.encode("utf-32-le", "replace"), "<u4")


def _steps(text: bytes) -> Iterator[np.ndarray]:
    """All hashed n-grams of a text, a bounded number of characters at a time."""
    data = fold(text)
    for at in range(0, len(data), STEP):
        parts = [own[:STEP] for own in grams(data[at : at + STEP + max(ORDERS) - 1])]
        if parts:
            yield np.concatenate(parts)


def present(text: bytes) -> np.ndarray:
    found = [np.unique(own) for own in _steps(text)]
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)


def features(slots: np.ndarray, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, amounts) of the features in a text; an amount is the logarithm of one plus the count."""
    found = []
    for hashed in _steps(text):
        own = slots[hashed]
        found.append(np.unique(own[own > 0], return_counts=True))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0)
    if len(found) == 1:
        return found[0][0], np.log1p(found[0][1])
    numbers, places = np.unique(np.concatenate([n for n, _ in found]), return_inverse=True)
    return numbers, np.log1p(np.bincount(places, np.concatenate([c for _, c in found])))


def logistic(rows: list[np.ndarray], amounts: list[np.ndarray], values: np.ndarray, target: np.ndarray, strength: float, rounds: int = 15) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression over scaled features, by Newton steps with conjugate gradients."""
    n, k = max(len(rows), 1), len(values)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    entry = values[column] * (np.concatenate(amounts) if rows else 1.0)
    forward = lambda x: np.bincount(owner, entry * x[:k][column], len(rows)) + x[k]
    back = lambda e: np.append(np.bincount(column, entry * e[owner], k), e.sum())
    ridge = np.append(np.full(k, strength * n), 1e-6 * n)
    x = np.zeros(k + 1)

    def loss(x: np.ndarray) -> float:
        odds = forward(x)
        return float((np.logaddexp(0, odds) - target * odds).sum() + (ridge * x * x).sum() / 2)

    now = loss(x)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(forward(x), -40, 40)))
        gradient = back(p - target) + ridge * x
        curve = p * (1 - p)
        step, rest = np.zeros(k + 1), -gradient
        way, square = rest, rest @ rest
        first = square
        for _ in range(30):
            if square <= 1e-3 * first or not first:
                break
            bent = back(curve * forward(way)) + ridge * way
            length = square / (way @ bent)
            step, rest = step + length * way, rest - length * bent
            square, before = rest @ rest, square
            way = rest + square / before * way
        size = 1.0
        while (new := loss(x + size * step)) > now and size > 1e-6:
            size /= 2
        done = now - new < 1e-5 * n
        x, now = x + size * step, new
        if done:
            break
    return x[:k], float(x[k])


def ratios(counts: np.ndarray, size: np.ndarray, smoothing: float) -> tuple[np.ndarray, np.ndarray]:
    """(log-count ratios, how many standard errors they are from zero) by class and slot.

    ``counts`` are the texts of a class that hold a slot, ``size`` its texts. A
    class that all or none of the texts have is sure of nothing.
    """
    size = size[:, None]
    own, others = counts + smoothing, counts.sum(axis=0) - counts + smoothing
    ratio = np.log(own / (size + 2 * smoothing)) - np.log(others / (size.sum() - size + 2 * smoothing))
    sure = np.abs(ratio) / np.sqrt(1 / own + 1 / others)
    return ratio, sure * ((size > 0) & (size < size.sum())) * (counts.sum(axis=0) > 0)


def chosen(counts: np.ndarray, size: np.ndarray, smoothing: float, certainty: float, most: int) -> np.ndarray:
    """The slots that become features 1, 2, ...: the surest for some class, of equal ones the first."""
    best = np.zeros(counts.shape[1])
    for at in range(0, len(best), 1 << 16):  # a part of the table at a time
        best[at : at + (1 << 16)] = ratios(counts[:, at : at + (1 << 16)], size, smoothing)[1].max(axis=0, initial=0.0)
    best[best < certainty] = 0
    return np.argsort(-best, kind="stable")[: min(most, int((best > 0).sum()))]


def _ratio_of(counts: np.ndarray, size: np.ndarray, smoothing: float, order: np.ndarray) -> np.ndarray:
    """Ratios of the chosen slots, by class."""
    return ratios(counts[:, order], size, smoothing)[0]


def _numbered(order: np.ndarray) -> np.ndarray:
    slots = np.zeros(1 << TABLE_BITS, np.int32)
    slots[order] = np.arange(1, len(order) + 1)
    return slots


def _model(found: list[tuple[np.ndarray, np.ndarray]], goal: np.ndarray, ratio: np.ndarray, order: np.ndarray, size: np.ndarray, strength: float) -> Model:
    classes, texts = len(size), len(goal)
    weights, bias = np.zeros((1 + len(order), classes)), np.zeros(classes)
    for k in range(classes):
        if classes == 2 and k and texts:  # the other side of the same question
            weights[:, 1], bias[1] = -weights[:, 0], -bias[0]
        elif 0 < size[k] < texts:
            values = np.concatenate(([0.0], ratio[k]))
            own, bias[k] = logistic([n for n, _ in found], [x for _, x in found], values, goal == k, strength)
            weights[:, k] = own * values
        else:
            bias[k] = np.log((size[k] + 0.5) / (texts - size[k] + 0.5)) if texts else NEVER
    return Model(_numbered(order), weights, bias)


#: Log odds of a class of which nothing is known, as there is no labelled text.
NEVER = -40.0


def fit(texts: list[bytes], labels: list[int], classes: int, smoothing: float = 1.0, certainty: float = 3.0, most: int = 20_000, strength: float = 1e-4) -> Model:
    """One regression for each class against the others; ``labels`` are 0 to ``classes`` - 1.

    A feature is kept when its log-count ratio for some class is at least
    ``certainty`` standard errors from zero, and of those the ``most`` surest.
    A class that all or none of the texts have gets no feature, and its bias is
    the prior's log odds; without any text no class has a chance.
    """
    goal = np.array(labels, np.int64)
    counts = np.zeros((classes, 1 << TABLE_BITS), np.int32)
    for text, label in zip(texts, labels, strict=True):
        counts[label, present(text)] += 1
    size = np.bincount(goal, minlength=classes)
    order = chosen(counts, size, smoothing, certainty, most)
    slots = _numbered(order)
    return _model([features(slots, t) for t in texts], goal, _ratio_of(counts, size, smoothing, order), order, size, strength)


def sample(docs: DataFrame, marks: DataFrame, rows: int, longest: int, characters: int) -> DataFrame:
    """(id, label, body): about ``rows`` texts of the labelled ids ``marks`` (id, label), one for each id.

    Ids are chosen by a hash; of the texts of a repeated id the first by hash
    is taken. A text gives its first ``longest`` characters, or fewer where all
    together would be more than ``characters``, so what is learned from is
    bounded whatever the tables hold.
    """
    low = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 40)) / float(1 << 40) < rows / max(marks.count(), 1)
    own = docs.select(F.col("doc_id").alias("__doc"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    near = own.join(F.broadcast(marks.filter(low)), F.col("__doc") == F.col("id"))
    first = F.min(F.struct(F.xxhash64("text").alias("h"), F.left("text", F.lit(longest)).alias("piece"), "label")).alias("first")
    one = cut(near.groupBy("id").agg(first).select("id", "first.label", "first.piece"))
    found = one.agg(F.count(F.lit(1)), F.sum(F.length("piece"))).head()
    room = longest if (found[1] or 0) <= characters else max(1, characters // found[0])
    return one.select("id", "label", F.left("piece", F.lit(room)).cast("binary").alias("body"))


def fit_frame(rows: DataFrame, classes: int, smoothing: float = 1.0, certainty: float = 3.0, most: int = 20_000, strength: float = 1e-4) -> Model:
    """``fit`` over a bounded frame (id, label, body), whose n-grams the executors count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((classes, 1 << TABLE_BITS), np.int32)
        for batch in batches:
            for label, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[label, present(body)] += 1
        held = np.flatnonzero(counts.any(axis=0)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(held), *(pa.array(own[held]) for own in counts)], ["slot", *names])

    names = [f"n{k}" for k in range(classes)]
    table = rows.select("label", "body").mapInArrow(count, ", ".join(["slot int", *(f"{n} int" for n in names)]))
    held = table.groupBy("slot").agg(F.count(F.lit(1)).alias("tasks"), *[F.sum(n).cast("int").alias(n) for n in names]).drop("tasks").toArrow()  # a row for each slot of the table at most
    counts = np.zeros((classes, 1 << TABLE_BITS), np.int32)
    for k, n in enumerate(names):
        counts[k, held.column("slot").to_numpy()] = held.column(n).to_numpy()
    del held
    size = np.zeros(classes, np.int64)
    for label, n in rows.groupBy("label").count().collect():
        size[label] = n
    order = chosen(counts, size, smoothing, certainty, most)
    ratio = _ratio_of(counts, size, smoothing, order)
    del counts
    shared = rows.sparkSession.sparkContext.broadcast(_numbered(order))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(shared.value, body) for body in batch.column(2).to_pylist()]
            columns = [pa.array([n for n, _ in found], pa.list_(pa.int32())), pa.array([x for _, x in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "label", "numbers", "amounts"])

    marked = rows.select(F.col("id").cast("string").alias("id"), "label", "body").mapInArrow(mark, "id string, label int, numbers array<int>, amounts array<double>")
    found = sorted(zip(*(c.to_pylist() if k < 2 else [x.values.to_numpy() for x in c] for k, c in enumerate(marked.toArrow().columns)), strict=True), key=lambda r: r[0])
    goal = np.array([r[1] for r in found], np.int64)
    return _model([(r[2].astype(np.int64), r[3]) for r in found], goal, ratio, order, size, strength)


def probabilities(model: Model, text: bytes) -> np.ndarray:
    """Probability of each class against the others; a text without features has the biases' odds."""
    numbers, amounts = features(model.slots, text)
    return 1 / (1 + np.exp(-np.clip(model.bias + amounts @ model.weights[numbers], -40, 40)))
