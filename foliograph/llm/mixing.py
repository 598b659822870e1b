"""Mixing documents to target domain weights by soft membership.

A classifier learned from a labelled table gives every document a posterior
over domains; a document's tokens belong to the domains in these parts. What is
sought are document rates r >= 0 (expected copies) whose expected token totals
by domain meet the targets in the least-squares sense:

    minimise  1/2 (s(r) - t)' M^-1 (s(r) - t),    s_k = sum_d r_d n_d p_dk / N

M is the second moment of the posteriors, so the gradient has curvature one and
a unit step is right at any corpus size. Projected gradient starts from r = 1,
so that the rates are the current mixture where it meets the targets already.
An iteration is one pass over the posteriors that brings K sums to the driver;
rates are never stored between iterations, because a document's rate follows
from its posterior and the few gradients seen so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.llm.common import cut, small_batches, table, text_bytes, windows
from foliograph.llm.ngrams import Model, fit_frame, probabilities, sample

#: Production targets: shares of the corpus's tokens by domain of the labelled table.
TARGETS = {"high": 0.88, "low": 0.08, "toxic": 0.04}


@dataclass(frozen=True)
class Classifier:
    """N-gram regressions, one for each domain, whose probabilities are scaled to sum 1."""

    domains: tuple[str, ...]
    model: Model

    def posterior(self, text: bytes) -> tuple[int, np.ndarray]:
        """(tokens, membership by domain); tokens are words, and a text without features has the prior's memberships."""
        own = probabilities(self.model, text)
        return len(text.split()), own / own.sum() if len(own) else own


def learn(docs: DataFrame, labelled: DataFrame, sample_rows: int = 4000, longest: int = 65_536, characters: int = 32 << 20, domains: int = 256) -> Classifier:
    """The classifier of about ``sample_rows`` rows of ``labelled`` (doc_id, domain).

    The rows are chosen by a hash of their id, one for each id; a text gives its
    first ``longest`` characters, or fewer where the sample would be more than
    ``characters``. Of the n-grams the 2,000 surest are kept. An id with several
    labels counts for the first by name; more than ``domains`` domains are
    refused.
    """
    marks = labelled.select(F.col("doc_id").alias("id"), F.col("domain").cast("string").alias("domain"))
    marks = marks.filter("id IS NOT NULL AND domain IS NOT NULL").groupBy("id").agg(F.min("domain").alias("label"))
    rows = sample(docs, marks, sample_rows, longest, characters)
    names = [r[0] for r in rows.select("label").distinct().limit(domains + 1).collect()]
    if len(names) > domains:
        raise ValueError(f"more than {domains} domains")
    if not names:
        return Classifier((), fit_frame(rows.select("id", F.lit(0).alias("label"), "body"), 0))
    number = F.array_position(F.array(*[F.lit(d) for d in sorted(names)]), F.col("label")).cast("int") - 1
    return Classifier(tuple(sorted(names)), fit_frame(rows.select("id", number.alias("label"), "body"), len(names), most=2_000))


def rates(posteriors: np.ndarray, gradients: list[np.ndarray]) -> np.ndarray:
    """Rates after the projected steps along these gradients, from 1."""
    own = np.ones(len(posteriors))
    for g in gradients:
        own = np.maximum(0.0, own - posteriors @ g)
    return own


@dataclass(frozen=True)
class Mixture:
    classifier: Classifier
    gradients: list[np.ndarray]
    wanted: dict[str, float]  # token totals
    reached: dict[str, float]


def memberships(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """(doc_id, n_tokens, p): p has the domains in the classifier's order."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in windows(batches, "body"):
            found = [model.posterior(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([p.tolist() for _, p in found], pa.list_(pa.float64()))],
                ["doc_id", "n_tokens", "p"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, p array<double>")


def _matrix(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
    return sizes, batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def solve(members: DataFrame, classifier: Classifier, targets: dict[str, float], budget: float = 1.0, steps: int = 40, tolerance: float = 1e-4) -> Mixture:
    """Projected gradient to targets; domains without a target get weight zero.

    ``targets`` are relative weights, ``budget`` is the wanted total as a share
    of the present tokens. It stops when no domain's share moves by more than
    ``tolerance`` or after ``steps`` passes.
    """
    k = len(classifier.domains)
    if not k:
        return Mixture(classifier, [], {}, {})
    weight = sum(targets.values()) or 1.0
    goal = budget * np.array([targets.get(d, 0.0) / weight for d in classifier.domains])

    def sums(gradients: list[np.ndarray], second: bool) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, moments = np.zeros(k), np.zeros(k * k)
            tokens = 0.0
            for batch in batches:
                n, p = _matrix(batch, k)
                total += (rates(p, gradients) * n) @ p
                tokens += n.sum()
                if second:
                    moments += np.einsum("d,di,dj->ij", n, p, p).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(([tokens], total, moments)).tolist()], pa.list_(pa.float64()))], ["x"])

        parts = members.select("n_tokens", "p").mapInArrow(run, "x array<double>")
        row = parts.agg(*[F.sum(F.col("x")[i]) for i in range(1 + k + k * k)]).head()
        return np.array([x or 0.0 for x in row])

    first = sums([], True)
    tokens, share = max(first[0], 1.0), first[1 : 1 + k] / max(first[0], 1.0)
    moment = first[1 + k :].reshape(k, k) / tokens
    whiten = np.linalg.pinv(moment + 1e-6 * np.eye(k))
    gradients: list[np.ndarray] = []
    while len(gradients) < steps:
        gradients.append(whiten @ (share - goal))
        new = sums(gradients, False)[1 : 1 + k] / tokens
        still, share = np.abs(new - share).max() <= tolerance, new
        if still:
            break
    named = lambda x: dict(zip(classifier.domains, (x * tokens).tolist(), strict=True))
    return Mixture(classifier, gradients, named(goal), named(share))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float = 1.0) -> tuple[DataFrame, Mixture]:
    """(doc_id, n_tokens, rate, memberships) for every row, and the mixture.

    Null and empty texts have no token and the prior's memberships; texts of any
    length are scored whole; repeated rows are rated alike, a row each; an empty
    table gives none. Without any label there is no domain and every rate is 1.
    """
    classifier = learn(docs, labelled)
    members = cut(memberships(docs, classifier))
    mixture = solve(members, classifier, targets, budget)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, p = _matrix(batch.select(["n_tokens", "p"]), len(classifier.domains)) if classifier.domains else (None, np.zeros((batch.num_rows, 0)))
            rate = rates(p, mixture.gradients)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rate), batch.column(2)], ["doc_id", "n_tokens", "rate", "memberships"])

    return members.mapInArrow(run, "doc_id long, n_tokens long, rate double, memberships array<double>"), mixture


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labels table: toxic, else high or low quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every document's tokens, rate and domain memberships, with what each domain should get and gets."""
    rated, mixture = mix(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")), TARGETS)
    domains = mixture.classifier.domains
    return rated.select(
        "doc_id", "n_tokens", "rate",
        *[F.col("memberships")[k].alias(f"p_{d}") for k, d in enumerate(domains)],
        *[F.lit(mixture.wanted[d]).alias(f"wanted_{d}") for d in domains],
        *[F.lit(mixture.reached[d]).alias(f"reached_{d}") for d in domains],
    )


def resample(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float = 1.0) -> DataFrame:
    """The rows of ``docs`` in the numbers that their rates ask for.

    A row with rate r comes floor(r) times, and once more with probability
    r - floor(r), decided by a hash of id and text. Rates are worked out again
    row by row in the scan, so no text is shuffled and columns of any name pass
    through untouched. Null texts and null ids are rows like any other; without
    any label every row comes once, and an empty table gives none.
    """
    classifier = learn(docs, labelled)
    mixture = solve(cut(memberships(docs, classifier)), classifier, targets, budget)
    shared = docs.sparkSession.sparkContext.broadcast(mixture)

    @F.arrow_udf("double")
    def rate(texts: pa.Array) -> pa.Array:
        model = shared.value.classifier
        found = [model.posterior((t.as_py() or "").encode("utf-8", "replace"))[1] for t in texts]
        return pa.array(rates(np.array(found).reshape(len(found), len(model.domains)), shared.value.gradients))

    chance = F.pmod(F.xxhash64(docs["doc_id"].cast("string"), docs["text"].cast("string")), F.lit(1 << 40)) / float(1 << 40)
    copies = F.floor(rate(docs["text"].cast("string")) + chance).cast("int")
    name = "__copy" + "_" * max([0, *map(len, docs.columns)])  # no column of docs has this name
    return docs.select("*", F.explode(F.array_repeat(F.lit(0), copies)).alias(name)).drop(name)
