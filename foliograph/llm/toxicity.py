"""Toxicity scores from a character n-gram classifier with naive Bayes scaling.

The classifier of ``foliograph.llm.ngrams`` learns the toxic label from labelled
text that is not held out, and scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.llm.common import held_out, small_batches, table, text_bytes, windows
from foliograph.llm.ngrams import Model, fit_frame, probabilities, sample

THRESHOLD = 0.3


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, longest: int = 65_536, characters: int = 48 << 20) -> Model:
    """The model of about ``sample_rows`` labelled rows that are not held out.

    The rows are chosen by a hash of their id, one for each id, and carry
    toxic = 0 or 1; where an id has several labels the larger counts. A text
    gives its first ``longest`` characters, or fewer where the sample would be
    more than ``characters``. Of the n-grams the 20,000 surest are kept, whose
    ratios are three standard errors from zero. Nothing else is bounded. Without
    any such row nothing is toxic: every score is 0.
    """
    marks = labels.filter(F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.filter(F.col("id").isNotNull() & ~held_out("id")).groupBy("id").agg(F.max("toxic").alias("label"))
    return fit_frame(sample(docs, marks, sample_rows, longest, characters), 2)


def rate(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row.

    Only the text decides, the whole of it. Null and empty texts score as a
    text without any feature does; without labels every score is 0 (to 17
    digits) and nothing is predicted toxic; repeated rows give repeated rows and
    an empty table none.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in windows(batches, "body"):
            scores = [float(probabilities(own, t)[1]) for t in batch.column(2).to_pylist()]
            verdicts = [int(s >= threshold) for s in scores]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(verdicts, pa.int32())],
                ["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_bytes().alias("body"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: doc_id, held_out, score, predicted for every document."""
    docs = table(spark, sf_dir, "documents")
    return rate(docs, learn(docs, table(spark, sf_dir, "labels")))
