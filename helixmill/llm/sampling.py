"""Bounded samples of labelled rows for fitting classifiers on the driver."""

from __future__ import annotations

from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_checked

#: Code points that a document gives to a sample at most, and all of a sample's together; a longer text gives a stretch
#: from a place that a hash of its id chooses. Scoring reads whole texts of any length.
SAMPLE_CHARS, TOTAL_CHARS, LEAST_CHARS = 200_000, 200_000_000, 1000


def sample_ids(rows: DataFrame, label: str, per_label: int, labels: int | None = None) -> list[tuple]:
    """(doc_id, label, hash) of up to ``per_label`` rows of each label value, or of the ``labels`` first, by smallest hash of the id.

    A label may hold most rows, so only ids whose hash is below four times the share wanted of the label are gathered,
    some 4 * per_label of each.
    """
    hashed = rows.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", label).distinct()
    hashed = hashed.withColumn("_hash", F.shiftrightunsigned(F.xxhash64("doc_id"), 1))
    counts = hashed.groupBy(label).count()
    counts = counts if labels is None else counts.orderBy(label).limit(labels)
    low = join_checked(hashed, counts, label).filter(F.col("_hash") < F.lit(2.0**63) * 4 * per_label / F.col("count"))
    found: dict = {}
    for doc_id, of, at in low.select("doc_id", label, "_hash").collect():
        found.setdefault(of, []).append((at, doc_id))
    chosen = [(doc_id, of, at) for of, ids in found.items() for at, doc_id in islice(sorted(ids), per_label)]
    return sorted(chosen, key=lambda x: (x[2], x[0], str(x[1])))


def sample_texts(docs: DataFrame, ids: list[tuple]) -> list[tuple[str, object]]:
    """(text, label) of the sampled documents in the order of ids, of rows that repeat an id one; the ids are a bounded list, so they are broadcast."""
    if not ids:
        return []
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    chars = max(LEAST_CHARS, min(SAMPLE_CHARS, TOTAL_CHARS // len(ids)))
    wanted = spark.createDataFrame([(x[0],) for x in ids], f"doc_id {kind.simpleString()}").distinct()
    place = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - chars, F.lit(0)) + 1).cast("int") + 1
    stretch = F.when(F.length("text") > chars, F.substring("text", place, F.lit(chars))).otherwise(F.col("text"))
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").select("doc_id", stretch.alias("text")).filter("text is not null")
    texts = dict(tuple(r) for r in rows.groupBy("doc_id").agg(F.max("text")).collect())
    return [(texts[i], label) for i, label, *_ in ids if i in texts]


def fit_logistic(x, y, weight=None, ridge: float = 0.1, steps: int = 60):
    """Weights of a logistic regression with an intercept first, by Newton steps."""
    import numpy as np

    a = np.column_stack([np.ones(len(x)), x])
    weight = np.ones(len(a)) if weight is None else weight
    penalty = ridge * np.eye(a.shape[1])
    penalty[0, 0] = 1e-3
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (p - y)) + penalty @ w
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + penalty, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w
