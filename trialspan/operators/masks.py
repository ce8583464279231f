"""Answer masks: spans of characters to tokens, labels, and padded batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

IGNORED = -100


_TOKEN = re.compile(r"<<|>>|[A-Za-z0-9]+|[^A-Za-z0-9\s]")
_SPAN = re.compile(r"<<\s*(.*?)\s*>>", re.S)


def token_offsets(text: str) -> np.ndarray:
    """(start, end) of words, markers and single signs; for use where no tokenizer is given."""
    return np.array([m.span() for m in _TOKEN.finditer(text)], np.int64).reshape(-1, 2)


def overlapping(tokens: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens overlap a span: the token ends behind the span's start and starts before its end.

    The spans are in order and do not overlap, so one search by end and one by start tell it.
    Spans without characters overlap the token that they stand within.
    """
    if not len(tokens) or not len(spans):
        return np.zeros(len(tokens), bool)
    ended = np.searchsorted(spans[:, 1], tokens[:, 0], "right")
    begun = np.searchsorted(spans[:, 0], tokens[:, 1], "left")
    return begun > ended


def answer_labels(df: DataFrame, key: str, text: str, tokenize: Callable[[str], np.ndarray] = token_offsets) -> DataFrame:
    """(key, n_tokens, n_spans, ids, labels): token numbers, and the same within answer spans, else the ignored label.

    Null texts have no row; a text without spans has ignored labels only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, n_spans = [], [], []
            for t in batch.column(1).to_pylist():
                spans = np.array([m.span(1) for m in _SPAN.finditer(t)], np.int64).reshape(-1, 2)
                tokens = tokenize(t)
                numbers = np.arange(len(tokens))
                ids.append(numbers)
                labels.append(np.where(overlapping(tokens, spans), numbers, IGNORED))
                n_spans.append(len(spans))
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(i) for i in ids], pa.int32()), pa.array(n_spans, pa.int32()), pa.array(ids, kind), pa.array(labels, kind)],
                names=[key, "n_tokens", "n_spans", "ids", "labels"],
            )

    return df.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, n_tokens int, n_spans int, ids array<long>, labels array<long>")


def collate(rows: DataFrame, position: str, ids: str, labelled: str, batch: int, multiple: int = 8, pad: int = 0) -> DataFrame:
    """Batches of ``batch`` rows by position, padded on the right to the longest, rounded up to a multiple.

    Adds ``batch_id``, ``input_ids``, ``labels`` and ``attention_mask``.
    """
    from pyspark.sql import Window as W

    rows = rows.withColumn("batch_id", F.floor(F.col(position) / batch).cast("long"))
    longest = F.max(F.size(ids)).over(W.partitionBy("batch_id"))
    rows = rows.withColumn("_width", (F.ceil(longest / multiple) * multiple).cast("int")).withColumn("_gap", F.col("_width") - F.size(ids))

    def padded(c: str, fill: int) -> Column:
        return F.concat(F.col(c), F.array_repeat(F.lit(fill), F.col("_gap")))

    mask = F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), F.col("_gap")))
    return rows.select("batch_id", position, padded(ids, pad).alias("input_ids"), padded(labelled, IGNORED).alias("labels"), mask.alias("attention_mask"))
