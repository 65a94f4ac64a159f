"""The seam for a model that reads documents: typed responses, errors as rows, batch timing.

A model is a function from a list of requests (dicts of the request's columns)
to a list of answers (text and confidence, or an exception in an answer's
place). It is loaded once in each Python worker. A batch that raises is tried
again request by request, so an error costs no more than its own row; ids come
from the rows, so a repeated task gives the same rows again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

RESPONSE = "doc_id long, text string, confidence double, error string, batch_size int, batch_place int, seconds double"

Answer = tuple[str | None, float | None]
Model = Callable[[list[dict[str, Any]]], list[Answer | Exception]]


def _told(e: BaseException) -> str:
    return f"{type(e).__name__}: {e}"


def _answers(model: Model, requests: list[dict[str, Any]]) -> list[Answer | Exception]:
    """One answer for each request; where the model fails as a whole, each request is asked alone."""
    try:
        out = list(model(requests))
        if len(out) != len(requests):
            raise ValueError(f"{len(out)} answers to {len(requests)} requests")
        return out
    except Exception as whole:
        if len(requests) == 1:
            return [whole]
    return [_answers(model, [r])[0] for r in requests]


def asked(docs: DataFrame, load: Callable[[], Model], *, batch_size: int = 16, id_col: str = "doc_id") -> DataFrame:
    """RESPONSE for each row of docs: the model's answer or its error, and the time of its batch, shared evenly.

    `load` is called once in each task and gives the model; if it fails, every
    row of the task carries that error. The model gets `batch_size` requests at a time;
    frames, which Arrow's batches bound, come and go as a whole.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, broken = None, None
        try:
            model = load()
        except Exception as e:
            broken = e
        for frame in frames:
            requests, rows = frame.to_dict("records"), []
            for at in range(0, len(requests), batch_size):
                part = requests[at : at + batch_size]
                began = time.perf_counter()
                answers = [broken] * len(part) if broken else _answers(model, part)
                took = (time.perf_counter() - began) / len(part)
                for k, (r, a) in enumerate(zip(part, answers, strict=True)):
                    key = r[id_col]
                    text, sure, error = (None, None, _told(a)) if isinstance(a, BaseException) else (*a, None)
                    rows.append((None if pd.isna(key) else int(key), text, sure, error, len(part), k, took))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "confidence", "error", "batch_size", "batch_place", "seconds"]).astype({"doc_id": "Int64", "confidence": "float64"})

    return docs.mapInPandas(run, RESPONSE)


def placeholder(requests: list[dict[str, Any]]) -> list[Answer | Exception]:
    """A model that answers with the first line of a request's text, surer for longer ones; a request without text is an error."""
    out: list[Answer | Exception] = []
    for r in requests:
        text = r.get("text")
        out.append((text.split("\n")[0], min(1.0, len(text) / 1000)) if text else ValueError("no text"))
    return out
