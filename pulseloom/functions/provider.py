"""Extension: labels of an external provider, in batches, with each failure kept to its row.

A provider is a factory of clients; a worker makes one client and keeps it. A batch that fails is asked again, with growing pauses; if it
still fails it is halved, until the rows that cannot be answered stand alone: these, and answers that are no label, are rows with a reason.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import slices
from ..operators.extensions import LABEL_VALUES, ext_label_contract

FIELDS = (*LABEL_VALUES, "targets", "notes")


class Client(Protocol):
    def label(self, texts: list[str]) -> list[dict | None]:
        """One answer for each text: the fields of a label."""


_clients: dict[str, Client] = {}


def _client(name: str, connect: Callable[[], Client]) -> Client:
    """The worker's client of that name."""
    if name not in _clients:
        _clients[name] = connect()
    return _clients[name]


def ask(client: Client, texts: list[str], retries: int, pause: float) -> list[tuple[dict | None, str | None]]:
    """(answer, reason) of each text."""
    why = None
    for attempt in range(retries + 1):
        if attempt:
            time.sleep(pause * 2 ** (attempt - 1))
        try:
            answers = client.label(texts)
            if len(answers) != len(texts):
                raise ValueError(f"{len(answers)} answers")
            return [(a, None) if isinstance(a, dict) else (None, "no_label") for a in answers]
        except Exception as e:  # whatever a provider does
            why = type(e).__name__
    if len(texts) == 1:
        return [(None, f"provider:{why}")]
    half = len(texts) // 2
    return ask(client, texts[:half], retries, pause) + ask(client, texts[half:], retries, pause)


def ext_provider_labels(texts: DataFrame, name: str, connect: Callable[[], Client], text: str = "text", batch: int = 64, retries: int = 2, pause: float = 0.2) -> DataFrame:
    """Adds the fields of a label and ``reject_reason``: NULL, the field that breaks the label contract, ``no_label``, or ``provider:`` and the error that stayed.

    Every row comes out once; a null text is asked as an empty one. The factory is pickled, so it should carry settings and no connection.
    """
    kept = [c for c in texts.columns if c not in (*FIELDS, "reject_reason")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = _client(name, connect)
        for b in slices(batches, "_text"):
            said = [x or "" for x in b.column(b.schema.get_field_index("_text")).to_pylist()]
            got = [r for i in range(0, len(said), batch) for r in ask(client, said[i : i + batch], retries, pause)]
            fields = [pa.array([None if a is None or a.get(f) is None else str(a[f]) for a, _ in got], pa.string()) for f in FIELDS]
            cols = [b.column(b.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, *fields, pa.array([r for _, r in got], pa.string())], names=[*kept, *FIELDS, "_failed"])

    here = texts.select(*kept, F.col(text).cast("string").alias("_text"))
    schema = ", ".join([*(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in kept), *(f"`{f}` string" for f in FIELDS), "_failed string"])
    labelled = ext_label_contract(here.mapInArrow(run, schema))
    return labelled.withColumn("reject_reason", F.coalesce("_failed", "reject_reason")).drop("_failed")


class Rehearsal:
    """A deterministic provider for tests and queries: by rules of the text alone it answers, fails, fails the first time, or answers wrongly."""

    def __init__(self) -> None:
        self.seen: set[tuple[str, ...]] = set()

    def label(self, texts: list[str]) -> list[dict | None]:
        batch = tuple(texts)
        if any("!poison" in t for t in texts):
            raise ConnectionError("refused")
        if any("!later" in t for t in texts) and batch not in self.seen:
            self.seen.add(batch)
            raise TimeoutError("not yet")
        good = {k: v[0] for k, v in LABEL_VALUES.items()} | {"targets": "market", "notes": ""}
        return [None if "!silent" in t else good | ({"stance": "sideways"} if "!odd" in t else {}) | ({"notes": None} if "!bare" in t else {}) for t in texts]
