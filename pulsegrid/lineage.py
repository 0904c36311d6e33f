"""Run lineage: start, complete and fail events as JSON lines. A failure to emit never fails the job."""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

LOG = logging.getLogger(__name__)


def file_emitter(path: str) -> Callable[[dict], None]:
    def emit(event: dict) -> None:
        with open(path, "a", encoding="utf-8") as out:
            out.write(json.dumps(event, sort_keys=True) + "\n")

    return emit


def safely(emit: Callable[[dict], None], event: dict) -> bool:
    """Emits an event; gives False, with a warning, where that fails."""
    try:
        emit(event)
    except Exception as error:  # noqa: BLE001
        LOG.warning("lineage event was not emitted: %s", error)
        return False
    return True


@contextmanager
def run(emit: Callable[[dict], None], job: str, inputs: list[str], outputs: list[str]) -> Iterator[str]:
    """Brackets a job with a START and a COMPLETE event, or a FAIL event where it raises; gives the run's id."""
    run_id = str(uuid.uuid4())

    def event(state: str) -> dict:
        return {"eventType": state, "eventTime": datetime.now(UTC).isoformat(), "run": {"runId": run_id}, "job": {"name": job}, "inputs": [{"name": n} for n in inputs], "outputs": [{"name": n} for n in outputs]}

    safely(emit, event("START"))
    try:
        yield run_id
    except BaseException:
        safely(emit, event("FAIL"))
        raise
    safely(emit, event("COMPLETE"))


def model_edges(models: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(input, output) pairs of models and the relations that they read."""
    return sorted((i, o) for o, inputs in models.items() for i in inputs)
