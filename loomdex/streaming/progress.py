"""Progress of incremental runs: one line for each micro-batch."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger("loomdex.progress")


def line(done: int, total: int | None, correct: int, elapsed: float) -> str:
    """A status line; accuracy and rate are 0 before anything is done."""
    of = f"{done}/{total}" if total else str(done)
    accuracy = correct / done if done else 0.0
    rate = done / elapsed if elapsed > 0 else 0.0
    return f"{of} questions, accuracy {accuracy:.4f}, {rate:.2f} a second"


class Heartbeat(StreamingQueryListener):
    """Tells of every batch, and of waiting, by `say`."""

    def __init__(self, say: Callable[[str], None] = log.info):
        self.say = say

    def onQueryStarted(self, event) -> None:
        self.say(f"started {event.name or event.id}")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.say(f"batch {p.batchId}: {p.numInputRows} rows")

    def onQueryIdle(self, event) -> None:
        self.say("waiting")

    def onQueryTerminated(self, event) -> None:
        self.say("failed: " + event.exception if event.exception else "ended")
