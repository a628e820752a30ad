"""How long calls take, and how fast streams run."""

from __future__ import annotations

import functools
import logging
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql.streaming import StreamingQueryListener

from tessera.functions.fingerprints import format_time, short_time

log = logging.getLogger("tessera")


def timed(function: Callable[..., Any]) -> Callable[..., Any]:
    """Logs the time that each call takes; ``last_seconds`` of the function has the last one."""

    @functools.wraps(function)
    def run(*args: Any, **kwargs: Any) -> Any:
        start = time.perf_counter()
        try:
            return function(*args, **kwargs)
        finally:
            run.last_seconds = time.perf_counter() - start
            log.info("%s took %s", function.__name__, format_time(run.last_seconds))

    run.last_seconds = None
    return run


class Throughput(StreamingQueryListener):
    """Counts the rows of the streams of a session and logs their rate after each batch; ``total``, if known, gives what is left."""

    def __init__(self, total: int | None = None):
        self.total, self.rows, self.batches, self.ended = total, 0, 0, 0
        self.start = time.perf_counter()

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        if not (rows := event.progress.numInputRows):
            return
        self.rows += rows
        self.batches += 1
        rate = self.rows / max(time.perf_counter() - self.start, 1e-9)
        left = f", {short_time((self.total - self.rows) / rate)} left" if self.total and rate else ""
        log.info("%d rows, %.0f a second%s", self.rows, rate, left)

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        self.ended += 1
