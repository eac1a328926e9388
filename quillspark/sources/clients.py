"""A client of a remote source: one transport, at most so many calls a second, closed when done."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any


class Client:
    """Calls answer(...) no more often than `per_second`; a closed client answers no more.

    Each task that fetches makes its own, so the rate of a job is that of a client times its tasks; for one rate over all,
    rows go through one partition.
    """

    def __init__(
        self, answer: Callable[..., Any], per_second: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep,
        close: Callable[[], None] | None = None,
    ):
        if per_second <= 0:
            raise ValueError("per_second must be above 0")
        self._answer, self._gap, self._clock, self._sleep, self._close = answer, 1.0 / per_second, clock, sleep, close
        self._last: float | None = None
        self.calls, self.closed = 0, False

    def __call__(self, *given, **more):
        if self.closed:
            raise RuntimeError("the client is closed")
        if self._last is not None and (left := self._last + self._gap - self._clock()) > 0:
            self._sleep(left)
        self._last = self._clock()
        self.calls += 1
        return self._answer(*given, **more)

    def close(self) -> None:
        if not self.closed and self._close:
            self._close()
        self.closed = True

    def __enter__(self) -> Client:
        return self

    def __exit__(self, *_) -> None:
        self.close()
