"""Pacing of calls to a service from within tasks."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable


class Pace:
    """Lets calls through at most ``per_second`` times a second, whatever the threads; a task that shares the rate with others takes its part of it."""

    def __init__(self, per_second: float, tasks: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        if per_second <= 0 or tasks < 1:
            raise ValueError("a rate must be above 0")
        self._gap, self._clock, self._sleep = tasks / per_second, clock, sleep
        self._next, self._lock = 0.0, threading.Lock()

    def wait(self) -> None:
        """Returns when the next call may go; each caller gets a time of its own."""
        with self._lock:
            now = self._clock()
            at = max(now, self._next)
            self._next = at + self._gap
        if at > now:
            self._sleep(at - now)


def retried(call: Callable, times: int = 5, first: float = 0.5, pace: Pace | None = None, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call`` tried up to ``times`` times, with waits that double from ``first`` seconds on; the last error is raised."""

    def tried(*args, **kwargs):
        for i in range(times):
            if pace is not None:
                pace.wait()
            try:
                return call(*args, **kwargs)
            except Exception:  # noqa: BLE001
                if i == times - 1:
                    raise
                sleep(first * 2**i)

    return tried
