"""Pausing, cancelling and measuring a run."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass


class Cancelled(Exception):
    """The run was asked to stop."""


class RunControl:
    """Pause, resume and cancel between steps of a run; time spent paused is kept apart."""

    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self._clock, self._lock = clock, threading.Lock()
        self._go = threading.Event()
        self._go.set()
        self._since: float | None = None
        self._paused = 0.0
        self._stop = False

    @property
    def is_paused(self) -> bool:
        return not self._go.is_set()

    def pause(self) -> None:
        with self._lock:
            if self._since is None:
                self._since = self._clock()
                self._go.clear()

    def resume(self) -> None:
        with self._lock:
            if self._since is not None:
                self._paused += self._clock() - self._since
                self._since = None
            self._go.set()

    def reset(self) -> None:
        """Forget all pauses and let waiting runs go on."""
        with self._lock:
            self._since, self._paused, self._stop = None, 0.0, False
            self._go.set()

    def cancel(self) -> None:
        self._stop = True
        self._go.set()

    def total_paused(self) -> float:
        """Seconds paused, the present pause included."""
        with self._lock:
            return self._paused + (self._clock() - self._since if self._since is not None else 0.0)

    def checkpoint(self, timeout: float | None = None) -> None:
        """Wait while paused; raise if cancelled."""
        if not self._stop:
            self._go.wait(timeout)
        if self._stop:
            raise Cancelled


@dataclass
class Progress:
    """Counters of a run so far."""

    total: int = 0
    scanned: int = 0
    unchanged: int = 0
    indexed: int = 0
    failed: int = 0
    removed: int = 0
    bytes_indexed: int = 0
    seconds: float = 0.0

    @property
    def percent(self) -> float:
        most = max(self.total, self.scanned)
        return min(100.0, 100.0 * self.scanned / most) if most else 0.0

    @property
    def files_per_second(self) -> float:
        return self.scanned / self.seconds if self.seconds > 0 else 0.0

    @property
    def seconds_left(self) -> float | None:
        return max(0, self.total - self.scanned) / self.files_per_second if self.files_per_second else None
