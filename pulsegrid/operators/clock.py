"""When the clock becomes right: polling it, and telling those who wait."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pulsegrid.operators.event_log import Clock

Listener = Callable[[int, int], None]
PERIOD = 1.0


class ClockMonitor:
    """Polls a clock until it is synchronized and then tells each listener once: (sync second, adjustment in seconds).

    The adjustment is the sync second less the second the monitor started at. Without a
    clock, or once it is synchronized, a new listener is told at once, with adjustment 0.
    ``now`` gives whole seconds. Listeners are told under ``lock``, which an owner shares so
    that neither waits for the other.
    """

    def __init__(self, clock: Clock | None = None, now: Callable[[], int] = lambda: int(time.time()), lock: threading.RLock | None = None):
        self.clock, self.now = clock, now
        self.started = now()
        self.listeners: list[Listener] = []
        self.synchronized = clock is None
        self.timer: threading.Timer | None = None
        self.lock, self.stopped = lock or threading.RLock(), False

    def register(self, listener: Listener) -> None:
        with self.lock:
            if not self.synchronized:
                self.listeners.append(listener)
                return
        listener(self.now(), 0)

    def poll(self) -> bool:
        """Ask the clock once; True if it is synchronized."""
        with self.lock:
            if self.synchronized or not self.clock.synchronized():
                return self.synchronized
            self.synchronized = True
            second, waiting, self.listeners = self.now(), self.listeners, []
            for listener in waiting:
                listener(second, second - self.started)
        return True

    def start(self) -> None:
        """Poll every second on a thread of its own until the clock is synchronized."""
        if not self.stopped and not self.poll():
            self.timer = threading.Timer(PERIOD, self.start)
            self.timer.daemon = True
            self.timer.start()

    def stop(self) -> None:
        self.stopped = True
        if self.timer:
            self.timer.cancel()
