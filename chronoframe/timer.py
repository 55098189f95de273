"""A timer that sums intervals."""

from __future__ import annotations

import time


class Timer:
    """``with Timer() as t`` or start and stop, any number of times; ``total`` is in seconds."""

    def __init__(self, running: bool = False):
        self.total, self._since = 0.0, None
        if running:
            self.start()

    def start(self) -> Timer:
        if self._since is None:
            self._since = time.monotonic()
        return self

    def stop(self) -> float:
        if self._since is not None:
            self.total, self._since = self.total + time.monotonic() - self._since, None
        return self.total

    def reset(self) -> None:
        self.total, self._since = 0.0, None

    __enter__ = start

    def __exit__(self, *_) -> None:
        self.stop()
