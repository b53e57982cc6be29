"""Logging to the console and a file, and timing of steps."""

from __future__ import annotations

import logging
import time

NAME = "quireflow"


def setup(level: str = "INFO", file: str = "") -> logging.Logger:
    log = logging.getLogger(NAME)
    log.setLevel(level.upper())
    log.handlers.clear()
    for handler in (logging.StreamHandler(), *([logging.FileHandler(file)] if file else [])):
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(handler)
    return log


def get(name: str = "") -> logging.Logger:
    return logging.getLogger(f"{NAME}.{name}" if name else NAME)


class timed:  # noqa: N801
    """Logs how long a block took, or that it failed; `seconds` has the time afterwards."""

    def __init__(self, what: str, log: logging.Logger | None = None):
        self.what, self.log, self.seconds = what, log or get(), 0.0

    def __enter__(self) -> timed:
        self.began = time.monotonic()
        self.log.info("%s begins", self.what)
        return self

    def __exit__(self, kind, error, trace) -> None:
        self.seconds = time.monotonic() - self.began
        if error is None:
            self.log.info("%s took %.1f s", self.what, self.seconds)
        else:
            self.log.error("%s failed after %.1f s: %s", self.what, self.seconds, error)
