"""Logging of the package: silent until it is set up."""

from __future__ import annotations

import logging
import sys

FORMAT = "%(asctime)s %(levelname)s %(name)s: %(message)s"


def set_up(level: str = "INFO", path: str | None = None) -> logging.Logger:
    """Messages of this level and above to standard error, or to a file; called again it only changes the level."""
    top = logging.getLogger("tidemark")
    top.setLevel(level.upper())
    if not top.handlers:
        handler = logging.FileHandler(path, encoding="utf-8", delay=True) if path else logging.StreamHandler(sys.stderr)
        handler.setFormatter(logging.Formatter(FORMAT))
        top.addHandler(handler)
        top.propagate = False
    return top
