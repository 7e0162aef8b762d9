"""Logging with five levels, of which the last is silence."""

from __future__ import annotations

import logging

DEBUG, INFO, WARN, ERROR, SILENT = range(5)
_LEVELS = {DEBUG: logging.DEBUG, INFO: logging.INFO, WARN: logging.WARNING, ERROR: logging.ERROR, SILENT: logging.CRITICAL + 1}
logger = logging.getLogger("docloom")


def set_level(level: int) -> None:
    logger.setLevel(_LEVELS[level])


def plain(message: str) -> None:
    """Print at any level but silence."""
    if logger.level <= logging.CRITICAL:
        print(message)


set_level(INFO)
