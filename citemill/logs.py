"""Structured JSON logging."""

from __future__ import annotations

import json
import logging
from datetime import datetime, timezone

_STANDARD = set(logging.makeLogRecord({}).__dict__) | {"message", "asctime"}


class JsonFormatter(logging.Formatter):
    """One JSON object per record: event, level, logger, timestamp and extras."""

    def format(self, record: logging.LogRecord) -> str:
        extras = {k: v for k, v in record.__dict__.items() if k not in _STANDARD}
        stamp = datetime.fromtimestamp(record.created, timezone.utc).isoformat()
        entry = {
            "event": record.getMessage(), "level": record.levelname.lower(),
            "logger": record.name, "timestamp": stamp, **extras,
        }
        return json.dumps(entry, default=str)


def setup_logging(level: str = "INFO") -> None:
    handler = logging.StreamHandler()
    handler.setFormatter(JsonFormatter())
    root = logging.getLogger("citemill")
    root.handlers = [handler]
    root.setLevel(level)
    root.propagate = False


def get_logger(name: str) -> logging.Logger:
    return logging.getLogger(f"citemill.{name}")
