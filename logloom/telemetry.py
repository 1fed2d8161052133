"""What the store does, as one line of JSON for each event."""

from __future__ import annotations

import datetime
import json
import logging
import sys

_OWN = set(vars(logging.makeLogRecord({}))) | {"message", "asctime"}


class JsonLines(logging.Formatter):
    """``timestamp, level, target, message``, then the event's own fields, then the error if there is one."""

    def format(self, record: logging.LogRecord) -> str:
        at = datetime.datetime.fromtimestamp(record.created, datetime.timezone.utc)
        line = {"timestamp": at.isoformat(), "level": record.levelname, "target": record.name, "message": record.getMessage()}
        line |= {k: v for k, v in vars(record).items() if k not in _OWN}
        if record.exc_info:
            line["error"] = self.formatException(record.exc_info)
        return json.dumps(line, default=str)


def start(level: str = "INFO", stream=None) -> logging.Handler:
    """Writes the package's events to standard output, or to ``stream``. A second start replaces the first."""
    logger = logging.getLogger("logloom")
    for old in [h for h in logger.handlers if isinstance(h.formatter, JsonLines)]:
        logger.removeHandler(old)
    handler = logging.StreamHandler(stream or sys.stdout)
    handler.setFormatter(JsonLines())
    logger.addHandler(handler)
    logger.setLevel(level)
    return handler
