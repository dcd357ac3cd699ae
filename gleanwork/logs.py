"""A log file for each day. Logging never raises."""

from __future__ import annotations

import logging
import os
from datetime import datetime


class DailyFile(logging.Handler):
    """Lines ``[HH:mm:ss.fff] [LEVEL] message`` in ``<prefix>-yyyy-MM-dd.log``."""

    def __init__(self, folder: str, prefix: str = "gleanwork"):
        super().__init__()
        self.folder, self.prefix = folder, prefix

    def emit(self, record: logging.LogRecord) -> None:
        try:
            at = datetime.fromtimestamp(record.created)
            os.makedirs(self.folder, exist_ok=True)
            with open(os.path.join(self.folder, f"{self.prefix}-{at:%Y-%m-%d}.log"), "a", encoding="utf-8") as f:
                f.write(f"[{at:%H:%M:%S}.{at.microsecond // 1000:03d}] [{record.levelname}] {record.getMessage()}\n")
                if record.exc_info:
                    f.write(logging.Formatter().formatException(record.exc_info) + "\n")
        except Exception:  # a full disk or a wrong message must not stop what is logged
            return
