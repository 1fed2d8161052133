"""Merging on a schedule, beside the work of a store."""

from __future__ import annotations

import logging
import threading

from logloom.api import ClosedError, ConflictError, KeyedLog
from logloom.functions.scalars import jittered

log = logging.getLogger(__name__)


def merge_regularly(store: KeyedLog, stop: threading.Event) -> threading.Thread | None:
    """Checks again and again, at jittered intervals, whether to merge; ends when ``stop`` is set or the
    store closed. None if the policy is never. A merge that fails is logged and tried again later."""
    conf = store.conf.merge
    if conf.policy == "never":
        return None

    def run() -> None:
        while not stop.wait(jittered(conf.check_interval_ms, conf.check_jitter) / 1000):
            try:
                store.maybe_merge()
            except ClosedError:
                return
            except ConflictError as e:
                log.warning("merge gave way to another writer: %s", e)
            except Exception:
                log.exception("merge failed")

    thread = threading.Thread(target=run, name="merges", daemon=True)
    thread.start()
    return thread
