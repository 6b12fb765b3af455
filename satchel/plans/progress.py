"""Progress and cancelling of long jobs."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

EVERY_S, LEAST_STEP = 0.1, 5.0  #: a report at most so often, unless so many percent were done


MAPPED_S, MAPPED_STEP = 0.2, 2.0  #: the same for callbacks of a part of a larger job


def mapped(callback: Callable[[float, str], bool | None], low: float, high: float, every_s: float = MAPPED_S, least_step: float = MAPPED_STEP) -> Callable[[float, str], bool | None]:
    """A callback for one part of a job: its 0 to 100 % are ``low`` to ``high`` % of the whole.

    Reports that come sooner than ``every_s`` after the last one and are less than ``least_step``
    beyond it are left out, but for the first and the end; a stop is never left out.
    """
    told = {"at": float("-inf"), "percent": float("-inf"), "go": None}

    def report(percent: float, label: str) -> bool | None:
        whole, now = low + (high - low) * min(max(percent, 0.0), 100.0) / 100.0, time.monotonic()
        if percent < 100 and now - told["at"] < every_s and whole - told["percent"] < least_step:
            return told["go"]
        told.update(at=now, percent=whole, go=callback(whole, label))
        return told["go"]

    return report


class Cancelled(RuntimeError):
    """The progress callback asked to stop."""


@contextmanager
def reported(spark: SparkSession, callback: Callable[[float, str], bool | None], label: str = "") -> Iterator[str]:
    """Run jobs in a group of their own and tell ``callback(percent, label)`` how far they are.

    A callback that returns False cancels the group, and ``Cancelled`` is raised here.
    """
    group, done, stopped = f"satchel-{uuid.uuid4().hex}", threading.Event(), threading.Event()
    context = spark.sparkContext
    context.setJobGroup(group, label or group, interruptOnCancel=True)
    tracker = context.statusTracker()

    def watch() -> None:
        last, told = -LEAST_STEP, 0.0
        while not done.wait(EVERY_S):
            stages = [s for j in tracker.getJobIdsForGroup(group) if (i := tracker.getJobInfo(j)) for k in i.stageIds if (s := tracker.getStageInfo(k))]
            total = sum(s.numTasks for s in stages)
            percent = 100.0 * sum(s.numCompletedTasks for s in stages) / total if total else 0.0
            if percent - last < LEAST_STEP and time.time() - told < 10 * EVERY_S:
                continue
            last, told = percent, time.time()
            if callback(percent, label) is False:
                stopped.set()
                context.cancelJobGroup(group)

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield group
    except Exception as e:
        if stopped.is_set():
            raise Cancelled(label) from e
        raise
    finally:
        done.set()
        watcher.join()
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)
    if not stopped.is_set():
        callback(100.0, label)
