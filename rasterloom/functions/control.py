"""Cancelling and watching jobs: what a cancellation token and a progress callback are to one decode."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass
class Control:
    """Handle on the jobs that a `controlled` block starts; usable from another thread."""

    spark: SparkSession
    tag: str
    cancelled: bool = False

    def cancel(self) -> None:
        self.cancelled = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def progress(self) -> tuple[int, int]:
        """Tasks done and tasks known of the stages that run now."""
        tracker = self.spark.sparkContext.statusTracker()
        infos = [tracker.getStageInfo(s) for s in tracker.getActiveStageIds()]
        return sum(i.numCompletedTasks for i in infos if i), sum(i.numTasks for i in infos if i)


@contextlib.contextmanager
def controlled(spark: SparkSession) -> Iterator[Control]:
    c = Control(spark, f"rasterloom-{uuid.uuid4().hex}")
    spark.sparkContext.addJobTag(c.tag)
    try:
        yield c
    finally:
        spark.sparkContext.removeJobTag(c.tag)
