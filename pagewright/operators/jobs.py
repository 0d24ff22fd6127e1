"""Long work that tells its stages and can be cancelled: Spark's jobs of a run belong to one group."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")


class Cancelled(Exception):
    """The run was cancelled; what it had put out is gone."""


class Run:
    """One piece of work in stages. ``report`` gets the name of each stage as it begins, and ``done`` or ``cancelled`` at the end."""

    def __init__(self, spark: SparkSession, report: Callable[[str], None] | None = None):
        self.context, self.report = spark.sparkContext, report or (lambda stage: None)
        self.group = f"run-{uuid.uuid4().hex}"
        self.stopped = threading.Event()

    def stage(self, name: str) -> None:
        """Begin a stage, unless the run is cancelled: later jobs of this thread carry its name in Spark's own reports too."""
        if self.stopped.is_set():
            raise Cancelled(name)
        self.context.setJobGroup(self.group, name, interruptOnCancel=True)
        self.report(name)

    def cancel(self) -> None:
        """Stop the run, from any thread: its running jobs end, and no stage begins any more."""
        self.stopped.set()
        self.context.cancelJobGroup(self.group)

    def run(self, work: Callable[[Run], T], undo: Callable[[], None] | None = None) -> T:
        """The result of ``work(self)``. If the run is cancelled, even just after the work, ``undo`` removes what it put out."""
        try:
            self.stage("start")
            result = work(self)
            if self.stopped.is_set():
                raise Cancelled("end")
        except Exception as e:
            if not self.stopped.is_set():
                raise
            if undo:
                undo()
            self.report("cancelled")
            raise e if isinstance(e, Cancelled) else Cancelled("running") from e
        finally:
            self.context.setLocalProperty("spark.jobGroup.id", None)
            self.context.setLocalProperty("spark.job.description", None)
        self.report("done")
        return result
