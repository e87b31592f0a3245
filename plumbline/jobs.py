"""Background jobs: a thread and a Spark job group each, with linked cancellation."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import Future

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


class Cancelled(RuntimeError):
    pass


class Job:
    """Runs work(job) on a thread of its own; cancelling it cancels its Spark jobs and its children."""

    def __init__(self, spark: SparkSession, work: Callable[[Job], object], parent: Job | None = None):
        self.spark, self.group, self.children = spark, f"plumbline-{uuid.uuid4().hex}", []
        self._stop, self._future, self._progress = threading.Event(), Future(), 0
        if parent is not None:
            parent.children.append(self)
            if parent._stop.is_set():
                self._stop.set()

        def run():
            spark.sparkContext.setJobGroup(self.group, "plumbline", interruptOnCancel=True)
            try:
                self.check()
                self._future.set_result(work(self))
            except BaseException as error:
                self._future.set_exception(Cancelled() if self._stop.is_set() else error)

        threading.Thread(target=inheritable_thread_target(spark)(run), daemon=True).start()

    def check(self) -> None:
        if self._stop.is_set():
            raise Cancelled()

    def report(self, done: int) -> None:
        """Progress never goes back."""
        if done < self._progress:
            raise ValueError("progress goes one way")
        self._progress = done

    @property
    def progress(self) -> int:
        return self._progress

    def cancel(self) -> None:
        self._stop.set()
        self.spark.sparkContext.cancelJobGroup(self.group)
        for child in self.children:
            child.cancel()

    def wait(self, timeout: float | None = None):
        return self._future.result(timeout)
