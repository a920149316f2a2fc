"""Runs in the background that can be cancelled."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import Future
from typing import Any

from pyspark.sql import SparkSession


class Runs:
    """At most ``most`` runs at a time; each has a tag, and cancel() stops its Spark jobs."""

    def __init__(self, spark: SparkSession, most: int = 32):
        self.spark, self.most, self._tags = spark, most, {}

    def start(self, work: Callable[[SparkSession], Any], tag: str | None = None) -> Future:
        tag = tag or f"run-{uuid.uuid4().hex}"
        self._tags = {f: t for f, t in self._tags.items() if not f.done()}
        if tag in self._tags.values():
            raise ValueError(f"there is a run {tag}")
        if len(self._tags) >= self.most:
            raise RuntimeError("too many runs")
        future: Future = Future()
        self._tags[future] = tag

        def run() -> None:
            if not future.set_running_or_notify_cancel():
                return
            self.spark.sparkContext.addJobTag(tag)
            try:
                future.set_result(work(self.spark))
            except BaseException as error:  # the future carries it to whoever waits
                future.set_exception(error)
            finally:
                self.spark.sparkContext.removeJobTag(tag)

        from pyspark import InheritableThread

        InheritableThread(target=run, daemon=True).start()
        return future

    def cancel(self, future: Future) -> None:
        if not future.cancel() and future in self._tags:
            self.spark.sparkContext.cancelJobsWithTag(self._tags[future])


__all__ = ["Runs"]
