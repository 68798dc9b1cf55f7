"""Progress of a run, told on standard error while its jobs are running."""

from __future__ import annotations

import sys
import threading
import time

from pyspark.sql import SparkSession


class Progress:
    """A context in which a thread tells, every so many seconds, how many tasks are done, how fast, and how long the rest may take.

    What is known are the stages that Spark has begun; the estimate is theirs.
    """

    def __init__(self, spark: SparkSession, seconds: float = 10, out=None):
        self.tracker, self.seconds, self.out = spark.sparkContext.statusTracker(), seconds, out or sys.stderr
        self.ended, self.began = threading.Event(), time.time()
        self.thread = threading.Thread(target=self._tell, daemon=True)
        self.done: dict[int, tuple[int, int]] = {}

    def line(self) -> str:
        for i in self.tracker.getActiveStageIds():
            if info := self.tracker.getStageInfo(i):
                self.done[i] = info.numCompletedTasks, info.numTasks
        done, known = (sum(x[k] for x in self.done.values()) for k in (0, 1))
        passed = max(time.time() - self.began, 1e-3)
        rest = f"{(known - done) * passed / done:.0f}s" if done else "?"
        return f"[progress] tasks={done}/{known} rate={done / passed:.2f}/s elapsed={passed:.0f}s eta={rest}"

    def _tell(self) -> None:
        while not self.ended.wait(self.seconds):
            print(self.line(), file=self.out, flush=True)

    def __enter__(self) -> Progress:
        if self.seconds > 0:
            self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.ended.set()
        if self.thread.is_alive():
            self.thread.join(1)
