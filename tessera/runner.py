"""A query under way: rows as they come, what it took, and a way to stop it."""

from __future__ import annotations

import time
import uuid
from itertools import islice

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


class Runner:
    """Runs one DataFrame in its own job group: next() gives batches of rows, a partition at a time, so the driver never holds all.

    wait() gives no rows: their batches are made and counted by the tasks, and the driver gets the counts.
    """

    def __init__(self, df: DataFrame, batch: int = 10_000):
        self.df, self.batch, self.group = df, batch, f"runner-{uuid.uuid4().hex}"
        self.state, self.error, self.rows, self.began, self.ended = "initialized", None, 0, None, None
        self._rows = self._seen = None

    def _tagged(self, work):
        context = self.df.sparkSession.sparkContext
        context.setJobGroup(self.group, "tessera", interruptOnCancel=True)
        try:
            return work()
        except Exception as e:
            if self.state != "aborted":
                self.state, self.error = "failed", e
            self.ended = time.time()
            raise
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)

    def next(self) -> list[Row] | None:
        """The next rows, or None at the end."""
        if self.state in ("finished", "aborted", "failed"):
            return None
        if self._rows is None:
            self.state, self.began = "running", time.time()
            self._rows = self._tagged(self.df.toLocalIterator)
        out = self._tagged(lambda: list(islice(self._rows, self.batch)))
        self.rows += len(out)
        if not out:
            self.state, self.ended = "finished", time.time()
            return None
        return out

    def _count(self) -> int:
        """The number of rows, all columns of which are computed; a number a task goes to the driver."""
        batch, seen = self.batch, self._seen

        def counts(parts):
            import pyarrow as pa

            rows = 0
            for part in parts:
                for at in range(0, part.num_rows, batch):
                    rows += (n := part.slice(at, batch).num_rows)
                    seen.add(n)
            yield pa.RecordBatch.from_pydict({"rows": pa.array([rows], pa.int64())})

        # Names may be equal, and there may be no column to carry the rows.
        rows = self.df.toDF(*map(str, range(len(self.df.columns)))).select("*", F.lit(True))
        return sum(r["rows"] for r in rows.mapInArrow(counts, "rows long").collect())

    def wait(self) -> int:
        """Runs to the end and gives the number of rows.

        If next() has begun, the rest comes to the driver as well: a second run need not give the same rows.
        """
        if self.state == "initialized":
            self.state, self.began = "running", time.time()
            self._seen = self.df.sparkSession.sparkContext.accumulator(0)  # as tasks end, for stats()
            try:
                self.rows = self._tagged(self._count)
            except Exception:
                self.rows = self._seen.value
                raise
            if self.state == "running":
                self.state, self.ended = "finished", time.time()
        while self.next() is not None:
            pass
        return self.rows

    def start(self) -> InheritableThread:
        """wait() in a thread of its own."""
        thread = InheritableThread(target=lambda: self._quietly())
        thread.start()
        return thread

    def _quietly(self) -> None:
        try:
            self.wait()
        except Exception:  # kept in self.error
            pass

    def abort(self) -> None:
        self.state, self.ended = "aborted", time.time()
        self.df.sparkSession.sparkContext._jsc.sc().cancelJobGroupAndFutureJobs(self.group)  # wait() may be about to start its job

    def stats(self) -> dict:
        tracker = self.df.sparkSession.sparkContext.statusTracker()
        jobs = tracker.getJobIdsForGroup(self.group)
        stages = [s for j in jobs if (i := tracker.getJobInfo(j)) for s in i.stageIds]
        seconds = None if self.began is None else (self.ended or time.time()) - self.began
        rows = max(self.rows, self._seen.value if self._seen else 0)
        return {"state": self.state, "rows": rows, "jobs": len(jobs), "stages": len(stages), "seconds": seconds}
