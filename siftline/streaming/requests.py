"""Requests of a stream whose failures wait in state, not in a task: each key's retries are timers, and the cap counts anew at each of them."""
import time

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from ..sources.external import Caller

ANSWER = "query_id string, status string, error string, response string, tries int"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def wait(tries: int, least: float, most: float) -> float:
    """Seconds to the next try: doubling, from least to most."""
    return min(most, max(least, 2.0 ** (tries - 1)))


class Requests(StatefulProcessor):
    """Tries every prompt of a key once when it comes; what fails is kept with its number of tries and the time of the next one.

    cap(milliseconds of the clock) says how many partitions may send requests now; the others keep their prompts for `recheck` seconds.
    """

    def __init__(self, client, attempts: int, least: float, most: float, cap, recheck: float):
        self.client, self.attempts, self.least, self.most, self.cap, self.recheck = client, attempts, least, most, cap, recheck

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "prompt string, tries int, due long")
        self.call = Caller(self.client, attempts=1)

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentProcessingTimeInMs()
        fresh = [(p, 0, now) for frame in rows for p in frame["prompt"]]
        yield self._tried(key[0], fresh, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self._tried(key[0], [], timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass

    def _tried(self, key, fresh: list, now: int) -> pd.DataFrame:
        work = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        left, out = [], []
        free = self.cap is None or TaskContext.get().partitionId() < self.cap(now)
        for prompt, tries, due in work + fresh:
            if due > now or not free:
                left.append((prompt, tries, due if due > now else now + int(1000 * self.recheck)))
                continue
            try:
                out.append((key, "success", None, self.call(prompt), tries + 1))
            except Exception as e:  # any failure of the service is retried, then told
                if tries + 1 >= self.attempts:
                    out.append((key, "failed", f"{type(e).__name__}: {e}", None, tries + 1))
                else:
                    left.append((prompt, tries + 1, now + int(1000 * wait(tries + 1, self.least, self.most))))
        if left:
            self.open.put(left)
            self.handle.registerTimer(min(due for _, _, due in left))
        else:
            self.open.clear()
        return pd.DataFrame(out, columns=["query_id", "status", "error", "response", "tries"])


def answered(source: DataFrame, client, out: str, checkpoint: str, attempts: int = 10, least: float = 5.0, most: float = 30.0, cap=None, recheck: float = 60.0,
             partitions: int = 9, every: str = "1 second", seconds: float | None = None) -> bool:
    """Answers the requests (query_id, prompt) of a stream into Parquet at out; whether all that there are have been answered.

    A slow or failing key holds up neither its batch nor other keys: its next try is a timer.  Started again with the same checkpoint it goes
    on with what is open.  It ends when nothing is open, or after `seconds`.  partitions is the most that the cap can allow; it is fixed with
    the checkpoint.
    """
    spark = source.sparkSession
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        rows = source.select("query_id", "prompt").groupBy("query_id").transformWithStateInPandas(
            Requests(client, attempts, least, most, cap, recheck), ANSWER, "Append", "ProcessingTime")
        q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    end = None if seconds is None else time.monotonic() + seconds
    done = False
    while q.isActive and not done and (end is None or time.monotonic() < end):
        p = q.lastProgress
        done = p is not None and p["numInputRows"] == 0 and not any(s["numRowsTotal"] for s in p["stateOperators"])
        time.sleep(0.2)
    q.stop()
    if q.exception():
        raise q.exception()
    return done
