"""Rate limits over a stream of requests: a token bucket for each key, slowed down when the other side pushes back."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocks(spark: SparkSession):
    """State of the queries that start within is kept in RocksDB, as stateful processors need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


@dataclass(frozen=True)
class Limit:
    """A bucket of `burst` tokens that fills at `rate` a second. A request that is pushed back halves its
    key's rate, down to `slowest`; every `wins` successes in a row raise it by a tenth, up to `rate`.
    A key that is silent for `expire` seconds begins anew."""

    rate: float
    burst: float
    slowest: float = 0.05
    wins: int = 5
    expire: float = 3600.0


def _buckets(limit: Limit) -> StatefulProcessor:
    """The processor; its class is made here, as the process that starts it may not find this module."""
    burst, fastest, slowest, wins, expire = limit.burst, limit.rate, limit.slowest, limit.wins, int(limit.expire * 1_000_000)

    class Buckets(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.bucket = handle.getValueState("bucket", "tokens double, rate double, last long, row int, timer long")

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            held, out = self.bucket.get(), []
            tokens, rate, last, row, timer = held if held is not None else (burst, fastest, None, 0, None)
            given = pd.concat(list(rows)).sort_values(["micros", "place"], kind="stable")
            for number, t, pushed in zip(given["place"], given["micros"].tolist(), given["pushed"], strict=True):
                if last is None or t - last >= expire:
                    tokens, rate, row = burst, fastest, 0
                else:
                    tokens = min(burst, tokens + max(0, t - last) / 1e6 * rate)
                last = t if last is None else max(last, t)
                allowed = tokens >= 1.0
                wait = 0.0 if allowed else (1.0 - tokens) / rate
                if allowed:
                    tokens -= 1.0
                    row = 0 if pushed else row + 1
                    if pushed:
                        rate = max(slowest, rate / 2.0)
                    elif row % wins == 0:
                        rate = min(fastest, rate * 1.1)
                out.append((key[0], number, allowed, wait, rate))
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = (last + expire) // 1000 + 1
            self.handle.registerTimer(timer)
            self.bucket.update((tokens, rate, last, row, timer))
            yield pd.DataFrame(out, columns=["owner", "place", "allowed", "wait", "rate"])

        def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.bucket.clear()
            return iter([])

        def close(self) -> None:
            pass

    return Buckets()


def rate_limited(requests: DataFrame, key: str, ts: str, order: str, pushed: str, late: str, limit: Limit) -> DataFrame:
    """(key, order, allowed, wait, rate) of each request of a stream: whether its key's bucket had a token, else
    the seconds until it has one, and the key's rate behind it. Only requests that were allowed tell
    how they went: pushed is true for one that was pushed back, null counts as false.

    A key's requests of a batch are taken in the order of (ts, order); those of earlier batches came
    before. A request behind the watermark is dropped. State is a few numbers for each key, and goes when an
    event-time timer finds the key silent. Start the query within `rocks`."""
    kind, number = requests.schema[key].dataType.simpleString(), requests.schema[order].dataType.simpleString()
    # rows come to the processor as named tuples, whose names can't begin with an underscore
    rows = requests.withWatermark(ts, late).select(
        F.col(key).alias("owner"), F.col(order).alias("place"), ts, F.unix_micros(ts).alias("micros"), F.coalesce(F.col(pushed), F.lit(False)).alias("pushed")
    )
    told = f"owner {kind}, place {number}, allowed boolean, wait double, rate double"
    out = rows.groupBy("owner").transformWithStateInPandas(_buckets(limit), told, "Append", "EventTime")
    return out.withColumnsRenamed({"owner": key, "place": order})
