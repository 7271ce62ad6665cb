"""Monthly means as keyed state (A6, A7): a month adds up until the watermark has passed it, and is given out once."""

from __future__ import annotations

import calendar
import datetime as dt
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .daily import run_available

#: What the state needs of a session that streams.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class MonthState(StatefulProcessor):
    """Of a key and month: sums and counts, the days and granules seen; a timer at the end of the month gives the mean out.

    Rows are added up before they touch the state, so that a month's state is its days (a bit each), its sums and its granules.
    """

    def __init__(self, keys: Sequence[str], least: int | None):
        self.keys, self.least = list(keys), least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "total double, weight double, days long")
        self.granules = handle.getMapState("granules", "granule string", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = not self.sums.exists()
        total, weight, days = (0.0, 0.0, 0) if fresh else self.sums.get()
        for pdf in rows:
            used = pdf["value"].notna() & (pdf["weight"] > 0)
            total += float((pdf["value"] * pdf["weight"])[used].sum())
            weight += float(pdf["weight"][used].sum())
            for day in pdf["day"].unique():
                days |= 1 << int(day)
            for granule in pdf["granule"].dropna().unique() if self.least is not None else ():
                self.granules.updateValue((granule,), (1,))
        self.sums.update((total, weight, days))
        if fresh:
            month = key[-1]
            end = dt.datetime(month.year + month.month // 12, month.month % 12 + 1, 1, tzinfo=dt.timezone.utc)
            self.handle.registerTimer(int(end.timestamp() * 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        total, weight, days = self.sums.get()
        month = key[-1]
        seen, granules = days.bit_count(), sum(1 for _ in self.granules.keys()) if self.least is not None else 0
        whole = seen >= calendar.monthrange(month.year, month.month)[1] if self.least is None else granules >= self.least
        self.sums.clear()
        self.granules.clear()
        if whole:
            yield pd.DataFrame({**{k: [v] for k, v in zip(self.keys, key[:-1], strict=True)}, "month": [month], "value": [total / weight if weight else None], "days": [seen], "granules": [granules]})

    def close(self) -> None:
        pass


def monthly_stream(stream: DataFrame, keys: Sequence[str], ts: str, value: str = "value", weight: str | None = None, granule: str | None = None, least: int | None = None, late: str = "2 days") -> DataFrame:
    """Monthly means of a stream, each given out once, when the watermark has passed the month: (keys, month, value, days, granules).

    Without ``least`` (A6): months whose every day has a row, all rows alike.  With it (A7): means weighted by ``weight``, of
    months with so many granules or more.  Rows later than ``late`` behind the newest are dropped, as the watermark says.
    """
    rows = stream.withWatermark(ts, late).select(
        *keys, F.trunc(F.to_date(ts), "month").alias("month"), F.col(ts).alias("ts"), F.col(value).cast("double").alias("value"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"),
        F.dayofmonth(ts).alias("day"), (F.col(granule).cast("string") if granule else F.lit(None).cast("string")).alias("granule"),
    )
    schema = T.StructType([*[stream.schema[k] for k in keys], T.StructField("month", T.DateType()), T.StructField("value", T.DoubleType()), T.StructField("days", T.IntegerType()), T.StructField("granules", T.IntegerType())])
    return rows.groupBy(*keys, "month").transformWithStateInPandas(MonthState(keys, least), schema, "Append", "EventTime")


def run_to_end(spark: SparkSession, folder: str, schema: str, closing: DataFrame, means: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Streams the Parquet files of ``folder`` to a table, then ``closing`` rows, which move the watermark on, behind them."""
    before = spark.conf.get(STATE_STORE[0], None)
    spark.conf.set(*STATE_STORE)
    try:
        for last in (False, True):
            if last:
                closing.write.mode("append").parquet(folder)
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(folder)
            run_available(means(stream), out, checkpoint).awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE[0])
        else:
            spark.conf.set(STATE_STORE[0], before)
