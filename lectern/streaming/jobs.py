"""Streaming jobs: admission, retirement, completion and retries, over file sources that end with what is there.

State is kept by ``transformWithState``, which needs the RocksDB store; ``drain`` sets it for the query that it runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from lectern.sources.scratch import scratch_path

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_parts(rows: DataFrame, order: str, parts: int = 4) -> DataFrame:
    """Rows as a stream of ``parts`` batches, by ranges of ``order`` (a whole number) from its least to its largest value."""
    spark = rows.sparkSession
    ends = rows.agg(F.min(order).alias("a"), F.max(order).alias("b")).first()
    path = scratch_path(spark, "stream")
    low, high = ends["a"] or 0, ends["b"] or 0
    width = -(-(high - low + 1) // parts)
    for k in range(parts):  # one after another, as a file source takes older files first
        part = rows.where((F.col(order) >= low + k * width) & (F.col(order) < low + (k + 1) * width))
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns its output."""
    spark = stream.sparkSession
    out, before = scratch_path(spark, name), spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKSDB)
    try:
        stream.writeStream.outputMode(mode).option("checkpointLocation", scratch_path(spark, f"{name}-state")).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    return spark.read.schema(stream.schema).parquet(out)


def drain_batches(stream: DataFrame, name: str, each: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """As ``drain``, with a function of each batch's rows; a batch that is run again replaces what it wrote before."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", scratch_path(spark, f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/*")


class Residency(StatefulProcessor):
    """Pages take a free place of their class, or wait for one in order of arrival; a page that is done frees its place."""

    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.free = handle.getValueState("free", "places array<int>")
        self.places = handle.getMapState("places", "page long", "place int")
        self.waiting = handle.getMapState("waiting", "at long", "page long")
        self.queued = handle.getMapState("queued", "page long", "at long")
        self.ends = handle.getValueState("ends", "first long, last long")

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        free = list(self.free.get()[0]) if self.free.exists() else list(range(self.window))[::-1]
        first, last = self.ends.get() if self.ends.exists() else (0, 0)

        def admit(page: int) -> Row:
            place = free.pop()
            self.places.updateValue((page,), (place,))
            return Row(**{"class": key[0], "share": key[1], "page": page, "place": place})

        out = []
        for r in sorted(rows, key=lambda r: r["at"]):
            page = (r["page"],)
            if r["done"]:
                if self.places.containsKey(page):
                    free.append(self.places.getValue(page)[0])
                    self.places.removeKey(page)
                elif self.queued.containsKey(page):  # given up while it waited
                    self.waiting.removeKey(self.queued.getValue(page))
                    self.queued.removeKey(page)
            elif free and first == last:
                out.append(admit(r["page"]))
            else:
                self.waiting.updateValue((last,), page)
                self.queued.updateValue(page, (last,))
                last += 1
            while free and first < last:
                if self.waiting.containsKey((first,)):
                    (next_page,) = self.waiting.getValue((first,))
                    self.waiting.removeKey((first,))
                    self.queued.removeKey((next_page,))
                    out.append(admit(next_page))
                first += 1
        self.free.update((free,))
        self.ends.update((first, last))
        return iter(out)

    def close(self) -> None:
        pass


def admit(events: DataFrame, window: int, shares: int) -> DataFrame:
    """(class, share, page, place) of every admission, from (class, page, at, done): a page's arrival and its end.

    ``window`` places of a class are divided among its shares (a page's number modulo ``shares``), so that no class meets
    in one task and never more than ``window`` pages are resident. Classes do not wait for one another. A page that ends
    while it waits is given up. ``at`` orders the rows of a batch; batches are taken as they come.
    """
    if window % shares:
        raise ValueError("the window must be a multiple of the shares")
    keyed = events.withColumn("share", F.pmod("page", F.lit(shares)).cast("long"))
    return keyed.groupBy("class", "share").transformWithState(Residency(window // shares), "class string, share long, page long, place int", "Append", "None")


class Harvest(StatefulProcessor):
    """Sums up a stream's steps until its end token comes; later steps, and steps not after the last one, do not count."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long, total double, last long, ended boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        n, total, last, ended = self.seen.get() if self.seen.exists() else (1, 1.0, -1, False)
        out = []
        for r in sorted(rows, key=lambda r: r["at"]):
            if not ended and r["at"] > last:
                n, total, last, ended = n + 1, total + r["p1"], r["at"], r["eos"]
                if ended:
                    out.append(Row(stream=key[0], ntok=n, conf=total / n))
        self.seen.update((n, total, last, ended))
        return iter(out)

    def close(self) -> None:
        pass


def retire(steps: DataFrame) -> DataFrame:
    """(stream, ntok, conf) of each stream once its end token has come, from (stream, at, p1, eos).

    ``at`` orders a stream's steps; a step that comes in a later batch than one after it is late, and left out.
    """
    return steps.groupBy("stream").transformWithState(Harvest(), "stream long, ntok long, conf double", "Append", "None")


class Completion(StatefulProcessor):
    """Counts a job's pages down; the job is complete with its last page, once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.left = handle.getValueState("left", "left long, words long")
        self.done = handle.getMapState("done", "page long", "words long")

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        out = []
        for r in rows:
            left, words = self.left.get() if self.left.exists() else (r["pages"], 0)
            page = (r["page"],)
            # a page that is done again (a second pass) replaces its words and does not count again
            old = self.done.getValue(page)[0] if self.done.containsKey(page) else None
            self.done.updateValue(page, (r["words"],))
            left, words = left - (old is None), words + r["words"] - (old or 0)
            self.left.update((left, words))
            if left == 0 and old is None:
                out.append(Row(job_id=key[0], pages=r["pages"], words=words))
        return iter(out)

    def close(self) -> None:
        pass


def complete(pages: DataFrame) -> DataFrame:
    """(job_id, pages, words) of each job whose pages are all done, from (job_id, pages, page, words) of finished pages."""
    return pages.groupBy("job_id").transformWithState(Completion(), "job_id long, pages long, words long", "Append", "None")


class Counters(StreamingQueryListener):
    """Health counters of the session's streams: rows taken in, batches done, queries running and failed."""

    def __init__(self) -> None:
        self.rows = self.batches = self.running = self.failed = 0

    def onQueryStarted(self, event) -> None:
        self.running += 1

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        self.batches += 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.running -= 1
        self.failed += event.exception is not None
