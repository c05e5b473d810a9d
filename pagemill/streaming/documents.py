"""Page results as a stream: upserts, and the completeness fan-in with deadline and expiry."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import batched

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagemill.functions import texts
from pagemill.functions.numbers import rounded
from pagemill.operators.documents import BLOCK
from pagemill.params import Params
from pagemill.sources.streams import timed_rows


def distinct_results(results: DataFrame, delay: str = "24 hours") -> DataFrame:
    """Producers deliver at least once: repeats of a result id within the delay are dropped."""
    return results.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["result_id"])


WAITING = "num_pages long, page_index long, ts_us long, result_id long, ok boolean"
FAN_IN_SCHEMA = (
    "document_id bigint, total_pages bigint, successful_pages bigint, failed_pages bigint, missing_count bigint,"
    " timeout_reached boolean, first_us bigint, decided_us bigint, block bigint, missing_pages array<bigint>"
)


#: Results that are handed to the state at once.
CHUNK = 1000


def _due(us: int) -> int:
    """The watermark (ms) at which all rows up to an event time (us) have come."""
    return -(-us // 1000)


class DocumentFanIn(StatefulProcessor):
    """Emits a document as of the moment it is complete, or as of its deadline; only the times in the rows count.

    Results wait in list state on disk. A record goes out once the watermark has passed its decision, when no row can change
    it any more, so the order of rows and files changes nothing. The number of pages is that of the first result. Results
    after the decision do not count; after one lifetime from its first result the same id is a new document. At its decision
    one document's pages (a time and a mark each) are in memory; it is emitted in blocks of pages.
    """

    def __init__(self, p: Params = Params()) -> None:
        self.deadline_us = p.document_deadline_s * 1_000_000
        self.ttl_us = p.result_ttl_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        # first_us, newest_us and rows of what waits; closed_us: rows before it belong to a document that is out
        self.document = handle.getValueState("document", "first_us long, newest_us long, rows long, closed_us long, timer_ms long")

    def _arm(self, old: int | None, due: int | None) -> int | None:
        if old != due:
            if old is not None:
                self.handle.deleteTimer(old)
            if due is not None:
                self.handle.registerTimer(due)
        return due

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, newest, count, closed, timer = self.document.get() or (None, None, 0, None, None)
        taken = ((row["num_pages"], row["page_index"], row["ts_us"], row["result_id"], bool(row["ok"])) for row in rows if closed is None or row["ts_us"] >= closed)
        for chunk in batched(taken, CHUNK):
            low, high = min(r[2] for r in chunk), max(r[2] for r in chunk)
            first, newest = (low, high) if first is None else (min(first, low), max(newest, high))
            count += len(chunk)
            self.waiting.appendList(list(chunk))
        if first is not None:
            timer = self._arm(timer, _due(min(first + self.deadline_us, newest)))
        if first is not None or closed is not None:
            self.document.update((first, newest, count, closed, timer))
        yield from ()

    def _decision(self, first: int) -> tuple[int, int, bool]:
        """(pages, time of the decision, late) from what waits."""
        starts: dict[int, int] = {}
        opening, limit = (math.inf, 0, 0), first + self.deadline_us
        for pages, page, at, result, _ in self.waiting.get():
            if at <= limit:
                opening = min(opening, (at, result, pages))
                starts[page] = min(at, starts.get(page, at))
        total = opening[2]
        reached = [at for page, at in starts.items() if 0 <= page < total]
        late = len(reached) < total
        return total, limit if late else max(reached, default=first), late

    def _records(self, key, first: int, total: int, decided: int, late: bool) -> Iterator[Row]:
        newest: dict[int, tuple] = {}
        for _, page, at, result, ok in self.waiting.get():
            if at <= decided and 0 <= page < total:
                newest[page] = max(newest.get(page, (at, result, ok)), (at, result, ok))
        good, gaps = sum(w[2] for w in newest.values()), total - len(newest)
        for block in range(max(-(-total // BLOCK), 1)):
            numbers = [i + 1 for i in range(block * BLOCK, min((block + 1) * BLOCK, total)) if i not in newest]
            yield Row(document_id=key[0], total_pages=total, successful_pages=good, failed_pages=total - good, missing_count=gaps,
                      timeout_reached=late, first_us=first, decided_us=decided, block=block, missing_pages=numbers)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.document.get()
        if held is None:
            return
        first, newest, count, closed, _ = held
        watermark, due = timerValues.getCurrentWatermarkInMs(), None
        while first is not None:
            total, decided, late = self._decision(first)
            if watermark < _due(decided):
                due = _due(decided)
                break
            yield from self._records(key, first, total, decided, late)
            closed = first + self.ttl_us
            rest = [row for row in self.waiting.get() if row[2] >= closed]
            self.waiting.put(rest) if rest else self.waiting.clear()
            times = [row[2] for row in rest]
            first, newest, count = min(times, default=None), max(times, default=None), len(rest)
        if first is None:
            if watermark >= _due(closed):
                self.document.clear()
                return
            due = _due(closed)
        self.handle.registerTimer(due)
        self.document.update((first, newest, count, closed, due))

    def close(self) -> None:
        pass


def fan_in(results: DataFrame, p: Params = Params(), delay: str = "10 minutes") -> DataFrame:
    """Final record per document, in blocks of pages, from a stream of (document_id, num_pages, page_index, ok, result_id, ts,
    ts_us); ``ts_us`` is ``ts`` in microseconds. Rows without a document or page are left out."""
    needed = results.select("document_id", "num_pages", "page_index", "ok", "result_id", "ts", "ts_us")
    keyed = timed_rows(needed, ["document_id", "page_index", "num_pages"], delay)
    emitted = keyed.groupBy("document_id").transformWithState(
        statefulProcessor=DocumentFanIn(p), outputStructType=FAN_IN_SCHEMA, outputMode="append", timeMode="EventTime")
    ok, failed = F.col("successful_pages"), F.col("failed_pages")
    return emitted.withColumns({
        "processing_time": rounded((F.col("decided_us") - F.col("first_us")) / 1_000_000, 3),
        "status": texts.document_status(ok, failed),
        "message": texts.document_message(ok, failed, F.col("total_pages"), F.col("timeout_reached"), p.document_deadline_s),
        "missing_list": texts.missing_list(F.col("missing_pages")),
    }).drop("first_us", "decided_us")
