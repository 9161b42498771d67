"""The append-only history as a stream of reports (an extra: the rules are those of the batch update)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.history import update
from ..sources.versions import Versions


def append_reports(reports: DataFrame, store: Versions, checkpoint: str, **trigger) -> StreamingQuery:
    """Each batch of reports is checked against the current version and appended, or stops the query.

    A batch that comes again after a failure agrees with what it wrote and adds
    nothing.
    """

    def step(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        found = update(store.read(), batch)
        if found.new_rows:
            store.write(found.combined, found.history_rows + found.new_rows)

    return reports.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
