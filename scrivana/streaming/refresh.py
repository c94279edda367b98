"""Streaming forms of the bounded refreshes: changes of sources, and one task at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scrivana.operators.snapshot import diff_sources


def source_changes(versions: DataFrame, previous: Callable[[], DataFrame], store: Callable[[DataFrame, int], None], emit: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Compare each micro-batch of versions (id, body_digest, accessible, version) with what is stored.

    Of several versions of a source in a batch the newest counts. `emit` gets the material changes, `store` the new
    versions; both get the batch's number, so that a batch that runs again replaces itself. A batch says nothing
    about the sources it lacks, so none is reported as removed.
    """

    def each(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("id").agg(F.max_by(F.struct("body_digest", "accessible"), "version").alias("v")).select("id", "v.*")
        old = previous().join(newest.select("id"), "id", "left_semi")
        emit(diff_sources(old, newest), number)
        store(newest, number)

    return versions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_versions(versions: DataFrame) -> DataFrame:
    """(id, version, body_digest): running newest version of each source; in update mode, each batch's changes."""
    return versions.groupBy("id").agg(F.max(F.struct("version", "body_digest")).alias("v")).select("id", "v.version", "v.body_digest")


def windowed_counts(events: DataFrame, time: str, width: str, late: str, *by: str) -> DataFrame:
    """Counts by tumbling window and keys; events later than `late` behind the newest are left out. An extra."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"))
