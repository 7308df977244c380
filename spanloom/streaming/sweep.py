"""Micro-batch drift checks and the correction process: extensions on structured streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.terms import process_identity, text_hash
from ..operators.drift import classify


def drift_stream(changes: DataFrame, citations: DataFrame) -> DataFrame:
    """Problems as changed documents arrive: a stream of (doc_uri, text) against stored citations.

    A static side joins a stream without state; each arriving text is compared with the hash
    of every whole-text citation of its document.
    """
    arrived = changes.select("doc_uri", text_hash(F.col("text")).alias("current_hash"))
    stored = citations.select(F.col("source_uri").alias("doc_uri"), "property_shape_iri", "content_hash")
    drift = arrived.join(stored, "doc_uri").select(
        "property_shape_iri",
        "content_hash",
        "current_hash",
        F.lit("RESOLVED").alias("current_status"),
        (F.col("current_hash") != F.col("content_hash")).alias("changed"),
    )
    return classify(drift)


def correction_state(events: DataFrame) -> DataFrame:
    """Correction processes still paused: the latest event of each identity is a rejection.

    ``events`` has fact_key, leaf_ref, drift_kind, fingerprint, verdict, at; the same plan runs
    on a table and, in complete mode, on a stream.
    """
    identity = process_identity(F.col("fact_key"), F.col("leaf_ref"), F.col("drift_kind"), F.col("fingerprint"))
    last = events.withColumn("process", identity).groupBy("process").agg(F.max_by("verdict", "at").alias("verdict"), F.max("at").alias("at"))
    return last.where("verdict = 'REJECTED'")


class CorrectionProcess(StatefulProcessor):
    """One process: paused from a rejection on, gone with its completion; what isn't kept isn't paused.

    Rows of an identity are (verdict, at); only what comes after the last event seen counts, so
    that late and repeated ones change nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.paused = handle.getValueState("paused", "at long")
        self.seen = handle.getValueState("seen", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        events = pd.concat(list(rows)).sort_values(["at", "verdict"])
        seen = self.seen.get()[0] if self.seen.exists() else None
        events = events if seen is None else events[events["at"] > seen]
        if len(events):
            last = events.iloc[-1]
            self.seen.update((int(last["at"]),))
            if last["verdict"] == "REJECTED":
                self.paused.update((int(last["at"]),))
            elif self.paused.exists():
                self.paused.clear()
        at = int(self.paused.get()[0]) if self.paused.exists() else None
        yield pd.DataFrame({"process": [key[0]], "paused": [at is not None], "at": pd.array([at], dtype="Int64")})

    def close(self) -> None:
        pass


def correction_process(events: DataFrame) -> DataFrame:
    """A stream of (process, paused, at), one row for each process that a micro-batch touches, from a stream of events.

    ``events`` has the columns of :func:`correction_state`, with ``at`` as a long. State is kept by process; the
    session's state store must be RocksDB's.
    """
    identity = process_identity(F.col("fact_key"), F.col("leaf_ref"), F.col("drift_kind"), F.col("fingerprint"))
    rows = events.select(identity.alias("process"), "verdict", F.col("at").cast("long").alias("at"))
    return rows.groupBy("process").transformWithStateInPandas(CorrectionProcess(), "process string, paused boolean, at long", "Update", "None")


def start(problems: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append problems to Parquet, once over what is there."""
    return problems.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
