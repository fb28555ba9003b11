"""The ledger as a stream: contiguity and hash links checked with state per ledger, projections kept up to date.

Rows may come out of order: those that lie ahead wait in state until the gap closes, in blocks of neighbouring seqs with an entry each, so that a batch reads and writes only the blocks
that it touches, however long the ledger is. A repeated or broken row is reported. There is no event time in this model, so no watermark: a row is never late, only out of place.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evidentia.sources.relations import GENESIS

CHECKED = "ledger string, seq long, verdict string"
#: What lists and maps in state need; the setting holds for streams of the session that are started after it is made.
PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Neighbouring seqs that wait in one entry of state.
BLOCK = 256


class Chain(StatefulProcessor):
    """The last seq in order with its digest, and the rows ahead of it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "seq long, tail string")
        self.ahead = handle.getMapState("ahead", "block long", "rows string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seq, tail = self.done.get() if self.done.exists() else (0, GENESIS)
        touched: dict[int, dict[str, list]] = {}
        out: list[tuple[str, int, str]] = []

        def block(s: int) -> dict[str, list]:
            """The waiting rows around a seq, read when they are first asked for."""
            n = s // BLOCK
            if n not in touched:
                touched[n] = json.loads(self.ahead.getValue((n,))[0]) if self.ahead.containsKey((n,)) else {}
            return touched[n]

        for frame in rows:
            for s, prev, digest, payload in zip(frame["seq"].tolist(), frame["prev_hash"], frame["payload_hash"], frame["payload"], strict=True):
                if s <= seq or str(s) in block(s):
                    out.append((key[0], s, "repeated"))
                else:
                    block(s)[str(s)] = [prev, digest, hashlib.sha256((payload or "").encode()).hexdigest() == digest]
        while str(seq + 1) in block(seq + 1):
            seq += 1
            prev, digest, fits = block(seq).pop(str(seq))
            out.append((key[0], seq, "payload" if not fits else "link" if prev != tail else "ok"))
            tail = digest
        for n, waiting in touched.items():
            if waiting:
                self.ahead.updateValue((n,), (json.dumps(waiting),))
            elif self.ahead.containsKey((n,)):
                self.ahead.removeKey((n,))
        self.done.update((seq, tail))
        yield pd.DataFrame(out, columns=["ledger", "seq", "verdict"])


def checked(events: DataFrame) -> DataFrame:
    """A verdict for each event (ledger, seq, prev_hash, payload_hash, payload) of a stream."""
    events.sparkSession.conf.set(*PROVIDER)
    return events.groupBy("ledger").transformWithStateInPandas(Chain(), CHECKED, "append", "none")


def kind_counts(events: DataFrame) -> DataFrame:
    """Running counts by kind."""
    return events.groupBy("kind").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))


def run_once(spark: SparkSession, stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Works off what is there, then stops; exactly once by the checkpoint folder."""
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
