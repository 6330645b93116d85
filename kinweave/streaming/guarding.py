"""The guards of a request stream as a stateful operator: what an id was first sent with is kept by Spark's state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from kinweave.operators.guards import CONFLICT, IDEMPOTENT, NEW, REPEAT, digest

#: Setting without which Spark refuses this operator.
STATE_STORE = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)
OUTCOME_LAYOUT = "mention_id string, arrival_seq long, guard string"


class FirstDigest(StatefulProcessor):
    """State of an id: the digest of the record that was new."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "digest string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        if not self.first.exists():
            self.first.update((initialState["digest"].iloc[0],))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self.first.get() if self.first.exists() else None
        if stored is not None:
            for part in rows:
                yield _told(part, (part["digest"] == stored[0]).map({True: IDEMPOTENT, False: CONFLICT}))
            return
        # The first of a batch is known at its end; until then a record is a number and a digest.
        batch = pd.concat(list(rows), ignore_index=True)
        first = batch["arrival_seq"].idxmin()
        opening = batch["digest"].iloc[first]
        guard = (batch["digest"] == opening).map({True: REPEAT, False: CONFLICT})
        guard.iloc[first] = NEW
        self.first.update((opening,))
        yield _told(batch, guard)

    def close(self) -> None:
        pass


def _told(rows: pd.DataFrame, guard: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"mention_id": rows["mention_id"], "arrival_seq": rows["arrival_seq"], "guard": guard})


def guard_stream(records: DataFrame, fields: list[str], stored: DataFrame | None = None) -> DataFrame:
    """Outcome of each record of a stream: mention_id, arrival_seq, guard.

    The outcomes are those of `guards.guard` for each batch, with everything that was new in earlier batches as stored.  They
    survive a restart from the query's checkpoint.  `stored` (mention_id and the fields, ids unique) seeds the state of a new
    checkpoint.  Records without an id are left out.  Only ids, numbers and digests reach the operator; of an id
    that is not stored yet it holds the rows of one batch, which the bounds of the source limit.  The session needs
    the setting `STATE_STORE`.
    """
    judged = records.where(F.col("mention_id").isNotNull()).select("mention_id", "arrival_seq", digest(fields).alias("digest"))
    seed = None if stored is None else stored.select("mention_id", digest(fields).alias("digest")).groupBy("mention_id")
    return judged.groupBy("mention_id").transformWithStateInPandas(
        FirstDigest(), OUTCOME_LAYOUT, outputMode="append", timeMode="none", initialState=seed
    )
