"""Typed change events from a stream of observations.

Two ways with the same events as ``operators.changes.detect_changes``:

* ``detect_changes_stream``: keyed state, one snapshot per listing, low latency;
* ``ChangeLog``: ``foreachBatch`` over a snapshot table, for streams where single
  listings get very many observations per batch (the batch job cuts those).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from nestrank.operators import changes as CH

STATE = T.StructType(
    [
        T.StructField("price", T.DoubleType()),
        T.StructField("listing_status", T.StringType()),
        T.StructField("photos_hash", T.StringType()),
        T.StructField("description_hash", T.StringType()),
    ]
)
PAIR = ", ".join(
    f"{side}_{name} {kind}"
    for side in ("old", "new")
    for name, kind in (("price", "double"), ("listing_status", "string"), ("photos_hash", "string"), ("description_hash", "string"))
)


class _LastSnapshot(StatefulProcessor):
    """Pairs every observation of a listing with the snapshot before it.

    What a pair means is decided by the shared Column expression afterwards, so the
    state holds one row and the Python part holds no rule.
    """

    def __init__(self, order: Sequence[str]):
        self.order = list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [f.name for f in STATE]
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable").reset_index(drop=True)
        known = self.last.exists()
        before = self.last.get() if known else (None,) * len(names)
        new = frame[names]
        old = new.shift(1)
        old.iloc[0] = list(before)
        out = frame[self.order].copy()
        out.insert(0, "listing_id", key[0])
        out["known"] = [known, *([True] * (len(frame) - 1))]
        for name in names:
            out[f"old_{name}"], out[f"new_{name}"] = old[name], new[name]
        for name, field in zip(names, STATE):
            if isinstance(field.dataType, T.StringType):
                for side in ("old", "new"):
                    col = out[f"{side}_{name}"].astype(object)
                    out[f"{side}_{name}"] = col.where(col.notna(), None)
        tail = new.iloc[-1]
        self.last.update(tuple(None if pd.isna(v) else v for v in tail))
        yield out

    def close(self) -> None:
        pass


def detect_changes_stream(obs: DataFrame, order: Sequence[str]) -> DataFrame:
    """Change events of a streaming observation DataFrame; needs the RocksDB state store.

    Observations of a listing must arrive in order between micro-batches; inside one
    they are sorted here.
    """
    snaps = CH.observation_snapshots(obs)
    fields = {f.name: f.dataType.simpleString() for f in obs.schema}
    keyed = snaps.select(
        "listing_id", *order, *[F.col(f"snap.{f.name}").alias(f.name) for f in STATE if f.name not in order]
    )
    schema = "listing_id bigint, " + ", ".join(f"{c} {fields[c]}" for c in order) + f", known boolean, {PAIR}"
    pairs = keyed.groupBy("listing_id").transformWithStateInPandas(
        statefulProcessor=_LastSnapshot(order),
        outputStructType=T.StructType.fromDDL(schema),
        outputMode="Append",
        timeMode="None",
    )
    old = F.struct(*[F.col(f"old_{f.name}").alias(f.name) for f in STATE])
    new = F.struct(*[F.col(f"new_{f.name}").alias(f.name) for f in STATE])
    staged = pairs.withColumns({"prev": F.when(F.col("known"), old), "snap": new})
    changed = staged.filter(F.col("prev").isNull() | (F.col("prev") != F.col("snap")))
    moves = CH.change_array(F.col("prev"), F.col("snap"))
    keys = ["listing_id", *order]
    return changed.select(*keys, F.posexplode(moves).alias("seq", "event")).select(*keys, "seq", "event.*")


class ChangeLog:
    """``foreachBatch`` target: appends events and keeps the last snapshot per listing.

    Every batch writes its own folder named by the batch id, so a batch replayed after a
    lost executor or driver overwrites itself and the log stays exact.
    """

    def __init__(self, spark: SparkSession, path: str, order: Sequence[str], seconds: int = CH.skew.PIECE_SECONDS):
        self.spark, self.path, self.order, self.seconds = spark, path.rstrip("/"), list(order), seconds

    def _snapshots(self, batch_id: int) -> str:
        return f"{self.path}/snapshots/batch={batch_id}"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        cols = ["listing_id", *dict.fromkeys([*self.order, *CH.SNAPSHOT])]
        rows = batch.select(*cols).withColumn("_old", F.lit(False))
        if batch_id > 0:
            before = self.spark.read.schema(batch.select(*cols).schema).parquet(self._snapshots(batch_id - 1))
            rows = rows.unionByName(before.withColumn("_old", F.lit(True)))
        paired = CH.prev_snapshot(CH.observation_snapshots(rows), self.order, self.seconds)
        moves = CH.change_array(F.col("prev"), F.col("snap"))
        fresh = paired.filter(~F.col("_old") & (F.col("prev").isNull() | (F.col("prev") != F.col("snap"))))
        keys = ["listing_id", *self.order]
        events = fresh.select(*keys, F.posexplode(moves).alias("seq", "event")).select(*keys, "seq", "event.*")
        events.write.mode("overwrite").parquet(f"{self.path}/events/batch={batch_id}")
        stamp = F.struct(*self.order)
        last = rows.groupBy("listing_id").agg(F.max_by(F.struct(*cols[1:]), stamp).alias("_s"))
        last.select("listing_id", "_s.*").write.mode("overwrite").parquet(self._snapshots(batch_id))

    def events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/events")
