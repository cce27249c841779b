"""The same operators on streams: positions against a static network, and the change log with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from linref.functions.lineage import settle
from linref.operators.references import marker_measures, reference_from_point


def stream_references(points: DataFrame, segments: DataFrame, markers: DataFrame, path: str, checkpoint: str, **trigger):
    """References of a stream of positions (pid, road_code, x, y) as Parquet under path, one folder per batch, so a batch that is run
    again replaces itself. The network does not change meanwhile: its segments and the places of its markers are computed once."""
    segments = settle(segments)
    measures = settle(marker_measures(markers, segments))

    def batch(df: DataFrame, n: int) -> None:
        reference_from_point(df, segments, markers, measures=measures).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return points.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


class CompactLog(StatefulProcessor):
    """State of one object, whatever order its ops come in: its last two ops that are no U, each with its place in the log, and the place of its last U.

    That is all the compacted op depends on, and it can be brought up to date with any op at any time: so no op is too late, none has to be
    waited for, and one that is delivered twice changes nothing."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("ops", "x string, xs long, y string, ys long, u long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        x, xs, y, ys, u = self.state.get() if self.state.exists() else (None, -1, None, -1, -1)
        others = {s: op for s, op in ((xs, x), (ys, y)) if op is not None}
        for log in rows:
            ups = log.loc[log["op"] == "U", "seq"]
            u = max(u, int(ups.max())) if len(ups) else u
            rest = log[log["op"] != "U"].drop_duplicates("seq").nlargest(2, "seq")
            others |= dict(zip((int(s) for s in rest["seq"]), rest["op"], strict=True))
            others = dict(sorted(others.items())[-2:])
        last = sorted(others.items(), reverse=True)
        (xs, x), (ys, y) = (last + [(-1, None)] * 2)[:2]
        self.state.update((x, xs, y, ys, u))
        op = "U" if x is None else "I" if x == "I" else "U" if u > xs else None if y == "I" else "D"
        yield pd.DataFrame({"table_name": [key[0]], "id": [key[1]], "op": [op]})

    def close(self) -> None:
        pass


def stream_compact_log(log: DataFrame) -> DataFrame:
    """The compacted op of each object (table_name, id) after each batch of its log (seq, op), which may come in any order; a null op means that its ops
    cancel out. seq is a place in the log, from 0, each op's own."""
    return log.groupBy("table_name", "id").transformWithStateInPandas(CompactLog(), "table_name string, id long, op string", "Update", "None")
