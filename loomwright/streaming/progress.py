"""Progress of streams as rows of a table, and log files read as a stream whose lines may be cut in two."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A line of a log that begins an entry: its time and level.
ENTRY = r"^\[(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)\] \[([A-Z]+)\] (.*)$"


class Progress(StreamingQueryListener):
    """Keeps what streams report, a few numbers a batch, until `write` appends them as Parquet to a folder."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802  the names are Spark's
        self.rows.append((str(event.runId), event.name, -1, "started", 0))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.rows.append((str(p.runId), p.name, p.batchId, "progress", p.numInputRows))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.rows.append((str(event.runId), None, -1, "idle", 0))

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.rows.append((str(event.runId), None, -1, "failed" if event.exception else "ended", 0))

    def write(self, spark: SparkSession, folder: str) -> int:
        rows, self.rows = self.rows, []
        if rows:
            spark.createDataFrame(rows, "run string, name string, batch long, state string, rows long").write.mode("append").parquet(folder)
        return len(rows)


def whole_lines(pieces: DataFrame) -> DataFrame:
    """pieces: a stream of file, part (its number), text. Rows file, n, line, at, level: a line that ends in a later part comes out whole, with that part.

    State holds a file's unfinished end, the number of its lines, and the time and level of its last entry, which lines that begin none inherit.
    Parts of a file must come in order from batch to batch; within a batch they are sorted.
    """

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import re

        rest, n, at, level = state.get if state.exists else ("", 0, None, None)
        out = []
        for text in pd.concat(list(frames)).sort_values("part")["text"]:
            *lines, rest = (rest + text).split("\n")
            for line in lines:
                if m := re.match(ENTRY, line):
                    at, level = m[1], m[2]
                n += 1
                out.append((key[0], n, line, at, level))
        state.update((rest, n, at, level))
        yield pd.DataFrame(out, columns=["file", "n", "line", "at", "level"])

    rows = pieces.groupBy("file").applyInPandasWithState(work, "file string, n long, line string, at string, level string", "rest string, n long, at string, level string", "append", GroupStateTimeout.NoTimeout)
    return rows.select("file", "n", "line", F.to_timestamp("at").alias("at"), "level")
