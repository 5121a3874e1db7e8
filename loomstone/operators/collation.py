"""Rows of a partition as padded batches, by a table function that SQL can call."""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf


class Collate:
    """Batches of up to ``size`` rows in the order of the partition, each row's ids filled up to the longest of its batch.

    It holds one batch at a time. A row without ids has length 0; a partition's last batch may be smaller.
    """

    def __init__(self) -> None:
        self.held: list[tuple[object, list]] = []
        self.number, self.pad, self.group = 0, 0, None

    def eval(self, size: int, pad: int, row: Row):
        self.group, self.pad = row["bucket"], pad
        self.held.append((row["id"], list(row["ids"] or [])))
        if len(self.held) >= max(1, size):
            yield self._batch()

    def terminate(self):
        if self.held:
            yield self._batch()

    def _batch(self):
        width = max(len(ids) for _, ids in self.held)
        ids = [i + [self.pad] * (width - len(i)) for _, i in self.held]
        out = (self.group, self.number, [k for k, _ in self.held], ids, [len(i) for _, i in self.held], [[1] * len(i) + [0] * (width - len(i)) for _, i in self.held])
        self.held, self.number = [], self.number + 1
        return out


def register(spark: SparkSession, name: str = "collate") -> None:
    """Make ``collate(size, pad, TABLE(rows) PARTITION BY bucket ORDER BY (...))`` known to SQL. ``rows`` has ``bucket, id, ids``;
    what comes back is ``bucket, batch, keys, ids, lengths, mask``."""
    spark.udtf.register(name, udtf(Collate, returnType="bucket long, batch int, keys array<long>, ids array<array<int>>, lengths array<int>, mask array<array<int>>"))
