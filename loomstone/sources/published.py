"""A table that is replaced while it is read: whole versions in folders of their own, and one pointer to the current one.

A version is written aside, under a name nobody else uses. Moving the pointer is a compare-and-swap under a lock file:
the writer says which version it started from, and loses if another one was published since. A pointer is a new file with
the next number; files are never changed, so a reader finds the old version or the new one, and never none.
"""

from __future__ import annotations

import contextlib
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has published since the version that this one started from."""


class Published:
    """The table at ``path``. ``patience`` seconds are waited for a lock; one older than ``stale`` seconds was left behind
    by a writer that is gone, and is taken away."""

    def __init__(self, spark: SparkSession, path: str, patience: float = 60.0, stale: float = 600.0):
        self.spark, self.path, self.patience, self.stale = spark, path.rstrip("/"), patience, stale
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        place = self._at(f"{self.path}/{folder}")
        if not self._files.exists(place):
            return []
        return sorted(s.getPath().getName() for s in self._files.listStatus(place) if not s.getPath().getName().startswith((".", "_")))

    def _put(self, name: str, text: str) -> None:
        out = self._files.create(self._at(f"{self.path}/{name}"), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def current(self) -> str | None:
        """Name of the current version; none before the first."""
        names = self._names("pointers")
        return names[-1].split("-", 1)[1] if names else None

    def read(self) -> DataFrame:
        """The current version, which stays readable until ``prune``."""
        version = self.current()
        if version is None:
            raise FileNotFoundError(f"nothing is published at {self.path}")
        return self.spark.read.parquet(f"{self.path}/versions/{version}")

    def stage(self, rows: DataFrame) -> str:
        """Write a version that no reader sees yet."""
        version = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/versions/{version}")
        return version

    @contextlib.contextmanager
    def _lock(self):
        place, mine = self._at(f"{self.path}/_lock"), uuid.uuid4().hex
        self._files.mkdirs(self._at(self.path))
        until = time.monotonic() + self.patience
        while not self._take(place, mine):
            with contextlib.suppress(Exception):  # it may have gone in the meantime
                age = time.time() - self._files.getFileStatus(place).getModificationTime() / 1000
                if age > self.stale:
                    self._files.delete(place, False)
            if time.monotonic() > until:
                raise TimeoutError(f"{self.path} stays locked")
            time.sleep(0.05)
        try:
            yield
        finally:
            self._files.delete(place, False)

    def _take(self, place, mine: str) -> bool:
        """Make the lock file, which fails where it is there. Hadoop's local files check and create in two steps, so these
        are opened by the operating system."""
        if self._files.getScheme() == "file":
            try:
                os.close(os.open(place.toUri().getPath(), os.O_CREAT | os.O_EXCL))
                return True
            except FileExistsError:
                return False
        try:
            self._put("_lock", mine)
            return True
        except Exception:  # taken: a store says so by errors of its own
            if not self._files.exists(place):
                raise
            return False

    def publish(self, version: str, expected: str | None) -> None:
        """Make a staged version the current one, if ``expected`` still is; else ``Conflict``, and nothing has changed."""
        with self._lock():
            names = self._names("pointers")
            now = names[-1].split("-", 1)[1] if names else None
            if now != expected:
                raise Conflict(f"{self.path}: {now} was published since {expected}")
            number = int(names[-1].split("-", 1)[0]) + 1 if names else 0
            self._put(f"pointers/{number:012d}-{version}", "")

    def replace(self, rows: DataFrame, *expected: str | None) -> str:
        """Write and publish. ``rows`` may be computed from the current version; give the version they were computed from as
        ``expected`` where others write, too (by default it is the one that is current at the call)."""
        expected = expected[0] if expected else self.current()
        version = self.stage(rows)
        try:
            self.publish(version, expected)
        except Conflict:
            self._files.delete(self._at(f"{self.path}/versions/{version}"), True)
            raise
        return version

    def build_once(self, make, force: bool = False) -> bool:
        """Publish what ``make()`` gives unless a version is there; whether it did. Looked up again under the lock: of two
        that build at once, the second one's version is thrown away and the first one's kept."""
        expected = self.current()
        if expected is not None and not force:
            return False
        try:
            self.replace(make(), expected)
        except Conflict:
            if force:
                raise
            return False
        return True

    def prune(self, keep: int = 2) -> list[str]:
        """Remove all but the last ``keep`` published versions; staged ones that were never published stay."""
        with self._lock():
            names = self._names("pointers")
            gone = [n.split("-", 1)[1] for n in names[:-keep]] if keep < len(names) else []
            kept = {n.split("-", 1)[1] for n in names[-keep:]}
            for version in set(gone) - kept:
                self._files.delete(self._at(f"{self.path}/versions/{version}"), True)
            for name in names[:-keep] if keep < len(names) else []:
                self._files.delete(self._at(f"{self.path}/pointers/{name}"), False)
        return sorted(set(gone) - kept)
