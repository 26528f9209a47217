"""An append-only table of events in files that can be rewritten without a moment in which they are not there.

A log is a folder for each generation: ``path``, ``path-1``, ``path-2``, ... Events are appended to the newest generation that
is complete. A rewrite fills the next one and marks it complete when all is written, so whoever stops in between leaves the
one before in force. The generation before stays until the next rewrite, for readers that began with it.

Files are dealt by ranges of the key, sorted by it and have Bloom filters of it, so events of one key are found in few files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMPLETE = "_complete"


class EventLog:
    """Events of a schema with ``seq`` and a ``key`` column; ``span`` keys share a folder."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, span: int = 10_000) -> None:
        self.spark, self.path, self.schema, self.key, self.span = spark, path, schema, key, span
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.generation = max(self._complete())
        system, at = self._at(self.folder())
        if not system.exists(at):
            self._write(spark.createDataFrame([], schema), self.folder())
        self.appended = self._files() - self._kept()

    def _at(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self._conf), at

    def folder(self, generation: int | None = None) -> str:
        n = self.generation if generation is None else generation
        return f"{self.path}-{n}" if n else self.path

    def _generations(self) -> list[int]:
        system, at = self._at(self.path)
        found = system.globStatus(self._jvm.org.apache.hadoop.fs.Path(f"{self.path}-*"))
        names = [f.getPath().getName().removeprefix(f"{at.getName()}-") for f in found or []]
        return [0, *(int(n) for n in names if n.isdigit())]

    def _complete(self) -> list[int]:
        """Generations that count; the first needs no mark."""
        marked = lambda n: n == 0 or (lambda s, a: s.exists(a))(*self._at(f"{self.folder(n)}/{COMPLETE}"))
        return [n for n in self._generations() if marked(n)]

    def _files(self) -> int:
        system, at = self._at(self.folder())
        found, n = system.listFiles(at, True), 0
        while found.hasNext():
            n += found.next().getPath().getName().endswith(".parquet")
        return n

    def _kept(self) -> int:
        """Files of the newest generation that its rewrite made."""
        if not self.generation:
            return 0
        system, at = self._at(f"{self.folder()}/{COMPLETE}")
        mark = system.open(at)
        try:
            return int(mark.readUTF())
        finally:
            mark.close()

    def _part(self) -> Column:
        return F.floor(F.col(self.key) / self.span).alias("part")

    def _write(self, rows: DataFrame, folder: str, mode: str = "append") -> None:
        out = rows.withColumn("part", self._part()).write.mode(mode).partitionBy("part")
        out.option(f"parquet.bloom.filter.enabled#{self.key}", "true").parquet(folder)

    def read(self, key: int | None = None) -> DataFrame:
        """All events, or those of one key: only its range's folder is listed, and there the files that can hold it are read."""
        rows = self.spark.read.schema(f"{self.schema}, part long").parquet(self.folder())
        return (rows if key is None else rows.where((F.col("part") == key // self.span) & (F.col(self.key) == key))).drop("part")

    def append(self, rows: list[tuple]) -> None:
        """Few events, as one file for each range of keys."""
        if rows:
            self._write(self.spark.createDataFrame(rows, self.schema).coalesce(1), self.folder())
            self.appended += 1

    def rewrite(self, rows: DataFrame) -> None:
        """These events instead of all others."""
        old, new = self.generation, max(self._generations()) + 1
        try:
            self._write(rows.repartitionByRange(self.key).sortWithinPartitions(self.key, "seq"), self.folder(new), "overwrite")
            self.generation = new
            self._mark()
        except BaseException:
            self.generation = old
            raise
        self.appended = 0
        self._remove([n for n in self._generations() if n not in (old, new)])

    def _mark(self) -> None:
        """From here on the generation counts."""
        made, (system, at) = self._files(), self._at(f"{self.folder()}/{COMPLETE}")
        mark = system.create(at, True)
        try:
            mark.writeUTF(str(made))
        finally:
            mark.close()

    def _remove(self, generations: list[int]) -> None:
        for n in generations:
            system, at = self._at(self.folder(n))
            system.delete(at, True)
