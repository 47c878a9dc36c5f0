"""Numbered JSON files in a folder that all sessions reach: each appears whole, under the next number, or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class NumberedFiles:
    """Files of one prefix. File operations go through Hadoop. That two writers of one number can't both succeed rests on a rename that
    refuses an existing target, which HDFS does in one step; elsewhere the file is read again after the rename, and one who
    finds another's fails. Object stores that copy on rename leave a gap there: use one writer, as the flows do."""

    prefix = "_FILE-"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _states(self) -> list:
        """The files, oldest first."""
        fs, pattern = self._file(f"{self.prefix}*")
        return sorted((s.getPath() for s in fs.globStatus(pattern) or []), key=lambda p: p.getName())

    def _load(self, path) -> dict:
        stream = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, from_, to) -> None:
        """Renames a file; an existing target is never overwritten."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        options = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        hadoop.FileContext.getFileContext(to.toUri(), self.spark._jsc.hadoopConfiguration()).rename(from_, to, options)

    def put(self, content: dict, number: int) -> list:
        """Writes the file of a number, which has to follow the newest one; the files that there were before."""
        writer = uuid.uuid4().hex
        fs, next_ = self._file(f"_NEXT-{writer}")
        out = fs.create(next_, False)
        out.write(bytearray(json.dumps(content | {"writer": writer}).encode()))
        out.close()
        _, path = self._file(f"{self.prefix}{number:012d}")
        before = self._states()
        newest = int(before[-1].getName().removeprefix(self.prefix)) if before else -1
        stale = RuntimeError(f"{self.path}: another writer has committed since number {number - 1} was read")
        if newest != number - 1:
            fs.delete(next_, False)
            raise stale
        try:
            self._publish(next_, path)
        except Exception as e:  # py4j wraps the store's FileAlreadyExistsException
            if not fs.exists(path):
                raise
            raise stale from e
        if self._load(path)["writer"] != writer:
            raise stale
        return before
