"""Shared-storage helpers: where jobs keep their state, and small file calls.

Everything goes through the Hadoop file system API, so the same code works on a
local disk, HDFS or an object store. Only metadata passes here (paths, small
JSON documents); table data is always read and written by Spark jobs.
"""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from tidemark.errors import Refused


def base_dir(spark: SparkSession) -> str:
    """The shared folder of this session, as named in `spark.checkpoint.dir`.

    Where that is unset, the checkpoint folder the context was given; a local
    session that has neither gets a temporary one, a cluster is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise Refused("spark.checkpoint.dir is unset: a cluster needs a shared folder")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir()


def new_dir(spark: SparkSession, label: str) -> str:
    """A directory name nobody has used yet; it is created by the first write."""
    return f"{base_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"


class Files:
    """The few file system calls a ledger needs."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()
        self._context = None

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def mkdirs(self, path: str) -> None:
        self._fs(path).mkdirs(self._path(path))

    def delete(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)

    def names(self, path: str) -> list[str]:
        """Names directly under a directory; a missing directory has none."""
        if not self.exists(path):
            return []
        return [s.getPath().getName() for s in self._fs(path).listStatus(self._path(path))]

    def qualified(self, path: str) -> str:
        """The path as listings print it, with scheme and authority."""
        return self._fs(path).makeQualified(self._path(path)).toString()

    def glob(self, pattern: str) -> list[str]:
        """Paths that match a pattern, hidden ones too; none where nothing does."""
        found = self._fs(pattern).globStatus(self._path(pattern))
        return [] if found is None else [s.getPath().toString() for s in found]

    def files_below(self, path: str) -> list[tuple[str, int, int]]:
        """(path, bytes, milliseconds of the last change) of a file, or of all files below a directory."""
        out, files = [], self._fs(path).listFiles(self._path(path), True)
        while files.hasNext():
            status = files.next()
            out.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
        return out

    def total_bytes(self, path: str) -> int:
        """Bytes of a file, or of everything below a directory."""
        return self._fs(path).getContentSummary(self._path(path)).getLength()

    def sizes(self, path: str) -> dict[str, int]:
        """Name to size of the visible files directly under a directory."""
        return {
            s.getPath().getName(): s.getLen()
            for s in self._fs(path).listStatus(self._path(path))
            if s.isFile() and not s.getPath().getName().startswith(("_", "."))
        }

    def read_text(self, path: str) -> str:
        stream = self._fs(path).open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        out = self._fs(path).create(self._path(path), True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()

    def rename_new(self, src: str, dst: str) -> bool:
        """Rename atomically; False when the destination already exists.

        This is the rename a streaming checkpoint itself depends on, so a
        store that can hold the checkpoint can hold the ledger.
        """
        options = self._jvm.org.apache.hadoop.fs.Options
        none = self._gateway.new_array(options.Rename, 1)
        none[0] = options.Rename.NONE
        if self._context is None:
            contexts = self._jvm.org.apache.hadoop.fs.FileContext
            self._context = contexts.getFileContext(self._path(dst).toUri(), self._conf)
        try:
            self._context.rename(self._path(src), self._path(dst), none)
            return True
        except Py4JJavaError as err:
            if "FileAlreadyExistsException" in err.java_exception.getClass().getName():
                return False
            raise

    def publish_text(self, path: str, text: str) -> bool:
        """Create a file with its whole content at once, or return False."""
        parent, name = path.rsplit("/", 1)
        staged = f"{parent}/.{name}.{uuid.uuid4().hex}"
        self.write_text(staged, text)
        if self.rename_new(staged, path):
            return True
        self.delete(staged)
        return False

    def copy_tree(self, src: str, dst: str) -> None:
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(
            self._fs(src), self._path(src), self._fs(dst), self._path(dst), False, self._conf
        )
