"""A store of rows by key that is appended to, where an append that is run again changes nothing (SNK-1, SNK-4, JOB-5).

An append writes its rows into a folder of its own (an attempt) and is published by one
small file, its entry in the log.  Readers follow the log, so rows of an
attempt that failed or was not published are never seen, and a job that is run again
skips the keys that are in the store already.  A key (a source file) is in one
attempt at most.

Two writers at a time: an entry's number is taken by a rename that fails where the name
exists (on local disks by a link); who loses looks at the log again and is refused if the winner
has brought one of its keys.  An object store needs a file system that renames so.

``path/data/store_attempt=<id>``  rows, partitioned by ``partition_by`` and the key
``path/attempts/<id>/keys``   (key, rows)
``path/attempts/<id>/entry``  the attempt's id and its rows' schema, as JSON
``path/log/<number>``         the entry of a published attempt
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_ATTEMPT = "store_attempt"


class KeyInStore(ValueError):
    """An append holds keys that the store has already."""


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str, key: str = "file_key", partition_by: Sequence[str] = ()):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.partition_by = [c for c in partition_by if c != key]

    # ------------------------------------------------------------ the log

    def _hadoop(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _entries(self) -> list[str]:
        folder, fs = self._hadoop("log")
        if not fs.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().isdigit())

    def _entry(self, name: str) -> dict:
        path, fs = self._hadoop(name)
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _log(self) -> list[dict]:
        """Entries (attempt, schema) in the order of their publication: one small file a successful append."""
        return [self._entry(f"log/{name}") for name in self._entries()]

    def attempts(self) -> list[str]:
        """Ids of the published attempts, in the order of their publication."""
        return [e["attempt"] for e in self._log()]

    def _enter(self, number: int, attempt: str) -> bool:
        """Take a number of the log; False if somebody has it."""
        jvm = self.spark._jvm
        target, fs = self._hadoop(f"log/{number:012d}")
        own, _ = self._hadoop(f"attempts/{attempt}/entry")
        fs.mkdirs(target.getParent())
        own, target = fs.makeQualified(own), fs.makeQualified(target)
        try:
            if target.toUri().getScheme() == "file":
                place = jvm.java.nio.file.Path.of
                jvm.java.nio.file.Files.createLink(place(target.toUri()), place(own.toUri()))
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
                plain = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                context.rename(own, target, plain)
        except Exception:  # noqa: BLE001  (the JVM's exception types differ by file system)
            if fs.exists(target):
                return False
            raise
        return True

    # ------------------------------------------------------------ keys

    def _keys_of(self, entries: Sequence[dict]) -> DataFrame:
        schema = T.StructType([T.StructField(self.key, self._schema(entries)[self.key].dataType), T.StructField("rows", T.LongType())])
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/attempts/{e['attempt']}/keys" for e in entries])

    def committed(self) -> DataFrame | None:
        """(key, rows) of every key in the store; None while it is empty."""
        log = self._log()
        return self._keys_of(log) if log else None

    # ------------------------------------------------------------ appending

    def write_attempt(self, df: DataFrame) -> str:
        """Write rows where no reader sees them; the attempt's id."""
        attempt = uuid.uuid4().hex
        entry = {"attempt": attempt, "schema": df.schema.jsonValue()}
        df.write.option("compression", "zstd").partitionBy(*self.partition_by, self.key).parquet(f"{self.path}/data/{_ATTEMPT}={attempt}")
        self._scan([entry]).groupBy(self.key).agg(F.count(F.lit(1)).alias("rows")).coalesce(1).write.parquet(f"{self.path}/attempts/{attempt}/keys")
        path, fs = self._hadoop(f"attempts/{attempt}/entry")
        stream = fs.create(path, True)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        return attempt

    def publish(self, attempt: str) -> int:
        """Make an attempt visible; the number of its keys.  Refused if another append has brought one of them."""
        own = self._keys_of([self._entry(f"attempts/{attempt}/entry")])
        while True:
            before = self._log()
            there = self._keys_of(before).select(self.key, F.lit(1).alias("_there")) if before else None
            joined = own.join(there, self.key, "left") if before else own.withColumn("_there", F.lit(None).cast("int"))
            n_keys, unnamed, twice, one = joined.agg(F.count(F.lit(1)), F.count(F.when(F.col(self.key).isNull(), 1)), F.count("_there"),
                                                     F.max(F.when(F.col("_there") == 1, F.col(self.key).cast("string")))).first()
            if unnamed:
                raise ValueError(f"rows without {self.key}")
            if twice:
                raise KeyInStore(f"in the store already: {twice} keys, such as {one}")
            if not n_keys or self._enter(len(before), attempt):
                return n_keys

    def append(self, df: DataFrame, existing: str = "skip") -> int:
        """Add the rows of the keys that are not in the store; how many keys were added.

        ``existing``: what to do about keys that are there: ``skip`` their rows, or ``refuse`` the append.
        """
        if existing not in ("skip", "refuse"):
            raise ValueError(f"existing must be skip or refuse, not {existing!r}")
        done = self.committed()
        if done is not None and existing == "skip":
            df = df.join(done.select(self.key), self.key, "left_anti").select(*df.columns)
        return self.publish(self.write_attempt(df))

    # ------------------------------------------------------------ reading

    def _schema(self, entries: Sequence[dict]) -> T.StructType:
        """Columns of all attempts by name, in the order in which they first appear."""
        fields: dict[str, T.StructField] = {}
        for e in entries:
            for f in T.StructType.fromJson(e["schema"]).fields:
                known = fields.setdefault(f.name, T.StructField(f.name, f.dataType, True))
                if known.dataType != f.dataType:
                    raise ValueError(f"column {f.name} is {known.dataType.simpleString()} and {f.dataType.simpleString()}")
        return T.StructType(list(fields.values()))

    def _folders(self, entries: Sequence[dict]) -> list[str]:
        return [f"{self.path}/data/{_ATTEMPT}={e['attempt']}" for e in entries]

    def _scan(self, entries: Sequence[dict]) -> DataFrame:
        reader = self.spark.read.schema(self._schema(entries).add(_ATTEMPT, T.StringType())).option("basePath", f"{self.path}/data")
        return reader.parquet(*self._folders(entries))

    def source(self) -> tuple[DataFrame, list[str]]:
        """The scan of all published rows, and the folders that it reads (for ``file_order``)."""
        log = self._log()
        if not log:
            raise ValueError(f"nothing has been published in {self.path}")
        return self._scan(log), self._folders(log)

    def read(self, **only: str) -> DataFrame:
        """All rows of the store; ``split="train"`` and the like read one partition."""
        df = self.source()[0].drop(_ATTEMPT)
        for column, value in only.items():
            df = df.where(F.col(column) == value)
        return df
