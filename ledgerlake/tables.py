"""Tables on plain files with snapshots: a version is a list of immutable files, and a pointer says which one holds.

Files lie in buckets by a hash of the key (BUCKETS of them), so a change costs what it touches: an insert adds files
for its new rows, an upsert or delete writes the buckets anew in which it has rows, and all other files are carried
over by name. Readers see the old version or the new one, never a mixture; a crash before the pointer moves leaves
files that no version names, which vacuum() removes. There is one writer at a time. Paths may be on any file system
that Spark knows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.changes import latest_per_key

POINTER, BUCKET, BUCKETS = "_CURRENT", "_bucket", 32


class VersionedTable:
    """key: the columns that rows are bucketed by; without them all rows are in one bucket."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str] = (), buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), list(key), buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), conf)

    # --- versions

    def _at(self, name: str):
        return self._path(f"{self.path}/{name}")

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        stream = self._fs.create(self._at(name), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def version(self) -> int | None:
        return int(self._text(POINTER)) if self._fs.exists(self._at(POINTER)) else None

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def exists(self) -> bool:
        return self.version() is not None

    def _manifest(self, version: int | None = None) -> dict:
        v = self.version() if version is None else version
        if v is None:
            raise FileNotFoundError(f"no version of {self.path}")
        return json.loads(self._text(f"v{v}.json"))

    def _publish(self, files: dict[str, list[str]], schema: dict) -> int:
        """files: the names of the files in each bucket. The manifest is written first, and then the pointer moves."""
        v = max([0, *self.versions()]) + 1
        self._write(f"v{v}.json", json.dumps({"files": files, "schema": schema}))
        self._write(f"{POINTER}.tmp", str(v))
        rename = getattr(self.spark.sparkContext._jvm, "org.apache.hadoop.fs.Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self._context.rename(self._at(f"{POINTER}.tmp"), self._at(POINTER), options)
        return v

    # --- files

    def _bucket(self, key: Sequence[str]) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int") if key else F.lit(0)

    def _add(self, rows: DataFrame, key: Sequence[str] | None = None) -> dict[str, list[str]]:
        """Writes rows into new files; the files of each bucket."""
        made = f"data-{uuid.uuid4().hex}"
        key = self.key if key is None else key
        told = rows.withColumn(BUCKET, self._bucket(key))
        told = told.repartition(BUCKET) if key else told
        told.write.partitionBy(BUCKET).parquet(f"{self.path}/{made}")
        files: dict[str, list[str]] = {}
        for folder in self._fs.listStatus(self._at(made)):
            name = folder.getPath().getName()
            if name.startswith(f"{BUCKET}="):
                files[name.split("=")[1]] = [f"{made}/{name}/{s.getPath().getName()}" for s in self._fs.listStatus(folder.getPath()) if s.getPath().getName().endswith(".parquet")]
        return files

    def _rows(self, files: list[str], schema: dict) -> DataFrame:
        from pyspark.sql import types as T

        shape = T.StructType.fromJson(schema)
        return self.spark.read.schema(shape).parquet(*(f"{self.path}/{f}" for f in files)) if files else self.spark.createDataFrame([], shape)

    def read(self, version: int | None = None, buckets: Sequence[str] | None = None) -> DataFrame:
        found = self._manifest(version)
        return self._rows([f for b, names in found["files"].items() if buckets is None or b in buckets for f in names], found["schema"])

    @staticmethod
    def _merged(old: dict, new: dict) -> dict:
        """The columns of both schemas, the old ones first; files that lack a column read as null there."""
        have = {f["name"] for f in old["fields"]}
        return {"type": "struct", "fields": [*old["fields"], *(f | {"nullable": True} for f in new["fields"] if f["name"] not in have)]}

    @staticmethod
    def _shape(rows: DataFrame) -> dict:
        shape = json.loads(rows.schema.json())
        return {"type": "struct", "fields": [f | {"nullable": True} for f in shape["fields"]]}

    def _with(self, old: dict, added: dict[str, list[str]], gone: Sequence[str] = (), schema: dict | None = None) -> int:
        """A version with the old files, less those of the buckets in gone, and the added ones."""
        files = {b: names for b, names in old["files"].items() if b not in set(gone)}
        for b, names in added.items():
            files[b] = [*files.get(b, []), *names]
        return self._publish(files, schema or old["schema"])

    # --- changes

    def overwrite(self, rows: DataFrame) -> int:
        return self._publish(self._add(rows), self._shape(rows))

    def create_if_absent(self, like: DataFrame) -> None:
        if not self.exists():
            self._publish({}, self._shape(like))

    def append(self, rows: DataFrame) -> int:
        if not self.exists():
            return self.overwrite(rows)
        old = self._manifest()
        return self._with(old, self._add(rows), schema=self._merged(old["schema"], self._shape(rows)))

    def insert_only(self, rows: DataFrame, key: Sequence[str]) -> int:
        """Adds the rows whose key isn't there, nulls in it being equal to each other; of rows with equal keys one. New
        columns are added. Only the keys of what is there are read, and nothing of it is written."""
        fresh = rows.dropDuplicates(list(key))
        if not self.exists():
            return self.overwrite(fresh)
        old = self._manifest()
        have = self.read().select(*(F.col(k).alias(f"_have_{k}") for k in key))
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_have_{k}")) for k in key])
        added = self._add(fresh.join(have, same, "left_anti"))
        return self._with(old, added, schema=self._merged(old["schema"], self._shape(rows)))

    def upsert_newer(self, rows: DataFrame, pk: str, order: Sequence[str] = ("source_lsn", "_kafka_offset")) -> int:
        """The newest row of each key of what is there and what comes; at a tie what is there stays. Rows without a
        key are not taken. The order of batches makes no difference. Only buckets that rows come for are written; the
        table's key is pk."""
        self.key = self.key or [pk]
        if self.key != [pk]:
            raise ValueError(f"{self.path} is bucketed by {self.key}, not by {pk}")
        fresh = latest_per_key(rows.filter(F.col(pk).isNotNull()), pk, order)
        if not self.exists():
            return self.overwrite(fresh)
        old, held = self._manifest(), fresh.persist()
        try:
            touched = [str(r[0]) for r in held.select(self._bucket([pk])).distinct().collect()]  # at most `buckets`
            both = self.read(buckets=touched).withColumn("_old", F.lit(1)).unionByName(held.withColumn("_old", F.lit(0)), allowMissingColumns=True)
            added = self._add(latest_per_key(both, pk, [*order, "_old"]).drop("_old"))
            return self._with(old, added, touched, self._merged(old["schema"], self._shape(rows)))
        finally:
            held.unpersist()

    def delete(self, condition: Column) -> int:
        """Buckets without a row that meets the condition stay as they are."""
        old = self._manifest()
        meets = F.coalesce(condition, F.lit(False))
        hit = [r[0] for r in self.read().filter(meets).select(F.regexp_extract(F.col("_metadata.file_path"), f"{BUCKET}=(\\d+)/", 1)).distinct().collect()] if any(old["files"].values()) else []
        return self._with(old, self._add(self.read(buckets=hit).filter(~meets)), hit)

    def compact(self, size: int = 512 << 20) -> int:
        """One file for each bucket that has several; without a key, as many as rows of that size need."""
        old = self._manifest()
        many = [b for b, names in old["files"].items() if len(names) > 1]
        if not many:
            return self.version() or 0
        rows = self.read(buckets=many)
        if not self.key:
            rows = rows.coalesce(max(1, -(-self.detail()["bytes"] // size)))
        return self._with(old, self._add(rows), many)

    def vacuum(self, keep: int = 1) -> list[int]:
        """Removes all versions but the current one and the keep - 1 before it, and files that none of these names."""
        now = self.version()
        if now is None:
            return []
        gone = [v for v in self.versions() if v > now] + [v for v in self.versions() if v <= now][:-keep]
        for v in gone:
            self._fs.delete(self._at(f"v{v}.json"), False)
        named = {f for v in self.versions() for names in self._manifest(v)["files"].values() for f in names}
        for data in self._fs.listStatus(self._path(self.path)):
            made = data.getPath().getName()
            if not made.startswith("data-"):
                continue
            if not any(f.startswith(f"{made}/") for f in named):
                self._fs.delete(data.getPath(), True)
                continue
            for folder in self._fs.listStatus(data.getPath()):
                if folder.isDirectory():
                    for s in self._fs.listStatus(folder.getPath()):
                        if s.getPath().getName().endswith(".parquet") and f"{made}/{folder.getPath().getName()}/{s.getPath().getName()}" not in named:
                            self._fs.delete(s.getPath(), False)
        return gone

    def drop(self) -> None:
        self._fs.delete(self._path(self.path), True)

    def files(self) -> list[str]:
        return sorted(f for names in self._manifest()["files"].values() for f in names)

    def detail(self) -> dict[str, int]:
        names = self.files()
        return {"files": len(names), "bytes": sum(self._fs.getFileStatus(self._at(f)).getLen() for f in names)}
