"""Versioned Parquet tables with a manifest: readers keep a version, a writer publishes a whole new one.

A version is current as soon as its manifest, a file of its own, has its name; older manifests stay behind it. A writer that
is killed leaves files that no manifest names, never a store without one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..schema import SCHEMA_VERSION, TABLES

#: Manifests that stay.
KEEP = 10
FINGERPRINT = ("model", "model_version", "dimension", "chunk_policy", "quantization")


class Store:
    """Files are reached by Hadoop's file systems only, so that a store can lie wherever Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        if self._newest() is None:
            if held := [n for n in TABLES if self._fs.exists(self._path(f"{self.root}/{n}"))]:
                raise ValueError(f"{self.root} has tables ({', '.join(held)}) and no manifest")
            self._publish({"schema_version": SCHEMA_VERSION, "instance_uuid": uuid.uuid4().hex, "version": 0, "tables": {}, "fingerprint": None})
        self.manifest = self._read()

    def _manifests(self) -> list[str]:
        if not self._fs.exists(self._path(self.root)):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(self._path(self.root)))
        return sorted(n for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def _newest(self) -> str | None:
        return max(self._manifests(), default=None)

    def _read(self) -> dict:
        lines = self.spark.read.text(f"{self.root}/{self._newest()}", wholetext=True).collect()
        return json.loads(lines[0][0])

    def _publish(self, manifest: dict) -> None:
        """The new manifest gets its name in one step, which fails if another writer has taken it."""
        number = int((self._newest() or "manifest-0000000000.json")[9:-5]) + 1
        new, to = self._path(f"{self.root}/_manifest-{uuid.uuid4().hex}"), self._path(f"{self.root}/manifest-{number:010d}.json")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if self._fs.exists(to) or not self._fs.rename(new, to):
            raise RuntimeError(f"another writer has published {to.getName()}")
        self.manifest = manifest
        for old in self._manifests()[:-KEEP]:
            self._fs.delete(self._path(f"{self.root}/{old}"), False)

    def table(self, name: str) -> DataFrame:
        path = self.manifest["tables"].get(name)
        return self.spark.read.schema(TABLES[name]).parquet(path) if path else self.spark.createDataFrame([], TABLES[name])

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        """Writes a table that no manifest names yet, so that it is computed once; commit() takes it up as it is."""
        path = f"{self.root}/{name}/staged-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged = path
        return out

    def commit(self, **tables: DataFrame) -> int:
        """Writes the given tables, then makes them current all at once."""
        version = self.manifest["version"] + 1
        paths = dict(self.manifest["tables"])
        for name, df in tables.items():
            path = getattr(df, "_staged", None) or f"{self.root}/{name}/v{version:06d}-{uuid.uuid4().hex[:8]}"
            if not hasattr(df, "_staged"):
                df.select(*TABLES[name].names).write.parquet(path)
            paths[name] = path
        self._publish(self.manifest | {"version": version, "tables": paths})
        return version

    def snapshot(self, target: str) -> None:
        """A compact copy of the current version, a store itself; what was there before is removed."""
        self._fs.delete(self._path(target), True)
        copy = Store(self.spark, target)
        copy.commit(**{name: self.table(name) for name in self.manifest["tables"]})
        copy._publish(copy.manifest | {k: self.manifest[k] for k in ("schema_version", "fingerprint")})

    def migrate(self, steps: dict[int, object], snapshot: str | None = None) -> int:
        """Runs the steps above the current schema version in order, each published by itself."""
        todo = sorted(v for v in steps if v > self.manifest["schema_version"])
        if todo and snapshot:
            self.snapshot(snapshot)
        for v in todo:
            self.commit(**(steps[v](self) or {}))
            self._publish(self.manifest | {"schema_version": v})
        return self.manifest["schema_version"]

    def check_fingerprint(self, **parts: object) -> None:
        """An index without a fingerprint takes any; another one than the index has is an error."""
        held = self.manifest["fingerprint"]
        if held is not None and {k: parts.get(k) for k in FINGERPRINT} != held:
            raise ValueError(f"fingerprint mismatch: the index has {held}")

    def write_fingerprint(self, **parts: object) -> None:
        self.check_fingerprint(**parts)
        self._publish(self.manifest | {"fingerprint": {k: parts.get(k) for k in FINGERPRINT}})

    def semantic_compatible(self, quantization: str) -> tuple[bool, str]:
        """Whether vector search may run: an index without a fingerprint is open, another quantisation closes it."""
        held = self.manifest["fingerprint"]
        if held is None or held.get("quantization") == quantization:
            return True, ""
        return False, f"index has {held.get('quantization')}"
