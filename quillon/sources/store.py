"""Stored bytes and published folders through Hadoop's file systems, so that every executor and any shared store will do."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from quillon.functions.scalars import canonical_json
from quillon.sources.readers import MAX_BYTES, Refused

MANIFEST = "manifest.json"


def shared_root(spark: SparkSession) -> str:
    """A fresh folder that all executors see: under ``spark.checkpoint.dir``; under one of our own only where a local session has none."""
    context = spark.sparkContext
    top = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not top:
        if not re.match(r"local(\[|$)", context.master):
            raise Refused("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
        top = context.getCheckpointDir()
    return f"{top.rstrip('/')}/store-{uuid.uuid4().hex}"


class Store:
    """A folder of named files, raw copies known by their digest, and published folders."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, (root or shared_root(spark)).rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}".rstrip("/")

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.path(name))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def remove(self, name: str) -> bool:
        return self._fs.delete(self._at(name), True)

    def names(self, name: str = "") -> list[str]:
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._at(name))) if self.exists(name) else []

    def put(self, name: str, data: bytes) -> None:
        """A new file; one that is there is not replaced."""
        out = self._fs.create(self._at(name), False)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def read(self, name: str, most: int = MAX_BYTES) -> bytes:
        """A regular file within a size, in one read."""
        if not self.exists(name) or not self._fs.getFileStatus(self._at(name)).isFile():
            raise Refused(f"{name} is no file")
        if self._fs.getFileStatus(self._at(name)).getLen() > most:
            raise Refused(f"{name} is larger than the limit")
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def put_raw(self, data: bytes, folder: str = "raw") -> tuple[str, bool]:
        """A copy under its own digest, and whether it is new; one that is there must still be what its name says."""
        digest = hashlib.sha256(data).hexdigest()
        if self.exists(f"{folder}/{digest}"):
            if hashlib.sha256(self.read(f"{folder}/{digest}")).hexdigest() != digest:
                raise Refused(f"{digest} has been changed")
            return digest, False
        self.put(f"{folder}/{digest}", data)
        return digest, True

    def _publish(self, name: str, temp: str, manifest: dict) -> bool:
        """Move a complete folder to its name; a second time must be equal. True if it is new."""
        self.put(f"{temp}/{MANIFEST}", canonical_json(manifest).encode())
        if not self.exists(name) and self._fs.rename(self._at(temp), self._at(name)):
            return True
        self.remove(temp)
        if json.loads(self.read(f"{name}/{MANIFEST}")) != json.loads(canonical_json(manifest)):
            raise Refused(f"{name} is there with other contents")
        return False

    def publish(self, name: str, files: dict[str, bytes]) -> bool:
        """Files and a manifest under a name, complete or not at all."""
        temp = f".{name}.{uuid.uuid4().hex}"
        for n, data in files.items():
            self.put(f"{temp}/{n}", data)
        return self._publish(name, temp, {n: hashlib.sha256(data).hexdigest() for n, data in files.items()})

    def publish_tables(self, name: str, tables: dict[str, DataFrame], form: str = "parquet") -> bool:
        """Tables of any size, written in parallel, with rows, columns and a digest of each in the manifest."""
        temp, manifest = f".{name}.{uuid.uuid4().hex}", {}
        for n, df in tables.items():
            writer = df.write.option("header", True) if form == "csv" else df.write
            writer.format(form).save(self.path(f"{temp}/{n}"))
            back = self.table(f"{temp}/{n}", form, df)
            manifest[n] = {"rows": back.count(), "columns": [list(c) for c in back.dtypes], "digest": _digest(back), "form": form}
        return self._publish(name, temp, manifest)

    def table(self, name: str, form: str = "parquet", like: DataFrame | None = None) -> DataFrame:
        reader = self.spark.read.option("header", True) if form == "csv" else self.spark.read
        return (reader.schema(like.schema) if like is not None else reader).format(form).load(self.path(name))

    def manifest(self, name: str) -> dict:
        return json.loads(self.read(f"{name}/{MANIFEST}"))

    def verified(self, name: str) -> dict[str, bool]:
        """By table or file of a published folder: whether it is what the manifest says."""
        out = {}
        for n, said in self.manifest(name).items():
            if isinstance(said, str):
                out[n] = hashlib.sha256(self.read(f"{name}/{n}")).hexdigest() == said
            else:
                reader = self.spark.read.option("header", True) if said["form"] == "csv" else self.spark.read
                out[n] = _digest(reader.schema(", ".join(f"`{c}` {k}" for c, k in said["columns"])).format(said["form"]).load(self.path(f"{name}/{n}"))) == said["digest"]
        return out

    def sweep(self) -> int:
        """Remove what broken-off publications left; how many."""
        stale = [n for n in self.names() if n.startswith(".")]
        for n in stale:
            self.remove(n)
        return len(stale)


def _digest(df: DataFrame) -> str:
    from quillon.plans.requests import digest

    return digest(df)
