"""Fitted pipelines kept by version below a shared folder.

`<root>/<name>/<version>/model` is what `MLWriter` wrote, `<version>/meta` one row with the features, a hash of their
schema, the metrics and the time; `<root>/<name>/latest` names the version in use. The pointer is written aside and
moved over the old one in one step, so a reader sees the old or the new version and never half of one: a
version that was not finished is not pointed at. Of two writers the one that moves its pointer last wins; both
versions stay.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from uuid import uuid4

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

META = "name string, version string, features array<string>, schema_hash string, metrics map<string,double>, saved_at string"


@dataclass(frozen=True)
class Saved:
    """What is known of a version beside its model."""
    name: str
    version: str
    features: tuple[str, ...]
    schema_hash: str
    metrics: dict[str, float]
    saved_at: str


def schema_hash(rows: DataFrame, features: Sequence[str]) -> str:
    """Digest of the features' names and types, in order."""
    types = dict(rows.dtypes)
    missing = [f for f in features if f not in types]
    if missing:
        raise ValueError(f"rows lack the features {', '.join(missing)}")
    return hashlib.sha256(json.dumps([[f, types[f]] for f in features]).encode()).hexdigest()


class ModelStore:
    """Models of one root folder, which every executor must reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _path(self, place: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{place}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self, name: str) -> list[str]:
        """Finished versions, oldest first."""
        files, folder = self._files(), self._path(name)
        if not files.exists(folder):
            return []
        found = [s.getPath().getName() for s in files.listStatus(folder) if s.isDirectory()]
        return sorted(v for v in found if files.exists(self._path(f"{name}/{v}/meta/_SUCCESS")))

    def latest(self, name: str) -> str:
        files, pointer = self._files(), self._path(f"{name}/latest")
        if not files.exists(pointer):
            raise FileNotFoundError(f"no version of model {name!r} below {self.root}")
        stream = files.open(pointer)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def use(self, name: str, version: str) -> None:
        """Point `latest` at a finished version, in one step."""
        if version not in self.versions(name):
            raise ValueError(f"model {name!r} has no version {version!r}; known: {', '.join(self.versions(name)) or 'none'}")
        files, aside = self._files(), self._path(f"{name}/.latest-{uuid4().hex}")
        stream = files.create(aside, True)
        try:
            stream.write(bytearray(version.encode()))
        finally:
            stream.close()
        jvm = self.spark._jvm
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(aside, self._path(f"{name}/latest"), options)

    def save(self, name: str, model: PipelineModel, rows: DataFrame, features: Sequence[str], metrics: dict[str, float] | None = None) -> str:
        """Write a new version fitted on `rows`, make it the latest and return its name."""
        now = datetime.now(timezone.utc)
        version = f"{now:%Y%m%dT%H%M%S%fZ}-{uuid4().hex[:8]}"
        model.write().save(f"{self.root}/{name}/{version}/model")
        row = (name, version, list(features), schema_hash(rows, features), {k: float(v) for k, v in (metrics or {}).items()}, now.isoformat())
        self.spark.createDataFrame([row], META).coalesce(1).write.json(f"{self.root}/{name}/{version}/meta")
        self.use(name, version)
        return version

    def load(self, name: str, version: str | None = None, rows: DataFrame | None = None) -> tuple[PipelineModel, Saved]:
        """A version (the latest one by default); `rows` to be scored must have its features with the same types."""
        version = version or self.latest(name)
        if version not in self.versions(name):
            raise ValueError(f"model {name!r} has no version {version!r}; known: {', '.join(self.versions(name)) or 'none'}")
        row = self.spark.read.schema(META).json(f"{self.root}/{name}/{version}/meta").first()
        saved = Saved(row["name"], row["version"], tuple(row["features"]), row["schema_hash"], dict(row["metrics"] or {}), row["saved_at"])
        if rows is not None and schema_hash(rows, saved.features) != saved.schema_hash:
            raise ValueError(f"the rows' features have other types than those of model {name!r}, version {version!r}")
        return PipelineModel.load(f"{self.root}/{name}/{version}/model"), saved
