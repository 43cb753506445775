"""Saving and loading models that hold sub-models or tables.

Params go through ``DefaultParamsWriter`` metadata; sub-models are saved by
their own writers under ``<path>/<attr>/<i>``; tables as Parquet under
``<path>/<attr>``; a small JSON manifest records what is where. Any Hadoop
URI works, so a ``PipelineModel`` containing these stages saves and loads
like one made only of built-in stages.
"""

from __future__ import annotations

import importlib
import json

from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReader, MLWriter
from pyspark.sql import SparkSession


def _cls_name(obj) -> str:
    return f"{type(obj).__module__}.{type(obj).__name__}"


def _load_cls(name: str):
    mod, _, cls = name.rpartition(".")
    return getattr(importlib.import_module(mod), cls)


class CompositeWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        inst = self.instance
        DefaultParamsWriter.saveMetadata(inst, path, self.sc)
        manifest: dict = {"models": {}, "frames": [], "values": {}}
        for attr in getattr(inst, "_sub_models", ()):
            val = getattr(inst, attr, None)
            if val is None:
                continue
            items = val if isinstance(val, list) else [val]
            manifest["models"][attr] = {"list": isinstance(val, list), "classes": [_cls_name(m) for m in items]}
            for i, m in enumerate(items):
                m.write().overwrite().save(f"{path}/{attr}/{i}")
        for attr in getattr(inst, "_sub_frames", ()):
            df = getattr(inst, attr, None)
            if df is not None:
                df.write.mode("overwrite").parquet(f"{path}/{attr}")
                manifest["frames"].append(attr)
        for attr in getattr(inst, "_sub_values", ()):
            manifest["values"][attr] = getattr(inst, attr, None)
        spark = SparkSession.builder.getOrCreate()
        spark.createDataFrame([(json.dumps(manifest),)], "m string").coalesce(1).write.mode("overwrite") \
            .parquet(f"{path}/manifest")


class CompositeReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        meta = DefaultParamsReader.loadMetadata(path, self.sc)
        inst = self.cls()
        inst._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(inst, meta)
        spark = SparkSession.builder.getOrCreate()
        manifest = json.loads(spark.read.parquet(f"{path}/manifest").first()["m"])
        for attr, spec in manifest["models"].items():
            items = [_load_cls(c).load(f"{path}/{attr}/{i}") for i, c in enumerate(spec["classes"])]
            setattr(inst, attr, items if spec["list"] else items[0])
        for attr in manifest["frames"]:
            setattr(inst, attr, spark.read.parquet(f"{path}/{attr}"))
        for attr, v in manifest["values"].items():
            setattr(inst, attr, v)
        return inst


class CompositePersistence:
    """Mixin: set ``_sub_models``, ``_sub_frames``, ``_sub_values`` on the class."""

    _sub_models: tuple = ()
    _sub_frames: tuple = ()
    _sub_values: tuple = ()

    def write(self):
        return CompositeWriter(self)

    @classmethod
    def read(cls):
        return CompositeReader(cls)
