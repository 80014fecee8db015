"""Saved models, found again by what they were trained on."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from ..session import shared_folder
from . import models


def digest(rows: DataFrame) -> str:
    """Digest of a table's rows, whatever their order and partitioning."""
    names = sorted(rows.columns)
    hashed = rows.select(F.xxhash64(*names).cast("decimal(20,0)").alias("h"), F.hash(*names).cast("long").alias("g"))
    found = hashed.agg(F.count(F.lit(1)), F.sum("h"), F.sum("g")).first()
    return hashlib.md5(json.dumps([names, *map(str, found)]).encode()).hexdigest()


def path_of(rows: DataFrame, variant: str, on: str = "train", folder: str | None = None, **options) -> str:
    """Where the model of a variant, its settings and these rows is kept."""
    settings = {**models.VARIANTS[variant][2], **options}
    key = hashlib.md5(json.dumps([variant, on, settings, digest(rows)], sort_keys=True).encode()).hexdigest()
    return f"{(folder or shared_folder(rows.sparkSession)).rstrip('/')}/models/{variant}-{on}-{key}"


def stored(rows: DataFrame, variant: str, on: str = "train", folder: str | None = None, **options) -> PipelineModel:
    """The saved model of a variant for ``prepared`` rows; trained and saved if there is none.

    Other rows, settings or another part are another model. It is saved beside
    its place and renamed, so a model is whole or absent; of two that are
    trained at the same time the first one stays. The result is always loaded
    from the files, so every caller scores with the same artefact.
    """
    spark = rows.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path_of(rows, variant, on, folder, **options))
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        draft = spark._jvm.org.apache.hadoop.fs.Path(f"{place.getParent().toString()}/.{uuid.uuid4().hex}")
        models.save(models.train(rows, variant, on, **options), draft.toString())
        if files.exists(place) or not files.rename(draft, place):
            files.delete(draft, True)
    return models.load(place.toString())
