"""Session settings the operators are tuned for."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}

#: Own folders of plain local sessions, by application.
_OWN: dict[str, str] = {}


def build_session(master: str | None = None, app: str = "seqrisk", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for stored intermediates, readable and writable by the driver and all executors.

    A cluster names it in ``spark.checkpoint.dir``, or the caller has set a checkpoint folder on the
    context. Where neither is set, a plain ``local[...]`` session, whose driver and executor are one
    process, gets a temporary folder of its own; any other master is an error, because no folder that
    this code could make up would be shared.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError(f"{context.master}: set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="seqrisk-checkpoint-")
    return _OWN[context.applicationId]
