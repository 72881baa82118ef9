"""Session settings the library expects, for tests and local runs.

On a cluster the submitter's configuration wins: every setting here is a
default that ``spark-submit --conf`` may override.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that change results, not only speed.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

# Run-time re-planning: shuffle coalescing and splitting of oversized
# join partitions. The partition count is only the upper bound that AQE
# coalesces from.
ADAPTIVE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(
    app: str = "tallyfold",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SEMANTIC_CONF, **ADAPTIVE_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


_own_scratch: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach, for staged tables and checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a
    session whose executors run in this process gets a temporary folder, as in
    tests; any other raises, since its executors would each write to a disk of
    their own.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_scratch:
        _own_scratch[app] = tempfile.mkdtemp(prefix="tallyfold-")
    return _own_scratch[app]


def new_name(name: str) -> str:
    """``name`` with an ending that nothing else uses."""
    return f"{name}-{uuid.uuid4().hex[:12]}"


def new_scratch(spark: SparkSession, name: str) -> str:
    """A folder name under the scratch root that nothing else uses."""
    return f"{scratch_root(spark)}/{new_name(name)}"
