"""Session helpers.

``get_spark`` is a convenience for scripts and tests. Library code never
creates a session; it takes the one its input DataFrame belongs to.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # image rows are large: keep Arrow batches small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(
    master: str | None = None,
    app_name: str = "panelscope",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder the cluster names.

    The cluster's ``spark.checkpoint.dir`` always wins. Only when it is
    unset (local runs, tests) a folder is set: ``fallback`` or a fresh
    temporary one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not fallback and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = fallback or tempfile.mkdtemp(prefix="panelscope-ckpt-")
    os.makedirs(path, exist_ok=True)
    spark.sparkContext.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/panelscope-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: what follows sees
    the same rows however often it is evaluated, lost executors included."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions the session is sized for."""
    try:
        return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    except (TypeError, ValueError):
        return 200


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``panelscope`` importable in the Python workers (pandas UDFs
    reference its functions): zip the package into the shared checkpoint
    folder once per SparkContext and ``addPyFile`` it. On a cluster the usual
    alternative is ``--py-files``."""
    import hashlib
    import io
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    data = buf.getvalue()
    name = f"panelscope-{hashlib.sha1(data).hexdigest()[:12]}.zip"
    target = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    local = target[len("file:"):] if target.startswith("file:") else target
    if "://" not in target or target.startswith("file:"):
        local = local.lstrip("/") and ("/" + local.lstrip("/"))
        with open(local, "wb") as fh:
            fh.write(data)
    else:  # remote shared folder: copy through the Hadoop file system
        tmp = tempfile.NamedTemporaryFile(suffix=".zip", delete=False)
        tmp.write(data)
        tmp.close()
        jvm = spark._jvm
        dst = jvm.org.apache.hadoop.fs.Path(target)
        dst.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(jvm.org.apache.hadoop.fs.Path(tmp.name), dst)
    sc.addPyFile(target)
    _SHIPPED.add(app)
