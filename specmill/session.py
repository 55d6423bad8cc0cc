"""Session helpers: settings the operators rely on, and lineage cuts that survive executor loss."""

from __future__ import annotations

import hashlib
import io
import tempfile
import zipfile
from pathlib import Path
from threading import Lock
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(master: str | None = None, app: str = "specmill", **conf) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return ship(b.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable on the workers, once per application, from wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_specmill_shipped", None) != sc.applicationId:
        root = Path(__file__).resolve().parent
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, str(Path(root.name) / f.relative_to(root)))
        path = Path(tempfile.mkdtemp(prefix="specmill-ship-")) / "specmill.zip"
        path.write_bytes(held.getvalue())
        sc.addPyFile(str(path))
        sc._specmill_shipped = sc.applicationId
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Where that is unset a local session gets a temp folder; on a cluster executors and driver would each write to disks of their
    own, so there it is an error.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path and not sc.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not path:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="specmill-ckpt-"))
        path = sc.getCheckpointDir()
    return path


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a result that several jobs read."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


LISTED = 1_000
_STORED: dict[tuple[str, str], str] = {}
_STORING = Lock()


def source_key(*tables: DataFrame) -> str:
    """Names, sizes and times of the files that tables are read from, as one number: another content gives another key.

    Files are only listed, by the driver, or by a job of one row per file if there are many.
    """
    spark, names = tables[0].sparkSession, sorted(f for t in tables for f in t.inputFiles())
    if len(names) > LISTED:
        files = spark.read.format("binaryFile").load(names).select("path", "length", "modificationTime")
        return f"{files.agg(F.sum(F.xxhash64('*').cast('decimal(38,0)'))).first()[0]}"
    jvm, conf, listed = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for f in names:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f))
        status = path.getFileSystem(conf).getFileStatus(path)
        listed.append((f, status.getLen(), status.getModificationTime()))
    return hashlib.sha256(repr(listed).encode()).hexdigest()[:32]


def stored(spark: SparkSession, name: str, build) -> DataFrame:
    """A table built once per application and ``name``, in the shared folder, and read from there afterwards.

    ``name`` must say what the table is made from (``source_key``). Each build has a folder of its own, and only a finished one is
    read; of threads that ask at once, one builds.
    """
    key = (spark.sparkContext.applicationId, name)
    with _STORING:
        if key not in _STORED:
            path = f"{shared_dir(spark)}/specmill-{key[0]}/{name}-{uuid4().hex}"
            build().write.parquet(path)
            _STORED[key] = path
    return spark.read.parquet(_STORED[key])
