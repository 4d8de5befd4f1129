"""Shared scratch storage and shipping of this package to the executors."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Only a session on this machine alone may do without one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "vectide-scratch")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and
    lost executors cost only their own running tasks."""
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def own_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/vectide-{spark.sparkContext.applicationId}"


def counted(df: DataFrame, name: str, *more: Column) -> tuple[DataFrame, tuple]:
    """As ``materialize``, with the number of rows and further aggregates, all told by the job that writes."""
    seen = Observation()
    named = [x.alias(f"x{k}") for k, x in enumerate(more)]
    kept = materialize(df.observe(seen, F.count(F.lit(1)).alias("n"), *named), name)
    return kept, tuple(seen.get[x] for x in ("n", *(f"x{k}" for k in range(len(more)))))


def clear(spark: SparkSession):
    """Deletes what this application has put in the shared folder; results that are read from there end with it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: The setting for the bytes of an Arrow batch, Spark's own value, and ours: large batches of texts fill
#: the memory beside the heap.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m")


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package, once per application, and have texts sent to Python in
    batches of a few MB, unless the session says otherwise."""
    name, usual, ours = BATCH
    if spark.conf.get(name) == usual:
        spark.conf.set(name, ours)
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        path = Path(tempfile.mkdtemp(prefix="vectide-")) / "vectide_pkg.zip"
        path.write_bytes(data.getvalue())
        spark.sparkContext.addPyFile(str(path))
        _SHIPPED.add(app)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(columns: list[str], *names: str) -> list[str]:
    """Names for own columns beside ``columns``: the given ones, longer where they are taken."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(columns: list[str], *names: str) -> list[str]:
    """``columns`` but for those that are about to be made anew."""
    return [c for c in columns if c.lower() not in names]
