"""What every query needs of its session."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application; workers that have it on their path already are served from there."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, dirs, names in os.walk(home):
            dirs[:] = sorted(d for d in dirs if d != "__pycache__")
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.relpath(path, os.path.dirname(home)))
    path = os.path.join(tempfile.mkdtemp(), "barloom_package.zip")
    with open(path, "wb") as f:
        f.write(held.getvalue())
    sc.addPyFile(path)  # the driver serves it; workers don't read this path
    _shipped.add(sc.applicationId)


def with_fields(schema: T.StructType, **kinds: str) -> T.StructType:
    """A new schema with more fields; ``StructType.add`` would change the one a DataFrame holds."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in kinds.items())).fields])


def settle(df: DataFrame) -> DataFrame:
    """A frame that several steps read: cut off in the folder that spark.checkpoint.dir names, or kept by the executors (and made again by its lineage where one is lost) if the session names none."""
    sc = df.sparkSession.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return df.checkpoint()


def beside(a: DataFrame, b: DataFrame, keys: dict[str, str], how: str = "inner") -> DataFrame:
    """``a`` with the other columns of ``b``, joined where the ``keys`` (column of a: column of b) are equal, or both NULL."""
    named = b.withColumnsRenamed({k: f"_of_{k}" for k in keys.values()})
    on = [F.expr(x).eqNullSafe(F.col(f"_of_{k}")) for x, k in keys.items()]
    return a.join(named, on, how).drop(*[f"_of_{k}" for k in keys.values()])
