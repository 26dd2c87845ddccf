"""Session helpers shared by the operators: partition counts and durable intermediates."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions the session is sized for; blocks and shards follow it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> None:
    """Make sure that the context has a checkpoint folder."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs a shared folder in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))


def settled(df: DataFrame) -> DataFrame:
    """Cut the lineage with an eager checkpoint in the shared folder.

    The files are written once, so a lost executor re-reads them and never
    recomputes a differently ordered copy.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Give the workers this package, as a zip that Spark hands out (once per context)."""
    import io
    import os
    import zipfile
    from pathlib import Path

    import tieout

    sc = spark.sparkContext
    if getattr(sc, "_tieout_shipped", False):
        return
    root = Path(tieout.__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), "tieout_package.zip")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, str(Path("tieout") / file.relative_to(root)))
    Path(path).write_bytes(data.getvalue())
    sc.addPyFile(path)
    sc._tieout_shipped = True
