"""Tables in the folder that all executors share: written once, read by later queries of the application."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_made: dict[tuple, str] = {}
_local: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset on one machine, as in tests, a folder of this process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "at" not in _local:
        _local["at"] = tempfile.mkdtemp(prefix="tabulon-shared-")
        atexit.register(shutil.rmtree, _local["at"], ignore_errors=True)
    return f"file://{_local['at']}"


def written(df: DataFrame) -> DataFrame:
    """The rows, from files in the shared folder: what a later step reads several times is made once, and its plan starts anew. The
    files go when the process ends."""
    spark = df.sparkSession
    at = f"{folder(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(at)

    def drop() -> None:
        try:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session has ended; the folder's owner cleans it
            return

    atexit.register(drop)
    return spark.read.schema(df.schema).parquet(at)


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt by a key over as many tasks as a shuffle has: files of short rows are read by few tasks, too few for what is made
    of each row. The number is given, or small rows would be dealt to one task again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _files(spark: SparkSession, key: tuple) -> tuple:
    """Names, lengths and times of all files below the folders that a key names: what was made of other files is another table."""
    jvm, out = spark.sparkContext._jvm, []
    for at in sorted({k for k in key if isinstance(k, str) and "/" in k}):
        path = jvm.org.apache.hadoop.fs.Path(at)
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)  # an error where it can't be listed
        while found.hasNext():
            f = found.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def stored(spark: SparkSession, key: tuple, make: Callable[[], dict[str, tuple[DataFrame, list[str]]]]) -> dict[str, DataFrame]:
    """The tables that make() gives, by name with the columns they are partitioned by, from files. They are written the first time
    that an application asks for the key, and again once a file below a folder in the key has changed; the key must name the inputs' folder."""
    key = (spark.sparkContext.applicationId, *key, _files(spark, key))
    if key not in _made:
        at = f"{folder(spark)}/stored-{uuid.uuid4().hex}"
        for name, (df, by) in make().items():
            (df.repartition(*by) if by else df).write.partitionBy(*by).parquet(f"{at}/{name}")
        _made[key] = at
    at = _made[key]
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    names = [s.getPath().getName() for s in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)]
    return {n: spark.read.parquet(f"{at}/{n}") for n in names}
