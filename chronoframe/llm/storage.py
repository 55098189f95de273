"""Tables written to the folder that the cluster shares, and small helpers on sessions and columns.

The folder is the session's ``spark.checkpoint.dir``.  Where that is unset, a local session gets a temporary
folder of its own, and a cluster an error, as its executors share no local folder.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, without a slash at the end."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir isn't set; it must be a folder that the whole cluster shares")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="chronoframe-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/chronoframe/{name}-{uuid.uuid4().hex}"


#: For rows of large values that are compressed already: no codec, whose buffers are as large as a page, and a row in a page.
LARGE_VALUES = {"compression": "none", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def written(df: DataFrame, name: str, path: str | None = None, **options: str) -> DataFrame:
    """The table, written as Parquet to the shared folder and read from it: its lineage is cut, and a lost executor loses nothing of it."""
    path = path or new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    for made in _scratch[-1:]:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_scratch: list[list[str]] = []


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` gives, written; what ``written`` wrote on the way there is removed."""
    made: list[str] = []
    _scratch.append(made)
    try:
        df = make()
        path = new_path(spark, name)
        df.write.parquet(path)
    finally:
        _scratch.remove(made)
        for x in made:
            delete(spark, x)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, columns: list[str]) -> str:
    """The name, or one made of it, that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared store."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Removes the files of a table that ``written`` made."""
    for path in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        delete(spark, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id, k: int):
    """crc32 of the id as text, modulo k."""
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the rows of text that a Python worker is sent at a time, as texts can be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
