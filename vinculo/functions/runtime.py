"""Job helpers: lineage cuts in the cluster's shared folder, row identity, broadcasts of counted size."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of the tables that ``materialize`` has written and that are still read.
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that setting is absent a folder under the temp dir serves a ``local`` master (tests); on
    a cluster, where every machine has its own temp dir, it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", "")
    if found:
        return found
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/vinculo-shared"


def materialize(df: DataFrame, *done: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; then ``forget`` the tables ``done``.

    This cuts the lineage, and unlike blocks on an executor's disk the files outlive a lost
    executor. Files that no later step forgets stay until the folder is cleared, as jobs of the
    caller still read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vinculo-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    forget(*done)
    return out


def forget(*done: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` returned and that nothing reads any more."""
    for df in done:
        path = _folders.pop(df, None)
        if path:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Rows of ids up to which ``small`` lets every executor hold them: 8 MB of long values.
SMALL_ROWS = 1_000_000


def small(ids: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Hint a broadcast of ``ids`` (few narrow columns) if its counted rows are within ``limit``.

    Beyond the limit the join stays a shuffle join.
    """
    return F.broadcast(ids) if ids.limit(limit + 1).count() <= limit else ids


#: Name of the column that tells rows apart.
ROW = "__vinculo_row"


def with_rows(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """``df`` with the column ``ROW``, a number of each row in the order of the ids, and whether the ids serve as such.

    Ids without nulls and repeats are the numbers themselves, at the cost of one aggregation of the
    ids. Otherwise the rows are sorted by id (nulls last) and text, numbered and written once.
    """
    unclear = df.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n")).where("id IS NULL OR n > 1")
    if unclear.isEmpty():
        return df.withColumn(ROW, F.col(id_col).cast("bigint")), True
    return materialize(df.orderBy(F.col(id_col).asc_nulls_last(), text_col).withColumn(ROW, F.monotonically_increasing_id())), False
