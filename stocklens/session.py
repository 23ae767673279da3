"""Session defaults, reliable checkpoints and work tables."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str = "*", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster passes its own settings to ``spark-submit``."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stocklens")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; one of this machine where local tests set none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can read")
    return (shared or "file://" + tempfile.mkdtemp(prefix="stocklens-")).rstrip("/")


class WorkTables:
    """Tables of one run in the shared folder: written, read back, and removed when no longer needed.

    They cut the lineage as checkpoints do, and outlive lost executors, but old ones go while the run goes on.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def remove(self, name: str) -> None:
        remove_folder(self.spark, f"{self.root}/{name}")


def _folder(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library's own tables."""
    files, folder = _folder(spark, path)
    files.delete(folder, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    files, folder = _folder(spark, path)
    return files.exists(folder)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    files, folder = _folder(spark, path)
    return [entry.getPath().getName() for entry in files.listStatus(folder)] if files.exists(folder) else []
