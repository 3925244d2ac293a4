"""Session set-up and the written tables that cut long lineages."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("wordloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which every executor must see.

    Where the setting is missing a temporary folder is made, but only for a local master: a cluster
    without a shared folder would lose the tables with the machine that wrote them.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    made = getattr(spark.sparkContext, "_wordloom_folder", None)
    if made is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        made = spark.sparkContext._wordloom_folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    return made


def scratch(spark: SparkSession) -> str:
    """The name of a new folder below the shared one."""
    return f"{shared_folder(spark)}/wordloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application, wherever they were started."""
    context = spark.sparkContext
    if getattr(context, "_wordloom_shipped", False):
        return
    package = Path(__file__).parent
    folder = shared_folder(spark)
    target = Path(folder.removeprefix("file://") if folder.startswith("file:") else tempfile.mkdtemp(prefix="spark-"))
    target.mkdir(parents=True, exist_ok=True)
    archive = target / f"wordloom-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, f"wordloom/{file.relative_to(package)}")
    context.addPyFile(str(archive))
    context._wordloom_shipped = True


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that nothing before it runs again.

    The files outlive the executors that wrote them; columns and row groups can be skipped on the way back.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows over as many partitions as the session has cores, where a scan of small files gives fewer; else as they are.

    For work that costs far more than moving a row does. A scan of large files has more partitions than that anyway.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.rdd().getNumPartitions() >= cores else df.repartition(cores)


def clean(spark: SparkSession) -> None:
    """Delete all tables that cut() and others wrote for this application; results not yet read from them are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/wordloom/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
