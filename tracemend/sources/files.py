"""Finding log files, in any file system that Spark reads, and loading compressed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Name endings of log files, in the order in which they are taken.
PATTERNS = [".xes.yaml", ".yaml", ".xes", ".xes.yaml.gz", ".yaml.gz", ".xes.gz"]


def _files(spark: SparkSession, path: str, deep: bool = True) -> list[str]:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    if not fs.exists(at):
        return []
    out, found = [], fs.listFiles(at, deep)
    while found.hasNext():
        out.append(found.next().getPath().toString())
    return sorted(out)


def find_logs(spark: SparkSession, path: str, most: int | None = None) -> list[str]:
    """Log files under a path: by ending as in PATTERNS, sorted within each, none twice; `most` files at most."""
    every = _files(spark, path)
    out = list(dict.fromkeys(f for p in PATTERNS for f in every if f.endswith(p)))
    return out[:most]


def is_yaml(path: str) -> bool:
    return path.removesuffix(".gz").endswith(".yaml")


def resolve(spark: SparkSession, path: str) -> str:
    """The XES file that a path stands for: itself, of a folder the file of its name, else its first .xes or .gz, else the .gz beside it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    if not (fs.exists(at) and fs.getFileStatus(at).isDirectory()):
        return path
    inside = _files(spark, path, deep=False)
    own = [f for f in inside if f.rpartition("/")[2] == at.getName()]
    beside = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.gz")
    other = [f for f in inside if f.endswith((".xes", ".gz"))]
    if own or other:
        return (own or other)[0]
    if fs.exists(beside):
        return beside.toString()
    raise FileNotFoundError(f"no log in or beside {path}")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def load_tables(spark: SparkSession, folder: str, names: list[str], target: str, replace: bool = True) -> dict[str, DataFrame]:
    """Compressed CSV files <name>.csv.gz of a folder as Parquet tables of inferred types below `target`; those that are missing are left out.

    replace: tables that are there are made anew, else they are taken as they are.
    """
    out = {}
    for n in names:
        at = f"{target.rstrip('/')}/{n}"
        if exists(spark, f"{folder.rstrip('/')}/{n}.csv.gz") and (replace or not exists(spark, f"{at}/_SUCCESS")):
            spark.read.option("header", True).option("inferSchema", True).csv(f"{folder.rstrip('/')}/{n}.csv.gz").write.mode("overwrite").parquet(at)
        if exists(spark, f"{at}/_SUCCESS"):
            out[n] = spark.read.parquet(at)
    return out


def write_batches(rows: DataFrame, key: str, size: int, path: str) -> None:
    """rows in parts of `size` consecutive numbers of `key`; parts that are there from an earlier run stay as they are.

    A part is one file of one task, which moves it in place when it is done: the driver would move the files of all tasks one
    by one. So a part is there whole or not at all, also after a run that failed.
    """
    from pyspark.sql import functions as F

    part = F.floor(F.col(key) / size)
    todo = rows.withColumn("part", part)
    if exists(rows.sparkSession, path):
        done = rows.sparkSession.read.parquet(path).select("part").distinct()
        todo = todo.join(F.broadcast(done), "part", "left_anti")  # a row for each part
    todo.repartition("part").write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("part").parquet(path)


def rename_parts(spark: SparkSession, path: str, ending: str) -> None:
    """Give the part files of a folder that Spark wrote another ending, so that they are found as logs."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for f in _files(spark, path, deep=False):
        name = f.rpartition("/")[2]
        if name.startswith("part-"):
            at = jvm.org.apache.hadoop.fs.Path(f)
            at.getFileSystem(conf).rename(at, jvm.org.apache.hadoop.fs.Path(at.getParent(), name.partition(".")[0] + ending))
