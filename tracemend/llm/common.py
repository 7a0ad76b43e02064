"""What the training-data operators share: table access, scratch tables in the shared folder, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import ClassVar

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; in local mode, as in tests, a temporary one is set where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='tracemend-')}"
        spark.sparkContext.setCheckpointDir(path)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """Intermediate tables as Parquet in the shared folder; they cut lineage and survive lost executors."""

    roots: ClassVar[list[str]] = []  #: folders of this session, in order

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        self.roots.append(self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/t{self.n}"
        df.write.option("compression", "snappy").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(conf).delete(path, True)


def forget_since(spark: SparkSession, mark: int) -> None:
    """Delete the folders opened since there were `mark` of them, once what was made from them is stored elsewhere."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while len(Scratch.roots) > mark:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(Scratch.roots.pop())
        path.getFileSystem(conf).delete(path, True)


def fresh(taken: list[str], name: str) -> str:
    """A column name that is not taken; names are compared as Spark does, without case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fields_of(df: DataFrame, *without: str) -> str:
    """The columns of df as a schema string, whatever their names."""
    return ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in without)


def row_keys(scratch: Scratch, rows: DataFrame) -> DataFrame | None:
    """(doc_id, digest, key) where some doc_id has several digests, else None: then doc_id itself is a key of its text.

    Keys are dense numbers in order of doc_id and digest, from a range partition and the sizes of its partitions.
    """
    ranges = rows.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"))
    if not ranges.where("lo <> hi").limit(1).count():
        return None
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = rows.select("doc_id", "digest").distinct().repartitionByRange(n, "doc_id", "digest").sortWithinPartitions("doc_id", "digest")
    t = scratch.keep(t.withColumn("key", F.monotonically_increasing_id()).withColumn("part", F.shiftright("key", 33)))
    sizes = t.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each partition
    return scratch.keep(t.join(F.broadcast(before), "part").select("doc_id", "digest", (F.col("key").bitwiseAND((1 << 33) - 1) + F.col("before")).alias("key")))


def map_arrow(df: DataFrame, schema: str, each: Callable[[Iterator[dict]], Iterator[dict]], out: pa.Schema | None = None) -> DataFrame:
    """mapInArrow over column lists: `each` gets and yields dicts of lists or arrays, one for each batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = out or to_arrow_schema(_parse_datatype_string(schema))
    conf = df.sparkSession.conf
    if conf.get(BATCH) == "67108864b":  # the default; a batch of long texts stays small in the JVM and the worker
        conf.set(BATCH, f"{BATCH_BYTES}b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns() -> Iterator[dict]:
            for b in batches:
                if b.num_rows:
                    yield dict(zip(b.schema.names, b.columns, strict=True))

        for got in each(columns()):
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) if not isinstance(got[f.name], pa.Array) else got[f.name].cast(f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def text_slices(ids: pa.Array, texts: pa.Array, most_bytes: int = 8 << 20) -> Iterator[tuple[list, list]]:
    """Rows of a batch as lists of ids and texts (null: empty), a few MB at a time, so that long texts don't pile up."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
    begin = total = 0
    for i, size in enumerate(sizes):
        total += size
        if total >= most_bytes or i + 1 == len(sizes):
            n = i + 1 - begin
            yield ids.slice(begin, n).to_pylist(), [t or "" for t in texts.slice(begin, n).to_pylist()]
            begin, total = i + 1, 0


def components(scratch: Scratch, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (id, component), component the smallest id reachable.

    Alternating large-star and small-star steps; each round is written to the shared folder. Only ids with an edge to
    another id get rows; edges with a null end, loops and repeated edges change nothing, and no edges give no rows. A node's
    neighbours are never collected: each step is an aggregation and an equi-join.
    """
    cur = scratch.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(rounds):
        # large star: every larger neighbour of a node points at the smallest id next to that node
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours point at the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = scratch.keep(small)
        mark = new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()  # edges are distinct
        scratch.drop(cur)
        cur = new
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component"))
