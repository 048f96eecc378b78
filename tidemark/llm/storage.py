"""Tables and files in the folder that the driver and all executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``; only where that is unset (tests
in local mode) one is made.  A table written there cuts the lineage: a lost executor costs the tasks
it ran, and no stage before the table runs again.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A reducer's words of 64 bits: 2 MB.
WORDS = 1 << 18
_made: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, as a URI."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _made:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        _made[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _made[app]


#: Rows and bytes of an Arrow batch between the JVM and a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are small however long its texts are; smaller settings stay."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df


#: Tables and folders that this process made in the shared folder and has not released.
_left: dict[str, set[str]] = {}


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _left.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def clear(spark: SparkSession) -> None:
    """Delete all that this application left in the shared folder; for callers that have read their results."""
    release(spark, *_left.pop(spark.sparkContext.applicationId, ()))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once as a table in the shared folder."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tidemark_path = path
    return out


def release(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete tables (or paths) that nothing reads any more."""
    for t in tables:
        path = t if isinstance(t, str) else getattr(t, "tidemark_path", None)
        if path:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
            _left.get(spark.sparkContext.applicationId, set()).discard(path)


def pyarrow_fs(uri: str):
    """(file system, path) of a folder for workers that read and write plain files."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


class Publisher:
    """A file that is written under a name of its own and moved into place when it is closed, so that a repeated or second attempt leaves one whole file."""

    def __init__(self, uri: str):
        self.fs, self.path = pyarrow_fs(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.temporary)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temporary, self.path)


def publish(uri: str, data: bytes) -> None:
    out = Publisher(uri)
    out.write(data)
    out.close()


def fetch(uri: str, start: int = 0, length: int | None = None) -> bytes:
    """Bytes of a file; a negative start counts from its end.  A file that is not there is an error."""
    fs, path = pyarrow_fs(uri)
    with fs.open_input_file(path) as f:
        f.seek(start if start >= 0 else f.size() + start)
        return f.read(length) if length is not None else f.read()


def privately(docs: DataFrame, keep: tuple[str, ...] = ("text",)) -> tuple[DataFrame, list[Column]]:
    """docs with all columns but ``keep`` under private names, and the columns that give its own names back.

    A stage that adds columns works on the first and ends with a select of the second, so no name of the
    input can clash with one of its own.
    """
    names = {c: c if c in keep else f"__own_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), [F.col(n).alias(c) for c, n in names.items()]


#: Rows of a key (an id or two each) that a task takes without a thought.
HOT = 10_000


def hot_join(left: DataFrame, right: DataFrame, key: str, parts: int = 1000) -> DataFrame:
    """Left join of ``right`` (at most one row a key), whose hot keys do not meet in one task.

    At most ``parts`` keys can have more than a ``parts``-th of the rows of left.  What right has for them is that many
    rows or fewer, whatever the size of either table, and is broadcast; all other keys are spread by the exchange.
    Rows of left without a key match nothing and stay where they are too.  left is read twice and should be a written table.
    """
    count = left.groupBy(key).agg(F.count("*").alias("__n"))
    limit = max(left.count() // parts, HOT)
    found = [r[0] for r in count.filter(F.col(key).isNull() | (F.col("__n") > limit)).select(key).collect()]
    if not found:
        return left.join(right, key, "left")
    hot = [k for k in found if k is not None]
    is_hot = F.col(key).isNull() | F.col(key).isin(hot) if hot else F.col(key).isNull()
    broad = left.filter(is_hot).join(F.broadcast(right.filter(is_hot)), key, "left")
    return broad.unionByName(left.filter(~is_hot).join(right.filter(~is_hot), key, "left"))


def _place(column: str) -> tuple[Column, Column]:
    """Of an id: its word, and its bit in that word."""
    h = f"xxhash64(`{column}`)"
    return F.expr(f"pmod({h}, {WORDS}L)"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({h}, 40) & 63 as int))")


class Reducer:
    """Semi-join reduction before a wide column is shuffled: a one-hash Bloom filter of at most ``WORDS`` rows.

    Rows without a bit have no partner for sure.  The filter's size does not grow with the data, so it can be
    broadcast; when it fills up it lets more rows pass to the exact join that always follows, and never fewer.
    """

    def __init__(self, words: DataFrame):
        self.words = words

    def marked(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """df and a boolean that is false only where the id is surely absent."""
        word, bit = _place(column)
        joined = df.withColumn("__w", word).join(F.broadcast(self.words), "__w", "left")
        return joined.withColumn(name, F.coalesce(F.col("__b").bitwiseAND(bit) != 0, F.lit(False))).drop("__w", "__b")


def reducer(ids: DataFrame, column: str) -> Reducer:
    word, bit = _place(column)
    return Reducer(materialise(ids.select(word.alias("__w"), bit.alias("__b")).groupBy("__w").agg(F.bit_or("__b").alias("__b")), "filter"))
