"""What the corpus operators share: the cluster's shared folder, written tables, let-bindings."""
from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Stands for a null id where ids are join keys or are ordered: null sorts before every id.
NULL_ID = -(2**63)
#: Characters that separate words.
BLANKS = r"[\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a local master, as in tests, may do without: a temporary folder is set then.  On a cluster that
    names none this is an error, since executors would each write to a disk of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found if "://" in found or found.startswith("file:") else f"file://{os.path.abspath(found)}"


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/corpus/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Gives the workers this package, wherever the driver imported it from; once per context."""
    context = spark.sparkContext
    if getattr(context, "_tokenloom_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.writestr(os.path.relpath(full, os.path.dirname(top)), open(full).read())
    target = os.path.join(tempfile.mkdtemp(), "tokenloom.zip")
    with open(target, "wb") as f:
        f.write(packed.getvalue())
    context.addPyFile(target)
    context._tokenloom_shipped = True


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def drop_written() -> None:
    """Deletes what materialize() and new_path() have made so far; results that read it must be stored by then."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended; the folder belongs to it
            return


atexit.register(drop_written)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, though a lambda below uses it for each element."""
    return F.transform(F.array(value), body)[0]


def fresh_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for columns beside those of df, whatever they are called (Spark takes no notice of case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def integral(df: DataFrame, id_col: str) -> None:
    """Refuses ids that aren't integers, where an operator orders and joins them as such."""
    kind = df.select(id_col).schema[0].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{id_col} must be an integer, not {kind.simpleString()}")


#: A key with more rows than this is hot; so many hot keys are broadcast at most.
HOT, FEW_HOT = 1000, 200_000


def join_hot(left: DataFrame, right: DataFrame, key: str | list[str], count: str) -> DataFrame:
    """left joined to right, a written table with one row a key and the key's number of rows in left.

    Rows of hot keys meet a broadcast of those (FEW_HOT rows at most) and are moved nowhere; the others meet
    by an exchange, as all do where more keys are hot, which Spark may split by size."""
    hot = right.where(F.col(count) > HOT)
    if not 0 < hot.limit(FEW_HOT + 1).count() <= FEW_HOT:
        return left.join(right, key)
    keys = [key] if isinstance(key, str) else key
    cold = left.join(F.broadcast(hot.select(*keys)), key, "left_anti").join(right.where(F.col(count) <= HOT), key)
    return left.join(F.broadcast(hot), key).unionByName(cold)


def key_of(col: str | Column) -> Column:
    """An id as a join key that is never null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(NULL_ID))


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text, in order."""
    trimmed = F.regexp_replace(text, rf"^{BLANKS}|{BLANKS}$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS))


# Files that executors write and read themselves, whatever the scheme of the shared folder.


def _fs(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), urlparse(path).path
    return fs.FileSystem.from_uri(path)


class FileWriter:
    """A file written under another name until it is closed, so that a task that dies leaves nothing half written."""

    def __init__(self, path: str):
        self.path, self.size = path, 0
        self.system, self.name = _fs(path)
        self.system.create_dir(os.path.dirname(self.name), recursive=True)
        self.part = f"{self.name}.{uuid.uuid4().hex}.part"
        self.out = self.system.open_output_stream(self.part, compression=None)

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.system.move(self.part, self.name)


def write_file(path: str, chunks) -> int:
    out = FileWriter(path)
    for chunk in chunks:
        out.write(chunk)
    out.close()
    return out.size


def read_file(path: str) -> bytes:
    system, name = _fs(path)
    with system.open_input_file(name) as f:
        return f.read()


@contextmanager
def open_ranges(path: str):
    """read(at, size) of a file, for those who need parts of it."""
    system, name = _fs(path)
    with system.open_input_file(name) as f:
        yield lambda at, size: f.read_at(size, at)


def open_input(path: str):
    system, name = _fs(path)
    return system.open_input_stream(name, compression=None)
