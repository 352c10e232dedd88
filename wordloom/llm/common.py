"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

WORD = r"[^\x20\x09-\x0D]+"
"""A word: code points other than the six ASCII white-space characters."""


SLICE = 16_000_000
"""Bytes of a batch, about, that Python sees at once."""


MEMORIES: dict[str, dict] = {}
"""What operators remember in a Python worker between tasks, by name."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; a cluster
    session is refused, as its executors would not see each other's files.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wordloom-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, which cuts its lineage.

    The files outlive lost executors.  They stay until the folder is cleared,
    as the returned frame reads them lazily, or until the ``passing`` block ends
    in which they are written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wordloom/{name}-{uuid.uuid4().hex}"
    if _PASSING:
        _PASSING[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_PASSING: list[list[str]] = []
"""For each open ``passing`` block, what was written in it."""


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables stored in the block are deleted at its end; what the given function stores stays, as tables stored outside do."""
    written: list[str] = []
    _PASSING.append(written)

    def lasting(df: DataFrame, name: str) -> DataFrame:
        held = _PASSING.pop()
        try:
            return stored(df, name)
        finally:
            _PASSING.append(held)

    try:
        yield lasting
    finally:
        _PASSING.remove(written)
        for path in written:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def as_list(column: pa.Array) -> list:
    """``column.to_pylist()``, which makes a scalar of each value, by way of NumPy for the kinds that allow it."""
    kind, is_ = column.type, pa.types
    if is_.is_string(kind) or is_.is_large_string(kind) or is_.is_binary(kind) or is_.is_large_binary(kind):
        return column.to_numpy(zero_copy_only=False).tolist()
    if not column.null_count:
        if is_.is_integer(kind) or is_.is_floating(kind) or is_.is_boolean(kind):
            return column.to_numpy(zero_copy_only=False).tolist()
        if is_.is_list(kind) or is_.is_large_list(kind):
            flat, at = as_list(column.flatten()), column.offsets.to_numpy()
            at = (at - at[0]).tolist()
            return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        if is_.is_struct(kind) and kind.num_fields:
            names = [f.name for f in kind]
            return [dict(zip(names, row, strict=True)) for row in zip(*map(as_list, column.flatten()), strict=True)]
    return column.to_pylist()


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict], Iterator[dict]]], schema: str, memory: str = "") -> DataFrame:
    """Apply a Python function to Arrow batches.

    A worker that turns to another operator gives up what it remembered for
    the last one; ``memory`` names what this one goes on with.

    ``make`` runs once per task and returns a function from a dict of column
    lists to dicts of column lists (or NumPy arrays); called with None after
    the last batch, it may yield what it has held back.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    parsed = schema if isinstance(schema, StructType) else _parsed(schema)
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, remembered in MEMORIES.items():
            if name != memory:
                remembered.clear()
        step = make()

        def out(columns: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)

        for whole in batches:
            rows = max(1, SLICE * whole.num_rows // max(1, whole.nbytes))
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                for columns in step({n: as_list(c) for n, c in zip(batch.schema.names, batch.columns, strict=True)}):
                    yield out(columns)
        for columns in step(None) or ():
            yield out(columns)
        _give_back()

    return df.mapInArrow(run, parsed)


def _give_back() -> None:
    """Return freed memory to the system, as an idle worker keeps its processes' memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only there with the GNU library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _parsed(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)
