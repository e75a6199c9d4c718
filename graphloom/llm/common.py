"""What several of the operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of one Arrow batch sent to Python: bounds a worker's memory where texts are long.
BATCH_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_words(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def n_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


class Recent:
    """A cache of two generations: when the younger is full it becomes the older, whose entries go unless asked for again."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get_all(self, keys: list) -> list:
        out = list(map(self.young.get, keys))
        if self.old and None in out:
            for i, x in enumerate(out):
                if x is None and (x := self.old.get(keys[i])) is not None:
                    out[i] = self.young[keys[i]] = x
        return out

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


_worker: dict[tuple, object] = {}


def worker_state(*key, make: Callable[[], object]):
    """What one Python worker keeps between tasks: the state of one operator; that of another is given back first."""
    if key not in _worker:
        if _worker:
            _worker.clear()
            trim()
        _worker[key] = make()
    return _worker[key]


def trim() -> None:
    """Give memory that Python and Arrow hold without need back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with batches small enough for long texts.

    Columns reach ``f`` by place: their names may hold dots or back-ticks, which ``mapInArrow`` can't look up.
    """
    df = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(f, schema)


def batch(columns: dict[str, tuple]) -> pa.RecordBatch:
    """``{name: (values, arrow type)}`` as a record batch."""
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def quoted(name: str) -> str:
    """A column name, whatever it holds, for ``F.col`` and SQL."""
    return "`" + name.replace("`", "``") + "`"


def schema_of(src: DataFrame, kept: list[str], out: dict[str, str]):
    """Schema of the columns ``kept`` of ``src`` and those of ``{name: type}``."""
    made = StructType([StructField(k, _parse_datatype_string(t)) for k, t in out.items()])
    return StructType([f for f in src.schema.fields[: len(kept)]] + made.fields)
