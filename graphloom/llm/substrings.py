"""Substring dedup over a log-structured fingerprint index.

Each batch of documents becomes sorted immutable runs of window fingerprints
(one for each anchor of ``windows``: every window of 13 words holds one, at a
place its words alone decide). A batch's runs are merge-joined, range by range,
with the runs of earlier batches, of which only the ranges that the batch has
are read; what agrees in its fingerprint is verified window by window; then the
runs are kept, and compacted once there are many. A word goes if a window that
covers it also starts in a document with a smaller doc_id, in this batch or an
earlier one. So batches come in ascending order of doc_id.

``FingerprintIndex`` keeps its runs in a folder that all executors share, and a
new object on that folder goes on where the last one was;
``remove_repeats`` puts a table through an index of its own, in ``batches``.

Two windows are equal if two 64-bit hashes over 64-bit hashes of their words
agree. Null texts have no words; a null doc_id counts as larger than any; rows
of one doc_id are one document and don't remove each other's words. A text of
any length is held by one task at a time. An empty table gives an empty one.
Columns made here win over others of the same name. Nothing is capped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import repeats
from graphloom.llm.common import map_arrow, quoted, schema_of
from graphloom.session import delete_path, folders, shared_dir

WIDTH = 13
GRAM = 6
BATCHES = 2
_OUT = {"n_words": "long", "n_removed": "long", "kept": "string"}


def word_tokens(data: bytes) -> np.ndarray:
    words = data.split()  # at ASCII white space
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), dtype=np.uint64, count=len(words))


def rule(width: int = WIDTH, gram: int | None = None) -> repeats.Rule:
    return repeats.Rule(word_tokens, width, gram or max(1, min(GRAM, width // 2)))


def _keyed(docs: DataFrame, id_col: str, text_col: str, kept_cols: list[str]) -> DataFrame:
    """``(doc, body, text, row)``: doc is never null, row holds the columns that pass through."""
    text = F.col(quoted(text_col))
    row = F.struct(F.lit(0).alias("0"), *[F.col(quoted(c)) for c in kept_cols])
    return docs.select(F.coalesce(F.col(quoted(id_col)).cast("long"), F.lit(repeats.NO_ID)).alias("doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("body"), text.alias("text"), row.alias("row"))


def _apply(keyed: DataFrame, verdicts: DataFrame, stretches: DataFrame, r: repeats.Rule, kept_cols: list[str]) -> DataFrame:
    rows = keyed.withColumn("text", F.encode(F.coalesce("text", F.lit("")), "UTF-8")).join(verdicts, ["doc", "body"], "left").join(stretches, ["doc", "body"], "left").select("row", "text", "verdicts", "stretches")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, gone, kept = [], [], []
            for text, v, s in zip(b.column(1), b.column(2), b.column(3), strict=True):
                data = text.as_buffer().to_pybytes()
                words = data.split()
                v, at, n = repeats.lists_of(v, s)
                size.append(len(words))
                if len(v) or len(at):
                    mark = repeats.marked_tokens(r, data, len(words), v, at, n)
                    words = [w for w, m in zip(words, mark.tolist(), strict=True) if not m]
                gone.append(size[-1] - len(words))
                kept.append(b" ".join(words))
            cols = [pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(b.column(0).flatten()[1:] + cols, names=[*kept_cols, *_OUT])

    return map_arrow(rows, run, schema_of(keyed.select("row.*").drop("0"), kept_cols, _OUT))


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, **tuning) -> DataFrame:
    """``docs`` without its text, with ``n_words, n_removed`` and the ``kept`` words joined by one space.

    The table goes through a new index in ``batches`` ranges of its ids, cut at
    their quantiles; the last one has the rows without an id.
    """
    spark, key = docs.sparkSession, F.col(quoted(id_col)).cast("long")
    cuts = docs.select(key.alias("id")).approxQuantile("id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    cuts = sorted({int(c) for c in cuts or []})
    index = FingerprintIndex(spark, f"{shared_dir(spark)}/graphloom/index-{uuid.uuid4().hex}", width, **tuning)
    lows, highs = [None, *cuts], [*cuts, None]
    out = None
    for low, high in zip(lows, highs, strict=True):
        after = key > F.lit(low) if low is not None else F.lit(True)
        mine = docs.where(after & (key <= F.lit(high)) if high is not None else after | key.isNull())
        earlier = docs.where(key <= F.lit(low)) if low is not None else None
        part = index.add(mine, earlier, id_col, text_col)
        out = part if out is None else out.unionByName(part)
    delete_path(spark, index.path)
    return out


class FingerprintIndex:
    """Runs of earlier batches in a folder that all executors share.

    A run is a Parquet table of packed entries by range of fingerprints, written
    once; it counts from when its writer has committed it. The texts of earlier
    batches, ``history``, are needed to verify; of them only those are read
    beyond their key that share a gram with a doubtful row of the batch.
    """

    def __init__(self, spark: SparkSession, path: str, width: int = WIDTH, buckets: int | None = None, max_runs: int = 8, hot: int = repeats.HOT, run_anchors: int = repeats.RUN_ANCHORS):
        self.spark, self.path, self.rule, self.max_runs, self.hot, self.run_anchors = spark, path.rstrip("/"), rule(width), max_runs, hot, run_anchors
        # How the runs are cut is part of their names, so that an index can be opened anew.
        old = [int(n.split("-")[1]) for n in self.names]
        self.buckets = old[0] if old else buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    @property
    def names(self) -> list[str]:
        """Committed runs; those that a compaction replaced are gone or about to be deleted."""
        return [n for n in folders(self.spark, self.path) if n.startswith("run-")]

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema("bucket int, payload binary").parquet(*[f"{self.path}/{n}" for n in names])

    def _name(self) -> str:
        return f"run-{self.buckets}-{uuid.uuid4().hex}"

    def add(self, batch: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``batch`` deduplicated against itself and all earlier batches, then kept as a run."""
        kept_cols = [c for c in batch.columns if c != text_col and c not in _OUT]
        keyed = _keyed(batch, id_col, text_col, kept_cols)
        earlier, name = self.names, self._name()
        repeats.runs(keyed, self.rule, self.buckets, self.hot, self.run_anchors).write.option("compression", "none").parquet(f"{self.path}/{name}")
        fresh = self._read([name])
        payloads = fresh.withColumn("fresh", F.lit(True))
        if earlier:
            # Ranges that the batch has, at most ``buckets`` numbers, and entries of hot grams.
            touched = [r.bucket for r in fresh.select("bucket").where(F.col("bucket") < self.buckets).distinct().collect()]
            wanted = F.col("bucket").isin(touched) | F.col("bucket").between(self.buckets, 2 * self.buckets - 1)
            payloads = payloads.unionByName(self._read(earlier).where(wanted).withColumn("fresh", F.lit(False)))
        old = _keyed(history, id_col, text_col, []).select("doc", "body", "text") if history is not None else None
        verdicts, stretches = repeats.resolve(keyed.select("doc", "body", "text"), self.rule, payloads, old)
        if len(earlier) >= self.max_runs:
            self.compact()
        return _apply(keyed, verdicts, stretches, self.rule, kept_cols)

    def compact(self) -> None:
        """All runs become one; no entry is lost that a later batch may ask for."""
        told = 2 * self.buckets

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, []

            def close() -> pa.RecordBatch:
                e = np.concatenate([repeats._unpack(p) for p in held])
                e = e[np.lexsort((e["ord"], e["body"], e["doc"], e["c"], e["g"]))]
                return repeats._payloads([at], [e])

            for b in batches:
                for bucket, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if bucket != at and held:
                        yield close()
                        held = []
                    at = bucket
                    held.append(payload)
            if held:
                yield close()

        old = self.names
        merged = self._read(old).where(F.col("bucket") < told).repartition("bucket").sortWithinPartitions("bucket")
        map_arrow(merged, run, "bucket int, payload binary").write.option("compression", "none").parquet(f"{self.path}/{self._name()}")
        # Entries that are there twice, should this stop here, change nothing: a row doesn't repeat itself.
        for n in old:
            delete_path(self.spark, f"{self.path}/{n}")
