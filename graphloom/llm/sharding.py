"""Sharding by vector bin packing over bytes, tokens and rows.

Groups of equal texts are the items. A group is placed in the shard whose
residual capacity has the highest dot product with the group's demand, among
the shards that still have its bytes, tokens and rows free (tokens and rows
within ``SLACK``); where none has, in the one that it overfills least.

Scale: items above 1/64 of a shard in any dimension number at most
``3 * 64 * shards`` whatever the input, so the driver packs those. All others
are dealt by digest to cells of some ten thousand groups; each cell packs its
own groups against its share of what the driver left free, so no cell needs to
know of another and the sums stay balanced. A group that would fill over half
a shard is split by a hash of row and doc_id, so a text that makes up a third of
all rows is spread over as many shards as its size asks for, whatever its ids.

Nulls: a null text has no bytes and no tokens and is a group of its own; a null
doc_id is an id like any other, and comes first among the slots. Repeated rows
are rows. A text of any length is one item, and a shard that a single text
overfills gets no other as long as another has room. An empty table gives an
empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import n_bytes, n_words
from graphloom.session import materialize

DIMS = ("bytes", "tokens", "rows")
#: Share of a shard by which tokens and rows may be overfilled, so that bytes come out even.
SLACK = 0.04
#: Weights of the dimensions in the dot product: the law is that bytes come out even.
WEIGHT = np.array([6.0, 1.0, 1.0])
ITEM = "digest string, sub int, bytes long, tokens long, rows long"


def pack(demand: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """Shard of each item; ``demand`` is items x dims, ``capacity`` shards x dims, and is used up.

    Both are in the units of ``DIMS``. The largest items go first; ties keep the given order.
    """
    unit = np.maximum(capacity.sum(axis=0), 1e-9)
    want, left = demand / unit, capacity / unit
    slack = SLACK / len(capacity)
    shard = np.empty(len(want), dtype=np.int32)
    for i in np.argsort(-want.max(axis=1), kind="stable"):
        d = want[i]
        rest = left - d
        rest[:, 1:] += slack
        rest = rest.min(axis=1)
        if rest.max() >= 0:
            s = int(np.argmax(np.where(rest >= 0, left @ (d * WEIGHT), -np.inf)))
        else:  # a shard whose bytes are overfilled by more than the slack takes no more
            s = int(np.argmax(np.where(left[:, 0] > -slack, rest, -np.inf)))
        left[s] -= d
        shard[i] = s
    capacity[:] = left * unit
    return shard


def shard_documents(
    docs: DataFrame,
    shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_overhead: int = 16,
    heavy_share: int = 64,
    cell_groups: int = 20_000,
    slot_rows: int = 200_000,
) -> DataFrame:
    """``(doc_id, size, text_crc32, words, digest, shard, slot)``, one row for each input row.

    ``slot`` counts from 0 without gaps in each shard. ``heavy_share`` and
    ``cell_groups`` bound what the driver and one task pack, ``slot_rows`` what
    one numbers; they change balance a little and never drop a row.
    """
    text = F.col(text_col)
    rows = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (n_bytes(text) + row_overhead).alias("size"),
            n_words(text).alias("words"),
            F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.md5(F.encode(text, "UTF-8")), F.lit("null")).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    spark = docs.sparkSession
    sums = [F.sum("size").alias("bytes"), F.sum("words").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    total = rows.agg(*sums).first()
    whole = np.array([total[d] or 0 for d in DIMS], dtype=float)
    slot_buckets = max(8, -(-int(whole[2]) // (slot_rows * shards)))  # of one shard's rows, each numbered by one task
    if not whole[2]:
        return rows.drop("row").select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    per_shard = np.maximum(whole / shards, 1e-9)

    def share(part: float):
        return F.greatest(*[F.col(d) / F.lit(float(part * p)) for d, p in zip(DIMS, per_shard, strict=True)])

    groups = materialize(rows.groupBy("digest").agg(*sums), "shard-groups")
    # At most 2 * 3 * shards groups are over half a shard in some dimension.
    over = groups.where(share(0.5) > 1).select("digest", F.ceil(share(1.0) * heavy_share).cast("int").alias("parts")).toPandas()
    parts = spark.createDataFrame(over, "digest string, parts int")
    keyed = rows.join(F.broadcast(parts), "digest", "left").select(
        *rows.columns, F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", "row"), F.col("parts"))).cast("int").alias("sub"), F.col("parts").isNotNull().alias("cut")
    )
    pieces = keyed.where("cut").groupBy("digest", "sub").agg(*sums)
    items = groups.join(F.broadcast(parts), "digest", "left_anti").select("digest", F.lit(0).alias("sub"), *DIMS)
    big = items.where(share(1 / heavy_share) > 1).unionByName(pieces).toPandas()
    big = big.sort_values(["bytes", "digest", "sub"], ascending=[False, True, True], ignore_index=True)
    capacity = np.tile(whole / shards, (shards, 1))
    big["shard"] = pack(big[list(DIMS)].to_numpy(dtype=float), capacity)
    free = np.where(capacity[:, :1] > 0, np.maximum(capacity, 0), 0)  # a shard whose bytes are used up takes no more
    free = free / np.maximum(free.sum(axis=0), 1e-9)

    light = items.where(share(1 / heavy_share) <= 1)
    cells = max(1, -(-light.count() // cell_groups))

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "digest"], ascending=[False, True], ignore_index=True)
        demand = pdf[list(DIMS)].to_numpy(dtype=float)
        return pdf.assign(shard=pack(demand, free * demand.sum(axis=0)))[["digest", "sub", "shard"]]

    placed = light.withColumn("cell", F.pmod(F.xxhash64("digest"), F.lit(cells)).cast("int")).groupBy("cell").applyInPandas(cell, "digest string, sub int, shard int")
    placed = placed.unionByName(spark.createDataFrame(big[["digest", "sub", "shard"]], "digest string, sub int, shard int"))
    put = materialize(
        keyed.join(placed, ["digest", "sub"]).select(*rows.columns, "shard", F.pmod(F.xxhash64("doc_id", "row"), F.lit(slot_buckets)).cast("int").alias("bucket")),
        "shard-put",
    )
    # One shard is a fixed share of all rows, too many for one task: count in buckets, add up, then number.
    ahead = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = put.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "digest", "row"))
    return put.join(F.broadcast(starts), ["shard", "bucket"]).select(*rows.drop("row").columns, "shard", (F.col("start") + rank - 1).cast("long").alias("slot"))
