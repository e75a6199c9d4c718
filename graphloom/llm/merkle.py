"""Document fingerprints: a Merkle tree over paragraphs and sections.

Sections are split at blank lines, paragraphs at line ends. A paragraph's leaves
are runs of words with the white space around them, so the leaves of a text
joined are the text. Where a leaf ends is decided by content: after a word whose
last character has a code point divisible by twelve (below U+0100), or after
``LEAF_WORDS`` words; so an insertion changes the leaf it is in and the next at
most, not all that follow. A node's hash covers its level and its children's
hashes; the root tests equality. Where two trees differ, only branches under
differing nodes are looked into: ``differing`` locates the paragraphs that were
edited, ``likeness`` counts what the trees share, wherever it stands.

Only DataFrame operations, row-wise. Null texts are empty; an empty text is one
empty section with one empty paragraph and is unlike any other. Very long texts
only have more leaves. Repeated rows have equal trees; in ``with_next`` rows of
one id follow each other in the order of ``tie_col``, null ids come last, and an
empty table stays empty. Its columns may have any name; ``next_<column>`` wins
over others of that name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import quoted

LEAF_WORDS = 32
_SPACE = r"\x20\x09-\x0D"
_ENDS = "".join(re.escape(chr(c)) for c in range(0x24, 0x100, 12) if not 0x7F <= c < 0xA1)
LEAF = rf"[{_SPACE}]*(?:[^{_SPACE}]*[^{_SPACE}{_ENDS}][{_SPACE}]+){{0,{LEAF_WORDS - 1}}}[^{_SPACE}]+[{_SPACE}]*|[{_SPACE}]+"


def _node(level: str, children: Column) -> Column:
    return F.sha2(F.concat(F.lit(level), F.array_join(children, "")), 256)


def tree(text: Column) -> Column:
    """``struct<root, sections: array<struct<hash, paragraphs: array<struct<hash, leaves: array<string>>>>>>``."""

    def paragraph(p: Column) -> Column:
        # A leaf keeps half of its digest's bits, plenty to tell leaves apart and half the memory.
        return F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.substring(F.sha2(x, 256), 1, 32))

    def hashed_paragraph(leaves: Column) -> Column:
        return F.struct(_node("p", leaves).alias("hash"), leaves.alias("leaves"))

    def section(s: Column) -> Column:
        leaves = F.transform(F.split(s, "\n", -1), paragraph)
        return F.transform(leaves, hashed_paragraph)

    def hashed_section(paragraphs: Column) -> Column:
        return F.struct(_node("s", F.transform(paragraphs, lambda p: p["hash"])).alias("hash"), paragraphs.alias("paragraphs"))

    sections = F.transform(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n", -1), section), hashed_section)
    return F.transform(F.array(sections), lambda s: F.struct(_node("r", F.transform(s, lambda x: x["hash"])).alias("root"), s.alias("sections")))[0]


def branches(node: Column) -> Column:
    """A tree in 64 bits a node, ``array<struct<h, n, paragraphs: array<struct<h, n, leaves: array<long>>>>>`` with leaf counts: what a shuffle has to carry to compare it."""

    def paragraph(p: Column) -> Column:
        return F.struct(F.xxhash64(p["hash"]).alias("h"), F.size(p["leaves"]).alias("n"), F.transform(p["leaves"], lambda x: F.xxhash64(x)).alias("leaves"))

    def section(s: Column) -> Column:
        n = F.aggregate(s["paragraphs"], F.lit(0), lambda a, p: a + F.size(p["leaves"]))
        return F.struct(F.xxhash64(s["hash"]).alias("h"), n.alias("n"), F.transform(s["paragraphs"], paragraph).alias("paragraphs"))

    return F.transform(node["sections"], section)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: twice the leaves that two trees (as ``branches``) share, over those of both; nodes and leaves count once.

    Sections that both have are shared as a whole, then, in the others,
    paragraphs, and in the rest of those, leaves.
    """
    hashes = lambda nodes: F.transform(nodes, lambda x: x["h"])

    def level(x: Column, y: Column) -> tuple[Column, Column, Column]:
        """Leaves under the nodes in common, and the other nodes of both."""
        both = F.array_intersect(hashes(x), hashes(y))
        known = F.filter(F.array_distinct(F.transform(x, lambda n: F.struct(n["h"].alias("h"), n["n"].alias("n")))), lambda n: F.array_contains(both, n["h"]))
        rest = lambda nodes: F.filter(nodes, lambda n: ~F.array_contains(both, n["h"]))
        return F.aggregate(known, F.lit(0), lambda s, n: s + n["n"]), rest(x), rest(y)

    def named(*values: Column):
        """Each value once, under a name that later steps use."""
        return F.array(F.struct(*[v.alias(f"c{i}") for i, v in enumerate(values)]))

    below = lambda nodes, child: F.flatten(F.transform(nodes, lambda n: n[child]))

    def from_sections(s: Column) -> Column:
        return F.transform(named(s["c0"], *level(below(s["c1"], "paragraphs"), below(s["c2"], "paragraphs"))), from_paragraphs)[0]

    def from_paragraphs(p: Column) -> Column:
        x, y = (F.array_distinct(below(p[c], "leaves")) for c in ("c2", "c3"))
        return F.transform(F.array(F.struct((p["c0"] + p["c1"]).alias("shared"), x.alias("x"), y.alias("y"))), share)[0]

    def share(v: Column) -> Column:
        both = (v["shared"] + F.size(F.array_intersect(v["x"], v["y"]))) * 2.0
        total = v["shared"] * 2 + F.size(v["x"]) + F.size(v["y"])
        return F.coalesce(both / F.when(total > 0, total), F.lit(0.0))

    return F.transform(named(*level(a, b)), from_sections)[0]


def differing(a: Column, b: Column) -> Column:
    """``array<struct<section, paragraph>>``, from 0: the paragraphs of ``a`` that are not at the same place in ``b``, both as ``branches``.

    Sections whose hashes agree are not looked into.
    """

    def inside(s: Column, i: Column) -> Column:
        other = F.try_element_at(b, i + 1)
        differs = F.transform(s["paragraphs"], lambda p, j: F.struct(i.alias("section"), j.alias("paragraph"), (~p["h"].eqNullSafe(F.try_element_at(other["paragraphs"], j + 1)["h"])).alias("differs")))
        return F.when(s["h"].eqNullSafe(other["h"]), F.slice(differs, 1, 0)).otherwise(F.filter(differs, lambda x: x["differs"]))

    return F.transform(F.flatten(F.transform(a, inside)), lambda x: F.struct(x["section"].alias("section"), x["paragraph"].alias("paragraph")))


def with_next(docs: DataFrame, columns: list[str], id_col: str = "doc_id", tie_col: str | None = None, bucket_rows: int = 2000, max_buckets: int = 20_000) -> DataFrame:
    """``docs`` with ``next_<column>`` of the following row, descending ``id_col``; the last row is followed by the first.

    Ids are cut into at most ``max_buckets`` equal ranges between their 0.1 %
    and 99.9 % quantiles, so that a few far ones don't matter; each range gets a
    copy of the first row of the next one that has any, so the order needs no
    task that sees more than a range, and each text is shuffled once.
    """
    own = F.col(quoted(id_col))
    ids = docs.select(own.cast("long").alias("id"))
    lo, hi = (int(x) for x in (ids.approxQuantile("id", [0.001, 0.999], 0.0005) or [0, 0]))
    n = max(1, min(max_buckets, ids.count() // bucket_rows, hi - lo + 1))
    width = -(-(hi - lo + 1) // n)

    def bucket(c: Column) -> Column:
        return F.when(c.isNull(), -1).otherwise(F.floor((F.greatest(F.least(c, F.lit(hi)), F.lit(lo)) - lo) / width)).cast("long")

    # The row that starts each bucket goes to the bucket before it, in descending order, as well.
    heads = ids.groupBy(bucket(F.col("id")).alias("bucket")).agg(F.max("id").alias("head"))
    down = Window.orderBy(F.col("bucket").desc())
    ghosts = heads.select("head", F.coalesce(F.lag("bucket").over(down), F.min("bucket").over(Window.partitionBy())).alias("to"))  # max_buckets + 1 rows at most
    row = F.struct(*[F.col(quoted(c)) for c in docs.columns])
    rows = docs.select(row.alias("row"), own.cast("long").alias("id")).withColumn("at", bucket(F.col("id"))).join(F.broadcast(ghosts), F.col("id").eqNullSafe(F.col("head")), "left")
    here = F.struct(F.col("at").alias("b"), F.lit(0).alias("ghost"))
    there = F.when(F.col("to").isNotNull(), F.array(here, F.struct(F.col("to").alias("b"), F.lit(1).alias("ghost"))))
    rows = rows.select("row", "id", F.explode(F.coalesce(there, F.array(here))).alias("place"))
    ties = [F.col("row")[tie_col]] if tie_col else []
    order = Window.partitionBy(F.col("place.b")).orderBy(F.col("place.ghost"), F.col("id").desc_nulls_last(), *ties)
    following = F.struct(*[F.col("row")[c].alias(c) for c in columns])
    rows = rows.select("row", "place", F.lead(following).over(order).alias("next")).where(F.col("place.ghost") == 0)
    made = [f"next_{c}" for c in columns]
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in made], *[F.col("next")[c].alias(f"next_{c}") for c in columns])
