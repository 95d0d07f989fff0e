"""Exact duplicates by a 128-bit content hash, confirmed byte by byte.

Plan, for texts of any number of copies:

1. every text is normalised (runs of ASCII white space become one space) and
   hashed with MD5 (128 bits);
2. ``groupBy(hash, bytes)`` finds the smallest id and the size of each set of
   equal texts.  Because the bytes are part of the key, two texts that merely
   collide in the hash stay apart.  The aggregate combines on the map side, so
   a group that holds a third of all rows costs one row per map task;
3. a second, narrow aggregate sees which hashes hold more than one text;
4. every row meets its group again by hash alone (16 bytes, no text).  Only the
   hashes with several texts, if there are any, are joined on their bytes.

Step 4 is a sort-merge join of two freshly shuffled sides, so AQE may split the
hash that holds a hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ASCII_SPACE, free_name, need, save, without


def normalise(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), ASCII_SPACE, " ")


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_fn=content_hash) -> DataFrame:
    """Adds ``keep_id, group_size, kept, norm_text`` to every row of ``docs``.

    Null text counts as empty.  Of equal texts the smallest id stays; repeated
    rows with that same id are all kept rows of it.  A null id sorts last, so it
    stays only if its group has no other id (``keep_id`` is then null and
    ``kept`` true).  An empty table gives an empty result.  Other columns pass
    through; a column of ``docs`` named like an added one is replaced.
    """
    need(docs, id_col, text_col)
    docs = without(docs, "keep_id", "group_size", "kept", "norm_text")
    h, norm = free_name(docs, "content_hash"), "norm_text"
    keyed = docs.withColumn(norm, normalise(F.col(text_col))).withColumn(h, hash_fn(F.col(norm)))
    texts = keyed.groupBy(h, norm).agg(F.min(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # values are those of the only text where there is one; the others are joined below
    hashes = save(
        texts.groupBy(h).agg(F.count(F.lit(1)).alias("variants"), F.min("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")),
        "hashes",
    )
    out = keyed.join(hashes.where("variants = 1").drop("variants"), h)
    collided = hashes.where("variants > 1").select(h)
    if not collided.isEmpty():
        apart = keyed.join(collided, h, "left_semi")
        sized = apart.groupBy(h, norm).agg(F.min(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        out = out.unionByName(apart.join(sized, [h, norm]).select(*out.columns))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id"))).select(*docs.columns, "keep_id", "group_size", "kept", norm)
