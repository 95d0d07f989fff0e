"""Boilerplate lines, found by the number of distinct sites that carry them.

1. Lines are trimmed and hashed (128 bits, as are documents); lines under
   ``min_chars`` characters are never boilerplate.  Hashes and places are written
   down once.  A first aggregate counts each hash's occurrences; a line with
   fewer than ``min_sites`` of them cannot be on ``min_sites`` sites.
2. For the others a HyperLogLog sketch of the sites is built per hash; sketches
   merge, so the aggregate combines on the map side however often a line occurs.
3. Where the estimate is near the threshold (within ``margin`` standard errors),
   the distinct sites are counted exactly.
4. A line on at least ``min_sites`` sites is removed from every document but the
   one with the smallest id, which keeps it.  The positions of the lines to
   remove come back to their document by a join; no line's occurrences are ever
   gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import need, save, without

MIN_SITES, MIN_CHARS, LG_K, MARGIN = 5, 20, 12, 5.0


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")


def site_counts(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, margin: float = MARGIN) -> DataFrame:
    """``hash, first_id, sites, exact`` of the lines on at least ``min_sites`` sites.

    ``lines`` holds ``hash, id, site``.  ``sites`` is the exact number where
    ``exact`` holds, else an estimate that is far above the threshold.
    """
    often = lines.groupBy("hash").agg(F.count(F.lit(1)).alias("uses"), F.min("id").alias("first_id")).where(F.col("uses") >= min_sites)
    often = save(often.select("hash", "first_id"), "frequent")
    uses = lines.join(often, "hash").select("hash", "site")
    sketch = uses.groupBy("hash").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
    guess = save(sketch.select("hash", F.hll_sketch_estimate("sketch").alias("guess")), "sketches")
    error = margin * 1.04 / 2 ** (lg_k / 2)
    low, high = min_sites * (1 - error) - 1, min_sites * (1 + error) + 1
    near = guess.where((F.col("guess") >= low) & (F.col("guess") <= high)).select("hash")
    exact = uses.join(near, "hash").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites)
    sure = guess.where(F.col("guess") > high).select("hash", F.col("guess").alias("sites"), F.lit(False).alias("exact"))
    return often.join(exact.select("hash", "sites", F.lit(True).alias("exact")).unionByName(sure), "hash")


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", lg_k: int = LG_K, margin: float = MARGIN) -> DataFrame:
    """``docs`` with ``text_col`` cleaned, and ``n_lines, n_removed`` added.

    Lines end at line feeds.  A line is on a site if a document of it holds the
    line; a null site counts as one site named by the empty text.  Null and
    empty texts stay as they are (0 lines).  The document with the smallest id
    keeps the line, all its occurrences included; repeated rows of that id keep
    it too.  With a null id a document never keeps a line that has other ids,
    and if all ids are null the line stays everywhere.  Other columns pass
    through; columns named ``n_lines`` or ``n_removed`` are replaced.
    """
    need(docs, id_col, text_col, site_col)
    docs = without(docs, "n_lines", "n_removed", "__doc", "__gone")
    text = F.col(text_col)
    digest = lambda c: F.unhex(F.md5(c.cast("binary")))
    key = digest(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\0"), text))
    parts = F.split(text, "\n", -1)
    lines = docs.where(text.isNotNull() & (F.length(text) >= min_chars)).select(
        key.alias("doc"), F.col(id_col).alias("id"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.posexplode(F.transform(parts, trimmed)).alias("pos", "line")
    )
    lines = save(lines.where(F.length("line") >= min_chars).select("doc", "id", "site", "pos", digest(F.col("line")).alias("hash")), "lines")
    wide = site_counts(lines.select("hash", "id", "site"), min_sites, lg_k, margin)
    wide = save(wide.where("first_id is not null").select("hash", "first_id"), "boilerplate")
    hits = lines.join(wide, "hash").where(~F.col("id").eqNullSafe(F.col("first_id"))).groupBy("doc").agg(F.collect_set("pos").alias("__gone"))
    out = docs.withColumn("__doc", key).join(hits.withColumnRenamed("doc", "__doc"), "__doc", "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__gone"))
    # the lines are split once and looked up by place, so a long document costs no more than its lines
    looked_up = F.transform(F.array(F.struct(parts.alias("p"), kept.alias("k"))), lambda s: F.array_join(F.transform(s["k"], lambda i: F.get(s["p"], i)), "\n"))
    clean = F.when(F.col("__gone").isNull(), text).otherwise(F.get(looked_up, F.lit(0)))
    n_lines = F.when(text.isNull() | (text == ""), 0).otherwise(F.size(parts))
    return out.select(
        *[clean.alias(c) if c == text_col else F.col(c) for c in docs.columns],
        n_lines.cast("int").alias("n_lines"), F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("int").alias("n_removed"),
    )
