"""Exact deduplication by deterministic block naming, with DataFrame functions only.

Each text is cut into fixed-size blocks of bytes. Equal blocks get one integer name (their place in the sorted order of
the distinct blocks of a partition), equal pairs of adjacent names get one name of the next level, and so on until one
name is left: documents with the same number of blocks and the same last name are equal, and no others.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copyloom.llm.common import stored

BLOCK = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, everything else as it is; lower() does it alone where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _blocks(data: Column, block: int, seed: int) -> Column:
    """The hash and bytes of each block in turn; one empty block for an empty text."""
    cut = lambda b: F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(b) / block).cast("int") - 1)),
        lambda i: F.substring(b, i * block + 1, F.lit(block)),
    )
    return F.flatten(F.transform(F.array(data), cut))


def _named(keys: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct keys with integer names: sorted within the partition that the keys' hash deals them to."""
    return keys.groupBy(*cols).agg(F.count(F.lit(1)).alias("copies")).sortWithinPartitions(*cols).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, text_sha256, n_blocks, name), one row per row of docs: equal (n_blocks, name) if and only if equal texts."""
    data = F.encode(ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), "UTF-8")
    for seed in count():
        # Blocks meet by their whole bytes; later joins use the 64-bit hash alone once it is shown to be free of collisions.
        cut = docs.select(F.explode(_blocks(data, block, seed)).alias("block")).select(F.xxhash64("block", F.lit(seed)).alias("h"), "block")
        names = stored(_named(cut, ["h", "block"]).select("h", "name"), "names")
        if names.groupBy("h").count().where("count > 1").isEmpty():
            break
    row = docs.select(F.col(id_col).alias("doc_id"), data.alias("data"))
    row = row.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", F.sha2("data", 256).alias("text_sha256"),
        F.transform(_blocks(F.col("data"), block, seed), lambda b: F.xxhash64(b, F.lit(seed))).alias("hs"),
    )
    row = stored(row, "rows")
    cur = row.select("uid", F.posexplode("hs").alias("at", "h")).join(names, "h").select("uid", "at", "name")
    size = row.select("uid", "doc_id", "text_sha256", F.size("hs").alias("n_blocks"))
    most = size.agg(F.max("n_blocks")).first()[0] or 1
    done = cur.join(size.where("n_blocks = 1").select("uid"), "uid", "left_semi").select("uid", "name")
    level = 1
    if most > 1:
        cur = cur.join(size.where("n_blocks > 1").select("uid"), "uid", "left_semi")
    while level < most:
        level *= 2
        half = F.expr("at div 2")
        pairs = cur.groupBy("uid", half.alias("at")).agg(F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        pairs = stored(pairs, "pairs")
        names = stored(_named(pairs, ["a", "b"]).select("a", "b", "name"), "names")
        cur = stored(pairs.join(names, ["a", "b"]).select("uid", "at", "name"), "level")
        ready = size.where((F.col("n_blocks") > level // 2) & (F.col("n_blocks") <= level)).select("uid")
        done = done.unionByName(cur.join(ready, "uid", "left_semi").select("uid", "name"))
        cur = cur.join(size.where(F.col("n_blocks") > level).select("uid"), "uid", "left_semi")
    return size.join(done, "uid").select("doc_id", "text_sha256", "n_blocks", "name")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the text with A-Z lower-cased).

    Of equal texts, the row with the largest doc_id stays. Null texts count as empty, and equal one another. Rows that
    repeat a doc_id and its text count singly in group_size and have the same kept, so a caller who wants one row drops
    repeats; a null doc_id stays only if its group has no other. An empty table gives an empty one; other columns are ignored.
    """
    ids = stored(identities(docs, id_col, text_col, block), "identities")
    groups = ids.groupBy("n_blocks", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    at = ids.join(stored(groups, "groups"), ["n_blocks", "name"])
    return at.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""
