"""Changes of the store as new frames: nothing is edited in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``stored`` whose key it does not have."""
    return stored.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def latest(table: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The last version of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in version]))
    return table.withColumn("_r", rank).where("_r = 1").drop("_r")


def revise(assertions: DataFrame, corrections: DataFrame) -> DataFrame:
    """A correction supersedes a row and adds one with the old dates: ``(id, object, superseded_by, locked)``.

    ``corrections`` has (id, new_object); a row that is superseded keeps its columns.
    """
    touched = assertions.join(corrections, "id", "left")
    old = touched.withColumn("superseded_by", F.when(F.col("new_object").isNotNull(), F.concat("id", F.lit("'")))).withColumn("locked", F.lit(False)).drop("new_object")
    new = assertions.join(corrections, "id").withColumn("object", F.col("new_object")).withColumn("id", F.concat("id", F.lit("'"))).withColumn("superseded_by", F.lit(None).cast("string")).withColumn("locked", F.lit(True)).drop("new_object")
    return old.unionByName(new)


def rename(names: DataFrame, renames: DataFrame, search_only: int = 5) -> DataFrame:
    """``(entity_id, label, precedence, revealed_pos)`` after renaming labels (``label``, ``to``).

    A new form that the entity already has folds into it: highest precedence, earliest reveal. The old form stays,
    search-only.
    """
    hit = names.join(renames, "label")
    new = hit.select("entity_id", F.col("to").alias("label"), "precedence", "revealed_pos")
    old = hit.select("entity_id", "label", F.lit(search_only).alias("precedence"), "revealed_pos")
    rest = names.join(renames.select("label"), "label", "left_anti").select("entity_id", "label", "precedence", "revealed_pos")
    return rest.unionByName(new).unionByName(old).groupBy("entity_id", "label").agg(F.max("precedence").alias("precedence"), F.min("revealed_pos").alias("revealed_pos"))


def counted(parts: dict[str, DataFrame]) -> DataFrame:
    """``(name, n)`` of several frames."""
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def export(tables: dict[str, DataFrame], tenant: str, folder: str) -> DataFrame:
    """Write the rows of ``tenant`` of every table below ``folder``; ``(name, n)`` counts what was written, read back.

    Each table has ``tenant`` (string; null belongs to nobody). A table without rows of the tenant is written empty.
    """
    written = {}
    for name, df in tables.items():
        df.where(F.col("tenant") == tenant).drop("tenant").write.parquet(f"{folder}/{name}")
        written[name] = df.sparkSession.read.parquet(f"{folder}/{name}")
    return counted(written)


def purge(tables: dict[str, DataFrame], gone: DataFrame, folder: str) -> DataFrame:
    """Write every table without the rows of the tenants ``gone`` below ``folder``; ``(name, kept, removed)``.

    ``gone`` is a short stated list of ``tenant``. Rows of no tenant (null) stay.
    """
    out = None
    for name, df in tables.items():
        df.join(F.broadcast(gone), "tenant", "left_anti").write.parquet(f"{folder}/{name}")
        kept = df.sparkSession.read.parquet(f"{folder}/{name}").agg(F.count("*").alias("kept"))
        removed = df.join(F.broadcast(gone), "tenant", "left_semi").agg(F.count("*").alias("removed"))
        one = kept.crossJoin(removed).select(F.lit(name).alias("name"), "kept", "removed")  # one row each
        out = one if out is None else out.unionByName(one)
    return out


def reopen(proposals: DataFrame, decisions: DataFrame, which: Column) -> DataFrame:
    """``(id, status, action)``: cards that are rejected or deferred and meet ``which`` are proposed again and lose their decision.

    Other cards keep both; of several decisions on one card the least action stands, a card without one has null.
    """
    again = F.coalesce(F.col("status").isin("rejected", "deferred") & which, F.lit(False))
    cards = proposals.withColumn("again", again)
    kept = decisions.groupBy("id").agg(F.min("action").alias("action")).join(cards.where("again").select("id"), "id", "left_anti")
    return cards.join(kept, "id", "left").select("id", F.when(F.col("again"), "proposed").otherwise(F.col("status")).alias("status"), "action")


def card_priority(category: Column, confidence: Column) -> Column:
    base = F.when(category == "entity", 30).when(category == "assertion", 20).otherwise(10)
    return base + F.when(confidence < 0.5, 5).otherwise(0)


def paragraphs(html: Column) -> Column:
    """Texts of paragraphs and list items, markup, comments, scripts and tables taken out."""
    clean = F.regexp_replace(html, r"(?s)<!--.*?-->|<(script|style|table)[^>]*>.*?</\1>", "")
    parts = F.regexp_extract_all(clean, F.lit(r"(?s)<(?:p|li)>(.*?)</(?:p|li)>"), 1)
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, "<[^>]*>", ""), r"\s+", " "))), lambda p: F.length(p) > 0)
