"""Sources with cursors (S26-S30, R1): rows past a cursor, contents, and the next cursor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as tx

# Cursor column and its type by source; a string type compares as text.
CURSORS = {
    "slack": ("ts", "string"), "github": ("updated_at", "timestamp"), "gitlab": ("updated_at", "timestamp"), "bitbucket": ("updated_on", "timestamp"), "discord": ("id", "string"), "telegram": ("update_id", "long"),
    "notion": ("last_edited_time", "timestamp"), "google_drive": ("modifiedTime", "timestamp"), "spotify": ("release_date", "date"), "youtube": ("published_at", "timestamp"), "postgres": ("cursor", "long"), "mongodb": ("_id", "string"),
}


def joined_content(columns: list[str]) -> Column:
    """Non-empty columns joined by a blank line."""
    parts = F.array(*[F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string")) for c in columns])
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n\n")


def jdbc(spark: SparkSession, url: str, table: str, cursor: str | None = None, after=None, **options) -> DataFrame:
    """S26 (Q26): a database table; the typed cursor condition is pushed down."""
    import re

    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.]*", table):
        raise ValueError(f"{table!r} is no table name")
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return rows if cursor is None or after is None else rows.where(F.col(cursor) > F.lit(after))


def since(rows: DataFrame, source: str, after=None, column: str | None = None) -> DataFrame:
    """Rows past a cursor, compared by the source's own type; all rows without one."""
    name, kind = CURSORS[source]
    c = F.col(column or name).cast(kind)
    return rows if after is None else rows.where(c > F.lit(after).cast(kind))


def next_cursor(rows: DataFrame, source: str, column: str | None = None) -> DataFrame:
    """One row ``cursor``, as text; null for no rows, so that the old one stays."""
    name, kind = CURSORS[source]
    return rows.agg(F.max(F.col(column or name).cast(kind)).cast("string").alias("cursor"))


def items(rows: DataFrame, source: str, content: Column, source_id: Column, author: Column | None = None, created_at: Column | None = None, connector_id: str = "default") -> DataFrame:
    """``(content, connector_type, connector_id, source_id, author, created_at)``; empty contents are skipped."""
    out = rows.select(content.alias("content"), F.lit(source).alias("connector_type"), F.lit(connector_id).alias("connector_id"), source_id.cast("string").alias("source_id"), (author if author is not None else F.lit(None).cast("string")).alias("author"), (created_at if created_at is not None else F.lit(None).cast("long")).alias("created_at"))
    return out.where(F.coalesce(tx.trimmed("content"), F.lit("")) != "")


def vault(spark: SparkSession, folder: str, include: str = "*.md", modified_after: str | None = None) -> DataFrame:
    """Markdown files below a folder with front matter, links and tags; ``modified_after`` is pushed to the listing."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", include).option("recursiveFileLookup", "true")
    if modified_after is not None:
        reader = reader.option("modifiedAfter", modified_after)
    text = F.decode("content", F.lit("UTF-8"))
    rows = reader.load(folder).select("path", "modificationTime", text.alias("text"))
    body = F.regexp_replace("text", r"(?s)\A---\n.*?\n---(?:\n|\z)", "")
    return rows.select("path", "modificationTime", tx.frontmatter("text").alias("frontmatter"), tx.wikilinks("text").alias("links"), tx.tags("text").alias("tags"), tx.trimmed(body).alias("body"))
