"""Reference captures: text files of `copies name  # note` under board headings."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.shares import resolve_alias

# A version file's name, a note's opening override, the headings.
VERSION = r"^v(\d+)-"
OVERRIDE = r"(?i)^(core|flex)(?::\s*|\s*$)"
MAINBOARD, SIDEBOARD = "mainboard", "sideboard"


def scan(spark: SparkSession, folder: str, owner: str) -> DataFrame:
    """Every numbered capture of a folder as `(owner, version, value)`."""
    name = F.element_at(F.split("path", "/"), -1)
    files = (
        spark.read.option("wholetext", True).option("pathGlobFilter", "v*.txt").text(folder)
        .withColumn("path", F.col("_metadata.file_path"))
        .withColumn("number", F.regexp_extract(name, VERSION, 1))
    )
    return files.where("number != ''").select(
        F.lit(owner).alias("owner"), F.col("number").cast("int").alias("version"), "value"
    )


def _text(column: Column) -> Column:
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def read(captures: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Captures as `reference_items`, one row per basket and item.

    A heading holds for the lines below it. Lines of one capture are one file's,
    so the pass that carries the heading down is as short as the file.
    """
    lines = captures.select("owner", "version", F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("at", "line"))
    cut = F.instr("line", "#")
    parts = lines.select(
        "owner", "version", "at",
        _text(F.when(cut > 0, F.substring_index("line", "#", 1)).otherwise(F.col("line"))).alias("entry"),
        _text(F.when(cut > 0, F.expr("substring(line, instr(line, '#') + 1)")).otherwise(F.lit(""))).alias("said"),
    ).where("entry != ''")
    heading = F.when(F.lower("entry").isin(MAINBOARD, SIDEBOARD), F.lower("entry"))
    above = Window.partitionBy("owner", "version").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.withColumn("heading", heading).withColumn(
        "board", F.last("heading", ignorenulls=True).over(above)
    )
    slots = placed.where("heading IS NULL AND board IS NOT NULL").select(
        "owner", "version", "at", "board",
        F.regexp_extract("entry", r"^(\S+) (.*)$", 1).cast("int").alias("copies"),
        resolve_alias(F.regexp_extract("entry", r"^(\S+) (.*)$", 2), cfg.item_aliases).alias("item"),
        F.nullif(F.lower(F.regexp_extract("said", OVERRIDE, 1)), F.lit("")).alias("override"),
        F.nullif(_text(F.regexp_replace("said", OVERRIDE, "")), F.lit("")).alias("note"),
    )
    copies = lambda name: F.coalesce(
        F.sum(F.when(F.col("board") == name, F.col("copies"))), F.lit(0)
    ).cast("int")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at")))
    return slots.groupBy("owner", "version", "item").agg(
        copies(MAINBOARD).alias("qty_a"), copies(SIDEBOARD).alias("qty_b"),
        last("override").alias("override"), last("note").alias("note"),
    )


def current(reference: DataFrame) -> DataFrame:
    """The newest version of every owner's basket."""
    newest = reference.groupBy("owner").agg(F.max("version").alias("version"))
    return reference.join(newest, ["owner", "version"], "left_semi")
