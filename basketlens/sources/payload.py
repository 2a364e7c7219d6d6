"""Raw event payloads: one JSON a published event, in two shapes.

A league payload carries a win record per list and nothing ranked; a challenge
payload carries standings, records and perhaps a final ranking that are matched
to its lists by login. The presence of standings tells them apart. Numbers
arrive as text.
"""

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.dates import strict_date
from .store import Store, build

CARD = "struct<qty:string,card_attributes:struct<card_name:string,card_type:string>>"
PAYLOAD_SCHEMA = (
    "site_name string, name string, publish_date string, event_id string, description string, "
    "starttime string, "
    f"decklists array<struct<loginid:string,player:string,main_deck:array<{CARD}>,"
    f"sideboard_deck:array<{CARD}>,wins:struct<wins:string,losses:string>>>, "
    "standings array<struct<loginid:string,rank:string,score:string>>, "
    "winloss array<struct<loginid:string,wins:string,losses:string>>, "
    "final_rank array<struct<loginid:string,rank:string>>"
)
# What is read of a payload where no card is named: the parser steps over a list's cards.
CARDLESS_SCHEMA = PAYLOAD_SCHEMA.replace(f"main_deck:array<{CARD}>,sideboard_deck:array<{CARD}>,", "")
# Fixed value: the day and number that close an event id.
DATED_SUFFIX = r"-\d{4}-\d{2}-\d{2}\d+$"


def _reader(spark: SparkSession, lines: bool) -> DataFrameReader:
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "part-*" if lines else "*.json")


def scan(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """Every cached payload with the file it came from: one a file, or one a line
    of files that Spark wrote. The schema is explicit: inferred from leagues alone
    it would lose every ranked column. A text that doesn't parse is a row of nulls
    here, names no event and is left behind by `first_copies`; see `quarantine`."""
    return (
        _reader(spark, lines).schema(PAYLOAD_SCHEMA).option("multiLine", not lines).json(folder)
        .withColumn("path", F.col("_metadata.file_path"))
    )


def quarantine(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """Payload texts that don't parse, `(path, value)`: empty ones, broken ones, and
    those with a field of another kind than the schema's."""
    told = F.from_json("value", f"{PAYLOAD_SCHEMA}, broken string", {"columnNameOfCorruptRecord": "broken"})
    texts = _reader(spark, lines).option("wholetext", not lines).text(folder)
    return (
        texts.select(F.col("_metadata.file_path").alias("path"), "value", told.alias("told"))
        .where("told IS NULL OR told.broken IS NOT NULL")
        .select("path", "value")
    )


def first_copies(payloads: DataFrame) -> DataFrame:
    """One payload an event: a second file naming the same event is the same
    event listed twice, and the first file in name order stands.

    Names and paths alone decide; payloads are only kept or left."""
    first = payloads.groupBy("site_name").agg(F.min("path").alias("path"))
    return payloads.join(first, ["site_name", "path"], "left_semi").select(*payloads.columns)


def without_cards(payloads: DataFrame) -> DataFrame:
    """Payloads whose lists keep who and how they finished, not what they hold.

    Most of a payload is its cards, so readings that name none leave them behind
    before copies are told apart."""
    slim = lambda deck: F.struct(*[deck[c].alias(c) for c in ("loginid", "player", "wins")])
    return payloads.withColumn("decklists", F.transform("decklists", slim))


def event_class(site_name: Column) -> Column:
    """The kind of an event: its id without the dated suffix and the format prefix."""
    return F.regexp_replace(F.regexp_replace(site_name, DATED_SUFFIX, ""), r"^[^-]*-", "")


def finish_order() -> Column:
    """The final ranking where one was published, else the Swiss standings."""
    placed = lambda row: F.struct(row["loginid"].alias("loginid"), row["rank"].alias("rank"))
    return F.when(F.size("final_rank") > 0, F.transform("final_rank", placed)).otherwise(
        F.transform("standings", placed)
    )


def list_key(site_name: str = "site_name", pos: str = "pos") -> Column:
    """An id two runs agree on: the event and the list's place in it."""
    return F.xxhash64(site_name, pos)


def listed(payloads: DataFrame) -> DataFrame:
    """One row per published list, before its finish is matched to it."""
    ranked = F.col("standings").isNotNull()
    kind = event_class(F.col("site_name"))
    return payloads.select(
        F.col("site_name").alias("event_id"),
        F.when(ranked, F.col("description")).otherwise(F.col("name")).alias("event"),
        kind.alias("event_class"),
        F.when(ranked, F.substring("starttime", 1, 10)).otherwise(F.col("publish_date")).alias("day"),
        ranked.alias("ranked"),
        F.posexplode("decklists").alias("pos", "deck"),
    ).withColumn("list_id", list_key("event_id", "pos"))


def standings(payloads: DataFrame) -> DataFrame:
    """Placement, points and record of every login an event ranked.

    The three arrays are laid end to end and matched by login in one
    aggregation. A login an array names twice keeps the row it names last.
    """
    none = F.lit(None).cast("string")

    def told(row, placement=none, points=none, record=none):
        return F.struct(
            row["loginid"].alias("loginid"), placement.alias("placement"), points.alias("points"), record.alias("record")
        )

    laid = F.concat(
        F.transform(finish_order(), lambda row: told(row, placement=row["rank"])),
        F.transform("standings", lambda row: told(row, points=row["score"])),
        F.transform(
            F.coalesce("winloss", F.array().cast("array<struct<loginid:string,wins:string,losses:string>>")),
            lambda row: told(row, record=F.concat_ws("-", row["wins"], row["losses"])),
        ),
    )
    rows = (
        payloads.where(F.col("standings").isNotNull())
        .select(F.col("site_name").alias("event_id"), laid.alias("rows"))
        .select("event_id", F.posexplode("rows").alias("at", "row"))
        .select("event_id", "at", "row.*")
    )
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at")))
    return rows.groupBy("event_id", "loginid").agg(
        last("placement").cast("int").alias("placement"),
        last("points").cast("int").alias("points"),
        last("record").alias("record"),
    )


def with_finishes(lists: DataFrame, ranks: DataFrame) -> DataFrame:
    """Lists with their finish. A league publishes no rank, so its lists carry
    NULL placement and points and their own record."""
    own = F.concat_ws("-", "deck.wins.wins", "deck.wins.losses")
    joined = lists.withColumn("loginid", F.col("deck.loginid")).join(ranks, ["event_id", "loginid"], "left")
    day = strict_date("day")
    refused = F.raise_error(F.concat(F.lit("not an ISO day: "), F.coalesce("day", F.lit("none")))).cast("date")
    return joined.select(
        "list_id", F.col("deck.player").alias("actor"), "event", "event_id", "event_class",
        F.coalesce(day, refused).alias("date"),
        "placement", "points",
        F.when(F.col("ranked"), F.col("record")).otherwise(own).alias("record"),
    )


def baskets(payloads: DataFrame) -> DataFrame:
    return with_finishes(listed(payloads), standings(payloads))


def entries(payloads: DataFrame) -> DataFrame:
    """Every registered entry on its board, in the shape the store counts."""
    boards = F.array(
        F.struct(F.lit("a").alias("board"), F.col("deck.main_deck").alias("cards")),
        F.struct(F.lit("b").alias("board"), F.col("deck.sideboard_deck").alias("cards")),
    )
    return (
        listed(payloads)
        .select("list_id", F.inline(boards))
        .select("list_id", "board", F.explode("cards").alias("card"))
        .select(
            "list_id", "board",
            F.col("card.qty").cast("int").alias("qty"),
            F.col("card.card_attributes.card_name").alias("name"),
            F.col("card.card_attributes.card_type").alias("type"),
        )
    )


def store(spark: SparkSession, folder: str, snapshots: DataFrame, cfg: EngineConfig) -> Store:
    """The store over a folder of payloads, rebuilt whole from them."""
    payloads = first_copies(scan(spark, folder))
    return build(baskets(payloads), entries(payloads), snapshots, cfg)
