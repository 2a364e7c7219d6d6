"""Match logs: who played, who took each game, and what each side was seen casting.

Events are found by pattern in the raw bytes, each from its player mark on. Logs
are read as `(match_id, part, value)`, so one log may lie over any number of rows.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import stacked

# How a log embeds its events.
LOGIN = r"@P([A-Za-z0-9_.\-]+)"
GAME_WIN = LOGIN + r" wins the game"
MATCH_WIN = LOGIN + r" wins the match (\d+-\d+)"
ROLL = LOGIN + r" rolled a \d"
CAST = LOGIN + r" (?:casts|plays) @\[([^@]+)@:"
FILE_NAME = r"Match_GameLog_([0-9a-f\-]+)\.dat$"
# Turns a piece of a log that is landed in pieces, and pieces a packed file.
PIECE_TURNS = 64
PIECES_A_FILE = 2_000


def scan(spark: SparkSession, folder: str, charset: str = "ISO-8859-1") -> DataFrame:
    """Every log of a folder, a file each or pieces in packed files; latin-1 keeps each
    byte of a file, so framing passes through."""
    match_id = lambda name: F.regexp_extract(name, FILE_NAME, 1).alias("match_id")
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "Match_GameLog_*.dat").load(folder)
        .select(match_id("path"), F.lit(0).cast("long").alias("part"), F.decode("content", charset).alias("value"), F.col("modificationTime").alias("start"))
    )
    packed = (
        spark.read.schema("log string, piece long, value string").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "part-*.json.gz").json(folder)
        .select(match_id("log"), F.col("piece").alias("part"), "value", F.col("_metadata.file_modification_time").alias("start"))
    )
    return stacked(files, packed).where("match_id != ''")


def land(logs: DataFrame, folder: str, turns: int = PIECE_TURNS) -> None:
    """Logs `(match_id, part, value)` in packed files: a line for every `turns` parts of
    a log, so that no log is gathered whole however long it is, and files are as many
    as the logs' bytes ask for and not as many as logs."""
    inside = F.array_sort(F.collect_list(F.struct("part", "value")))
    pieces = logs.where("match_id IS NOT NULL AND part IS NOT NULL").groupBy("match_id", F.floor(F.col("part") / turns).alias("piece")).agg(
        F.array_join(F.transform(inside, lambda turn: turn["value"]), "\n").alias("value")
    )
    named = pieces.select(F.concat(F.lit("Match_GameLog_"), "match_id", F.lit(".dat")).alias("log"), "piece", "value")
    # A packed file is read by one task, so files are kept short.
    named.write.option("maxRecordsPerFile", PIECES_A_FILE).json(folder, compression="gzip")


def events(logs: DataFrame) -> DataFrame:
    """Every event of every log in order, one row each."""
    found = []
    for kind, pattern, second in (
        ("roll", ROLL, False), ("win", GAME_WIN, False), ("match", MATCH_WIN, True), ("cast", CAST, True),
    ):
        players = F.regexp_extract_all("value", F.lit(pattern), F.lit(1))
        values = F.regexp_extract_all("value", F.lit(pattern), F.lit(2)) if second else players
        pairs = F.zip_with(players, values, lambda p, v: F.struct(p.alias("player"), v.alias("told")))
        found.append(F.struct(F.lit(kind).alias("kind"), pairs.alias("pairs")))
    return (
        logs.select("match_id", "part", F.inline(F.array(*found)))
        .select("match_id", "part", "kind", F.posexplode("pairs").alias("at", "pair"))
        .select("match_id", "part", "kind", "at", "pair.player", "pair.told")
    )


def winners(found: DataFrame) -> DataFrame:
    """The match winner: the first explicit line, else the first to two games."""
    at = F.struct("part", "at")
    told = (
        found.where("kind = 'match'").groupBy("match_id")
        .agg(F.min_by(F.struct("player", "told"), at).alias("told"))
        .select("match_id", F.col("told.player").alias("explicit"), F.col("told.told").alias("score"))
    )
    # A player's second win is the first one after the first: two minima, so no
    # log's events are ever sorted in one task.
    wins = found.where("kind = 'win'").select("match_id", "player", at.alias("at"))
    opened = wins.groupBy("match_id", "player").agg(F.min("at").alias("opened"))
    second = (
        wins.join(opened, ["match_id", "player"])
        .where(F.col("at") > F.col("opened"))
        .groupBy("match_id")
        .agg(F.min_by("player", "at").alias("inferred"))
    )
    return told.join(second, "match_id", "full_outer").select(
        "match_id", F.coalesce("explicit", "inferred").alias("winner"), "score"
    )


def players(found: DataFrame) -> DataFrame:
    """Players of each match in the order of their first roll."""
    return (
        found.where("kind = 'roll'").groupBy("match_id", "player")
        .agg(F.min(F.struct("part", "at")).alias("first"))
        .groupBy("match_id")
        .agg(F.array_sort(F.collect_list(F.struct("first", "player"))).alias("seated"))
        .select("match_id", F.transform("seated", lambda s: s["player"]).alias("players"))
    )


def game_wins(found: DataFrame) -> DataFrame:
    return found.where("kind = 'win'").groupBy("match_id", "player").agg(F.count("*").alias("wins"))


def cards_seen(found: DataFrame) -> DataFrame:
    """Each card a player was seen on, once, with where it was first seen."""
    return (
        found.where("kind = 'cast'").groupBy("match_id", "player", F.col("told").alias("card"))
        .agg(F.min(F.struct("part", "at")).alias("first"))
    )


def records(logs: DataFrame) -> DataFrame:
    """One record a match, in the shape the reader of match files expects."""
    found = events(logs)
    wins = game_wins(found).groupBy("match_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("player", "wins")))).alias("game_wins")
    )
    cards = (
        cards_seen(found).groupBy("match_id", "player")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "card"))), lambda c: c["card"]).alias("cards"))
        .groupBy("match_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("player", "cards")))).alias("cards"))
    )
    matches = logs.groupBy("match_id").agg(F.min("start").alias("start")) if "start" in logs.columns else (
        logs.select("match_id").distinct()
    )
    read = matches
    for part in (players(found), wins, winners(found), cards):
        read = read.join(part, "match_id", "left")
    return read


def match_record(matches: DataFrame, login: str) -> DataFrame:
    """Wins and losses of one login over the decided matches it played."""
    decided = matches.where(F.col("winner").isNotNull() & F.array_contains("players", login))
    return decided.agg(
        F.count_if(F.col("winner") == login).alias("wins"),
        F.count_if(F.col("winner") != login).alias("losses"),
    )


def write(matches: DataFrame, path: str) -> None:
    """One JSON record a line."""
    matches.write.json(path)
