"""Source-shaped data Spark derives from the star tables, for the ingest readings."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path
from ..sources import matchlogs, payload, star
from ..streaming import arrivals

# Words of a turn: no blanks, no controls, and not the mark that frames an event.
WORD = r"[^\x00-\x20@]+"
PAYLOADS_A_FILE = 200_000


def site_names(orders: DataFrame) -> DataFrame:
    """An event id per list in the published form: format, kind, day and number."""
    kind = F.when(F.col("o_orderpriority").isin(*star.LEAGUE_PRIORITIES), F.lit("league")).otherwise(
        F.lower("o_orderpriority")
    )
    return orders.select(
        F.col("o_orderkey").alias("list_id"),
        F.concat(F.lit("basket-"), kind, F.lit("-"), F.date_format("o_orderdate", "yyyy-MM-dd"),
                 F.col("o_orderkey").cast("string")).alias("site_name"),
        F.col("o_orderstatus").alias("fill"),
    )


def with_status(run, *states: str) -> DataFrame:
    return run.table("orders").where(F.col("o_orderstatus").isin(*states)).select(F.col("o_orderkey").alias("list_id"))


def documents(run) -> DataFrame:
    """Payload texts `(feed, fill, value)`: one an order, published on two feeds.

    Entries are counted before they are gathered, so one order's payload is as
    long as the vocabulary it holds and no longer. Dealt by list once, they are
    counted, gathered and joined where they lie.
    """
    card = F.struct(
        F.col("qty").cast("string").alias("qty"),
        F.struct(F.col("name").alias("card_name"), F.rpad("type", 10, " ").alias("card_type")).alias("card_attributes"),
    )
    entries = (
        star.item_entries(run.spark, run.sf_dir, dealt=True).groupBy("list_id", "board", "name", "type")
        .agg(F.sum("qty").alias("qty"))
    )
    boards = entries.groupBy("list_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("board") == "a", card))).alias("main_deck"),
        F.array_sort(F.collect_list(F.when(F.col("board") == "b", card))).alias("sideboard_deck"),
    )
    none = F.array().cast(f"array<{payload.CARD}>")
    league = F.col("event_class") == "league"
    login = F.col("actor")
    deck = F.struct(
        login.alias("loginid"), login.alias("player"),
        F.coalesce("main_deck", none).alias("main_deck"), F.coalesce("sideboard_deck", none).alias("sideboard_deck"),
        F.when(league, F.struct(F.lit("5").alias("wins"), F.lit("0").alias("losses"))).alias("wins"),
    )
    rank = F.struct(login.alias("loginid"), F.col("placement").cast("string").alias("rank"),
                    F.col("points").cast("string").alias("score"))
    # The dearest priority also publishes a final ranking, one place further down.
    final = F.struct(login.alias("loginid"), (F.col("placement") + 1).cast("string").alias("rank"))
    won = F.struct(login.alias("loginid"), F.floor(F.col("points") / 3).cast("string").alias("wins"), F.lit("0").alias("losses"))
    day = F.date_format("date", "yyyy-MM-dd")
    text = F.to_json(
        F.struct(
            "site_name",
            F.when(league, F.col("event")).alias("name"),
            F.when(league, day).alias("publish_date"),
            F.when(~league, F.col("event")).alias("description"),
            F.when(~league, F.concat(day, F.lit(" 00:00:00.0"))).alias("starttime"),
            F.array(deck).alias("decklists"),
            F.when(~league, F.array(rank)).alias("standings"),
            F.when(~league, F.array(won)).alias("winloss"),
            F.when(F.col("event_class") == "1-URGENT", F.array(final)).alias("final_rank"),
        )
    )
    return (
        run.baskets.join(site_names(run.table("orders")), "list_id")
        .join(boards, "list_id", "left")
        .select("fill", text.alias("value"))
        .select(F.explode(F.array(F.lit("one"), F.lit("two"))).alias("feed"), "fill", "value")
    )


def land_payloads(run) -> str:
    """The folder where both feeds lie as packed files, a payload a line. On the second
    feed, payloads of partly filled orders broke off half way."""
    folder = fresh_path(run.spark, "landing")
    broken = (F.col("feed") == "two") & (F.col("fill") == "P")
    half = F.substring("value", F.lit(1), F.floor(F.length("value") / 2).cast("int"))
    rows = documents(run).select("feed", F.when(broken, half).otherwise(F.col("value")).alias("value"))
    # A packed file is read by one task, so files are kept short.
    rows.write.partitionBy("feed").option("maxRecordsPerFile", PAYLOADS_A_FILE).text(folder, compression="gzip")
    return folder


def payloads(run) -> DataFrame:
    """The first copy of every event's payload, without its cards, scanned from where they landed."""
    return payload.first_copies(payload.without_cards(payload.scan(run.spark, run.landing, lines=True)))


def feed(path: F.Column) -> F.Column:
    """The feed whose folder a file lies in."""
    return F.regexp_extract(path, "/feed=([^/]+)/", 1)


def snapshot_table(events: DataFrame) -> DataFrame:
    """Transcribed readings as text: a day's count of each event type as its percentage."""
    return events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n")).select(
        F.date_format("day", "yyyy-MM-dd").alias("captured_on"), F.lit("1").alias("window_days"),
        F.col("event_type").alias("archetype"), F.col("n").cast("string").alias("meta_pct"),
        F.col("n").cast("string").alias("deck_count"),
    )


def capture_texts(reference: DataFrame) -> DataFrame:
    """Reference baskets written out as captures: a basket is one short file.

    The note mark cannot be part of a name, so names are written without it.
    """
    said = F.concat_ws(
        " ", F.when(F.col("override").isNotNull(), F.concat("override", F.lit(":"))), F.col("note")
    )
    line = lambda copies: F.concat(
        F.col(copies).cast("string"), F.lit(" "), F.translate("item", "#", "-"),
        F.when(said != "", F.concat(F.lit("  # "), said)).otherwise(F.lit("")),
    )
    main = F.when((F.col("qty_a") > 0) | (F.col("qty_b") == 0), line("qty_a"))
    side = F.when(F.col("qty_b") > 0, line("qty_b"))
    board = lambda text: F.array_join(F.array_sort(F.collect_list(text)), "\n")
    return reference.groupBy("owner", "version").agg(
        F.concat_ws(
            "\n", F.lit("# exported\nMainboard"), board(main), F.lit(""), F.lit("Sideboard"), board(side)
        ).alias("value")
    )


def logs(conversations: DataFrame) -> DataFrame:
    """Conversations as match logs, a part a turn: who spoke rolled, cast every
    word of the text as a card, and took a game with a long enough text."""
    player = F.col("role")
    cast = F.concat(F.lit("@P"), player, F.lit(" casts @[$0@:1,2:@]"))
    text = F.concat_ws(
        " ", F.concat(F.lit("~@P"), player, F.lit(" rolled a 3")), F.regexp_replace("text", F.lit(WORD), cast),
        F.when(F.length("text") > 200, F.concat(F.lit("@P"), player, F.lit(" wins the game"))),
        F.when(player == "system", F.concat(F.lit("@P"), player, F.lit(" wins the match 2-1"))),
    )
    return conversations.select(
        F.col("conv_id").cast("string").alias("match_id"), F.col("turn").alias("part"), text.alias("value")
    )


def landed_logs(run) -> DataFrame:
    """The logs landed as files and scanned from there."""
    folder = fresh_path(run.spark, "logs")
    matchlogs.land(logs(run.table("conversations")), folder)
    return matchlogs.scan(run.spark, folder, "UTF-8")


def streamed_arrivals(run) -> DataFrame:
    """Payload texts landed as files and drained through the arrivals stream."""
    root = fresh_path(run.spark, "arrivals")
    documents(run).select("value").write.option("maxRecordsPerFile", PAYLOADS_A_FILE).text(f"{root}/landing", compression="gzip")
    landed = run.spark.readStream.schema("value string").text(f"{root}/landing")
    parsed = landed.select(F.from_json("value", payload.CARDLESS_SCHEMA).alias("p")).select("p.*")
    return arrivals.land(arrivals.arriving_lists(parsed), f"{root}/lists", f"{root}/state", "month", run.cfg.unsettled_days).select(
        "event_id", "event_class", "actor", F.to_date("event_ts").alias("date")
    )


def two_publications(raw: DataFrame, last, unsettled: int) -> tuple[DataFrame, DataFrame]:
    """What was published some days before the last one, and what is published then.

    The first lacks the last days, one whole event and every seventh list of its
    own last three days, of which the second brings those still unsettled; the
    second has withdrawn every eleventh list of the unsettled days.
    """
    first_day = F.date_sub(last, unsettled)
    tardy = (F.col("date") >= F.date_sub(first_day, 2)) & (F.col("list_id") % 7 == 0)
    missed = F.col("event_id") == raw.agg(F.min("event_id")).scalar()
    gone = (F.col("date") >= first_day) & (F.col("list_id") % 11 == 0)
    return raw.where((F.col("date") <= first_day) & ~tardy & ~missed), raw.where(~gone)
