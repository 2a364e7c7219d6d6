"""Packing documents into sequences of fixed length: shortest-pack-first over the length histogram.

Each text becomes token ids and an end id, cut where a full sequence ends; full
pieces are sequences of their own and the rest of each document is packed. The
histogram of rest lengths (at most `size` rows, whatever the input) comes to the
driver. Lengths are placed longest first, each piece into the shortest pack, which has
the most room, or a new one if even that can't hold it. Packs filled alike are one
packing pattern with a count, and a pattern takes pieces until another has more
room, so the work depends on `size` and not on the number of documents. Last,
pieces of a length are numbered and patterns are joined back to them by that rank.

Ranks are taken in salted groups (length and a part of the hash of the piece, about
GROUP_ROWS rows each) with offsets from counted groups, so a length that a third of
all documents share is spread over many tasks. The plan of patterns has at most 3 * `size` patterns of at
most sqrt(2 * `size`) distinct lengths each, which bounds what is sent to tasks.

Ids come from the tokenizer itself, once for each distinct word and task: the
tokenizer splits text into words before it merges, and never looks across white
space, so the ids of the parts are those of the whole text (tests compare them).
The table of words is emptied when it reaches MOST_WORDS.

Defined cases: a null or empty text is its end id alone; a null doc_id and rows
that repeat a doc_id are documents of their own; an empty table gives no rows;
further columns are ignored.
"""

import os
import re
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .work import kept

SIZE = 2048
END_ID = 1
GROUP_ROWS = 2_000
MOST_WORDS = 400_000

PIECES = "doc_id long, row_start long, length int, ids_crc32 long, doc_tokens long, ids binary"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# The tokenizer's splitting pattern, for text whose characters are all below U+0100 and lower-cased. Such text
# is in composed form, so the tokenizer's normaliser changes nothing in it but white space, which the splitter drops.
WORD = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
    r"|[^\t-\r \x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+"
)


class Encoder(dict):
    """Ids of whole texts as little-endian unsigned 32-bit bytes; as a dict, the ids of each word met."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's cores are Spark's to share out
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isprintable() and word == word.lower() and WORD.fullmatch(word):
            found = [token.id for token in self.model.tokenize(word)]  # normaliser and splitter leave it as it is
        else:
            found = self.tokenizer.encode(word, add_special_tokens=False).ids
        self[word] = ids = array("I", found).tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        if len(self) > MOST_WORDS:
            self.clear()
        return b"".join(map(self.__getitem__, self.split(text)))

    def split(self, text: str) -> list[str]:
        """Parts whose ids, put together, are those of the text."""
        if (text.isascii() or max(text) <= "\xff") and not any(s in text for s in self.special):
            return WORD.findall(text.lower())
        return text.replace("\n", " ").replace("\t", " ").split(" ")


def _tokens(path: str, end_id: int, size: int):
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches):
        encoder = Encoder(path)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for low in range(0, len(texts), 512):
                out = []
                for name, text in zip(names[low : low + 512], texts.slice(low, 512).to_pylist(), strict=True):
                    body = encoder.encode(text) + end
                    n = len(body) // 4
                    for start in range(0, n, size):
                        ids = body[4 * start : 4 * (start + size)]
                        out.append((name, start, len(ids) // 4, zlib.crc32(ids), n, ids))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                    names=["doc_id", "row_start", "length", "ids_crc32", "doc_tokens", "ids"],
                )

    return pieces


def pieces(docs: DataFrame, path: str | None = None, end_id: int = END_ID, size: int = SIZE) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, ids (binary), piece."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(_tokens(path or vocabulary(), end_id, size), PIECES)
    return made.withColumnRenamed("row_start", "start").withColumn("piece", F.monotonically_increasing_id())


def patterns(histogram: dict[int, int], size: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Shortest-pack-first: ([(length, how many)], number of sequences) per pattern, every length placed.

    Patterns wait by the room they have left. A length takes the pattern with the
    most room, several of its kind at once as long as no other has more, and opens
    packs where it doesn't fit there.
    """
    waiting: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    rooms: list[int] = []  # sorted rooms with waiting patterns
    done = []

    def put(pattern, count, room):
        if room == 0:
            done.append((pattern, count))
        elif room in waiting:
            waiting[room].append((pattern, count))
        else:
            waiting[room] = [(pattern, count)]
            rooms.insert(int(np.searchsorted(rooms, room)), room)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if rooms and rooms[-1] >= length:
                room = rooms[-1]
                pattern, count = waiting[room].pop()
                if not waiting[room]:
                    del waiting[room], rooms[-1]
                # Another pattern is the shortest once this one has less room than it.
                rounds = (room - (rooms[-1] if rooms else 0)) // length + 1
            else:
                rounds = min(size // length, left)
                pattern, count, room = [], left // rounds, size
            times = min(rounds, room // length, max(1, left // count))
            used = min(count, left // times)
            if used < count:
                put(pattern, count - used, room)
            more = pattern[-1][1] if pattern and pattern[-1][0] == length else 0
            put([*(pattern[:-1] if more else pattern), (length, more + times)], used, room - times * length)
            left -= used * times
    done += [x for room in rooms for x in waiting[room]]
    return done


def slots(plan: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """The plan as arrays sorted by (length, first rank): where ranks of a length go.

    Ranks from `rank` on fill `times` places side by side in each of consecutive sequences from `sequence` on, from `offset` on.
    """
    rows, first, nth = [], 0, {}
    for pattern, count in plan:
        offset = 0
        for length, times in pattern:
            rows.append((length, nth.get(length, 0), times, first, offset))
            nth[length] = nth.get(length, 0) + times * count
            offset += length * times
        first += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "times", "sequence", "offset"), table.T, strict=True))


def _placer(where: dict[str, np.ndarray]):
    def place(batches):
        lengths, ranks = where["length"], where["rank"]
        span = np.searchsorted(lengths, np.arange(lengths.max(initial=0) + 2))
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("rank").to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.zeros(len(rank), np.int64)
            for one in np.unique(length):
                mine = length == one
                low, high = span[one], span[one + 1]
                at[mine] = low + np.searchsorted(ranks[low:high], rank[mine], "right") - 1
            k = rank - ranks[at]
            sequence = where["sequence"][at] + k // where["times"][at]
            offset = where["offset"][at] + k % where["times"][at] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sequence), pa.array(offset)], names=[*batch.schema.names, "sequence_id", "offset"]
            )

    return place


def ranked(rests: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows with their rank (from 0) among those of their length; counts: length, part, n."""
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "part", "base")
    own = Window.partitionBy("length", "part").orderBy("piece")
    return rests.withColumn("nth", F.row_number().over(own) - 1).join(base, ["length", "part"]).withColumn("rank", F.col("nth") + F.col("base"))


def placed(made: DataFrame, size: int = SIZE) -> DataFrame:
    """The pieces of `pieces` (written once, without their ids) with sequence_id and offset."""
    slim = made.select("piece", "doc_id", "start", "length", "ids_crc32", "doc_tokens")
    full, rest = slim.filter(F.col("length") == size), slim.filter(F.col("length") < size)
    histogram = {row.length: row["count"] for row in rest.groupBy("length").count().collect()}  # under `size` rows
    # Each length has parts of about GROUP_ROWS rows; the numbers of parts are a literal of `size` entries.
    parts = F.array(*[F.lit(-(-histogram.get(n, 1) // GROUP_ROWS)) for n in range(1, size)])
    rest = rest.withColumn("part", F.pmod(F.xxhash64("piece"), F.element_at(parts, F.col("length"))).cast("int"))
    counts = kept(rest.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-lengths")
    plan = patterns(histogram, size)
    schema = "piece long, doc_id long, start long, length int, ids_crc32 long, doc_tokens long, rank long, sequence_id long, offset long"
    seats = ranked(rest, counts).select(*slim.columns, "rank").mapInArrow(_placer(slots(plan)), schema).drop("rank")
    # Full pieces need no plan: each is a sequence, numbered after the planned ones.
    alone = full.withColumns({"sequence_id": F.lit(sum(count for _, count in plan)) + F.col("piece"), "offset": F.lit(0).cast("long")})
    return seats.unionByName(alone).withColumn("length", F.col("length").cast("long"))


def packed(docs: DataFrame, path: str | None = None, end_id: int = END_ID, size: int = SIZE, with_ids: bool = True) -> DataFrame:
    """A row per piece: piece, doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, ids."""
    made = kept(pieces(docs, path, end_id, size), "pieces")
    seats = placed(made, size)
    return seats.join(made.select("piece", "ids"), "piece") if with_ids else seats
