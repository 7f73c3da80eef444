"""Best-fit packing planned on the histogram of lengths.

Documents are tokenised; one longer than a sequence is cut into full pieces and a last one. Best fit decreasing runs
over counts: all pieces of one length are placed at once into groups of sequences with the same room, tightest room
first, each sequence taking as many as still fit. That gives what placing piece by piece gives, in work and memory
bounded by the number of lengths. The plan is a table of ranges: the pieces of a length with ranks ``low`` to ``high``
go into consecutive sequences from ``first``, ``each`` of them a sequence, from place ``base`` on. A piece's rank within
its length is its number in its task plus the counts of the tasks before, so no length is gathered anywhere.

Edge cases: a null or empty text is its end id alone; null ids and repeated rows are packed like others; equal lengths
take slots in the order in which they are read; an empty table gives no pieces. Only id and text are read, so other
columns may have any name.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headloom.llm.common import read_table, staged
from headloom.llm.packing import CAPACITY, token_pieces
from headloom.llm.tokens import PIECES, WORD_VOCAB

END_ID = 1
PLAN = "length long, low long, high long, first long, each long, base long"


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Ranges (length, low, high, first, each, base) for ``histogram[length]`` pieces of every length."""
    open_, rooms, made, out = {}, [], 0, []  # room -> groups (first, number) of sequences; rooms in use, ascending

    def leave(room: int, first: int, number: int) -> None:
        if room and number:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((first, number))

    for length in sorted(histogram, reverse=True):
        placed, count = 0, histogram[length]
        while placed < count:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, number = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, first, number = capacity, made, -(-(count - placed) // (capacity // length))
                made += number
            each = room // length
            used = min(number, (count - placed) // each)
            if used:
                out.append((length, placed, placed + used * each, first, each, capacity - room))
                leave(room - each * length, first, used)
                placed += used * each
            if used < number and placed < count:
                some = count - placed  # fewer than one sequence takes
                if some < each:
                    out.append((length, placed, count, first + used, some, capacity - room))
                    leave(room - some * length, first + used, 1)
                    placed, used = count, used + 1
            leave(room, first + used, number - used)
    return out


def pack_best_fit(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocab: str = WORD_VOCAB, end_id: int = END_ID, known: int = PIECES,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids (binary, little-endian unsigned 32-bit)."""
    spark = df.sparkSession
    pieces = staged(token_pieces(df, id_col, text_col, capacity, 1, vocab, end_id, known), "best-fit-pieces")
    counts = staged(pieces.groupBy("length", "part").count(), "best-fit-counts")
    histogram = dict(counts.groupBy("length").agg(F.sum("count")).collect())  # a row a length, ``capacity`` at most
    table = F.broadcast(spark.createDataFrame(plan(histogram, capacity), PLAN))  # bounded by lengths and rooms
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    ranked = pieces.join(starts, ["length", "part"]).withColumn("_rank", F.col("_start") + F.col("nth")).alias("r")
    hit = (F.col("r.length") == F.col("t.length")) & (F.col("_rank") >= F.col("t.low")) & (F.col("_rank") < F.col("t.high"))
    nth = F.col("_rank") - F.col("low")
    return ranked.join(table.alias("t"), hit).select(
        "doc_id",
        F.expr(f"cast(start div {capacity} as int)").alias("piece"),
        "start",
        "r.length",
        "ids_crc32",
        (F.col("first") + F.floor(nth / F.col("each"))).alias("sequence_id"),
        (F.col("base") + nth % F.col("each") * F.col("r.length")).alias("offset"),
        "ids",
    )


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(read_table(spark, sf_dir, "documents")).drop("ids")
