"""Cutting oversized texts into pieces at natural boundaries, with overlap.

Method: bounded-quantifier regular expressions. One expression, run over the whole text, consumes
up to the room of a piece; its alternatives are ordered by the strength of the boundary they end
at, and the last one takes characters where there is no boundary. The overlap is taken by
lookback from the offsets of the pieces, with SQL array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LIMIT = 6000
OVERLAP = 200

# Private-use characters that stand for a marker while boundaries are sought: its first character, the rest.
OPENED, WITHIN = "", ""

#: what a stretch may end with, the strongest first; trials and paragraphs end a line
LINE_END = r"\n"
SENTENCE_END = r"[.!?。！？…][\"”»)\]>]{0,3}(?:\s|(?<=[。！？…]))"
WORD_END = r"(?:\s|[，、；：])"


def masked(text: Column, room: int) -> Column:
    """``text`` with every ``<<...>>`` of at most ``room`` code points replaced by as many mask characters."""
    marker = F.lit(rf"<<[^<>]{{0,{room - 4}}}>>")
    found = F.regexp_extract_all(text, marker, F.lit(0))
    runs = F.transform(found, lambda m: F.concat(F.lit(OPENED), F.repeat(F.lit(WITHIN), F.length(m) - 1)))
    between = F.split(text, rf"<<[^<>]{{0,{room - 4}}}>>", -1)
    return F.array_join(F.transform(F.arrays_zip(between.alias("a"), runs.alias("b")), lambda x: F.concat(F.coalesce(x["a"], F.lit("")), F.coalesce(x["b"], F.lit("")))), "")


def piece_pattern(limit: int = LIMIT, overlap: int = OVERLAP) -> str:
    """The expression, over masked text, for the new part of each piece: at most ``limit - overlap`` code points.

    A stretch ends at the last line end in its upper half, else at the last sentence end there,
    else at the last blank of its upper nine tenths, else before a marker, else after as many
    characters as there is room for. The last stretch takes what is left.
    """
    room = limit - overlap
    half, tenth = room // 2, room // 10
    ends = [(half, room - 1, LINE_END), (half, room - 5, SENTENCE_END), (tenth, room - 1, WORD_END), (1, room, "")]
    cuts = [rf"[\s\S]{{{least},{max(least, most)}}}{end}(?!{WITHIN})" for least, most, end in ends]
    return "|".join([rf"[\s\S]{{1,{room}}}\z", *cuts, rf"[\s\S]{{1,{room}}}"])


def shared_length(before: Column, overlap: int = OVERLAP) -> Column:
    """How much of the end of ``before``, masked, the next piece begins with: at most ``overlap`` code points.

    The lookback moves on to a line, sentence or word boundary in its first half where there is
    one. It leaves a marker that it would begin within, and is empty where it lies within one.
    """
    tail = F.substring(before, F.greatest(F.length(before) - overlap + 1, F.lit(1)), F.lit(overlap))
    half = overlap // 2
    out = F.regexp_replace(tail, rf"^{WITHIN}+", "")
    moved = F.regexp_replace(out, rf"^(?:[^\n]{{0,{half}}}\n+|[\s\S]{{0,{half}}}?[.!?。！？]\s+|[\s\S]{{0,{half}}}?\s)(?=[\s\S])", "")
    return F.when(F.length(before) <= overlap, F.length(before)).otherwise(F.length(moved))


def cut_texts(df: DataFrame, key: str = "row_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every text longer than ``limit`` code points.

    Columns: the key, ``piece`` (from 0), ``n_pieces``, ``start`` (offset of the piece's first
    code point in the text), ``n_new`` (code points behind the overlap) and ``piece_text``. The
    text is restored by joining the last ``n_new`` code points of the pieces in order. Texts that
    are null, empty or within the limit have no row; rows delivered twice are cut twice; other
    columns of ``df`` are not read. A marker longer than ``limit - overlap`` may be cut.
    """
    if not (limit >= 100 and 0 < overlap <= limit // 4):
        raise ValueError("the limit must be 100 or more and the overlap at most a quarter of it")
    long = df.select(F.col(key).alias("key"), F.col(text).alias("whole")).where(F.length("whole") > limit)
    new = F.regexp_extract_all(masked(F.col("whole"), limit - overlap), F.lit(piece_pattern(limit, overlap)), F.lit(0))
    parts = long.select("key", "whole", new.alias("new"))
    # a long text has a piece always; a plain posexplode would infer a filter on its size and run the expressions for it again
    laid = parts.select("key", "whole", "new", F.posexplode_outer("new").alias("piece", "own"))
    begun = F.expr("aggregate(slice(new, 1, piece), 0, (n, x) -> n + length(x))")
    shared = F.when(F.col("piece") == 0, 0).otherwise(shared_length(F.expr("new[greatest(piece - 1, 0)]"), overlap))
    laid = laid.select("key", "whole", "piece", F.size("new").alias("n_pieces"), (begun - shared).alias("start"), F.length("own").alias("n_new"), shared.alias("shared"))
    return laid.select(
        F.col("key").alias(key), "piece", "n_pieces", "start", "n_new",
        F.substring("whole", F.col("start") + 1, F.col("shared") + F.col("n_new")).alias("piece_text"),
    )


def oversized(df: DataFrame, key: str = "row_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Keys of the texts that the operator cuts, one row for each input row."""
    return cut_texts(df, key, text, limit, overlap).where("piece = 0").select(key)
