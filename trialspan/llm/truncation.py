"""Texts that stop before their end.

Method: word trigrams, in pure SQL. Trigrams of words, numbers, signs and markers are counted inside
the texts' segments and at their ends; a final trigram that goes on inside texts and is almost never
terminal marks a cut. The last word may itself be cut, so it goes on also where a longer word
begins with it. The first word of a trigram counts as any word, so that the counts are dense; where
they are too few to decide, the counts of the last word alone do. Identical segments are counted once
with their number before trigrams are made: the many equal trial lines cost little. A sign put
behind a cut is taken off before the end is judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trialspan.llm.shares import share_bound
from trialspan.runtime import cut

#: an end is a cut if such a share of its places, or less, are ends of lines or texts, by the upper
#: Wilson bound, and regular if that or more are, by the lower bound: alike in a table of any size
TERMINAL = 0.2

# Control characters that mark the start of a segment's words.
_START = "\x01"
# Signs that are put where a text was cut.
SIGN = r"(?:\s*(?:…|\.{3,}|\[(?:\.{3}|…)\]|\((?:\.{3}|…)\)|\[\+?\s?\d+ (?:more )?(?:char|byte|word|line|zeichen|caract)[^\]\n]{0,20}\]|[\[(](?:cont(?:\.|inued|inúa|inua)?|truncated|cut|more|snip|gekürzt|cortado|truncado|recortado|截断|未完|待续)[.…]{0,3}[\])]|→|>>>|✂))+$"
#: parts of characters, escapes and references that a cut leaves
BROKEN = r"(?:�|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|\\|&#?[A-Za-z0-9]{0,8})$"
STOP = r"(?:(?<!\d)[.!?]|[。！？]|(?<=\d)[!?])[\"”»“')\]>」』]*$"
_NEXT = r" (?<=[.!?] )|[\r\n]+"
# letters of Latin scripts make words, longer runs several; characters of other scripts are tokens each; a number
# whose point ends the segment is one token, as it may go on
_TOKEN = r"[A-Za-zÀ-ɏ]{1,40}|9\.9|9\.\z|9|<<|>>|[^\s]"
#: more tokens than a trigram needs from the end of a text, in reverse order
_LAST = r"^(?:\s*+(?:[A-Za-zÀ-ɏ]++|\d++|\S)){1,12}"
#: signs and broken parts are looked for in so many last code points, in the whole text if it ends in a longer run of signs
TAIL = 200
BLANK = " \t\r\n\v\f    ​  　﻿"


def trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANK))


def _last(text: Column, n: int) -> Column:
    return F.substring(text, F.greatest(F.length(text) - n + 1, F.lit(1)), F.lit(n))


def _tokens(segment: Column) -> Column:
    """Two start marks and the words, numbers and signs of a segment whose numbers are 9."""
    return F.concat(F.array(F.lit(_START), F.lit(_START)), F.regexp_extract_all(segment, F.lit(_TOKEN), F.lit(0)))


def _context(first: Column, second: Column) -> Column:
    """The hash of what stands before the last word of a trigram: any word for the first, any name for a capitalised second."""
    a, b = F.ascii(first), F.ascii(second)
    return F.xxhash64(F.when(((a >= 65) & (a <= 122)) | (a > 191), "w").otherwise(first), F.when((b >= 65) & (b <= 90), "A").otherwise(second))


def final_trigrams(corpus: DataFrame) -> DataFrame:
    """Every row with what its end says by itself: (row_id, source, spans, sign, broken, stopped, text, context, word).

    ``context`` and ``word`` are the final trigram, null where the text is blank or a full stop ends it.
    """
    body = F.coalesce(trimmed(F.col("text")), F.lit(""))
    rows = corpus.select("row_id", "source", "n_answer_spans", body.alias("body"))
    rows = rows.withColumn("tail", _last(F.col("body"), TAIL))
    bare = trimmed(F.regexp_replace("tail", SIGN, ""))
    rows = rows.withColumn("sign", F.col("tail").rlike(SIGN)).withColumn("bare", F.when(F.col("sign"), bare))
    short = F.when(F.col("bare") == "", F.regexp_replace("body", SIGN, "")).otherwise(F.concat(F.substring("body", F.lit(1), F.length("body") - F.length("tail")), "bare"))
    rows = rows.withColumn("core", F.when(F.col("sign"), trimmed(short)).otherwise(F.col("body")))
    end = _last(F.col("core"), TAIL)
    closed = (F.length("body") - F.length(F.replace("body", F.lit(">>"), F.lit("")))) / 2
    rows = rows.select(
        "row_id", "source", F.coalesce(F.col("n_answer_spans") > closed, F.lit(False)).alias("spans"), "sign", end.rlike(BROKEN).alias("broken"),
        (end.rlike(STOP) | (F.col("core") == "")).alias("stopped"), F.xxhash64("body").alias("text"), F.when(~end.rlike(STOP) & (F.col("core") != ""), F.col("core")).alias("core"),
    )
    piece = F.regexp_replace(F.reverse(F.regexp_extract(F.reverse("core"), _LAST, 0)), r"\d+", "9")
    tokens = F.slice(_tokens(F.element_at(F.split(piece, _NEXT, -1), -1)), -3, 3)
    rows = rows.select("row_id", "source", "spans", "sign", "broken", "stopped", "text", F.when(F.col("core").isNotNull(), tokens).alias("t"))
    word = F.element_at("t", 3)
    return rows.select("row_id", "source", "spans", "sign", "broken", "stopped", "text", F.when(F.col("t").isNotNull(), _context(F.element_at("t", 1), F.element_at("t", 2))).alias("context"), word.alias("word"))


def inner_trigrams(corpus: DataFrame) -> DataFrame:
    """(context, word, goes_on, stops) of all trigrams in all segments: how often it is followed in its segment, and how often it ends one that is not the last of its text."""
    split = F.split(F.regexp_replace(F.coalesce(trimmed(F.col("text")), F.lit("")), r"\d+", "9"), _NEXT, -1)
    held = corpus.select(split.alias("split")).select((F.size("split") - 1).alias("most"), F.posexplode_outer("split").alias("nth", "segment"))
    segments = held.where("trim(segment) <> ''").groupBy("segment", (F.col("nth") == F.col("most")).alias("closes")).agg(F.count("*").alias("n"))
    made = segments.select("n", "closes", _tokens(F.col("segment")).alias("t")).withColumn("last", F.size("t") - 3)
    made = made.select("n", "closes", "last", F.posexplode_outer(F.expr("arrays_zip(slice(t, 1, last + 1), slice(t, 2, last + 1), slice(t, 3, last + 1))")).alias("at", "x"))
    made = made.where("at < last OR NOT closes").select(_context(F.col("x")["0"], F.col("x")["1"]).alias("context"), F.col("x")["2"].alias("word"), "n", (F.col("at") == F.col("last")).alias("ends"))
    return made.groupBy("context", "word").agg(F.sum(F.when(F.col("ends"), 0).otherwise(F.col("n"))).alias("goes_on"), F.sum(F.when(F.col("ends"), F.col("n")).otherwise(0)).alias("stops"))


def _told(asked: DataFrame, counted: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``asked`` with ``name``: true if its end is almost never terminal, false if it is regular, null if the counts decide neither.

    A word goes on where it is followed or where a longer one begins with it: each counted word counts for its
    beginnings, so all joins are on equal keys.
    """
    finals = asked.where("word IS NOT NULL").groupBy(*keys).agg(F.countDistinct("text").alias("texts"))
    near = counted.join(finals.select(keys[0]).distinct(), keys[0], "left_semi") if len(keys) > 1 else counted
    begun = near.select(*keys[:-1], F.col("word").alias("whole"), "goes_on", "stops", F.explode(F.expr("transform(sequence(1, length(word)), i -> left(word, i))")).alias("word"))
    same = F.col("whole") == F.col("word")
    by = begun.groupBy(*keys).agg(F.sum(F.when(same, F.col("goes_on")).otherwise(F.col("goes_on") + F.col("stops"))).alias("goes_on"), F.sum(F.when(same, F.col("stops")).otherwise(0)).alias("stops"))
    known = finals.join(by, keys, "left").fillna(0, ["goes_on", "stops"])
    stops, n = F.col("stops") + F.col("texts") - 1, F.col("goes_on") + F.col("stops") + F.col("texts") - 1
    known = known.select(*keys, F.when(share_bound(stops, n, 1) <= TERMINAL, True).when(share_bound(stops, n, -1) >= TERMINAL, False).alias(name))
    return asked.join(known, keys, "left")


def judged(corpus: DataFrame) -> DataFrame:
    """Every row with what speaks for a cut: (row_id, source, cut, reason).

    Reasons, the first that holds: ``trigram`` (the final trigram goes on inside texts and is almost
    never terminal), ``word`` (so the last word by itself, where its trigram is too rare to tell),
    ``spans`` (more spans stated than held), ``sign``, ``broken`` (a character, escape or reference is
    incomplete) and ``open`` (no full stop, and an end that is known nowhere else). ``cut`` is never
    null; null and blank texts are not cut unless they lack stated spans. Repeated rows are judged
    each, and equal texts are one text in the counts. An empty table gives no rows.
    """
    asked = cut(final_trigrams(corpus))
    counted = cut(inner_trigrams(corpus))
    told = _told(asked, counted, ["context", "word"], "by_trigram")
    words = counted.groupBy("word").agg(F.sum("goes_on").alias("goes_on"), F.sum("stops").alias("stops"))
    told = _told(told, words, ["word"], "by_word")
    reason = (
        F.when(F.col("by_trigram"), "trigram").when(F.col("by_trigram").isNull() & F.col("by_word"), "word").when(F.col("spans"), "spans").when(F.col("sign"), "sign").when(F.col("broken"), "broken")
        .when(~F.col("stopped") & F.col("by_trigram").isNull() & F.col("by_word").isNull(), "open")
    )
    return told.select("row_id", "source", reason.isNotNull().alias("cut"), reason.alias("reason"))


def truncation_report(corpus: DataFrame) -> DataFrame:
    """Per source, in one spelling: rows, cut rows and their share; a null source is its own line."""
    one = F.regexp_replace(F.lower(F.trim("source")), "[-\\s]+", "_")
    by = judged(corpus).groupBy(one.alias("source"))
    return by.agg(F.count("*").alias("n_rows"), F.count(F.when(F.col("cut"), 1)).alias("n_cut"), F.avg(F.col("cut").cast("double")).alias("share_cut"))
