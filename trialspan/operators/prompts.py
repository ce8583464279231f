"""Prompts of sessions: deck labels, rendered texts, spans with offsets, and texts cut for prediction."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

DECKS = ("A", "B", "C", "D")
# The letters that decks are labelled with, the alphabet without I, O and S.
LABELS = "ABCDEFGHJKLMNPQRTUVWXYZ"


def label_list(deck_map: Column) -> Column:
    """Four labels in the order of the decks, from either shape of the stored map; null where there are not four."""
    by_name = F.from_json(deck_map, "map<string,string>")
    listed = F.from_json(deck_map, "deck_labels_in_order array<string>")["deck_labels_in_order"]
    named = F.filter(F.array(*[F.element_at(by_name, d) for d in DECKS]), lambda x: x.isNotNull())
    return F.when(F.size(listed) == 4, listed).when(F.size(named) == 4, named)


def hashed_labels(subject: Column) -> Column:
    """Four letters for a subject: those whose hash with the subject's id comes first. Any SQL engine can repeat it."""
    pool = F.array(*[F.struct(F.sha2(F.concat(subject, F.lit("|" + c)), 256).alias("h"), F.lit(c).alias("c")) for c in LABELS])
    return F.transform(F.slice(F.array_sort(pool), 1, 4), lambda s: s["c"])


@pandas_udf(T.ArrayType(T.StringType()))
def seeded_labels(subjects: pd.Series) -> pd.Series:
    """Four letters drawn by Python's generator, seeded with the hash of the subject's id; null for a null id."""
    import hashlib
    import random

    def draw(s: str | None) -> list[str] | None:
        return None if s is None else random.Random(int(hashlib.sha256(s.encode()).hexdigest()[:16], 16)).sample(LABELS, 4)

    return subjects.map(draw)


def rendered(trials: Column, labels: Column, currency: str = " points") -> Column:
    """One line for each trial, amounts with one decimal; a deck without a label is ``?``."""

    def line(t: Column) -> Column:
        at = F.array_position(F.array(*[F.lit(d) for d in DECKS]), t["deck"]).cast("int")
        label = F.coalesce(F.when(at > 0, F.element_at(labels, F.greatest(at, F.lit(1)))), F.lit("?"))
        amount = [F.format_string("%.1f", F.coalesce(x, F.lit(0.0))) for x in (t["gain"], F.abs(t["loss"]))]
        return F.concat(F.lit("You press <<"), label, F.lit(">>. You win "), amount[0], F.lit(currency), F.lit(" and lose "), amount[1], F.lit(currency), F.lit("."))

    return F.array_join(F.transform(F.coalesce(trials, F.array().cast("array<struct<deck:string,gain:double,loss:double>>")), line), "\n")


# The sentences before the trials of a prompt, and the sentence of a trial in ``rendered``.
PREAMBLE = (
    "You see in front of you four decks of cards labeled {labels}.\n"
    "You get a loan of {loan}{currency} of play money.\n"
    "You have to select one card at a time, from any of the four decks, for {n_trials} trials.\n"
    "You select a card from a deck by pressing the corresponding key.\n"
    "After turning a card, you win some money, the amount varies with the deck.\n"
    "You sometimes also have to pay a penalty, which also varies with the deck.\n"
    "Your goal is to maximize profit on the loan of the play money.\n"
    "\n"
)


def full_prompt(trials: Column, labels: Column, loan: int, n_trials: Column, currency: str) -> Column:
    """The preamble, with the labels, the loan and the number of trials, and a line for each trial; null where there are no labels."""
    listed = F.concat(F.array_join(F.slice(labels, 1, 3), ", "), F.lit(", and "), F.element_at(labels, 4))
    head, rest = PREAMBLE.replace("{loan}", str(loan)).replace("{currency}", currency).split("{labels}")
    before, after = rest.split("{n_trials}")
    count = F.coalesce(n_trials, F.size(trials), F.lit(0)).cast("string")
    return F.when(labels.isNotNull(), F.concat(F.lit(head), listed, F.lit(before), count, F.lit(after), rendered(trials, labels, currency)))


_SPAN = re.compile(r"<<\s*(.*?)\s*>>", re.S)
_SPANS = T.ArrayType(T.StructType([T.StructField("trial_index", T.IntegerType()), T.StructField("target_text", T.StringType()), T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType())]))


@pandas_udf(_SPANS)
def spans(texts: pd.Series) -> pd.Series:
    """Trial spans with the offsets of their content, blanks at its ends left out."""
    return texts.map(lambda t: [] if t is None else [{"trial_index": i, "target_text": m[1], "start_char": m.start(1), "end_char": m.end(1)} for i, m in enumerate(_SPAN.finditer(t))])


@pandas_udf(_SPANS)
def scanned_spans(texts: pd.Series) -> pd.Series:
    """Spans as found by searching marker after marker, their content untouched; an unclosed marker ends the search."""

    def scan(t: str | None) -> list[dict]:
        out, at = [], 0
        while t and (a := t.find("<<", at)) >= 0 and (b := t.find(">>", a + 2)) >= 0:
            out.append({"trial_index": len(out), "target_text": t[a + 2 : b], "start_char": a + 2, "end_char": b})
            at = b + 2
        return out

    return texts.map(scan)


def prediction_prompt(text: Column) -> Column:
    """The text up to the last closed marker, which is left open; null where there is none."""
    head = F.regexp_extract(text, r"(?s)^(.*)<<[^\n]*?>>", 1)
    return F.when(text.rlike(r"<<[^\n]*?>>"), F.concat(head, F.lit("<<")))


def last_choice(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"<<[ \t]*([^\n]*?)[ \t]*>>"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def tail_of_choices(text: Column, most: int) -> Column:
    """The lines before the first choice, a note of how many choices are left out, and the last ``most`` lines with choices."""
    lines = F.split(text, "\n")
    chosen = F.filter(lines, lambda x: F.contains(x, F.lit("<<")))
    first = F.array_position(F.transform(lines, lambda x: F.contains(x, F.lit("<<"))), True).cast("int")
    head = F.slice(lines, 1, F.greatest(first - 1, F.lit(0)))
    left_out = F.size(chosen) - most
    note = F.array(F.concat(F.lit("["), left_out.cast("string"), F.lit(" earlier choices omitted]")))
    tail = F.slice(chosen, F.greatest(left_out, F.lit(0)) + 1, most)
    return F.when(left_out <= 0, text).otherwise(F.array_join(F.concat(head, note, tail), "\n"))


def requests(prompts: DataFrame, text: str = "text") -> DataFrame:
    """Request payloads for an inference service: one struct for each prompt that has a choice to predict."""
    masked = prediction_prompt(F.col(text))
    return prompts.where(masked.isNotNull()).select("prompt_id", F.struct(F.col("prompt_id").alias("id"), masked.alias("inputs"), F.struct(F.lit(1).alias("max_new_tokens"), F.lit(True).alias("return_logprobs")).alias("parameters")).alias("request"), last_choice(F.col(text)).alias("target"))
