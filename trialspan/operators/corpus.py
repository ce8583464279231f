"""Corpus building: filters with reasons, budgets, ordered sampling, sentence chunks and marker-aware chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.functions import pandas_udf

from trialspan.functions.text import approx_tokens, sentences, stripped

# Terms that tell texts of the task itself from other tasks.
TASK_KEYS = ["steingroever", "iowa", "igt", "bechara", "gambling"]
TASK_PHRASES = ["iowa gambling", "iowa gambling task", "four decks of cards", "four decks", "deck a", "deck b", "deck c", "deck d"]


def of_task(experiment: Column, text: Column, keys: list[str] = TASK_KEYS, phrases: list[str] = TASK_PHRASES) -> Column:
    """Whether the experiment has a key in it, or the text a phrase; null counts as empty."""

    def any_of(column: Column, terms: list[str]) -> Column:
        low = F.lower(F.coalesce(column, F.lit("")))
        out = F.lit(False)
        for t in terms:
            out = out | F.contains(low, F.lit(t))
        return out

    return any_of(experiment, keys) | any_of(text, phrases)


def reject_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, tried in order; null where none does. A null rule does not hold."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        out = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(out)
    return out


def hash_order(key: Column, salt: str) -> Column:
    """A reproducible order of rows: the hash of their key with a salt."""
    return F.sha2(F.concat_ws("::", key, F.lit(salt)), 256)


def budget_prefix(df: DataFrame, order: Column, key: str, size: Column, cap: int, max_rows: int = 0, buckets: int = 256) -> DataFrame:
    """Rows in order until the running total of ``size`` reaches ``cap``; the row that crosses it is kept.

    ``cap`` 0 means no budget, ``max_rows`` 0 no limit of rows. ``order`` must be a hex hash: its
    first two digits give ``buckets`` ranges whose totals are summed up first, so that no task
    sorts all rows. Ties of the order are decided by the key. Adds ``position`` (from 1) and
    ``total_before``.
    """
    rows = df.withColumn("_order", order).withColumn("_size", F.coalesce(size, F.lit(0)).cast("long")).withColumn("_bucket", F.substring("_order", 1, 2 if buckets == 256 else 1))
    totals = rows.groupBy("_bucket").agg(F.sum("_size").alias("s"), F.count("*").alias("n"))
    up = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select("_bucket", F.coalesce(F.sum("s").over(up), F.lit(0)).alias("_s"), F.coalesce(F.sum("n").over(up), F.lit(0)).alias("_n"))
    if cap > 0:
        before = before.where(F.col("_s") < cap)  # later ranges are never sorted
    inside = W.partitionBy("_bucket").orderBy("_order", key)
    ranked = rows.join(F.broadcast(before), "_bucket")  # at most one row for each bucket
    ranked = ranked.withColumn("position", F.col("_n") + F.row_number().over(inside)).withColumn("total_before", F.col("_s") + F.coalesce(F.sum("_size").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    kept = F.lit(True)
    if cap > 0:
        kept = kept & (F.col("total_before") < cap)
    if max_rows > 0:
        kept = kept & (F.col("position") <= max_rows)
    return ranked.where(kept).drop("_order", "_size", "_bucket", "_s", "_n")


def seeded_positions(n: int, seed: int) -> list[int]:
    """The permutation that Python's generator makes of n positions, for lists short enough for the driver."""
    import random

    out = list(range(n))
    random.Random(seed).shuffle(out)
    return out


def sentence_chunks(df: DataFrame, text: str, least: int = 1200, most: int = 2500) -> DataFrame:
    """Sentences packed to chunks of ``least`` to ``most`` characters: adds ``chunk_idx`` and ``chunk``.

    A chunk is given out when the next sentence would make it longer than ``most``, even if it is
    short then; a sentence longer than ``most`` stands alone; a tail shorter than ``least`` is left out.
    """
    state = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, s: Column) -> Column:
        joined = F.when(acc["open"] == "", s).otherwise(F.concat_ws(" ", acc["open"], s))
        full = (F.length(joined) > most) & (acc["open"] != "")
        after = F.when(full, s).otherwise(joined)
        done = F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        ready = F.length(after) >= least
        return F.struct(F.when(ready, F.lit("")).otherwise(after).alias("open"), F.when(ready, F.concat(done, F.array(after))).otherwise(done).alias("done"))

    packed = F.aggregate(F.filter(sentences(F.coalesce(F.col(text), F.lit(""))), lambda s: s != ""), state, step, lambda acc: acc["done"])
    return df.select(*df.columns, F.posexplode(packed).alias("chunk_idx", "chunk"))


def tokens_of_four(text: str) -> list[tuple[int, int]]:
    """Offsets of runs of at most four characters that are no blanks: the tokenizer where no other is given."""
    return [m.span() for m in re.finditer(r"\S{1,4}", text)]


_ATOM = re.compile(r"<<.*?>>", re.S)


def cut_at_markers(text: str, limit: int, tokenize: Callable[[str], list[tuple[int, int]]] = tokens_of_four) -> list[str]:
    """Chunks of at most ``limit`` tokens whose concatenation is the text; markers are never cut.

    Every atom, a marker or the text between two, is tokenized once. Text that does not fit is
    cut behind the last blank within the room, else behind the last token. A marker with more
    tokens than the limit is a chunk of its own.
    """
    chunks: list[str] = []
    current, used, at = "", 0, 0

    def close() -> None:
        nonlocal current, used
        if current:
            chunks.append(current)
        current, used = "", 0

    for m in [*_ATOM.finditer(text), None]:
        plain = text[at : m.start() if m else len(text)]
        spans = tokenize(plain) if plain else []
        done = first = 0
        while first < len(spans) and len(spans) - first > limit - used:
            room = limit - used
            if room <= 0:
                close()
                continue
            end = spans[first + room - 1][1]
            blank = max(plain.rfind(c, done, end + 1) for c in " \n\t")
            cut = blank + 1 if blank > done else end
            current += plain[done:cut]
            close()
            done = cut
            while first < len(spans) and spans[first][1] <= cut:
                first += 1
        current, used = current + plain[done:], used + len(spans) - first
        if m:
            n = len(tokenize(m.group()))
            if used and used + n > limit:
                close()
            current, used = current + m.group(), used + n
            at = m.end()
    close()
    return chunks


def marker_chunks(df: DataFrame, text: str, limit: int = 8192, tokenize: Callable[[str], list[tuple[int, int]]] = tokens_of_four, safety: int = 64) -> DataFrame:
    """``df`` with ``chunk_idx``, ``n_chunks``, ``chunk``, ``chunk_tokens`` and ``preserved`` (whether the chunks joined are the text) of each text; null texts have no chunk.

    ``safety`` tokens are kept free, as a chunk may have more tokens than its atoms.
    """

    def chunks_of(t: str | None) -> list[dict]:
        found = [] if t is None else cut_at_markers(t, limit - safety, tokenize)
        same = "".join(found) == t
        return [{"chunk": c, "chunk_tokens": len(tokenize(c)), "preserved": same} for c in found]

    @pandas_udf("array<struct<chunk:string,chunk_tokens:int,preserved:boolean>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(chunks_of)

    parts = df.withColumn("_parts", cut(F.col(text)))
    out = parts.select(*df.columns, F.size("_parts").alias("n_chunks"), F.posexplode("_parts").alias("chunk_idx", "_part"))
    return out.select(*df.columns, "chunk_idx", "n_chunks", "_part.chunk", "_part.chunk_tokens", "_part.preserved")


def chunk_audit(chunks: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """One row of checks: texts preserved, sizes kept, characters lost, texts and chunks without markers."""
    by = chunks.groupBy(key).agg(F.bool_and("preserved").alias("same"), F.max("chunk_tokens").alias("most"), F.sum(F.length("chunk")).alias("kept"), F.first(F.length(text)).alias("given"), F.count(F.when(~F.contains("chunk", F.lit("<<")), 1)).alias("bare"), F.count("*").alias("n"))
    ok = by.agg(
        F.count("*").alias("n_texts"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"), F.coalesce(F.bool_and("same"), F.lit(False)).alias("preserved"),
        F.coalesce(F.max("most"), F.lit(0)).alias("most_tokens"), F.coalesce(F.sum("given") - F.sum("kept"), F.lit(0)).alias("n_lost"), F.coalesce(F.sum("bare"), F.lit(0)).alias("n_chunks_without_marker"),
    )
    return ok.withColumn("within_limit", F.col("most_tokens") <= limit)


def wrapped(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix), F.lit("<<"), text, F.lit(">>"))


def corpus_records(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Records with a zero-padded id by order of the key column ``position``, and their token estimate."""
    return df.select(F.format_string(f"{prefix}_%06d", F.col("position")).alias("prompt_id"), "experiment", F.col(text).alias("text"), approx_tokens(F.col(text)).alias("n_tokens_approx"))


def blank(text: Column) -> Column:
    return F.coalesce(stripped(text) == "", F.lit(True))


NOISE_TEMPLATES = ("You choose <<{0}>> and get {1} points.", "Option <<{0}>> pays {1}.", "You press <<{0}>>. The result is {1}.", "Round: <<{0}>>, reward {1}.", "Selecting <<{0}>> yields {1}.")


def noise_prompts(spark, n_prompts: int, n_trials: int = 50, seed: int = 0, partitions: int = 8) -> DataFrame:
    """Synthetic prompts with random choices and rewards; each row has its own random stream, so any number of tasks gives the same rows."""

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import random

        for frame in frames:
            texts = []
            for i in frame["id"]:
                rng = random.Random(f"{seed}:{i}")
                keys = rng.sample("ABCDEFGHIJKLMNOPQRSTUVWXYZ", rng.randint(2, 4))
                template = rng.choice(NOISE_TEMPLATES)
                texts.append("\n".join(template.format(rng.choice(keys), rng.choice((-100, -50, -10, 0, 10, 50, 100, 250))) for _ in range(n_trials)))
            yield pd.DataFrame({"prompt_id": [f"noise_{i:06d}" for i in frame["id"]], "text": texts})

    return spark.range(0, n_prompts, 1, partitions).mapInPandas(make, "prompt_id string, text string")
