"""Exact token counts under an existing byte-level BPE vocabulary, and token budgets.

Method: prefix tries of distinct pieces. A text splits into pieces by the vocabulary's pattern, and
pieces are encoded apart from each other. Each task keeps the distinct pieces of its partition; new
ones are walked in sorted order, which is the depth-first order of their prefix trie, and the exact
state of the encoding (last token and number of tokens of every prefix) is carried along shared
prefixes. The counts at the ends are joined back to the documents of the partition. No piece is
shuffled, so the work is one pass over the text at any size.
"""

from __future__ import annotations

import base64
import os
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: the vocabulary file: a base64 token and its rank on each line. The path must exist on all executors.
VOCABULARY = os.environ.get("TRIALSPAN_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: distinct pieces that a task keeps; beyond, it forgets them and starts anew
KEPT_PIECES = 1_000_000

# Fixed value: the public pattern of pieces of the byte-level vocabulary, with letters as L and numbers as N;
# words and numbers come first, as no other alternative can begin where they do.
PIECES = r" ?L+| ?N+|'(?:[sdmt]|ll|ve|re)| ?[^\sLN]+|\s+(?!\S)|\s+"


def _class(kind: str) -> str:
    """The characters of a general category as ranges of a character class."""
    out, start = [], -1
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == kind
        if inside and start < 0:
            start = c
        elif not inside and start >= 0:
            out.append(re.escape(chr(start)) if c == start + 1 else f"{re.escape(chr(start))}-{re.escape(chr(c - 1))}")
            start = -1
    return "".join(out)


def piece_splitter() -> re.Pattern[str]:
    letters, numbers = _class("L"), _class("N")
    # blanks as Unicode has them; the information separators are no blanks there
    space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    return re.compile(PIECES.replace(r"[^\sLN]", f"[^{space}{letters}{numbers}]").replace("L+", f"[{letters}]+").replace("N+", f"[{numbers}]+").replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]"))


class PrefixEncoder:
    """Exact numbers of tokens of byte strings under ranked merges, with states carried along shared prefixes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        self.words = {r: w for w, r in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.seen = b""
        self.last: list[int] = [-1]
        self.count: list[int] = [0]

    def _merged(self, word: bytes, below: int) -> list[int]:
        """Tokens of ``word`` when only merges of a rank under ``below`` are done."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def split_of(self, token: int) -> tuple[int, int]:
        """The two tokens that the last merge of ``token`` joins; a single byte is its own half twice."""
        known = self.halves.get(token)
        if known is None:
            word = self.words[token]
            parts = [token] if len(word) == 1 else self._merged(word, token)
            known = self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else (token, token) if len(parts) == 1 else (-1, -1)
        return known

    def adjoin(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, stay as they are: no merge across their border comes first.

        The border is undone merge by merge, the later of the two first; at each step the tokens
        at the border must not merge before the token that was taken apart came to be.
        """
        pair = (left, right)
        known = self.fits.get(pair)
        if known is not None:
            return known
        words, ranks = self.words, self.ranks
        bound, stays = 1 << 60, True
        while True:
            joined = ranks.get(words[left] + words[right])
            if joined is not None and joined < bound and self.split_of(joined) == (left, right):
                stays = False
                break
            by_left = left > right
            if by_left:
                bound, inner = left, self.split_of(left)[1]
                by_left = inner != left
            if by_left:
                left = inner
                continue
            inner = self.split_of(right)[0]
            if inner != right:
                bound, right = right + 1, inner
                continue
            inner = self.split_of(left)[1]
            if inner == left:
                break
            bound, left = left, inner
        self.fits[pair] = stays
        return stays

    def tokens_in(self, word: bytes) -> int:
        """Number of tokens of ``word``; states of the prefix shared with the word before are kept."""
        same = 0
        for a, b in zip(self.seen, word, strict=False):
            if a != b:
                break
            same += 1
        del self.last[same + 1 :], self.count[same + 1 :]
        last, count, ranks = self.last, self.count, self.ranks
        for i in range(same + 1, len(word) + 1):
            for j in range(max(0, i - self.longest), i):
                token = ranks.get(word[j:i])
                if token is None or self.split_of(token)[0] < 0:
                    continue
                if j == 0 or self.adjoin(last[j], token):
                    last.append(token)
                    count.append(count[j] + 1)
                    break
        self.seen = word
        return count[-1]


#: a line end between two characters that are no blanks: a piece of its own
_LINE_END = re.compile(r"\n(?<=\S\n)(?=\S)")
#: lines up to this length are remembered with their counts
_SHORT_LINE = 120


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines) if rank}


_HELD: dict[str, tuple[re.Pattern[str], PrefixEncoder]] = {}


class PieceCounts:
    """Token counts of texts, by the distinct pieces of all texts that it has been given."""

    def __init__(self, path: str) -> None:
        if path not in _HELD:
            _HELD[path] = (piece_splitter(), PrefixEncoder(read_ranks(path)))
        splitter, self.encoder = _HELD[path]
        self.split = splitter.findall
        self.known: dict[str, int] = {}
        self.lines: dict[str, int] = {}

    def counts(self, texts: Iterable[str | None]) -> list[int]:
        """Tokens of each text; null and empty texts have none."""
        if len(self.known) > KEPT_PIECES:
            self.known.clear()
        if len(self.lines) > KEPT_PIECES:
            self.lines.clear()
        texts = [_LINE_END.split(t) if t else [] for t in texts]
        lines = set().union(*texts).difference(self.lines) if texts else set()
        parts = {line: self.split(line) for line in lines}
        fresh = {"\n"}.union(*parts.values()).difference(self.known)
        for piece in sorted(p.encode("utf-8", "replace") for p in fresh):
            self.known[piece.decode("utf-8")] = self.encoder.tokens_in(piece)
        tokens = self.known.__getitem__
        counts = {line: sum(map(tokens, p)) for line, p in parts.items()}
        self.lines.update((line, n) for line, n in counts.items() if len(line) <= _SHORT_LINE)
        short, end = self.lines, tokens("\n")

        def of(line: str) -> int:
            return counts[line] if line in counts else short[line]

        return [sum(map(of, t)) + end * (len(t) - 1) if t else 0 for t in texts]


def with_tokens(df: DataFrame, text: str = "text", name: str = "n_tokens_exact", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` without its text column, with the number of tokens of each text as ``name``.

    Null and empty texts have 0 tokens; a column that was already called ``name`` is replaced.
    """
    kept = [c for c in df.columns if c not in (text, name)]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[f"`{c}`" for c in kept]).schema)
    wanted = [*kept, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounts(vocabulary)
        for batch in batches:
            n = batch.num_columns - 1
            counts = pa.array(counter.counts(batch.column(n).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n)], counts], names=wanted)

    return df.select(*[f"`{c}`" for c in kept], F.col(text)).mapInArrow(run, f"{fields}, `{name}` long" if fields else f"`{name}` long")


def one_spelling(name: Column) -> Column:
    """A source or experiment in one spelling: lower case, parts joined by ``_``; blank is null."""
    plain = F.regexp_replace(F.lower(F.trim(name)), r"[-\s]+", "_")
    return F.when(plain != "", plain)


def language(tag: Column) -> Column:
    """The two letters of a language tag; blank, unknown and other values are null."""
    code = F.lower(F.regexp_extract(F.trim(tag), r"^([A-Za-z]{2})(?:[-_].*)?$", 1))
    return F.when(code != "", code)


def token_counts(corpus: DataFrame, documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each corpus record and document with its exact number of tokens.

    Columns: origin, record_id, source, lang, domain, experiment, n_chars, n_tokens_exact. A corpus
    record that was delivered several times (one ``prompt_id``) is its latest delivery, of ties
    the one with the greatest ``row_id``; records without a ``prompt_id`` stand for themselves.
    The deliveries are told apart on narrow columns, before the texts are read again by key.
    """
    order = W.partitionBy(F.coalesce("prompt_id", F.concat(F.lit("row:"), F.col("row_id").cast("string")))).orderBy(F.col("loaded_at").desc_nulls_last(), F.col("row_id").desc())
    latest = corpus.select("row_id", "prompt_id", "loaded_at").withColumn("nth", F.row_number().over(order)).where("nth = 1").select("row_id")
    common = [one_spelling(F.col("source")).alias("source"), language(F.col("lang")).alias("lang")]
    from_corpus = corpus.select(
        F.lit("corpus").alias("origin"), F.col("row_id").alias("record_id"), *common, one_spelling(F.col("task_domain")).alias("domain"),
        one_spelling(F.col("experiment")).alias("experiment"), F.length("text").cast("long").alias("n_chars"), "text",
    )
    from_documents = documents.select(
        F.lit("documents").alias("origin"), F.col("doc_id").alias("record_id"), *common, one_spelling(F.col("topic")).alias("domain"),
        one_spelling(F.col("experiment")).alias("experiment"), F.length("text").cast("long").alias("n_chars"), "text",
    )
    counted = with_tokens(from_corpus, vocabulary=vocabulary).join(latest.withColumnRenamed("row_id", "record_id"), "record_id", "left_semi")
    return counted.select("origin", "record_id", "source", "lang", "domain", "experiment", "n_chars", "n_tokens_exact").union(
        with_tokens(from_documents, vocabulary=vocabulary).select("origin", "record_id", "source", "lang", "domain", "experiment", "n_chars", "n_tokens_exact")
    )


def answer_tokens(session_nll: DataFrame) -> DataFrame:
    """Answer tokens by experiment and model, of the latest score of each model and session.

    Ties of ``scored_at`` are decided by the greater count; null counts add nothing.
    """
    latest = session_nll.groupBy("model", "prompt_id").agg(F.max(F.struct("scored_at", "n_answer_tokens", one_spelling(F.col("experiment")).alias("experiment"))).alias("last"))
    by = latest.select("model", "last.*").groupBy("experiment", "model")
    return by.agg(F.count("*").alias("n_sessions"), F.coalesce(F.sum("n_answer_tokens"), F.lit(0)).alias("n_answer_tokens"))


def token_budget(corpus: DataFrame, documents: DataFrame, session_nll: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Records, characters and tokens by origin, source, language, domain and experiment.

    Missing values are groups of their own. ``answer_tokens`` has, next to them, the answer tokens
    of the group's experiment by model; it is null where the experiment has no scores.
    """
    by = token_counts(corpus, documents, vocabulary).groupBy("origin", "source", "lang", "domain", "experiment")
    text = by.agg(F.count("*").alias("n_records"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("n_chars"), F.sum("n_tokens_exact").alias("n_tokens"))
    models = answer_tokens(session_nll).where("experiment IS NOT NULL AND model IS NOT NULL").groupBy("experiment")
    models = models.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("model", "n_answer_tokens")))).alias("answer_tokens"))
    return text.join(models, "experiment", "left").select("origin", "source", "lang", "domain", "experiment", "n_records", "n_chars", "n_tokens", "answer_tokens")
