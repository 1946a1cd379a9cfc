"""Operator 1: token counts by heap-and-linked-list byte-pair merging.

``count_tokens`` adds the number of tokens that the library of a piece vocabulary (a ``.model`` file) gives a text,
without ever forming identifiers: a word's count is its initial symbols (a character outside the vocabulary counts
one symbol for each UTF-8 byte) minus the merges the queue performs.

Texts divide exactly where no vocabulary piece can cross: before a run of spaces, and around characters that occur in
no piece of more than one character. Counts of words are kept in a bounded table in each worker.

Defined results: null and empty texts have 0 bytes and 0 tokens; every row, repeated or not, gives one row; columns of
the input that clash with the output's names are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import ship, table

from .merge_queue import Kept, merge_spans

SPACE = "▁"
KEPT_WORDS = 600_000
BLOCK = 200_000
_COUNTERS: dict = {}


def load_pieces(path: str) -> dict[str, int]:
    """piece -> merge rank (0 best; equal scores share a rank) of a sentencepiece BPE model with byte fallback."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    scores = sorted({sp.get_score(i) for i in own}, reverse=True)
    rank = {s: k for k, s in enumerate(scores)}
    pieces = {sp.id_to_piece(i): rank[sp.get_score(i)] for i in own}
    if sp.normalize("a  ﬁ①\tb ") != SPACE + "a  ﬁ①\tb ".replace(" ", SPACE):
        raise ValueError("only models with the identity normaliser and a leading space are supported")
    if any(SPACE in p.lstrip(SPACE) or (p.startswith(SPACE * 2) and p.strip(SPACE)) for p in pieces):
        raise ValueError("a piece holds an inner space: texts can't be divided at spaces")
    return pieces


class PieceCounter:
    """Counts tokens of texts; one in each worker for each vocabulary."""

    def __init__(self, pieces: dict[str, int]):
        self.ranks = {p: r for p, r in pieces.items() if len(p) > 1}
        self.single = {p for p in pieces if len(p) == 1}
        self.pairs = {p[i : i + 2] for p in self.ranks for i in range(len(p) - 1)}
        joined = set().union(*self.ranks)
        cut = "".join(c for c in "\n\t\r" if c not in joined)
        self.words = re.compile(f"[ {SPACE}]+[^ {SPACE}{cut}]*|[^ {SPACE}{cut}]+" + (f"|[{cut}]" if cut else ""))
        self.kept = Kept(KEPT_WORDS)
        self.stems = Kept(KEPT_WORDS)

    def symbols(self, word: str) -> int:
        """Initial symbols: one a character, or one a byte where the character is no piece."""
        return sum(1 if c in self.single else len(c.encode()) for c in word)

    def of_stems(self, words: list[str]) -> dict[str, int]:
        single = self.single
        return {w: merge_spans(w, self.ranks)[1] + (0 if single.issuperset(w) else self.symbols(w) - len(w)) for w in words}

    def of_words(self, words: list[str]) -> dict[str, int]:
        """A last character that no piece joins to the one before counts by itself, so words share their stems."""
        stems, pairs = {}, self.pairs
        for w in words:
            x = w.replace(" ", SPACE)
            stems[w] = (x[:-1], x[-1]) if len(x) > 1 and x[-2:] not in pairs else (x, "")
        counts = self.stems.fill((x for x, _ in stems.values()), self.of_stems)
        return {w: counts[x] + (self.symbols(y) if y else 0) for w, (x, y) in stems.items()}

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = " " + text  # the library puts one space before a text
        words = (m.group() for m in self.words.finditer(text)) if len(text) > 1_000_000 else iter(self.words.findall(text))
        total = 0
        while block := list(itertools.islice(words, BLOCK)):
            total += sum(map(self.kept.fill(block, self.of_words).__getitem__, block))
        return total


def _counter(key: str, pieces) -> PieceCounter:
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = PieceCounter(pieces())
    return _COUNTERS[key]


def count_tokens(df: DataFrame, model_path: str, text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``df`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of ``text_col``.

    The vocabulary (tens of thousands of pieces, fixed by the model) is read on the driver and broadcast.
    """
    ship(df.sparkSession)
    pieces = df.sparkSession.sparkContext.broadcast(load_pieces(model_path))

    @F.pandas_udf("long")
    def tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(model_path, lambda: pieces.value)
        for part in texts:
            yield pd.Series([counter.count(t) for t in part], dtype="int64")

    own = {"n_bytes", "n_tokens", "over_limit"}
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        df.select(F.struct(F.lit(0).alias("__"), *[c for c in df.columns if c not in own]).alias("__doc"), F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias("__n"))
        .select(
            *[F.col("__doc")[c].alias(c) for c in df.columns if c not in own],
            "n_bytes",
            F.col("__n").alias("n_tokens"),
            (F.col("__n") > limit).alias("over_limit"),
        )
    )


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


QUERIES = {"op1_token_counts": op1_token_counts}
SQL: dict[str, str] = {}
