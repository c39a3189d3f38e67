"""Sizes of texts in tokens of a public tokenizer.

The vocabulary is a file of byte-level BPE ranks whose path is a parameter.
Its word pattern never lets a token cross from a non-blank into the blank after
it, so a text's count is the sum of its words' counts.  A batch's words are made
distinct column-wise; each distinct word is encoded once.
"""

from __future__ import annotations

import base64
import importlib.util
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: The usual split pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PIECE = re.compile(r" ?\S+|\s+(?!\S)|\s")
#: Blanks next to a space, where words depend on their neighbours; and separators that the two pattern languages take differently.
_ODD = r"  |[\t\n\v\f\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] |\s $| \s|[\x1c-\x1f]"
#: Distinct words kept between batches of a task.
CACHE = 400_000


def default_vocabulary() -> str:
    """The file of the installed package of public vocabularies, where there is one; else a path must be given."""
    spec = importlib.util.find_spec("public_tokenizers")
    if spec is None or not spec.origin:
        raise ValueError("give the path of a vocabulary")
    return os.path.join(os.path.dirname(spec.origin), "byte_bpe_50k.tiktoken")


class Counter:
    """Counts tokens of the vocabulary at ``path``."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def whole(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def word(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            if "\n" in word or "\r" in word:
                n = sum(map(self.piece, _PIECE.findall(word)))
            else:
                n = self.whole(word)
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[word] = n
        return n

    def piece(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = self.known[piece] = self.whole(piece)
        return n

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; 0 of a null."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        out = np.zeros(len(texts), np.int64)
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(odd):
            out[i] = self.whole(texts[i].as_py())
        at = np.flatnonzero(~odd)
        if len(at):
            words = pc.split_pattern(texts.take(pa.array(at)), " ")
            sizes = pc.list_value_length(words).to_numpy()
            flat = pc.list_flatten(words).dictionary_encode()
            distinct = flat.dictionary.to_pylist()
            index = flat.indices.to_numpy()
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            first = np.zeros(len(index), bool)
            first[starts] = True  # a text's first word has no blank before it
            spaced = np.fromiter((self.word(" " + w) for w in distinct), np.int64, len(distinct))
            n = spaced[index]
            n[first] = [self.word(distinct[j]) if distinct[j] else 0 for j in index[first]]
            out[at] = np.add.reduceat(n, starts)
        return out


def token_counts(docs: DataFrame, keys: list[str], text: str = "text", vocabulary: str | None = None, out: str = "tokens") -> DataFrame:
    """The ``keys`` columns and ``out``, the number of tokens of the whole ``text``; 0 for a null or empty one."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for b in batches:
            counter = counter or Counter(path)
            n = counter.counts(b.column(len(keys)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(n)], names=[*keys, out])

    picked = docs.select(*keys, text)
    schema = ", ".join(f"`{k}` {picked.schema[k].dataType.simpleString()}" for k in keys)
    small_batches(docs.sparkSession)
    return picked.mapInArrow(run, f"{schema}, `{out}` long")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the rows of a batch handed to Python, as texts may be long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
