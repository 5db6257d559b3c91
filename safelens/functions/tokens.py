"""Subword tokens of public vocabularies: counts, cuts, and the texts that a model reads. Vocabularies are read, never trained."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: how the public rank files split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KINDS = {".json": "tokenizers", ".tiktoken": "tiktoken", ".model": "sentencepiece"}


class SubwordTokenizer:
    """A vocabulary file and the library that reads it, by suffix: ``.json``, ``.tiktoken`` or ``.model``.

    The driver reads the file; workers get its bytes by value and build the encoder once, so executors need no copy of the file.
    ``special`` tokens are those that a model puts around every text: they count, and a cut leaves room for them.
    """

    def __init__(self, path: str | Path, pattern: str = PATTERN, special: int = 0) -> None:
        if Path(path).suffix not in KINDS:
            raise ValueError(f"no tokenizer reads {path}")
        self.kind, self.data, self.pattern, self.special = KINDS[Path(path).suffix], Path(path).read_bytes(), pattern, special

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_built"}

    @property
    def encoder(self):
        if "_built" not in self.__dict__:
            if self.kind == "tokenizers":
                import tokenizers

                self._built = tokenizers.Tokenizer.from_str(self.data.decode())
                self._built.encode_special_tokens = True  # their strings in a text are ordinary text
            elif self.kind == "tiktoken":
                import tiktoken

                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in self.data.splitlines() if line)}
                self._built = tiktoken.Encoding("file", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
            else:
                import sentencepiece

                self._built = sentencepiece.SentencePieceProcessor(model_proto=self.data)
        return self._built

    def encode(self, texts: Iterable[str]) -> list[list[int]]:
        texts = list(texts)
        if self.kind == "tokenizers":
            return [e.ids for e in self.encoder.encode_batch(texts, add_special_tokens=False)]
        if self.kind == "tiktoken":
            return [self.encoder.encode_ordinary(t) for t in texts]
        return self.encoder.encode(texts, num_threads=1)

    def prefix(self, text: str, ids: list[int], most: int) -> str:
        """The begin of a text that its first tokens stand for; a character of which only some bytes are among them is left out."""
        if most == 0:
            return ""
        if self.kind == "tokenizers":
            return text[: self.encoder.encode(text, add_special_tokens=False).offsets[most - 1][1]]
        if self.kind == "tiktoken":
            return self.encoder.decode_bytes(ids[:most]).decode("utf-8", "ignore")
        return text.encode()[: self.encoder.encode(text, return_type="proto").pieces[most - 1].end].decode("utf-8", "ignore")

    def cut(self, text: str, most: int | None) -> tuple[str, int]:
        """(the text that a model of ``most`` tokens reads, its tokens with the special ones)."""
        return self.cut_all([text], most)[0]

    def cut_all(self, texts: Iterable[str], most: int | None) -> list[tuple[str, int]]:
        texts = list(texts)
        room = None if most is None else max(0, most - self.special)
        return [(t, len(ids) + self.special) if room is None or len(ids) <= room else (self.prefix(t, ids, room), room + self.special) for t, ids in zip(texts, self.encode(texts), strict=True)]


def token_counts(text: Column, tokenizer: SubwordTokenizer, max_length: int | None = None) -> Column:
    """Tokens that a model reads of each text, at most ``max_length``; null for null."""

    @F.pandas_udf("int")
    def count(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in frames:
            there = [i for i, t in enumerate(texts) if t is not None]
            out: list[int | None] = [None] * len(texts)
            for i, ids in zip(there, tokenizer.encode(texts.iloc[there]), strict=True):
                out[i] = len(ids) + tokenizer.special if max_length is None else min(max_length, len(ids) + tokenizer.special)
            yield pd.Series(out, dtype="Int32")

    return count(text)


class TokenReader:
    """A model of texts that reads, and is measured by, subword tokens: what ``ArrowScorer`` wants of a model."""

    def __init__(self, model: Callable[[list[str]], list[dict[str, float]]], tokenizer: SubwordTokenizer) -> None:
        self.model, self.cut_all = model, tokenizer.cut_all

    def __call__(self, texts: list[str]) -> list[dict[str, float]]:
        return self.model(texts)
