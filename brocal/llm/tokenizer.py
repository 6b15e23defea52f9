"""Encoding with a byte-level BPE vocabulary, exact to its merges, in linear time."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brocal.session import ship

#: How the vocabulary's own tokenizer cuts text before merging (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that an encoder remembers, and token pairs.
WORDS, PAIRS = 300_000, 2_000_000
#: Rows that are encoded at a time.
ROWS = 500


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in the vocabulary's file: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> tuple[dict[str, int], list[tuple[int, int, int]]]:
    """Tokens as Latin-1 strings of their bytes, with ids; merges as (left, right, merged) ids, first first."""
    model = json.loads(Path(path).read_text())["model"]
    letters = byte_letters()
    table = {ord(k): chr(v) for k, v in letters.items()}
    ids = model["vocab"]
    tokens = {t.translate(table): i for t, i in ids.items() if all(c in letters for c in t)}
    merges = []
    for m in model["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        merges.append((ids[a], ids[b], ids[a + b]))
    return tokens, merges


class Encoder:
    """Exact merges without merging.

    A tokenization is the one that merging gives if and only if each pair of
    adjacent tokens is one that merging leaves apart.  So the text is walked
    from the left with the longest token that fits, tried shorter or taken
    back where it is not compatible with its neighbour.  Every position is
    left at most once for good, so the walk is linear in the text.  Finding
    the longest tokens costs a step for each token that ends at a byte, of
    which there are no more than the longest token has bytes.
    """

    def __init__(self, tokens: dict[str, int], merges: list[tuple[int, int, int]], words: int = WORDS, pairs: int = PAIRS):
        self.tokens = tokens
        self.text = {i: t for t, i in tokens.items()}
        self.rank: dict[int, int] = {}  # position of the merge that makes a token; bytes before all
        self.merged: dict[tuple[int, int], int] = {}  # position of the merge of two tokens
        self.halves: dict[int, tuple[int, int]] = {}
        for at, (a, b, c) in enumerate(merges):
            self.merged.setdefault((a, b), at)
            if c not in self.halves:
                self.halves[c] = (a, b)
                self.rank[c] = at
        self.automaton = ahocorasick.Automaton()
        for t, i in tokens.items():
            if len(t) == 1 or i in self.halves:
                self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.cut = regex.compile(PATTERN)
        self.words: dict[str, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.most_words, self.most_pairs = words, pairs
        self.shorter: dict[int, int | None] = {}

    def prefix(self, token: int) -> int | None:
        """The longest token that is a proper beginning of this one."""
        if token not in self.shorter:
            t = self.text[token]
            self.shorter[token] = next((i for n in range(len(t) - 1, 0, -1) if (i := self.tokens.get(t[:n])) is not None and (n == 1 or i in self.halves)), None)
        return self.shorter[token]

    def apart(self, a: int, b: int) -> bool:
        """Whether merging leaves the adjacent tokens apart."""
        key = (a, b)
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            got = self.pairs[key] = self._apart(a, b)
        return got

    def _apart(self, a: int, b: int) -> bool:
        # undo the merges inside both tokens, the latest first; the pieces that touch must not
        # have been merged with each other before the merge that is being undone
        end = len(self.merged) + 1
        bound = end
        while True:
            at = self.merged.get((a, b))
            if at is not None and at < bound:
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                # on the left, the merge inside a comes first among merges of one rank
                bound, a = ra, self.halves[a][1]
            else:
                bound, b = rb + 1, self.halves[b][0]

    def word(self, piece: str) -> list[int]:
        """Ids of one piece of text that merges don't leave."""
        t = piece.encode("utf-8").decode("latin-1")
        whole = self.tokens.get(t)
        n = len(t)
        longest = [0] * n
        for end, (token, size) in self.automaton.iter(t):
            longest[end - size + 1] = token
        if whole is not None and longest[0] == whole and n <= 1:
            return [whole]
        dead = bytearray(n + 1)
        out: list[int] = []
        at = 0
        token: int | None = longest[0]
        while at < n:
            last = out[-1] if out else None
            while token is not None:
                end = at + len(self.text[token])
                if not dead[end] and (last is None or self.apart(last, token)):
                    break
                token = self.prefix(token)
            if token is None:
                dead[at] = 1
                token = out.pop()
                at -= len(self.text[token])
                token = self.prefix(token)
            else:
                out.append(token)
                at += len(self.text[token])
                token = longest[at] if at < n else None
        return out

    def encode(self, text: str) -> list[int]:
        words = self.words
        out: list[int] = []
        for piece in self.cut.findall(text):
            ids = words.get(piece)
            if ids is None:
                ids = self.word(piece)
                if len(piece) <= 64:
                    if len(words) >= self.most_words:
                        words.clear()
                    words[piece] = ids
            out += ids
        return out


class _Encode:
    """Encodes the column `text`; gives the lists, or their lengths only."""

    def __init__(self, vocabulary, lengths: bool):
        self.vocabulary, self.lengths = vocabulary, lengths

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = getattr(self.vocabulary, "encoder", None)
        if encoder is None:
            # the worker keeps the broadcast, so all its tasks share one automaton
            encoder = self.vocabulary.encoder = Encoder(*self.vocabulary.value)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                lists = [encoder.encode(t) if t else [] for t in part.column(1).to_pylist()]
                if self.lengths:
                    made = pa.array([len(x) for x in lists], pa.int64())
                else:
                    offsets = np.zeros(len(lists) + 1, np.int64)
                    np.cumsum([len(x) for x in lists], out=offsets[1:])
                    flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
                    made = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), made], [b.schema.names[0], "tokens" if self.lengths else "ids"])


def _run(df: DataFrame, key: str, text: str, path: str | None, lengths: bool) -> DataFrame:
    spark = df.sparkSession
    ship(spark)
    vocabulary = spark.sparkContext.broadcast(load_vocabulary(path or vocabulary_path()))
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(_Encode(vocabulary, lengths), f"`{key}` {kind}, " + ("tokens long" if lengths else "ids array<int>"))


def encoded(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """`key` and `ids`, the token ids of `text` by the vocabulary at `path`, without special tokens; one row out per row in.

    No shuffle: each task encodes the rows of its split.  The vocabulary (some
    MB, a fixed size) is read by the driver and broadcast.  Null and empty
    texts give an empty list.  Texts of special tokens are ordinary text.  A
    text of any length takes time in proportion; the memory for words and
    pairs is bounded.  Keys may be null or repeated.
    """
    return _run(df, key, text, path, False)


def token_lengths(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """`key` and `tokens`, how many token ids `encoded` gives."""
    return _run(df, key, text, path, True)
