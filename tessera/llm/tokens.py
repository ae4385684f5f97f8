"""Token counts of a byte-level BPE tokenizer file by the whole-token shortcut.

Byte-level BPE splits a text into pre-tokens and merges each on its own.  For
most pre-tokens the answer is known beforehand: :func:`whole_tokens` runs the
library once over its own vocabulary and keeps those strings that it gives back
as a single token.  A pre-token in that set counts one without any merging;
only the rest is merged, and remembered in a bounded cache.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CACHE = 300_000
_STREAM = 1 << 20


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write bytes as."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Counter:
    """Counts tokens as the library does; built once per worker process."""

    def __init__(self, path: str) -> None:
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        if (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec.get("normalizer") or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only byte-level tokenizers without a normalizer or a prefix space")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = [t for t in spec["added_tokens"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that look at their neighbours are not supported")
        self.added = [t["content"] for t in added]
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if added else None
        self.split = regex.compile(SPLIT)
        alphabet = _byte_alphabet()
        ranks = {bytes(alphabet[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in self.added}
        self.merge = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.whole = whole_tokens(self.library, ranks, self.split)
        self.known: dict[str, int] = dict(self.whole)

    def _count(self, piece: str) -> int:
        n = len(self.merge(piece.encode("utf-8")))
        if len(self.known) >= _CACHE + len(self.whole):
            self.known = dict(self.whole)
        self.known[piece] = n
        return n

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        if len(text) <= _STREAM:
            pieces = self.split.findall(text)
        else:
            pieces = (m.group() for m in self.split.finditer(text))
        total, get, count = 0, self.known.get, self._count
        for piece in pieces:
            n = get(piece)
            if n is None:
                n = count(piece)
                get = self.known.get
            total += n
        return total

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if self.cut is None or not any(t in text for t in self.added):
            return self._plain(text)
        bounds = [m.span() for m in self.cut.finditer(text)]
        edges = [0, *chain.from_iterable(bounds), len(text)]
        return len(bounds) + sum(self._plain(text[s:e]) for s, e in zip(edges[::2], edges[1::2], strict=True))


def whole_tokens(library: Tokenizer, ranks: dict[bytes, int], split: regex.Pattern) -> dict[str, int]:
    """The vocabulary strings that are one pre-token and that the library encodes alone as one token."""
    texts = []
    for raw in ranks:
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:  # part of a character: never a whole pre-token
            continue
        if split.findall(text) == [text]:
            texts.append(text)
    coded = library.encode_batch(texts, add_special_tokens=False)
    return {t: 1 for t, c in zip(texts, coded, strict=True) if len(c.ids) == 1}


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row of ``docs``.

    ``path`` is the tokenizer's file, readable on every executor.  A null text
    counts as empty: no bytes, no tokens.  Texts are counted whole; those over
    a megabyte are split as a stream.  Rows stay rows, repeated or not; other
    columns are not read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            tokens = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
