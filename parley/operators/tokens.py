"""Exact token counts and token-exact tails from a public vocabulary file.

The default vocabulary is a byte-level BPE rank file; its path is a parameter. A
text is split before bytes are merged, and never joined again where a blank
follows another character. So a long text can be encoded in parts that end at
such places, forwards to count its tokens, or backwards to find its last ones,
without encoding what lies before them.
"""

from __future__ import annotations

import base64
import re
import sys
import types
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a part of a long text, and the default vocabulary file.
PART_CHARS, VOCABULARY = 1 << 16, "byte_bpe_multi_50k.tiktoken"
_CUT = re.compile(r"(?<=\S)(?= \S)")


class Vocabulary:
    """Token ids of whole texts, part by part."""

    def __init__(self, path: str | None = None, pattern: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:  # a file installed with the library on every machine
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("file", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def parts_from_end(self, text: str) -> Iterator[str]:
        """The parts of a text, the last one first; a part has ``PART_CHARS`` characters or more (up to where it can begin)."""
        end = len(text)
        while end > PART_CHARS:
            lo, begin = end - PART_CHARS, 0
            while lo > 0:
                cuts = [m.start() for m in _CUT.finditer(text, max(0, lo - PART_CHARS), lo + 2) if m.start() <= lo]
                if cuts:
                    begin = cuts[-1]
                    break
                lo -= PART_CHARS
            yield text[begin:end]
            end = begin
        if end:
            yield text[:end]

    def count(self, text: str) -> int:
        return sum(len(self.encoding.encode_ordinary(p)) for p in self.parts_from_end(text))

    def tail(self, text: str, max_tokens: int) -> str:
        """The text of the last ``max_tokens`` tokens, the text itself if it has no more (bytes cut off from a character become U+FFFD)."""
        found: list[list[int]] = []
        n, whole = 0, True
        for part in self.parts_from_end(text):
            if n > max_tokens:
                whole = False
                break
            found.append(self.encoding.encode_ordinary(part))
            n += len(found[-1])
        if whole and n <= max_tokens:
            return text
        ids = [i for part in reversed(found) for i in part]
        return self.encoding.decode(ids[len(ids) - max_tokens:]) if max_tokens else ""


def _vocabulary(path: str | None) -> Vocabulary:
    """The vocabulary of this Python worker, kept from batch to batch."""
    kept = sys.modules.setdefault("parley_vocabularies", types.ModuleType("parley_vocabularies")).__dict__
    if path not in kept:
        kept[path] = Vocabulary(path)
    return kept[path]


def count_tokens(path: str | None = None) -> Callable[[Column], Column]:
    """Column -> its exact tokens; NULL counts 0."""

    @F.pandas_udf("bigint")
    def _count(texts: pd.Series) -> pd.Series:
        v = _vocabulary(path)
        return pd.Series([v.count(t) if isinstance(t, str) else 0 for t in texts], dtype="int64")

    return _count


def truncate_tail_tokens(max_tokens: int = 8190, path: str | None = None) -> Callable[[Column], Column]:
    """Column -> the text of its last ``max_tokens`` tokens; blank texts become one blank, NULL stays NULL."""

    @F.pandas_udf("string")
    def _tail(texts: pd.Series) -> pd.Series:
        v = _vocabulary(path)
        return pd.Series([(v.tail(t, max_tokens) if t.strip() else " ") if isinstance(t, str) else None for t in texts], dtype="object")

    return _tail
