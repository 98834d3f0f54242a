"""Token ids of whole texts from a public tokenizer file, inside Spark tasks.

A byte-level BPE file splits a text before it merges, always between other
characters and a blank after them and between a letter and what is no letter
after it. So a text is cut there, and the ids of such a chunk are kept for the
next time it comes; new chunks are encoded many at a time, put together as they
could stand in a text. The string of a special token in a text is that token; it
starts with neither letter nor blank and holds no blank, so a chunk has it whole. Texts in which blanks meet are encoded whole. Either way
the ids are those of the library.
"""

from __future__ import annotations

import os
import re
import sys
import types

import numpy as np

TOKENIZER_FILE = "byte_bpe_50k.json"
#: Chunks kept per Python worker, and their characters together; beyond either, the newer half is dropped.
KEPT_CHUNKS, KEPT_CHARS = 1_200_000, 20_000_000
#: New chunks that one call of the library encodes.
RUN = 4096
#: Letters of the languages at hand; a run of them is a chunk unless another letter follows.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"


def tokenizer_path() -> str:
    """Place of the default tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)


class Encoder:
    """Encodes lists of texts to little-endian 32-bit ids."""

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path or tokenizer_path())
        entries = self.library.get_vocab()
        self.sizes = np.ones(max(entries.values()) + 1, dtype=np.int64)  # bytes of each id: byte-level entries have a letter per byte
        for entry, i in entries.items():
            self.sizes[i] = len(entry)
        self.kept: dict[str, bytes] = {}
        self.chars = 0
        self.chunks = re.compile(rf"[ \n]?[{LETTERS}]+(?![^\W\d_])|[ \n]?[^ \n]+").findall
        self.end = self.library.encode("\n", add_special_tokens=False).ids

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks without a blank inside, from runs of them: each begins with a blank, or gets a line end before it whose id is left out."""
        out: list[bytes] = []
        for lo in range(0, len(chunks), RUN):
            some = chunks[lo:lo + RUN]
            led = [c[0] not in " \n" for c in some]
            run = "".join(["\n" + c if bare else c for c, bare in zip(some, led)])
            ids = np.frombuffer(self._whole([run])[0], dtype="<u4")
            ends = np.cumsum([len(c.encode("utf-8", "surrogatepass")) + bare for c, bare in zip(some, led)])
            reach = np.cumsum(self.sizes[ids])
            last = np.searchsorted(reach, ends)
            if len(self.end) != 1 or last[-1] >= len(reach) or (reach[last] != ends).any():  # not a byte-level vocabulary
                out += self._whole(some)
                continue
            data, bounds = ids.tobytes(), np.concatenate([[0], 4 * (last + 1)])
            first = (bounds[:-1] + 4 * np.array(led)).tolist()
            out += [data[a:b] for a, b in zip(first, bounds[1:].tolist())]
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text (none for null)."""
        get, out, open_, new = self.kept.get, [], [], {}
        for text in texts:
            if not text:
                out.append([])
            elif "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[-1] in " \n":  # blanks that meet or end a text
                out.append(None)
            else:
                chunks = self.chunks(text)
                parts = list(map(get, chunks))
                if not all(parts):  # looking for None would compare it with the ids of every chunk
                    holes = [(i, c) for i, (c, p) in enumerate(zip(chunks, parts)) if p is None]
                    new.update(dict.fromkeys([c for _, c in holes]))
                    open_.append((len(out), holes))
                out.append(parts)
        # a chunk with another blank inside is not cut safely; its texts are encoded whole
        safe = [c for c in new if c.split() == [c.lstrip(" \n")]]
        new.update(zip(safe, self._chunks(safe)))
        for at, holes in open_:
            parts = out[at]
            for i, c in holes:
                parts[i] = new[c]
            if any(new[c] is None for _, c in holes):
                out[at] = None
        self._keep(new, safe)
        whole = [i for i, parts in enumerate(out) if parts is None]
        encoded = dict(zip(whole, self._whole([texts[i] for i in whole])))
        return [np.frombuffer(encoded[i] if parts is None else b"".join(parts), dtype="<u4") for i, parts in enumerate(out)]

    def _keep(self, new: dict[str, bytes], safe: list[str]) -> None:
        """Keep the new chunks; when there are too many, the newer half goes (frequent ones come early)."""
        self.kept.update((c, new[c]) for c in safe)
        self.chars += sum(map(len, safe))
        if len(self.kept) > KEPT_CHUNKS or self.chars > KEPT_CHARS:
            for c in list(self.kept)[len(self.kept) // 2:]:
                self.chars -= len(c)
                del self.kept[c]


def worker_encoder(path: str | None = None) -> Encoder:
    """The encoder of this Python worker, kept from task to task."""
    state = sys.modules.setdefault("parley_worker_state", types.ModuleType("parley_worker_state"))
    encoders = state.__dict__.setdefault("encoders", {})
    if path not in encoders:
        encoders[path] = Encoder(path)
    return encoders[path]
