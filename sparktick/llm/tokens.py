"""Token ids of whole texts by a byte-level BPE file, with a bounded memory of words already encoded."""

from __future__ import annotations

import base64
import re
from pathlib import Path

import numpy as np

# White space other than single blanks and line feeds between visible characters.
ODD_SPACE = re.compile(r"[^\S\n ]|[ \n][ \n]|^[ \n]|[ \n]$")


class TextEncoder:
    """`encode(text)`: ids as little-endian unsigned 32-bit bytes, equal to the tokenizers library's without special tokens added.

    The file's pattern never joins what stands before a single blank or line feed with what stands behind it, so a text is cut
    there and each part is encoded once. Texts with other white space are encoded in one piece, texts that hold a special token's
    string by the tokenizers library itself.
    """

    def __init__(self, path: str, remembered: int = 400_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.remembered = remembered
        ranks = Path(path).with_suffix(".tiktoken")
        self.fast = None
        if ranks.exists():
            import tiktoken
            from public_tokenizers import PATTERN

            lines = (line.split() for line in ranks.read_bytes().splitlines())
            self.fast = tiktoken.Encoding(
                "ranks", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in lines}, special_tokens={},
            ).encode_ordinary
        self.first, self.later = _Known(self.plain, ""), _Known(self.plain, " ")
        self.feed = self.plain("\n")

    def forget(self) -> None:
        self.first.clear()
        self.later.clear()

    def plain(self, text: str) -> bytes:
        ids = self.fast(text) if self.fast else self.library.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if not text:
            return b""
        if ODD_SPACE.search(text):
            return self.plain(text)
        if len(self.first) + len(self.later) > self.remembered:
            self.forget()
        first, later = self.first.__getitem__, self.later.__getitem__
        lines = []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            lines.append(first(head) + b"".join(map(later, rest)))
        return self.feed.join(lines)


class _Known(dict):
    def __init__(self, encode, before: str):
        self.encode, self.before = encode, before

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.encode(self.before + word)
        return ids


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder for each Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]
