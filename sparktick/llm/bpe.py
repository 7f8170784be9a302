"""BPE encoding of the distinct words of a block by one walk through their trie, and decoding."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparktick.llm.common import chunks, ids_and_texts, released

WORD_END = "</w>"
LETTERS, NUMBERS = "a-zA-Zªµºß-öø-ɏÀ-ÖØ-Þ", "0-9²³¹¼½¾"
# The file's pattern for texts of Latin characters; other texts are cut by the library's own pre-tokeniser.
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
UNUSUAL = re.compile("[^\\x00-\\x1b\\x20-ɏ]")
BLOCK_BYTES = 24 << 20
FIELDS = "doc_id long, n_tokens long, ids binary, decoded string"


class TrieEncoder:
    """Words to token ids of a BPE file whose words end in `</w>`, through a trie of distinct words.

    A word's symbols are its byte characters, the last one with the word end. For each trie node the state is the last token of
    the encoding of its prefix: the one token t ending there for which t is the whole prefix, or may follow the last token of the
    prefix without t. Two tokens may follow each other if the merges turn their joined symbols into just these two. A prefix
    shared by many words is visited once; a word's ids are read off by jumping back from its last state.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.strings = {i: s for s, i in self.library.get_vocab(with_added_tokens=True).items()}
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.longest = max(len(t.removesuffix(WORD_END)) for t in self.vocab)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.as_char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.follows: dict[tuple[str, str], bool] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """The merges applied one by one, lowest rank first, leftmost first."""
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: self.rank.get((symbols[i], symbols[i + 1]), 1 << 60))
            if (symbols[best], symbols[best + 1]) not in self.rank:
                break
            symbols[best:best + 2] = [symbols[best] + symbols[best + 1]]
        return symbols

    @staticmethod
    def symbols(token: str) -> list[str]:
        if token.endswith(WORD_END) and len(token) > len(WORD_END):
            body = token[:-len(WORD_END)]
            return [*body[:-1], body[-1] + WORD_END]
        return list(token)

    def may_follow(self, left: str, token: str) -> bool:
        known = self.follows.get((left, token))
        if known is None:
            if len(self.follows) > 1_000_000:
                self.follows.clear()
            wanted = [left, token] if left else [token]
            known = self.follows[left, token] = self.merged([s for t in wanted for s in self.symbols(t)]) == wanted
        return known

    def last_token(self, prefix: str, states: list[str], end: bool) -> str:
        """State of the node of `prefix` (`end`: its word-end node), given the states of all shorter prefixes."""
        n = len(prefix)
        tail = WORD_END if end else ""
        for j in range(max(0, n - self.longest), n):
            token = prefix[j:] + tail
            if token in self.vocab and self.may_follow(states[j], token):
                return token
        raise ValueError(f"no token ends {prefix!r}")

    def encode_words(self, words: set[str]) -> dict[str, list[int]]:
        """All words' ids by a depth-first walk: in sorted order, a word shares the nodes of its common prefix with the one before."""
        out: dict[str, list[int]] = {}
        path, states = "", [""]  # the node at hand: its characters, and the state of each prefix of it
        for word in sorted(words):
            inner = word[:-1]
            keep = 0
            for a, b in zip(path, inner):
                if a != b:
                    break
                keep += 1
            del states[keep + 1:]
            for i in range(keep, len(inner)):
                states.append(self.last_token(inner[:i + 1], states, False))
            path = inner
            ids, token, at = [], self.last_token(word, states, True), len(word)
            while True:
                ids.append(self.vocab[token])
                at -= len(token.removesuffix(WORD_END)) or len(token)
                if at <= 0:
                    break
                token = states[at]
            out[word] = ids[::-1]
        return out

    def byte_chars(self, piece: str) -> str:
        return "".join(map(self.as_char.__getitem__, piece.encode()))

    def pieces(self, text: str) -> list[str]:
        """The byte characters of the words of any text without special tokens, cut by the library."""
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def block(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """(ids, decoded text) of each text; what stands between two gaps is looked up as a whole."""
        cut: list[list[tuple[str, bool]]] = []  # per text: (segment, is special)
        usual: set[str] = set()
        rare: dict[str, list[str]] = {}
        for text in texts:
            parts = [text]
            if self.at_special and any(s in text for s in self.special):
                parts = [p for p in self.at_special.split(text) if p]
            row = []
            for part in parts:
                row.append((part, part in self.special))
                if row[-1][1]:
                    continue
                if UNUSUAL.search(part):
                    rare[part] = self.pieces(part)
                else:
                    usual.update(part.lower().split())
            cut.append(row)
        of_chunk = {c: [self.byte_chars(p) for p in PIECES.findall(c)] for c in usual}
        words = {w for ws in of_chunk.values() for w in ws}
        words.update(w for ws in rare.values() for w in ws)
        ids = {w: np.asarray(x, "<u4").tobytes() for w, x in self.encode_words(words).items()}

        def joined(ws: list[str]) -> tuple[bytes, str]:
            b = b"".join([ids[w] for w in ws])
            return b, " ".join([self.strings[i] for i in np.frombuffer(b, "<u4").tolist()])

        chunk = {c: joined(ws) for c, ws in of_chunk.items()}
        chunk_ids, chunk_text = {c: x[0] for c, x in chunk.items()}, {c: x[1] for c, x in chunk.items()}
        for row in cut:
            out_ids, out_text = [], []
            for part, is_special in row:
                if is_special:
                    out_ids.append(self.special[part].to_bytes(4, "little"))
                    out_text.append(part)
                elif part in rare:
                    b, t = joined(rare[part])
                    out_ids.append(b)
                    out_text.extend([t] if b else [])
                else:
                    cs = part.lower().split()
                    out_ids.extend(map(chunk_ids.__getitem__, cs))
                    out_text.extend(map(chunk_text.__getitem__, cs))
            yield b"".join(out_ids), " ".join(out_text)


_ENCODERS: dict[str, TrieEncoder] = {}


def trie_encoder(path: str) -> TrieEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(path)
    return _ENCODERS[path]


def _encode(batches: Iterator[pa.RecordBatch], path: str, fields: list[str], digest) -> Iterator[pa.RecordBatch]:
    block = trie_encoder(path).block
    for held in chunks(batches, "text", BLOCK_BYTES):
        doc_ids = [i for b in held for i in b.column("doc_id").to_pylist()]
        texts = [t for b in held for t in b.column("text").to_pylist()]
        rows, size = [], 0
        for doc_id, (ids, text) in zip(doc_ids, block(texts)):
            rows.append((doc_id, len(ids) // 4, *digest(ids, text)))
            size += sum(len(x) for x in rows[-1][2:])
            if size > BLOCK_BYTES or len(rows) >= 10_000:
                yield _batch(rows, fields)
                rows, size = [], 0
        if rows:
            yield _batch(rows, fields)


def _batch(rows: list[tuple], fields: list[str]) -> pa.RecordBatch:
    a, b, *rest = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *map(pa.array, rest)], names=fields)


def _whole(ids: bytes, text: str) -> tuple[bytes, str]:
    return ids, text


def _hashes(ids: bytes, text: str) -> tuple[str, str]:
    import hashlib

    return hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def encode_decode(docs: DataFrame, tokenizer: str, digests: bool = False) -> DataFrame:
    """Encode each whole text and decode the ids again.

    Returns doc_id, n_tokens, and ids (little-endian unsigned 32-bit, binary) with decoded (string), or with `digests` only
    ids_sha256 and decoded_sha256 of the two, so that long results need not leave the task.

    The texts stay in the tasks that read them. A task takes blocks of about BLOCK_BYTES of text, collects the block's distinct
    words and encodes them in one walk through their trie; no words are exchanged between tasks, and nothing grows with the table.

    Null and empty texts give no tokens and an empty decoded text; special tokens' strings inside texts become their ids, as the
    library does. Empty tables give no rows; repeated rows give repeated results.
    """
    fields = ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])]
    schema = FIELDS.replace("ids binary, decoded string", "ids_sha256 string, decoded_sha256 string") if digests else FIELDS
    how = _hashes if digests else _whole
    return ids_and_texts(docs).mapInArrow(released(lambda batches: _encode(batches, tokenizer, fields, how)), schema)
