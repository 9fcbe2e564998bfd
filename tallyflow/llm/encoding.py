"""Token ids of whole texts, batch by batch.

The tokenizer's splitting pattern never joins over white space and its normalizer turns white
space into white space only, so the ids of a text are those of its white-space chunks in order.
Arrow splits a batch and numbers its distinct chunks; each distinct chunk is encoded once, kept
within the worker, and the ids of the texts are gathered from those of the chunks.

A chunk is normalized and cut into words here; the ids of a word come from ``words``: the BPE
model of the tokenizers library (``LibraryWords``) or the dynamic programming of ``bpe``.
"""

from __future__ import annotations

import json
import struct
import unicodedata
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallyflow.llm.texts import kept_in_worker, tokenizer_file

CACHED_CHUNKS = 500_000  # memory bound of a worker, about 110 MB; a full cache starts anew


class Words(Protocol):
    def ids(self, word: str) -> list[int]:
        """Ids of a word in byte letters."""


class LibraryWords:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path).model

    def ids(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word)]


def byte_letters() -> list[str]:
    """Printable letter of each byte in byte-level vocabularies: bytes with a visible Latin-1
    character keep it, the others take the characters from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


class BatchEncoder:
    """Encoder of Arrow string columns for a byte-level BPE file whose normalizer is NFC, white space
    to space, lower case, and whose first pre-tokenizer keeps the matches of a pattern."""

    def __init__(self, words: Words, path: str, cached: int = CACHED_CHUNKS):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        first = spec["pre_tokenizer"]["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or (first["type"], first["invert"]) != ("Split", True):
            raise ValueError(f"{path}: not a word-end BPE file of the supported kind")
        self.words = words
        self.pieces = regex.compile(first["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        names = {i: t for t, i in spec["model"]["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.names = pa.array([names.get(i, "") for i in range(max(names) + 1)], pa.string())
        self.letters = dict(enumerate(byte_letters()))
        self.known: dict[str, bytes] = {}
        self.known_words: dict[str, bytes] = {}
        self.cached = cached

    def _word(self, piece: str) -> bytes:
        got = self.known_words.get(piece)
        if got is None:
            plain = piece.isascii() and piece.isprintable()
            ids = self.words.ids(piece if plain else piece.encode().decode("latin-1").translate(self.letters))
            got = struct.pack(f"<{len(ids)}I", *ids)
            if len(self.known_words) >= self.cached // 2:
                self.known_words.clear()
            self.known_words[piece] = got
        return got

    def _chunk(self, chunk: str) -> bytes:
        if "<|" in chunk and (parts := self.at_special.split(chunk))[1:]:
            # special tokens are found in the text as it stands, before it is normalized
            return b"".join(
                struct.pack("<I", self.special[p]) if k % 2 else self._chunk(p) for k, p in enumerate(parts) if p
            )
        if chunk.isascii():
            chunk = chunk.lower()
        else:
            chunk = unicodedata.normalize("NFC", chunk)
            # letter by letter where the lower case of a letter depends on its neighbours
            chunk = "".join(map(str.lower, chunk)) if "Σ" in chunk else chunk.lower()
        if chunk.isalpha():
            return self._word(chunk)
        return b"".join(map(self._word, self.pieces.findall(chunk)))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as unsigned 32-bit, n + 1 offsets). A null text has no ids."""
        texts = pc.fill_null(column, "")
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, chunks))
        missing = [k for k, f in enumerate(found) if f is None]
        if len(self.known) + len(missing) > self.cached:
            self.known.clear()
        for k in missing:
            found[k] = self.known[chunks[k]] = self._chunk(chunks[k])
        pool = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        words = coded.indices.to_numpy()
        lengths = sizes[words]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(starts[words] - ends[:-1], lengths)
        at += np.arange(len(at))
        per_text = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        return pool[at], ends[np.concatenate([[0], np.cumsum(per_text)])]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of ids: the file names no decoder, so that tokens are joined by a space."""
        tokens = self.names.take(pa.array(ids))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tokens), " ")


def id_column(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Ids of each text as binary: little-endian unsigned integers of the array's width."""
    ends = (offsets * ids.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(ids))])


def library_encoder(path: str | None = None) -> BatchEncoder:
    """The worker's encoder: what it keeps serves all tasks that the worker runs."""
    file = path or tokenizer_file()
    return kept_in_worker(("library", file), lambda: BatchEncoder(LibraryWords(file), file))
