"""Byte-pair merges of one pre-token, taken from the vocabulary file of a byte-level tokenizer.

The merges of the file, in their order, are handed to a merge loop that knows nothing else: no normalizer, no pattern, no special
tokens. So only what the tokenizer's own steps leave as one pre-token may be passed in. Where the file marks word ends, a byte that no
UTF-8 text holds stands for the mark, and its merge with the last byte comes before all others.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import tiktoken

_END = b"\xff"


def byte_of() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable Latin-1 characters stand for themselves, the
    other bytes in ascending order for the characters from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """Ids of single pre-tokens of letters."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        odd = ("dropout", "continuing_subword_prefix", "ignore_merges", "fuse_unk", "byte_fallback")
        if model["type"] != "BPE" or any(model.get(k) for k in odd):
            raise ValueError(f"not a plain byte-pair vocabulary: {path}")
        vocab, suffix, table = model["vocab"], model.get("end_of_word_suffix") or "", byte_of()
        self.end = _END if suffix else b""
        ranks: dict[bytes, int] = {}
        ids: list[int] = []

        def add(token: str, data: bytes) -> None:
            if data in ranks:
                raise ValueError(f"two merges make {token!r}")
            ranks[data] = len(ids)
            ids.append(vocab.get(token, 0))

        for char, byte in table.items():
            add(char, bytes([byte]))
        if suffix:
            for char, byte in table.items():
                add(char + suffix, bytes([byte]) + _END)
        for merge in model["merges"]:
            token = "".join(merge.split(" ") if isinstance(merge, str) else merge)
            ended = bool(suffix) and token.endswith(suffix)
            add(token, bytes(table[c] for c in (token[: -len(suffix)] if ended else token)) + (_END if ended else b""))
        self.ids = np.array(ids, np.int64)
        self._id = ids
        self._piece = tiktoken.Encoding("merges", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def one(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ids = self._id
        return [ids[k] for k in self._piece(piece + self.end)]

    def encode_all(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of many pieces."""
        ranks = [self._piece(p + self.end) for p in pieces]
        ends = np.cumsum([len(r) for r in ranks])
        flat = self.ids[np.fromiter((x for r in ranks for x in r), np.int64, int(ends[-1]) if ranks else 0)]
        return np.split(flat, ends[:-1]) if ranks else []


@lru_cache(maxsize=4)
def merges_of(path: str) -> Merges:
    return Merges(path)


def is_letters(text: str) -> bool:
    """Letters only, of scripts whose letters all versions of Unicode agree on (up to Cyrillic)."""
    return text.isalpha() and max(text) <= "ӿ"
