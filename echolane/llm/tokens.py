"""Token ids of whole texts with a given byte-level vocabulary file.

Where the file is plain byte-level BPE whose ids follow the order of its merges, an encoder that
works on the same ranks gives the same ids as the file's own library and takes a quarter of
the time. It takes texts of Latin-1 characters without strings of added tokens: on those all
libraries agree on what a letter, a digit and white space is. All other texts, and all texts of any
other file, go to the file's own library.
"""

from __future__ import annotations

import hashlib
import json
import os
from pathlib import Path

import numpy as np

from .common import worker_store

# Texts to encode at a time.
TEXTS = 500

# The pre-tokenizer of byte-level BPE, and how it splits a text.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_vocabulary(path: str) -> str:
    """The vocabulary file's JSON; a few MB, which travel with the job."""
    return Path(path).read_text(encoding="utf-8")


def byte_of_mark() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class ByteLevel:
    """Token ids and token bytes of a byte-level BPE file.

    ``marks_as_text`` takes strings of added tokens for plain text; else they are what the library's
    plain call makes of them.
    """

    def __init__(self, vocabulary: str, marks_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = marks_as_text
        data = json.loads(vocabulary)
        added = {t["content"] for t in data["added_tokens"]}
        self.marks = [] if marks_as_text else sorted(added)
        bytes_of = byte_of_mark()
        ranks = {bytes(bytes_of[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in added}
        self.bytes_of = [b""] * self.tokenizer.get_vocab_size()
        for token, i in ranks.items():
            self.bytes_of[i] = token
        pairs = (m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"])
        merged = [ranks[bytes(bytes_of[c] for part in pair for c in part)] for pair in pairs]
        plain = data["normalizer"] is None and data["pre_tokenizer"] == BYTE_LEVEL
        in_order = merged == list(range(256, 256 + len(merged))) and len(ranks) == 256 + len(merged)
        self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}) if plain and in_order else None

    def _easy(self, text: str) -> bool:
        return self.fast is not None and not any(m in text for m in self.marks) and _latin(text)

    def encode(self, texts: list[str]) -> list[list[int]]:
        easy = [self._easy(t) for t in texts]
        others = iter(self.tokenizer.encode_batch_fast([t for t, e in zip(texts, easy) if not e], add_special_tokens=False))
        return [self.fast.encode_ordinary(t) if e else next(others).ids for t, e in zip(texts, easy)]


class Encoder:
    """``encode(texts)`` gives an array of ids per text, two bytes each where the vocabulary allows it."""

    def __init__(self, vocabulary: str):
        store = worker_store("tokens")
        key = hashlib.sha256(vocabulary.encode()).digest()
        if key not in store:
            store[key] = ByteLevel(vocabulary)
        self.bytes = store[key]
        self.dtype = np.dtype("<u2" if self.bytes.tokenizer.get_vocab_size() < 1 << 16 else "<u4")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, dtype=self.dtype) for ids in self.bytes.encode(texts)]
