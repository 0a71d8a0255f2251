"""Token ids of texts by a public tokenizer file, with each distinct word encoded once per worker.

A tokenizer cuts a text into pieces and encodes every piece on its own. The texts are
cut here only where the tokenizer surely cuts as well, so that the ids of the parts,
encoded by the tokenizers library and kept in a bounded dictionary, are the ids of the text.
"""

from __future__ import annotations

import array
import re
from collections.abc import Iterator

import numpy as np

from clausemill.llm.common import worker_state

# The characters that the tokenizers' \s matches.
SPACE = "\t-\r \x85\xa0  -     　"

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_AFTER_WORD = rf"(?![^{SPACE}.,;:!?])"

# Where a byte-level tokenizer surely cuts: a word keeps one space before it, of other white
# space all but the last character goes together, and marks after a run of letters are apart.
BYTE_LEVEL_PARTS = rf" ?[{_LETTERS}]++{_AFTER_WORD}| ?[^{SPACE}]++|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]"
# A tokenizer that drops white space: runs of anything else.
WORD_PARTS = rf"[{_LETTERS}]++{_AFTER_WORD}|[^ \t\n\r]++"

WORDS_KEPT = 1_000_000


# How byte-level tokenizers write bytes: printable ones as they are, the others from character 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARACTERS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class _Words(dict):
    """Ids of words as little-endian unsigned 32-bit bytes, made when a word is first asked for."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.normal, self.model = self.tokenizer.normalizer, self.tokenizer.model
        self.one_piece = re.compile(f" ?[{_LETTERS}]+").fullmatch

    def __missing__(self, word: str) -> bytes:
        if self.one_piece(word):  # letters alone are one piece, which needs only the normalizer and the model
            piece = self.normal.normalize_str(word) if self.normal else word
            piece = piece.encode().decode("latin-1").translate(_BYTE_CHARACTERS)
            ids = [t.id for t in self.model.tokenize(piece)]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        self[word] = data = array.array("I", ids).tobytes()
        return data


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes.

    ``words_kept`` bounds the memory of the dictionary; beyond it the dictionary starts anew.
    Strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str, parts: str, words_kept: int = WORDS_KEPT):
        self.words = _Words(path)
        self.tokenizer = self.words.tokenizer
        self.split = re.compile(parts).findall
        self.words_kept = words_kept

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        find = self.words.__getitem__
        for text in texts:
            if len(self.words) > self.words_kept:
                self.words.clear()
            yield b"".join(map(find, self.split(text)))


def encoder(path: str, parts: str) -> Encoder:
    """The worker's encoder for this file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    state, key = worker_state(), f"encoder {path}"
    if key not in state:
        state[key] = Encoder(path, parts)
    return state[key]


def ids_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<u4")
