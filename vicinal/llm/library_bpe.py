"""Ids from the tokenizers library for split pieces, with few calls."""

from __future__ import annotations

import os

import numpy as np


class LibraryEncoder:
    """Encodes pieces of the byte-level split by the library's merges.

    Letters with one space before them keep their borders when they are put in
    a row, and the library marks each border by a token that begins with a
    space; pieces of letters alone are put between line ends.  So thousands of
    pieces go through one call.  All others are encoded one by one.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.most = max(vocabulary.values())
        self.spaced = np.zeros(self.most + 1, bool)
        for token, i in vocabulary.items():
            self.spaced[i] = token.startswith("Ġ")
        (self.line,) = self.ids("\n")

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def many(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def __call__(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each piece begin, how many they are, and all ids."""
        begin, size = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        pool: list[np.ndarray] = []
        used = 0
        spaced, plain, rest = [], [], []
        for i, p in enumerate(pieces):
            (spaced if p[0] == " " and p[1:].isalpha() else plain if p.isalpha() else rest).append(i)
        for which, between in ((spaced, ""), (plain, "\n")):
            for k in range(0, len(which), 8192):
                part = which[k : k + 8192]
                ids = self.many(between.join([pieces[i] for i in part]))
                if between:
                    line = np.flatnonzero(ids == self.line)
                    at, to = np.concatenate([[0], line + 1]), np.append(line, len(ids))
                else:
                    at = np.flatnonzero(self.spaced[ids])
                    to = np.append(at[1:], len(ids))
                if len(at) != len(part):  # a letter that the library splits in another way
                    rest += part
                    continue
                begin[part], size[part] = used + at, to - at
                pool.append(ids)
                used += len(ids)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False), strict=True):
            begin[i], size[i] = used, len(e.ids)
            pool.append(np.array(e.ids, np.uint32))
            used += len(e.ids)
        return begin, size, np.concatenate(pool) if pool else np.zeros(0, np.uint32)
