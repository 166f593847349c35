"""Subword ids of whole texts, with a compact cache of words.

The vocabulary of ``word_bpe_49k.json`` never joins what white space parts, so the ids of a text
are those of its words in turn. Words are told apart by a 64-bit hash; each distinct word of a
block is looked up once, and those not met before are encoded many at a time. Words of Latin
letters alone need neither the tokenizer's patterns nor its offsets: they go straight to its
merges. Of the others, those of letters are told apart by the mark of a word's last id; the rest
go one by one.
"""

from __future__ import annotations

import os
from functools import cache

import numpy as np

from pixelweave.llm.line_dedup import spans

#: Marks that the vocabulary parts from letters before them.
PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: The letter that stands for each byte, as in the vocabulary's byte level: itself if it can be seen, else one from 256 on.
SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTERS = {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*SEEN}))}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Maps words to their ids; what is known lies in arrays, about 25 bytes a word."""

    #: Words kept; beyond that only those of the texts at hand stay.
    KEEP = 2_000_000

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, np.bool_)
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.type = np.uint16 if len(self.last) <= 1 << 16 else np.uint32
        self._forget()

    def _forget(self) -> None:
        self.known, self.start, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, self.type)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the texts' words in turn: the place of each hash among the distinct ones, and those; of each text, the end of its words and of its ids; all ids."""
        joined = b"\n".join(texts)
        if b"<|" not in joined:  # the vocabulary has no capitals; its marks, matched before it folds case, hold these signs
            joined = joined.lower()
        hashes, starts = spans(joined)
        words = np.searchsorted(starts, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1))
        distinct, first, at = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, distinct)
        if len(self.known):
            new = self.known[np.minimum(place, len(self.known) - 1)] != distinct
        else:
            new = np.ones(len(distinct), np.bool_)
        if new.any():
            if len(self.known) + int(new.sum()) > self.KEEP:
                self._forget()
                new[:] = True
            i = first[new]
            ends = np.append(starts, len(joined))[i + 1]  # with the white space after the word
            self._learn(distinct[new], [joined[a:b].rstrip() for a, b in zip(starts[i].tolist(), ends.tolist())])
            place = np.searchsorted(self.known, distinct)
        if not len(at):
            return at, distinct, words, words, self.flat[:0]
        size, start = self.size[place][at], self.start[place][at]
        to = np.cumsum(size, dtype=np.int32)
        return at, distinct, words, np.append(0, to)[words], self.flat[np.repeat(start - to + size, size) + np.arange(int(to[-1]), dtype=np.int32)]

    def _learn(self, hashes: np.ndarray, words: list[bytes], at_once: int = 20_000) -> None:
        """Adds words by their hashes (in order)."""
        raw = []
        for i in range(0, len(words), at_once):
            raw += self._encoded(words[i : i + at_once])
        flat = np.frombuffer(b"".join(raw), self.type)
        size = np.fromiter(map(len, raw), np.int32, len(raw)) // flat.itemsize
        order = np.argsort(np.concatenate([self.known, hashes]), kind="stable")
        self.known = np.concatenate([self.known, hashes])[order]
        self.start = np.concatenate([self.start, (np.cumsum(size) - size + len(self.flat)).astype(np.int32)])[order]
        self.size = np.concatenate([self.size, size])[order]
        self.flat = np.concatenate([self.flat, flat])

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word."""
        plain, other, rest, parts = {}, {}, {}, []
        for w in words:
            stem = w.rstrip(PUNCTUATION)
            s = stem.decode("utf-8", "replace")
            low = s.lower()
            if not s.isalpha() or not low.isalpha():
                rest[w] = None
                parts.append((w, b""))
                continue
            tail = w[len(stem) :]
            if s.isascii() or max(s) < "ɐ":
                plain[stem] = low
            else:
                other[stem] = s
            if tail:
                rest[tail] = None
            parts.append((stem, tail))
        ids = self._each(list(rest)) | self._many(other, self.tokenizer, 2000)
        ids |= self._many({w: (s if s.isascii() else s.encode().decode("latin-1").translate(LETTERS)) for w, s in plain.items()}, self.merges, 500)
        ids[b""] = b""
        return [ids[stem] + ids[tail] for stem, tail in parts]

    def _many(self, words: dict[bytes, str], tokenizer, at_once: int) -> dict[bytes, bytes]:
        out, keys = {}, list(words)
        for i in range(0, len(keys), at_once):
            own = keys[i : i + at_once]
            ids = np.array(tokenizer.encode_batch_fast([" ".join([words[w] for w in own])], add_special_tokens=False)[0].ids, self.type)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(own) or ends[-1] != len(ids):
                out |= self._each(own)
                continue
            raw, a, width = ids.tobytes(), 0, ids.itemsize
            for w, b in zip(own, (ends * width).tolist(), strict=True):
                out[w] = raw[a:b]
                a = b
        return out

    def _each(self, words: list[bytes]) -> dict[bytes, bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False) if words else []
        return {w: np.array(e.ids, self.type).tobytes() for w, e in zip(words, found, strict=True)}


@cache
def word_ids(path: str) -> WordIds:
    """One for each Python worker."""
    return WordIds(path)
