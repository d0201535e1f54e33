"""Wrappers of public tokenizers for one Python worker.

The word tokenizer never joins what stands on two sides of white space, so a
word's ids depend on the word alone: the distinct words of a batch are tokenised
once, and all the rest is gathering in arrays. Tables of pieces are bounded in
entries and characters; a full one is emptied and filled anew.
"""

from __future__ import annotations

import functools
import re
from array import array

import numpy as np

CACHE_ENTRIES = 600_000
#: Characters of all pieces that a worker keeps.
CACHE_CHARS = 16_000_000
#: Words without these are composed already, have no white space and no special-token text; the rest go through the whole tokenizer.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u0250-\U0010ffff]|<[|]")


def _byte_letters() -> dict[int, str]:
    """Byte -> the letter that byte-level vocabularies write for it: printable bytes stand for themselves, the others follow from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def gather(values: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """values[begin[i] : begin[i] + count[i]] for each i, one after another."""
    ends = np.cumsum(count)
    return values[np.repeat(begin - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]


class PieceNumbers(dict):
    """pre-token -> its number; ids and counts hold the ids of each by number. Number 0 is the border between words."""

    def __init__(self, model) -> None:
        super().__init__({"\n": 0})
        self.model, self.letters = model, _byte_letters()
        self.ids, self.counts = array("I"), array("q", [0])
        self.chars = 0

    def __missing__(self, piece: str) -> int:
        ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
        self.ids.extend(ids)
        self.counts.append(len(ids))
        self.chars += len(piece)
        n = self[piece] = len(self.counts) - 1
        return n


class WordIds:
    """Ids of texts by the tokenizers library, each distinct word of a batch being tokenised once."""

    def __init__(self, path: str) -> None:
        import json

        import regex
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            split = json.load(f)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._pieces = regex.compile(rf"\n|{split}")
        self._numbers = PieceNumbers(self._tokenizer.model)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after another, and how many each has."""
        if len(self._numbers) > CACHE_ENTRIES or self._numbers.chars > CACHE_CHARS:
            self._numbers = PieceNumbers(self._tokenizer.model)
        numbers, joined = self._numbers, "\n".join([*words, ""])
        odd = [m.start() for m in _ODD.finditer(joined)]
        if odd:
            borders = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            odd = np.unique(np.searchsorted(borders, odd, "right")).tolist()
            plain = list(words)
            for i in odd:
                plain[i] = ""
            joined = "\n".join([*plain, ""])
        pieces = self._pieces.findall(joined.lower())
        at = np.fromiter(map(numbers.__getitem__, pieces), np.int64, len(pieces))
        count = np.array(numbers.counts, np.int64)
        ids = gather(np.array(numbers.ids, np.uint32), (np.cumsum(count) - count)[at], count[at])
        ends = np.cumsum(count[at])[at == 0]
        sizes = np.diff(ends, prepend=0)
        if odd:
            begins = ends - sizes
            whole = [np.array(e.ids, np.uint32) for e in self._tokenizer.encode_batch([words[i] for i in odd], add_special_tokens=False)]
            parts, last = [], 0
            for i, own in zip(odd, whole, strict=True):
                parts += [ids[last : begins[i]], own]
                last, sizes[i] = begins[i], len(own)
            ids = np.concatenate([*parts, ids[last:]])
        return ids, sizes

    def encode(self, texts, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of an Arrow array of texts: little-endian uint32 ids one after another, and how many each text has, the end id included."""
        import pyarrow as pa
        import pyarrow.compute as pc

        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        borders = lists.offsets.to_numpy()
        words = lists.flatten().dictionary_encode()
        known, known_sizes = self._words(words.dictionary.to_pylist())
        codes = words.indices.to_numpy()
        if end_id is not None:  # the end is one more word behind each text
            codes = np.insert(codes, borders[1:] - borders[0], len(known_sizes))
            known, known_sizes = np.r_[known, np.uint32(end_id)], np.r_[known_sizes, 1]
            borders = borders + np.arange(len(borders))
        table = pa.Array.from_buffers(pa.large_binary(), len(known_sizes), [None, pa.py_buffer(4 * np.r_[0, np.cumsum(known_sizes)]), pa.py_buffer(known.astype("<u4"))])
        _, ends, data = table.take(pa.array(codes)).buffers()
        ends = np.frombuffer(ends, np.int64, len(codes) + 1) // 4
        ids = np.frombuffer(data, "<u4", ends[-1]) if len(codes) else np.zeros(0, "<u4")
        return ids, np.diff(ends[borders - borders[0]])


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One for all tasks of a Python worker."""
    return WordIds(path)


class Pieces:
    """A SentencePiece model, and the same model for text that is normalised already."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        from .model_proto import without_normalizer

        with open(path, "rb") as f:
            model = f.read()
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.raw = sentencepiece.SentencePieceProcessor(model_proto=without_normalizer(model))
        names = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        byte = [self.sp.is_byte(i) for i in range(len(names))]
        self.n_bytes = np.array([1 if b else len(n.encode()) for n, b in zip(names, byte, strict=True)], np.int64)

    def ids(self, normal: list[str]) -> list[np.ndarray]:
        """Ids of normalised texts, without begin and end ids."""
        return [np.array(x, "<u4") for x in self.raw.encode(normal, num_threads=1)]
