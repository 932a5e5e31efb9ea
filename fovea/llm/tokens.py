"""Public tokenizer vocabularies: pre-tokens, ids and their bytes, as the library gives them."""

from __future__ import annotations

import functools
import json
import os
import re
from array import array

import public_tokenizers
import regex
import sentencepiece
import tiktoken

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers import Tokenizer  # noqa: E402

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
#: Entries of a per-worker cache; texts repeat few strings often and many once.
CACHE_ENTRIES = 200_000
#: Characters per slice of a text.
SLICE_CHARS = 1 << 15
_BORDER = re.compile(r"(?<=\S) (?=\S)")
#: Longer strings are not cached.
CACHE_CHARS = 64


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file.

    Printable Latin-1 bytes stand for themselves, the rest take the code points from 256 up.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def slices(text: str, size: int = SLICE_CHARS):
    """The text in slices cut before single spaces between two other characters.

    Such a space always starts a pre-token, so the slices split as the whole does. A stretch
    without one stays whole.
    """
    start = 0
    while len(text) - start > size:
        cut = _BORDER.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


class _Known(dict):
    """Per character: does our pattern treat it as the library's does?

    The two carry different Unicode versions. A letter, number, space or other character
    splits the probe in four different ways, so equal splits mean equal classes.
    """

    def __init__(self, vocabulary: "ByteBpe"):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, char: str) -> bool:
        v, probe = self.vocabulary, f"a{char}{char}1"
        same = [m.span() for m in v.pattern.finditer(probe)] == [at for _, at in v.library.pre_tokenizer.pre_tokenize_str(probe)]
        self[char] = same = same and v.quick.encode_ordinary(probe) == v.library.encode(probe, add_special_tokens=False).ids
        return same


class ByteBpe:
    """A byte-level BPE vocabulary of the tokenizers library.

    ``quick`` merges by the ranks of the same vocabulary and gives the same ids several times
    faster; it is used on single pre-tokens of characters both sides class alike, everything
    else goes to the library.
    """

    def __init__(self, name: str):
        path = public_tokenizers.path(name)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        alphabet = byte_alphabet()
        self.bytes_of = {i: bytes(map(alphabet.__getitem__, t)) for t, i in spec["model"]["vocab"].items() if t not in self.specials}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        side = lambda t: self.id_of[bytes(map(alphabet.__getitem__, t))]
        self.merges = [(side(a), side(b)) for a, b in pairs]
        self.decoded = self.bytes_of | {i: t.encode() for t, i in self.specials.items()}
        self.quick = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.id_of, special_tokens={})
        self.known = _Known(self)

    def segments(self, text: str) -> list[str]:
        """The text cut around special strings, which stay as segments of their own."""
        if self.special_pattern is None or not self.special_pattern.search(text):
            return [text]
        return [s for s in self.special_pattern.split(text) if s]

    def is_plain(self, text: str) -> bool:
        return text.isascii() or all(map(self.known.__getitem__, set(text)))

    def pretokens(self, text: str):
        """Pre-tokens of the whole text in order; a special string is one of them."""
        for part in self.pretoken_parts(text):
            yield from part

    def pretoken_parts(self, text: str):
        """The pre-tokens of the whole text in lists of bounded length, in order."""
        for segment in self.segments(text):
            if segment in self.specials:
                yield [segment]
                continue
            for part in slices(segment):
                if self.is_plain(part):
                    yield self.pattern.findall(part)
                else:
                    yield [part[lo:hi] for _, (lo, hi) in self.library.pre_tokenizer.pre_tokenize_str(part)]

    def pretoken_list(self, text: str) -> list[str]:
        if self.is_plain(text) and not (self.special_pattern and self.special_pattern.search(text)):
            return self.pattern.findall(text)
        return list(self.pretokens(text))

    def ids(self, text: str) -> bytes:
        """Ids of any text as little-endian unsigned 32-bit numbers."""
        if len(text) <= CACHE_CHARS and self.is_plain(text) and not (self.special_pattern and self.special_pattern.search(text)):
            return array("I", self.quick.encode_ordinary(text)).tobytes()
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()


class Generations(dict):
    """A cache of two generations: what is used again survives, the rest goes; bounded."""

    def __init__(self, compute, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.compute, self.entries, self.old = compute, entries, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class WordIds:
    """Ids of whole texts, a word at a time.

    A single space between two non-space characters always starts a pre-token, so what
    stands between two such spaces is encoded the same in every text. A text with other
    white space around a space goes to the library as a whole.
    """

    def __init__(self, vocabulary: ByteBpe):
        self.vocabulary = vocabulary
        self.words = Generations(self._word)

    def _word(self, word: str):
        if not word or word[0].isspace() or word[-1].isspace():
            return 0  # not bytes: join refuses it and the text goes to the library
        return self.vocabulary.ids(" " + word)

    def __call__(self, text: str) -> bytes:
        head, *rest = text.split(" ")
        try:
            if head and head[-1].isspace() and rest:
                raise TypeError
            return (self.vocabulary.ids(head) if head else b"") + b"".join(map(self.words.__getitem__, rest))
        except TypeError:
            return self.vocabulary.ids(text)


@functools.lru_cache(maxsize=4)
def byte_bpe(name: str = BYTE_BPE) -> ByteBpe:
    """One per worker process."""
    return ByteBpe(name)


@functools.lru_cache(maxsize=4)
def sentence_pieces(name: str = PIECES) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
