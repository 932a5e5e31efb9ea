"""Streaming BPE: a bounded-lookahead transducer to ids and an incremental decoder back.

Two facts carry the encoder. A sequence of tokens is the encoding of its bytes exactly
when every two neighbours are the encoding of their own bytes; so the last token of each
prefix is found from the last tokens of shorter prefixes, byte by byte. And text changes
tokens on its left only through a chain of merges, whose reach the merge list bounds (the
sufficient lookahead); so a token that ends further than that from the end of what was read
is stable and leaves. Memory holds the unstable end only.
"""

from __future__ import annotations

import codecs
import functools
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fovea.llm.tokens import BYTE_BPE, ByteBpe, Generations, byte_bpe

_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Pre-tokens whose ids a worker remembers, per generation.
CACHE_ENTRIES = 400_000
#: Pair verdicts a worker remembers.
PAIR_ENTRIES = 1_000_000


class MergeTable:
    """The merge list, and what follows from it."""

    def __init__(self, vocabulary: ByteBpe):
        self.bytes_of, self.id_of = vocabulary.bytes_of, vocabulary.id_of
        self.rank = {pair: r for r, pair in enumerate(vocabulary.merges)}
        self.merged = [self.id_of[self.bytes_of[a] + self.bytes_of[b]] for a, b in vocabulary.merges]
        self.halves = {m: pair for m, pair in zip(self.merged, vocabulary.merges)}
        self.longest = max(map(len, self.bytes_of.values()))
        self.pairs: dict[tuple[int, int], bool] = {}
        # Sizes of the tokens that end in the same two bytes, longest first.
        sizes: dict[bytes, set[int]] = {}
        for token in self.id_of:
            if len(token) > 1:
                sizes.setdefault(token[-2:], {1}).add(len(token))
        self.sizes = {end: sorted(found, reverse=True) for end, found in sizes.items()}

    def apply(self, data: bytes) -> list[int]:
        """The merge list applied by definition: the earliest merge first, from the left."""
        ids = [self.id_of[data[i : i + 1]] for i in range(len(data))]
        while len(ids) > 1:
            ranks = [self.rank.get(p, -1) for p in zip(ids, ids[1:])]
            best = min((r for r in ranks if r >= 0), default=-1)
            if best < 0:
                break
            a, b = next(p for p in zip(ids, ids[1:]) if self.rank.get(p, -1) == best)
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and ids[i] == a and ids[i + 1] == b:
                    out.append(self.merged[best])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def may_follow(self, left: int, right: int) -> bool:
        """Is (left, right) the encoding of its own bytes?"""
        verdict = self.pairs.get((left, right))
        if verdict is None:
            if len(self.pairs) >= PAIR_ENTRIES:
                self.pairs.clear()
            verdict = self.pairs[(left, right)] = self._kept_apart(left, right)
        return verdict

    def _kept_apart(self, left: int, right: int) -> bool:
        """Replays only the merges on the two sides of the border, latest first.

        The border survives if at no time a merge across it comes before the next merge
        that builds either side; on equal terms the one further left goes first.
        """
        bound = len(self.rank)
        while True:
            across = self.rank.get((left, right))
            if across is not None and across < bound:
                return False
            made_left = self.rank[self.halves[left]] if left in self.halves else -1
            made_right = self.rank[self.halves[right]] if right in self.halves else -1
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right:
                bound, left = made_left, self.halves[left][1]
            else:
                bound, right = made_right + 1, self.halves[right][0]

    @functools.cached_property
    def lookahead(self) -> int:
        """Bytes past a token's end after which nothing can change it any more.

        Text further right reaches back only through a chain of merges, each earlier in the
        list than the one it disturbs and starting on the right edge of that one's right
        half. The longest such chain, plus one token that may still grow, is enough.
        """
        reach_from: dict[int, int] = {}
        longest = 0
        for left, right in self.rank:
            edge, reach = right, reach_from.get(right, 0)
            while edge in self.halves:
                edge = self.halves[edge][1]
                reach = max(reach, reach_from.get(edge, 0))
            longest = max(longest, reach)
            mine = len(self.bytes_of[right]) + reach
            reach_from[left] = max(reach_from.get(left, 0), mine)
        return longest + self.longest


class Transducer:
    """Feed bytes of one pre-token; ids come out as soon as they are stable."""

    def __init__(self, table: MergeTable):
        self.table = table
        self.tail = b""  # bytes since the last stable border
        self.last: list[int] = [-1]  # last token of the encoding of each prefix of tail
        self.before = -1  # the token left of tail

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        step = self.table.lookahead
        for i in range(0, len(data), step):
            self._extend(data[i : i + step])
            if len(self.tail) > 2 * step:
                out += self._stable()
        return out

    def finish(self) -> list[int]:
        out = self._path(len(self.tail))
        self.tail, self.last, self.before = b"", [-1], -1
        return out

    def _extend(self, data: bytes) -> None:
        tail, last, table = self.tail + data, self.last, self.table
        id_of, pairs, may_follow, sizes, single = table.id_of, table.pairs, table.may_follow, table.sizes, [1]
        for end in range(len(self.tail) + 1, len(tail) + 1):
            for size in sizes.get(tail[end - 2 : end], single) if end > 1 else single:
                start = end - size
                if start < 0:
                    continue
                token = id_of.get(tail[start:end])
                if token is None:
                    continue
                left = last[start] if start else self.before
                if left == -1:
                    if start:
                        continue  # no encoding ends there
                    good = True
                else:
                    good = pairs.get((left, token))
                    if good is None:
                        good = may_follow(left, token)
                if good:
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        self.tail = tail

    def _path(self, end: int) -> list[int]:
        out = []
        while end:
            out.append(self.last[end])
            end -= len(self.table.bytes_of[self.last[end]])
        return out[::-1]

    def _stable(self) -> list[int]:
        """Tokens that end at least the sufficient lookahead before the end of what was read."""
        path, border = self._path(len(self.tail)), len(self.tail)
        while path and border > len(self.tail) - self.table.lookahead:
            border -= len(self.table.bytes_of[path.pop()])
        if path:
            self.before = path[-1]
            self.tail, self.last = self.tail[border:], [-1, *self.last[border + 1 :]]
        return path


class TextMachine:
    """Decoder: ids in, text out; bytes of an unfinished character wait for the rest."""

    def __init__(self, vocabulary: ByteBpe):
        self.decoded = vocabulary.decoded
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, data: bytes) -> str:
        return self.machine.decode(data)

    def feed_ids(self, ids) -> str:
        return self.feed(b"".join(map(self.decoded.__getitem__, ids)))

    def finish(self) -> str:
        return self.machine.decode(b"", final=True)


class StreamCodec:
    """Ids of a text pre-token by pre-token, in constant memory besides bounded caches."""

    def __init__(self, vocabulary: ByteBpe):
        self.vocabulary, self.table = vocabulary, merge_table_of(vocabulary)
        self.seen = Generations(self._entry, CACHE_ENTRIES)

    def encode_pretoken(self, pretoken: str) -> list[int]:
        if pretoken in self.vocabulary.specials:
            return [self.vocabulary.specials[pretoken]]
        transducer = Transducer(self.table)
        return transducer.feed(pretoken.encode()) + transducer.finish()

    def _entry(self, pretoken: str) -> tuple[int, str, bytes]:
        ids = self.encode_pretoken(pretoken)
        return len(ids), ",".join(map(str, ids)), b"".join(map(self.vocabulary.decoded.__getitem__, ids))

    def ids(self, text: str):
        for pretoken in self.vocabulary.pretokens(text):
            yield from self.encode_pretoken(pretoken)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the decimal ids joined by commas, SHA-256 of the text decoded from them."""
        n, ids_hash, text_hash, machine, comma = 0, hashlib.sha256(), hashlib.sha256(), TextMachine(self.vocabulary), ""
        for step in self.vocabulary.pretoken_parts(text):
            if not step:
                continue
            counts, decimals, pieces = zip(*map(self.seen.__getitem__, step))
            n += sum(counts)
            ids_hash.update((comma + ",".join(decimals)).encode())
            text_hash.update(machine.feed(b"".join(pieces)).encode())
            comma = ","
        text_hash.update(machine.finish().encode())
        return n, ids_hash.hexdigest(), text_hash.hexdigest()


@functools.lru_cache(maxsize=4)
def merge_table_of(vocabulary: ByteBpe) -> MergeTable:
    return MergeTable(vocabulary)


@functools.lru_cache(maxsize=2)
def stream_codec(name: str) -> StreamCodec:
    """One per worker process: pre-tokens seen by a task are known to the next one."""
    return StreamCodec(byte_bpe(name))


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = BYTE_BPE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row.

    Null and empty texts have no ids; both digests are then of the empty string. Repeated
    rows give repeated results, null ids stay null, other columns are not read.
    """

    def run(batches):
        codec = stream_codec(vocabulary)
        for batch in batches:
            out = [(i, *codec.digest(t or "")) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _DIGESTS)
