"""Byte-level BPE by prefix dynamic programming, with exact appends and re-encoding near edits."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from trendloom.llm.common import bounded_batches

#: Entries that a worker's caches hold; of pieces, half are kept while the other half fills again.
CACHE_PIECES, CACHE_PAIRS = 400_000, 600_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, of a file with a base64 token and its rank in each line."""
    pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class PrefixState:
    """The encoding of a growing byte string: for each prefix, its last token.

    ``last[i]`` is the one token that ends the encoding of the first i bytes; walking back
    from the end by token lengths gives the whole encoding, so appending bytes never
    touches what is stored, and cutting off the end is cutting the list.
    """

    def __init__(self, codec: Codec, data: bytes = b""):
        self.codec, self.data, self.last = codec, bytearray(), [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Extends the string; costs the new bytes only."""
        start, c = len(self.data), self.codec
        self.data += more
        base = max(0, start - c.longest)
        c.extend(self.last, self.data[base:].decode("latin-1"), base)
        if len(self.last) <= len(self.data):
            raise ValueError(f"byte {self.data[len(self.last) - 1]} has no token")

    def truncate(self, size: int) -> None:
        """Drops all bytes from ``size`` on."""
        del self.data[size:]
        del self.last[size + 1 :]

    def replace(self, begin: int, end: int, new: bytes) -> None:
        """Puts ``new`` in place of bytes begin..end.

        Prefixes before the edit stay. Behind it, bytes are appended again until the last
        tokens of ``longest`` prefixes in a row are the old ones; from there on the old
        tokens hold, as each depends on no more than those.
        """
        tail, old = bytes(self.data[end:]), self.last[end + 1 :]
        self.truncate(begin)
        self.append(new)
        same, need = 0, self.codec.longest
        for i in range(len(tail)):
            self.append(tail[i : i + 1])
            same = same + 1 if self.last[-1] == old[i] else 0
            if same >= need:
                self.data += tail[i + 1 :]
                self.last += old[i + 1 :]
                break

    def ids(self) -> list[int]:
        """The encoding of the whole string."""
        return self.codec.walk(self.last)


class Codec:
    """A vocabulary with its pattern; encodes as the tiktoken library does, without special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.lengths = {i: len(t) for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        # White space is Unicode's; the regex library's \s has four control characters more.
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.finder = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.finder.add_word(t.decode("latin-1"), i)
        self.finder.make_automaton()
        self._shift = max(1, max(self.tokens, default=0).bit_length())
        self._pairs: dict[int, bool] = {}
        self._sound: dict[int, bool] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._earlier: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """BPE as defined: joins the leftmost pair of least rank until none is left. For short pieces."""
        none, get = 1 << 60, self.ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        joined = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while joined and (rank := min(joined)) != none:
            at = joined.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joined[at]
            if at < len(joined):
                joined[at] = get(parts[at] + parts[at + 1], none)
            if at:
                joined[at - 1] = get(parts[at - 1] + parts[at], none)
        return [self.ranks[p] for p in parts]

    def sound(self, token: int) -> bool:
        """Whether merging the token's bytes gives the token."""
        if token not in self._sound:
            self._sound[token] = self.merge(self.tokens[token]) == [token]
        return self._sound[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b gives just a and b."""
        key = a << self._shift | b
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) >= CACHE_PAIRS:
                self._pairs.clear()
            found = self._pairs[key] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return found

    def extend(self, last: list[int], text: str, base: int = 0) -> None:
        """Appends the last tokens of the prefixes beyond those in ``last``; text holds the bytes from ``base`` on, one a character."""
        lengths, pairs, shift = self.lengths, self._pairs, self._shift
        n = len(last)
        base += 1
        for at, token in self.finder.iter(text):  # tokens by their ends, longer ones first
            at += base
            if at < n:
                continue  # this prefix has its token
            if at > n:
                return
            before = last[at - lengths[token]]
            if before < 0:
                fits = self.sound(token)
            else:
                fits = pairs.get(before << shift | token)
                if fits is None:
                    fits = self.compatible(before, token)
            if fits:
                last.append(token)
                n += 1

    def walk(self, last: list[int]) -> list[int]:
        """The tokens of the string whose prefixes' last tokens are given."""
        out, at, lengths = [], len(last) - 1, self.lengths
        while at:
            token = last[at]
            out.append(token)
            at -= lengths[token]
        out.reverse()
        return out

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """One match of the pattern: a token as it stands, else by prefixes."""
        found = self._pieces.get(piece)
        if found is None:
            found = self._earlier.get(piece)
            if found is None:
                data = piece.encode("utf-8")
                whole = self.ranks.get(data)
                if whole is not None:
                    found = (whole,)
                else:
                    last = [-1]
                    self.extend(last, data.decode("latin-1"))
                    if len(last) <= len(data):
                        raise ValueError(f"no token ends at byte {len(last)} of {data!r}")
                    found = tuple(self.walk(last))
            if len(piece) <= 64:
                if len(self._pieces) >= CACHE_PIECES // 2:
                    self._earlier = dict(self._pieces)
                    self._pieces.clear()
                self._pieces[piece] = found
        return found

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; lone surrogates, which UTF-8 can't hold, count as U+FFFD."""
        try:
            text.encode("utf-8")
        except UnicodeEncodeError:
            text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        cached, encode, out = self._pieces.get, self.encode_piece, []
        for piece in self.pattern.findall(text):
            out += cached(piece) or encode(piece)
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.tokens.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a vocabulary file, which has to be at the same path on every machine."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(read_ranks(path), pattern)
    return _codecs[path, pattern]


def encode_table(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every row of docs, text encoded whole and decoded again.

    A null or empty text has no tokens and the digests of nothing. Long texts are encoded whole,
    one after the other. A vocabulary that lacks a byte of a text is an error. Repeated rows give
    the same row each; other columns are ignored whatever their names; an empty table gives an
    empty one.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    extra = ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        name = {i: str(i) for i in c.tokens}
        for b in batches:
            n, a, d, kept = [], [], [], []
            for text in b.column(1).to_pylist():
                ids = c.encode(text or "")
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(name.__getitem__, ids)).encode()).hexdigest())
                d.append(hashlib.sha256(c.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(ids)
            out = {"doc_id": b.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(d, pa.string())}
            if with_ids:
                out["ids"] = pa.array(kept, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
