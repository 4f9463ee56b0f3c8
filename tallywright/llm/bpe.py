"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For a byte string, the merge procedure gives each prefix exactly one last
token. That token is the only one ``t`` ending the prefix for which the last
token before ``t`` and ``t`` may stand side by side: no merge would ever cross
their border. So one array, the last token of every prefix, holds the encodings
of all prefixes at once; an append only extends it, and an edit recomputes it
from the edited byte on, until nothing more changes.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from itertools import chain
from os.path import commonprefix

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallywright.llm.common import text_pass

#: Bytes of pieces with their ids that a worker keeps, and pairs of tokens; beyond it what is not in use goes, and pairs start anew.
CACHED_BYTES, CACHED_PAIRS = 128 << 20, 500_000
#: Bytes that an entry of the store of pieces takes besides its characters and ids.
ENTRY_BYTES = 250

#: Characters on which the standard library's classes agree with the Unicode
#: properties that a splitting pattern names: ASCII and Latin letters.
_PLAIN = re.compile("[^\t-\r -~À-ÖØ-öø-ž]")


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and a number."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class PrefixEncoding:
    """The last token of every prefix of one piece, kept up to date under appends and edits."""

    def __init__(self, codec: BytePairCodec, data: bytes = b"") -> None:
        self.codec, self.data, self.last = codec, b"", []
        self.append(data)

    def append(self, data: bytes) -> None:
        """Extend by ``data``; earlier entries stay as they are."""
        begin = len(self.data)
        self.data += data
        self.codec.extend(self.data, self.last, begin)

    def replace(self, start: int, stop: int, data: bytes) -> None:
        """Put ``data`` in place of ``[start:stop]``; prefixes up to ``start`` keep their entries.

        Behind the edit, entries are recomputed until as many in a row as the
        longest token has bytes equal the old ones: from there on nothing that
        a later entry depends on has changed.
        """
        old, shift = self.last[stop:], start + len(data)
        self.data = self.data[:start] + data + self.data[stop:]
        del self.last[start:]
        self.codec.extend(self.data, self.last, start, shift)
        same = 0
        for i, token in enumerate(old):
            if same >= self.codec.longest:
                self.last.extend(old[i:])
                return
            self.codec.extend(self.data, self.last, shift + i, shift + i + 1)
            same = same + 1 if self.last[-1] == token else 0

    def ids(self, stop: int | None = None) -> list[int]:
        """The encoding of the first ``stop`` bytes (all by default)."""
        return self.codec.walk_back(self.last, len(self.data) if stop is None else stop)


class _Pieces(dict):
    """Ids by piece, filled as pieces are asked for.

    There are two generations. When this one holds half of ``CACHED_BYTES`` it
    becomes the old one, whose pieces come back when they are asked for again; so
    what is in use stays, and what is not goes.
    """

    def __init__(self, codec: BytePairCodec) -> None:
        super().__init__()
        self.codec, self.held, self.old = codec, 0, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        return self.put(piece, self.codec.encode_piece(piece) if ids is None else ids)

    def put(self, piece: str, ids: tuple[int, ...]) -> tuple[int, ...]:
        """Store ``ids``, unless they alone would be a large part of what may be held."""
        cost = ENTRY_BYTES + 4 * len(piece) + 8 * len(ids)
        if cost * 32 > CACHED_BYTES:
            return ids
        if 2 * (self.held + cost) > CACHED_BYTES:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self.held += cost
        self[piece] = ids
        return ids


class BytePairCodec:
    """Encodes and decodes by a table of ranks; ``pattern`` splits text into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.plain_pattern = plain_form(pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.beside: dict[int, bool] = {}
        self.pieces = _Pieces(self)
        #: Tokens that the merges of their own bytes end in; others never take part in an encoding but as a whole piece.
        self.usable = {token: rank for token, rank in ranks.items() if len(token) == 1 or self.split_of(rank)}
        #: The ends of those tokens, at which a search for longer tokens stops.
        self.tails = {token[i:] for token in self.usable for i in range(len(token))}

    def split_of(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte or one that no merge makes."""
        if token not in self.halves:
            data = self.bytes_of[token]
            self.halves[token] = None
            if len(data) > 1:
                # Only merges of a lower rank come before the one that makes the token.
                parts = [self.ranks[bytes([b])] for b in data]
                while len(parts) > 2:
                    merged = [(self.ranks.get(self.bytes_of[a] + self.bytes_of[b], token), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
                    rank, i = min(merged)
                    if rank >= token:
                        break
                    parts[i : i + 2] = [rank]
                self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[token]

    def may_touch(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` can end up as neighbours.

        Takes both apart from the border outwards, latest merge first. If at
        any time the two border parts have a merge of a lower rank than the
        next one on either side, that merge would have come first.
        """
        key = left << 32 | right
        if (known := self.beside.get(key)) is None:
            if len(self.beside) >= CACHED_PAIRS:
                self.beside.clear()
            known = self.beside[key] = self._touch(left, right)
        return known

    def _touch(self, left: int, right: int) -> bool:
        # A merge across the border beats those that come after it: on the left
        # the ones of an equal rank are done first, on the right after it.
        bound = float("inf")
        while True:
            across = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if across is not None and across < bound:
                return False
            a, b = self.split_of(left), self.split_of(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                bound, left = left, a[1]
            else:
                bound, right = right + 1, b[0]

    def extend(self, data: bytes, last: list[int], begin: int, stop: int | None = None) -> None:
        """Append to ``last`` the last token of every prefix longer than ``begin``, up to ``stop`` (all by default)."""
        token_of, known, tails = self.usable.get, self.beside.get, self.tails
        for end in range(begin + 1, (len(data) if stop is None else stop) + 1):
            start = end - 1
            tail = data[start:end]
            while True:
                token = token_of(tail)
                if token is not None:
                    if start == 0:
                        break
                    before = last[start - 1]
                    fits = known(before << 32 | token)
                    if self.may_touch(before, token) if fits is None else fits:
                        break
                start -= 1
                tail = data[start:end] if start >= 0 else None
                if tail not in tails:
                    raise ValueError(f"no token ends at byte {end}")
            last.append(token)

    def learn(self, pieces: set[str]) -> None:
        """Encode ``pieces`` into the store; in sorted order each shares its prefix's entries with the one before."""
        before, last = b"", []
        for piece in sorted(pieces):
            data = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(data)
            if whole is not None:
                self.pieces.put(piece, (whole,))
                continue
            same = len(commonprefix((before, data)))
            del last[same:]
            self.extend(data, last, same)
            self.pieces.put(piece, tuple(self.walk_back(last, len(data))))
            before = data

    def walk_back(self, last: list[int], stop: int) -> list[int]:
        """The tokens of the prefix of ``stop`` bytes, from the array of last tokens."""
        ids = []
        while stop:
            ids.append(last[stop - 1])
            stop -= len(self.bytes_of[ids[-1]])
        return ids[::-1]

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """The ids of one piece; a piece that is a token is that token."""
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        last: list[int] = []
        self.extend(data, last, 0)
        return tuple(self.walk_back(last, len(data)))

    def split(self, text: str) -> list[str]:
        """The pieces of ``text``."""
        if self.plain_pattern is not None and _PLAIN.search(text) is None:
            return self.plain_pattern.findall(text)
        return self.pattern.findall(text)

    def encode(self, text: str) -> list[int]:
        """The ids of ``text``, each piece encoded separately."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text; pieces that are new are learnt together."""
        split = [self.split(text) for text in texts]
        known, old = self.pieces, self.pieces.old
        fresh = {piece for pieces in split for piece in pieces if piece not in known and piece not in old}
        if fresh:
            self.learn(fresh)
        return [list(chain.from_iterable(map(known.__getitem__, pieces))) for pieces in split]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ``ids``."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


class EditableText:
    """A text with its pieces and ids; edits re-encode only the pieces near them."""

    def __init__(self, codec: BytePairCodec, text: str = "") -> None:
        self.codec, self.text = codec, text
        self.pieces = codec.split(text)

    def replace(self, start: int, stop: int, new: str) -> None:
        """Put ``new`` in place of ``text[start:stop]``.

        A piece depends on no character beyond the second after it, so pieces
        that end two characters before the edit stay. Splitting starts there,
        and stops where it meets an old border well behind the edit.
        """
        kept, at = 0, 0
        for piece in self.pieces:
            if at + len(piece) + 2 > start:
                break
            at += len(piece)
            kept += 1
        text = self.text[:start] + new + self.text[stop:]
        shift = len(new) - (stop - start)
        borders, place = {}, 0
        for i, piece in enumerate(self.pieces):
            if place >= stop:
                borders[place + shift] = i
            place += len(piece)
        fresh, rest = [], []
        for match in self.codec.pattern.finditer(text, at):
            if match.start() in borders and match.start() >= start + len(new):
                rest = self.pieces[borders[match.start()] :]
                break
            fresh.append(match.group())
        self.text, self.pieces = text, self.pieces[:kept] + fresh + rest

    def append(self, text: str) -> None:
        """Add ``text`` at the end."""
        self.replace(len(self.text), len(self.text), text)

    def ids(self) -> list[int]:
        """The ids of the whole text."""
        return list(chain.from_iterable(map(self.codec.pieces.__getitem__, self.pieces)))


def plain_form(pattern: str) -> re.Pattern | None:
    """The standard library's form of a pattern that uses no Unicode property but letters and numbers."""
    for a, b in ((r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)"), (r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d")):
        pattern = pattern.replace(a, b)
    try:
        return None if r"\p" in pattern else re.compile(pattern)
    except re.error:
        return None


@lru_cache(maxsize=2)
def _codec(file: str, pattern: str) -> BytePairCodec:
    with open(file, "rb") as f:
        return BytePairCodec(read_ranks(f.read()), pattern)


def encode_documents(docs: DataFrame, ranks_file: str, pattern: str, text: str = "text", keep: list[str] | None = None, outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """``docs`` with the encoding of ``text``, made in one pass without a shuffle.

    ``keep`` names the columns that stay (all by default; one that has the name
    of an output is left out). ``outputs`` may name

    - ``ids`` (array<int>): the token ids,
    - ``n_tokens`` (bigint): their number,
    - ``ids_sha256``, ``decoded_sha256``: lowercase hex of the decimal ids
      joined by commas, and of the bytes that decoding gives.

    ``ranks_file`` is sent to the executors with the job, so it needs to be
    readable by the driver only. A null text counts as empty and has no ids;
    repeated rows each get their row; an empty table gives an empty one.
    """
    docs.sparkSession.sparkContext.addFile(ranks_file)
    name = ranks_file.rsplit("/", 1)[-1]
    types = {"ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), "n_tokens": (T.LongType(), pa.int64()), "ids_sha256": (T.StringType(), pa.string()), "decoded_sha256": (T.StringType(), pa.string())}

    def work():
        codec = _codec(SparkFiles.get(name), pattern)
        decimal = {i: str(i) for i in codec.bytes_of} if "ids_sha256" in outputs else {}
        made = {
            "ids": lambda ids: ids,
            "n_tokens": len,
            "ids_sha256": lambda ids: hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest(),
            "decoded_sha256": lambda ids: hashlib.sha256(codec.decode(ids)).hexdigest(),
        }

        def encoded(texts: list[str]) -> list[list]:
            each = codec.encode_all(texts)
            return [list(map(made[o], each)) for o in outputs]

        return encoded

    return text_pass(docs, text, keep, [(T.StructField(o, types[o][0]), types[o][1]) for o in outputs], work)
