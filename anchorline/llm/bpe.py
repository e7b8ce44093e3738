"""Byte-level BPE as a bounded-lookahead streaming transducer, and its inverse.

A sequence of tokens is the encoding of its text exactly if each pair of neighbours is
the encoding of the two tokens' joint text. So every prefix of a pre-token has one last
token, found from the prefixes before it. All encodings of longer texts pass through one
of the last ``longest`` positions; tokens before the latest boundary that all of those
share can never change, and are emitted. The merge list bounds how far such a boundary
can lie behind (``lookahead``), so memory is constant however long a pre-token is.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Chunker
from .common import slices

#: The published split pattern of this vocabulary family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Marks that are pre-tokens of their own after a letter.
MARKS = frozenset(".,:;!?")
#: Words up to so many letters are looked up without the mark after them.
WORD, NONE = 64, -1


def byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: printable Latin-1 stands for itself, other bytes for letters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Token bytes, ids and merges of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        to_bytes = lambda token: bytes(map(letters.__getitem__, token))
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {to_bytes(t): k for t, k in spec["model"]["vocab"].items() if t not in self.specials}
        self.merges = [tuple(map(to_bytes, m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"]]
        self.rank = {pair: k for k, pair in enumerate(self.merges)}
        self.texts: list[bytes] = [b""] * (1 + max([*self.ids.values(), *self.specials.values()]))
        for token, k in self.ids.items():
            self.texts[k] = token
        for token, k in self.specials.items():
            self.texts[k] = token.encode()
        self.longest = max(map(len, self.ids))
        self.sizes = list(map(len, self.texts))
        self.lookahead = self._chain() * self.longest
        self.fits: dict[int, bool] = {}
        self.made: dict[bytes, tuple[int, bytes, bytes]] = {}  # token -> the one merge that makes it
        for k, (left, right) in enumerate(self.merges):
            self.made.setdefault(left + right, (k, left, right))
        self.one_way = len(self.made) == len(self.merges)
        self.tokens = ahocorasick.Automaton()  # its letters are bytes
        reached: set[bytes] = set()
        for token, k in sorted(self.ids.items(), key=lambda x: len(x[0])):
            if self._reached(token, reached):
                reached.add(token)
                self.tokens.add_word(token.decode("latin-1"), (k, len(token)))
        self.tokens.make_automaton()

    def _chain(self) -> int:
        """Longest chain of merges of rising rank, each taking as its right part what the one before takes as its left part.

        A new byte disturbs an earlier token only by such a chain: a merge takes a neighbour's part away, which leaves
        that neighbour's other part free for a later merge further left.
        """
        best: dict[bytes, int] = {}
        for left, right in self.merges:
            best[left] = max(best.get(left, 0), 1 + best.get(right, 0))
        return 1 + max(best.values(), default=0)

    def merged(self, data: bytes) -> list[bytes]:
        """The encoding by its definition: apply the earliest merge of the list that applies, leftmost first."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            low = min(range(len(parts) - 1), key=lambda k: self.rank.get((parts[k], parts[k + 1]), len(self.rank)))
            pair = parts[low], parts[low + 1]
            if pair not in self.rank:
                break
            out, k = [], 0
            while k < len(parts):
                if k + 1 < len(parts) and (parts[k], parts[k + 1]) == pair:
                    out.append(parts[k] + parts[k + 1])
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return parts

    def neighbours(self, before: int, token: int) -> bool:
        """Whether two tokens are the encoding of their joint text; remembered, boundedly."""
        if len(self.fits) >= 1 << 19:
            self.fits.clear()
        left, right = self.texts[before], self.texts[token]
        known = self.fits[before << 32 | token] = self._apart(left, right) if self.one_way else self.merged(left + right) == [left, right]
        return known

    def _reached(self, token: bytes, reached: set[bytes]) -> bool:
        """Whether a token is the encoding of its text; only such ones are ever emitted."""
        if len(token) < 2 or not self.one_way:
            return self.merged(token) == [token]
        if token not in self.made:
            return False
        _, left, right = self.made[token]
        return left in reached and right in reached and self._apart(left, right, True)

    def _apart(self, left: bytes, right: bytes, inside: bool = False) -> bool:
        """No merge joins a part at the end of ``left`` with one at the start of ``right`` while both exist; ``inside``: but for that of both as they are."""
        never = len(self.merges)
        ends, x, until = [], left, never
        while x:
            ends.append((x, until))
            until, _, x = self.made.get(x, (never, b"", b""))
        y, until = right, never
        while y:
            for x, x_until in ends:
                if (at := self.rank.get((x, y), never)) < x_until and at <= until and at < never and not (inside and x == left and y == right):
                    return False
            until, y, _ = self.made.get(y, (never, b"", b""))
        return True


class Transducer:
    """Push bytes of one pre-token, get the ids that no later byte can change; ``finish`` gives the rest.

    An automaton of all tokens names those that end at each byte, longest first; the first that suits the last
    token before it is the last token of the text up to there.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.reset()

    def reset(self) -> None:
        self.before: int | None = None  # last token emitted
        self.last: list[int] = []  # last token of each prefix behind it
        self.emitted, self.fresh = 0, True

    def push(self, data: bytes) -> list[int]:
        out: list[int] = []
        step = self.v.lookahead
        for at in range(0, len(data), step):
            self._extend(data[at : at + step].decode("latin-1"))
            if len(self.last) > step:
                out += self._emit(self._settled())
        return out

    def finish(self) -> list[int]:
        out = self._emit(len(self.last))
        self.reset()
        return out

    def _extend(self, more: str) -> None:
        if self.fresh:
            self.found, self.fresh = self.v.tokens.iter(more), False
        else:
            self.found.set(more, False)
        last, fits, emitted = self.last, self.v.fits, self.emitted
        known = emitted + len(last)
        for end, (token, size) in self.found:
            if end < known:
                continue
            start = end + 1 - size - emitted
            before = last[start - 1] if start > 0 else self.before if start == 0 else NONE
            if before is None or before != NONE and ((good := fits.get(before << 32 | token)) or good is None and self.v.neighbours(before, token)):
                last.append(token)
                known += 1

    def _settled(self) -> int:
        """The latest boundary on the way to every position that a longer text can go on from."""
        n, size = len(self.last), self.v.sizes
        heads = set(range(max(0, n - self.v.longest + 1), n + 1))
        while len(heads) > 1:
            top = max(heads)
            heads.remove(top)
            heads.add(top - size[self.last[top - 1]] if top else 0)
        return heads.pop()

    def _emit(self, upto: int) -> list[int]:
        out, at, last, size = [], upto, self.last, self.v.sizes
        while at:
            out.append(last[at - 1])
            at -= size[out[-1]]
        if out:
            self.before, self.last, self.emitted = out[0], last[upto:], self.emitted + upto
        out.reverse()
        return out


class Codec:
    """Whole texts to ids and back, in blocks."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.split = regex.compile(PATTERN)
        self.transducer = Transducer(self.v)
        self.chunks = Chunker(self.packed, {k: array("I", [i]).tobytes() for k, i in self.v.specials.items()})
        self.decimal = [str(k) for k in range(len(self.v.texts))]

    def packed(self, chunk: str) -> bytes:
        """Packed ids of a chunk. A word and the one mark after it are pre-tokens of their own, so the word is looked up without it."""
        word = chunk[1:]
        if word[-1:] in MARKS and word[:-1].isalpha() and chunk[0] == " " and len(word) <= WORD:
            return self.chunks.spaced[word[:-1]] + array("I", self.one(word[-1])).tobytes()
        return array("I", self.stream(chunk)).tobytes()

    def one(self, part: str) -> list[int]:
        """Ids of one pre-token."""
        ids = self.transducer.push(part.encode("utf-8", "surrogatepass"))
        return ids + self.transducer.finish()

    def stream(self, text: str) -> Iterator[int]:
        """Ids of a text without special tokens, as soon as they are certain."""
        if text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
            yield from self.one(text)
            return
        for found in self.split.finditer(text):
            yield from self.one(found.group())

    def encode(self, text: str) -> Iterator[list[int]]:
        for block in self.chunks.blocks(text):
            yield np.frombuffer(block, "<u4").tolist()

    def decode(self, blocks: Iterable[list[int]]) -> Iterator[str]:
        """Byte-to-text state machine: bytes of an unfinished character wait for the next block."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in blocks:
            yield state.decode(b"".join(map(self.v.texts.__getitem__, ids)))
        yield state.decode(b"", True)


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def digest(text: str | None, path: str) -> tuple[int, str, str]:
    """Tokens, SHA-256 of the decimal ids and of the text decoded from them."""
    own = codec(path)
    n, ids_sha, text_sha = 0, hashlib.sha256(), hashlib.sha256()

    def seen() -> Iterator[list[int]]:
        nonlocal n
        for ids in own.encode(text or ""):
            if ids:
                ids_sha.update(("," * bool(n) + ",".join(map(own.decimal.__getitem__, ids))).encode())
                n += len(ids)
                yield ids

    for piece in own.decode(seen()):
        text_sha.update(piece.encode())
    return n, ids_sha.hexdigest(), text_sha.hexdigest()


def encode_texts(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``ids array<int>`` of each whole text; a null text has no ids. A kept column ``ids`` comes back as ``given_ids``."""
    names = ["given_ids" if c == "ids" else c for c in keep]

    def run(batches):
        own = codec(path)
        for part in slices(batches):
            ids = [[k for block in own.encode(t or "") for k in block] for t in part.column(part.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"])

    chosen = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col(text).cast("string").alias("_text"))
    return chosen.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]) + ", ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give the empty text, ids outside the vocabulary fail the row's task."""

    def run(batches):
        own = codec(path)
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(["".join(own.decode([x or []])) for x in part.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def query(docs: DataFrame, path: str) -> DataFrame:
    """Per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    Null and empty texts have no tokens and the digests of the empty string. Rows stay
    as many as they are, repeated rows included; a text is streamed in blocks of words.
    """

    def run(batches):
        for part in slices(batches):
            n, ids, text = zip(*(digest(t, path) for t in part.column(1).to_pylist()), strict=True) if part.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
