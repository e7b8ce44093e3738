"""Hierarchical multi-length packing of token streams.

Each task streams its documents in pools. Whole windows of the longest tier are cut off
first; what is left of a document is routed to the smallest tier that holds it. From the
longest left-over down, each opens a window of its tier, whose gap is filled with the
longest left-overs of shorter tiers that fit and closed by cutting the shortest one, so
that windows are full. Left-overs of an open window move on to the next pool; the last
ones of a task go into windows of falling powers of two. No row is shuffled.
"""

from __future__ import annotations

import bisect
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, Vocabulary
from .common import slices

#: Context sizes; the largest is the longest sequence.
TIERS = (128, 256, 512, 1024)
#: Training steps that sequences are dealt to, in equal numbers of each tier.
STEP_GROUPS = 64
#: Documents of a task that are packed together.
POOL_ROWS = 512
#: Sequence ids are the task's number times this, plus a count.
SEQUENCES_A_TASK = 1 << 40

#: Line feed, tab, printable ASCII, and letters and marks that have kept their class since early Unicode.
UNDISPUTED = re.compile("[\\n\\t -~\u00c0-\u01ff\u0391-\u03a1\u03a3-\u03c9\u0410-\u044f\u2010-\u2026\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*")

#: More white space in a row than the faster encoder's pattern matcher is trusted with.
LONG_GAP = re.compile("[\\n\\t ]{4096}")

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group int"


class Packer:
    """State of one task: left-overs as ``(length, order, doc, start)`` by length, and counts."""

    def __init__(self, task: int, tiers: tuple[int, ...], step_groups: int):
        self.tiers, self.groups, self.task = sorted(tiers), step_groups, task
        self.left: list[tuple[int, int, tuple, int]] = []
        self.order = self.sequences = 0
        self.dealt = {t: task + k for k, t in enumerate(self.tiers)}
        self.rows: list[tuple] = []

    def _close(self, tier: int, pieces: list[tuple[tuple, int, int]]) -> None:
        offset, number = 0, self.task * SEQUENCES_A_TASK + self.sequences
        group = self.dealt.get(tier, self.sequences) % self.groups
        if tier in self.dealt:
            self.dealt[tier] += 1
        self.sequences += 1
        for (doc_id, ids), start, length in pieces:
            self.rows.append((doc_id, start, length, ids[start : start + length].tobytes(), len(ids), number, offset, tier, group))
            offset += length

    def _put(self, doc: tuple, start: int, length: int) -> None:
        if length:
            self.order += 1
            bisect.insort(self.left, (length, self.order, doc, start), key=lambda x: x[:2])

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        doc, top, whole = (doc_id, ids), self.tiers[-1], len(ids) // self.tiers[-1]
        for k in range(whole):
            self._close(top, [(doc, k * top, top)])
        self._put(doc, whole * top, len(ids) - whole * top)

    def _fill(self, size: int) -> list[tuple[tuple, int, int]] | None:
        """Pieces of exactly ``size`` tokens, longest fitting left-overs first, the last one cut; None if there are too few."""
        pieces, gap = [], size
        while gap and self.left:
            at = bisect.bisect_right(self.left, gap, key=lambda x: x[0]) - 1
            length, _, doc, start = self.left.pop(max(at, 0))
            used = min(gap, length)
            pieces.append((doc, start, used))
            self._put(doc, start + used, length - used)
            gap -= used
        if gap:
            for doc, start, used in pieces:
                self._put(doc, start, used)
            return None
        return pieces

    def pack(self) -> None:
        """Fill windows, from the longest left-over down, while there is enough to fill one."""
        while self.left:
            tier = next(t for t in self.tiers if t >= self.left[-1][0])
            pieces = self._fill(tier)
            if pieces is None:
                return
            self._close(tier, pieces)

    def finish(self) -> None:
        total = sum(x[0] for x in self.left)
        while total:
            size = min(self.tiers[-1], 1 << (total.bit_length() - 1))
            self._close(size, self._fill(size))
            total -= size

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * 9
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])


@functools.cache
def library(path: str):
    """Tokenizer of the file, and tiktoken's encoder of the same vocabulary, merges and split pattern where one can be made."""
    import tiktoken
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    v = Vocabulary(path)
    ranks = {token: k for k, token in enumerate(v.texts) if k not in v.specials.values()}
    by_rank = all(v.ids[left + right] == 256 + k for k, (left, right) in enumerate(v.merges))
    return own, tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=dict(v.specials)) if by_rank else None


def token_array(text: str | None, path: str) -> np.ndarray:
    """Ids as the tokenizers library gives them, then 0. Texts of characters whose class no Unicode version disputes
    take the faster encoder, which gives the same ids (tested)."""
    own, fast = library(path)
    text, ids = text or "", None
    if fast is not None and UNDISPUTED.fullmatch(text) and not LONG_GAP.search(text):
        try:
            ids = fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # its pattern matcher gives up on some very long texts
            ids = None
    if ids is None:
        ids = own.encode(text, add_special_tokens=False).ids
    return np.append(np.asarray(ids, "<u4"), np.uint32(0)).astype("<u4", copy=False)


def pack_documents(docs: DataFrame, path: str, tiers: tuple[int, ...] = TIERS, step_groups: int = STEP_GROUPS, pool_rows: int = POOL_ROWS) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``: where each lies in its document and sequence, its ids
    (little-endian unsigned 32-bit), the tier and the step group of its sequence.

    A document's ids end with id 0, so null and empty texts are one token. Ties of length
    are taken in the order read; repeated rows are packed as documents of their own; an
    empty table gives no pieces. ``sequence_id`` holds the task's number: read ``docs``
    from files, so that a task done again sees the same rows in the same order.
    """

    def run(batches):
        packer = Packer(TaskContext.get().partitionId(), tiers, step_groups)
        for part in slices(batches, pool_rows):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                packer.add(doc_id, token_array(text, path))
                if len(packer.rows) >= 4096:
                    yield packer.batch()
            packer.pack()
            yield packer.batch()
        packer.finish()
        yield packer.batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def query(docs: DataFrame, path: str) -> DataFrame:
    """The digest of :func:`pack_documents` under its contract."""
    return pack_documents(docs, path).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")
