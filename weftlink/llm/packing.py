"""Hierarchical packing of token sequences into windows of several sizes.

Whole windows are cut off long documents first. The rest of each document is routed to
the smallest tier (context size) that holds it. Tiers are packed from the largest down:
a piece opens a window of its tier, the gap is filled with the largest shorter pieces
that fit, and the last of the gap by cutting one. What remains at the end of a block of
documents is laid on end and split at powers of two, so no window needs padding.
Windows are dealt to step groups in a back-and-forth order of size, which balances the
tokens of the groups.

Blocks are formed inside each task from a bounded number of tokens: nothing is
shuffled, and a retried task forms the same windows.

Defined results: a null or empty text is its end token alone; repeated rows are packed
each on its own; an empty table gives no pieces. Sequence ids are unique, not dense.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.llm.common import table
from weftlink.llm.tokens import encoder, vocabulary

END_ID = 1
TIERS = (2048, 1024, 512, 256)
#: Tokens that a task packs together.
BLOCK_TOKENS = 1 << 22
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step_group int"

Piece = tuple[int, int, int]  # length, document, start


def pack(lengths: Sequence[int], tiers: Sequence[int] = TIERS) -> list[list[Piece]]:
    """Windows of pieces for documents of these lengths; each window is full or a power of two long."""
    top = max(tiers)
    windows: list[list[Piece]] = []
    left: dict[int, list[Piece]] = {t: [] for t in tiers}
    rising = sorted(tiers)
    for doc, n in enumerate(lengths):
        start = 0
        while n - start >= top:
            windows.append([(top, doc, start)])
            start += top
        if n > start:
            left[next(t for t in rising if t >= n - start)].append((n - start, doc, start))
    for pieces in left.values():
        pieces.sort()
    for tier in reversed(rising):
        others = [t for t in reversed(rising) if t <= tier]
        own = left[tier]
        while own:
            window = [own.pop()]
            gap = tier - window[0][0]
            while gap:
                pool = next((left[t] for t in others if left[t] and left[t][0][0] <= gap), None)
                if pool is not None:
                    piece = pool.pop(bisect_right(pool, (gap, float("inf"), 0)) - 1)
                else:
                    pool = next((left[t] for t in reversed(others) if left[t]), None)
                    if pool is None:
                        break
                    size, doc, start = pool.pop(0)
                    piece = (gap, doc, start)
                    rest = (size - gap, doc, start + gap)
                    insort(left[next(t for t in rising if t >= rest[0])], rest)
                window.append(piece)
                gap -= piece[0]
            if gap:
                windows += _split(window)
            else:
                windows.append(window)
    return windows


def _split(pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces on end, split into windows whose sizes are the powers of two in their sum."""
    total, out, at = sum(p[0] for p in pieces), [], 0
    queue = list(pieces)
    for bit in reversed(range(total.bit_length())):
        size = total & (1 << bit)
        window = []
        while size:
            n, doc, start = queue[at]
            take = min(n, size)
            window.append((take, doc, start))
            size -= take
            if take == n:
                at += 1
            else:
                queue[at] = (n - take, doc, start + take)
        if window:
            out.append(window)
    return out


def step_groups(sizes: Sequence[int], groups: int) -> list[int]:
    """A group for each window, dealt from the largest down, to and fro."""
    out = [0] * len(sizes)
    for k, i in enumerate(sorted(range(len(sizes)), key=lambda i: -sizes[i])):
        turn, place = divmod(k, groups)
        out[i] = place if turn % 2 == 0 else groups - 1 - place
    return out


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tiers: Sequence[int] = TIERS, groups: int = 8, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece, see ``SCHEMA``. ``path``: a vocabulary file that every executor has."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(src.dtypes)["doc_id"]

    def flush(ids: list, tokens: list[np.ndarray], first: int) -> tuple[pa.RecordBatch, int]:
        windows = pack([len(t) for t in tokens], tiers)
        group = step_groups([sum(p[0] for p in w) for w in windows], groups)
        rows = []
        for k, window in enumerate(windows):
            offset, size = 0, sum(p[0] for p in window)
            for n, doc, start in window:
                crc = zlib.crc32(tokens[doc][start : start + n].astype("<u4").tobytes())
                rows.append((ids[doc], start, n, crc, len(tokens[doc]), first + k, offset, size, group[k]))
                offset += n
        columns = list(zip(*rows, strict=True))
        types = [out_type, *[pa.int64()] * 6, pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names), first + len(windows)

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    out_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        first = TaskContext.get().partitionId() << 40
        ids: list = []
        tokens: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                made = np.append(own.ids(text.as_py()), np.uint32(END_ID))
                ids.append(doc.as_py())
                tokens.append(made)
                held += len(made)
                if held >= block_tokens:
                    out, first = flush(ids, tokens, first)
                    yield out
                    ids, tokens, held = [], [], 0
        if ids:
            yield flush(ids, tokens, first)[0]

    return src.mapInArrow(packed, SCHEMA.replace("doc_id bigint", f"doc_id {kind}"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
