"""Packing of token sequences by non-negative least squares over length combinations.

Every document is cut at multiples of the window; full pieces fill a window alone.
The rest, at most one shorter piece a document, is known to the planner only as a
histogram of lengths, which has no more entries than the window whatever the corpus.
Combinations of two or three lengths that fill a window are the columns of a matrix;
non-negative least squares gives how often to use each so that the columns add up to
the histogram. Rounded down, they leave few pieces, which are packed greedily. Pieces
of one length are interchangeable: a piece finds its place from its rank among them.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator, Mapping
from functools import lru_cache
from struct import pack as pack_ints

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from ..sources.storage import pin
from .arrow import BLOCK_ROWS
from .pieces import Pieces

_PARTNERS, _STEPS = 8, 400


@lru_cache(maxsize=4)
def library_ids(path: str) -> Pieces:
    """Ids by the tokenizer library, without truncation or padding; a worker process loads it once."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task has one core
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()

    def encode_all(texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), 2048):  # the library's results are far larger than their ids
            found = library.encode_batch_fast(texts[at : at + 2048], add_special_tokens=False)
            out += [pack_ints(f"<{len(ids)}I", *ids) for ids in (f.ids for f in found)]
        return out

    # A byte-level vocabulary writes each byte as one character. Added tokens stand for no bytes of a piece.
    vocabulary = library.get_vocab(with_added_tokens=True)
    added = [t.content for t in library.get_added_tokens_decoder().values()]
    widths = np.zeros(max(vocabulary.values(), default=-1) + 1, dtype=np.int64)
    for token, n in vocabulary.items():
        widths[n] = 0 if token in added else len(token)
    return Pieces(encode_all, added, widths)


def combinations(lengths: np.ndarray, window: int, slack: int) -> list[tuple[int, ...]]:
    """Two or three of the ascending lengths whose sum lies within `slack` below the window; a few third parties for each first."""
    found = set()
    for a in lengths.tolist():
        room = window - a
        fitting = lengths[lengths <= room]
        if not len(fitting):
            continue
        if window - a - fitting[-1] <= slack:
            found.add(tuple(sorted((a, int(fitting[-1])))))
        for b in fitting[np.unique(np.linspace(0, len(fitting) - 1, _PARTNERS).astype(int))].tolist():
            thirds = lengths[lengths <= room - b]
            if len(thirds) and room - b - thirds[-1] <= slack:
                found.add(tuple(sorted((a, b, int(thirds[-1])))))
    return sorted(found)


def repeat_counts(columns: list[tuple[int, ...]], histogram: np.ndarray) -> np.ndarray:
    """Non-negative least squares: how often to use each column so that they add up to the histogram.

    Accelerated projected gradient; a column has at most three entries, so a step is a few sums.
    """
    owner = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    entry = np.array([x for c in columns for x in c])
    size = len(histogram)
    degree = np.bincount(entry, minlength=size)
    # The largest row sum of A times its largest column sum bounds the largest eigenvalue of A'A.
    step = 1.0 / max(1, degree.max() * 3)
    x = ahead = np.zeros(len(columns))
    momentum = 1.0
    for _ in range(_STEPS):
        residual = np.bincount(entry, weights=ahead[owner], minlength=size) - histogram
        new = np.maximum(ahead - step * np.bincount(owner, weights=residual[entry], minlength=len(columns)), 0)
        following = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        ahead = new + (momentum - 1) / following * (new - x)
        x, momentum = new, following
    return x


def plan(histogram: Mapping[int, int], window: int, slack: int = 0) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences follow each; together they use every piece once."""
    left = np.zeros(window + 1, dtype=np.int64)
    for length, count in histogram.items():
        left[length] = count
    patterns = [((window,), int(left[window]))] if left[window] else []
    left[window] = 0
    columns = combinations(np.flatnonzero(left), window, slack)
    if columns:
        times = repeat_counts(columns, left.astype(float))
        for n in np.argsort(-times, kind="stable").tolist():
            lengths, needs = np.unique(columns[n], return_counts=True)
            count = int(min(np.floor(times[n] + 1e-6), (left[lengths] // needs).min()))
            if count:
                patterns.append((tuple(sorted(columns[n], reverse=True)), count))
                left[lengths] -= count * needs
    while left.any():  # each turn uses up at least one length
        room, taken = window, []
        here = left.copy()
        while room and len(fits := np.flatnonzero(here[: room + 1])):
            longest = int(fits[-1])
            taken.append(longest)
            here[longest] -= 1
            room -= longest
        lengths, needs = np.unique(taken, return_counts=True)
        count = int((left[lengths] // needs).min())
        patterns.append((tuple(taken), count))
        left[lengths] -= count * needs
    return patterns


def placements(patterns: list[tuple[tuple[int, ...], int]], window: int) -> dict[int, np.ndarray]:
    """For each length, runs of ranks in order: first rank, pieces a sequence, first sequence, offset of the first."""
    used = np.zeros(window + 1, dtype=np.int64)
    out: dict[int, list] = {}
    sequence = 0
    for lengths, count in patterns:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            each = lengths.count(length)
            out.setdefault(length, []).append((int(used[length]), each, sequence, offset))
            used[length] += each * count
            offset += each * length
        sequence += count
    return {length: np.array(rows, dtype=np.int64) for length, rows in out.items()}


_PIECE = "part int, local_rank bigint, doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pieces(docs: DataFrame, vocabulary: str, window: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """The pieces of every document, numbered within their task and length."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = StructType.fromDDL(_PIECE.format(kind=kind))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(schema)
        part, ranks, e = TaskContext.get().partitionId(), np.zeros(window + 1, dtype=np.int64), library_ids(vocabulary)
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                keys, texts = (c.to_pylist() for c in batch.slice(at, BLOCK_ROWS).columns)
                rows = []
                for key, ids in zip(keys, e.encode([t or "" for t in texts]), strict=True):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        own = ids[4 * start : 4 * (start + window)]
                        length = len(own) // 4
                        rows.append((part, int(ranks[length]), key, start, length, zlib.crc32(own), total))
                        ranks[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)

    return docs.select(id_col, text_col).mapInArrow(task, schema)


def pack(
    docs: DataFrame, vocabulary: str, *, window: int = 1024, end_id: int = 0, slack: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone. Repeated rows and rows without an id are packed each
    for itself; an empty table gives no rows. The plan, on the driver, has at most a few entries for
    each length and pattern; ranks come from counts per task and length.
    """
    found = pin(pieces(docs, vocabulary, window, end_id, id_col, text_col))
    counts = found.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placed = placements(plan(histogram, window, slack), window)
    ranked = found.join(firsts, ["part", "length"]).withColumn("rank", F.col("first") + F.col("local_rank"))
    kind = docs.schema[id_col].dataType.simpleString()
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    schema = StructType.fromDDL(f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(schema)
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for one in np.unique(length).tolist():
                here = np.flatnonzero(length == one)
                run = placed[one][np.searchsorted(placed[one][:, 0], rank[here], side="right") - 1]
                k = rank[here] - run[:, 0]
                sequence[here] = run[:, 2] + k // run[:, 1]
                offset[here] = run[:, 3] + k % run[:, 1] * one
            arrays = [batch.column(c) for c in columns] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, target, strict=True)], schema=target)

    return ranked.select(*columns, "rank").mapInArrow(place, schema)
