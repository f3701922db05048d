"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text: every byte adds its gear to the hash shifted
by four bits, so in 32 bits it depends on the last 8 bytes alone. A chunk ends where the
hash is the largest within REACH bytes on either side. Cuts follow content, so a passage
is cut alike wherever it stands, from at most REACH + 8 bytes after its begin to
REACH bytes before its end, and chunks vary little in length.

What is compared, by digest, are windows: the shortest stretches of adjacent chunks that
touch at least `min_words` words, from every chunk on and up to every chunk. The digest of a
window of more than LONG bytes is mixed from those of its chunks, so that each byte is hashed
a bounded number of times. A window is a
repeat if one earlier document, or an earlier place, holds it whole; the occurrence in the
document of the smallest id stays. Windows that overlap make one passage, and windows
side by side two, so every word of a passage lies in a stretch that one document holds:
common phrases stay, also where many follow each other. A passage that one document
holds whole is found whole, because all its windows are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import BLOCK_ROWS, WHITE, by_blocks, free_names, map_blocks

#: Bytes on either side among which a cut is the largest hash; chunks have about twice as many.
REACH = 16
#: Longest chunk, for stretches that repeat themselves and so have no largest hash.
MOST = 128
MIN_WORDS = 25
#: Bytes of a window that is hashed as it is.
LONG = 4096


def _gears() -> np.ndarray:
    """One gear a byte, from the byte's digest."""
    return np.array([xxhash.xxh3_64_intdigest(bytes([b])) >> 32 for b in range(256)], dtype=np.uint32)


_GEARS = _gears()
_IS_WHITE = np.zeros(256, dtype=bool)
_IS_WHITE[[ord(c) for c in WHITE]] = True


def _largest_before(values: np.ndarray, reach: int) -> np.ndarray:
    """Largest of the `reach` values (a power of two) before each."""
    largest = np.concatenate((np.zeros(1, dtype=values.dtype), values[:-1]))
    width = 1
    while width < reach:
        largest[width:] = np.maximum(largest[width:], largest[:-width])
        width *= 2
    return largest


def cuts(raw: np.ndarray) -> np.ndarray:
    """Ends of the chunks, as byte positions between characters."""
    if not len(raw):
        return np.empty(0, dtype=np.int64)
    rolled = _GEARS[raw]
    for back in (1, 2, 4):
        rolled[back:] += rolled[:-back] << np.uint32(4 * back)
    begins = (raw & 0xC0) != 0x80
    peak = (rolled > _largest_before(rolled, REACH)) & (rolled >= _largest_before(rolled[::-1], REACH)[::-1])
    wanted = np.flatnonzero(peak[:-1]) + 1
    out, last, size = [], 0, len(raw)
    for cut in [*wanted.tolist(), size]:
        while cut < size and not begins[cut]:
            cut += 1
        while cut - last > MOST:
            last += MOST
            while not begins[last]:
                last -= 1
            out.append(last)
        if cut > last:
            out.append(cut)
            last = cut
    return np.array(out, dtype=np.int64)


def _chunked(text: str) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, and of each chunk: end in bytes, end in characters, words begun so far, whether it starts inside a word."""
    data = text.encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, dtype=np.uint8)
    ends = cuts(raw)
    if not len(ends):
        return data, ends, ends, ends, ends.astype(bool)
    black = ~_IS_WHITE[raw]
    begun = np.cumsum(black & np.concatenate(([True], ~black[:-1])))
    characters = np.cumsum((raw & 0xC0) != 0x80)
    inside = np.concatenate(([False], black[ends[:-1]] & black[ends[:-1] - 1]))
    return data, ends, characters[ends - 1], begun[ends - 1], inside


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def stretch_digests(chunks: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Digest of each stretch of chunks first..last, from the two longest runs of 2^k chunks at its ends and its length.

    Level k holds the digests of all runs of 2^k chunks, so the work is the number of chunks times the
    logarithm of the longest stretch, however long the chunks are.
    """
    sizes = last - first + 1
    out, level, width = np.zeros(len(first), dtype=np.uint64), chunks, 1
    while True:
        here = np.flatnonzero((sizes >= width) & (sizes < 2 * width))
        ends = _mix(level[first[here]] + np.uint64(0x9E3779B97F4A7C15)) + level[last[here] - width + 1]
        out[here] = _mix(ends + sizes[here].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        if not len(sizes) or int(sizes.max()) < 2 * width:
            return out
        level = _mix(_mix(level[:-width] + np.uint64(width)) + level[width:])
        width *= 2


def windows(text: str, min_words: int) -> tuple[np.ndarray, ...]:
    """Digest, start, end (in characters), words begun before and up to the end, of each window in order.

    Words count as touched, so that a window is the same whatever stands before it.
    """
    data, ends, characters, begun, inside = _chunked(text)
    size = len(ends)
    before = np.concatenate(([0], begun[:-1]))[:size]
    untouched = before - inside
    numbers = np.arange(size)
    stops = np.maximum(np.searchsorted(begun, untouched + min_words), numbers)
    origins = np.minimum(np.searchsorted(untouched, begun - min_words, side="right") - 1, numbers)
    pairs = np.unique(np.concatenate(((numbers * size + stops)[stops < size], (origins * size + numbers)[origins >= 0])))
    first, last = np.divmod(pairs, max(size, 1))
    places = np.concatenate(([0], characters))
    starts = np.concatenate(([0], ends))
    spans = zip(starts[first].tolist(), ends[last].tolist(), strict=True)
    digests = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) if b - a <= LONG else 0 for a, b in spans), dtype=np.uint64, count=len(pairs))
    long = np.flatnonzero(ends[last] - starts[first] > LONG)
    if len(long):
        hashed = (xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(starts[:-1].tolist(), ends.tolist(), strict=True))
        digests[long] = stretch_digests(np.fromiter(hashed, dtype=np.uint64, count=size), first[long], last[long])
    return digests.view(np.int64), places[first], characters[last], before[first], begun[last]


#: A window: start, end (characters, exclusive), words begun before it and up to its end.
Window = tuple[int, int, int, int]


def joined(held: list[Window], min_words: int) -> list[tuple[int, int, int]]:
    """Passages of overlapping windows that begin at least `min_words` words: start, end, words."""
    out: list[list[int]] = []
    for start, end, before, through in sorted(held):
        if out and start < out[-1][1]:
            if end > out[-1][1]:
                out[-1][1], out[-1][3] = end, through
        else:
            out.append([start, end, before, through])
    return [(start, end, through - before) for start, end, before, through in out if through - before >= min_words]


def document_windows(keyed: DataFrame, min_words: int) -> DataFrame:
    """One row per window of `keyed` (owner, text_key, text): its digest, place and whether it is the first of its digest in the text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                columns: list[list[np.ndarray]] = [[] for _ in _WINDOW]
                for owner, key, text in zip(*(c.to_pylist() for c in batch.slice(at, BLOCK_ROWS).columns), strict=True):
                    digests, *place = windows(text or "", min_words)
                    size = len(digests)
                    first = np.zeros(size, dtype=bool)
                    first[np.unique(digests, return_index=True)[1]] = True
                    for column, values in zip(columns, (np.full(size, owner), np.full(size, key), digests, *place, first), strict=True):
                        column.append(values)
                arrays = [pa.array(np.concatenate(c).astype(kind)) for c, kind in zip(columns, _WINDOW.values(), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=list(_WINDOW))

    names = {"int64": "bigint", "int32": "int", "bool": "boolean"}
    return keyed.select("owner", "text_key", "text").mapInArrow(task, ", ".join(f"{c} {names[kind]}" for c, kind in _WINDOW.items()))


_WINDOW = {
    "owner": "int64", "text_key": "int64", "digest": "int64", "start": "int32", "end": "int32", "before": "int32", "through": "int32", "first": "bool"
}


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of `docs`: doc_id, removed and shared (arrays of start, end in characters, words; ends exclusive).

    `removed` are passages that a document of a smaller id, or an earlier place of the same text, holds
    too; `shared` are all passages that another document holds, the first holder's included.
    Null and empty texts have none. Rows of one id count as one document, and rows without an id as
    one last document: what only they share with each other is no repeat. Ids must be integers.

    Texts are chunked twice and never shuffled. A digest's documents are summed before they move, so a
    hot passage is one row a task; the join that marks its places can be split.
    """
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumns(
        {"owner": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(2**63 - 1)), "text_key": F.xxhash64("text")}
    )
    made = document_windows(keyed, min_words)
    holders = made.where("first").groupBy("digest").agg(F.min("owner").alias("holder"), F.max("owner").alias("last")).where("holder <> last").drop("last")
    place = ["start", "end", "before", "through"]
    found = made.join(holders, "digest").select("owner", "text_key", *place, (~F.col("first") | (F.col("owner") != F.col("holder"))).alias("later"), F.lit(True).alias("common"))
    # Repeats inside one text need no other document. Marks of rows with one owner and text are the same, and one set.
    within = made.where("not first").select("owner", "text_key", *place, F.lit(True).alias("later"), F.lit(False).alias("common"))
    marked = found.union(within).groupBy("owner", "text_key").agg(F.collect_set(F.struct(*place, "later", "common")).alias("marks"))

    def spans(owners: list, keys: list, marks: list) -> tuple:
        removed, shared = [], []
        for rows in marks:
            for out, kind in ((removed, "later"), (shared, "common")):
                held = [tuple(r[c] for c in place) for r in rows if r[kind]]
                out.append([dict(zip(("start", "end", "words"), p, strict=True)) for p in joined(held, min_words)])
        return owners, keys, removed, shared

    passage = "array<struct<start:bigint,end:bigint,words:bigint>>"
    told = map_blocks(marked, ["owner", "text_key", "marks"], spans, f"owner bigint, text_key bigint, removed {passage}, shared {passage}")
    told = told.where((F.size("removed") > 0) | (F.size("shared") > 0))
    none = F.array().cast(passage)
    listed = keyed.select("doc_id", "owner", "text_key").join(told, ["owner", "text_key"], "left")
    return listed.select("doc_id", "text_key", F.coalesce("removed", none).alias("removed"), F.coalesce("shared", none).alias("shared"))


_WORD_EDGE = re.compile(f"[{WHITE}]")


def cut_out(text: str, passages: list[tuple[int, int]]) -> str:
    """The text without the whole words of the passages, which ascend and do not overlap."""
    out, at = [], 0
    for start, end in passages:
        if start and not _WORD_EDGE.match(text[start - 1]):
            found = _WORD_EDGE.search(text, start, end)
            start = found.end() if found else end
        if end < len(text) and not _WORD_EDGE.match(text[end]):
            while end > start and not _WORD_EDGE.match(text[end - 1]):
                end -= 1
        if end > start:
            out.append(text[at:start])
            at = end
    return "".join(out) + text[at:]


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All documents with all their columns, whatever their names, repeated passages cut from `text_col`; those left without words go.

    Documents without repeats are returned as they are, also empty and null ones, and so are rows
    without an id. Repeated rows of one id are cut alike.
    """
    found = repeated_passages(docs, id_col=id_col, text_col=text_col, min_words=min_words).where((F.size("removed") > 0) & F.col("doc_id").isNotNull())
    own_id, own_key, own_cut = free_names(docs, 3)
    found = found.groupBy(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key)).agg(F.any_value("removed").alias(own_cut))

    @F.arrow_udf("string")
    def shortened(texts: pa.Array, passages: pa.Array) -> pa.Array:
        def block(some: list, cuts: list) -> list:
            return [t if t is None or p is None else cut_out(t, [(x["start"], x["end"]) for x in p]) for t, p in zip(some, cuts, strict=True)]

        return by_blocks(block, pa.string(), texts, passages)

    matched = docs.join(found, (F.col(id_col) == F.col(own_id)) & (F.xxhash64(text_col) == F.col(own_key)), "left")
    cut = matched.withColumn(text_col, shortened(F.col(text_col), F.col(own_cut)))
    left = cut.where(F.col(own_cut).isNull() | F.col(text_col).rlike("[^\\x20\\x09-\\x0D]"))
    return left.select(*docs.columns)
