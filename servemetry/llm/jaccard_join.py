"""Similarity join of documents by the Jaccard distance of their word n-gram sets.

The distance 1 - intersection / union is a metric. Pivots split a set of documents
into Voronoi regions; a document is copied into every further region whose pivot is
at most twice the join distance farther than its own, since by the triangle
inequality a partner may lie there; regions are joined the same way until small.

Document pivots cannot split a corpus at the first level: unrelated texts are at
distance 1 from every pivot, so nearly all lie in all windows. The first level
therefore uses projections as pivots. The hash range of n-grams is cut into more
classes than a linked pair can have differences, so that in some class both sets
are equal: every distinct projection on a class is the centre of a region of radius
0. Documents with equal projections meet there under the smallest of them, and all
that meet under one pivot are a region, which is joined by document pivots, windows
and recursion. No link is lost (see `signatures`), nothing is sampled or capped.

Many documents share a projection but little else. So before the grams of a region move, its
members meet as sketches of a few bits a gram, which bound the differences of two sets from
below (see `sketch`); what they leave apart cannot link and goes its own way.

Documents with equal sets are one node. What a region reports are links that connect
it, not all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import pin, release
from .arrow import BLOCK_ROWS, free_names, map_blocks
from .components import components

#: Odd multipliers of the hash mixing (fixed values).
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)
#: Weight of one block of a region, in n-grams and DOCUMENT_WEIGHT for each document. Larger
#: regions are cut into blocks that meet in pairs, so a task holds two blocks or one long document.
BLOCK_WEIGHT, DOCUMENT_WEIGHT = 100_000, 100
#: The same for sketches, in bytes and SKETCH_ROW for each document.
SKETCH_BLOCK, SKETCH_ROW = 150_000, 100
_DIRECT, _PIVOTS = 24, 8


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; of the whole sequence if it is shorter.

    A-Z are lowered; words are separated by ASCII white space. Without words the set is empty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(n, len(words))
    grams = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        grams = _mix(grams + hashes[k : len(words) - width + 1 + k] * _ODD[k % 4]) + np.uint64(k)
    return np.unique(grams)


def bands(size: int, num: int, den: int) -> list[tuple[int, int]]:
    """The size bands (low, high) in which a set of this size may meet a partner not smaller than itself, or itself."""
    out, low, high = [], 1, 2
    while True:
        if size < high and (not out or low <= size * den // num):
            out.append((low, high))
        elif size < high:
            return out
        low, high = high, max(high + 1, high * 3 // 2)


@lru_cache(maxsize=1024)
def _classes(low: int, high: int, num: int, den: int) -> tuple[int, int]:
    """Most differences of a linked pair whose larger set lies in the band, and the number of classes.

    There are so many classes that even the smallest sets in the band nearly always fill more
    than `most` of them: random grams fill classes * (1 - exp(-size / classes)) on average.
    """
    most = 2 * (high - 1) * (den - num) // (den + num)
    smallest, classes = max(1, low * num // den), most + 1
    while classes < 2 * most + 4:
        empty = classes * math.exp(-smallest / classes)
        if classes - empty >= most + 1 + 2.5 * math.sqrt(empty):
            break
        classes += 1 + classes // 64
    return most, classes


def signatures(grams: np.ndarray, num: int, den: int) -> np.ndarray:
    """Names of the first-level regions of a set, such that linked sets share one.

    A pair is looked for in the band of its larger set, of fewer than `high` grams. The two differ in
    at most 2 (high - 1) (den - num) / (den + num) grams. With one class more than that, some class has
    no difference. Empty classes name no region, so there are more, see `_classes`; a set that fills no
    more classes than a pair can have differences names every gram as well. Two such sets share a
    gram; and if one of a linked pair is not such a set, one of its filled classes is undamaged.
    """
    out = []
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_mix(grams + _ODD[0]), dtype=np.uint64)))
    for low, high in bands(len(grams), num, den):
        most, classes = _classes(low, high, num, den)
        if not most:
            continue  # linked sets of this band are equal
        # The top 32 bits give the class; equal grams fall in one class in every set.
        edges = np.searchsorted((grams >> np.uint64(32)).astype(np.int64) * classes >> 32, np.arange(classes + 1))
        filled = edges[1:] > edges[:-1]
        named = sums[edges[1:]] - sums[edges[:-1]] + np.arange(classes, dtype=np.uint64) * _ODD[1] + np.full(1, high, dtype=np.uint64) * _ODD[2]
        out.append(_mix(named[filled]))
        if int(filled.sum()) <= most:
            out.append(_mix(grams * _ODD[3] + np.full(1, high, dtype=np.uint64) * _ODD[4]))
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def sketch(grams: np.ndarray) -> bytes:
    """The size of a set, and for each class of its grams whether their number is odd, at 2 to 4 classes a gram.

    A gram that only one of two sets holds changes one bit, so the bits in which two sketches differ are
    at most as many as the grams in which the sets do. The number of classes is a power of two, and the
    halves of a sketch combined by exclusive or are the sketch with half as many.
    """
    bits = 1 << max(6, (2 * len(grams) - 1).bit_length())
    odd = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return len(grams).to_bytes(8, "little") + np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


class Region:
    """The exact join of some sets: pivots, windows, recursion; keeps what connects them."""

    def __init__(self, names: list[int], sets: list[np.ndarray], num: int, den: int):
        self.names, self.num, self.den = names, num, den
        self.sizes = np.array([len(s) for s in sets])
        self.universe, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    @classmethod
    def of(cls, names: list[int], grams: list[bytes], num: int, den: int) -> Region:
        return cls(names, [np.frombuffer(g, dtype=np.uint64) for g in grams], num, den)

    def root(self, name: int) -> int:
        while (up := self.parent.get(name, name)) != name:
            self.parent[name] = self.parent.get(up, up)
            name = up
        return name

    def unite(self, a: int, b: int, link: bool = True) -> None:
        ra, rb = self.root(a), self.root(b)
        if ra != rb:
            self.parent[max(ra, rb)] = min(ra, rb)
            if link:
                self.links.append((a, b))

    def shared(self, pivot: int, items: np.ndarray) -> np.ndarray:
        """Size of the intersection of each item with the pivot; items ascend."""
        marked = np.zeros(len(self.universe), dtype=bool)
        marked[self.flat[self.starts[pivot] : self.starts[pivot] + self.sizes[pivot]]] = True
        if len(items) == len(self.sizes):
            return np.add.reduceat(marked[self.flat].astype(np.int64), self.starts)
        spans = np.repeat(self.starts[items] - np.concatenate(([0], np.cumsum(self.sizes[items])[:-1])), self.sizes[items])
        hits = marked[self.flat[spans + np.arange(len(spans))]].astype(np.int64)
        return np.add.reduceat(hits, np.concatenate(([0], np.cumsum(self.sizes[items])[:-1])))

    def compare(self, pivot: int, items: np.ndarray) -> np.ndarray:
        """Distances of items to a pivot; items within the join distance are united with it."""
        common = self.shared(pivot, items)
        union = self.sizes[items] + self.sizes[pivot] - common
        for i in items[self.den * common >= self.num * union].tolist():
            self.unite(self.names[pivot], self.names[i])
        return 1 - common / union

    def join(self, items: np.ndarray) -> None:
        """Find all links between items that are not connected yet."""
        roots = [self.root(self.names[i]) for i in items.tolist()]
        if len(items) < 2 or len(set(roots)) == 1:
            return
        if len(items) <= _DIRECT:
            return self.direct(items)
        chosen = np.unique(np.linspace(0, len(items) - 1, _PIVOTS).astype(int))
        pivots, rest = items[chosen], np.delete(items, chosen)
        distances = np.stack([self.compare(p, items)[~np.isin(np.arange(len(items)), chosen)] for p in pivots.tolist()])
        nearest = distances.argmin(axis=0)
        own = distances.min(axis=0)
        window = own + 2 * (self.den - self.num) / self.den + 1e-9
        for k in range(len(pivots)):
            region = rest[(nearest == k) | (distances[k] <= window)]
            if len(region) > 0.7 * len(items):
                return self.direct(rest)  # windows too wide to split further
        for k in range(len(pivots)):
            if (nearest == k).any():
                self.join(rest[(nearest == k) | (distances[k] <= window)])

    def direct(self, items: np.ndarray) -> None:
        """Compare each item with all later ones of fitting size in other components."""
        for at, i in enumerate(items.tolist()):
            later = items[at + 1 :]
            small, large = np.minimum(self.sizes[later], self.sizes[i]), np.maximum(self.sizes[later], self.sizes[i])
            later = later[self.den * small >= self.num * large]
            mine = self.root(self.names[i])
            later = later[[self.root(self.names[j]) != mine for j in later.tolist()]] if len(later) else later
            if len(later):
                self.compare(i, later)


class SketchRegion(Region):
    """Connects the members of a region that may link by their sketches: all that do link, and few others."""

    def __init__(self, names: list[int], sketches: list[bytes], num: int, den: int):
        self.names, self.num, self.den = names, num, den
        words = [np.frombuffer(s, dtype=np.uint64) for s in sketches]
        self.sizes = np.array([int(w[0]) for w in words], dtype=np.int64)
        self.bits = [w[1:] for w in words]
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def join(self, items: np.ndarray) -> None:
        """Compare each item with all later ones of as many classes, and with those of more that have a fitting size."""
        lengths = np.array([len(self.bits[i]) for i in items.tolist()])
        for length in np.unique(lengths).tolist():
            own = items[lengths == length]
            larger = items[lengths > length]
            larger = larger[self.den * self.sizes[own].max() >= self.num * self.sizes[larger]]
            both = np.concatenate((own, larger))
            bits = np.stack([_folded(self.bits[i], length) for i in both.tolist()])
            sizes = self.sizes[both]
            for at, i in enumerate(own.tolist()):
                low, high = np.minimum(sizes[at + 1 :], sizes[at]), np.maximum(sizes[at + 1 :], sizes[at])
                later = np.flatnonzero(self.den * low >= self.num * high) + at + 1
                apart = np.bitwise_count(bits[later] ^ bits[at]).sum(axis=1, dtype=np.int64)
                for j in both[later[(self.den + self.num) * apart <= (self.den - self.num) * (sizes[later] + sizes[at])]].tolist():
                    self.unite(self.names[i], self.names[j])


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in the order of signature and node: each node that shares a signature, with the smallest such node."""
    last_signature = last_pivot = None
    for batch in batches:
        if not batch.num_rows:
            continue
        signature, node = (batch.column(k).to_numpy() for k in (0, 1))
        new = np.concatenate(([last_signature is None or signature[0] != last_signature], signature[1:] != signature[:-1]))
        firsts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        pivots = np.concatenate(([last_pivot if last_pivot is not None else node[0]], node[firsts]))
        pivot = pivots[group + 1]
        last_signature, last_pivot = signature[-1], pivot[-1]
        keep = pivot != node
        pairs = np.unique(np.stack((pivot[keep], node[keep]), axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["pivot", "node"])


def document_sets(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, digest and sketch of the set (both null if empty)."""

    def block(keys: list, texts: list) -> tuple:
        sets = [shingles(t, words) for t in texts]
        digests = [xxhash.xxh3_128_digest(g.tobytes()) if len(g) else None for g in sets]
        return keys, [len(g) for g in sets], digests, [sketch(g) if len(g) else None for g in sets]

    return map_blocks(docs, [id_col, text_col], block, "doc_id bigint, n_shingles bigint, digest binary, sketch binary")


#: Sets a task remembers so as to name the regions of equal ones only once; speed only.
REMEMBERED = 200_000


def document_signatures(docs: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """Rows signature, node for the first document of each set in a task.

    Equal sets so give at most one document a task to a region, however many copies there are.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                nodes, names = [], []
                for node, text in zip(*(c.to_pylist() for c in batch.slice(at, BLOCK_ROWS).columns), strict=True):
                    grams = shingles(text, words)
                    if node is None or not len(grams) or (digest := xxhash.xxh3_128_digest(grams.tobytes())) in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(digest)
                    names.append(signatures(grams, num, den))
                    nodes.append(np.full(len(names[-1]), node, dtype=np.int64))
                if names:
                    columns = [pa.array(np.concatenate(names).view(np.int64)), pa.array(np.concatenate(nodes))]
                    yield pa.RecordBatch.from_arrays(columns, names=["signature", "node"])

    return docs.select(F.col(id_col).cast("bigint"), text_col).mapInArrow(task, "signature bigint, node bigint")


def similarity_components(
    docs: DataFrame, *, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Documents link when den * |intersection| >= num * |union| of their sets of `words`-word shingles;
    component_id is the smallest id reachable by links. Documents without words or with a null text
    link with nothing. Rows with one id are one document: their sets' links are all its own. A row
    without an id never links others; it takes the component of the documents with its set, else null.
    Ids must be integers.
    """
    sets = pin(document_sets(docs, words, id_col, text_col))
    smallest = sets.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("node"))
    members = pin(sets.join(smallest, "digest", "left").select("doc_id", "n_shingles", "node"))

    named = document_signatures(docs, words, num, den, id_col, text_col)
    meetings = named.repartition("signature").sortWithinPartitions("signature", "node").mapInArrow(_meetings, "pivot bigint, node bigint")
    meetings = pin(meetings.distinct())
    release(docs.sparkSession)
    sketches = sets.where("doc_id is not null and sketch is not null").select(F.col("doc_id").alias("node"), "sketch").distinct()
    meetings = pin(_possible(meetings, sketches, num, den))
    release(docs.sparkSession)
    links = _region_links(docs, meetings, members, words, num, den, id_col, text_col)
    # A copy that named regions stands for its set, as does the copy of the smallest id.
    met = meetings.select("node").union(meetings.select("pivot")).distinct().withColumnRenamed("node", "doc_id")
    copies = members.where("doc_id <> node").join(met, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    several = members.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    same = members.join(several.select("doc_id", "low"), "doc_id").select(F.col("low").alias("a"), F.col("node").alias("b"))
    found = components(links.union(copies).union(same)).withColumnRenamed("component", "component_id")
    return members.join(found, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "node", "doc_id").alias("component_id"))


def _blocks(members: DataFrame, weight: Column, block_weight: int) -> DataFrame:
    """pivot and the number of blocks of its region, from the weights of its members."""
    return members.groupBy("pivot").agg(F.ceil(F.sum(weight) / block_weight).alias("n_blocks"))


def _met(table: pa.Table, kind: Callable[..., Region], num: int, den: int) -> Region:
    """The region of one tile, its members compared."""
    table = table.sort_by("node")
    names = table.column("node").to_pylist()
    region = kind(names, table.column("content").to_pylist(), num, den)
    settled = [n for n, s in zip(names, table.column("settled").to_pylist(), strict=True) if s]
    for n in settled:
        region.unite(settled[0], n, link=False)
    region.join(np.arange(len(names)))
    return region


def _alone(small: DataFrame) -> DataFrame:
    """Regions of one block (pivot, node, content) as tiles."""
    zero = F.lit(0).cast("bigint")
    return small.select("pivot", zero.alias("i"), zero.alias("j"), "node", "content", F.lit(False).alias("settled"))


def _by_blocks(large: DataFrame, linked: Callable[[bytes, bytes], bool], weight: Column, block_weight: int) -> tuple[DataFrame, DataFrame]:
    """Tiles of larger regions (pivot, node, n_blocks, content; pinned), and links (a, b) with their pivots.

    They first settle all that is linked with the pivot; only the others meet everyone, block by block.
    """
    centres = large.where("pivot = node").select("pivot", F.col("content").alias("centre"))

    def settle(pivots: list, names: list, counts: list, contents: list, centres: list) -> tuple:
        return pivots, names, counts, contents, [linked(a, b) for a, b in zip(contents, centres, strict=True)]

    columns = ["pivot", "node", "n_blocks", "content", "centre"]
    judged = pin(map_blocks(large.join(centres, "pivot"), columns, settle, "pivot bigint, node bigint, n_blocks bigint, content binary, settled boolean"))
    at_pivot = judged.where("settled and pivot <> node").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    open_blocks = _blocks(judged.where("not settled"), weight, block_weight).withColumnRenamed("n_blocks", "n_open")
    own = judged.join(open_blocks, "pivot").withColumns({
        "block": F.pmod(F.xxhash64("node"), F.col("n_blocks")), "open_block": F.pmod(F.xxhash64("node", F.lit(1)), F.col("n_open")),
    })
    everyone = own.select("pivot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_open") - 1)).alias("i"), F.col("block").alias("j"), "node", "content", "settled")
    openers = own.where("not settled").select("pivot", F.col("open_block").alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_blocks") - 1)).alias("j"), "node", "content", "settled")
    return everyone.union(openers), at_pivot


def _with_pivots(meetings: DataFrame) -> DataFrame:
    return meetings.union(meetings.select("pivot", F.col("pivot").alias("node")).distinct())


def _possible(meetings: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Smaller regions, again as rows pivot, node: the parts of each region that its members' sketches connect.

    Linked documents stay together. A part is named by its smallest member, so regions that hold the same
    part give it once. Parts of regions of several blocks are joined across these regions.
    """
    weight = F.octet_length("content") + SKETCH_ROW
    rows = _with_pivots(meetings).join(sketches.withColumnRenamed("sketch", "content"), "node")
    sized = pin(rows.join(_blocks(rows, weight, SKETCH_BLOCK), "pivot").select("pivot", "node", "n_blocks", "content"))

    def parts(table: pa.Table) -> pa.Table:
        region = _met(table, SketchRegion, num, den)
        pairs = {(root, n) for n in region.names if (root := region.root(n)) != n}
        return pa.table({"pivot": pa.array([a for a, _ in pairs], pa.int64()), "node": pa.array([b for _, b in pairs], pa.int64())})

    found = _alone(sized.where("n_blocks = 1")).groupBy("pivot", "i", "j").applyInArrow(parts, "pivot bigint, node bigint")
    large = sized.where("n_blocks > 1")
    if large.isEmpty():
        return found.distinct()

    def near(a: bytes, b: bytes) -> bool:
        pair = SketchRegion([0, 1], [a, b], num, den)
        pair.join(np.arange(2))
        return bool(pair.links)

    def links(table: pa.Table) -> pa.Table:
        return _links_of(_met(table, SketchRegion, num, den))

    tiles, at_pivot = _by_blocks(large, near, weight, SKETCH_BLOCK)
    across = components(tiles.groupBy("pivot", "i", "j").applyInArrow(links, "a bigint, b bigint").union(at_pivot))
    return found.union(across.where("node <> component").select(F.col("component").alias("pivot"), "node")).distinct()


def _links_of(region: Region) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in region.links], pa.int64()), "b": pa.array([b for _, b in region.links], pa.int64())})


def _region_links(
    docs: DataFrame, meetings: DataFrame, members: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str
) -> DataFrame:
    """Links (a, b) that connect what is connected inside the regions of `meetings`."""
    sizes = members.where("doc_id is not null").groupBy(F.col("doc_id").alias("node")).agg((F.max("n_shingles") + DOCUMENT_WEIGHT).alias("weight"))
    rows = _with_pivots(meetings)
    regions = pin(rows.join(_blocks(rows.join(sizes, "node"), F.col("weight"), BLOCK_WEIGHT), "pivot").select("pivot", "node", "n_blocks"))

    def grams_of(some: DataFrame) -> DataFrame:
        """The grams of every document of `some` regions beside its region; a document's text moves once."""
        # A document names at most as many regions as it has grams, so the list is bounded by its text.
        listed = some.groupBy("node").agg(F.collect_list(F.struct("pivot", "n_blocks")).alias("regions"))

        def block(nodes: list, texts: list, lists: list) -> tuple:
            return nodes, [shingles(t, words).tobytes() for t in texts], lists

        met = docs.select(F.col(id_col).cast("bigint").alias("node"), F.col(text_col).alias("text")).join(listed, "node")
        made = map_blocks(met, ["node", "text", "regions"], block, "node bigint, content binary, regions array<struct<pivot:bigint,n_blocks:bigint>>")
        return made.select("node", "content", F.inline("regions"))

    def join_tile(table: pa.Table) -> pa.Table:
        return _links_of(_met(table, Region.of, num, den))

    def joined(tiles: DataFrame) -> DataFrame:
        return tiles.groupBy("pivot", "i", "j").applyInArrow(join_tile, "a bigint, b bigint")

    small = _alone(grams_of(regions.where("n_blocks = 1")))
    if regions.where("n_blocks > 1").isEmpty():
        return joined(small)

    def linked(a: bytes, b: bytes) -> bool:
        x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
        common = len(np.intersect1d(x, y, assume_unique=True))
        return den * common >= num * (len(x) + len(y) - common)

    tiles, at_pivot = _by_blocks(pin(grams_of(regions.where("n_blocks > 1"))), linked, F.octet_length("content") / 8 + DOCUMENT_WEIGHT, BLOCK_WEIGHT)
    return joined(small.union(tiles)).union(at_pivot)


def one_of_each_group(docs: DataFrame, *, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document of the smallest id of each component, with all its columns.

    Documents without words or id are in no group and stay. Of rows that repeat an id one stays.
    """
    found = pin(similarity_components(docs, words=words, num=num, den=den, id_col=id_col, text_col=text_col).where("doc_id is not null"))
    release(docs.sparkSession)
    (out_id,) = free_names(docs, 1)
    dropped = found.where("doc_id <> component_id").select(F.col("doc_id").alias(out_id)).distinct()
    repeated = found.groupBy(F.col("doc_id").alias(out_id)).count().where("count > 1").select(out_id)
    if repeated.isEmpty():
        return docs.join(dropped, F.col(id_col) == F.col(out_id), "left_anti")
    again = pin(repeated.join(dropped, out_id, "left_anti"))
    once = docs.join(again, F.col(id_col) == F.col(out_id), "left_semi").dropDuplicates([id_col])
    return docs.join(dropped.union(again), F.col(id_col) == F.col(out_id), "left_anti").union(once)
