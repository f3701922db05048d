"""Ranked lexical search over posting lists cut into blocks of similar documents.

Documents are read once into narrow rows: the terms of theirs that any item asks for, and how often
they hold each. The documents of an item's rarest terms give its floor, the score of the k-th best of
them. A document that reaches the floor holds one of the item's strong terms, those that are left when
weak ones are taken away as long as their largest impacts add up to less. Shards of the narrow rows
become posting lists of the strong terms; a long list is clustered by the similarity of its documents,
and each cluster is a block with the largest impact of every term that any of its documents holds. The
sum of weight times largest impact over an item's terms bounds the score of every document of the
block: blocks whose bound is below the floor are skipped, the documents of all others are scored.

The items are a stated set of queries. They are dealt into blocks of bounded text, and each such
block makes one search over all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from heapq import heappush, heappushpop

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.storage import fresh_path
from .arrow import map_blocks

#: Bytes of item text searched for at once.
ITEM_BYTES = 1 << 22
#: Documents and postings of one shard, and documents a block is meant to hold.
SHARD_DOCS, SHARD_POSTINGS, BLOCK_DOCS = 8192, 400_000, 128
#: Documents that the rarest terms of an item are to hold together, for its floor.
LEAD_DOCS = 64
#: Dimensions of the random projection by which documents of a list are compared.
_SKETCH = 16
_BLOCK = "term int, docs array<bigint>, coordinates array<int>, maxima array<int>"


def _table() -> bytes:
    """Letters and digits stay, A-Z becomes a-z, other ASCII becomes a space; bytes of other characters stay."""
    out = bytearray(range(256))
    for b in range(128):
        out[b] = ord(chr(b).lower()) if chr(b).isalnum() else 0x20
    return bytes(out)


_TABLE = _table()


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, with repeats; a null text has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What each posting adds to a score per unit of weight, below 10^6; m is the length of its document beside the mean."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


@dataclass(frozen=True)
class Items:
    """A bounded set of queries: their ids, the vocabulary, and each item's distinct terms as ascending numbers."""

    ids: list
    vocabulary: dict[bytes, int]
    lists: list[np.ndarray]

    @classmethod
    def of(cls, rows: Sequence[tuple]) -> Items:
        found = [sorted(set(terms(text))) for _, text in rows]
        vocabulary = {t: n for n, t in enumerate(sorted({t for own in found for t in own}))}
        return cls([i for i, _ in rows], vocabulary, [np.array([vocabulary[t] for t in own], dtype=np.int64) for own in found])


class Scorer:
    """Weighted sums of one vector of impacts for some items at once."""

    def __init__(self, lists: Sequence[np.ndarray], weights: np.ndarray):
        self.vector = np.zeros(len(weights), dtype=np.int64)
        self.sizes = np.array([len(own) for own in lists], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.terms = np.concatenate([np.zeros(0, dtype=np.int64), *lists])
        self.weights = weights[self.terms]

    def sums(self, items: np.ndarray, coordinates: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The sum of each item, all of which have terms."""
        sizes = self.sizes[items]
        at = _of_rows(self.starts[items], sizes)
        self.vector[coordinates] = values
        out = np.add.reduceat(self.vector[self.terms[at]] * self.weights[at], np.cumsum(sizes) - sizes)
        self.vector[coordinates] = 0
        return out


def items_of(lists: Sequence[Sequence[int]]) -> dict[int, np.ndarray]:
    """The items that name each term."""
    found: dict[int, list[int]] = {}
    for item, own in enumerate(lists):
        for t in own:
            found.setdefault(int(t), []).append(item)
    return {t: np.array(items, dtype=np.int64) for t, items in found.items()}


def _written(df: DataFrame, label: str) -> DataFrame:
    """The rows of `df`, fixed in the shared folder in columns."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def forward(docs: DataFrame, vocabulary: Mapping[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """One narrow row per document: n terms in all, and the counts of those in the vocabulary; fixed, each with a number of its own."""

    def block(keys: list, texts: list) -> tuple:
        sizes, found, counts = [], [], []
        for text in texts:
            own = terms(text)
            held = [(number, n) for t, n in Counter(own).items() if (number := vocabulary.get(t)) is not None]
            held.sort()
            sizes.append(len(own))
            found.append([t for t, _ in held])
            counts.append([n for _, n in held])
        return keys, sizes, found, counts

    kind = docs.schema[id_col].dataType.simpleString()
    made = map_blocks(docs, [id_col, text_col], block, f"doc_id {kind}, n bigint, terms array<int>, tfs array<int>", rows=64)
    return _written(made.withColumn("row", F.monotonically_increasing_id()), "lexical-narrow")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0, and the values of a list column without nulls."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], column.flatten().to_numpy(zero_copy_only=False)


def _postings(batch: pa.RecordBatch, n_docs: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, terms and impacts of narrow rows, one document after the other."""
    offsets, found = _lists(batch.column("terms"))
    _, tf = _lists(batch.column("tfs"))
    sizes = np.diff(offsets)
    m = np.array([10 + (90 * n * n_docs) // n_terms for n in batch.column("n").to_pylist()], dtype=np.int64)
    return sizes, found.astype(np.int64), impacts(tf.astype(np.int64), np.repeat(m, sizes))


def _of_rows(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of the entries of rows that begin at `starts`, one row after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def shard_blocks(
    rows: np.ndarray, ptr: np.ndarray, term: np.ndarray, impact: np.ndarray, weights: np.ndarray, coordinates: Mapping[int, np.ndarray]
) -> Iterator[tuple]:
    """(term, rows, coordinates, maxima) of every block of a shard of documents.

    rows: document numbers; ptr, term, impact: their postings, one document after the other; coordinates:
    the terms to have lists, each with the terms that its summaries cover. A list of more than BLOCK_DOCS
    documents is clustered about evenly spread documents of its own.
    """
    sizes = np.diff(ptr)
    owner = np.repeat(np.arange(len(rows)), sizes)
    plane = np.random.default_rng(7).standard_normal((len(weights), _SKETCH), dtype=np.float32)
    scaled = (weights[term] * impact).astype(np.float32)
    sketch = np.zeros((len(rows), _SKETCH), dtype=np.float32)
    full = np.flatnonzero(sizes)
    for d in range(_SKETCH if len(full) else 0):
        sketch[full, d] = np.add.reduceat(scaled * plane[term, d], ptr[:-1][full])
    sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-30)

    by_term = np.argsort(term, kind="stable")
    doc, listed = owner[by_term], term[by_term]
    bounds = np.flatnonzero(np.diff(listed, prepend=-1))
    covered = np.zeros(len(weights), dtype=bool)
    for low, high in zip(bounds.tolist(), [*bounds[1:].tolist(), len(listed)], strict=True):
        wanted = coordinates.get(int(listed[low]))
        if wanted is None:
            continue
        own, cluster = doc[low:high], np.zeros(high - low, dtype=np.int64)
        if len(own) > BLOCK_DOCS:
            seeds = own[np.linspace(0, len(own) - 1, -(-len(own) // BLOCK_DOCS)).astype(np.int64)]
            cluster = (sketch[own] @ sketch[seeds].T).argmax(axis=1)
            order = np.argsort(cluster, kind="stable")
            own, cluster = own[order], cluster[order]
        # Each entry as one number, so that the last of a cluster and term is its maximum.
        where = _of_rows(ptr[own], sizes[own])
        covered[wanted] = True
        inside = covered[term[where]]
        covered[wanted] = False
        where, part = where[inside], np.repeat(cluster, sizes[own])[inside]
        keys = np.sort((part * len(weights) + term[where]) << 20 | impact[where])
        cells = keys >> 20
        last = np.append(cells[1:] != cells[:-1], True)
        cells, maxima = cells[last], keys[last] & 0xFFFFF
        for n in np.unique(cluster).tolist():
            a, b = np.searchsorted(cells, (n * len(weights), (n + 1) * len(weights)))
            c, d = np.searchsorted(cluster, (n, n + 1))
            yield int(listed[low]), rows[own[c:d]], cells[a:b] - n * len(weights), maxima[a:b]


def blocks(narrow: DataFrame, weights: np.ndarray, coordinates: Mapping[int, np.ndarray], n_docs: int, n_terms: int) -> DataFrame:
    """The posting lists of the terms of `coordinates` over all documents, in blocks with their summaries; fixed."""

    schema = StructType.fromDDL(_BLOCK)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(schema)
        held: list[tuple] = []

        def made() -> Iterator[pa.RecordBatch]:
            rows, sizes, found, values = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            ptr = np.concatenate(([0], np.cumsum(sizes)))
            some: list[tuple] = []
            for one in shard_blocks(rows, ptr, found, values, weights, coordinates):
                some.append(one)
                if len(some) == 2048:
                    yield batch_of(some)
                    some = []
            if some:
                yield batch_of(some)

        def batch_of(some: list[tuple]) -> pa.RecordBatch:
            numbers, *lists = zip(*some, strict=True)
            arrays = [pa.array(numbers, type=pa.int32())]
            for own, field in zip(lists, list(target)[1:], strict=True):
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(own)).cast(field.type.value_type)).cast(field.type))
            return pa.RecordBatch.from_arrays(arrays, schema=target)

        docs = postings = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sizes, found, values = _postings(part, n_docs, n_terms)
                held.append((part.column("row").to_numpy(), sizes, found, values))
                docs, postings = docs + part.num_rows, postings + len(found)
                if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    yield from made()
                    docs = postings = 0
        if held:
            yield from made()

    return _written(narrow.where(F.size("terms") > 0).select("row", "n", "terms", "tfs").mapInArrow(task, schema), "lexical-blocks")


def _record(rows: Sequence[tuple], schema: StructType) -> pa.RecordBatch:
    target = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)


def floors_and_maxima(
    narrow: DataFrame, lists: Sequence[np.ndarray], lead: Mapping[int, np.ndarray], weights: np.ndarray, k: int, n_docs: int, n_terms: int
) -> tuple[np.ndarray, np.ndarray]:
    """For each item the k-th best score of documents that hold one of its lead terms, 1 if there are fewer; each term's largest impact.

    A task hands on k scores an item and one impact a term.
    """
    schema = StructType.fromDDL("item int, term int, value bigint")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, most = Scorer(lists, weights), np.zeros(len(weights), dtype=np.int64)
        best: dict[int, list[int]] = {}
        leads = np.zeros(len(weights), dtype=bool)
        leads[list(lead)] = True
        for batch in batches:
            sizes, found, values = _postings(batch, n_docs, n_terms)
            np.maximum.at(most, found, values)
            ends = np.cumsum(sizes)
            hits = np.flatnonzero(leads[found])
            docs = np.searchsorted(ends, hits, side="right")
            for n, low, high in zip(*_runs(docs), strict=True):
                items = np.unique(np.concatenate([lead[t] for t in found[hits[low:high]].tolist()]))
                own = slice(ends[n] - sizes[n], ends[n])
                for item, score in zip(items.tolist(), scorer.sums(items, found[own], values[own]).tolist(), strict=True):
                    heap = best.setdefault(item, [])
                    (heappush if len(heap) < k else heappushpop)(heap, score)
        rows = [(item, None, score) for item, heap in best.items() for score in heap]
        rows += [(None, t, most[t]) for t in np.flatnonzero(most).tolist()]
        if rows:
            yield _record(rows, schema)

    found = narrow.where(F.size("terms") > 0).select("n", "terms", "tfs").mapInArrow(task, schema).persist()
    floors, maxima = np.ones(len(lists), dtype=np.int64), np.zeros(len(weights), dtype=np.int64)
    order = Window.partitionBy("item").orderBy(F.desc("value"))
    for r in found.where("item IS NOT NULL").withColumn("place", F.row_number().over(order)).where(F.col("place") == k).collect():
        floors[r["item"]] = max(1, r["value"])
    for r in found.where("term IS NOT NULL").groupBy("term").agg(F.max("value").alias("value")).collect():
        maxima[r["term"]] = r["value"]
    found.unpersist()
    return floors, maxima


def _runs(values: np.ndarray) -> tuple[list, list, list]:
    """Value, start and end of each run of equal values."""
    first = np.flatnonzero(np.diff(values, prepend=-1))
    return values[first].tolist(), first.tolist(), [*first[1:].tolist(), len(values)]


def lead_terms(own: np.ndarray, df: Mapping[int, int]) -> list[int]:
    """The rarest terms of an item that occur at all, until they hold LEAD_DOCS documents."""
    out, docs = [], 0
    for t in sorted((t for t in own.tolist() if df.get(t)), key=lambda t: (df[t], t)):
        out.append(t)
        docs += df[t]
        if docs >= LEAD_DOCS:
            break
    return out


def strong_terms(own: np.ndarray, floor: int, weights: np.ndarray, maxima: np.ndarray) -> list[int]:
    """The terms of an item one of which every document holds whose score reaches the floor."""
    ordered = own[np.argsort(weights[own] * maxima[own], kind="stable")]
    return ordered[np.cumsum(weights[ordered] * maxima[ordered]) >= floor].tolist()


def unskipped(found: DataFrame, lists: Sequence[np.ndarray], strong: Mapping[int, np.ndarray], weights: np.ndarray, floors: np.ndarray) -> DataFrame:
    """(row, items) of the documents of every block whose bound reaches the floor of an item that its term is strong for."""
    schema = StructType.fromDDL("row bigint, items array<int>")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, scorer = to_arrow_schema(schema), Scorer(lists, weights)
        for batch in batches:
            offsets, coordinates = _lists(batch.column("coordinates"))
            _, maxima = _lists(batch.column("maxima"))
            ends, docs = _lists(batch.column("docs"))
            rows, asked = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for n, term in enumerate(batch.column("term").to_pylist()):
                own, items = slice(offsets[n], offsets[n + 1]), strong[term]
                left = items[scorer.sums(items, coordinates[own], maxima[own]) >= floors[items]]
                here = docs[ends[n] : ends[n + 1]]
                rows.append(np.repeat(here, len(left)))
                asked.append(np.tile(left, len(here)))
            # Lists of one shard follow each other, so most repeats of a document and item meet here.
            row, item = np.concatenate(rows), np.concatenate(asked)
            order = np.lexsort((item, row))
            row, item = row[order], item[order]
            new = np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]))[: len(row)]
            row, item = row[new], item[new]
            first = np.flatnonzero(np.diff(row, prepend=-1))
            cuts = pa.array(np.append(first, len(row)).astype(np.int32))
            grouped = pa.ListArray.from_arrays(cuts, pa.array(item.astype(np.int32))).cast(target.field("items").type)
            yield pa.RecordBatch.from_arrays([pa.array(row[first]), grouped], schema=target)

    return found.mapInArrow(task, schema)


def scored(candidates: DataFrame, narrow: DataFrame, lists: Sequence[np.ndarray], weights: np.ndarray, floors: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """(item, doc_id, row, score) of candidates (row, items) whose exact score reaches the floor."""
    wanted = candidates.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    schema = StructType.fromDDL(f"item int, doc_id {kind}, row bigint, score bigint")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lists, weights)
        for batch in batches:
            sizes, found, values = _postings(batch, n_docs, n_terms)
            offsets, asked = _lists(batch.column("items"))
            ends, rows = np.cumsum(sizes), []
            keys, numbers = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
            for n in range(batch.num_rows):
                items, own = asked[offsets[n] : offsets[n + 1]], slice(ends[n] - sizes[n], ends[n])
                scores = scorer.sums(items, found[own], values[own])
                good = scores >= floors[items]
                rows += [(i, keys[n], numbers[n], s) for i, s in zip(items[good].tolist(), scores[good].tolist(), strict=True)]
            if rows:
                yield _record(rows, schema)

    joined = narrow.join(wanted, "row").select("row", "doc_id", "n", "terms", "tfs", "items")
    return joined.mapInArrow(task, schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: Items, *, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item, rank, doc_id, score): the k best documents of each item, `item` being its place in `items`."""
    narrow = forward(docs, items.vocabulary, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    n_docs, n_terms = narrow.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    # At most one row per term of the items reaches the driver.
    df = dict(narrow.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
    if not df:
        return docs.sparkSession.createDataFrame([], f"item int, rank int, doc_id {kind}, score bigint")
    weights = np.array([weight(n_docs, df.get(t, 0)) for t in range(len(items.vocabulary))], dtype=np.int64)
    lead = items_of([lead_terms(own, df) for own in items.lists])
    floors, maxima = floors_and_maxima(narrow, items.lists, lead, weights, k, n_docs, n_terms)
    strong = items_of([strong_terms(own, floor, weights, maxima) for own, floor in zip(items.lists, floors.tolist(), strict=True)])
    coordinates = {t: np.unique(np.concatenate([items.lists[i] for i in own.tolist()])) for t, own in strong.items()}
    found = blocks(narrow, weights, coordinates, n_docs, n_terms)
    left = unskipped(found, items.lists, strong, weights, floors)
    return _ranked(scored(left, narrow, items.lists, weights, floors, n_docs, n_terms), k).select("item", "rank", "doc_id", "score")


def ranked_search(
    docs: DataFrame, items: DataFrame, *, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The k highest-scoring documents of each item: item_id, rank, doc_id, score.

    Equal scores are ranked by ascending doc_id, null ids last; a document whose score is 0 is in no result.
    Documents without text have no terms and count nowhere; repeated rows are documents of their own.
    Each row of `items` is an item of its own, also where ids are repeated or null; one without terms, and
    any item over an empty table, gives no rows. Other columns of either table play no part.
    """
    asked = _written(items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")), "lexical-items")
    size = asked.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    parts = max(1, -(-size // ITEM_BYTES))
    spark, item_kind = docs.sparkSession, items.schema[item_col].dataType.simpleString()
    out = None
    for part in range(parts):
        here = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        own = Items.of([(r["item_id"], r["text"]) for r in here.collect()])
        names = spark.createDataFrame(list(enumerate(own.ids)), f"item int, item_id {item_kind}")
        found = search(docs, own, k=k, id_col=id_col, text_col=text_col)
        named = found.join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = named if out is None else out.union(named)
    return out
