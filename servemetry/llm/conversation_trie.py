"""The trie of conversation prefixes, from sorted shards and a skeleton of splitter paths.

A conversation is its path: 24 bytes a turn, 16 of a digest of role and text and 8 of the text's size,
so paths sort byte by byte as sequences of turns. Equal paths are one row with the number of their
conversations. A sample of the paths gives splitters, each cut behind the first turn that tells it from
the sample path before it. A node that is no prefix of a splitter has all its paths in one range, so the
task that walks this range in order finishes it; nodes of the splitters' own trie, the skeleton, which
every task knows, are summed from what each range holds of them.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.storage import pin

#: Bytes of a turn in a path, and those of them that hold the size of its text.
TURN, SIZE = 24, 8
#: Longest splitter in turns, sampled paths for each shard.
SPLITTER_TURNS, SAMPLED = 64, 32
#: Turns of a slice of a conversation, ids of a chunk, and rows held until their parent is known; memory only.
SLICE_TURNS, CHUNK_IDS, HELD_ROWS = 1 << 16, 4096, 50_000
_EMPTY = hashlib.sha256(b"").hexdigest()
_NODE, _PARTIAL, _PARENT = 0, 1, 2


def turn_key(role: str, text: str) -> bytes:
    who, said = role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")
    digest = hashlib.sha256(len(who).to_bytes(8, "big") + who + said).digest()
    return digest[: TURN - SIZE] + len(said).to_bytes(SIZE, "big")


def _batches(rows: Iterator[tuple], schema: StructType, most: int = 8192) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of at most `most`."""
    target, some = to_arrow_schema(schema), []
    for row in rows:
        some.append(row)
        if len(some) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*some, strict=True), target, strict=True)], schema=target)
            some = []
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*some, strict=True), target, strict=True)], schema=target)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def own_paths(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, keys) of every conversation.

    Turns are dealt by ranges of their whole order, so a conversation with most of the rows covers many
    tasks; only its keys come together.
    """
    schema = StructType.fromDDL("conv_id bigint, slice bigint, keys binary")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = TaskContext.get().partitionId() << 32

        def slices() -> Iterator[tuple]:
            conv, keys, at = None, [], begun
            for who, role, text in _rows(batches):
                if who != conv or len(keys) == SLICE_TURNS:
                    if keys:
                        yield conv, at, b"".join(keys)
                    conv, keys, at = who, [], at + 1
                keys.append(turn_key(role, text))
            if keys:
                yield conv, at, b"".join(keys)

        yield from _batches(slices(), schema, 256)

    turns = conversations.select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"), F.spark_partition_id().alias("part"),
    ).where(F.col("conv_id").isNotNull())
    order = ["conv_id", "turn", "role", "text"]
    ranged = turns.repartitionByRange(*order, "part").sortWithinPartitions(*order)
    sliced = ranged.select("conv_id", "role", "text").mapInArrow(task, schema)
    parts = sliced.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("slice", "keys"))).alias("parts"))
    return parts.select("conv_id", F.aggregate("parts", F.expr("X''"), lambda a, x: F.concat(a, x["keys"])).alias("keys"))


def rebuilt_paths(paths: DataFrame) -> DataFrame:
    """(conv_id, path_id, path): the first h turns of conversation c - c % 5, then the own ones behind the first h."""
    heads = paths.where("conv_id % 5 = 0").select(F.col("conv_id").alias("head_of"), F.expr(f"substring(keys, 1, {8 * TURN})").alias("head"))
    own = paths.withColumn("cut", (F.crc32(F.col("conv_id").cast("string")) % 9 * TURN).cast("int"))
    joined = own.join(heads, F.col("head_of") == F.expr("conv_id - conv_id % 5"), "left")
    path = F.expr("concat(coalesce(substring(head, 1, cut), X''), substring(keys, cut + 1))")
    return joined.select("conv_id", path.alias("path")).select("conv_id", F.unhex(F.sha2("path", 256)).alias("path_id"), "path")


def ends(rebuilt: DataFrame) -> DataFrame:
    """(path_id, conv_id, n, ends) of every distinct path: smallest id, count, and digest of all ids.

    Ids are dealt by ranges of path and id and written out in chunks; the digest of a path, which only a
    walk in order can give, then reads few long chunks.
    """
    chunked = StructType.fromDDL("path_id binary, first bigint, last bigint, n bigint, ids string")
    summed = StructType.fromDDL("path_id binary, conv_id bigint, n bigint, ends string")

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks() -> Iterator[tuple]:
            path, ids = None, []
            for of, conv in _rows(batches):
                if of != path or len(ids) == CHUNK_IDS:
                    if ids:
                        yield path, ids[0], ids[-1], len(ids), ",".join(map(str, ids))
                    path, ids = of, []
                ids.append(conv)
            if ids:
                yield path, ids[0], ids[-1], len(ids), ",".join(map(str, ids))

        yield from _batches(chunks(), chunked, 1024)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digests() -> Iterator[tuple]:
            path, least, count, state = None, 0, 0, None
            for of, first, n, ids in _rows(batches):
                if of != path:
                    if state is not None:
                        yield path, least, count, state.hexdigest()
                    path, least, count, state = of, first, 0, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
                count += n
            if state is not None:
                yield path, least, count, state.hexdigest()

        yield from _batches(digests(), summed)

    ranged = rebuilt.select("path_id", "conv_id").repartitionByRange("path_id", "conv_id").sortWithinPartitions("path_id", "conv_id")
    chunks = ranged.mapInArrow(chunk, chunked)
    together = chunks.repartition("path_id").sortWithinPartitions("path_id", "first")
    return together.select("path_id", "first", "n", "ids").mapInArrow(digest, summed)


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with alike."""
    size = min(len(a), len(b)) // TURN
    if a[: size * TURN] == b[: size * TURN]:
        return size
    low, high = 0, size  # the first `low` turns agree, the first `high` do not
    while high - low > 1:
        middle = (low + high) // 2
        if a[low * TURN : middle * TURN] == b[low * TURN : middle * TURN]:
            low = middle
        else:
            high = middle
    return low


def splitters(sample: Sequence[bytes], shards: int) -> list[bytes]:
    """At most shards - 1 ascending borders, each the shortest that tells a sample path from the one before it."""
    ordered = sorted(set(sample))
    found = []
    for n in range(1, min(shards, len(ordered))):
        at = n * len(ordered) // min(shards, len(ordered))
        found.append(ordered[at][: TURN * (common_turns(ordered[at - 1], ordered[at]) + 1)])
    return sorted(set(found))


class Skeleton:
    """The trie of the splitters; node 0 is the root."""

    def __init__(self, borders: Sequence[bytes]):
        self.borders = list(borders)
        self.nodes = {b"": 0}
        self.parents = [-1]
        for border in self.borders:
            for end in range(TURN, len(border) + 1, TURN):
                if border[:end] not in self.nodes:
                    self.parents.append(self.nodes[border[: end - TURN]])
                    self.nodes[border[:end]] = len(self.parents) - 1

    def depth_in(self, path: bytes) -> int:
        """Turns of the path's longest prefix that is a node here; its neighbours among the borders hold it."""
        at = bisect_right(self.borders, path)
        return max((common_turns(path, b) for b in self.borders[max(0, at - 1) : at + 1]), default=0)

    def rows(self) -> list[tuple]:
        """(node, parent, depth, n_bytes, n_inner): n_inner children are in the skeleton themselves."""
        inner = [0] * len(self.parents)
        for p in self.parents[1:]:
            inner[p] += 1
        return [(n, self.parents[n], len(path) // TURN, _size(path, len(path) // TURN), inner[n]) for path, n in self.nodes.items()]

    def ancestors(self) -> list[tuple[int, int]]:
        """(node, node or one above it)."""
        out = []
        for n in range(len(self.parents)):
            above = n
            while above >= 0:
                out.append((n, above))
                above = self.parents[above]
        return out


def _size(path: bytes, depth: int) -> int:
    return int.from_bytes(path[depth * TURN - SIZE : depth * TURN], "big") if depth else 0


class _Open:
    """A node that the walk is inside of."""

    __slots__ = ("depth", "size", "inner", "n", "conv", "kids", "leaves", "saved", "ends", "waiting", "ref")

    def __init__(self, depth: int, size: int, inner: int | None):
        self.depth, self.size, self.inner = depth, size, inner
        self.n = self.kids = self.leaves = self.saved = 0
        self.conv = self.ends = self.ref = None
        self.waiting: list[tuple] = []


def walk(paths: Iterator[tuple], skeleton: Skeleton, first_ref: int) -> Iterator[tuple]:
    """Rows of a range of distinct ascending paths (path, conv_id, n, ends).

    (0, ref, conv_id, depth, parent_conv_id, n, kids, leaves, saved, ends): a finished node. Its parent's id
    is there, or else row ref of the parents: -1 - node of the skeleton, or a row (2, ref, conv_id, ...).
    (1, node, conv_id, ...): what this range holds of a skeleton node. kids, leaves and saved leave out
    those of its children that are in the skeleton.
    """
    stack = [_Open(0, 0, 0)]
    before, held, ref = b"", 0, first_ref

    def close() -> Iterator[tuple]:
        nonlocal held
        node = stack.pop()
        up = stack[-1] if stack else None
        if up is not None:
            up.n += node.n
            up.conv = node.conv if up.conv is None else min(up.conv, node.conv)
        if node.inner is not None:
            if node.n:
                yield _PARTIAL, node.inner, node.conv, node.depth, None, node.n, node.kids, node.leaves, node.saved, node.ends
            return
        leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * node.size
        up.kids, up.leaves, up.saved = up.kids + 1, up.leaves + leaves, up.saved + saved
        for row in node.waiting:
            yield *row[:4], node.conv, *row[5:]
        held -= len(node.waiting)
        if node.ref is not None:
            yield _PARENT, node.ref, node.conv, node.depth, None, None, None, None, None, None
        row = (_NODE, None, node.conv, node.depth, None, node.n, node.kids, leaves, saved, node.ends or _EMPTY)
        if up.inner is not None:
            yield row[0], -1 - up.inner, *row[2:]
        else:
            up.waiting.append(row)
            held += 1

    for path, conv, n, digest in paths:
        shared, depth, inside = common_turns(before, path), len(path) // TURN, skeleton.depth_in(path)
        while stack[-1].depth > shared:
            yield from close()
        for d in range(shared + 1, depth + 1):
            stack.append(_Open(d, _size(path, d), skeleton.nodes[path[: d * TURN]] if d <= inside else None))
        top = stack[-1]
        top.n += n
        top.conv = conv if top.conv is None else min(top.conv, conv)
        top.ends = digest
        before = path
        if held > HELD_ROWS:  # the parents of these rows are named later
            for node in stack:
                if node.waiting:
                    if node.ref is None:
                        node.ref, ref = ref, ref + 1
                    for row in node.waiting:
                        yield row[0], node.ref, *row[2:]
                    node.waiting = []
            held = 0
    while stack:
        yield from close()


def prefix_trie(
    conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns of one conversation are ordered by turn (null first), then role, then text; null roles and texts
    are empty, repeated rows are turns of their own. Rows without a conv_id belong to no conversation; an
    empty table has no nodes, not even a root. A conversation's path, 24 bytes a turn, is one row; paths
    that agree over more than SPLITTER_TURNS turns may share a range, whatever their number. Two turns are
    the same if their 128-bit digests and sizes are. Other columns play no part.
    """
    spark = conversations.sparkSession
    rebuilt = pin(rebuilt_paths(own_paths(conversations, conv_col, turn_col, role_col, text_col)))
    # The path of the smallest id stands for all equal ones, so this join has one row a key on both sides.
    distinct = pin(rebuilt.select("conv_id", "path").join(ends(rebuilt).select("path_id", "conv_id", "n", "ends"), "conv_id"))
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sampled = distinct.select("path_id", F.expr(f"substring(path, 1, {SPLITTER_TURNS * TURN})").alias("path"))
    borders = splitters([bytes(r["path"]) for r in sampled.orderBy("path_id").limit(SAMPLED * shards).collect()], shards)
    skeleton = Skeleton(borders)
    schema = StructType.fromDDL(
        "kind int, ref bigint, conv_id bigint, depth bigint, parent_conv_id bigint, n bigint, kids bigint, leaves bigint, saved bigint, ends string"
    )
    dealt = StructType.fromDDL("shard int, path binary, conv_id bigint, n bigint, ends string")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(((bisect_right(skeleton.borders, row[0]), *row) for row in _rows(batches)), dealt, 1024)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(walk(_rows(batches), skeleton, (TaskContext.get().partitionId() << 33) + 1), schema)

    ranged = distinct.select("path", "conv_id", "n", "ends").mapInArrow(deal, dealt).repartitionById(len(borders) + 1, "shard")
    found = pin(ranged.sortWithinPartitions("path").select("path", "conv_id", "n", "ends").mapInArrow(scan, schema))

    inner = spark.createDataFrame(skeleton.rows(), "node bigint, above bigint, depth bigint, size bigint, n_inner bigint")
    above = spark.createDataFrame(skeleton.ancestors(), "node bigint, top bigint")
    sums = found.where(F.col("kind") == _PARTIAL).groupBy(F.col("ref").alias("node")).agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")], F.max("ends").alias("ends")
    )
    whole = pin(
        sums.join(inner, "node").withColumn("kids", F.col("kids") + F.col("n_inner"))
        .withColumn("leaves", F.col("leaves") + (F.col("kids") == 0).cast("bigint"))
        .withColumn("saved", F.col("saved") + (F.col("n") - 1) * F.col("size"))
    )
    subtrees = whole.join(above, "node").groupBy(F.col("top").alias("node")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    ids = whole.select((-1 - F.col("node")).alias("ref"), F.col("conv_id").alias("of_parent"))
    columns = ["conv_id", "depth", "parent_conv_id", "n", "kids", "leaves", "saved", "ends"]
    skeletal = (
        whole.drop("leaves", "saved").join(subtrees, "node").withColumn("ref", -1 - F.col("above")).join(ids, "ref", "left")
        .withColumn("parent_conv_id", F.col("of_parent")).withColumn("ends", F.coalesce("ends", F.lit(_EMPTY)))
    )
    nodes = found.where(F.col("kind") == _NODE)
    parents = ids.union(found.where(F.col("kind") == _PARENT).select("ref", F.col("conv_id").alias("of_parent")))
    named = nodes.where(F.col("ref").isNotNull()).join(parents, "ref").withColumn("parent_conv_id", F.col("of_parent"))
    every = nodes.where(F.col("ref").isNull()).select(*columns).union(named.select(*columns)).union(skeletal.select(*columns))
    return every.withColumnsRenamed({"n": "n_convs", "kids": "n_children", "leaves": "n_leaves", "saved": "saved_tokens", "ends": "ends_sha256"})
