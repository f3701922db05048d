"""Near-duplicate vectors by tiles of int8 products with rigorous error bounds.

A vector x of length 1 is kept as int8 codes q and a scale s, with the length e of what
is lost, x - s q. For two vectors the lost part of the product is at most
e_x + |s_x q_x| e_y, so a pair whose quantised product plus this bound stays below the
threshold cannot link. Only the others are computed again in double precision.
Products of codes are whole numbers far below 2**24, so a single-precision matrix
product gives them exactly.

All vectors of a label are compared. Equal vectors are one node with a count. Nodes of
a label are dealt to blocks by hash, and every pair of blocks is one task, whatever
the label's size. A tile reports per node a sum of links and a representative of what
it is connected with, not pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import pin
from .components import components

#: Vectors of one block; a tile holds two.
BLOCK = 1024
_CANDIDATES = 1 << 17


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales, lengths of the coded vectors and of what the coding loses, of rows of length 1."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    coded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(coded, axis=1), np.linalg.norm(x - coded, axis=1)


def tile_links(x: np.ndarray, y: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Index pairs of rows with cosine >= threshold, and how many pairs were computed again.

    With `same`, x and y are one block and each unordered pair is returned once.
    """
    lengths = [np.sqrt(np.einsum("ij,ij->i", v, v)) for v in (x, y)]
    units = [v / n[:, None] for v, n in zip((x, y), lengths, strict=True)]
    (qx, sx, nx, ex), (qy, sy, _, ey) = (quantise(u) for u in units)
    products = (qx.astype(np.float32) @ qy.astype(np.float32).T).astype(np.float64) * sx[:, None] * sy
    products += ex[:, None] + nx[:, None] * ey + 1e-12
    if same:
        products[np.tril_indices(len(x))] = -2
    left, right = np.nonzero(products >= threshold)
    keep = np.zeros(len(left), dtype=bool)
    for at in range(0, len(left), _CANDIDATES):
        a, b = left[at : at + _CANDIDATES], right[at : at + _CANDIDATES]
        keep[at : at + _CANDIDATES] = np.einsum("ij,ij->i", x[a], y[b]) / (lengths[0][a] * lengths[1][b]) >= threshold
    return left[keep], right[keep], len(left)


def _smallest_reached(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index each of `size` nodes reaches over links a, b."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label, new)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def usable(vector: Column, label: Column) -> Column:
    """Whether a row can link: a label, and a vector of finite components that are not all zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(label.isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def near_vectors(
    vectors: DataFrame, *, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of one label link at a cosine of `threshold` (above 0) or more. Rows that are not `usable`, and vectors
    of different lengths, link with nothing. Each of repeated rows is a vector of its own. component_id is the
    smallest id reached, null only if no row reached has an id; kept says whether it is the row's own.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie above 0 and be at most 1")
    label, vector = F.col(label_col), F.col(vector_col)
    rows = vectors.select(
        F.col(id_col).alias("vec_id"), F.when(usable(vector, label), label).alias("label"), F.when(usable(vector, label), vector).alias("vector")
    )
    able = rows.where("vector is not null")
    nodes = pin(
        able.groupBy("label", "vector").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
        .withColumns({"node": F.monotonically_increasing_id(), "width": F.size("vector")})
    )
    sizes = nodes.groupBy("label", "width").agg(F.ceil(F.count(F.lit(1)) / block).alias("n_blocks"))
    dealt = nodes.join(sizes, ["label", "width"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_blocks") - 1))
    tiles = dealt.select("label", "width", "node", "copies", "vector", "block", other.alias("other")).select(
        "label", "width", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "vector"
    )

    def join_tile(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        column = table.column("vector").combine_chunks()
        x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(table), -1)
        node, copies, own, i, j = (table.column(c).to_numpy() for c in ("node", "copies", "block", "i", "j"))
        first = np.flatnonzero(own == i)
        second = first if i[0] == j[0] else np.flatnonzero(own == j)
        if len(first) and len(second):
            a, b, _ = tile_links(x[first], x[second], i[0] == j[0], threshold)
            a, b = first[a], second[b]
        else:
            a = b = np.empty(0, dtype=np.int64)
        links = np.bincount(a, weights=copies[b], minlength=len(node)) + np.bincount(b, weights=copies[a], minlength=len(node))
        linked = np.flatnonzero(links)
        reached = _smallest_reached(len(node), a, b)
        return pa.table({"node": node[linked], "reached": node[reached[linked]], "links": links[linked].astype(np.int64)})

    found = pin(tiles.groupBy("label", "width", "i", "j").applyInArrow(join_tile, "node bigint, reached bigint, links bigint"))
    totals = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("reached").alias("b")))
    named = nodes.select("label", "vector", "node", "least_id", "copies").join(groups, "node", "left").join(totals, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "component").select(
        "label", "vector", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    out = able.join(named, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("vector is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
