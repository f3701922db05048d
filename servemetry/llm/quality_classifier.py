"""A quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

Words are runs of letters and digits and runs of other visible characters, as they are written. A text's
vector holds the logarithmic counts of its hashed words and word pairs, a word beside itself being one
and the same pair whatever the word, scaled to length 1. Training examples are dealt to shards; in each
round every shard goes once through its own from the common state, and the shards' states are averaged,
so neither the driver nor any task holds more than one state beside its shard. Scores are sparse dot
products of a text's vector and the weights.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.storage import pin
from .arrow import BLOCK_ROWS, map_blocks

#: Bits of a hashed n-gram; the last slot is the intercept.
BITS = 18
SLOTS = (1 << BITS) + 1
#: Characters of a text worked on at once (speed and memory only; cuts fall between words), and words remembered.
SLICE, REMEMBERED = 1 << 16, 400_000
_WORD = re.compile(r"[^\W_]+|[^\w\s]+|_+")
_MIX, _SAME = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x5851F42D4C957F2D)


class Hasher:
    """Hashes of words, remembered."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.array([known[w] for w in words], dtype=np.uint64)
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for w in set(words):
                if w not in known:
                    raw = w.encode("utf-8", "surrogatepass")
                    known[w] = zlib.crc32(raw) << 32 | zlib.adler32(raw)
            return np.array([known[w] for w in words], dtype=np.uint64)


def _slices(text: str) -> Iterator[str]:
    """Parts of a text that end at white space, so no word is cut."""
    at = 0
    while at < len(text):
        end = at + SLICE
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end


def n_grams(text: str | None, hashed: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Slots in ascending order and values of a whole text's vector; empty for one without words."""
    slots, before = [], np.zeros(0, dtype=np.uint64)
    for part in _slices(text or ""):
        words = hashed(_WORD.findall(part))
        if not len(words):
            continue
        both = np.concatenate((before, words))
        left, right = both[:-1], both[1:]
        pairs = np.where(left == right, _SAME, (left * _MIX) ^ (right + (left << np.uint64(7))))
        mixed = np.concatenate((words, pairs)) * _MIX
        found, counts = np.unique(mixed >> np.uint64(64 - BITS), return_counts=True)
        slots.append((found, counts))
        before = words[-1:]
    if not slots:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    found, at = np.unique(np.concatenate([s for s, _ in slots]), return_inverse=True)
    values = np.log1p(np.bincount(at, weights=np.concatenate([c for _, c in slots])))
    return found.astype(np.int64), values / np.linalg.norm(values)


@dataclass(frozen=True)
class Rates:
    """Learning rate and regularisation of follow-the-regularised-leader."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.005
    l2: float = 0.001

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        pull = np.maximum(np.abs(z) - self.l1, 0) * -np.sign(z)
        return pull / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)


def _probability(margin: float | np.ndarray) -> float | np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -60, 60)))


def learn(z: np.ndarray, n: np.ndarray, label: int, slots: np.ndarray, values: np.ndarray, rates: Rates) -> None:
    """One example's update of the state, in place."""
    at, x = np.append(slots, SLOTS - 1), np.append(values, 1.0)
    w = rates.weights(z[at], n[at])
    gradient = (_probability(w @ x) - label) * x
    squared = gradient * gradient
    z[at] += gradient - (np.sqrt(n[at] + squared) - np.sqrt(n[at])) / rates.alpha * w
    n[at] += squared


def held_out(id_col: str | Column, folds: int = 5) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text, modulo `folds`, is 0. A null id counts as empty text and is held out."""
    key = F.coalesce((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string"), F.lit(""))
    return F.crc32(key) % folds == 0


def examples(docs: DataFrame, labels: DataFrame, most: int, shards: int, id_col: str, text_col: str, label_col: str, folds: int) -> DataFrame:
    """(label, slots, values) of at most `most` labelled rows outside the held-out fold, by a hash of their ids; fixed, a partition a shard.

    Ids with a null or another label than 0 and 1, with labels that disagree, or without a document teach nothing.
    """
    agreed = (
        labels.where(F.col(id_col).isNotNull() & ~held_out(id_col, folds)).groupBy(F.col(id_col).alias("labelled"))
        .agg(F.min(label_col).alias("label"), F.max(label_col).alias("other"), F.count_if(F.col(label_col).isNull()).alias("nulls"))
        .where("label = other AND nulls = 0 AND label IN (0, 1)")
    )
    chosen = agreed.select("labelled", F.col("label").cast("int").alias("label"), F.xxhash64("labelled").alias("place")).orderBy("place", "labelled").limit(most)
    # At most `most` narrow rows are broadcast. Repeated rows of one document are one example.
    texts = docs.select(F.col(id_col).alias("labelled"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "labelled").dropDuplicates(["labelled", "text"])
    schema = "place bigint, label int, slots array<int>, values array<float>"

    def block(places: list, marks: list, found: list) -> tuple:
        hashed = _hasher()
        vectors = [n_grams(t, hashed) for t in found]
        return places, marks, [s.astype(np.int32) for s, _ in vectors], [v.astype(np.float32) for _, v in vectors]

    made = map_blocks(texts, ["place", "label", "text"], block, schema, rows=64)
    shard = F.pmod("place", F.lit(shards)).cast("int").alias("shard")
    return pin(made.select("*", shard).repartitionById(shards, "shard").sortWithinPartitions("place", "label").select("label", "slots", "values"))


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    max_examples: int = 8192, shards: int = 4, rounds: int = 5, folds: int = 5, rates: Rates = Rates(),
) -> np.ndarray:
    """Weights of the slots, float32, from a bounded sample of labelled rows.

    The sample's bound is `max_examples`, and the state has SLOTS entries whatever the data hold. Without
    examples all weights are 0 and every score is a half.
    """
    rows = examples(docs, labels, max_examples, shards, id_col, text_col, label_col, folds)
    schema = StructType.fromDDL("z binary, n binary")
    z, n = np.zeros(SLOTS, dtype=np.float32), np.zeros(SLOTS, dtype=np.float32)
    for _ in range(rounds):
        start = (z, n)

        def one_shard(batches: Iterator[pa.RecordBatch], start: tuple = start) -> Iterator[pa.RecordBatch]:
            own_z, own_n, seen = start[0].astype(np.float64), start[1].astype(np.float64), False
            for batch in batches:
                offsets = batch.column("slots").offsets.to_numpy()
                slots = batch.column("slots").flatten().to_numpy().astype(np.int64)
                values = batch.column("values").flatten().to_numpy().astype(np.float64)
                cuts = (offsets - offsets[0]).tolist()
                for label, low, high in zip(batch.column("label").to_pylist(), cuts, cuts[1:], strict=False):
                    learn(own_z, own_n, label, slots[low:high], values[low:high], rates)
                    seen = True
            if seen:
                state = [pa.array([x.astype(np.float32).tobytes()], type=pa.binary()) for x in (own_z, own_n)]
                yield pa.RecordBatch.from_arrays(state, schema=to_arrow_schema(schema))

        # Two arrays of SLOTS numbers a shard reach the driver, however many examples there are.
        states = [tuple(np.frombuffer(x, dtype=np.float32) for x in r) for r in rows.mapInArrow(one_shard, schema).collect()]
        if not states:
            break
        # A slot moves by the mean over the shards that saw it.
        moved = np.maximum(1, sum((own_n != n).astype(np.float32) for _, own_n in states))
        z, n = z + sum(own_z - z for own_z, _ in states) / moved, n + sum(own_n - n for _, own_n in states) / moved
    return rates.weights(z, n).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row by its whole text alone; null and empty texts have no words and get the intercept's score."""
    kind = docs.schema[id_col].dataType.simpleString()

    def block(keys: list, texts: list) -> tuple:
        hashed, out = _hasher(), []
        for text in texts:
            slots, values = n_grams(text, hashed)
            out.append(float(_probability(float(weights[slots].astype(np.float64) @ values) + float(weights[-1]))))
        return keys, out

    return map_blocks(docs, [id_col, text_col], block, f"doc_id {kind}, score double", rows=BLOCK_ROWS // 4)


_HASHER: list[Hasher] = []


def _hasher() -> Hasher:
    """The hasher of a worker process."""
    if not _HASHER:
        _HASHER.append(Hasher())
    return _HASHER[0]


def classify(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    threshold: float = 0.3, folds: int = 5, max_examples: int = 8192,
) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1, higher where label 1 is likelier), predicted.

    Scores come from texts alone. Repeated rows are scored alike, each on its own row; a null id is held
    out; an empty table gives no rows. Other columns of either table play no part.
    """
    weights = train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, folds=folds, max_examples=max_examples)
    found = score(docs, weights, id_col=id_col, text_col=text_col)
    return found.select("doc_id", held_out("doc_id", folds).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
