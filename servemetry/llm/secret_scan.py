"""Secrets in text: fixed patterns, and strings that a battery of tests finds random.

The method looks at long runs of key characters, split at an inner '=', at the edges of
fixed patterns and, where no alphabet holds them, at marks. For each part it infers the
encoding (the smallest alphabet that holds it) and asks two questions.

Is it random? Chi-squared uniformity over the alphabet, a runs test about the middle of
the alphabet and a lag-one serial correlation, joined by Fisher's rule. A run that
fails is structured (a path, a repeated character, a ruler) and no secret.

Could it be text? The evidence is log2 of the likelihood of the run under the uniform
alphabet over that under the character shares of the corpus. Under text, evidence of b
bits or more has a chance of at most 2**-b, whatever the length, so 2**-b is a p-value.
Benjamini-Hochberg control within bands of length, over all candidates of the corpus,
then sets the bits a run needs. A band full of long ordinary words asks for more.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import pin
from .arrow import by_blocks, map_blocks

#: Kinds of spans in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "random")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Hexadecimal and access spans lie inside such runs, so only these are searched for them.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")

#: Alphabets from small to large (fixed values); a run has the encoding of the first that holds it.
ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base36_upper": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Lower ends of the bands of length in which discoveries are controlled.
BANDS = (20, 24, 32, 48, 64, 128)
_BITS_PER_BIN, _TOP_BIN = 0.25, 1024

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns: leftmost, not overlapping within a kind, failing matches dropped."""
    out: list[Span] = []
    lowered = text.lower()
    if any(w in lowered for w in _ASSIGN_WORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    for run in _RUN.finditer(text):
        out += [("access", *m.span()) for m in _ACCESS.finditer(text, *run.span()) if m.end() - m.start() >= 16]
        out += [("hex", *m.span()) for m in _HEX.finditer(text, *run.span())]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi_squared_tail(x: float, df: int) -> float:
    """Upper tail by the cube-root normal approximation."""
    spread = 2 / (9 * df)
    return _upper_tail(((max(x, 0.0) / df) ** (1 / 3) - (1 - spread)) / math.sqrt(spread))


def randomness(values: np.ndarray, size: int) -> float:
    """Joint p-value of uniformity, runs and serial correlation of symbols 0..size-1; small means structured."""
    n = len(values)
    counts = np.bincount(values, minlength=size)
    uniform = _chi_squared_tail(float((counts.astype(float) ** 2).sum()) * size / n - n, size - 1)
    above = values >= size // 2
    a = int(above.sum())
    b = n - a
    if a and b:
        runs = 1 + int((above[1:] != above[:-1]).sum())
        mean = 1 + 2 * a * b / n
        variance = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        turns = 2 * _upper_tail(abs(runs - mean) / math.sqrt(variance))
    else:
        turns = 2.0 ** (1 - n)
    centred = values - values.mean()
    power = float(centred @ centred)
    serial = 2 * _upper_tail(abs(float(centred[1:] @ centred[:-1]) / power) * math.sqrt(n)) if power else 0.0
    joint = -2 * sum(math.log(max(p, 1e-300)) for p in (uniform, turns, serial))
    half = joint / 2  # the upper tail of chi-squared with six degrees of freedom
    return math.exp(-half) * (1 + half + half * half / 2) if half < 700 else 0.0


_VALUES = {}
for _name, _symbols in ALPHABETS.items():
    _VALUES[_name] = np.full(128, -1)
    _VALUES[_name][[ord(c) for c in _symbols]] = np.arange(len(_symbols))


def infer_encoding(run: str) -> tuple[str, np.ndarray] | None:
    """The first alphabet that holds the run without its padding, and the symbol values."""
    raw = np.frombuffer(run.rstrip("=").encode("ascii"), dtype=np.uint8)
    for name, table in _VALUES.items():
        values = table[raw]
        if len(values) and values.min() >= 0:
            return name, values
    return None


def parts(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """The stretches of a run that are tested: split at inner '=', then whole if an alphabet holds them.

    Those with '+' or '/' and '-' or '_' may be a base64 string beside a path or name, or the other way
    about, so each longest stretch of base64, of base64url and of neither's marks is one; these overlap.
    """
    for piece in _PIECE.finditer(text, start, end):
        if infer_encoding(piece.group()):
            yield piece.span()
        else:
            yield from sorted({m.span() for kind in _PARTS for m in kind.finditer(text, *piece.span())})


_PIECE = re.compile(r"[A-Za-z0-9+/_-]+(?:=+(?![A-Za-z0-9+/_=-]))?")
_PARTS = [re.compile(f"[A-Za-z0-9{marks}]+(?:=+(?![A-Za-z0-9+/_=-]))?") for marks in ("+/", "_-", "")]


def candidates(text: str, taken: list[Span], shares: np.ndarray) -> list[tuple[int, int, float, float]]:
    """Parts of runs with at least BANDS[0] characters outside `taken`: start, end, bits of evidence, randomness."""
    out, spans, passed = [], sorted((s, e) for _, s, e in taken), 0
    reach = np.maximum.accumulate([e for _, e in spans]).tolist()
    for run in _RUN.finditer(text):
        at, free = run.start(), []
        while passed < len(spans) and reach[passed] <= at:  # runs ascend, so these touch no later one either
            passed += 1
        near = passed
        while near < len(spans) and (s := spans[near][0]) < run.end():
            if at < spans[near][1]:
                free.append((at, s))
                at = spans[near][1]
            near += 1
        for start, end in [p for s, e in [*free, (at, run.end())] if e - s >= BANDS[0] for p in parts(text, s, e)]:
            raw = np.frombuffer(text[start:end].rstrip("=").encode("ascii"), dtype=np.uint8)
            if len(raw) < BANDS[0]:
                continue
            name, values = infer_encoding(text[start:end])
            bits = float(-np.log2(shares[raw]).sum() - len(raw) * math.log2(len(ALPHABETS[name])))
            out.append((start, end, bits, randomness(values, len(ALPHABETS[name]))))
    return out


def confirmed(found: list[tuple[int, int, float, float]], needed: Mapping[int, float], alpha: float) -> list[tuple[int, int]]:
    """Start and end of the candidates that are secrets, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for start, end, bits, chance in sorted(found):
        if chance >= alpha and bits >= needed.get(max(b for b in BANDS if b <= end - start), math.inf):
            if out and start < out[-1][1]:
                start, end = out[-1][0], max(end, out.pop()[1])
            out.append((start, end))
    return out


def character_shares(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Share of each ASCII character among the run characters of the whole corpus, with one added count each.

    Every task sends one row of 128 counts, summed in Spark; one row reaches the driver.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    total += np.bincount(np.frombuffer(text.as_buffer(), dtype=np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array([total[:128].tolist()], type=pa.list_(pa.int64()))], names=["counts"])

    per_task = docs.select(text_col).mapInArrow(task, "counts array<bigint>")
    row = per_task.agg(*[F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(128)]).first()
    counts = np.array([row[f"c{i}"] or 0 for i in range(128)], dtype=float)
    keys = np.zeros(128, dtype=bool)
    keys[[ord(c) for c in ALPHABETS["base64"] + "-_="]] = True
    counts = np.where(keys, counts + 1, 0)
    return np.where(keys, counts / counts.sum(), 1.0)


def _band(length: Column) -> Column:
    found = F.lit(BANDS[0])
    for low in BANDS[1:]:
        found = F.when(length >= low, low).otherwise(found)
    return found


def evidence_needed(found: DataFrame, alpha: float, q: float) -> dict[int, float]:
    """Bits each band of length needs so that at most a share q of its discoveries are text.

    Counts per band and quarter bit are at most BANDS x _TOP_BIN rows, whatever the corpus.
    """
    one = found.select(F.explode("candidates").alias("c")).select(
        _band(F.col("c.end") - F.col("c.start")).alias("band"),
        F.when(F.col("c.randomness") < alpha, -1)
        .otherwise(F.least(F.floor(F.greatest(F.col("c.bits"), F.lit(0.0)) / _BITS_PER_BIN), F.lit(_TOP_BIN)))
        .cast("int").alias("bin"),
    )
    counts: dict[int, np.ndarray] = {}
    for row in one.groupBy("band", "bin").count().collect():
        # Structured runs are tested too: they count in the family but are no discoveries.
        counts.setdefault(row["band"], np.zeros(_TOP_BIN + 2))[row["bin"] if row["bin"] >= 0 else _TOP_BIN + 1] = row["count"]
    needed = {}
    for band, histogram in counts.items():
        family = histogram.sum()
        found_at_least = histogram[: _TOP_BIN + 1][::-1].cumsum()[::-1]
        bits = np.arange(_TOP_BIN + 1) * _BITS_PER_BIN
        passing = np.flatnonzero(family * 2.0**-bits <= q * found_at_least)
        if len(passing):
            needed[band] = float(bits[passing[0]])
    return needed


_FOUND = "base array<struct<kind:string,start:bigint,end:bigint>>, candidates array<struct<start:bigint,end:bigint,bits:double,randomness:double>>"


def _found(docs: DataFrame, shares: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    def block(keys: list, texts: list) -> tuple:
        base = [base_spans(t or "") for t in texts]
        more = [candidates(t or "", b, shares) for t, b in zip(texts, base, strict=True)]
        return (
            keys,
            [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in b] for b in base],
            [[dict(zip(("start", "end", "bits", "randomness"), c, strict=True)) for c in m] for m in more],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    return map_blocks(docs, [id_col, text_col], block, f"doc_id {kind}, {_FOUND}")


def secret_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.001, q: float = 0.01) -> DataFrame:
    """One row per document: doc_id, spans (array of kind, start, end in characters, ends exclusive).

    Spans are ordered by start, then kind. `alpha` is the level of the randomness battery, `q` the
    share of false discoveries. Null and empty texts have no spans; repeated rows and null ids are
    kept as they are. What is pinned are spans and candidates, not texts.
    """
    found = pin(_found(docs, character_shares(docs, text_col), id_col, text_col))
    needed = evidence_needed(found, alpha, q)

    def block(keys: list, base: list, more: list) -> tuple:
        spans = []
        for fixed, some in zip(base, more, strict=True):
            random = [("random", *span) for span in confirmed([tuple(c.values()) for c in some], needed, alpha)]
            listed = sorted([tuple(s.values()) for s in fixed] + random, key=lambda s: (s[1], KINDS.index(s[0])))
            spans.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in listed])
        return keys, spans

    kind = found.schema["doc_id"].dataType.simpleString()
    return map_blocks(found, ["doc_id", "base", "candidates"], block, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(text: str, shares: np.ndarray, needed: Mapping[int, float], alpha: float, mark: str = "[secret]") -> str:
    """The text with every span, overlapping ones as one, replaced by a mark."""
    base = base_spans(text)
    spans = [(s, e) for _, s, e in base] + confirmed(candidates(text, base, shares), needed, alpha)
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def without_secrets(docs: DataFrame, *, text_col: str = "text", alpha: float = 0.001, q: float = 0.01) -> DataFrame:
    """All documents with all their columns, secrets in `text_col` replaced by a mark; null texts stay null.

    Texts are read three times (shares, candidates, redaction) and never shuffled.
    """
    shares = character_shares(docs, text_col)
    empty = docs.select(F.lit(0).alias("_id"), F.col(text_col).alias("_text"))
    needed = evidence_needed(_found(empty, shares, "_id", "_text"), alpha, q)

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        return by_blocks(lambda block: [None if t is None else redact(t, shares, needed, alpha) for t in block], pa.string(), texts)

    return docs.withColumn(text_col, clean(text_col))
