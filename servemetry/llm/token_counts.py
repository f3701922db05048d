"""Token counts of the sections of documents, from one encoding of each whole document.

A document is encoded once. The character spans of its tokens are joined, as
intervals, with the spans of its sections; a token that crosses a boundary goes to
the section an explicit rule names:

largest  the section that holds most of its characters, the first of equals
first    the section of its first character
split    each section gets the share of the token's characters that it holds

A token of bytes inside one character spans that whole character. Tokens outside all
sections count nowhere.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_blocks
from .bpe import Encoder, encoder

RULES = ("largest", "first", "split")

#: A section: name, first character, end (exclusive).
Section = tuple[str, int, int]


def lines_of(text: str) -> list[Section]:
    """Every line with its line feed is a section, named by its number; an empty text is one empty line."""
    out, at = [], 0
    for n, line in enumerate(text.split("\n")):
        end = min(at + len(line) + 1, len(text))
        out.append((str(n), at, end))
        at = end
    return out


def token_spans(e: Encoder, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end (exclusive) of each token."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    begun = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    ends = np.cumsum(e.lengths[ids])
    starts = ends - e.lengths[ids]
    return begun[np.minimum(starts + 1, len(raw))] - 1, begun[ends]


def allocate(starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section and, of those, how many cross a boundary; sections are ascending and do not overlap."""
    counts, crossing = np.zeros(len(low)), np.zeros(len(low), dtype=np.int64)
    if not len(low) or not len(starts):
        return counts, crossing
    first = np.searchsorted(high, starts, side="right")
    last = np.searchsorted(low, ends, side="left") - 1
    whole = (first == last) & (starts >= low[np.minimum(first, len(low) - 1)]) & (ends <= high[np.minimum(first, len(low) - 1)])
    counts += np.bincount(first[whole], minlength=len(low))
    for t in np.flatnonzero(~whole & (first <= last)).tolist():
        held = np.minimum(high[first[t] : last[t] + 1], ends[t]) - np.maximum(low[first[t] : last[t] + 1], starts[t])
        if held.max() <= 0:
            continue
        if rule == "split":
            counts[first[t] : last[t] + 1] += np.maximum(held, 0) / (ends[t] - starts[t])
            crossing[first[t] : last[t] + 1] += held > 0
            continue
        if rule == "first" and not low[first[t]] <= starts[t] < high[first[t]]:
            continue
        to = first[t] + (int(held.argmax()) if rule == "largest" else 0)
        counts[to] += 1
        crossing[to] += 1
    return counts, crossing


def section_token_counts(
    docs: DataFrame, vocabulary: str, *, sections_col: str | None = None, sections_of: Callable[[str], Sequence[Section]] = lines_of,
    rule: str = "largest", id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per section: doc_id, section, start, end, n_tokens (double), n_crossing.

    Sections come from `sections_col` (array of structs name, start, end) or else from `sections_of`.
    They may leave gaps; they are put in order, and each must end before the next begins: where given
    sections of a document overlap, or have a null bound or one after the other, all of its rows have
    null counts. Null texts and documents with no or null sections give no rows; an empty text gives sections without
    tokens; repeated rows are counted each on its own. Texts are not shuffled.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def block(keys: list, texts: list, given: list | None = None) -> tuple:
        e = encoder(vocabulary)
        out: list[tuple] = []
        ids = e.encode([t or "" for t in texts])
        for n, (key, text) in enumerate(zip(keys, texts, strict=True)):
            if text is None:
                continue
            found = [(s["name"], s["start"], s["end"]) for s in given[n] or [] if s is not None] if given is not None else sections_of(text)
            found = sorted(found, key=lambda s: (s[1] is not None, s[1] or 0, s[2] or 0))
            if any(s[1] is None or s[2] is None or s[1] > s[2] for s in found) or any(a[2] > b[1] for a, b in zip(found, found[1:], strict=False)):
                out.extend((key, *s, None, None) for s in found)
                continue
            low, high = (np.array([s[k] for s in found], dtype=np.int64) for k in (1, 2))
            counts, crossing = allocate(*token_spans(e, text, np.frombuffer(ids[n], dtype="<u4").astype(np.int64)), low, high, rule)
            out.extend((key, *s, c, x) for s, c, x in zip(found, counts.tolist(), crossing.tolist(), strict=True))
        return tuple(zip(*out, strict=True)) if out else ((),) * 6

    kind = docs.schema[id_col].dataType.simpleString()
    columns = [id_col, text_col, *([sections_col] if sections_col else [])]
    return map_blocks(docs, columns, block, f"doc_id {kind}, section string, start bigint, end bigint, n_tokens double, n_crossing bigint")


def with_sections(docs: DataFrame, sections: DataFrame, *, id_col: str = "doc_id", into: str = "sections") -> DataFrame:
    """Documents with their rows of `sections` (doc_id, name, start, end) as an array; one document's sections are bounded by its text."""
    listed = sections.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("start", "end", "name"))).alias(into))
    return docs.join(listed, id_col, "left")
