"""Encoding of texts piece by piece, with arrays instead of a dictionary of words.

Where no two white-space characters follow each other, a byte-level tokenizer cuts a word
before every space, so the ids of a text are those of its pieces, each beginning at a
space, one after the other. A block of texts is one byte buffer: pieces are looked up by a
polynomial hash of 64 bits, new ones are encoded once, and the ids of all pieces are
gathered at once. The bytes of every piece are compared with those that its hash stands
for; where two pieces share one, the slice is encoded without hashes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np

#: Pieces a task remembers before it starts afresh (some 50 bytes each), and bytes worked on at once; speed only.
REMEMBERED, SLICE = 800_000, 1 << 18
#: Pieces that are encoded as one text; speed only.
JOINED = 256
#: Odd base of the hash (fixed value).
_BASE = 0x9E3779B97F4A7C15
_DOUBLE_WHITE = re.compile(r"\s\s")


def _powers(base: int, size: int) -> np.ndarray:
    out = np.ones(size, dtype=np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


class Pieces:
    """Ids of texts by `encode_all`, a function from strings to their ids as little-endian 32-bit bytes.

    With `widths`, the number of bytes that each id stands for, new pieces are encoded many at a time, as one
    text, and its ids are cut where a piece's bytes end. If they can't be cut there, each piece is encoded for itself.
    """

    def __init__(self, encode_all: Callable[[list[str]], Sequence[bytes]], added: Sequence[str], widths: np.ndarray | None = None):
        self.encode_all, self.added, self.widths = encode_all, list(added), widths
        self.powers, self.inverses = _powers(_BASE, SLICE + 1), _powers(pow(_BASE, -1, 1 << 64), SLICE + 1)
        self.forget()

    def forget(self) -> None:
        """Give up what is remembered."""
        # Names ascend and slots tell where a name's piece stands: its bytes in text and its ids in ids.
        self.names, self.slots = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        self.begins, self.starts = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        self.text, self.ids = np.empty(0, dtype=np.uint8), np.empty(0, dtype=np.uint32)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        Texts with white space beside white space, or that may hold an added token, are encoded whole.
        """
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        whole = [(w and bool(_DOUBLE_WHITE.search(t))) or any(a in t for a in self.added) for t, w in zip(texts, _may_have_double_white(raw), strict=True)]
        out = iter(self.encode_all([t for t, w in zip(texts, whole, strict=True) if w]))
        split = iter(self._split([r for r, w in zip(raw, whole, strict=True) if not w]))
        return [next(out) if w else next(split) for w in whole]

    def _split(self, texts: list[bytes]) -> list[bytes]:
        if not texts:
            return []
        raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        begins = raw == 0x20
        begins[(ends - [len(t) for t in texts])[[len(t) > 0 for t in texts]]] = True
        starts = np.flatnonzero(begins)
        stops = np.append(starts[1:], len(raw))[: len(starts)]
        # Slices of whole pieces; a longer piece is a slice of its own and encoded apart.
        parts, counts, at = [], [], 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(stops, starts[at] + SLICE, side="right")))
            ids, n = self._slice(raw, starts[at:to], stops[at:to])
            parts.append(ids)
            counts.append(n)
            at = to
        packed = b"".join(parts)
        upto = np.concatenate(([0], np.cumsum(np.concatenate(counts)))) if counts else np.zeros(1, dtype=np.int64)
        cuts = (4 * upto[np.searchsorted(starts, ends)]).tolist()
        return [packed[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def _slice(self, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Ids of the pieces in order, and how many each has."""
        first, last = int(starts[0]), int(stops[-1])
        if last - first > SLICE:
            (ids,) = self.encode_all([raw[first:last].tobytes().decode("utf-8", "surrogatepass")])
            return ids, np.array([len(ids) // 4])
        text, low, high = raw[first:last], starts - first, stops - first
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * self.powers[: len(text)], dtype=np.uint64)))
        names, where, each = np.unique((sums[high] - sums[low]) * self.inverses[low], return_index=True, return_inverse=True)
        sizes, stands = high - low, where[each]
        if not _alike(text, low, sizes, text, low[stands], sizes[stands]):
            return self._plainly(text, low, high)
        at = np.searchsorted(self.names, names)
        known = np.zeros(len(names), dtype=bool)
        inside = at < len(self.names)
        known[inside] = self.names[at[inside]] == names[inside]
        old = where[known]
        slot = self.slots[at[known]]
        if not _alike(text, low[old], sizes[old], self.text, self.begins[slot], self.begins[slot + 1] - self.begins[slot]):
            return self._plainly(text, low, high)
        if not known.all():
            if len(self.names) > REMEMBERED:
                self.forget()
                known[:] = False
                at[:] = 0
            new = np.flatnonzero(~known)
            fresh = where[new]
            found, counts = self._fresh(text, low[fresh], high[fresh])
            slots = len(self.begins) - 1 + np.arange(len(new))
            self.ids, self.text = np.concatenate((self.ids, found)), np.concatenate((self.text, text[_spread(low[fresh], sizes[fresh])]))
            self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(counts)))
            self.begins = np.concatenate((self.begins, self.begins[-1] + np.cumsum(sizes[fresh])))
            at = at + np.cumsum(~known) - ~known
            kept = np.ones(len(self.names) + len(new), dtype=bool)
            kept[at[new]] = False
            self.names, self.slots = _merged(kept, self.names, names[new]), _merged(kept, self.slots, slots)
        slot = self.slots[at]
        start = self.starts[slot]
        n = (self.starts[slot + 1] - start)[each]
        return self.ids[_spread(start[each], n)].astype("<u4").tobytes(), n

    def _fresh(self, text: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces, one after the other, and how many each has."""
        data, joined = text.tobytes(), np.zeros(len(low), dtype=bool)
        counts, parts = np.zeros(len(low), dtype=np.int64), []
        if self.widths is not None:
            # Only pieces that begin at a space and end in no white space, so that no white space meets another. Of the
            # characters beyond ASCII that means those of two bytes from U+00C0 on.
            last, lead = text[high - 1], text[np.maximum(high - 2, low)]
            likely = np.flatnonzero((text[low] == 0x20) & (((last > 0x20) & (last < 0x7F)) | ((last >= 0x80) & (lead >= 0xC3) & (lead <= 0xDF))))
            groups = [likely[at : at + JOINED] for at in range(0, len(likely), JOINED)]
            texts = [text[_spread(low[g], high[g] - low[g])].tobytes().decode("utf-8", "surrogatepass") for g in groups]
            for g, ids in zip(groups, self.encode_all(texts), strict=True):
                ids = np.frombuffer(ids, dtype="<u4")
                ends, wanted = np.cumsum(self.widths[ids]), np.cumsum(high[g] - low[g])
                at = np.searchsorted(ends, wanted)
                if len(ends) and ends[-1] == wanted[-1] and (ends[at] == wanted).all():
                    joined[g] = True
                    counts[g] = np.diff(at + 1, prepend=0)
                    parts.append((g, ids))
        alone = np.flatnonzero(~joined)
        found = self.encode_all([data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(low[alone].tolist(), high[alone].tolist(), strict=True)])
        counts[alone] = [len(ids) // 4 for ids in found]
        out, begun = np.empty(int(counts.sum()), dtype=np.uint32), np.cumsum(counts) - counts
        for g, ids in [*parts, (alone, np.frombuffer(b"".join(found), dtype="<u4"))]:
            out[_spread(begun[g], counts[g])] = ids
        return out, counts

    def _plainly(self, text: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The same by the pieces themselves."""
        data = text.tobytes()
        words = [data[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
        distinct = list(dict.fromkeys(words))
        ids = dict(zip(distinct, self.encode_all([w.decode("utf-8", "surrogatepass") for w in distinct]), strict=True))
        return b"".join([ids[w] for w in words]), np.array([len(ids[w]) // 4 for w in words], dtype=np.int64)


#: Bytes of white space, and those that begin a white-space character beyond ASCII.
_WHITE, _LEADS = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def _may_have_double_white(texts: list[bytes]) -> list[bool]:
    """False only for texts in which no two white-space characters follow each other."""
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    white, leads = _WHITE[raw], _LEADS[raw]
    leads[1:] |= white[1:] & white[:-1]
    out = np.zeros(len(texts), dtype=bool)
    out[np.searchsorted(np.cumsum([len(t) for t in texts]), np.flatnonzero(leads), side="right")] = True
    return out.tolist()


def _merged(kept: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Old values where `kept`, new ones elsewhere, each in their order."""
    out = np.empty(len(kept), dtype=old.dtype)
    out[kept], out[~kept] = old, new
    return out


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of stretches that begin at `starts`, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _alike(a: np.ndarray, a_starts: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_starts: np.ndarray, b_sizes: np.ndarray) -> bool:
    """Whether all stretches of `a` have the bytes of those of `b`."""
    return bool((a_sizes == b_sizes).all()) and bool((a[_spread(a_starts, a_sizes)] == b[_spread(b_starts, b_sizes)]).all())
