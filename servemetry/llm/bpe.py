"""Byte-pair encoding by speculation and verification, and decoding.

A word is first cut greedily into the longest tokens. A cut is the true encoding if
every adjacent pair of its tokens is compatible, that is, if exact merging of the
pair's bytes gives this pair again: a merge that would cross a token boundary in the
whole word would cross it in the pair as well. All pairs of a block are tested at
once, each distinct pair by one remembered answer. Only words with an incompatible
pair are merged exactly.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache
from struct import pack

import numpy as np
import regex
from pyspark.sql import DataFrame

from .arrow import map_blocks
from .pieces import Pieces

#: Answers about pairs that a task remembers before it starts afresh; speed only.
REMEMBERED = 500_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """One byte-level vocabulary: merges, greedy trial, and remembered answers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        alphabet = byte_alphabet()
        as_bytes = lambda token: bytes(alphabet[c] for c in token)
        self.ids = {as_bytes(token): i for token, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.tokens: list[bytes] = [b""] * size
        for token, i in self.ids.items():
            self.tokens[i] = token
        for content, i in self.special.items():
            self.tokens[i] = content.encode()
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.size = size
        self.ranks: dict[tuple[int, int], int] = {}
        self.product: list[int] = []
        for left, right in (map(as_bytes, m.split(" ") if isinstance(m, str) else m) for m in model["merges"]):
            self.ranks[self.ids[left], self.ids[right]] = len(self.product)
            self.product.append(self.ids[left + right])
        self.none = len(self.product)
        self.prefixes = {token[:n] for token in self.ids for n in range(2, len(token))}
        self.pattern = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        )
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.compatible: dict[int, bool] = {}
        self.pieces = Pieces(self.encode_strings, list(self.special))
        self.merged_exactly = 0

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the lowest-ranked pair, the leftmost of equals."""
        if len(word) > 64:
            return self._merge_long(word)
        ranks, product, none = self.ranks, self.product, self.none
        parts = [self.ids[word[i : i + 1]] for i in range(len(word))]
        order = [ranks.get(pair, none) for pair in zip(parts, parts[1:], strict=False)]
        while order and (best := min(order)) < none:
            i = order.index(best)
            parts[i : i + 2] = [product[best]]
            del order[i]
            if i:
                order[i - 1] = ranks.get((parts[i - 1], parts[i]), none)
            if i < len(order):
                order[i] = ranks.get((parts[i], parts[i + 1]), none)
        return parts

    def _merge_long(self, word: bytes) -> list[int]:
        """The same with a heap of pairs, for words without white space of any length."""
        ranks, product = self.ranks, self.product
        parts = [self.ids[word[i : i + 1]] for i in range(len(word))]
        end = len(parts)
        following, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = [(ranks[pair], i, *pair) for i, pair in enumerate(zip(parts, parts[1:], strict=False)) if pair in ranks]
        heapq.heapify(heap)
        while heap:
            best, i, a, b = heapq.heappop(heap)
            j = following[i]
            if parts[i] != a or j >= end or parts[j] != b:
                continue
            parts[i], parts[j] = product[best], -1
            following[i] = k = following[j]
            if k < end:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right < end and (pair := (parts[left], parts[right])) in ranks:
                    heapq.heappush(heap, (ranks[pair], left, *pair))
        return [p for p in parts if p >= 0]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]
        out, at, end, ids, prefixes = [], 0, len(word), self.ids, self.prefixes
        while at < end:
            best, here, stop = ids[word[at : at + 1]], at + 1, at + 2
            while stop <= end:
                part = word[at:stop]
                if (i := ids.get(part)) is not None:
                    best, here = i, stop
                if part not in prefixes:
                    break
                stop += 1
            out.append(best)
            at = here
        return out

    def _known(self, key: int) -> bool:
        """Whether a pair (or, for a key of one token, the token alone) comes out of exact merging as it is."""
        left, right = divmod(key, self.size + 1)
        wanted = [left] if right == self.size else [left, right]
        return self.merge(b"".join(self.tokens[i] for i in wanted)) == wanted

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Token ids (little-endian, 32 bits) of each word: proposals, one test of all pairs, exact merging of the rest."""
        proposals = [self.propose(w) for w in words]
        sizes = np.fromiter(map(len, proposals), dtype=np.int64, count=len(words))
        flat = np.fromiter((i for p in proposals for i in p), dtype=np.int64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        right = np.append(flat[1:], self.size)
        ends = np.cumsum(sizes) - 1
        alone = sizes == 1
        inner = np.ones(len(flat), dtype=bool)
        inner[ends[~alone]] = False
        right[ends[alone]] = self.size
        keys, at = np.unique(flat[inner] * (self.size + 1) + right[inner], return_inverse=True)
        answers = np.empty(len(keys), dtype=bool)
        for n, key in enumerate(keys.tolist()):
            answer = self.compatible.get(key)
            if answer is None:
                answer = self.compatible[key] = self._known(key)
            answers[n] = answer
        failing = np.unique(owner[inner][~answers[at]])
        packed, stops = flat.astype("<u4").tobytes(), (4 * ends + 4).tolist()
        out = [packed[a:b] for a, b in zip([0, *stops], stops, strict=False)]
        for n in failing.tolist():
            ids = self.merge(words[n])
            out[n] = pack(f"<{len(ids)}I", *ids)
        self.merged_exactly += len(failing)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.compatible) > REMEMBERED:
            self.compatible.clear()
        return self.pieces.encode(texts)

    def encode_strings(self, texts: list[str]) -> list[bytes]:
        """The same without remembering pieces: added tokens, then words, each distinct word once."""
        cuts: list[list] = []
        for text in texts:
            at, parts = 0, []
            for m in self.special_pattern.finditer(text) if self.special_pattern else ():
                parts += [*self._words(text[at : m.start()]), self.special[m.group()]]
                at = m.end()
            cuts.append(parts + self._words(text[at:]))
        distinct = list({w for parts in cuts for w in parts if isinstance(w, str)})
        ids = dict(zip(distinct, self.encode_words([w.encode("utf-8", "surrogatepass") for w in distinct]), strict=True))
        return [b"".join([ids[w] if isinstance(w, str) else w.to_bytes(4, "little") for w in parts]) for parts in cuts]

    def _words(self, text: str) -> list[str]:
        """Words of a text; most are a space and letters, and perhaps a stop."""
        if text.isascii() and text[:1] == " ":
            if text[1:].isalpha():
                return [text]
            if text[-1] in ".," and text[1:-1].isalpha():
                return [text[:-1], text[-1]]
        return self.pattern.findall(text)

    def decode(self, ids: np.ndarray) -> str:
        """The text of token ids; bytes that are not UTF-8 become replacement characters."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids.tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file; a worker process loads it once."""
    return Encoder(path)


def encode_documents(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts, then decode the ids again: doc_id, ids (little-endian unsigned 32-bit), decoded.

    One row per input row, without a shuffle; null texts count as empty and give no ids.
    """

    def block(keys: list, texts: list) -> tuple:
        e = encoder(vocabulary)
        ids = e.encode([t or "" for t in texts])
        return keys, ids, [e.decode(np.frombuffer(i, dtype="<u4")) for i in ids]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_blocks(docs, [id_col, text_col], block, f"doc_id {kind}, ids binary, decoded string")


def decode_documents(encoded: DataFrame, vocabulary: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decode ids (little-endian unsigned 32-bit) to texts; null ids give a null text."""

    def block(keys: list, ids: list) -> tuple:
        e = encoder(vocabulary)
        return keys, [None if i is None else e.decode(np.frombuffer(i, dtype="<u4")) for i in ids]

    kind = encoded.schema[id_col].dataType.simpleString()
    return map_blocks(encoded, [id_col, ids_col], block, f"doc_id {kind}, decoded string")
