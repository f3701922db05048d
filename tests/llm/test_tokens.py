"""Byte-pair encoding, token counts and packing against the tokenizer library and brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from servemetry.llm import bpe, packing, pieces, queries, token_counts

from ..conftest import SMALL

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def ids_of(e, text):
    return np.frombuffer(e.encode([text])[0], dtype="<u4").tolist()


def test_encoder_equals_library_on_mixed_strings(library):
    rng = random.Random(5)
    parts = ["a", "the", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "　", "é", "²", "½", "漢", "😀", "'s", "'LL", "12", "_", "<|endoftext|>", "\x00", "ſ", "İ", "...", "ABC"]
    strings = ["", *("".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(3000))]
    e = bpe.Encoder(PATH)
    want = [x.ids for x in library.encode_batch(strings, add_special_tokens=False)]
    assert [ids_of(e, s) for s in strings] == want
    assert [np.frombuffer(i, dtype="<u4").tolist() for i in packing.library_ids(PATH).encode(strings)] == want
    for s in strings[:500]:
        ids = ids_of(e, s)
        assert e.decode(np.array(ids, dtype=np.int64)) == library.decode(ids, skip_special_tokens=False)


def test_encoder_equals_library_on_long_words(library):
    rng = random.Random(6)
    words = ["".join(rng.choices("etaoinshrdlu", k=n)) for n in (40, 64, 65, 66, 300, 5000)] + ["a" * 3000, "ab" * 900]
    e = bpe.Encoder(PATH)
    assert [ids_of(e, w) for w in words] == [x.ids for x in library.encode_batch(words, add_special_tokens=False)]


def test_new_pieces_joined_or_alone_give_the_library_ids(library):
    """Odd white space, added tokens and letters of one to four bytes at the ends of pieces; widths that do not add up change nothing."""
    rng = random.Random(21)
    some = ["a", "the", " ", " ", "\n", "\t", "\x1c", "\u00a0", "\u0085", "\u2003", "\u3000", "\u00e9", "\u0301", "\u07ff", "\u0800", "\U0001f600", "'s", "12", "!", "<|endoftext|>", "<|"]
    strings = ["".join(rng.choice(some) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + [" " + "x" * 5000, "", " "]
    want = [e.ids for e in library.encode_batch(strings, add_special_tokens=False)]
    joined = packing.library_ids(PATH)
    for widths in (joined.widths, None, np.ones_like(joined.widths), np.zeros_like(joined.widths)):
        e = pieces.Pieces(joined.encode_all, joined.added, widths)
        assert [np.frombuffer(i, dtype="<u4").tolist() for i in e.encode(strings)] == want
    seen = []
    e = pieces.Pieces(lambda texts: seen.append(len(texts)) or joined.encode_all(texts), joined.added, joined.widths)
    e.encode([" ".join(f"w{i}" for i in range(3 * pieces.JOINED))])
    assert max(seen) <= 3  # as three texts, and the first piece alone


def test_pieces_whose_hashes_collide(library):
    """Thue-Morse words of 1,024 letters and more have the hash of their complements."""
    e = bpe.Encoder(PATH)
    for size in (1024, 2048):
        word = "a"
        while len(word) < size:
            word += word.translate({97: 98, 98: 97})
        other = word.translate({97: 98, 98: 97})
        texts = [f"x {word} {other} y", f"x {other} y", f"{word}", f"a {word} b", "plain text", f"{other} {word}"]
        want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
        for encode in (e.encode, packing.library_ids(PATH).encode):
            assert [np.frombuffer(i, dtype="<u4").tolist() for i in encode(texts)] == want
            assert [np.frombuffer(encode([t])[0], dtype="<u4").tolist() for t in reversed(texts)] == want[::-1]


def test_most_words_are_verified_and_failing_ones_merged():
    e = bpe.Encoder(PATH)
    words = [b" the", b" reading", b" zzzthe", b" unbelievably"]
    exact = [e.merge(w) for w in words]
    assert [np.frombuffer(i, dtype="<u4").tolist() for i in e.encode_words(words)] == exact
    assert e.merged_exactly < len(words)
    wrong = [w for w in words if e.propose(w) != e.merge(w)]
    assert e.merged_exactly >= len(wrong)


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    monkeypatch.setattr(pieces, "REMEMBERED", 10)
    monkeypatch.setattr(pieces, "SLICE", 64)
    e = bpe.Encoder(PATH)
    strings = [f"word{n} and more text{n % 7}, again" for n in range(60)] * 2
    strings.append("x" * 500 + " y " + "z" * 90)
    for s, x in zip(strings, library.encode_batch(strings, add_special_tokens=False), strict=True):
        assert ids_of(e, s) == x.ids
    assert [np.frombuffer(i, dtype="<u4").tolist() for i in e.encode(strings)] == [x.ids for x in library.encode_batch(strings, add_special_tokens=False)]


def test_round_trip_query_equals_library(spark, texts, library):
    got = {r["doc_id"]: r for r in queries.op2_bpe_round_trip(spark, SMALL).collect()}
    assert got.keys() == texts.keys()
    for key, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[key]["n_tokens"] == len(ids)
        assert got[key]["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[key]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


ODD = [(1, None, None, None, None), (None, "two words", "en", "s", 9), (3, "", "en", "s", 0), (3, "", "en", "s", 0), (4, "x" * 50_000, "en", "s", 50_000)]


def test_encode_odd_rows(spark, library):
    docs = spark.createDataFrame(ODD, DOCS).withColumns({"ids": F.lit(1), "decoded": F.lit("clash")})
    got = sorted(((r["doc_id"] or 0), r["decoded"]) for r in bpe.encode_documents(docs, PATH).collect())
    assert got == [(0, "two words"), (1, ""), (3, ""), (3, ""), (4, "x" * 50_000)]
    back = bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH).collect()
    assert sorted(r["decoded"] for r in back) == sorted(t for _, t in got)
    assert bpe.encode_documents(docs.limit(0), PATH).collect() == []


def brute_sections(library, text, sections, rule):
    counts = [0.0] * len(sections)
    encoding = library.encode(text, add_special_tokens=False)
    for start, end in encoding.offsets:
        held = [max(0, min(end, high) - max(start, low)) for _, low, high in sections]
        if not any(held):
            continue
        if rule == "split":
            counts = [c + h / (end - start) for c, h in zip(counts, held, strict=True)]
        elif rule == "largest":
            counts[held.index(max(held))] += 1
        else:
            inside = [n for n, (_, low, high) in enumerate(sections) if low <= start < high]
            if inside:
                counts[inside[0]] += 1
    return counts


@pytest.fixture(scope="module")
def plain_offsets():
    """The library with offsets that keep the leading space of a token."""
    import json

    with open(PATH, encoding="utf-8") as file:
        spec = json.load(file)
    spec["pre_tokenizer"]["trim_offsets"] = False
    spec["post_processor"] = None
    return Tokenizer.from_str(json.dumps(spec))


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_equal_brute_force(plain_offsets, rule):
    e = bpe.Encoder(PATH)
    rng = random.Random(8)
    for _ in range(150):
        text = "".join(rng.choices(["the ", "read", "ing\n", "é", "漢字 ", "\n\n", "ab cd ", "😀"], k=rng.randint(0, 25)))
        marks = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, rng.randint(0, 6))))
        sections = [(str(n), a, b) for n, (a, b) in enumerate(zip(marks, marks[1:], strict=False)) if rng.random() < 0.8]
        low, high = (np.array([s[k] for s in sections], dtype=np.int64) for k in (1, 2))
        spans = token_counts.token_spans(e, text, np.array(ids_of(e, text), dtype=np.int64))
        counts, _ = token_counts.allocate(*spans, low, high, rule)
        assert np.allclose(counts, brute_sections(plain_offsets, text, sections, rule))


def test_line_counts_query(spark, texts, plain_offsets):
    got = {}
    for r in queries.op3_section_token_counts(spark, SMALL).collect():
        got.setdefault(r["doc_id"], {})[r["section"]] = (r["start"], r["end"], r["n_tokens"])
    for key, text in texts.items():
        if text is None:
            assert key not in got
            continue
        sections = token_counts.lines_of(text)
        counts = brute_sections(plain_offsets, text, sections, "largest")
        assert got[key] == {n: (s[1], s[2], int(c)) for n, (s, c) in enumerate(zip(sections, counts, strict=True))}


def test_sections_of_a_table_and_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS).withColumns({"section": F.lit(1), "start": F.lit(2)})
    rows = token_counts.section_token_counts(docs, PATH).collect()
    assert sorted((r["doc_id"] or 0, r["section"], r["n_tokens"]) for r in rows)[:3] == [(0, "0", 2.0), (3, "0", 0.0), (3, "0", 0.0)]
    spans = spark.createDataFrame([(4, "b", 10, 20), (4, "a", 0, 10), (9, "c", 0, 1)], "doc_id bigint, name string, start bigint, end bigint")
    joined = token_counts.with_sections(docs.drop("start"), spans)
    named = token_counts.section_token_counts(joined, PATH, sections_col="sections", rule="first").collect()
    assert sorted(r["section"] for r in named) == ["a", "b"]
    bad = spans.union(spark.createDataFrame([(4, "o", 15, 30), (None, "x", None, 3)], spans.schema))
    joined = token_counts.with_sections(spark.createDataFrame(ODD, DOCS), bad)
    marked = token_counts.section_token_counts(joined, PATH, sections_col="sections").collect()
    assert sorted((r["section"], r["n_tokens"]) for r in marked) == [("a", None), ("b", None), ("o", None)]
    nulls = joined.where("doc_id = 4").withColumn("sections", F.expr("array(null, struct(null as start, 5L as end, 'n' as name), struct(0L as start, 9L as end, 'm' as name))"))
    marked = token_counts.section_token_counts(nulls, PATH, sections_col="sections").collect()
    assert sorted((r["section"], r["n_tokens"]) for r in marked) == [("m", None), ("n", None)]
    with pytest.raises(ValueError):
        token_counts.section_token_counts(docs, PATH, rule="last")


def check_packing(rows, library, texts_by_row, window=1024):
    """Every id in exactly one piece, sequences gapless and no longer than the window."""
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append(r)
    total = 0
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= window
        total += at
    for key, text in texts_by_row.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(pieces.pop(key), key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert not pieces
    return total, len(sequences)


def test_packing_query(spark, texts, library):
    total, n = check_packing(queries.op6_packed_sequences(spark, SMALL).collect(), library, texts)
    assert n <= math.ceil(total / 1024) * 1.03 + 1


def test_packing_odd_rows(spark, library):
    rows = [(1, None), (2, ""), (5, "the " * 1023), (6, "the " * 5000), *((n, "a b c") for n in range(10, 40))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"start": F.lit("clash"), "rank": F.lit(1)})
    check_packing(packing.pack(docs, PATH).collect(), library, dict(rows))
    assert packing.pack(docs.limit(0), PATH).collect() == []
    repeated = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "x")], "doc_id bigint, text string")
    assert len(packing.pack(repeated, PATH, window=64).collect()) == 3


def test_plan_uses_every_piece_with_little_padding():
    rng = np.random.default_rng(3)
    histogram = dict(zip(*[x.tolist() for x in np.unique(np.clip(rng.lognormal(5.6, 0.8, 20_000).astype(int), 1, 1023), return_counts=True)], strict=True))
    histogram[1024] = 17
    used, length = {}, 0
    patterns = packing.plan(histogram, 1024)
    for lengths, count in patterns:
        assert count > 0 and sum(lengths) <= 1024
        for one in lengths:
            used[one] = used.get(one, 0) + count
    assert used == histogram
    length = sum(k * v for k, v in histogram.items())
    assert sum(c for _, c in patterns) * 1024 < 1.01 * length


def test_least_squares_meets_the_histogram():
    columns = packing.combinations(np.arange(1, 64), 64, 0)
    histogram = np.zeros(65)
    for c in columns[::7]:
        for x in c:
            histogram[x] += 5
    times = packing.repeat_counts(columns, histogram)
    fit = np.zeros(65)
    for c, t in zip(columns, times, strict=True):
        for x in c:
            fit[x] += t
    assert (times >= 0).all() and np.abs(fit - histogram).max() < 0.5
