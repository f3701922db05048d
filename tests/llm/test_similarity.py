"""Similarity joins, components, passages and vectors against brute force."""

import random
import re
import time
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from check import rows_of
from servemetry.llm import jaccard_join, queries, substrings, vector_dedup
from servemetry.llm.components import components

from ..conftest import SMALL


def union_find(links, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in ("documents", "embeddings"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SMALL)
    twin = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in twin.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, twin.fetchall())


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(1)
    links = [(n, n + 1) for n in range(40)] + [(100, n) for n in range(101, 180)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    links += [(rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(90)]
    rng.shuffle(links)
    frame = spark.createDataFrame([*links, *links[:20], (None, 1), (7, None)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components(frame).collect()}
    want = union_find(links, {n for link in links for n in link})
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: want[n] for n in linked}
    assert components(frame.limit(0)).collect() == []


WORDS = [f"w{n}" for n in range(400)]


def grams_of(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def copies(rng, n_seeds, per_seed, length, edits):
    out = []
    for _ in range(n_seeds):
        seed = rng.choices(WORDS, k=rng.randint(*length))
        for _ in range(per_seed):
            words = list(seed)
            for _ in range(rng.randint(0, edits)):
                at = rng.randrange(len(words))
                words[at : at + rng.choice((0, 1, 1))] = [rng.choice(WORDS)] * rng.choice((0, 1))
            out.append(" ".join(words) or "w")
    return out


def brute_components(rows, n, num, den):
    sets = {key: grams_of(text, n) for key, text in rows}
    links = [
        (a, b)
        for a, b in combinations(sets, 2)
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])
    ]
    return {key: (len(sets[key]), c) for key, c in union_find(links, sets).items()}


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80), (2, 60)])
@pytest.mark.parametrize("block", [100_000, 400])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, n, num, block):
    """Small blocks make every region a large one, settled at its pivot and joined tile by tile."""
    monkeypatch.setattr(jaccard_join, "BLOCK_WEIGHT", block)
    rng = random.Random(100 * n + num)
    texts = copies(rng, 6, 14, (40, 90), 8) + copies(rng, 8, 5, (3, 14), 2) + copies(rng, 2, 4, (600, 700), 60)
    texts += ["", None, "  \n ", "One", "one", "ONE two", "one two", texts[0], texts[0].upper()]
    rows = list(enumerate(texts, start=10))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"node": F.lit("x"), "digest": F.lit(0)})
    found = jaccard_join.similarity_components(docs, words=n, num=num, den=100)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()}
    want = brute_components(rows, n, num, 100)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 20


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100), (1, 2)])
def test_linked_sets_share_a_signature(num, den):
    rng = np.random.default_rng(num)
    for _ in range(600):
        size = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        for _ in range(4):
            drop = int(rng.integers(0, max(1, len(a) // 4) + 1))
            kept = rng.choice(a, len(a) - drop, replace=False)
            b = np.unique(np.concatenate((kept, rng.integers(0, 2**64, int(rng.integers(0, drop + 2)), dtype=np.uint64))))
            common = len(np.intersect1d(a, b))
            if len(b) and not np.array_equal(a, b) and den * common >= num * (len(a) + len(b) - common):
                assert set(jaccard_join.signatures(a, num, den).tolist()) & set(jaccard_join.signatures(b, num, den).tolist())


def test_region_recursion_equals_brute_force():
    rng = random.Random(4)
    texts = copies(rng, 10, 40, (30, 40), 5)
    sets = [jaccard_join.shingles(t, 2) for t in texts]
    region = jaccard_join.Region(list(range(len(texts))), sets, 80, 100)
    region.join(np.arange(len(texts)))
    want = brute_components(list(enumerate(texts)), 2, 80, 100)
    assert {n: region.root(n) for n in range(len(texts))} == {n: c for n, (_, c) in want.items()}


@pytest.mark.parametrize("block", [100_000, 400])
def test_regions_on_sketches_equal_brute_force(spark, monkeypatch, block):
    """Small blocks of sketches settle every region at its pivot and compare it tile by tile."""
    monkeypatch.setattr(jaccard_join, "SKETCH_BLOCK", block)
    rng = random.Random(block)
    texts = copies(rng, 6, 14, (40, 90), 8) + copies(rng, 8, 5, (3, 14), 2) + copies(rng, 3, 6, (200, 700), 60)
    rows = list(enumerate(texts, start=10))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for num, den in ((80, 100), (1, 2)):
        found = jaccard_join.similarity_components(docs, words=2, num=num, den=den)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == brute_components(rows, 2, num, den)


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100), (1, 2)])
def test_sketches_connect_all_linked_sets(num, den):
    rng = np.random.default_rng(den + num)
    alone = 0
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**64, int(rng.integers(1, 900)), dtype=np.uint64))
        for share in (0, den / 4 / num, 1, 1):
            drop = int(len(a) * rng.uniform(0, 0.5)) if share == 1 else int(len(a) * share)
            b = np.unique(np.concatenate((rng.choice(a, len(a) - drop, replace=False), rng.integers(0, 2**64, int(rng.integers(0, drop + 2)), dtype=np.uint64))))
            common = len(np.intersect1d(a, b))
            pair = jaccard_join.SketchRegion([1, 2], [jaccard_join.sketch(a), jaccard_join.sketch(b)], num, den)
            pair.join(np.arange(2))
            linked = den * common >= num * (len(a) + len(b) - common)
            assert pair.links or not linked
            alone += not pair.links
    assert alone > 50


def test_only_what_may_link_moves_its_grams(spark, monkeypatch):
    """Documents that share a passage share projections; regions held all of them, with all their grams."""
    rng = random.Random(8)
    shared = " ".join(f"s{n}" for n in range(40))
    texts = [f"{shared} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(160)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate([*texts, f"{texts[7]} end"])), "doc_id bigint, text string")
    moved, joined = [], jaccard_join._region_links

    def seen(docs, meetings, *rest):
        moved.extend((r["pivot"], r["node"]) for r in meetings.collect())
        return joined(docs, meetings, *rest)

    monkeypatch.setattr(jaccard_join, "_region_links", seen)
    found = {r["doc_id"]: r["component_id"] for r in jaccard_join.similarity_components(docs, words=5).collect()}
    assert found == {**{n: n for n in range(60)}, 60: 7}
    assert moved == [(7, 60)]


def test_jaccard_join_odd_rows(spark):
    same = " ".join(WORDS[:60])
    near = " ".join([*WORDS[:59], "other"])
    rows = [(5, same), (5, near), (5, "apart " * 9), (3, "apart " * 9), (8, near), (8, near), (None, same), (None, "only here"), (9, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = jaccard_join.similarity_components(docs, words=3, num=90, den=100)
    by_id = {}
    for r in got.collect():
        by_id.setdefault(r["doc_id"], set()).add(r["component_id"])
    # Document 5 also holds the text of 3, so all its texts belong to 3.
    assert by_id == {5: {3}, 3: {3}, 8: {3}, None: {3, None}, 9: {9}}
    assert got.count() == len(rows)
    assert jaccard_join.similarity_components(docs.limit(0)).collect() == []


def test_one_of_each_group_keeps_columns(spark):
    same = " ".join(WORDS[:60])
    rows = [(5, same, "a"), (4, same, "b"), (4, same, "b"), (7, "another text", None), (None, same, "c"), (9, None, "d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _gone_id string")
    got = jaccard_join.one_of_each_group(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in got.collect()) == [0, 4, 7, 9]


def passage(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def test_passages_are_found_wherever_they_stand(spark):
    rng = random.Random(11)
    shared = [passage(rng, 60) for _ in range(12)]
    rows = [(n, f"{passage(rng, 80)} {shared[n % 12]} {passage(rng, 50)}") for n in range(36)]
    rows += [(n, passage(rng, 120)) for n in range(100, 130)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in substrings.repeated_passages(docs).collect()}
    for key, text in rows:
        r = found[key]
        start = text.index(shared[key % 12]) if key < 100 else -1
        if key < 12:
            assert not r["removed"] and len(r["shared"]) == 1
        elif key < 100:
            (span,) = r["removed"]
            end = start + len(shared[key % 12])
            # Chance chunks may reach a little over the edges; most of the passage is always inside.
            assert span["start"] >= start - 10 and span["end"] <= end + 10 and span["words"] >= 25
        else:
            assert not r["removed"] and not r["shared"]
    left = {r["doc_id"]: r["text"] for r in substrings.without_repeats(docs).collect()}
    assert left.keys() == dict(rows).keys()
    assert all(left[k] == t for k, t in rows if k < 12 or k >= 100)
    assert all(len(t.split()) - len(left[k].split()) > 22 for k, t in rows if 12 <= k < 100)
    assert all(set(left[k].split()) <= set(WORDS) for k, _ in rows)


def plain_chunks(text):
    """Ends of the chunks in bytes, byte by byte from the definition."""
    data = text.encode()
    gear = [xxhash.xxh3_64_intdigest(bytes([b])) >> 32 for b in range(256)]
    rolled = [sum(gear[data[i - k]] << 4 * k for k in range(min(8, i + 1))) % 2**32 for i in range(len(data))]
    near = substrings.REACH
    wanted = [
        i + 1 for i in range(len(data) - 1)
        if rolled[i] > max(rolled[max(0, i - near) : i], default=0) and rolled[i] >= max(rolled[i + 1 : i + 1 + near], default=0)
    ]
    begins = [b & 0xC0 != 0x80 for b in data] + [True]
    out, last = [], 0
    for cut in [*wanted, len(data)] if data else []:
        while not begins[cut]:
            cut += 1
        while cut - last > substrings.MOST:
            last += substrings.MOST
            while not begins[last]:
                last -= 1
            out.append(last)
        if cut > last:
            out.append(cut)
            last = cut
    return data, [0, *out]


def plain_windows(text, min_words=substrings.MIN_WORDS):
    """(start, end in bytes) of the shortest stretches of chunks that touch enough words, from and up to each chunk."""
    data, edges = plain_chunks(text)
    touched = lambda i, j: len(data[edges[i] : edges[j]].split())
    found, size = set(), len(edges) - 1
    for i in range(size):
        j = next((j for j in range(i + 1, size + 1) if touched(i, j) >= min_words), None)
        if j:
            found.add((edges[i], edges[j]))
        k = next((k for k in range(i, -1, -1) if touched(k, i + 1) >= min_words), None)
        if k is not None:
            found.add((edges[k], edges[i + 1]))
    return data, sorted(found)


def brute_passages(rows):
    """Passages (start, end in characters) of each text that one earlier document holds, and those that any other holds."""
    held = {key: plain_windows(text or "") for key, text in rows}
    owners = {}
    for key in sorted(held):
        data, spans = held[key]
        for a, b in spans:
            owners.setdefault(data[a:b], {}).setdefault(key, a)
    out = {}
    for key, (data, spans) in held.items():
        kinds = []
        for later in (True, False):
            marked = [
                (a, b) for a, b in spans
                if (min(owners[data[a:b]]) < key or owners[data[a:b]][key] < a if later else len(owners[data[a:b]]) > 1)
            ]
            joined = []
            for a, b in marked:
                if joined and a < joined[-1][1]:
                    joined[-1][1] = max(b, joined[-1][1])
                else:
                    joined.append([a, b])
            begun = lambda a, b: sum(1 for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", data) if a <= m.start() < b)  # noqa: B023, E731
            kinds.append([(len(data[:a].decode()), len(data[:b].decode()), begun(a, b)) for a, b in joined if begun(a, b) >= substrings.MIN_WORDS])
        out[key] = kinds
    return out


def test_repeated_passages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 6000")
    rng = random.Random(31)
    shared = [passage(rng, n) for n in (24, 26, 40, 90, 200)]
    made = [(10_000 + n, " ".join([passage(rng, rng.randint(0, 40)), *rng.choices(shared, k=rng.randint(0, 3)), passage(rng, rng.randint(0, 40))])) for n in range(40)]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id bigint, text string"))
    want = brute_passages([tuple(r) for r in docs.collect()])
    got = {r["doc_id"]: [[(s["start"], s["end"], s["words"]) for s in r[k]] for k in ("removed", "shared")] for r in substrings.repeated_passages(docs).collect()}
    assert got == want
    assert sum(bool(k[0]) for k in want.values()) > 30


def test_digests_of_stretches_tell_orders_and_lengths_apart():
    rng = np.random.default_rng(3)
    chunks = rng.integers(0, 3, 80).astype(np.uint64)
    first, last = (x.ravel() for x in np.meshgrid(np.arange(80), np.arange(80), indexing="ij"))
    first, last = first[first <= last], last[first <= last]
    digests = substrings.stretch_digests(chunks, first, last)
    by_content = {}
    for a, b, d in zip(first.tolist(), last.tolist(), digests.tolist(), strict=True):
        by_content.setdefault(tuple(chunks[a : b + 1].tolist()), set()).add(d)
    assert all(len(d) == 1 for d in by_content.values())
    assert len({d for own in by_content.values() for d in own}) == len(by_content)


def test_windows_of_very_long_words_take_linear_time():
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcdefgh", k=100_000)) for _ in range(30))
    started = time.perf_counter()
    digests, *_ = substrings.windows(text, 25)
    assert len(digests) > 10_000 and time.perf_counter() - started < 20


def test_phrases_of_many_documents_in_a_row_are_no_passage(spark):
    rng = random.Random(17)
    target = passage(rng, 120)
    ends = substrings.cuts(np.frombuffer(target.encode(), dtype=np.uint8)).tolist()
    phrases = [target[max(0, a - 24) : b + 24] for a, b in zip([0, *ends], ends, strict=False)]
    whole = [passage(rng, 60) for _ in range(2)]
    rows = [(n, f"{passage(rng, 60)} {p} {passage(rng, 60)}") for n, p in enumerate(phrases)]
    rows += [(n, f"{passage(rng, 60)} {w} {passage(rng, 60)}") for n, w in enumerate(whole, 100)]
    rows += [(150, target), (151, f"{passage(rng, 40)} {target[:400]} {whole[0]} {whole[1]} {phrases[4]}")]
    # Every chunk of 150 has an earlier holder; no stretch of 25 words has one.
    assert all(any(target[a:b] in t for _, t in rows[:-2]) for a, b in zip([0, *ends], ends, strict=False))
    found = {r["doc_id"]: r for r in substrings.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert not found[150]["removed"]
    # The begin of the target stands in 150; both passages are held whole by one document each.
    text = rows[-1][1]
    earlier = [t for _, t in rows[:-1]]
    assert sum(s["words"] for s in found[151]["removed"]) >= 120
    for span in found[151]["removed"]:
        words = text[span["start"] : span["end"]].split()[1:-1]
        within = set()
        for i in range(len(words) - 20):
            if any(" ".join(words[i : i + 21]) in t for t in earlier):
                within |= set(range(i, i + 21))
        assert len(within) == len(words)


def test_windows_cover_every_passage_of_enough_words():
    rng = random.Random(23)
    text = " ".join(rng.choices([*WORDS, "a", "I", "é", "12345678901234567890123456789"], k=3000))
    data, edges = plain_chunks(text)
    _, starts, stops, before, through = substrings.windows(text, 25)
    words = [m.start() for m in re.finditer(rb"\S+", data)]
    bounds, so_far = [len(data[:e].decode()) for e in edges], [sum(w < e for w in words) for e in edges]
    for _ in range(400):
        i = rng.randrange(len(edges) - 1)
        j = min(len(edges) - 1, i + rng.randint(1, 14))
        inside = [w for w in zip(starts.tolist(), stops.tolist(), before.tolist(), through.tolist(), strict=True) if bounds[i] <= w[0] and w[1] <= bounds[j]]
        want = [(bounds[i], bounds[j], so_far[j] - so_far[i])] if so_far[j] - so_far[i] >= 25 else []
        assert substrings.joined(inside, 25) == want


def test_passages_odd_rows(spark):
    rng = random.Random(2)
    text = passage(rng, 90)
    rows = [(1, None), (2, ""), (3, text), (3, text), (None, text), (None, text), (4, text + " " + text), (5, "x" * 100_000), (6, "é漢😀 " * 4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"owner": F.lit("clash"), "digest": F.lit(1), "_cut": F.lit(0), "_cut_id": F.lit(0), "_scratch_0": F.lit(0)})
    found = [(r["doc_id"], bool(r["removed"])) for r in substrings.repeated_passages(docs).collect()]
    assert sorted(found, key=str) == sorted(
        [(1, False), (2, False), (3, False), (3, False), (None, True), (None, True), (4, True), (5, False), (6, True)], key=str
    )
    left = substrings.without_repeats(docs)
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "2", "3", "3", "4", "5", "6", "None", "None"]
    kept = {r["doc_id"]: r["text"] for r in left.collect()}
    assert kept[None] == text and len(kept[4].split()) < 20 and len(kept[6]) < 1000 and kept[5] == "x" * 100_000
    assert substrings.without_repeats(docs.limit(0)).collect() == []


def test_chunks_resist_shifts():
    rng = random.Random(9)
    text = passage(rng, 2000)
    chunks = []
    for data in (text.encode(), b"an insertion " + text.encode()):
        ends = substrings.cuts(np.frombuffer(data, dtype=np.uint8)).tolist()
        assert [0, *ends] == plain_chunks(data.decode())[1]
        chunks.append({data[a:b] for a, b in zip([0, *ends], ends, strict=False)})
    assert len(chunks[0] & chunks[1]) >= len(chunks[0]) - 4


def vectors_frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def brute_vectors(rows, threshold):
    def good(v, label):
        return label is not None and v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)

    arrays = [np.array(v, dtype=np.float32).astype(float) if good(v, label) else None for _, v, label in rows]
    links = []
    for i, j in combinations(range(len(rows)), 2):
        a, b = arrays[i], arrays[j]
        if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b):
            if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                links.append((i, j))
    roots = union_find(links, range(len(rows)))
    members = {}
    for n, root in roots.items():
        members.setdefault(root, []).append(rows[n][0])
    out = []
    for n, (key, _, _) in enumerate(rows):
        ids = [k for k in members[roots[n]] if k is not None]
        out.append((key, sum(n in link for link in links), min(ids) if ids else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1024, 9])
def test_vectors_equal_brute_force(spark, block):
    rng = np.random.default_rng(block)
    rows = []
    for label in (0, 1, None):
        for _ in range(6):
            seed = rng.normal(size=24)
            rows += [(None, (seed + rng.normal(size=24) * rng.choice([0, 0.2, 0.35, 0.5])).tolist(), label) for _ in range(7)]
    rows += [(None, rows[0][1], 0), (None, rows[0][1], 0), (None, [1.0, 2.0], 0), (None, [2.0, 4.0], 0), (None, [0.0] * 24, 0), (None, None, 0)]
    rows += [(None, [], 1), (None, [None] * 24, 1), (None, [float("nan")] * 24, 1), (None, [float("inf")] * 24, 1)]
    rows = [(n, v, label) for n, (_, v, label) in enumerate(rows)] + [(3, rows[3][1], 0), (None, rows[5][1], 0), (None, [9.0] * 24, 7)]
    got = vector_dedup.near_vectors(vectors_frame(spark, rows).withColumns({"node": F.lit("x"), "vector": F.lit(1)}), block=block).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == brute_vectors(rows, 0.93)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert vector_dedup.near_vectors(vectors_frame(spark, rows).limit(0)).collect() == []


def test_error_bounds_hold_and_prune():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(300, 64)), rng.normal(size=(200, 64))
    y[:20] = x[:20] + rng.normal(size=(20, 64)) * 0.25
    units = [v / np.linalg.norm(v, axis=1)[:, None] for v in (x, y)]
    (qx, sx, nx, ex), (qy, sy, _, ey) = (vector_dedup.quantise(u) for u in units)
    approximate = (qx.astype(int) @ qy.astype(int).T) * sx[:, None] * sy
    assert (np.abs(units[0] @ units[1].T - approximate) <= ex[:, None] + nx[:, None] * ey + 1e-12).all()
    a, _, computed = vector_dedup.tile_links(x, y, False, 0.93)
    assert len(a) <= computed < 60
