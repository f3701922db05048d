"""Lexical search, the prefix trie and the quality classifier against brute force and held-out labels."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from servemetry.llm import conversation_trie, lexical_search, queries, quality_classifier

from ..conftest import SMALL

DOCS = "doc_id bigint, text string, item bigint, row string, n int, score double"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# Lexical search


def lowered(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def ranked(docs, items, k=10):
    """The contract, document by document."""
    held = [(doc_id, lowered(text)) for doc_id, text in docs]
    held = [(doc_id, own) for doc_id, own in held if own]
    n_docs, n_terms = len(held), sum(len(own) for _, own in held)
    df = defaultdict(int)
    for _, own in held:
        for t in set(own):
            df[t] += 1
    out = []
    for item_id, text in items:
        found = []
        for doc_id, own in held:
            m = 100 - 90 + (90 * len(own) * n_docs) // n_terms
            score = 0
            for t in set(lowered(text)) & set(own):
                tf = own.count(t)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, n, doc_id, -score) for n, (score, _, _, doc_id) in enumerate(sorted(found, key=lambda x: x[:3])[:k], start=1)]
    return sorted(out, key=str)


def searched(spark, docs, items, **more):
    table = spark.createDataFrame([(i, t, 7, "x", 3, 0.5) for i, t in docs], DOCS)
    asked = spark.createDataFrame([(i, t, 9, "y") for i, t in items], "item_id bigint, text string, doc_id bigint, rank string")
    found = lexical_search.ranked_search(table, asked, **more)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted([tuple(r) for r in found.collect()], key=str)


def corpus(rng, n_docs, words):
    docs = [(i, " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randint(1, 40)))) for i in range(n_docs)]
    docs += [(n_docs + i, docs[0][1]) for i in range(15)]  # ties
    return docs + [(None, docs[1][1]), (3, docs[3][1]), (900, None), (901, ""), (902, "-- ** "), (903, "Éa’b_c2 A1"), (904, "long " * 30_000 + "w1")]


def test_search_equals_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Ünder", "été", "A1", "b"]
    docs = corpus(rng, 150, words)
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(12)]
    items += [(50, docs[0][1]), (51, None), (52, "..."), (53, "nowhere"), (54, "éa’b"), (50, "w1"), (None, "w2")]
    assert searched(spark, docs, items) == ranked(docs, items)
    assert searched(spark, docs, items, k=3) == ranked(docs, items, k=3)


def test_search_in_several_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", 100)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    docs = corpus(rng, 40, words)
    items = [(i, " ".join(rng.choices(words, k=6))) for i in range(15)]
    assert searched(spark, docs, items) == ranked(docs, items)


def test_search_of_nothing(spark):
    assert searched(spark, [], [(1, "a")]) == []
    assert searched(spark, [(1, "a")], []) == []
    assert searched(spark, [(1, None), (2, "!")], [(1, "a")]) == []
    assert searched(spark, [(1, "a a"), (2, "a")], [(1, "a")]) == ranked([(1, "a a"), (2, "a")], [(1, "a")])


def test_summaries_are_maxima_and_lists_are_whole():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 12, 700)
    ptr = np.concatenate(([0], np.cumsum(sizes)))
    term = np.concatenate([np.sort(rng.choice(20, s, replace=False)) for s in sizes])
    impact, weights = rng.integers(1, 10**6, len(term)), rng.integers(0, 9000, 20)
    coordinates = {t: np.arange(0, 20, 1 + t % 3) for t in range(0, 20, 2)}
    rows = np.arange(700) + 10**10
    made = list(lexical_search.shard_blocks(rows, ptr, term, impact, weights, coordinates))
    vectors = [dict(zip(term[a:b].tolist(), impact[a:b].tolist(), strict=True)) for a, b in zip(ptr, ptr[1:], strict=False)]
    assert len(made) >= 20
    for t in range(20):
        listed = sorted(d for own, docs, _, _ in made if own == t for d in docs.tolist())
        assert listed == ([d + 10**10 for d, v in enumerate(vectors) if t in v] if t in coordinates else [])
    for t, docs, found, maxima in made:
        inside = [vectors[d - 10**10] for d in docs.tolist()]
        want = {c: max(v.get(c, 0) for v in inside) for c in coordinates[t].tolist()}
        assert dict(zip(found.tolist(), maxima.tolist(), strict=True)) == {c: m for c, m in want.items() if m}


def test_documents_at_the_floor_hold_a_strong_term():
    rng = np.random.default_rng(5)
    for _ in range(200):
        weights, maxima = rng.integers(0, 9, 8), rng.integers(0, 9, 8)
        own, floor = np.sort(rng.choice(8, 5, replace=False)), int(rng.integers(1, 150))
        strong = set(lexical_search.strong_terms(own, floor, weights, maxima))
        for held in range(256):
            doc = {t for t in own.tolist() if held >> t & 1}
            if sum(weights[t] * maxima[t] for t in doc) >= floor:
                assert doc & strong


# Prefix trie


def rebuilt(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in turns.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = tuple(own.get(c - c % 5, [])[:h] + v[h:])
    return out


def trie(paths):
    """Every node of {conv_id: tuple of (role, text)}."""
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(list)
    for key in members:
        if key:
            kids[key[:-1]].append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        leaves[key] = sum(leaves[k] for k in kids[key]) or 1
        saved[key] = sum(saved[k] for k in kids[key]) + (len(members[key]) - 1) * (len(key[-1][1].encode()) if key else 0)
    return sorted(
        (
            min(m), len(key), min(members[key[:-1]]) if key else -1, len(m), len(kids[key]), leaves[key], saved[key],
            hashlib.sha256(",".join(str(c) for c in sorted(m) if paths[c] == key).encode()).hexdigest(),
        )
        for key, m in members.items()
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes_of(spark, rows):
    table = spark.createDataFrame([(*r, 5, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, n int, keys string")
    found = conversation_trie.prefix_trie(table)
    assert found.columns == COLUMNS
    return sorted(tuple(-1 if x is None else x for x in r) for r in found.collect())


def chats(rng, n):
    rows = []
    for c in range(n):
        if rng.random() < 0.9:
            rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "é", ""])) for t in range(rng.randint(1, 11))]
    return rows


def test_trie_equals_brute_force(spark):
    rng = random.Random(8)
    rows = chats(rng, 300)
    rows += [(1000 + c, t, "user", f"hot {t}") for c in range(80) for t in range(12)]  # many equal conversations
    rows += [(2000, t, "user", "long") for t in range(3000)] + [(2005, t, "user", "long") for t in range(2500)]
    rows += [(2001, 0, None, None), (2002, None, "user", None), (2002, None, None, "x"), (2002, 1, "user", "y"), (2002, 1, "user", "x"), (2002, 1, "user", "x"), (None, 1, "user", "x")]
    rng.shuffle(rows)
    assert nodes_of(spark, rows) == trie(rebuilt(rows))


def test_trie_of_few_rows(spark):
    assert nodes_of(spark, []) == []
    assert nodes_of(spark, [(None, 1, "a", "b")]) == []
    for rows in ([(4, 0, "u", "x")], [(6, 0, "u", "x"), (6, 1, "u", "y")], [(n, 0, "u", "x") for n in range(1, 5)]):
        assert nodes_of(spark, rows) == trie(rebuilt(rows))


def walked(paths, borders, held_rows, monkeypatch):
    """The trie from walks over the ranges between borders, put together in plain Python."""
    monkeypatch.setattr(conversation_trie, "HELD_ROWS", held_rows)
    skeleton = conversation_trie.Skeleton(borders)
    by_path = defaultdict(list)
    for c, path in paths.items():
        by_path[b"".join(conversation_trie.turn_key(*t) for t in path)].append(c)
    rows = sorted((p, min(c), len(c), hashlib.sha256(",".join(map(str, sorted(c))).encode()).hexdigest()) for p, c in by_path.items())
    found = []
    for n in range(len(borders) + 1):
        mine = [r for r in rows if conversation_trie.bisect_right(borders, r[0]) == n]
        found += conversation_trie.walk(iter(mine), skeleton, (n << 33) + 1)
    whole = {}
    for node, above, depth, size, inner in skeleton.rows():
        parts = [r for r in found if r[0] == 1 and r[1] == node]
        count, kids = sum(r[5] for r in parts), sum(r[6] for r in parts) + inner
        ends = max((r[9] for r in parts if r[9]), default=conversation_trie._EMPTY)
        whole[node] = [min(r[2] for r in parts), depth, above, count, kids, sum(r[7] for r in parts) + (kids == 0), sum(r[8] for r in parts) + (count - 1) * size, ends]
    own = {n: (v[5], v[6]) for n, v in whole.items()}
    for v in whole.values():
        v[5] = v[6] = 0
    for n, above in skeleton.ancestors():
        whole[above][5] += own[n][0]
        whole[above][6] += own[n][1]
    parents = {r[1]: r[2] for r in found if r[0] == 2} | {-1 - n: v[0] for n, v in whole.items()}
    out = [(r[2], r[3], parents[r[1]] if r[4] is None else r[4], *r[5:]) for r in found if r[0] == 0]
    out += [(v[0], v[1], whole[v[2]][0] if v[2] >= 0 else -1, *v[3:]) for v in whole.values()]
    return sorted(out)


@pytest.mark.parametrize("held_rows", [0, 3, 10**6])
@pytest.mark.parametrize("shards", [1, 2, 7, 60])
def test_walks_and_skeleton_join_at_any_border(shards, held_rows, monkeypatch):
    rng = random.Random(shards)
    paths = rebuilt(chats(rng, 200))
    keys = [b"".join(conversation_trie.turn_key(*t) for t in p) for p in paths.values()]
    borders = conversation_trie.splitters(keys, shards)
    assert len(borders) < shards
    assert walked(paths, borders, held_rows, monkeypatch) == trie(paths)


# Quality classifier


def test_classifier_on_held_out_labels(spark):
    got = {r["doc_id"]: r for r in queries.op13_quality_scores(spark, "/root/testdata/sf0.1").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    assert len(got) == 10_000
    pairs = [(got[r["doc_id"]], r["quality"]) for r in labels if r["doc_id"] in got and got[r["doc_id"]]["held_out"]]
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == r["held_out"] for i, r in got.items())
    good, bad = [p["score"] for p, q in pairs if q == 1], [p["score"] for p, q in pairs if q == 0]
    assert len(bad) > 80 and all(0 <= s <= 1 for s in good + bad)
    above = np.mean([np.mean(np.array(good) > b) for b in bad])
    right = np.mean([p["predicted"] == q for p, q in pairs])
    assert above > 0.995 and right > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got.values())


def test_only_texts_and_learnable_labels_count(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    plain = quality_classifier.train(docs, labels, rounds=2)
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string"), "label": F.lit(9), "place": F.lit("p"), "slots": F.lit(1)})
    fold = quality_classifier.held_out("doc_id")
    spoilt = labels.withColumn("quality", F.when(fold, 1 - F.col("quality")).otherwise(F.col("quality")))
    odd = spark.createDataFrame([(None, 1, 0), (10**9, 0, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    spoilt = spoilt.where("doc_id <> 3").union(odd).union(spoilt.where("doc_id = 5"))
    assert np.allclose(plain, quality_classifier.train(other, spoilt.union(labels.where("doc_id = -1")), rounds=2)) == (not _learnable(labels, 3))
    assert np.allclose(plain, quality_classifier.train(other, labels.withColumn("quality", F.when(fold, 0).otherwise(F.col("quality"))), rounds=2))


def _learnable(labels, doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 != 0 and labels.where(F.col("doc_id") == doc_id).count() > 0


def test_odd_rows_are_scored(spark):
    docs = spark.createDataFrame(
        [(1, "a fine text"), (1, "a fine text"), (None, "a fine text"), (2, None), (3, ""), (4, " \n"), (5, "word " * 200_000), (6, "x" * 300_000)], "doc_id bigint, text string"
    ).withColumn("score", F.lit("s"))
    labels = spark.createDataFrame([(1, 1), (5, 0)], "doc_id bigint, quality int")
    rows = quality_classifier.classify(docs, labels).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "2", "3", "4", "5", "6", "None"]
    assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (2, 3, 4)}) == 1 and len({r["score"] for r in rows if r["doc_id"] in (1, None)}) == 1
    assert {r["held_out"] for r in rows if r["doc_id"] is None} == {True}
    assert quality_classifier.classify(docs.limit(0), labels).collect() == []
    nothing = quality_classifier.classify(docs, labels.limit(0)).collect()
    assert {r["score"] for r in nothing} == {0.5}


def test_slices_give_the_vector_of_the_whole_text(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choices(["a", "b!", "Ça", "__", "12", "a"], k=500))
    whole = quality_classifier.n_grams(text, quality_classifier.Hasher())
    monkeypatch.setattr(quality_classifier, "SLICE", 37)
    parts = quality_classifier.n_grams(text, quality_classifier.Hasher())
    assert whole[0].tolist() == parts[0].tolist() and np.allclose(whole[1], parts[1])
    assert abs(np.linalg.norm(whole[1]) - 1) < 1e-9
