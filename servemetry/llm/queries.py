"""Registered queries of the text operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import half_even
from . import bpe, conversation_trie, jaccard_join, lexical_search, license_scan, packing, quality, quality_classifier, secret_scan, shard_table, substrings, token_counts, vector_dedup

#: Vocabulary of the token queries; operators take any path.
VOCABULARY = "byte_bpe_50k.json"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    judged = quality.quality_rules(_documents(spark, sf_dir))
    return judged.withColumns({c: half_even(F.col(c), 6) for c in ("class_distance", "word_distance")})


#: Code points of the character classes, as in the lead bytes that `quality` counts.
_CLASS_RANGES = (
    "aeiou", "b-df-hj-np-tv-z", "A-Z", "0-9", r" \t", r"\n\r", ".,;:!?", r"\"''()\-/@\[\\\]^_`{}~+=", "#*$%&|<>",
    r"\x{C0}-\x{27F}", r"\x{280}-\x{3FF}", r"\x{400}-\x{4FF}", r"\x{80}-\x{BF}\x{500}-\x{10FFFF}", r"\x00-\x08\x0b\x0c\x0e-\x1f\x7f",
)
_OP1 = """
WITH texts AS (
    SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents
), windows AS (
    SELECT rid, i, count(*) OVER (PARTITION BY rid, g) > 1 AS again
    FROM (SELECT rid, unnest(range(1, len(w) - 1)) AS i, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS g FROM texts)
), repeats AS (
    SELECT rid, count(DISTINCT pos) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS pos FROM windows WHERE again) GROUP BY rid
), counted AS (
    SELECT rid, doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{word}')))
        - len(list_distinct(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{word}')))) AS n_dup_lines,
        coalesce(n, 0) AS n_repeat_words,
        [{classes}] AS classes,
        list_transform(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS lowered
    FROM texts LEFT JOIN repeats USING (rid)
), based AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
), common(lang, entry, forms) AS (VALUES {common}
), entries AS (
    SELECT rid, lang, base_failed, n_words, 'class' AS kind, unnest(range(1, 15)) AS entry, unnest(classes) AS n FROM based
    UNION ALL
    SELECT rid, b.lang, base_failed, n_words, 'word', entry, len(list_filter(lowered, lambda x: list_contains(forms, x))) FROM based b JOIN common c ON b.lang = c.lang
    UNION ALL
    SELECT rid, b.lang, base_failed, n_words, 'word', 0, len(list_filter(lowered, lambda x: NOT list_contains(everything, x)))
    FROM based b JOIN (SELECT lang, flatten(list(forms)) AS everything FROM common GROUP BY lang) c ON b.lang = c.lang
), shares AS (
    SELECT *, n / nullif(sum(n) OVER (PARTITION BY rid, kind), 0) AS p FROM entries WHERE n_words >= 80
), shipped(lang, kind, entry, share) AS (VALUES {shipped}
), means AS (
    SELECT lang, kind, entry, CASE WHEN any_value(share) IS NULL THEN avg(p) ELSE (sum(p) + {prior} * any_value(share)) / (count(*) + {prior}) END AS q
    FROM shares LEFT JOIN shipped USING (lang, kind, entry) WHERE NOT base_failed AND regexp_full_match(lang, '{code}') GROUP BY ALL
), distances AS (
    SELECT rid, kind, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS d
    FROM shares JOIN means USING (lang, kind, entry) GROUP BY ALL
), judged AS (
    SELECT b.*, c.d AS cd, w.d AS wd FROM based b LEFT JOIN distances c ON c.rid = b.rid AND c.kind = 'class' LEFT JOIN distances w ON w.rid = b.rid AND w.kind = 'word'
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND coalesce(cd <= 0.28::DOUBLE, true) AND coalesce(wd <= 0.335::DOUBLE, true) AS kept,
    CAST(printf('%.6f', cd) AS DOUBLE) AS class_distance, CAST(printf('%.6f', wd) AS DOUBLE) AS word_distance
FROM judged
""".format(
    word=r"[^\x20\x09-\x0D]+",
    classes=", ".join(f"length(regexp_replace(text, '[^{c}]', '', 'g'))" for c in _CLASS_RANGES),
    prior=quality.PRIOR_DOCS,
    code=quality.LANGUAGE,
    shipped=", ".join(
        f"('{lang}', '{kind}', {entry}, {share!r}::DOUBLE)"
        for lang in quality.COMMON_WORDS
        for kind, shares, numbers in zip(("class", "word"), quality.shipped_reference(lang), (range(1, 15), [*range(1, 21), 0]), strict=True)
        for entry, share in zip(numbers, shares, strict=True)
    ),
    common=", ".join(f"('{lang}', {n}, ['{w}', '{w}.', '{w},'])" for lang, words in quality.COMMON_WORDS.items() for n, w in enumerate(words, start=1)),
)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Digests of the token ids of every document and of the text they decode to."""
    encoded = bpe.encode_documents(_documents(spark, sf_dir), vocabulary or public_tokenizers.path(VOCABULARY))
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_section_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Tokens of every line of every document; a token across a boundary goes to the line with most of it."""
    return token_counts.section_token_counts(
        _documents(spark, sf_dir), vocabulary or public_tokenizers.path(VOCABULARY)
    ).select("doc_id", F.col("section").cast("bigint").alias("section"), "start", "end", F.col("n_tokens").cast("bigint").alias("n_tokens"), "n_crossing")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of 3-word shingles with a similarity of 0.9 or more."""
    return jaccard_join.similarity_components(_documents(spark, sf_dir), words=3, num=90, den=100)


_OP4 = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s FROM words
), sizes AS (
    SELECT doc_id, coalesce(len(s), 0)::BIGINT AS n_shingles FROM sets
), grams AS (
    SELECT doc_id, unnest(s) AS g FROM sets
), common AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * n >= 90 * (p.n_shingles + q.n_shingles - n)
), reach AS (
    SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
)
SELECT doc_id, n_shingles, (SELECT min(y) FROM reach WHERE x = doc_id) AS component_id FROM sizes
"""


def op5_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts of the fixed patterns and all spans."""
    found = secret_scan.secret_spans(_documents(spark, sf_dir))

    def listed(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id",
        *[count(kind) for kind in ("assign", "access", "hex")],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def op6_packed_sequences(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Place of every piece of every document in sequences of 1,024 tokens."""
    return packing.pack(_documents(spark, sf_dir), vocabulary or public_tokenizers.path(VOCABULARY), window=1024, end_id=0)


SHARDS, SLOTS = tuple(f"shard-{n:02d}" for n in range(64)), 65537


def op7_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document."""
    return shard_table.place(_documents(spark, sf_dir), "doc_id", SHARDS, slots=SLOTS)


#: The table itself is tested apart; the twin looks the same bytes up.
_OP7 = """
WITH placed AS (
    SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {slots} AS slot FROM documents
), owned AS (SELECT '{table}' AS owners)
SELECT doc_id, slot, printf('shard-%02d', CAST('0x' || substr(owners, CAST(slot * 4 + 1 AS BIGINT), 4) AS INTEGER)) AS shard
FROM placed, owned
"""


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector within its label, at a cosine of 0.93 or more."""
    return vector_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.93)


_OP8 = """
WITH RECURSIVE vectors AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM vectors a JOIN vectors b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
    SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
), least AS (
    SELECT x, min(y) AS component_id FROM reach GROUP BY x
), counts AS (
    SELECT x, count(*) AS n FROM links GROUP BY x
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON least.x = vec_id LEFT JOIN counts ON counts.x = vec_id
"""


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of every document that an earlier document holds, and all that it shares."""
    found = substrings.repeated_passages(_documents(spark, sf_dir))

    def listed(spans: str) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["end"])))

    def words(spans: str) -> Column:
        return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["words"])

    return found.select(
        "doc_id", words("removed").alias("n_removed_words"), words("shared").alias("n_shared_words"),
        listed("removed").alias("removed"), listed("shared").alias("shared"),
    )


def op10_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice of every document, with its differences from the template."""
    return license_scan.license_notices(_documents(spark, sf_dir))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that rank highest for each benchmark item."""
    return lexical_search.ranked_search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


_OP11 = r"""
WITH doc_terms AS (
    SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{term}') AS ts FROM documents
), sized AS (
    SELECT rid, doc_id, len(ts)::BIGINT AS n, ts FROM doc_terms WHERE len(ts) > 0
), totals AS (
    SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sized
), counted AS (
    SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(ts) AS t FROM sized) GROUP BY ALL
), asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{term}')) AS t FROM benchmark
), weights AS (
    SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counted, totals GROUP BY t
), lengths AS (
    SELECT rid, doc_id, 10 + (90 * n * n_docs) // n_terms AS m FROM sized, totals
), scores AS (
    SELECT item_id, rid, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM asked JOIN counted USING (t) JOIN weights USING (t) JOIN lengths USING (rid) GROUP BY item_id, rid
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, rid) AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
""".format(term=r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return conversation_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_OP12 = """
WITH turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
        coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
), cuts AS (
    SELECT conv_id, n, xor(list_reduce(
        list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
        lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)
    ), 4294967295) % 9 AS h
    FROM (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id)
), rebuilt AS (
    SELECT c.conv_id, pos AS d, role, text FROM cuts c JOIN turns p ON p.conv_id = c.conv_id - c.conv_id % 5 AND pos <= h
    UNION ALL
    SELECT conv_id, least(c.h, coalesce(p.n, 0)) + pos - c.h, role, text
    FROM turns JOIN cuts c USING (conv_id) LEFT JOIN (SELECT conv_id AS head, n FROM cuts) p ON p.head = conv_id - conv_id % 5 WHERE pos > c.h
), keyed AS (
    SELECT conv_id, 0 AS d, '' AS key, 0 AS size FROM cuts
    UNION ALL
    SELECT conv_id, d, md5(string_agg(md5(concat(length(role), ':', role, text)), '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d)), strlen(text) FROM rebuilt
), linked AS (
    SELECT *, lag(key) OVER w AS above, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM keyed WINDOW w AS (PARTITION BY conv_id ORDER BY d)
), nodes AS (
    SELECT key, any_value(d) AS depth, any_value(above) AS above, count(*) AS n, min(conv_id) AS conv_id, any_value(size) AS size,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
    FROM linked GROUP BY key
), children AS (
    SELECT above AS key, count(*) AS kids FROM nodes WHERE above IS NOT NULL GROUP BY above
), subtrees AS (
    SELECT a.key, sum((u.n - 1) * u.size)::BIGINT AS saved, count(*) FILTER (WHERE kids IS NULL) AS leaves
    FROM nodes u LEFT JOIN children c ON c.key = u.key JOIN keyed a ON a.conv_id = u.conv_id AND a.d <= u.depth GROUP BY a.key
)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, v.n AS n_convs, coalesce(kids, 0) AS n_children,
    leaves AS n_leaves, saved AS saved_tokens, v.ends_sha256
FROM nodes v JOIN subtrees USING (key) LEFT JOIN children c ON c.key = v.key LEFT JOIN nodes p ON p.key = v.above
"""


def op13_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels outside the held-out fold."""
    return quality_classifier.classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_bpe_round_trip, op3_section_token_counts, op4_jaccard_join, op5_secret_spans, op6_packed_sequences,
        op7_shard_placement, op8_near_vectors, op9_repeated_passages, op10_license_notices, op11_ranked_search,
        op12_prefix_trie, op13_quality_scores,
    )
}
ORACLES = {
    "op1_quality_rules": _OP1,
    "op4_jaccard_join": _OP4,
    "op7_shard_placement": _OP7.format(slots=SLOTS, table=shard_table.table_bytes(shard_table.fill_table(SHARDS, SLOTS)).hex()),
    "op8_near_vectors": _OP8,
    "op11_ranked_search": _OP11,
    "op12_prefix_trie": _OP12,
}
