"""Quality rules: counts of words, symbols and repeats, and divergence from the language.

The verdict compares two histograms of a document, its character classes and its
common words, with the reference of its language by Jensen-Shannon distance. A
reference is the mean histogram of all documents of a language that pass the base
rules and, with the weight of PRIOR_DOCS documents, of a shipped one, so it follows
the corpus at any size. Every language code of two or three letters has a reference
of classes, the configured languages one of words as well; there are at most 18,252
codes, whatever the data hold.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import pin
from .arrow import BLOCK_ROWS, WHITE, by_blocks

#: Common words looked for in each language (fixed values).
COMMON_WORDS = {
    "en": "the of and to in a is that for it with as was on be by are this from or".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un une du que est pour qui dans par sur au avec pas".split(),
    "es": "de la que el en y a los del se las por un para con no una su al es".split(),
}
#: Longest number of words over which a histogram entry is spread (entries per language).
WORDS_PER_LANGUAGE = 20
#: Character classes, in the order of the histogram.
CLASSES = (
    "vowel consonant upper digit blank newline stop other_punctuation symbol latin diacritic_or_greek cyrillic other_script control"
).split()

FEATURES = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint,"
    " classes array<bigint>, words array<bigint>"
)
#: Documents that a shipped reference counts as, and what a language is.
PRIOR_DOCS, LANGUAGE = 5, "[a-z]{2,3}"
#: Shipped shares of the classes in running text, in the order of CLASSES (fixed values, rough shares of written language).
CLASS_PRIOR = {
    "en": (0.30, 0.46, 0.025, 0.005, 0.165, 0.005, 0.022, 0.012, 0.002, 0.002, 0.0005, 0.0005, 0.0005, 0.0005),
    "de": (0.29, 0.46, 0.045, 0.005, 0.145, 0.005, 0.020, 0.010, 0.002, 0.017, 0.0005, 0.0005, 0.0005, 0.0005),
    "fr": (0.33, 0.40, 0.020, 0.005, 0.160, 0.005, 0.020, 0.015, 0.002, 0.035, 0.0005, 0.0005, 0.0005, 0.0005),
    "es": (0.35, 0.40, 0.020, 0.005, 0.165, 0.005, 0.020, 0.010, 0.002, 0.022, 0.0005, 0.0005, 0.0005, 0.0005),
}
#: Shipped share of the common words together; the single words follow a power law in the order listed.
WORD_PRIOR = 0.3
_SCRATCH = "_quality"


def _class_of_byte() -> np.ndarray:
    """Class of each UTF-8 lead byte; continuation bytes count nowhere (class -1)."""
    table = np.full(256, CLASSES.index("control"))
    at = {name: i for i, name in enumerate(CLASSES)}
    for chars, name in (
        ("aeiou", "vowel"), ("bcdfghjklmnpqrstvwxyz", "consonant"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "upper"),
        ("0123456789", "digit"), (" \t", "blank"), ("\n\r", "newline"), (".,;:!?", "stop"),
        ("\"'()-/@[\\]^_`{}~+=", "other_punctuation"), ("#*$%&|<>", "symbol"),
    ):
        table[[ord(c) for c in chars]] = at[name]
    table[0x80:0xC0] = -1
    for low, high, name in ((0xC2, 0xC3, "other_script"), (0xC3, 0xCA, "latin"), (0xCA, 0xD0, "diacritic_or_greek"), (0xD0, 0xD4, "cyrillic"), (0xD4, 0xF8, "other_script")):
        table[low:high] = at[name]
    return table


_CLASS_SUMS = np.zeros((256, len(CLASSES)), dtype=np.int64)
for _byte, _class in enumerate(_class_of_byte()):
    if _class >= 0:
        _CLASS_SUMS[_byte, _class] = 1
_FORMS = {lang: [[(w + stop).encode() for stop in ("", ".", ",")] for w in words] for lang, words in COMMON_WORDS.items()}


def document_features(text: str | None, lang: str | None) -> dict:
    """Counts of one text; a null text counts as one without words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    split = raw.split()
    numbers: dict[bytes, int] = {}
    words = np.fromiter((numbers.setdefault(w, len(numbers)) for w in split), dtype=np.int64, count=len(split))
    n_words, word_chars = len(split), len(b"".join(split).decode("utf-8", "surrogatepass"))
    del split
    repeated = 0
    if n_words > 3:
        # Windows as numbers: each pair of words gets one, then each pair and third word.
        pairs = np.unique(words[:-1] * len(numbers) + words[1:], return_inverse=True)[1]
        windows, at, times = np.unique(pairs[:-1] * len(numbers) + words[2:], return_inverse=True, return_counts=True)
        if len(windows) < n_words - 2:
            inside = np.zeros(n_words, dtype=bool)
            starts = np.flatnonzero(times[at] > 1)
            for shift in range(3):
                inside[starts + shift] = True
            repeated = int(inside.sum())
    lines = [line for line in (text or "").split("\n") if line.strip(WHITE)]
    common = _FORMS.get(lang)
    counts = None
    if common is not None:
        seen: Counter[bytes] = Counter()
        for word, n in zip(numbers, np.bincount(words, minlength=len(numbers)).tolist(), strict=True):
            seen[word.lower()] += n
        counts = [sum(seen.get(form, 0) for form in forms) for forms in common]
        counts += [0] * (WORDS_PER_LANGUAGE - len(common))
        counts.append(max(0, n_words - sum(counts)))
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated,
        "classes": (np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) @ _CLASS_SUMS).tolist(),
        "words": counts,
    }


def _features(text: Column, lang: Column) -> Column:
    @F.arrow_udf(f"struct<{FEATURES.replace(' bigint', ':bigint').replace(' array', ':array')}>")
    def features(texts: pa.Array, langs: pa.Array) -> pa.Array:
        longs = pa.list_(pa.int64())
        kinds = {k: pa.int64() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} | {"classes": longs, "words": longs}
        return by_blocks(lambda some, names: list(map(document_features, some, names)), pa.struct(list(kinds.items())), texts, langs)

    return features(text, lang)


def _base_failed(features: str) -> Column:
    f = F.col(features)
    return (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


def _shares(values: Sequence[float]) -> list[float]:
    return [v / sum(values) for v in values]


def shipped_reference(lang: str) -> tuple[list[float] | None, list[float] | None]:
    """The shipped shares of classes and of common words (none for a language without them)."""
    if lang not in COMMON_WORDS:
        return None, None
    ranks = [1 / (n + 3) if n < len(COMMON_WORDS[lang]) else 0.0 for n in range(WORDS_PER_LANGUAGE)]
    return _shares(CLASS_PRIOR[lang]), [WORD_PRIOR * r for r in _shares(ranks)] + [1 - WORD_PRIOR]


def language_references(featured: DataFrame, lang: str, features: str, min_words: int) -> dict[str, tuple]:
    """Reference histograms of each language, over all its documents that pass the base rules.

    One map-side combined sum per entry; at most one row per language code reaches the driver.
    """
    f = F.col(features)
    sizes = {"classes": len(CLASSES), "words": WORDS_PER_LANGUAGE + 1}
    usable = featured.where(F.col(lang).rlike(f"^{LANGUAGE}$") & ~_base_failed(features) & (f["n_words"] >= min_words))
    totals = {k: F.aggregate(f[k], F.lit(0).cast("bigint"), lambda a, b: a + b) for k in sizes}
    sums = [F.sum(f[k][i] / totals[k]).alias(f"{k}_{i}") for k, n in sizes.items() for i in range(n)]
    out = {}
    for r in usable.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        blended = []
        for (k, size), prior in zip(sizes.items(), shipped_reference(r["lang"]), strict=True):
            held = [r[f"{k}_{i}"] for i in range(size)]
            if prior is not None:
                blended.append([(h + PRIOR_DOCS * p) / (r["n"] + PRIOR_DOCS) for h, p in zip(held, prior, strict=True)])
            else:
                blended.append([h / r["n"] for h in held] if k == "classes" else None)
        out[r["lang"]] = tuple(blended)
    return out


def jensen_shannon(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2, from 0 to 1) of a histogram of counts and one of shares."""
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, b: a + b)

    def term(c, q):
        p = c / total
        middle = (p + q) / 2
        part = lambda x: F.when(x > 0, x * F.log2(x / middle)).otherwise(F.lit(0.0))
        return part(p) + part(q)

    divergence = F.aggregate(F.zip_with(counts, reference, term), F.lit(0.0), lambda a, b: a + b) / 2
    return F.when((total > 0) & reference.isNotNull(), F.sqrt(F.greatest(divergence, F.lit(0.0))))


def _reference_column(lang: str, references: Mapping[str, Sequence], k: int) -> Column:
    found = F.lit(None).cast("array<double>")
    for name in sorted(references):
        if references[name][k] is not None:
            found = F.when(F.col(lang) == name, F.array(*[F.lit(x) for x in references[name][k]])).otherwise(found)
    return found


def _judged(featured: DataFrame, lang: str, features: str, references: Mapping, min_words: int, max_class: float, max_word: float) -> DataFrame:
    f = F.col(features)
    long_enough = f["n_words"] >= min_words
    class_distance = F.when(long_enough, jensen_shannon(f["classes"], _reference_column(lang, references, 0)))
    word_distance = F.when(long_enough, jensen_shannon(f["words"], _reference_column(lang, references, 1)))
    diverges = F.coalesce(class_distance > max_class, F.lit(False)) | F.coalesce(word_distance > max_word, F.lit(False))
    return featured.withColumns({"_class_distance": class_distance, "_word_distance": word_distance, "_kept": ~_base_failed(features) & ~diverges})


def quality_rules(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    min_words: int = 80, max_class_distance: float = 0.28, max_word_distance: float = 0.335,
) -> DataFrame:
    """One row per document with its counts, distances and verdict.

    A null or empty text has no words and fails the base rules. A document whose language is null
    or no code of two or three letters, or that is shorter than `min_words`, has null distances and is
    judged by the base rules alone; one of a language without common words has a null word distance. Repeated rows are judged alike, each on its own row; ids may be null.
    The counts are fixed in reliable storage, so texts are read once.
    """
    featured = pin(docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("_lang"), _features(F.col(text_col), F.col(lang_col)).alias(_SCRATCH)))
    references = language_references(featured, "_lang", _SCRATCH, min_words)
    judged = _judged(featured, "_lang", _SCRATCH, references, min_words, max_class_distance, max_word_distance)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(
        "doc_id", *[F.col(_SCRATCH)[c].alias(c) for c in counts], _base_failed(_SCRATCH).alias("base_failed"),
        F.col("_kept").alias("kept"), F.col("_class_distance").alias("class_distance"), F.col("_word_distance").alias("word_distance"),
    )


def passing(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang",
    min_words: int = 80, max_class_distance: float = 0.28, max_word_distance: float = 0.335,
) -> DataFrame:
    """The documents that pass the rules, with all their columns, whatever their names.

    The rules are those of `quality_rules`, so null and empty texts go; repeated rows stay or go together.
    Texts are read twice, once for the references and once for the verdict, and are not shuffled.
    """
    narrow = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    featured = pin(narrow.select("lang", _features(F.col("text"), F.col("lang")).alias("features")).where(F.col("lang").rlike(f"^{LANGUAGE}$")))
    references = language_references(featured, "lang", "features", min_words)
    text_at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {lang: tuple(None if r is None else np.array(r) for r in own) for lang, own in references.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                texts, langs = part.column(text_at).to_pylist(), part.column(lang_at).to_pylist()
                kept = [
                    passes(document_features(t, lang), known.get(lang, (None, None)), min_words, max_class_distance, max_word_distance)
                    for t, lang in zip(texts, langs, strict=True)
                ]
                yield part.filter(pa.array(kept, type=pa.bool_()))

    return docs.mapInArrow(task, docs.schema)


def distance(counts: Sequence[int], reference: np.ndarray) -> float:
    """Jensen-Shannon distance of a histogram of counts and one of shares, as in `jensen_shannon`."""
    p = np.array(counts, dtype=float)
    if not p.sum():
        return 0.0
    p /= p.sum()
    middle = (p + reference) / 2
    parts = [x[x > 0] @ np.log2(x[x > 0] / middle[x > 0]) for x in (p, reference)]
    return float(np.sqrt(max(0.0, sum(parts) / 2)))


def passes(features: dict, references: tuple, min_words: int, max_class_distance: float, max_word_distance: float) -> bool:
    """The verdict on one document."""
    n = features["n_words"]
    if n < 50 or 100 * features["n_repeat_words"] > 50 * n:
        return False
    kinds = zip(("classes", "words"), references, (max_class_distance, max_word_distance), strict=True)
    return n < min_words or all(r is None or distance(features[k], r) <= most for k, r, most in kinds)
