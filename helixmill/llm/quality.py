"""Quality rules: counts within a document, and lines that too many documents of a host share.

Lines are normalised (case, digits, spacing) and hashed together with their host. A line that more than ``max_docs``
distinct documents of a host hold is boilerplate and is removed from all of them. A document whose remaining lines hold
less than ``least_left`` of its line characters is depleted and rejected. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, join_checked, materialize, numbered


def _held(name: str, value: Column) -> Column:
    """A value computed once per row: behind a generator it is an attribute, not an expression to be evaluated again."""
    return F.explode(F.array(value)).alias(name)


def _norm(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, r"[0-9]+", "0"), r"[\x20\x09\x0B-\x0D]+", " ")))


def line_key(host: Column, line: Column) -> Column:
    """128 bits of a host and a normalised line, in two halves."""
    parts = (F.coalesce(host, F.lit("")), host.isNull(), line)
    return F.struct(F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(1), *parts).alias("h2"))


def line_keys(text: Column, host: Column) -> Column:
    """Array of (key, chars) of the distinct normalised lines that hold a word; key hashes host and line."""
    lines = F.transform(F.split(_norm_text(text), "\n"), lambda x: F.trim(x))
    lines = F.filter(F.array_distinct(lines), lambda x: F.length(x) > 0)
    return F.transform(lines, lambda x: F.struct(line_key(host, x).alias("key"), F.length(x).alias("chars")))


def _norm_text(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"[0-9]+", "0"), r"[\x20\x09\x0B-\x0D]+", " "))


def document_counts(docs: DataFrame) -> DataFrame:
    """``docs`` (needs text, source) with word and line counts and the keys of its lines.

    n_repeat_words counts the words inside three-word windows that occur twice or more. Window hashes carry their
    position in the low bits, sorting brings equal windows together, and neighbours are compared word by word.
    """
    own = docs.columns
    with_words = docs.select(*own, _held("_w", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(F.size("_w") + 1.0)).cast("int")) - F.lit(1).cast("long")
    low = with_words.select(*own, "_w", _held("_m", mask))
    places = F.slice("_w", 1, F.greatest(F.size("_w") - 2, F.lit(0)))

    def packed(word: Column, i: Column) -> Column:
        h = F.xxhash64(word, F.get(F.col("_w"), i + 1), F.get(F.col("_w"), i + 2))
        return h.bitwiseAND(F.bitwise_not(F.col("_m"))).bitwiseOR(i.cast("long"))

    ordered = low.select(*own, "_w", "_m", _held("_s", F.sort_array(F.transform(places, packed))))

    def partner(value: Column, i: Column) -> Column:
        after = F.get(F.col("_s"), i + 1)
        here, there = (x.bitwiseAND(F.col("_m")).cast("int") for x in (value, after))
        same = F.bitwise_not(F.col("_m")).bitwiseAND(value.bitwiseXOR(after)) == 0
        for k in range(3):
            same = same & (F.get(F.col("_w"), here + k) == F.get(F.col("_w"), there + k))
        return F.when(F.coalesce(same, F.lit(False)), F.array(here, there))

    twice = F.flatten(F.filter(F.transform("_s", partner), lambda x: x.isNotNull()))
    found = ordered.select(*own, "_w", _held("_t", F.sort_array(F.array_distinct(twice))))
    covered = F.transform("_t", lambda p, i: F.least(F.lit(3), F.coalesce(F.get(F.col("_t"), i + 1) - p, F.lit(3))).cast("long"))
    text = F.coalesce("text", F.lit(""))
    worded = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = found.select(
        *own,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _held("_lines", worded),
        F.aggregate(covered, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_repeat_words"),
    )
    return out.select(
        *own, "n_words", "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        line_keys(text, F.col("source")).alias("lines"),
    )


def frequent_lines(counted: DataFrame, max_docs: int) -> DataFrame:
    """(key) of the lines that more than ``max_docs`` distinct documents (doc_id) of a host hold."""
    held = counted.select("doc_id", F.explode("lines.key").alias("key")).distinct()
    return held.groupBy("key").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") > max_docs).select("key")


def _removed(counted: DataFrame, shared: DataFrame) -> DataFrame:
    """(row, removed, keys): characters and keys of the lines above the limit in each row that has some."""
    lines = counted.select("row", F.explode("lines").alias("line")).select("row", "line.key", "line.chars")
    return join_checked(lines, shared, "key").groupBy("row").agg(F.sum("chars").alias("removed"), F.collect_set("key").alias("keys"))


def _kept(least_left: float) -> Column:
    total = F.aggregate("lines.chars", F.lit(0).cast("long"), lambda a, b: a + b)
    return ~F.col("base_failed") & ((total - F.coalesce("removed", F.lit(0))) >= total * least_left)


def quality_report(docs: DataFrame, max_docs: int = 20, least_left: float = 0.5) -> DataFrame:
    """Per document its counts, ``removed_chars`` and the verdict ``kept``.

    Defined cases: a null text is empty and fails the base rules; a null source is a host of its own; rows that repeat
    a doc_id are one document when lines are counted, and null ids together one; copies under other ids are documents
    of their own; very long texts are read whole; an empty input gives an empty result. Other columns are ignored.
    """
    rows = docs.select("doc_id", "text", "source")
    counted = materialize(document_counts(rows).drop("text", "source").withColumn("row", F.monotonically_increasing_id()), "counted")
    shared = materialize(frequent_lines(counted, max_docs), "frequent")
    judged = counted.join(_removed(counted, shared).drop("keys"), "row", "left")
    judged = judged.withColumn("kept", _kept(least_left)).withColumn("removed_chars", F.coalesce("removed", F.lit(0)).cast("long"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_chars")


def clean_documents(docs: DataFrame, max_docs: int = 20, least_left: float = 0.5) -> DataFrame:
    """The documents that pass, all columns as they are, their text without the lines above the limit.

    Defined cases: those of ``quality_report``; a text that loses no line stays as it is to the byte; columns of any
    name are carried unchanged; an empty input gives an empty result.
    """
    whole = numbered(docs, "whole")
    counted = materialize(document_counts(whole.select("row", "own.doc_id", "own.text", "own.source")).drop("text", "source"), "counted")
    shared = materialize(frequent_lines(counted, max_docs), "frequent")
    good = counted.join(_removed(counted, shared), "row", "left").filter(_kept(least_left)).select("row", "keys")
    host, text = F.col("own.source"), F.col("own.text")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(F.col("keys"), line_key(host, _norm(x)))), "\n")
    cleaned = F.when(F.col("keys").isNull(), text).otherwise(left)
    joined = whole.join(good, "row").select(F.col("own").withField("text", cleaned).alias("own"))
    return joined.select("own.*")
