"""Audit of how quality filters interact: what each removes, alone and after the others, in every order.

1. A narrow row per document: its part, its text's SHA-256, what its labels say, and the conditions that need no words.
2. A relational word pipeline: texts meet by digest, so that each distinct text goes on once with its smallest
   identifier and number of copies; its words are exploded and aggregated by (text, word), then by text, for totals and
   distinct words. Texts are dealt out before they are exploded, and both aggregations keep that partitioning, so the
   words themselves are never shuffled.
3. The flags of words and of repeats are outer-joined to the narrow rows. A document's failed filters are the bits of a
   pattern, and one aggregation by part makes the conditional counts of all 32 patterns: documents, good and toxic ones.
4. Every figure of every order is a sum over patterns: a filter removes, in its place, those that fail it and none of
   the filters before. Averaged over all orders, a document that fails k filters counts for each of them 1/k.

Cases: null text counts as empty; an empty text has no words and fails only A; null and empty sources are one part;
null identifiers are larger than all others, and no identifier is smaller than an equal one, so repeated rows of one
identifier do not fail E against each other; labels are those of any row of that identifier (a null label counts as 0);
an empty table gives no rows; other columns do not matter, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import durable, join_groups

FILTERS = "ABCDE"
PATTERNS = 1 << len(FILTERS)
LEAST_WORDS, LEAST_DISTINCT_PCT, MOST_CAPITALS_PCT = 50, 65, 5
SPACES, SIGNS = r"[\x20\x09-\x0D]+", "[#$%&*|]"


def narrow_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """doc_id, part, sha, good, toxic, fails_c, fails_d; one row per document."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text")).select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("sha"),
        (F.lit(100) * F.length(F.regexp_replace("text", "[^A-Z]+", "")) > F.lit(MOST_CAPITALS_PCT) * F.length("text")).alias("fails_c"),
        F.col("text").rlike(SIGNS).alias("fails_d"),
    )
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    return rows.join(marks, "doc_id", "left").fillna(False, ["good", "toxic"])


def text_flags(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """sha, least_id, copies, words, distinct_words of every distinct text, by exploding words and aggregating twice."""
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    once = texts.groupBy(F.unhex(F.sha2("text", 256)).alias("sha")).agg(F.first("text").alias("text"), F.min("doc_id").alias("least_id"), F.count("*").alias("copies"))
    # a text without words keeps one row, whose word is null; an empty string is what split() leaves at either end
    words = once.select("sha", "least_id", "copies", F.explode(F.split("text", SPACES)).alias("word")).withColumn("word", F.expr("nullif(word, '')"))
    by_word = words.groupBy("sha", "word").agg(F.count("word").alias("times"), F.first("least_id").alias("least_id"), F.first("copies").alias("copies"))
    return by_word.groupBy("sha").agg(F.first("least_id").alias("least_id"), F.first("copies").alias("copies"), F.sum("times").alias("words"), F.count("word").alias("distinct_words"))


def document_flags(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, good, toxic, words, distinct_words and pattern: bit i is set if the document fails filter FILTERS[i]."""
    rows = durable(narrow_rows(docs, labels, id_col, text_col, part_col), "audit-rows")
    flags = durable(text_flags(docs, id_col, text_col), "audit-texts")
    met = join_groups(rows, flags, ["sha"], "copies")
    fails = {
        "A": F.col("words") < LEAST_WORDS,
        "B": F.lit(100) * F.col("distinct_words") < F.lit(LEAST_DISTINCT_PCT) * F.col("words"),
        "C": F.col("fails_c"),
        "D": F.col("fails_d"),
        "E": F.coalesce(F.col("doc_id") > F.col("least_id"), F.col("least_id").isNotNull()),
    }
    pattern = sum((F.when(fails[f], 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    return met.select("doc_id", "part", "good", "toxic", "words", "distinct_words", pattern.alias("pattern"))


def pattern_counts(flags: DataFrame) -> DataFrame:
    """part, and n, good, toxic: arrays of the documents with each pattern, from one aggregation of conditional counts."""
    kinds = {"n": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    counts = [F.count_if((F.col("pattern") == p) & on).alias(f"{kind}_{p}") for kind, on in kinds.items() for p in range(PATTERNS)]
    return flags.groupBy("part").agg(*counts).select("part", *[F.array(*[f"{kind}_{p}" for p in range(PATTERNS)]).alias(kind) for kind in kinds])


def _total(counts: str, wanted: str) -> Column:
    """The sum of counts[p] over the patterns p for which the SQL condition holds."""
    return F.expr(f"aggregate(filter(sequence(0, {PATTERNS - 1}), p -> {wanted}), 0L, (s, p) -> s + {counts}[p])")


def orders(counts: DataFrame) -> DataFrame:
    """One row per part, order and step, with the sums over patterns."""
    every = F.array(*[F.lit("".join(o)) for o in permutations(FILTERS)])
    rows = counts.withColumn("filter_order", F.explode(every)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = f"shiftleft(1, instr('{FILTERS}', substr(filter_order, {{}}, 1)) - 1)"
    rows = rows.withColumns({
        "_bit": F.expr(bit.format("step")),
        "_before": F.expr(f"aggregate(filter(sequence(1, {len(FILTERS)}), i -> i < step), 0, (s, i) -> s | {bit.format('i')})"),
    })
    share = f"{len(list(permutations(FILTERS)))} div bit_count(p)"
    removed = "p & _bit != 0 AND p & _before = 0"
    return rows.select(
        "part", "filter_order", "step",
        _total("n", "p & (_before | _bit) = 0").alias("kept"), _total("n", removed).alias("removed"),
        _total("n", "p & _bit != 0 AND p & _before != 0").alias("redundant"), F.expr("n[_bit]").alias("unique_fails"),
        _total("good", removed).alias("good_lost"), _total("toxic", removed).alias("toxic_lost"),
        F.expr(f"aggregate(filter(sequence(0, {PATTERNS - 1}), p -> p & _bit != 0), 0L, (s, p) -> s + n[p] * ({share}))").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return orders(pattern_counts(document_flags(docs, labels, id_col, text_col, part_col)))
