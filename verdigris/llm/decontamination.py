"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are the symbols. The patterns are the benchmark's windows: every WINDOW consecutive words of an item, or the
whole item if it is shorter. Patterns of one length make one search: a shift table over blocks of two words says how
far the search may jump (a block that occurs in no pattern allows the longest jump, so most positions are never
looked at); where the shift is zero, a bucket chosen by the hash of the last block lists the test strings, and
direct comparison of all words confirms an occurrence. A document is read once and is never compared with
another, so the search is a map.

The distinct windows are counted first, with their bytes. Up to PATTERN_BLOCK of them with PATTERN_BYTES in all are
broadcast; more are dealt by hash into as many blocks as that takes, each searched over all documents, and the blocks'
findings are merged per row. A window that very many items share has their identifiers in several parts of about
ITEMS_A_PART, which are dealt out like windows of their own. So the broadcast stays bounded in rows and bytes, however
large the benchmark is and whatever it repeats.

Cases: null text has no words (no windows, no hits); an item repeated under one identifier counts once; items whose
identifier is null mark words but are not listed; empty tables on either side give rows without hits or none.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import durable, map_batches

WINDOW = 10
PATTERN_BLOCK, PATTERN_BYTES, ITEMS_A_PART = 200_000, 64 << 20, 1000
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SPARK_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
FOUND = "_row long, doc_id long, n_words long, spans array<struct<s:int,e:int>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of digits, Latin letters and non-ASCII characters, as UTF-8."""
    return WORD.findall(text.encode().lower()) if text else []


class WuManber:
    """Search for patterns (tuples of words, all of one length) in lists of words."""

    def __init__(self, patterns: list[tuple]):
        self.m = len(patterns[0])
        self.block = min(2, self.m)
        self.jump = self.m - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = defaultdict(list)
        for pattern in patterns:
            for end in range(self.block, self.m + 1):
                key = self.key(pattern, end)
                self.shift[key] = min(self.shift.get(key, self.jump), self.m - end)
            self.buckets[self.key(pattern, self.m)].append(pattern)

    def key(self, words, end: int):
        return (words[end - 2], words[end - 1]) if self.block == 2 else words[end - 1]

    def search(self, words: list) -> list[tuple[int, tuple]]:
        """(start, pattern) of each occurrence."""
        found = []
        m, jump, shift, buckets = self.m, self.jump, self.shift.get, self.buckets
        end, last = m, len(words)
        pairs = self.block == 2
        while end <= last:
            key = (words[end - 2], words[end - 1]) if pairs else words[end - 1]
            step = shift(key, jump)
            if step:
                end += step
                continue
            here = tuple(words[end - m : end])
            found += [(end - m, pattern) for pattern in buckets[key] if pattern == here]
            end += 1
        return found


class Screen:
    """All windows of one block, by length; what a document holds of them."""

    def __init__(self, windows: list[tuple[str, list[str]]]):
        items: dict[tuple, list[str]] = {}
        for w, ids in windows:
            items.setdefault(tuple(w.encode().split(b" ")), []).extend(ids)
        by_length = defaultdict(list)
        for window in items:
            by_length[len(window)].append(window)
        self.items = items
        self.searches = [WuManber(patterns) for _, patterns in sorted(by_length.items())]

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans of hit words (start, end) and the identifiers of the items found."""
        spans, items = [], set()
        for search in self.searches:
            for start, window in search.search(words):
                spans.append((start, start + len(window)))
                items.update(self.items[window])
        return merge(spans), items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(s, e) for s, e in out]


def windows(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """window (words joined by spaces), part and items: the identifiers of the items that hold it, about ITEMS_A_PART in each part.

    Every window has a part 0, without identifiers where its items have none.
    """
    lower = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = benchmark.select(F.col(item_col).cast("string").alias("item"), F.regexp_extract_all(lower, F.lit(SPARK_WORD), F.lit(0)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (WINDOW - 1)))
    pairs = words.select("item", "w", F.explode(starts).alias("at")).select("item", F.array_join(F.slice("w", F.col("at"), F.lit(WINDOW)), " ").alias("window")).distinct()
    pairs = durable(pairs, "window-items")
    counts = pairs.groupBy("window").agg(F.count("item").alias("_n"))
    crowded = durable(counts.filter(F.col("_n") > ITEMS_A_PART), "crowded-windows")
    # few windows have more items than a part, and a window's rows may be very many: they are told apart by broadcast only
    # where that is small, which the optimizer checks
    parted = pairs.join(crowded, "window", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("item"), F.ceil(F.col("_n") / ITEMS_A_PART).cast("long")), F.lit(0)))
    return parted.groupBy("window", "part").agg(F.collect_list("item").alias("items"))


def summarise(n_words: int, spans: list[tuple[int, int]], items) -> tuple:
    hit = sum(e - s for s, e in spans)
    names = sorted(items)
    return n_words, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0


def _screened(batch, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    kinds = pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()
    return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def pattern_blocks(benchmark: DataFrame, item_col: str, pattern_block: int, pattern_bytes: int = PATTERN_BYTES):
    """The number of blocks of patterns, and a function that broadcasts one of them (about pattern_block rows and pattern_bytes)."""
    patterns = durable(windows(benchmark, item_col, "text"), "windows")
    size = F.octet_length("window") + F.aggregate("items", F.lit(0), lambda n, i: n + F.octet_length(i) + 8)
    total = patterns.agg(F.count("*").alias("rows"), F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-total["rows"] // pattern_block), -(-total["bytes"] // pattern_bytes))

    def block(k: int):
        own = patterns.filter(F.pmod(F.xxhash64("window", "part"), F.lit(blocks)) == k).collect()
        return benchmark.sparkSession.sparkContext.broadcast([(r["window"], r["items"]) for r in own])

    return blocks, block


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", pattern_block: int = PATTERN_BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; one row per document."""
    blocks, block = pattern_blocks(benchmark, item_col, pattern_block)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if blocks == 1:
        table = block(0)

        def run(batches):
            screen = Screen(table.value)
            for batch in batches:
                rows = []
                for text in batch.column(1):
                    words = words_of(text.as_py())
                    rows.append(summarise(len(words), *screen.find(words)))
                yield _screened(batch, rows)

        return map_batches(narrow, run, SCHEMA)

    kept = durable(narrow.withColumn("_row", F.monotonically_increasing_id()).select("_row", "doc_id", "text"), "texts")

    def finder(table):
        def run(batches):
            screen = Screen(table.value)
            for batch in batches:
                out = []
                for row, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    words = words_of(text)
                    spans, items = screen.find(words)
                    out.append({"_row": row, "doc_id": doc, "n_words": len(words), "spans": [{"s": s, "e": e} for s, e in spans], "items": sorted(items)})
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("_row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), ("items", pa.list_(pa.string()))]))

        return run

    found = None
    for k in range(blocks):
        part = map_batches(kept, finder(block(k)), FOUND)
        found = part if found is None else found.unionByName(part)
    # a row meets one entry of each block: groups have `blocks` rows
    merged = found.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))

    def finish(batches):
        for batch in batches:
            rows = [summarise(n, merge([(x["s"], x["e"]) for x in spans]), set(items)) for n, spans, items in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield _screened(batch, rows)

    return map_batches(merged.select("doc_id", "n_words", "spans", "items"), finish, SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", pattern_block: int = PATTERN_BLOCK) -> DataFrame:
    """The documents without any hit word, with all their columns: one filtering map for each block of patterns."""
    blocks, block = pattern_blocks(benchmark, item_col, pattern_block)
    at = docs.columns.index(text_col)

    def clean(table):
        def run(batches):
            screen = Screen(table.value)
            for batch in batches:
                yield batch.filter(pa.array([not screen.find(words_of(t.as_py()))[0] for t in batch.column(at)], pa.bool_()))

        return run

    for k in range(blocks):
        docs = map_batches(docs, clean(block(k)), docs.schema)
    return docs
