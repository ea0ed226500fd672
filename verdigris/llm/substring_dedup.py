"""Removal of repeated passages by relative Lempel-Ziv parsing.

A window is LENGTH consecutive words of a document. Every word goes that lies in a window whose word sequence also starts
elsewhere, in another document or in the same one.

Parsing every document against every block of a corpus would be quadratic. The reference is therefore cut into blocks by
content, so that all that could match a stretch of text lies in one block:

1. In each window the ANCHOR-word sequence with the smallest hash is its anchor; equal windows have equal anchors at equal
   places. Neighbouring windows with one anchor in common are a segment, of LENGTH - ANCHOR + 1 windows at most.
2. Anchors are counted over all documents. Segments whose anchor occurs once match nothing and go no further (a bitmap of
   bounded size tells nearly all of them apart before any shuffle).
3. Equal segments become one reference segment with its number of occurrences. A block is all of them under one anchor;
   its index lists, for every seed (the hash of a window), the segments that hold it.
4. Each segment is parsed greedily against its block's index: a factor goes on while some other reference segment holds
   all of it. At a factor's end the next window, which crosses the boundary, is looked up anew, so none is missed. A
   window is identified by its anchor's and its own hash, 128 bits together.
5. A block of over BLOCK segments (a short common phrase in as many different surroundings) is parsed window by window:
   seeds are counted by anchor, and a factor is each seed that occurs twice. This gives the same factors' words, needs
   no pairs, and leaves no task with more than its share.
6. Factors go back to the places of their segments, and the places of a text to the text.

Places are kept by a text's digest (SHA-256, 128 bits), so copies of a text are parsed by every task that reads them but
their spans meet only once. What the driver gathers is counts and a bitmap of bounded size.

Cases: null text has no words; texts of fewer than LENGTH words lose nothing; white space is [\\x20\\x09-\\x0D] and other
characters, whatever they are, belong to words; repeated rows are copies of each other, so of a text of LENGTH words or
more that occurs twice all words go, in every copy; identifiers may be null or repeated; an empty table gives an empty
result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import BATCH_ROWS, durable, flagged, join_groups, likely, map_batches
from verdigris.llm.shingles import mixed

LENGTH, ANCHOR = 35, 12
BLOCK = 256
CHUNK = 1 << 17
U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Parsed:
    """The segments of one text: anchor and segment hashes, first windows, and the seeds of each."""

    def __init__(self, words: list[bytes], length: int = LENGTH, anchor: int = ANCHOR):
        n = len(words)
        self.anchors = self.segments = self.seeds = np.zeros(0, U)
        self.starts = np.zeros(0, np.int64)
        if n < length:
            return
        hashes = mixed(np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, n))
        power, back = (np.full(n + 1, b, U) for b in (BASE, INVERSE))
        power[0] = back[0] = 1
        power, back = np.cumprod(power), np.cumprod(back)
        sums = np.concatenate([np.zeros(1, U), np.cumsum(hashes * power[:n])])

        def spans(first: np.ndarray, end: np.ndarray) -> np.ndarray:
            return mixed((sums[end] - sums[first]) * back[first] + (end - first).astype(U))

        at = np.arange(n - anchor + 1)
        grams = spans(at, at + anchor)
        width, windows = length - anchor + 1, n - length + 1
        place = np.empty(windows, np.int64)
        for k in range(0, windows, CHUNK):
            view = sliding_window_view(grams[k : k + CHUNK + width - 1], width)[: windows - k]
            place[k : k + CHUNK] = view.argmin(axis=1) + np.arange(k, k + len(view))
        self.starts = np.flatnonzero(np.diff(place, prepend=-1))
        ends = np.append(self.starts[1:], windows)
        self.anchors = grams[place[self.starts]]
        self.segments = spans(self.starts, ends + length - 1)
        self.seeds = spans(np.arange(windows), np.arange(windows) + length)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, Parsed]]:
    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
            parsed = Parsed((text.as_py() or "").encode().split())
            if len(parsed.anchors):
                yield key, parsed


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, parsed in _texts(batches):
        yield pa.RecordBatch.from_arrays([_signed(parsed.anchors)], ["anchor"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, parsed in _texts(batches):
        n = len(parsed.anchors)
        offsets = pa.array(np.append(parsed.starts, len(parsed.seeds)), pa.int32())
        keys = pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([key], pa.binary())).dictionary_decode()
        columns = [_signed(parsed.anchors), _signed(parsed.segments), keys, pa.array(parsed.starts, pa.int32()), pa.ListArray.from_arrays(offsets, _signed(parsed.seeds))]
        yield pa.RecordBatch.from_arrays(columns, ["anchor", "segment", "key", "first", "seeds"])


def factors(block: list[tuple[list[int], int]]) -> list[list[tuple[int, int]]]:
    """For each segment (seeds, occurrences) of a block its factors, as first and last window, parsed greedily.

    The references that hold the factor so far are the bits of a number; a factor ends where none is left. A segment is
    a reference for itself only if it occurs more than once.
    """
    index: dict[int, int] = {}
    for k, (seeds, _) in enumerate(block):
        for seed in seeds:
            index[seed] = index.get(seed, 0) | 1 << k
    found = []
    for k, (seeds, occurrences) in enumerate(block):
        others = -1 if occurrences > 1 else ~(1 << k)
        own, held = [], 0
        for i, seed in enumerate(seeds):
            now = index[seed] & others
            if held & now:
                own[-1] = (own[-1][0], i)
                held &= now
            else:  # the boundary of a factor: the window that crosses it may begin another
                held = now
                if now:
                    own.append((i, i))
        found.append(own)
    return found


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Factors of segments sorted by anchor; a block can go on in the next batch."""
    out: list[tuple[int, int, int, list[tuple[int, int]]]] = []

    def taken(anchor: int, block: list[tuple[int, list[int], int]]) -> None:
        own = factors([(seeds, n) for _, seeds, n in block])
        out.extend((anchor, segment, n, spans) for (segment, _, n), spans in zip(block, own, strict=True) if spans)

    def sent() -> pa.RecordBatch:
        columns = [pa.array([r[k] for r in out], pa.int64()) for k in range(3)]
        flat = np.array([span for r in out for span in r[3]], np.int32).reshape(-1, 2)
        pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["a", "b"])
        offsets = np.concatenate([[0], np.cumsum([len(r[3]) for r in out])]).astype(np.int32)
        out.clear()
        return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets), pairs)], ["anchor", "segment", "n", "spans"])

    last, block = None, []
    for batch in batches:
        for anchor, *segment in zip(*(batch.column(c).to_pylist() for c in ("anchor", "segment", "seeds", "n")), strict=True):
            if anchor != last:
                taken(last, block)
                last, block = anchor, []
                if len(out) >= BATCH_ROWS:
                    yield sent()
            block.append(tuple(segment))
    taken(last, block)
    if out:
        yield sent()


def _crowded(segments: DataFrame) -> DataFrame:
    """anchor, segment, n, spans of segments in blocks of any size, window by window."""
    windows = durable(segments.select("anchor", "segment", "n", F.posexplode("seeds").alias("a", "seed")), "repeat-windows")
    repeated = durable(windows.groupBy("anchor", "seed").agg(F.sum("n").alias("_times"), F.count("*").alias("_rows")).filter("_times > 1").drop("_times"), "repeat-seeds")
    met = join_groups(windows, repeated, ["anchor", "seed"], "_rows")
    return met.groupBy("anchor", "segment", "n").agg(F.collect_list(F.struct("a", F.col("a").alias("b"))).alias("spans"))


def keyed(docs: DataFrame, text_col: str, *others: str) -> DataFrame:
    """The digest of each text, the text, and the other columns asked for."""
    text = docs.select(*others, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return text.select(*others, F.expr("substring(unhex(sha2(text, 256)), 1, 16)").alias("key"), "text")


def repeated_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """key (a text's digest), spans (first word, end), copies; a row for every distinct text that has repeated windows."""
    texts = keyed(docs, text_col)
    anchors = map_batches(texts, _anchors, "anchor bigint").groupBy("anchor").count()
    repeated = durable(anchors.filter("count > 1").select("anchor"), "repeat-anchors")
    found = map_batches(texts, _segments, "anchor bigint, segment bigint, key binary, first int, seeds array<bigint>")
    places = durable(likely(found, repeated, "anchor"), "repeat-places")
    segments = durable(places.groupBy("anchor", "segment", "seeds").agg(F.count("*").alias("n")), "repeat-segments")
    blocks = durable(segments.groupBy("anchor").agg(F.count("*").alias("_size"), F.sum("n").alias("_times")).filter("_times > 1").drop("_times"), "repeat-blocks")
    indexed = join_groups(segments, blocks, ["anchor"], "_size")
    small = indexed.filter(F.col("_size") <= BLOCK).drop("_size").repartition("anchor").sortWithinPartitions("anchor")
    parsed = map_batches(small, _parse, "anchor bigint, segment bigint, n bigint, spans array<struct<a:int,b:int>>")
    parsed = durable(parsed.unionByName(_crowded(indexed.filter(F.col("_size") > BLOCK).drop("_size"))), "repeat-factors")
    at = join_groups(places.select("anchor", "segment", "key", "first"), parsed, ["anchor", "segment"], "n")
    spans = at.select("key", "first", F.explode("spans").alias("s")).select("key", (F.col("first") + F.col("s.a")).alias("a"), (F.col("first") + F.col("s.b") + LENGTH).alias("b"))
    return spans.groupBy("key", "a", "b").agg(F.count("*").alias("copies")).groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("spans"), F.max("copies").alias("copies"))


def _strip(keep_text: bool):
    names = ["n_words", "n_removed", "kept_sha256", *["kept_text"] * keep_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, a, b in zip(batch.column("text"), batch.column("a"), batch.column("b"), strict=True):
                words = (text.as_py() or "").encode().split()
                n, removed = len(words), 0
                if a.is_valid:
                    edges = np.zeros(n + 1, np.int64)
                    np.add.at(edges, np.asarray(a.values), 1)
                    np.add.at(edges, np.asarray(b.values), -1)
                    gone = np.cumsum(edges)[:n] > 0
                    removed = int(gone.sum())
                    words = [words[i] for i in np.flatnonzero(~gone)]
                kept = b" ".join(words)
                rows.append((n, removed, hashlib.sha256(kept).hexdigest(), *[kept.decode()] * keep_text))
            if not rows:
                continue
            columns = [batch.column("_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.string(), pa.string()], strict=False))]
            yield pa.RecordBatch.from_arrays(columns, ["_id", *names])

    return run


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row, and with keep_text what is kept, words joined by one space."""
    spans = durable(repeated_spans(docs, text_col), "repeat-spans")
    rows = keyed(docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("text")), "text", "_id")
    marked = flagged(rows, spans, "key")
    nothing = F.lit(None).cast("array<int>")
    clear = marked.filter("NOT _maybe").select("_id", "text", nothing.alias("a"), nothing.alias("b"))
    # texts are read from the source, not from a stage; a text with over a thousandth of all rows is met by broadcast
    least = docs.count() / 1000
    maybe, hot = marked.filter("_maybe").drop("_maybe"), F.broadcast(spans.filter(F.col("copies") > least))
    done = maybe.join(hot, "key")
    rest = maybe.join(hot.select("key"), "key", "left_anti").join(spans.filter(F.col("copies") <= least).hint("merge"), "key", "left")
    met = [x.select("_id", "text", F.col("spans.a").alias("a"), F.col("spans.b").alias("b")) for x in (done, rest)]
    schema = f"_id {dict(rows.dtypes)['_id']}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * keep_text
    return map_batches(clear.unionByName(met[0]).unionByName(met[1]), _strip(keep_text), schema).withColumnRenamed("_id", "doc_id")
