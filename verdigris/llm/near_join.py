"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

Texts are sets of five-word shingles; two texts are linked if the sets' Jaccard similarity is at least THRESHOLD.

1. A map computes each text's set, its key (texts with equal sets form one class and are never compared again) and a
   signature of TREES x DEPTH MinHash values: in each tree a text is the path of its DEPTH values.
2. The forest is the tries of these paths in sorted order, as tables: how many texts lie under every prefix of full
   depth, of one value less, and so on up to the shallowest prefix that could be needed. Texts that are alone under
   their shallowest prefix in a tree, nearly all, leave that tree at once.
3. Every text matches its full paths first and then shortens them, tree by tree, always where that lets in the fewest
   texts, until a partner at the threshold would be met with the target recall: with depths d_1, d_2, ... that is
   1 - (1 - t^d_1)(1 - t^d_2)... Two texts meet in a tree if they agree as far as either of them looks there, so the
   recall holds for every pair from either side; crowded nodes stay deep where other trees can make up for them.
4. In each trie node, pairs that met in an earlier tree are left to that tree; pairs whose signatures agree in too
   few values (a pair at the threshold does so with probability below MISS) are skipped. This needs signatures only.
5. Sets are made once for the members that have pairs left, and every such pair is verified on the whole sets.
   Each member gets its count of links and one edge to the smallest member it hangs together with: pairs are counted
   inside the task, never written out.
6. Components of the edges give the groups.

A trie node with more than BLOCK members or BLOCK_SHINGLES shingles is cut into blocks, and each pair of blocks is a task
of its own, so a task's members are bounded in number and bytes, and every pair is still looked at once.

A threshold so low that not even one value of each tree reaches the target recall is refused (ValueError).

Result, one row per document: doc_id, class_id (smallest identifier in its component), n_links (documents linked with it
directly, copies included), n_copies (documents with an equal set), kept (whether it is the component's first).

Cases: null and wordless texts link with nothing (class_id is their own); texts of fewer than five words are one
shingle; null identifiers sort last; repeated rows are copies of each other; an empty table gives an empty result;
columns of any name may ride along in deduplicate().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from verdigris.llm.common import durable, join_groups, likely, map_batches, partitions, without
from verdigris.llm.components import components
from verdigris.llm.shingles import MinHash, mixed, set_key, shingle_set

THRESHOLD = 0.8
TREES, DEPTH = 12, 5
TARGET = 0.999
MISS = 1e-6
BLOCK, BLOCK_SHINGLES = 500, 2_000_000


def gains(threshold: float, depth: int) -> list[float]:
    """What a tree matched to depth 1, 2, ... gives towards recall: -ln of the chance that a pair at the threshold does not meet there."""
    return [math.inf if threshold >= 1 else -math.log1p(-(threshold**d)) for d in range(1, depth + 1)]


def prefix_depth(threshold: float = THRESHOLD, target: float = TARGET, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which all trees together meet a pair at the threshold with the target recall."""
    fit = [d for d, g in enumerate(gains(threshold, depth), 1) if trees * g >= -math.log1p(-target)]
    if not fit:
        raise ValueError(f"{trees} trees cannot find pairs of similarity {threshold} with recall {target}")
    return max(fit)


def chosen_depths(counts: np.ndarray, threshold: float = THRESHOLD, target: float = TARGET, least: int | None = None) -> np.ndarray:
    """For each text (rows) the depth it looks in each tree: counts[i, tree, k] texts lie under its prefix of depth least + k.

    All paths start whole. In each step every text that is short of the target shortens the path that lets in the fewest
    texts (of equal ones, that of the first tree).
    """
    least = prefix_depth(threshold, target) if least is None else least
    gain, need = np.array(gains(threshold, DEPTH)), -math.log1p(-target)
    n, trees, levels = counts.shape
    depth = np.full((n, trees), DEPTH)
    rows = np.arange(n)
    while True:
        short = gain[depth - 1].sum(axis=1) < need - 1e-12
        if not short.any():
            return depth
        at = np.minimum(np.maximum(depth - least, 1), levels - 1)
        added = np.take_along_axis(counts, (at - 1)[:, :, None], axis=2)[:, :, 0] - np.take_along_axis(counts, at[:, :, None], axis=2)[:, :, 0]
        added = np.where(depth > least, added, np.iinfo(np.int64).max)
        tree = added.argmin(axis=1)
        depth[rows[short], tree[short]] -= 1


def least_agreement(size: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """The largest count c for which a pair at the threshold agrees in fewer than c of size values with P <= miss."""
    below, c = 0.0, 0
    while c < size:
        p = math.comb(size, c) * threshold**c * (1 - threshold) ** (size - c)
        if below + p > miss:
            break
        below, c = below + p, c + 1
    return c


def tree_keys(signatures: np.ndarray, depth: int) -> np.ndarray:
    """One 64-bit number for the prefix of `depth` values in each tree."""
    levels = signatures.reshape(len(signatures), TREES, DEPTH)
    keys = np.full((len(signatures), TREES), depth, dtype=np.uint64)
    for k in range(depth):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + levels[:, :, k])
    return keys


SKETCH = pa.schema([("key", pa.binary()), ("n", pa.int32()), ("signature", pa.binary())])


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rid, doc_id, doc (all columns), text, key, n, signature; key is null where there are no words."""
    names = docs.columns
    wrapped = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in names if c != text_col]).alias("doc") if len(names) > 1 else F.lit(None).cast("string").alias("doc"), F.col(text_col).cast("string").alias("text"))
    minhash = MinHash(TREES * DEPTH)

    def run(batches):
        for batch in batches:
            keys, sizes, signs = [], [], []
            pending: list[tuple[int, np.ndarray]] = []

            def flush(pending, signs):
                for (i, _), row in zip(pending, minhash.signatures([s for _, s in pending]), strict=True):
                    signs[i] = row.tobytes()

            waiting = 0
            for i, text in enumerate(batch.column(3)):
                shingles = shingle_set(text.as_py())
                sizes.append(len(shingles))
                keys.append(set_key(shingles) if len(shingles) else None)
                signs.append(None)
                if len(shingles):
                    pending.append((i, shingles))
                    waiting += len(shingles)
                if waiting > 200_000:
                    flush(pending, signs)
                    pending, waiting = [], 0
            if pending:
                flush(pending, signs)
            extra = [pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(signs, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *SKETCH.names])

    schema = StructType([*wrapped.schema.fields, StructField("key", BinaryType()), StructField("n", IntegerType()), StructField("signature", BinaryType())])
    return map_batches(wrapped, run, schema)


def groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows that agree in the first `keys` (integer) columns of sorted batches."""
    held: list[pa.Table] = []
    own: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        table = pa.Table.from_batches([batch])
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(int(c[a]) for c in columns)
            if held and key != own:
                yield own, pa.concat_tables(held)
                held = []
            own = key
            held.append(table.slice(a, b - a))
    if held:
        yield own, pa.concat_tables(held)


class Members:
    """The members of a trie node in a task, as arrays."""

    def __init__(self, table: pa.Table, least: int):
        self.node, self.size, self.block = (table[c].to_numpy() for c in ("node", "n", "block"))
        self.signatures = np.frombuffer(b"".join(table["signature"].to_pylist()), dtype=np.uint16).reshape(table.num_rows, TREES * DEPTH)
        self.depths = np.frombuffer(b"".join(table["depths"].to_pylist()), dtype=np.uint8).reshape(table.num_rows, TREES)
        self.least, self.keys = least, [tree_keys(self.signatures, d) for d in range(least, DEPTH + 1)]

    def meet(self, i: int, others: np.ndarray, trees: int) -> np.ndarray:
        """Which of the others agree with i, in each of the first trees, as far as either of them looks."""
        look = np.minimum(self.depths[others, :trees], self.depths[i, :trees])
        out = self.keys[0][others, :trees] == self.keys[0][i, :trees]
        for k in range(1, len(self.keys)):
            out &= (look < self.least + k) | (self.keys[k][others, :trees] == self.keys[k][i, :trees])
        return out

    def open_pairs(self, tree: int, crossed: bool, agree: int, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
        """(member, other members) for the pairs that this tree has to verify."""
        n = len(self.size)
        for i in range(n - 1):
            rest = slice(i + 1, n)
            fit = np.minimum(self.size[rest], self.size[i]) >= threshold * np.maximum(self.size[rest], self.size[i]) - 1e-9
            if crossed:
                fit &= self.block[rest] != self.block[i]
            others = np.flatnonzero(fit) + i + 1
            if len(others):
                met = self.meet(i, others, tree + 1)
                others = others[met[:, tree] & ~met[:, :tree].any(axis=1)]
            if len(others):
                others = others[(self.signatures[others] == self.signatures[i]).sum(axis=1) >= agree]
            if len(others):
                yield i, others


def verify(sets: list[np.ndarray], pairs: Iterator[tuple[int, np.ndarray]], threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """Of the pairs, those whose sets have at least the threshold's similarity."""
    flat = np.concatenate(sets)
    _, ids = np.unique(flat, return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    marked = np.zeros(int(ids.max()) + 1, dtype=np.int32)
    for i, others in pairs:
        own = ids[starts[i] : ends[i]]
        marked[own] = 1
        shared = np.array([int(marked[ids[starts[j] : ends[j]]].sum()) for j in others])
        marked[own] = 0
        linked = others[shared >= threshold * (sizes[i] + sizes[others] - shared) - 1e-9]
        if len(linked):
            yield i, linked


def depths_of(members: DataFrame, least: int, threshold: float, rows: int) -> DataFrame:
    """(node, depths) of the members: how far each looks in each tree, a byte for every tree.

    members: tree, node, met (texts under the prefix of depth `least`), and the prefixes below that as columns p1, p2, ...
    """
    deeper = [c for c in members.columns if c.startswith("p") and c[1:].isdigit()]
    if not deeper:
        every = F.lit(bytes([least] * TREES))
        return members.select("node").distinct().withColumn("depths", every)
    counted = members
    for k, name in enumerate(deeper, 1):
        under = durable(members.groupBy("tree", name).agg(F.count(F.lit(1)).alias(f"met{k}")), "tries", rows)
        counted = durable(join_groups(counted, under, ["tree", name], f"met{k}"), "counted", rows)
    columns = ["met", *(f"met{k}" for k in range(1, len(deeper) + 1))]
    # one row for each tree of a node: groups of TREES rows at most
    by_node = counted.groupBy("node").agg(F.collect_list(F.struct("tree", *columns)).alias("trees"))

    def run(batches):
        for batch in batches:
            counts = np.ones((batch.num_rows, TREES, len(columns)), dtype=np.int64)  # alone in trees it has left
            for i, trees in enumerate(batch.column(1).to_pylist()):
                for t in trees:
                    counts[i, t["tree"]] = [t[c] for c in columns]
            depths = chosen_depths(counts, threshold, least=least).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d.tobytes() for d in depths], pa.binary())], names=["node", "depths"])

    return map_batches(by_node, run, "node long, depths binary")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> tuple[DataFrame, DataFrame]:
    """(sketched rows, one row per document: rid, doc_id, class_id, n_links, n_copies, kept)."""
    least = prefix_depth(threshold)
    rows = durable(sketch(docs, id_col, text_col), "sketch")
    total = rows.count()
    agree = least_agreement(TREES * DEPTH, threshold)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    worded = rows.filter(F.col("key").isNotNull())
    classes = worded.groupBy("key").agg(F.min("rid").alias("node"), F.count(F.lit(1)).alias("n_copies"), F.min(first).alias("first"))
    classes = durable(classes, "classes", total)
    leaders = durable(worded.join(classes.select(F.col("node").alias("rid"), "n_copies"), "rid").select(F.col("rid").alias("node"), "n", "signature", "n_copies"), "leaders", total)
    below = [f"p{k}" for k in range(1, DEPTH - least + 1)]

    def prefixes(batches):
        for batch in batches:
            signatures = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, TREES * DEPTH)
            keys = [pa.array(tree_keys(signatures, d).astype(np.int64).ravel()) for d in range(least, DEPTH + 1)]
            trees = pa.array(np.tile(np.arange(TREES, dtype=np.int32), batch.num_rows))
            yield pa.RecordBatch.from_arrays([trees, *(pa.array(np.repeat(batch.column(c).to_numpy(), TREES)) for c in (0, 1)), *keys], names=["tree", "node", "n", "prefix", *below])

    paths = durable(map_batches(leaders.select("node", "n", "signature"), prefixes, "tree int, node long, n int, prefix long" + "".join(f", {p} long" for p in below)), "paths")
    met = durable(paths.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("met"), F.sum("n").alias("shingles")).filter("met > 1"), "tries", total)
    blocks = F.greatest(F.ceil(F.col("met") / F.lit(block)), F.ceil(F.col("shingles") / F.lit(block_shingles))).cast("int")
    members = durable(join_groups(paths, met, ["tree", "prefix"], "met").withColumn("blocks", blocks), "members")
    share = members.count()
    looks = durable(depths_of(members, least, threshold, share), "depths", share)
    # a member of a node in k blocks takes part in k block pairs (its own with itself among them)
    spread = members.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("tree", "prefix", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "node")
    signed = leaders.join(looks, "node")

    def together(df: DataFrame) -> DataFrame:
        keys = ["tree", "prefix", "low", "high"]
        return df.repartition(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys, "node")

    def pick(batches):
        for (tree, prefix, low, high), table in groups_of(batches, 4):
            own = Members(table, least)
            needed: set[int] = set()
            for i, others in own.open_pairs(tree, low != high, agree, threshold):
                needed.add(i)
                needed.update(others.tolist())
            if needed:
                at = sorted(needed)
                k = len(at)
                yield pa.RecordBatch.from_arrays([pa.array([tree] * k, pa.int32()), pa.array([prefix] * k, pa.int64()), pa.array([low] * k, pa.int32()), pa.array([high] * k, pa.int32()), pa.array(own.block[at].astype(np.int32)), pa.array(own.node[at])], names=["tree", "prefix", "low", "high", "block", "node"])

    shown = ["tree", "prefix", "low", "high", "block", "node", "n", "signature", "depths"]
    needed = durable(map_batches(together(spread.join(signed.hint("merge"), "node").select(*shown)), pick, "tree int, prefix long, low int, high int, block int, node long"), "needed", share, deal=True)

    def sets_of(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], names=["node", "shingles"])

    def check(batches):
        for (tree, _, low, high), table in groups_of(batches, 4):
            own = Members(table, least)
            node, copies = own.node, table["n_copies"].to_numpy()
            sets = [np.frombuffer(b.as_buffer(), dtype=np.uint64) for b in table["shingles"]]
            links, root = np.zeros(len(node), np.int64), list(range(len(node)))

            def find(x, root=root):
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            for i, others in verify(sets, own.open_pairs(tree, low != high, agree, threshold), threshold):
                links[i] += copies[others].sum()
                links[others] += copies[i]
                for j in others.tolist():
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
            at = np.flatnonzero(links)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[[find(int(i)) for i in at]]), pa.array(links[at])], names=["node", "root", "links"])

    wanted = durable(needed.select("node").distinct(), "wanted", share)
    # no semi-join here: the optimizer would move it below the bitmap, and all texts would be shuffled
    sets = map_batches(likely(rows.select(F.col("rid").alias("node"), "text"), wanted, "node").select("node", "text"), sets_of, "node long, shingles binary")
    read = needed.join(signed.hint("merge"), "node").join(sets.hint("merge"), "node").select(*shown, "n_copies", "shingles")
    linked = durable(map_batches(together(read), check, "node long, root long, links long"), "links", share, deal=True)
    labels = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")), share)
    counts = linked.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(labels, "node", "left").join(counts, "node", "left").select("key", "n_copies", "first", F.coalesce("label", "node").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"))
    named = durable(named, "named", total)
    leading = durable(named.groupBy("label").agg(F.min("first").alias("lead"), F.count(F.lit(1)).alias("_classes")), "leading", total)
    full = durable(join_groups(named, leading, ["label"], "_classes").select("key", "n_copies", "n_links", "lead"), "full", total)
    narrow = rows.select("rid", "doc_id", "key")
    placed = join_groups(narrow.filter(F.col("key").isNotNull()), full, ["key"], "n_copies")
    alone = narrow.filter(F.col("key").isNull()).select("rid", "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), F.lit(True).alias("kept"))
    return rows, placed.select("rid", "doc_id", F.col("lead.doc_id").alias("class_id"), "n_links", "n_copies", (F.col("lead.rid") == F.col("rid")).alias("kept")).unionByName(alone)


def near_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_links, n_copies, kept; one row per document."""
    return near_groups(docs.select(id_col, text_col), id_col, text_col, threshold)[1].drop("rid")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs of which one of each group stays, with the columns of docs."""
    rows, placed = near_groups(docs, id_col, text_col, threshold)
    dropped = durable(placed.filter("NOT kept").select("rid"), "dropped", rows.count())
    kept = without(rows.select("rid", "doc", "text"), dropped, "rid")
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns])
