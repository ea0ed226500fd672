"""Byte-level BPE by a monoid tree reduction.

A text is cut in halves until a part has at most LEAF characters. Leaves are encoded alone; two neighbours are joined by
re-encoding a window around their border, grown until the tokens outside it provably cannot change:

* Cut at a character border from a non-space to a space, no piece of the split pattern spans it and no look-ahead
  reaches across it, so what stands before and after is encoded independently. A window that ends in such cuts (or
  in the text's own ends) leaves all other tokens as they are.
* Inside one long run of letters (a single piece), a token sequence is the piece's encoding exactly if every
  neighbouring pair of tokens, encoded together, gives that pair back. Joining re-encodes the last and first k
  tokens and checks the two pairs at the window's ends, doubling k until both hold.

The join is associative, so the tree's shape does not matter and encode(a + b) = join(encode(a), encode(b)).
Decoding joins the tokens' bytes up a tree of halves.

Cases: null text counts as empty (no tokens); repeated rows are encoded each; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import map_batches

LEAF = 512
#: Characters that a window first takes on either side of a border.
WINDOW = 48
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a file of lines 'base64 rank'."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class Codec:
    """Encoder and decoder over given ranks and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, window: int = WINDOW):
        import tiktoken

        base = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.leaf_encode, self.piece_encode = base.encode_ordinary, base._encode_single_piece
        self.ranks, self.leaf, self.window = ranks, leaf, window
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.widths = [len(token) for token in self.tokens]
        self.cut = regex.compile(r"(?<=\S)\s")
        self.last_cut = regex.compile(r"(?r)(?<=\S)\s")
        self.letters_end, self.letters_start = regex.compile(r"(?r)\p{L}+\Z"), regex.compile(r"\p{L}+")

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self.leaf_encode(text)
        middle = len(text) // 2
        left, right = text[:middle], text[middle:]
        return self.join(left, self.encode(left), right, self.encode(right))

    def join(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
        """encode(left + right) from the encodings of the two."""
        if not left or not right:
            return left_ids + right_ids
        size = self.window
        while True:
            begin = self.left_edge(left, size)
            end = self.right_edge(right, size)
            if begin is not None and end is not None:
                kept_left = self.tokens_before(left_ids, len(left[begin:].encode()))
                kept_right = self.tokens_after(right_ids, len(right[:end].encode()))
                return left_ids[:kept_left] + self.window_encode(left[begin:] + right[:end]) + right_ids[kept_right:]
            if size >= 4 * self.leaf and (joined := self.join_run(left, left_ids, right, right_ids)) is not None:
                return joined
            size *= 2

    def left_edge(self, left: str, size: int) -> int | None:
        """The last sure cut within size characters of left's end; 0 if the window holds all of left."""
        found = self.last_cut.search(left, max(0, len(left) - size))
        return found.start() if found else 0 if size >= len(left) else None

    def right_edge(self, right: str, size: int) -> int | None:
        found = self.cut.search(right, 0, min(len(right), size))
        return found.start() if found else len(right) if size >= len(right) else None

    def window_encode(self, text: str) -> list[int]:
        return self.leaf_encode(text)

    def tokens_before(self, ids: list[int], n_bytes: int) -> int:
        """How many tokens stand before the last n_bytes bytes."""
        k = len(ids)
        while n_bytes > 0:
            k -= 1
            n_bytes -= self.widths[ids[k]]
        return k

    def tokens_after(self, ids: list[int], n_bytes: int) -> int:
        k = 0
        while n_bytes > 0:
            n_bytes -= self.widths[ids[k]]
            k += 1
        return k

    def join_run(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int] | None:
        """The join inside one piece of letters; None where the border does not lie in such a piece."""
        before, after = self.letters_end.search(left), self.letters_start.match(right)
        if not before or not after or (before.start() and left[before.start() - 1] in "'"):
            return None
        space = before.start() > 0 and left[before.start() - 1] == " "  # it belongs to the piece
        first = self.tokens_before(left_ids, len(before[0].encode()) + space)
        stop = self.tokens_after(right_ids, len(after[0].encode()))
        own, others = left_ids[first:], right_ids[:stop]
        k = 4
        while True:
            i, j = max(0, len(own) - k), min(len(others), k)
            middle = self.piece(b"".join(self.tokens[t] for t in own[i:] + others[:j]))
            if (i == 0 or self.stable(own[i - 1], middle[0])) and (j == len(others) or self.stable(middle[-1], others[j])):
                return left_ids[:first] + own[:i] + middle + others[j:] + right_ids[stop:]
            k *= 2

    def piece(self, data: bytes) -> list[int]:
        return self.piece_encode(data)

    def stable(self, a: int, b: int) -> bool:
        return self.piece(self.tokens[a] + self.tokens[b]) == [a, b]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join([self.tokens[t] for t in ids])
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids array<int>: a map over the documents.

    rank_file is read on the driver; the ranks, below a megabyte and fixed by the vocabulary, are broadcast.
    """
    with open(rank_file, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        codec = Codec(read_ranks(shipped.value), pattern)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            ids_out = []
            for i in range(batch.num_rows):
                ids = codec.encode(batch.column(1)[i].as_py() or "")
                out[0].append(len(ids))
                out[1].append(hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest())
                out[2].append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if keep_ids:
                    ids_out.append(ids)
            columns = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(ids_out, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(narrow, run, SCHEMA + (", ids array<int>" if keep_ids else ""))
