"""Token counts that follow edits.

A document keeps a segment tree over its pre-tokens: a leaf stands for a run of
them, with its characters and tokens, and inner nodes hold the sums of their
halves.  An edit goes down the tree to the leaf it falls into, re-encodes from
that leaf until the boundaries of pre-tokens meet the old ones again at a leaf's
edge, and updates the sums above the leaves in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.llm.common import attach, on_worker

LEAF = 32  # pre-tokens of a leaf when the tree is built
FAT = 8  # a leaf of so many times LEAF has the tree built anew
LOOK_AHEAD = 2  # characters after a pre-token that can decide where it ends
CACHED_PIECES = 1_000_000
EDITS = "array<struct<start:int,end:int,text:string>>"


class Counter:
    """Pre-tokens of a text and their token counts; each distinct one is encoded once per worker."""

    def __init__(self, path: str, pattern: str):
        import base64

        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoder = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        if len(self.known) > CACHED_PIECES:
            self.known.clear()
        known = self.known
        for p in set(pieces):
            if p not in known:
                known[p] = len(self.encoder.encode_ordinary(p))
        return list(map(known.__getitem__, pieces))


class Tree:
    """Sums of characters, tokens and pre-tokens, in heap order: node i has the halves 2i and 2i + 1."""

    def __init__(self, chars, tokens, pieces):
        self.sums = (chars, tokens, pieces)
        self.size = len(chars) // 2

    @staticmethod
    def build(pieces: list[str], counts: list[int]) -> Tree:
        import numpy as np

        starts = np.arange(0, max(1, len(pieces)), LEAF)
        size = 1 << int(len(starts) - 1).bit_length()
        sums = []
        for values in (list(map(len, pieces)), counts, [1] * len(pieces)):
            tree = np.zeros(2 * size, np.int64)
            if pieces:
                tree[size:size + len(starts)] = np.add.reduceat(np.array(values, np.int64), starts)
            for level in range(size.bit_length() - 1, 0, -1):
                a, b = 1 << (level - 1), 1 << level
                tree[a:b] = tree[b:2 * b:2] + tree[b + 1:2 * b:2]
            sums.append(tree.tolist())
        return Tree(*sums)

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and the place where the leaf starts."""
        chars, node, start = self.sums[0], 1, 0
        while node < self.size:
            node *= 2
            if place - start >= chars[node] and chars[node + 1]:
                start += chars[node]
                node += 1
        return node - self.size, start

    def put(self, leaf: int, values: tuple[int, int, int]) -> None:
        """Set a leaf and the sums above it."""
        node = leaf + self.size
        changes = [v - tree[node] for v, tree in zip(values, self.sums, strict=True)]
        while node:
            for tree, change in zip(self.sums, changes, strict=True):
                tree[node] += change
            node //= 2


def edit(text: str, tree: Tree, start: int, end: int, new: str, counter: Counter) -> tuple[str, Tree, int]:
    """Replace a span; gives the text, the tree, and how many pre-tokens were encoded again."""
    chars = tree.sums[0]
    first, begin = tree.leaf_at(max(0, start - LOOK_AHEAD - 1))
    after = text[:start] + new + text[end:]
    shift = len(after) - len(text)
    # edges of old leaves beyond the edit, where boundaries may meet again
    leaf, edge = first + 1, begin + chars[tree.size + first]
    pieces, place = [], begin
    for m in counter.pattern.finditer(after, begin):
        pieces.append(m[0])
        place = m.end()
        while leaf < tree.size and (edge < end or edge + shift < place):
            edge += chars[tree.size + leaf]
            leaf += 1
        if edge >= end and edge + shift == place:
            break
    else:
        leaf = tree.size
    counts = counter.counts(pieces)
    many = leaf - first
    if len(pieces) > FAT * LEAF * many:
        whole = counter.pattern.findall(after)
        return after, Tree.build(whole, counter.counts(whole)), len(whole)
    share = -(-len(pieces) // many)
    for k in range(many):
        part = slice(k * share, (k + 1) * share)
        tree.put(first + k, (sum(map(len, pieces[part])), sum(counts[part]), len(pieces[part])))
    return after, tree, len(pieces)


def usable(edits, length: int) -> list[tuple[int, int, str]]:
    """Edits in order, cut to the text; one that overlaps an earlier one, or has no place, is left out."""
    out, upto = [], 0
    for e in sorted((e for e in edits or [] if e and e["start"] is not None and e["end"] is not None),
                    key=lambda e: (e["start"], e["end"])):
        start, end = max(0, e["start"]), min(length, e["end"])
        if upto <= start <= end:
            out.append((start, end, e["text"] or ""))
            upto = end
    return out


TREE = "tree_chars array<int>, tree_tokens array<int>, tree_pieces array<int>"
EDITED = ("new_text string, new_chars array<int>, new_tokens array<int>, new_pieces array<int>, n_edits long, "
          "n_encoded_again long")


def grow(docs: DataFrame, path: str, pattern: str, text: str = "text"):
    """Attach each document's tree; see ``common.attach`` for the two values.  Null texts count as empty."""
    def fn(texts):
        counter = on_worker(("counter", path, pattern), lambda: Counter(path, pattern))
        out = [[], [], []]
        for t in texts:
            pieces = counter.pattern.findall(t or "")
            tree = Tree.build(pieces, counter.counts(pieces))
            for column, sums in zip(out, tree.sums, strict=True):
                column.append(sums)
        return out

    return attach(docs, TREE, fn, text)


def apply_edits(trees: DataFrame, path: str, pattern: str, text: str, edits: str):
    """Apply each row's edits to its text and tree, last edit first, so that offsets stay right."""
    def fn(texts, all_edits, *columns):
        counter = on_worker(("counter", path, pattern), lambda: Counter(path, pattern))
        out = [[], [], [], [], [], []]
        for t, es, *sums in zip(texts, all_edits, *columns, strict=True):
            t, tree, again = t or "", Tree(*sums), 0
            use = usable(es, len(t))
            for start, end, new in reversed(use):
                t, tree, n = edit(t, tree, start, end, new, counter)
                again += n
            for column, v in zip(out, (t, *tree.sums, len(use), again), strict=True):
                column.append(v)
        return out

    return attach(trees, EDITED, fn, text, edits, *T._parse_datatype_string(TREE).names)


def counts_after_edits(docs: DataFrame, edits, path: str, pattern: str) -> DataFrame:
    """Counts before and after a column of edits, whose offsets are code points of the text.

    One row per row: pre-tokens, tokens, edits that were applied, pre-tokens encoded
    again, and the numbers afterwards.  Null texts are empty, null edits none; edits
    that overlap an earlier one are left out, and ends are cut to the text.  Only the
    id, the text and the edits are read, so no name can clash.
    """
    rows = docs.select("doc_id", "text", edits.cast(EDITS).alias("edits"))
    trees, named = grow(rows, path, pattern)
    names = {"_0": "doc_id", "_1": "text", "_2": "edits"}
    done, _ = apply_edits(trees.withColumnsRenamed(names), path, pattern, "text", "edits")
    root = lambda c: F.col(c)[F.when(F.size(c) > 1, 1).otherwise(0)].cast("long")
    return done.select(
        F.col("_0").alias("doc_id"), root("_5").alias("n_pieces"), root("_4").alias("n_tokens"), "n_edits", "n_encoded_again",
        root("new_pieces").alias("n_pieces_after"), root("new_tokens").alias("n_tokens_after"),
        root("new_chars").alias("n_chars_after"))
