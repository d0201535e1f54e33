"""Token counts that follow edits.

Each document keeps its text as a row of leaves, each a run of whole pre-tokens,
and a segment tree of token counts over them: keep_trees() returns the leaves as a
column. recount() takes kept trees and edits; an edit re-encodes only the leaves it
touches and boundary context on both sides, up to where the pre-token borders agree
with the old ones again, and updates sums on the paths to the root. Nothing else of a
text is encoded again.

Defined results: a null text counts as empty (no tokens); edits beyond the end
of a text are clipped to it. Repeated rows give repeated equal rows; extra input
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, split_columns, text_or_empty

#: Pre-tokens whose counts a worker keeps.
CACHE_ENTRIES = 600_000
#: Characters that a leaf holds before it is closed at the next pre-token border.
LEAF_CHARS = 512


class PreTokenCounts(dict):
    """pre-token -> number of its tokens, by the tiktoken library; bounded."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        super().__init__()
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)

    def __missing__(self, piece: str) -> int:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        n = self[piece] = len(self.encoding.encode_ordinary(piece))
        return n

    def leaves(self, text: str) -> list[tuple[int, int]]:
        """(characters, tokens) of each leaf."""
        out, chars, tokens = [], 0, 0
        for piece in self.pattern.findall(text):
            chars += len(piece)
            tokens += self[piece]
            if chars >= LEAF_CHARS:
                out.append((chars, tokens))
                chars = tokens = 0
        if chars:
            out.append((chars, tokens))
        return out


class CountTree:
    """Segment tree of (characters, tokens) over the leaves of one document."""

    def __init__(self, counts: PreTokenCounts, text: str, kept: bytes | None = None) -> None:
        self.counts, self.text = counts, text
        self.reencoded = 0
        self._build(counts.leaves(text) if kept is None else np.frombuffer(kept, "<u4").reshape(-1, 2).tolist())

    def kept(self) -> bytes:
        """Characters and tokens of each leaf, as uint32; with the text, all that the tree is made from."""
        leaves = slice(self.size, self.size + self.n)
        return np.array([self.chars[leaves], self.tokens[leaves]], "<u4").T.tobytes()

    def _build(self, leaves: list[tuple[int, int]]) -> None:
        size = 1
        while size < len(leaves):
            size *= 2
        self.size, self.n = size, len(leaves)
        self.chars = [0] * (2 * size)
        self.tokens = [0] * (2 * size)
        for i, (c, t) in enumerate(leaves):
            self.chars[size + i], self.tokens[size + i] = c, t
        for i in range(size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character (the last one beyond the end), and where it begins."""
        node, begin = 1, 0
        while node < self.size:
            node *= 2
            if char >= begin + self.chars[node] and self.chars[node + 1]:
                begin += self.chars[node]
                node += 1
        return node - self.size, begin

    def replace(self, start: int, stop: int, new: str) -> int:
        """Replace text[start:stop]; returns the new total."""
        start = min(max(start, 0), len(self.text))
        stop = min(max(stop, start), len(self.text))
        if not self.n:
            self.text = self.text[:start] + new + self.text[stop:]
            self._build(self.counts.leaves(self.text))
            self.reencoded += len(self.text)
            return self.total
        # One leaf of context in front: a pre-token may now begin earlier, but never before a border
        # that the text up to the edit fixes alone; a white-space run can reach back, so step over those.
        first, begin = self._leaf_at(start)
        for _ in range(2):
            if first:
                first -= 1
                begin -= self.chars[self.size + first]
        while first and (self.text[begin - 1].isspace() or self.text[begin].isspace() and not self.text[begin + 1 : begin + 2].strip()):
            first -= 1
            begin -= self.chars[self.size + first]
        last, last_begin = self._leaf_at(max(stop - 1, start))
        end = last_begin + self.chars[self.size + last]
        tail = self.text[stop:]
        self.text = self.text[:start] + new + tail
        shift = len(new) - (stop - start)
        # Behind the edit: take leaves in until a border of the new pre-tokens is one of the old ones.
        while True:
            region_end = end + shift
            context = min(len(self.text), region_end + LEAF_CHARS)
            done = self._resync(begin, region_end, context)
            self.reencoded += context - begin
            if done is not None or region_end >= len(self.text):
                leaves = done if done is not None else self.counts.leaves(self.text[begin:])
                break
            last += 1
            end += self.chars[self.size + last]
        self._splice(first, last, leaves)
        return self.total

    def _resync(self, begin: int, region_end: int, context: int) -> list[tuple[int, int]] | None:
        """Leaves of text[begin:region_end], if a pre-token border falls on region_end whatever follows the context."""
        at, chars, tokens, out, steps_behind, met = begin, 0, 0, [], 0, region_end == begin
        for m in self.counts.pattern.finditer(self.text, begin, context):
            if m.start() >= region_end:
                met |= m.start() == region_end
                steps_behind += 1
                if steps_behind > 1:
                    break
                continue
            piece = m.group()
            at = m.end()
            chars += len(piece)
            tokens += self.counts[piece]
            if chars >= LEAF_CHARS:
                out.append((chars, tokens))
                chars = tokens = 0
        if chars:
            out.append((chars, tokens))
        if at != region_end or not met and region_end != len(self.text):
            return None
        return out if steps_behind > 1 or context == len(self.text) else None

    def _splice(self, first: int, last: int, leaves: list[tuple[int, int]]) -> None:
        if len(leaves) == last - first + 1:
            for i, (c, t) in enumerate(leaves, self.size + first):
                self.chars[i], self.tokens[i] = c, t
            dirty = {(self.size + i) // 2 for i in range(first, last + 1)}
            while dirty - {0}:
                for i in dirty:
                    self._sum(i)
                dirty = {i // 2 for i in dirty if i > 1}
            return
        old = [(self.chars[self.size + i], self.tokens[self.size + i]) for i in range(self.n)]
        self._build([*old[:first], *leaves, *old[last + 1 :]])


def keep_trees(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, tree, n_chars, n_tokens) of every whole text; tree as CountTree.kept() has it."""
    bounded_batches(df.sparkSession)
    key_type = df.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        counts = PreTokenCounts(ranks_path, pattern)
        for batch in batches:
            at = 0
            for (texts,) in split_columns(batch, [text]):
                own = batch.slice(at, len(texts))
                at += len(texts)
                trees = [CountTree(counts, data.decode()) for data in texts]
                sizes = [pa.array(x, pa.int64()) for x in ([len(t.text) for t in trees], [t.total for t in trees])]
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array([t.kept() for t in trees], pa.binary()), *sizes], names=[key, text, "tree", "n_chars", "n_tokens"])

    schema = f"`{key}` {key_type}, `{text}` string, tree binary, n_chars long, n_tokens long"
    return df.select(F.col(key), text_or_empty(text).alias(text)).mapInArrow(run, schema)


def recount(kept: DataFrame, ranks_path: str, pattern: str, edits=None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, n_tokens, edited_chars, edited_tokens, reencoded_chars, tree) from the rows of keep_trees().

    edits: a function of a text that returns [(start, stop, new text), ...], applied in
    turn, each on the text that the one before left. The default edits nothing. tree is
    that of the edited text.
    """
    key_type = kept.schema[key].dataType.simpleString()
    make_edits = edits or (lambda _: [])

    def run(batches):
        import pyarrow as pa

        counts = PreTokenCounts(ranks_path, pattern)
        for batch in batches:
            for keys, texts, trees in split_columns(batch, [key, text, "tree"]):
                rows = []
                for data, own in zip(texts, trees, strict=True):
                    tree = CountTree(counts, data.decode(), own)
                    before = len(tree.text), tree.total
                    for start, stop, new in make_edits(tree.text):
                        tree.replace(start, stop, new)
                    rows.append((*before, len(tree.text), tree.total, tree.reencoded, tree.kept()))
                *sizes, after = zip(*rows, strict=True)
                columns = [*(pa.array(x, pa.int64()) for x in sizes), pa.array(after, pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(key).type), *columns], names=[key, *names, "tree"])

    names = ["n_chars", "n_tokens", "edited_chars", "edited_tokens", "reencoded_chars"]
    schema = f"`{key}` {key_type}, " + ", ".join(f"{n} long" for n in names) + ", tree binary"
    return kept.select(key, text, "tree").mapInArrow(run, schema)


def count_documents(df: DataFrame, ranks_path: str, pattern: str, edits=None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens of every whole text, and after each document's edits, counted from its kept tree; see recount()."""
    return recount(keep_trees(df, ranks_path, pattern, key, text), ranks_path, pattern, edits, key, text).drop("tree")


def redaction_edits(text: str) -> list[tuple[int, int, str]]:
    """Three small edits: a marker for 24 characters in the middle, a word put in at one third, the last 8 characters gone."""
    n = len(text)
    return [(n // 2, n // 2 + 24, "[removed]"), (n // 3, n // 3, " corrected"), (max(0, n - 8), n + 32, "")]


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, redaction_edits)
