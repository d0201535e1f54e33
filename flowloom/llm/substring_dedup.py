"""Removal of repeated passages by automata over recurring phrases.

A window is 50 consecutive words of one document. A word goes if a window that
covers it also starts in a document with a smaller id. The steps:

1.  Every window has one phrase, the 25-word sequence of the least hash in it.
    Equal windows have equal phrases, so only phrases of two or more documents
    matter. Runs of windows with one phrase make blocks; equal blocks recur whole.
2.  Recurring passages are confirmed: a block's first document by the block's
    hash. Where one phrase stands in different blocks, each is compared with the
    phrase's first document, and windows that this one doesn't have with their own
    first document, by the window's hash. The first documents own the passages.
3.  Each owner's passages are a shard: an Aho-Corasick automaton over their
    phrases (pyahocorasick), through which the claimed parts of all other
    documents stream. A hit is extended word by word on both sides; what isn't
    the owner's text, word for word, is not removed. Owners of many copies are
    split into parts, each with the same automaton and its share of documents.

Hashes thus only choose what is compared. Window statistics cover every whole
text; nothing is capped or sampled, and the work grows with the corpus.

Defined results: a null text has no words; a text of fewer than 50 words loses
none. Rows with a null id are neither compared nor changed. Rows that share an
id count as one document, of several texts: none of them is smaller than the
others. Repeated rows give repeated equal rows. Extra columns are carried only
where asked for; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_ROWS, KeyFilter, Scratch, mix64, split_columns, text_or_empty

WINDOW_WORDS = 50
#: Claims on one owner that one part of its shard answers.
CLAIMS_PER_PART = 4096
#: Words whose hashes a worker keeps.
CACHE_ENTRIES = 50_000
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class WordHashes(dict):
    """word -> 64-bit hash; bounded."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        out = self[word] = xxh64_intdigest(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Powers:
    """Powers of BASE and of its inverse modulo 2^64, as many as the longest text needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            size = 2 * n
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(size, BASE, np.uint64)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(size, INVERSE, np.uint64)], dtype=np.uint64)


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every run of width values, by doubling."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


class Hasher:
    """Rolling hashes of one document's word sequences."""

    def __init__(self, window: int) -> None:
        self.window, self.phrase = window, window // 2
        self.words, self.powers = WordHashes(), Powers()

    def load(self, words: list[bytes]) -> None:
        n = len(words)
        self.powers.reach(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.words.of(words) * self.powers.up[:n], out=self.sums[1:])

    def spans(self, begin: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
        raw = (self.sums[end] - self.sums[begin]) * self.powers.down[begin]
        return mix64(raw + (end - begin).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(salt))

    def blocks(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, block hash, first window, windows) of each block of a loaded document of n words."""
        at = np.arange(n - self.phrase + 1)
        least = window_minima(self.spans(at, at + self.phrase, 1), self.window - self.phrase + 1)
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        count = np.diff(np.r_[first, len(least)])
        return least[first], self.spans(first, first + count - 1 + self.window, 2), first, count


def _blocks(docs: DataFrame, window: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        hasher = Hasher(window)
        for batch in batches:
            for keys, texts in split_columns(batch, ["k", "t"]):
                out: list[list[np.ndarray]] = [[], [], [], [], []]
                for key, text in zip(keys, texts, strict=True):
                    words = text.split()
                    if key is None or len(words) < window:
                        continue
                    hasher.load(words)
                    phrase, block, first, count = hasher.blocks(len(words))
                    for column, v in zip(out, (phrase.view(np.int64), block.view(np.int64), np.full(len(first), key), first, count), strict=True):
                        column.append(v)
                if out[0]:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(out, kinds, strict=True)], names=["phrase", "block", "d", "s", "n"])

    return docs.mapInArrow(run, "phrase long, block long, d long, s int, n int")


def _owned(docs: DataFrame, window: int) -> DataFrame:
    """From owners (k, t, need): their passages (kind 0) and the windows of blocks that differ around one phrase (kind 1)."""

    def run(batches):
        import pyarrow as pa

        hasher = Hasher(window)
        kinds = (pa.int8(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
        names = ["kind", "d", "s", "passage", "phrase", "hash"]
        for batch in batches:
            for keys, texts, needs in split_columns(batch, ["k", "t", "need"], 64):
                passages, windows = [], []
                for key, text, need in zip(keys, texts, needs, strict=True):
                    words = text.split()
                    last = len(words) - window
                    need = sorted((x["s"], min(x["s"] + x["n"] - 1, last), x["mixed"], x["phrase"]) for x in need if x["s"] <= last)
                    if not need:
                        continue
                    for begin, end in _merged((a, b + window) for a, b, _, _ in need):
                        passages.append((key, begin, b" ".join(words[begin:end])))
                    if any(x[2] for x in need):
                        hasher.load(words)
                        for a, b, mixed, phrase in need:
                            if mixed:
                                at = np.arange(a, b + 1)
                                windows.append((np.full(len(at), key), at, np.full(len(at), phrase), hasher.spans(at, at + window, 3).view(np.int64)))
                if passages:
                    k, s, t = zip(*passages, strict=True)
                    n = len(k)
                    yield pa.RecordBatch.from_arrays([pa.array([0] * n, kinds[0]), pa.array(k, kinds[1]), pa.array(s, kinds[2]), pa.array(t, kinds[3]), pa.nulls(n, kinds[4]), pa.nulls(n, kinds[5])], names=names)
                if windows:
                    k, s, p, h = (np.concatenate(x) for x in zip(*windows, strict=True))
                    n = len(k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(n), kinds[0]), pa.array(k, kinds[1]), pa.array(s, kinds[2]), pa.nulls(n, kinds[3]), pa.array(p, kinds[4]), pa.array(h, kinds[5])], names=names)

    return docs.mapInArrow(run, "kind tinyint, d long, s int, passage binary, phrase long, hash long")


def _merged(spans):
    """Spans in order, those that overlap or touch joined."""
    begin = end = None
    for a, b in spans:
        if end is not None and a <= end:
            end = max(end, b)
            continue
        if end is not None:
            yield begin, end
        begin, end = a, b
    if end is not None:
        yield begin, end


def claimed_segments(claims: list[tuple[int, int, int, int]], n_words: int, window: int) -> list[tuple[int, int, int, int]]:
    """(owner, parts, begin, end) in words: runs of claimed windows of one owner. claims: (first window, windows, owner, parts)."""
    out: list[list[int]] = []
    for s, n, owner, parts in sorted(claims):
        last = min(s + n - 1, n_words - window)
        if last < s:
            continue
        if out and out[-1][0] == owner and s <= out[-1][3] - window + 1:
            out[-1][3] = max(out[-1][3], last + window)
        else:
            out.append([owner, parts, s, last + window])
    return [tuple(x) for x in out]


def _segments(claimed: DataFrame, window: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for rids, texts, claims in split_columns(batch, ["rid", "t", "claims"], 64):
                rows = []
                for rid, text, own in zip(rids, texts, claims, strict=True):
                    words = text.split()
                    for owner, parts, a, b in claimed_segments([(c["s"], c["n"], c["f"], c["parts"]) for c in own], len(words), window):
                        rows.append((owner, rid % parts, rid, a, b" ".join(words[a:b])))
                if rows:
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["owner", "part", "rid", "s", "words"])

    return claimed.mapInArrow(run, "owner long, part int, rid long, s int, words binary")


class Shard:
    """Automaton over the phrases of one owner's passages."""

    SEPARATOR, UNKNOWN = -1, -2

    def __init__(self, passages: list[bytes], window: int) -> None:
        import ahocorasick

        self.window, self.phrase = window, window // 2
        self.number: dict[bytes, int] = {}
        flat: list[int] = []
        at: dict[tuple[int, ...], list[int]] = {}
        for passage in passages:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in passage.split()]
            # a window holds a whole one of the phrases that follow each other from the passage's begin
            for i in range(0, len(ids) - self.phrase + 1, self.phrase):
                at.setdefault(tuple(ids[i : i + self.phrase]), []).append(len(flat) + i)
            flat += [*ids, self.SEPARATOR]
        self.flat = np.array(flat, np.int64)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, where in at.items():
            self.automaton.add_word(key, where)
        self.automaton.make_automaton()

    def locate(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Spans of words that, word for word, are window-long parts of a passage."""
        if len(words) < self.window or not len(self.automaton):
            return []
        ids = tuple(self.number.get(w, 0) for w in words)
        text = np.array(ids, np.int64)
        text[text == 0] = self.UNKNOWN
        covered = np.zeros(len(ids), bool)
        seen: dict[int, int] = {}  # offset of text to passage -> end of the run found there
        for end, places in self.automaton.iter(ids):
            begin = end + 1 - self.phrase
            for q in places:
                if seen.get(begin - q, -1) > end:
                    continue
                a, b = self._run(text, begin, q)
                seen[begin - q] = b
                if b - a >= self.window:
                    covered[a:b] = True
            if covered.all():
                break
        edges = np.flatnonzero(np.diff(np.r_[0, covered.view(np.int8), 0]))
        return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))

    def _run(self, text: np.ndarray, begin: int, q: int) -> tuple[int, int]:
        """The longest equal run around equal phrases at begin and q."""
        back = min(begin, q)
        differ = np.flatnonzero(text[begin - back : begin] != self.flat[q - back : q])
        a = begin - back + differ[-1] + 1 if len(differ) else begin - back
        ahead = min(len(text) - begin, len(self.flat) - q)
        differ = np.flatnonzero(text[begin : begin + ahead] != self.flat[q : q + ahead])
        return int(a), int(begin + differ[0]) if len(differ) else begin + ahead


def _located(passages: DataFrame, segments: DataFrame, window: int) -> DataFrame:
    """(rid, begin, end) of confirmed spans."""
    left = passages.select("owner", "part", F.lit(0).cast("tinyint").alias("kind"), F.lit(None).cast("long").alias("rid"), F.lit(0).alias("s"), F.col("passage").alias("words"))
    right = segments.select("owner", "part", F.lit(1).cast("tinyint").alias("kind"), "rid", "s", "words")

    def run(batches):
        import pyarrow as pa

        shard, now, passages = None, None, []
        for batch in batches:
            for owners, parts, kinds, rids, starts, texts in split_columns(batch, ["owner", "part", "kind", "rid", "s", "words"], 4096):
                out = []
                for owner, part, kind, rid, s, text in zip(owners, parts, kinds, rids, starts, texts, strict=True):
                    if (owner, part) != now:
                        now, passages, shard = (owner, part), [], None
                    if not kind:
                        passages.append(text)
                        continue
                    if shard is None:
                        shard = Shard(passages, window)
                    out += [(rid, s + a, s + b) for a, b in shard.locate(text.split())]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["rid", "begin", "end"])

    both = left.unionByName(right).repartition("owner", "part").sortWithinPartitions("owner", "part", "kind")
    return both.mapInArrow(run, "rid long, begin long, end long")


def _finished(rows: DataFrame, skip: KeyFilter | None, digest: bool) -> DataFrame:
    """Words, removed words and what is kept. skip: rows whose key it may hold are left to another pass."""
    fields = {f.name: f for f in rows.schema.fields}
    carry = "carry" in fields

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if skip is not None:
                key = batch.column(batch.schema.get_field_index("k"))
                valid = np.asarray(key.is_valid().to_numpy(zero_copy_only=False))
                batch = batch.filter(pa.array(~(skip.test(key.fill_null(0).to_numpy(zero_copy_only=False)) & valid)))
            at = 0
            for row in split_columns(batch, ["t", *["found"] * ("found" in fields)]):
                texts, found = row if len(row) == 2 else (row[0], [None] * len(row[0]))
                own = batch.slice(at, len(texts))
                at += SLICE_ROWS
                words_in, gone, kept = [], [], []
                for text, spans in zip(texts, found, strict=True):
                    words = text.split()
                    left, to, removed = [], 0, 0
                    for a, b in sorted((x["begin"], x["end"]) for x in spans or ()):
                        if b > to:
                            left += words[to:a]
                            removed += b - max(a, to)
                            to = b
                    words_in.append(len(words))
                    gone.append(removed)
                    joined = b" ".join(left + words[to:]) if removed or digest else text
                    kept.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode())
                columns = [own.column(own.schema.get_field_index(c)) for c in (["carry"] if carry else []) + ["k"]]
                columns += [pa.array(words_in, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*["carry"] * carry, "k", "n_words", "n_removed", "kept"])

    schema = rows.select(*["carry"] * carry, "k").schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")
    return rows.mapInArrow(run, schema)


def _maybe(docs: DataFrame, keys: KeyFilter) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            key = batch.column(batch.schema.get_field_index("k"))
            valid = np.asarray(key.is_valid().to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array(keys.test(key.fill_null(0).to_numpy(zero_copy_only=False)) & valid))

    return docs.mapInArrow(run, docs.schema)


def remove_repeats(df: DataFrame, window: int = WINDOW_WORDS, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), digest: bool = False) -> DataFrame:
    """(carried columns, key, n_words, n_removed, kept) for every row.

    kept: the text, as it was if nothing goes, else its kept words joined by one
    space; with digest the SHA-256 of the kept words joined by one space.
    """
    if window < 2 or window % 2:
        raise ValueError("window must be even")
    scratch = Scratch(df.sparkSession, "substring")
    docs = df.select(F.col(key).cast("long").alias("k"), text_or_empty(text).alias("t"), *([F.struct(*carry).alias("carry")] if carry else []))
    plain = docs.select("k", "t")

    blocks = scratch.table(_blocks(plain, window))
    shared = blocks.groupBy("phrase").agg(F.min("d").alias("a"), F.max("d").alias("b")).filter("a <> b").select("phrase")
    shared = scratch.table(shared)  # a written table: the join's two sides are plain shuffles, whose hot keys Spark can split
    active = scratch.table(blocks.join(shared, "phrase", "left_semi"))
    scratch.drop(blocks)

    first = scratch.table(active.groupBy("phrase", "block").agg(F.min("d").alias("f")))
    kinds = scratch.table(first.groupBy("phrase").agg((F.count("*") > 1).alias("mixed"), F.min("f").alias("g")))
    known = scratch.table(active.join(first, ["phrase", "block"]).join(kinds, "phrase").select("phrase", "d", "s", "n", "f", "g", "mixed"))
    scratch.drop(active)

    owners = known.filter("f = d").groupBy(F.col("d").alias("k")).agg(F.collect_list(F.struct("s", "n", "mixed", "phrase")).alias("need"))
    owned = scratch.table(_owned(_maybe(plain, KeyFilter.of(owners, "k")).join(owners, "k"), window))
    scratch.drop()

    windows = owned.filter("kind = 1").select("phrase", "hash", "d", "s")
    earlier = windows.groupBy("phrase", "hash").agg(F.min("d").alias("f"), F.max("d").alias("l")).filter("f <> l").drop("l")
    earlier = scratch.table(earlier.join(kinds, "phrase").filter("f <> g").select("phrase", "hash", "f"))  # the rest is in what g owns
    by_window = windows.join(earlier, ["phrase", "hash"]).filter("f < d").select("d", "s", F.lit(1).alias("n"), "f")
    by_phrase = known.filter("mixed and f = d and g < d").select("d", "s", "n", F.col("g").alias("f"))
    claims = scratch.table(known.filter("f < d").select("d", "s", "n", "f").unionByName(by_phrase).unionByName(by_window))
    scratch.drop(known)

    parts = scratch.table(claims.groupBy("f").agg(F.ceil(F.count("*") / CLAIMS_PER_PART).cast("int").alias("parts")))
    by_doc = claims.join(parts, "f").groupBy(F.col("d").alias("k")).agg(F.collect_list(F.struct("s", "n", "f", "parts")).alias("claims"))
    keys = KeyFilter.of(claims, "d")
    met = scratch.table(_maybe(docs, keys).join(by_doc, "k", "left").withColumn("rid", F.monotonically_increasing_id()))
    scratch.drop()

    segments = _segments(met.filter("claims is not null").select("rid", "t", "claims"), window)
    passages = owned.filter("kind = 0").select(F.col("d").alias("owner"), "passage").join(parts.withColumnRenamed("f", "owner"), "owner")
    passages = passages.select("owner", "passage", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    found = _located(passages, segments, window).groupBy("rid").agg(F.collect_list(F.struct("begin", "end")).alias("found"))
    columns = [*["carry"] * bool(carry), "k", "t"]
    rest = _finished(met.join(found, "rid", "left").select(*columns, "found"), None, digest)
    out = _finished(docs, keys, digest).unionByName(rest)
    return out.select(*[F.col(f"carry.`{c}`") for c in carry], *([] if key in carry else [F.col("k").alias(key)]), "n_words", "n_removed", "kept")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs, digest=True).withColumnRenamed("kept", "kept_sha256")
