"""Token counts, packing, SentencePiece, media and HTML against brute force and the libraries."""

import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from flowloom.llm import html_text, packing, progressive_jpeg, sentencepiece_codec, token_counts

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


# ---------------------------------------------------------------- op2


def test_counts_follow_edits(odd_documents, no_documents):
    counts = token_counts.PreTokenCounts(RANKS, public_tokenizers.PATTERN)
    out = token_counts.count_documents(odd_documents, RANKS, public_tokenizers.PATTERN, token_counts.redaction_edits)
    want = []
    for d, t in texts_of(odd_documents):
        edited = t
        for a, b, new in token_counts.redaction_edits(t):
            edited = edited[:a] + new + edited[max(a, b) :]
        want.append((d, len(t), len(counts.encoding.encode_ordinary(t)), len(edited), len(counts.encoding.encode_ordinary(edited))))
    got = [tuple(r)[:5] for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    long = max(out.collect(), key=lambda r: r["n_chars"])
    assert long["reencoded_chars"] < long["n_chars"] / 10
    assert token_counts.count_documents(no_documents, RANKS, public_tokenizers.PATTERN).count() == 0


def test_kept_trees(odd_documents):
    """Edits of kept trees encode the edited places alone, and give the trees of the edited texts."""
    counts = token_counts.PreTokenCounts(RANKS, public_tokenizers.PATTERN)
    kept = token_counts.keep_trees(odd_documents, RANKS, public_tokenizers.PATTERN)
    for r in kept.collect():
        leaves = np.frombuffer(bytes(r["tree"]), "<u4").reshape(-1, 2)
        assert leaves.sum(axis=0).tolist() == [r["n_chars"], r["n_tokens"]] == [len(r["text"]), len(counts.encoding.encode_ordinary(r["text"]))]
        tree = token_counts.CountTree(counts, r["text"], bytes(r["tree"]))
        assert tree.total == r["n_tokens"] and tree.kept() == bytes(r["tree"]) and not tree.reencoded
    same = token_counts.recount(kept, RANKS, public_tokenizers.PATTERN).collect()
    assert all(r["reencoded_chars"] == 0 and r["edited_tokens"] == r["n_tokens"] for r in same)
    edited = token_counts.recount(kept, RANKS, public_tokenizers.PATTERN, token_counts.redaction_edits).collect()
    assert all(np.frombuffer(bytes(r["tree"]), "<u4").reshape(-1, 2).sum(axis=0).tolist() == [r["edited_chars"], r["edited_tokens"]] for r in edited)


def test_random_edits(monkeypatch):
    monkeypatch.setattr(token_counts, "LEAF_CHARS", 8)
    counts = token_counts.PreTokenCounts(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(3)
    parts = ["a", " ", "  ", "\n", "\n\n", "'", "s", "'s", " 1", "é", "!", " foo", "Bar\t", "   \n  "]
    for _ in range(1500):
        tree = token_counts.CountTree(counts, "".join(rng.choices(parts, k=rng.randint(0, 60))))
        for _ in range(3):
            a = rng.randint(0, len(tree.text) + 2)
            tree.replace(a, a + rng.randint(0, 6), "".join(rng.choices(parts, k=rng.randint(0, 4))))
            assert tree.total == len(counts.encoding.encode_ordinary(tree.text))
            assert tree.chars[1] == len(tree.text)


# ---------------------------------------------------------------- op6


def test_packing(spark, odd_documents, no_documents):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORDS)
    docs = odd_documents.repartition(3)
    pieces = packing.pack(docs, WORDS, 64, with_ids=True).toPandas()
    want = sorted(np.array([*whole.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes() for _, t in texts_of(odd_documents))
    pieces["at"] = pieces["sequence_id"] * 64 + pieces["offset"]
    pieces = pieces.sort_values("at").reset_index(drop=True)
    assert pieces["at"].tolist() == [0, *np.cumsum(pieces["length"]).tolist()[:-1]]  # gapless, nothing twice
    assert (pieces["offset"] + pieces["length"] <= 64).all()
    assert all(zlib.crc32(i) == c and len(i) == 4 * n for i, c, n in zip(pieces["ids"], pieces["ids_crc32"], pieces["length"], strict=True))
    docs_back = (pieces["start"] == 0).cumsum()
    assert sorted(b"".join(g["ids"]) for _, g in pieces.groupby(docs_back)) == want
    assert (pieces.groupby(docs_back)["length"].sum().values == pieces.groupby(docs_back)["doc_tokens"].first().values).all()
    assert packing.pack(no_documents, WORDS).count() == 0


def test_sequences_are_padded(spark):
    docs = spark.createDataFrame([(i, "word " * 9) for i in range(5)], "doc_id long, text string").coalesce(1)
    rows = packing.sequences(packing.pack(docs, WORDS, 16, with_ids=True), 16).orderBy("sequence_id").collect()
    assert [r["n_tokens"] for r in rows] == [16, 16, 16, 2]
    assert [len(r["ids"]) // 4 for r in rows] == [16, 16, 16, 2]  # two is a power of two: no padding
    rows = packing.sequences(packing.pack(docs.limit(3), WORDS, 16, with_ids=True), 16).orderBy("sequence_id").collect()
    assert [(r["n_tokens"], len(r["ids"]) // 4) for r in rows] == [(16, 16), (14, 16)]


# ---------------------------------------------------------------- op9


def test_sentencepiece(odd_documents, no_documents):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sentencepiece_codec.encode_documents(odd_documents, PIECES, ("n_tokens", "ids", "span_ends", "decoded", "ids_sha256", "decoded_sha256")).collect()
    by_ids = {}
    for _, t in texts_of(odd_documents):
        ids = sp.encode(t, add_bos=True, add_eos=True)
        by_ids[np.array(ids, "<u4").tobytes()] = (t, ids)
    assert len(got) == odd_documents.count()
    for r in got:
        t, ids = by_ids[bytes(r["ids"])]
        assert r["n_tokens"] == len(ids) and r["decoded"] == sp.decode(ids)
        assert r["ids_sha256"] == hashlib.sha256(bytes(r["ids"])).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
        ends = np.frombuffer(bytes(r["span_ends"]), "<u4").astype(int)
        raw, at = t.encode(), 0
        assert (not len(raw) and not len(ends)) or ends[-1] == len(raw)
        for i, end in zip(ids[1:-1], ends, strict=True):
            name = sp.id_to_piece(i)
            surface = bytes([int(name[3:5], 16)]) if sp.is_byte(i) else name.replace("▁", " ").encode()
            assert raw[at:end] == (surface if at or not surface.startswith(b" ") else surface[1:])
            at = end
    assert sentencepiece_codec.encode_documents(no_documents, PIECES).count() == 0


def _trie(keys):
    """A double array laid out by first fit, values being offsets in the replacement strings."""
    units = [0] * 4096
    used = {0}
    strings, offsets = b"", {}
    for k, v in keys.items():
        offsets[k] = len(strings)
        strings += v + b"\0"

    def place(node, prefix):
        labels = sorted({k[len(prefix)] for k in keys if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in keys
        want = [0] * leaf + labels
        base = next(b for b in range(1, 2048) if all((node ^ b ^ x) not in used for x in want))
        units[node] |= base << 10 | leaf << 8
        used.update(node ^ base ^ x for x in want)
        if leaf:
            units[node ^ base] = 0x80000000 | offsets[prefix]
        for x in labels:
            units[node ^ base ^ x] |= x
        for x in labels:
            place(node ^ base ^ x, prefix + bytes([x]))

    place(0, b"")
    body = np.array(units, "<u4").tobytes()
    return len(body).to_bytes(4, "little") + body + strings


def test_longest_prefix_normalisation():
    from flowloom.llm.model_proto import NormalizerSpec

    spec = NormalizerSpec(_trie({b"a": b"A", b"abc": b"[abc]", "ﬁ".encode(): b"fi", b"\t": b" "}), True, True, True)
    text, borders = sentencepiece_codec.Normalizer(spec)("  ab abcd\t ﬁ ".encode())
    assert text.decode() == "▁Ab▁[abc]d▁fi"
    surface = "  ab abcd\t ﬁ ".encode()
    spans = {text[i : i + 1]: surface[borders[i] : max(borders[i + 1], borders[i])] for i in range(len(text))}
    assert spans[b"A"] == b"a" and len(borders) == len(text) + 1 and (np.diff(borders) >= 0).all()


# ---------------------------------------------------------------- op5


def test_payload_round_trip(odd_documents, no_documents):
    out = progressive_jpeg.store_texts(odd_documents).collect()
    want = sorted(hashlib.sha256(progressive_jpeg.padded(t.encode())).hexdigest() for _, t in texts_of(odd_documents))
    assert sorted(r["payload_sha256"] for r in out) == want
    for r in out:
        assert r["payload_bytes"] % 64 == 0 < r["payload_bytes"] and r["media_bytes"] == len(r["media"])
        assert len(r["rgb"]) == r["height"] * r["width"] * 3
    assert progressive_jpeg.store_texts(no_documents).count() == 0


def test_fast_reading_equals_the_plain_reader(monkeypatch):
    for data in (os.urandom(64 * 21), b"\xff" * 640, bytes(64)):
        media = progressive_jpeg.write_payload(data)
        fast = progressive_jpeg.Image(media)
        assert progressive_jpeg.read_payload(fast) == data
        with monkeypatch.context() as m:
            m.setattr(progressive_jpeg.Image, "_uniform", lambda *a: False)
            plain = progressive_jpeg.Image(media)
        assert (plain.components[0].coefficients == fast.components[0].coefficients).all()


def test_payload_files_are_subsampled_colour(monkeypatch):
    for data in (os.urandom(64 * 75), os.urandom(64 * 700), bytes(64)):
        media = progressive_jpeg.write_payload(data)
        image = progressive_jpeg.Image(media)
        assert [(c.h, c.v) for c in image.components] == [(2, 2), (1, 1), (1, 1)] and progressive_jpeg.read_payload(image) == data
        y, cb, cr = (image.plane(c).astype(np.float32) for c in image.components)
        assert y.shape == (2 * cb.shape[0], 2 * cb.shape[1]) == (image.height, image.width)
        cb, cr = (p.repeat(2, axis=0).repeat(2, axis=1) - 128 for p in (cb, cr))
        want = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
        assert (image.rgb() == np.clip(want + 0.5, 0, 255).astype(np.uint8)).all()
        with monkeypatch.context() as m:
            m.setattr(progressive_jpeg.Image, "_uniform", lambda *a: False)
            plain = progressive_jpeg.Image(media)
        assert all((a.coefficients == b.coefficients).all() for a, b in zip(image.components, plain.components, strict=True))


def _by_the_jvm(spark, rgb=None, data=None):
    """Write a progressive 4:2:0 file, or read one, with the JVM's own codec."""
    jvm = spark.sparkContext._jvm
    if data is not None:
        image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
        h, w = image.getHeight(), image.getWidth()
        flat = np.array([[image.getRGB(x, y) & 0xFFFFFF for x in range(w)] for y in range(h)])
        return np.stack([flat >> 16, flat >> 8 & 255, flat & 255], axis=2)
    h, w, _ = rgb.shape
    image = jvm.java.awt.image.BufferedImage(w, h, 1)
    for y in range(h):
        for x in range(w):
            r, g, b = map(int, rgb[y, x])
            image.setRGB(x, y, r << 16 | g << 8 | b)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    param.setProgressiveMode(1)
    sink = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(sink)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    stream.flush()
    return bytes(sink.toByteArray())


def test_colour_files_of_another_codec(spark):
    y, x = np.mgrid[0:37, 0:45]
    rgb = np.stack([128 + 100 * np.sin(x / 9), 128 + 100 * np.cos(y / 7), (x + y) * 2.5], axis=2).clip(0, 255).astype(np.uint8)
    data = _by_the_jvm(spark, rgb)
    image = progressive_jpeg.Image(data)
    assert len(image.components) == 3 and (image.h, image.v) == (2, 2)
    got = image.rgb().astype(int)
    assert got.shape == rgb.shape and np.abs(got - _by_the_jvm(spark, data=data)).mean() < 4
    out = progressive_jpeg.decode_images(spark.createDataFrame([(1, data), (2, None), (3, b"no")], "image_id long, media binary")).orderBy("image_id").collect()
    assert [r["height"] for r in out] == [37, None, None] and bytes(out[0]["rgb"]) == image.rgb().tobytes()


def test_payload_files_read_by_another_codec(spark):
    image = progressive_jpeg.Image(progressive_jpeg.write_payload(os.urandom(64 * 20)))
    theirs = _by_the_jvm(spark, data=progressive_jpeg.write_payload(os.urandom(64 * 20)))
    assert theirs.shape == image.rgb().shape


# ---------------------------------------------------------------- op7

PAGE = (
    '<html><head><title>t</title><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">home</a></ul></nav>'
    '<div id="cookie-notice">We use cookies, and many more words stand here</div><div class="post"><h2>Title&nbsp;here</h2><p>First   paragraph &amp; more,\n that goes on.'
    '<div class="ad">Buy</div><p>Second<br>line<blockquote>Quote</blockquote></div><aside>a long text at the side that says little</aside>'
    '<section class="comments"><p>Great article, I love it so much that I write this</p><p>Another comment that is long</p></section><form>Send</form><footer>bye</footer></body></html>'
)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (PAGE, "Title here\nFirst paragraph & more, that goes on.\nSecond line\nQuote"),
        ("", ""),
        ("plain &lt;text", "plain <text"),
        ("<p>one<p>two<ul><li>x<li>y</ul>", "one\ntwo\nx\ny"),
        ("<nav>a</nav>", ""),
        ("<body><main><section><p>aaa bbb</p><p>ccc</p></section><section><p>d</p></section></main><div>out</div>", "aaa bbb\nccc\nd"),
        ("<article><h1>T</h1><p><b>x<br><p>y</b> z</p></article><footer>f", "T\nx\ny z"),
        ("<article><p>cut <b>off</article", "cut off"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<!-- c --><p>x<!-- <p>no</p> -->y</p>", "xy"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("open_tag", ['<div class="layout has-sidebar">', '<div id="page" class="site with-header">', '<form id="f" action="/">'])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_wrappers_of_the_whole_page(open_tag, inner):
    page = f'<body>{open_tag}<div class="sidebar"><p>at the side</p></div><{inner}><p>The text of the page is long enough to count.</p><p>It goes on here.</p></{inner}></{open_tag[1:].split()[0]}></body>'
    assert html_text.main_text(page) == "The text of the page is long enough to count.\nIt goes on here."


@pytest.mark.parametrize("names", ["alert-fire", "market-share", "reply-note", "has-sidebar content", "with-header", "tagsoup"])
def test_names_that_hold_other_words_live(names):
    page = f'<body><article><p>The first paragraph of this text.</p><p class="{names}">A paragraph that stays.</p></article></body>'
    assert html_text.main_text(page) == "The first paragraph of this text.\nA paragraph that stays."


@pytest.mark.parametrize("names", ["comments", "cookie-notice", "reader-comments", "adBox", "related-posts", "share_buttons", "x comments"])
def test_names_of_boilerplate_words_alone_go(names):
    page = f'<body><article><p>The first paragraph of this text.</p><div class="{names}"><p>A paragraph that goes.</p></div><p>The last one.</p></article></body>'
    assert html_text.main_text(page) == "The first paragraph of this text.\nThe last one."


LONG = [f"Paragraph {i} of the text says something in a line that is long enough to count as prose." for i in range(8)]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # no article element: density alone; a list of links and a short line beside it stay out
        ('<div><ul><li><a href="/a">one link here</a><li><a href="/b">and another</a></ul><div>' + "".join(f"<p>{x}</p>" for x in LONG) + "</div><div>(c) x</div></div>", LONG),
        # two sibling mains
        ("<main>" + "".join(f"<p>{x}</p>" for x in LONG[:5]) + "</main><main>" + "".join(f"<p>{x}</p>" for x in LONG[5:]) + "</main>", LONG),
        # a heading in front of the densest block
        ("<div><h1>Title</h1><div>" + "".join(f"<p>{x}</p>" for x in LONG) + "</div><div>up</div></div>", ["Title", *LONG]),
        # formatting inside a paragraph makes it no better than its article
        ("<article><p>" + " ".join(f"<b>{x}</b>" for x in LONG) + "</p><p>The end.</p></article>", [" ".join(LONG), "The end."]),
        ("<div><p>" + " ".join(f"<b>{x}</b> and" for x in LONG) + f"</p><p>{LONG[0]}</p></div>", [" ".join(f"{x} and" for x in LONG), LONG[0]]),
    ],
)
def test_density_chooses(page, text):
    assert html_text.main_text(f"<body><nav>menu</nav>{page}<footer>end</footer></body>").split("\n") == text


def test_densities_against_counting():
    """Characters, tags, densities and sums of every node, each counted anew from its subtree."""
    import math

    rng = random.Random(9)

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            return " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 30)))
        tag = rng.choice(["div", "p", "b", "a", "section", "ul", "nav", "span"])
        return f"<{tag}>" + "".join(make(depth - 1) for _ in range(rng.randint(1, 4))) + f"</{tag}>"

    def alive(n):
        return [c for c in n.children if not isinstance(c, str) and not c.dead]

    def chars(n):
        return sum(len(c.replace(" ", "")) for c in n.children if isinstance(c, str)) + sum(map(chars, alive(n)))

    def tags(n):
        return sum(1 + tags(c) for c in alive(n))

    def in_links(n):
        return (chars(n), tags(n) + 1) if n.tag == "a" else tuple(map(sum, zip((0, 0), *map(in_links, alive(n)), strict=True)))

    def density(n, body):
        c, t, (lc, lt) = chars(n), max(1, tags(n)), in_links(n)
        if not c:
            return 0.0
        base = math.log(c / max(1, c - lc) * max(1, lc) + in_links(body)[0] / max(1, chars(body)) * c + math.e)
        return c / t * math.log(max(1.0, c / max(1, lc) * t / max(1, lt)) + 1e-9) / math.log(base)

    for _ in range(60):
        root = html_text.parse("".join(make(5) for _ in range(3)))
        measured = html_text.measure(root)
        for n in measured:
            assert (n.chars, n.tags, n.link_chars, n.link_tags) == (chars(n), tags(n), *in_links(n))
            assert n.density == pytest.approx(density(n, root))
            assert n.total == pytest.approx(sum(density(c, root) for c in alive(n) if c.tag in html_text.BLOCKS) or density(n, root))
        best = max((n for n in measured if n.tag in html_text.BLOCKS or n is root), key=lambda n: n.total)
        kept = html_text.main_nodes(root)
        up = best
        while up is not None and up not in kept:
            up = up.parent
        assert up is not None  # the densest subtree is always inside what is kept


def test_very_long_pages():
    page = "<article>" + "".join(f"<p>{x} {i}</p>" for i in range(20_000) for x in LONG[:1]) + "</article>"
    assert html_text.main_text(page).count("\n") == 19_999


def test_pages(spark):
    rows = [(1, "u", PAGE, 5), (2, None, None, 5), (None, "v", "<p>deep" + "<div>" * 3000 + "x", 5), (1, "u", PAGE, 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    out = html_text.extract_pages(df).collect()
    assert len(out) == 4 and all(r["n_chars"] == len(r["text"]) for r in out)
    assert [r["text"] for r in out if r["page_id"] == 2] == [""]
    assert html_text.extract_pages(df.filter("false")).count() == 0
