"""The registered queries themselves: columns, types and defined results on odd and on empty tables."""

import hashlib
import re
import zlib

import pytest

from flowloom.llm import queries

#: First columns of each query, with their types; more may follow.
COLUMNS = {
    "op1_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_token_counts": "doc_id bigint, n_chars bigint, n_tokens bigint, edited_chars bigint, edited_tokens bigint",
    "op3_url_rules": "page_id bigint, host string, path string, rule string, verdict string",
    "op4_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op5_progressive_jpeg": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op6_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op7_html_text": "page_id bigint, url string, text string, n_chars bigint",
    "op8_spotsigs": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op9_sentencepiece": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op10_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
}
PER_DOCUMENT = [q for q in COLUMNS if q not in ("op3_url_rules", "op6_packing", "op7_html_text")]


@pytest.fixture(scope="module")
def tables(spark, odd_documents, tmp_path_factory):
    """Folders of odd rows and of empty tables."""
    labels = spark.createDataFrame([(0, 1, 0), (4, 0, 0), (5, 1, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    rows = [(1, "http://a.com/en/1", "<p>x</p>", "t"), (None, None, None, None), (2, "http://B.net/de/8", "", "t"), (2, "http://B.net/de/8", "", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = {}
    for kind in ("odd", "empty"):
        out[kind] = str(tmp_path_factory.mktemp(kind))
        for name, df in (("documents", odd_documents), ("labels", labels), ("pages", pages)):
            (df if kind == "odd" else df.filter("false")).write.parquet(f"{out[kind]}/{name}.parquet")
    return out


def test_all_are_registered():
    assert list(queries.QUERIES) == sorted(COLUMNS, key=lambda q: int(re.match(r"op(\d+)", q)[1]))


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_and_empty_tables(spark, tables, name):
    empty = queries.QUERIES[name](spark, tables["empty"])
    first = ", ".join(f"{n} {t}" for n, t in empty.dtypes[: COLUMNS[name].count(",") + 1])
    assert first == COLUMNS[name]
    assert empty.count() == 0


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_one_row_per_document(spark, tables, odd_documents, name):
    rows = queries.QUERIES[name](spark, tables["odd"]).collect()
    ids = [r["doc_id"] for r in odd_documents.collect()]
    assert sorted(map(str, (r["doc_id"] for r in rows))) == sorted(map(str, ids))
    texts = {}
    for r in odd_documents.collect():
        texts.setdefault(r["doc_id"], set()).add(r["text"] or "")
    for r in rows:
        lengths = {len(t) for t in texts[r["doc_id"]]}
        if name == "op1_quality":
            assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
            assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        elif name == "op4_simhash":
            assert re.fullmatch("[0-9a-f]{16}", r["fingerprint"]) and r["component_id"] is not None
        elif name == "op5_progressive_jpeg":
            padded = {t.encode() + bytes(-len(t.encode()) % 64 or (0 if t else 64)) for t in texts[r["doc_id"]]}
            assert r["payload_sha256"] in {hashlib.sha256(p).hexdigest() for p in padded} and r["tail_crc32"] in {zlib.crc32(p[-64:]) for p in padded}
        elif name in ("op2_token_counts", "op8_spotsigs"):
            assert r["n_chars"] in lengths


def test_pages(spark, tables):
    rows = queries.QUERIES["op3_url_rules"](spark, tables["odd"]).collect()
    got = sorted((str(r["page_id"]), r["host"], r["path"], r["rule"], r["verdict"]) for r in rows)
    net = ("2", "b.net", "/de/8", "net/de/", "allow")
    assert got == sorted([("1", "a.com", "/en/1", "com/en/", "block"), ("None", "", "", None, "allow"), net, net])
    rows = queries.QUERIES["op7_html_text"](spark, tables["odd"]).collect()
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in rows) == [("1", "x", 1), ("2", "", 0), ("2", "", 0), ("None", "", 0)]


def test_pieces(spark, tables, odd_documents):
    rows = queries.QUERIES["op6_packing"](spark, tables["odd"]).collect()
    assert sum(r["start"] == 0 for r in rows) == odd_documents.count()
    at = sorted((r["sequence_id"] * 2048 + r["offset"], r["length"]) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(at, at[1:], strict=False)) and at[0][0] == 0


def test_pipeline_on_empty_tables(spark, tables):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, tables["empty"])
    assert out.count() == 0 and out.columns[:3] == ["doc_id", "start", "length"]


def test_quality_stage_on_odd_rows(spark, tables, odd_documents):
    import corpus_pipeline

    kept = corpus_pipeline.quality_stage(spark, odd_documents, tables["odd"]).collect()
    every = [tuple(r) for r in odd_documents.collect()]
    assert all(tuple(r) in every for r in kept)
