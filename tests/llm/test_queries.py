"""The queries themselves: the columns, types and digests that they derive from the operators."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pulsegrid.llm import html, media, queries
from tests.llm.test_corpus import slow_targets, toxic_corpus, vectors
from tests.llm.test_simhash import slow_components, slow_fingerprint
from tests.llm.test_texts import PAGE, slow_spans

EXTRA = ["mail a@b.org, c.d@e-f.com or +1 (743) 555-3824 from 10.0.0.1", "card 4387513035237269 or 4387 5130 3523 7269 and 1.2.3.256", "é" * 70 + " 漢字 \U0001f600", "Released under the MIT License.", "long " + "word and more " * 6000]


def documents():
    rows = [(i, t, f"s{i % 4}" if i % 4 else None) for i, t, _ in toxic_corpus(240)]
    rows += [(1000 + i, t, "s1") for i, t in enumerate(EXTRA)] + [(2000, None, "s2"), (2001, "", None), (2002, rows[3][1], "s0"), (2003, rows[3][1].upper(), "s0")]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in documents()], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in toxic_corpus(240)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", "<p>" + "x " * 90_000)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(i, v) for i, v in enumerate(vectors(np.random.default_rng(2), 60, 16))], "vec_id long, embedding array<double>").write.parquet(f"{path}/embeddings.parquet")
    return path


def run(spark, folder, name):
    out = queries.QUERIES[name](spark, folder)
    return out, out.collect()


def test_op1(spark, folder):
    out, rows = run(spark, folder, "op1_html_extraction")
    assert out.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    assert {(r.page_id, r.text, r.n_chars) for r in rows} == {(1, t := html.main_text(PAGE), len(t)), (2, "", 0), (3, t := ("x " * 90_000).strip(), len(t))}


def test_op2(spark, folder):
    out, rows = run(spark, folder, "op2_pii")
    assert out.dtypes[:6] == [("doc_id", "bigint"), *((f"n_{k}", "bigint") for k in ("email", "ip", "card", "phone")), ("base_sha256", "string")]
    got = {r.doc_id: r for r in rows}
    assert len(got) == len(rows) == len(documents())
    for i, text, _ in documents():
        spans = slow_spans(text or "")
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in spans) for kind in ("email", "ip", "card", "phone")]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(joined.split(",")) <= set(r.spans.split(",")) | {""}


def test_op3(spark, folder):
    out, rows = run(spark, folder, "op3_media_columns")
    assert out.columns[:8] == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    got = {r.doc_id: r for r in rows}
    for i, text, _ in documents():
        data = (text or "").encode()
        whole = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
        assert r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest() and r.media_bytes == len(r.media)
        assert r.segments and all(len(c.log_mel) == media.CLIP * media.BANDS and c.start_s < c.end_s for c in r.clips)
    assert got[3].feature == got[2002].feature


def test_op4(spark, folder):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    _, rows = run(spark, folder, "op4_token_counts")
    want = {(i, len((t or "").encode()), n := len(sp.encode(t)) if t else 0, n > 4096) for i, t, _ in documents()}
    assert {tuple(r) for r in rows} == want and any(r.over_limit for r in rows)


def test_op5(spark, folder):
    _, rows = run(spark, folder, "op5_license_scans")
    assert [(r.doc_id, r.license) for r in rows] == [(1003, "MIT")]


def test_op6(spark, folder):
    out, rows = run(spark, folder, "op6_mixing")
    assert out.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    sizes = {}
    for _, t, s in documents():
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    targets, source = slow_targets(sizes), {i: s for i, _, s in documents()}
    assert all(abs(r.target - targets[source[r.doc_id]]) < 1e-6 and r.source_size == sizes[source[r.doc_id]] and r.taken <= 3 * r.size for r in rows) and len(rows) == len(documents())


def test_op7(spark, folder):
    out, rows = run(spark, folder, "op7_toxicity")
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    labels = {i: y for i, _, y in toxic_corpus(240)}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) > 0.9


def test_op8(spark, folder):
    _, rows = run(spark, folder, "op8_simhash_near_duplicates")
    fps = {i: slow_fingerprint(t) for i, t, _ in documents()}
    pairs = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    want = slow_components(pairs, fps)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(i, f"{fp:016x}", want[i]) for i, fp in fps.items()}


def test_op9(spark, folder):
    out, rows = run(spark, folder, "op9_embedding_near_duplicates")
    assert out.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert len(rows) == spark.read.parquet(f"{folder}/embeddings.parquet").count() and all(r.kept == (r.vec_id == r.component_id) for r in rows) and sum(r.n_links for r in rows) > 100


def test_op10(spark, folder):
    out, rows = run(spark, folder, "op10_packing")
    assert out.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for i, t, _ in documents():
        ids = [*(library.encode(t, add_special_tokens=False).ids if t else []), 0]
        want |= {(i, s, min(1024, len(ids) - s), zlib.crc32(np.array(ids[s : s + 1024], "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 1024)}
    assert {(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows} == want
    assert all(r.offset + r.length <= 1024 for r in rows)
