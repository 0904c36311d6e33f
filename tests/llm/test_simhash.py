from __future__ import annotations

import random

import numpy as np
import xxhash

from pulsegrid.llm import simhash
from pulsegrid.llm.components import connected_components


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(pairs, nodes):
    at = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(at[a], at[b])
            if at[a] != low or at[b] != low:
                at[a] = at[b] = low
                changed = True
    return at


def test_fingerprint_is_that_of_all_shingles():
    for text in (None, "", " \n\t", "One", "one two", "A b c", "a b c d a b c d", "Ünï ß\x0bx y z " * 30, "w " * 40000):
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(rng.randrange(5000, 5600), rng.randrange(5000, 5600)) for _ in range(500)]
    pairs += [(7, 7), (-5, 9000), (9000, -5)]
    want = slow_components(pairs, {n for p in pairs if p[0] != p[1] for n in p} | {n for p in pairs for n in p})
    got = dict(connected_components(spark.createDataFrame(pairs + [(None, 3)], "a long, b long").repartition(7)).collect())
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    assert got == {n: want[n] for n in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(1)
    base = [[f"w{rng.randrange(900)}" for _ in range(rng.randrange(30, 200))] for _ in range(60)]
    texts = [" ".join(w) for w in base]
    for w in base:
        for _ in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    texts += [None, "", "  ", "one", "ONE", texts[0].upper(), texts[0]]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp long, component_id string")
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = {i: slow_fingerprint(t) for i, t in rows}
    pairs = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    want = slow_components(pairs, fps)
    assert len(set(want.values())) < len(want) - 8
    assert got == {i: (fps[i], want[i]) for i in fps}
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_large_buckets_go_block_by_block(spark, monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(simhash, "BLOCK", 8)
    seen = np.unique(np.concatenate([rng.integers(0, 1 << 12, 300, dtype=np.int64) | 7 << 40, rng.integers(-(1 << 62), 1 << 62, 50)]))
    edges = [tuple(r) for r in simhash.links(spark.createDataFrame([(int(x),) for x in seen], "fp long")).collect()]
    pairs = [(a, b) for a in seen.tolist() for b in seen.tolist() if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in edges)
    assert slow_components(edges, seen.tolist()) == slow_components(pairs, seen.tolist())


def test_edge_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicate(empty).count() == 0
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(False, 3, 3), (False, 4, 3), (False, 5, 5), (False, 5, 5), (True, 0, 5)]
    assert sorted((r.doc_id or 0) for r in simhash.deduplicate(docs).collect()) == [3, 5]


def test_deduplicate_loses_no_document(spark):
    long = "w " * 60_000
    rows = [(1, "alpha beta gamma delta", "a"), (1, "totally different words here now", "b"), (2, "and a third text of its own", "c"), (None, "one more without an id", "d"), (None, "one more without an id", "e"), (None, None, "f"), (None, "", "g"), (9, long, "h"), (8, long, "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, one string").withColumnsRenamed({"one": "row"})
    clash = docs.selectExpr("doc_id", "text", "row", "row as one", "row as fp", "row as component")
    for frame in (docs, clash):
        got = simhash.deduplicate(frame)
        assert got.columns == frame.columns
        found = sorted((r.doc_id or 0, r.text or "", r.row) for r in got.collect())
        assert [f[:2] for f in found] == sorted([(1, rows[0][1]), (1, rows[1][1]), (2, rows[2][1]), (0, rows[3][1]), (0, ""), (8, long)])


def test_hot_segments_are_dealt_by_the_other_ones_bytes(spark, monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    base = [(int(x) << 32 | 99, 99 << 32 | int(x)) for x in rng.integers(0, 1 << 31, 250)]
    base = [y for x in base for y in x]
    flipped = [x ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for x in base[:300] for a, b, c in [rng.integers(0, 63, 3)]]
    seen = sorted(set(base + flipped))
    frame = spark.createDataFrame([(x,) for x in seen], "fp long")
    assert simhash.hot_segments(frame).count() == 2
    sizes = {r.key: r["count"] for r in simhash._dealt(simhash.variants(frame), simhash.hot_segments(frame)).groupBy("key").count().collect()}
    assert max(sizes.values()) < 64
    edges = [tuple(r) for r in simhash.links(frame).collect()]
    pairs = [(a, b) for a in seen for b in seen if a < b and (a ^ b).bit_count() <= 3]
    assert all((a ^ b).bit_count() <= 3 for a, b in edges) and len(pairs) > 200
    assert slow_components(edges, seen) == slow_components(pairs, seen)
