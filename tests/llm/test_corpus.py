"""Operators that gather rows from the corpus, and the pipeline of all of them."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from pulsegrid.llm import lattice, mixing, pii, queries, simhash, toxicity
from pulsegrid.llm.components import smallest

# ---- mixing ----


def slow_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_sources, out = float(sum(sizes.values())), set(names), {}
    while open_sources:
        total = sum(weight[s] for s in open_sources)
        over = [s for s in open_sources if left * weight[s] / total > most * sizes[s] + 1e-9]
        if not over:
            return out | {s: left * weight[s] / total for s in open_sources}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_sources -= set(over)
    return out


def test_targets_are_those_of_repeated_sharing(spark):
    rng = random.Random(2)
    for case in range(6):
        sizes = {f"s{i}": rng.choice([0, 1, 5, 50, 500, 5000]) for i in range(rng.randrange(1, 9))} | ({None: 40} if case % 2 else {})
        sizes["é"] = 7
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = slow_targets(sizes)
        assert all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in sizes), (sizes, got, want)


def mixed_documents(spark, n=3000):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        source = rng.choice(["a"] * 12 + ["b", "c", "d", None])
        rows.append((i, "w " * rng.choice([1, 3, 10, 60, 200, 900]), source, 1.0))
    rows += [(7, "w w", "a", 1.0), (7, "w w", "a", 1.0), (None, "x y z", "b", 1.0), (None, "q", "b", 1.0), (9001, None, "c", 1.0), (9002, "", None, 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target double")


def test_mixing_meets_its_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 8)
    docs = mixed_documents(spark).repartition(5)
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    words = sorted((r.id if r.id is not None else -1, r.size) for r in got)
    assert words == sorted((r.doc_id if r.doc_id is not None else -1, len((r.text or "").split())) for r in docs.collect())
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    for rows in by.values():
        c = rows[0].target / rows[0].source_size
        assert sum(r.size for r in rows) == rows[0].source_size
        assert {r.copies for r in rows} <= {math.floor(c + 1e-9), math.ceil(c - 1e-9)} and max(r.copies for r in rows) <= 3
        assert abs(sum(r.copies for r in rows) - c * len(rows)) < 1 + 1e-6
        assert abs(sum(r.copies * r.size for r in rows) - rows[0].target) <= 0.05 * rows[0].target + 900
    again = mixing.mix(docs.repartition(3)).collect()
    key = lambda rows: sorted((str(r.id), r.salt, str(r.source), r.copies) for r in rows)
    assert key(got) == key(again)
    taken = mixing.apply_mix(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r.copies for r in got)
    copies = {}
    for r in taken.collect():
        copies[r.doc_id, r.text, r.source] = copies.get((r.doc_id, r.text, r.source), 0) + 1
    want = {}
    for r in got:
        want[str(r.id), r.size, r.source] = want.get((str(r.id), r.size, r.source), 0) + r.copies
    have = {}
    for (i, t, s), n in copies.items():
        have[str(i), len((t or "").split()), s] = have.get((str(i), len((t or "").split()), s), 0) + n
    assert have == {k: v for k, v in want.items() if v}


def test_each_fraction_is_kept_in_expectation(spark):
    rows = spark.createDataFrame([("s", i, i, 0, 10 + i % 3, 0, 0.05 + 0.9 * (i % 10) / 10) for i in range(40)], "source string, id long, salt long, nth long, size long, whole long, p double")
    total = np.zeros(40)
    runs = 16
    for seed in range(runs):
        found = {r.id: r.extra for r in mixing.round_copies(rows, seed).collect()}
        assert abs(sum(found.values()) - 40 * (0.05 + 0.405)) < 1.001
        total += [found[i] for i in range(40)]
    want = np.array([0.05 + 0.9 * (i % 10) / 10 for i in range(40)])
    pooled = (total / runs - want).reshape(4, 10).mean(axis=0)
    assert np.abs(pooled).max() < 0.25


def test_mixing_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0 and mixing.apply_mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert {(r.target, r.copies) for r in mixing.mix(blank).collect()} == {(0.0, 0)}


def test_apply_mix_takes_any_columns_and_many_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "REPEATS", 16)
    monkeypatch.setattr(mixing, "GROUP", 8)
    rows = [(1, "w " * 9, "a", 5, "x", 1, 2), (None, "same words", "b", 5, "y", 1, 2), (4, "long " * 30_000, "b", 0, None, 1, 2), (5, "d e f", "c", 0, None, 1, 2)]
    rows = rows[:1] * 300 + rows[1:2] * 200 + rows[2:] + [(None, "same words", "b", i, "z", 1, 2) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int, _n string, row int, portion int")
    got = mixing.apply_mix(docs)
    assert got.columns == docs.columns
    taken = got.collect()
    decided = mixing.mix(docs).collect()
    assert len(decided) == len(rows) and len(taken) == sum(r.copies for r in decided)
    assert {tuple(r) for r in taken} <= set(rows)
    want = {}
    for r in decided:
        want[r.id, r.source, r.size] = want.get((r.id, r.source, r.size), 0) + r.copies
    have = {}
    for r in taken:
        k = (r.doc_id, r.source, len(r.text.split()))
        have[k] = have.get(k, 0) + 1
    assert have == {k: v for k, v in want.items() if v}
    # a row is taken its whole number of times or once more, also among rows that differ in other columns only
    each = [sum(1 for t in taken if t.copies == i and t._n == "z") for i in range(50)]
    assert max(each) - min(each) <= 1


# ---- embeddings ----


def vectors(rng, n=400, dim=24):
    base = rng.standard_normal((n, dim))
    near = [base[i % 40] + rng.standard_normal(dim) * rng.choice([0.02, 0.1, 0.2, 0.3]) for i in range(300)]
    rows = [v.tolist() for v in [*base, *near]]
    return rows + [rows[0], rows[0], [3 * x for x in rows[1]], None, [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [float("inf")] * dim, [], [1.0, 2.0], [2.0, 4.0], [1e-200] * dim, [1e200] * dim]


def test_embedding_links_match_brute_force(spark, monkeypatch):
    rows = vectors(np.random.default_rng(5))
    frame = spark.createDataFrame([(3 * i + 5, v, 1, True) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, n_links int, kept boolean")
    usable = [i for i, v in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i]) / np.max(np.abs(rows[i])) for i in usable}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    pairs = {(i, j) for i in usable for j in usable if i < j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9}
    for block in (1024, 16):
        monkeypatch.setattr(lattice, "BLOCK", block)
        got = {r.vec_id: r for r in lattice.near_duplicates(frame).collect()}
        assert len(got) == len(rows)
        links = np.zeros(len(rows), int)
        for i, j in pairs:
            links[i] += 1
            links[j] += 1
        found = np.array([got[3 * i + 5].n_links for i in range(len(rows))])
        assert (found <= links).all() and found.sum() >= 0.97 * links.sum()
        a, b = (np.array(x) for x in zip(*sorted(pairs), strict=True))
        label = smallest(len(rows), a, b)
        same = [got[3 * i + 5].component_id == 3 * label[i] + 5 for i in range(len(rows))]
        assert np.mean(same) > 0.97 and all(r.kept == (r.vec_id == r.component_id) for r in got.values())
        assert all(got[3 * i + 5].n_links == 0 for i in range(len(rows)) if i not in unit)


def test_embedding_edges(spark):
    kind = "vec_id long, embedding array<float>"
    assert lattice.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    got = lattice.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (4, None)], kind)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [(0, 0, 0, False), (2, 1, 2, True), (2, 1, 2, True), (4, 0, 4, True)]


def test_repeated_ids_are_vectors_of_their_own(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.001, 0.0]), (3, [0.0, 1.0, 0.001]), (4, [1.0, 0.0])]
    got = lattice.near_duplicates(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, one int, node int, keys int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)]


def test_recall_at_the_threshold_itself():
    rng = np.random.default_rng(11)
    for dim in (16, 24, 64, 256):
        a = rng.standard_normal((1500, dim))
        a /= np.linalg.norm(a, axis=1)[:, None]
        o = rng.standard_normal((1500, dim))
        o -= (o * a).sum(axis=1)[:, None] * a
        o /= np.linalg.norm(o, axis=1)[:, None]
        x, y = lattice.cells(a), lattice.cells(0.9 * a + np.sqrt(1 - 0.81) * o)
        met = ((x[:, :, :1] == y).any(axis=2) | (y[:, :, :1] == x).any(axis=2)).any(axis=1)
        assert met.mean() >= 0.94, (dim, met.mean())


def test_lattice_points_are_nearest():
    x = np.random.default_rng(1).uniform(-3, 3, (300, 8))
    own = lattice.nearest_e8(x)
    assert np.all((np.rint(own * 2).sum(axis=1) % 4) == 0) and (((x - own) ** 2).sum(axis=1) <= 1 + 1e-9).all()
    step = lattice.roots()
    assert step.shape == (240, 8) and np.allclose((step**2).sum(axis=1), 2)
    assert (((x[:, None] - own[:, None] - step) ** 2).sum(axis=2).min(axis=1) >= ((x - own) ** 2).sum(axis=1) - 1e-9).all()


# ---- toxicity ----


def toxic_corpus(n=900, seed=6):
    rng = random.Random(seed)
    syllables = ["the", "on", "re", "ti", "an", "er", "ble", "ou", "sh", "ion", "st", "es"]
    insults = ["blorgface", "zibnax", "wurpling", "mukgob"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    docs = []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(10, 80))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(insults))
        docs.append((i, " ".join(words), int(toxic)))
    return docs


def test_toxicity_on_held_out_documents_and_disguised_insults():
    docs = toxic_corpus()
    machine = toxicity.train([(t, y) for _, t, y in docs[:600]])
    scorer = toxicity.Scorer(machine)
    scores = np.array(scorer.many([t for _, t, _ in docs[600:]]))
    labels = np.array([y for *_, y in docs[600:]])
    predicted = scores >= toxicity.THRESHOLD
    assert (predicted & (labels == 1)).sum() >= 0.97 * labels.sum() and (predicted & (labels == 0)).sum() <= 0.02 * (labels == 0).sum()
    plain = "the onre tierble an ou "
    disguised = ["zib.nax", "z-i-b-n-a-x", "z i b n a x", "Zibnax!", "ZIBNAX", "zibxnax", "blorgfaces", "muk*gob"]
    found = scorer.many([plain + d + " " + plain for d in disguised])
    assert sum(p >= toxicity.THRESHOLD for p in found) >= len(disguised) - 1, dict(zip(disguised, found, strict=True))
    assert scorer.many([plain, None, "", "  ", "x"])[0] < toxicity.THRESHOLD
    again = toxicity.train([(t, y) for _, t, y in docs[:600]])
    assert (again.weights == machine.weights).all() and again.slope == machine.slope


def phrase_corpus(n, seed):
    """Documents that are toxic by two neighbouring words, each of which is in clean documents too."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randrange(2, 9))) for _ in range(300)] + ["drop", "dead", "stop", "head", "deal", "crop"]
    docs = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 90))]
        words = [w for at, w in enumerate(words) if not (w == "dead" and at and words[at - 1] == "drop")]
        at = rng.randrange(len(words))
        words[at:at] = ["drop", "dead"] if i % 3 == 0 else rng.choice([["drop"], ["dead"], ["dead", "drop"]])
        docs.append((" ".join(words), int("drop dead" in " ".join(words))))
    return docs


def test_phrases_whose_words_are_clean_are_learned():
    machine = toxicity.train(phrase_corpus(400, 3))
    test = phrase_corpus(200, 4)
    predicted = np.array(toxicity.Scorer(machine).many([t for t, _ in test])) >= toxicity.THRESHOLD
    labels = np.array([y for _, y in test]) == 1
    assert (predicted & labels).sum() >= 0.9 * labels.sum() and (predicted & ~labels).sum() <= 0.1 * (~labels).sum()


def test_split_insults_and_insults_within_longer_runs_of_letters_are_found():
    docs = toxic_corpus()
    scorer = toxicity.Scorer(toxicity.train([(t, y) for _, t, y in docs[:600]]))
    plain = " the onre tierble an ou "
    hidden = ["zib nax", "blorg face", "wurp ling", "zi bn ax", "a z i b n a x o e", "blorgfaceblorgfaceblorgface", "q w z.i.b.n.a.x"]
    found = scorer.many([plain + h + plain for h in hidden])
    assert sum(p >= toxicity.THRESHOLD for p in found) >= len(hidden) - 1, dict(zip(hidden, found, strict=True))


def test_units_of_a_group_of_texts_equal_those_of_each_text():
    docs = toxic_corpus(240)
    machine = toxicity.train([(t, y) for _, t, y in docs])
    texts = [t for _, t, _ in docs[:60]] + ["a b c d e f g h i j k the", "... -- !", "x", "w" * 60 + " zibnax " + "q" * 40, "z i b n a x of it is a", ""]
    fast = toxicity.Scorer(machine).values(texts)
    for text, got in zip(texts, fast, strict=True):
        parts = toxicity.parts_of(text)
        every = sorted(toxicity.units(parts) | toxicity.pairs(parts))
        slow = max(machine.units(every).tolist(), default=toxicity.FLOOR) if every else toxicity.FLOOR
        assert abs(got - max(slow, toxicity.FLOOR)) < 1e-4, text


def test_scores_do_not_depend_on_what_is_remembered(monkeypatch):
    docs = toxic_corpus(200)
    machine = toxicity.train([(t, y) for _, t, y in docs])
    texts = [t for _, t, _ in docs] + ["w" * 50_000 + " zibnax", None]
    whole = toxicity.Scorer(machine).many(texts)
    monkeypatch.setattr(toxicity, "REMEMBERED", 50)
    monkeypatch.setattr(toxicity, "GROUP_CHARS", 500)
    assert np.allclose(whole, toxicity.Scorer(machine).many(texts), atol=1e-5)


def test_folded_weights_equal_the_landmark_kernels():
    words = ["zibnax", "the", "blorgface", "ontire", "aaaa"]
    table = np.zeros((toxicity.CLASSES**3, 1), np.float32)
    ids, w = toxicity.features(np.frombuffer(toxicity.codes("zibnaxe")[0], np.uint8)[None, :])
    np.add.at(table[:, 0], ids[0], w)

    def slow(a, b):
        def phi(s):
            out, norm = {}, 0.0
            for i in range(len(s)):
                for j in range(i + 1, len(s)):
                    for k in range(j + 1, min(len(s), i + toxicity.SPAN)):
                        v = toxicity.DECAY ** (k - i + 1)
                        out[s[i], s[j], s[k]] = out.get((s[i], s[j], s[k]), 0) + v
                        norm += v * v
            return {t: v / norm**0.5 for t, v in out.items()}

        x, y = phi(a), phi(b)
        return sum(v * y.get(t, 0) for t, v in x.items())

    got = toxicity.kernel_features([toxicity.codes(x)[0] for x in words], table)[:, 0]
    assert np.allclose(got, [slow(toxicity.codes(x)[0], toxicity.codes("zibnaxe")[0]) for x in words], atol=1e-5)


def test_toxicity_rows(spark):
    docs = toxic_corpus(300)
    frame = spark.createDataFrame([(i, t, "en", 0.5) for i, t, _ in docs] + [(None, None, None, None), (900, "", "", 0.0), (5, docs[5][1], "en", 0.5)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in docs] + [(None, 1, 1), (8, None, 1)], "doc_id long, toxic int, quality int")
    machine, rate = toxicity.fit(frame, labels, lambda i: ~queries.held_out(i))
    got = toxicity.score(frame, machine, rate).collect()
    assert len(got) == 303 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = {i for i, *_ in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    from pyspark.sql import functions as F

    assert {r.doc_id for r in frame.where(queries.held_out(F.col("doc_id"))).select("doc_id").collect()} == held | ({900} if zlib.crc32(b"900") % 4 == 2 else set())
    hits = [(r.predicted, docs[r.doc_id][2]) for r in got if r.doc_id in held]
    assert np.mean([a == b for a, b in hits]) > 0.95
    clean = toxicity.keep_clean(frame, machine, rate)
    assert clean.columns == frame.columns and clean.count() == sum(r.predicted == 0 for r in got)
    none, rate = toxicity.fit(frame, labels.limit(0))
    assert none is None and rate == 0 and {r.score for r in toxicity.score(frame, none, rate).collect()} == {0.0}
    assert toxicity.keep_clean(frame, none).count() == 303
    assert toxicity.score(frame.limit(0), machine, rate).count() == 0


# ---- the pipeline ----


def write_tables(spark, folder):
    rng = random.Random(9)
    docs = [(i, t, "en", f"src{i % 3}", len(t)) for i, t, _ in toxic_corpus(500)]
    docs += [(1000 + i, docs[i][1], "en", "src0", docs[i][4]) for i in range(1, 60, 2)]
    docs += [(2000 + i, docs[i][1] + " mail me at someone@example.org", "en", "src1", 0) for i in range(61, 90, 4)]
    docs += [(3000, None, None, None, None), (3001, "", "en", "src2", 0), (3002, "long " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(3000)), "en", None, 3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in toxic_corpus(500)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_pipeline_equals_its_brute_force_version(spark, tmp_path):
    folder = str(tmp_path)
    write_tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.run(spark, folder).collect()
    machine, _ = queries.toxicity_machine(spark, folder)
    rows = [r for r in docs.collect() if toxicity.Scorer(machine).many([r.text])[0] < toxicity.THRESHOLD]
    assert 300 < len(rows) < docs.count()
    fps = {r.doc_id: simhash.fingerprint(r.text) for r in rows}
    label = {i: i for i in fps}
    for a in sorted(fps):
        for b in fps:
            if (fps[a] ^ fps[b]).bit_count() <= 3 and label[b] != label[a]:
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    kept = [r for r in rows if label[r.doc_id] == r.doc_id]
    field = pii.trained()
    texts = {r.doc_id: pii.masked(r.text, pii.find_all([r.text], field)[0]) if r.text else r.text for r in kept}
    clean = spark.createDataFrame([(i, t, next(r.source for r in kept if r.doc_id == i)) for i, t in texts.items()], "doc_id long, text string, source string")
    copies = {r.id: r.copies for r in mixing.mix(clean).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in texts.items():
        ids = [*(library.encode(t, add_special_tokens=False).ids if t else []), 0]
        for _ in range(copies[i]):
            want += [(i, s, min(1024, len(ids) - s), zlib.crc32(np.array(ids[s : s + 1024], "<u4").tobytes())) for s in range(0, len(ids), 1024)]
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    assert not any("someone@example.org" in (t or "") for t in texts.values())
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "pii", "mixing", "packing"]
    staged = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        staged = stage(spark, staged, folder)
        assert staged.columns == docs.columns, name


def test_all_ten_operators_have_a_query():
    numbers = sorted(int(n.split("_")[0][2:]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11))
