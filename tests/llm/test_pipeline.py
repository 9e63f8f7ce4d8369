"""The pipeline's stages on a small corpus: each works on what the one before it kept."""

import numpy as np

import corpus_pipeline
from tests.llm.test_operators import words
from tidegate.llm import shingle_dedup


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(3)
    toxic = rng.random(400) < 0.2
    texts = [words(120, i) + (" vilest" if t else "") for i, t in enumerate(toxic)]
    texts[200], toxic[200] = texts[0].upper(), toxic[0]
    clean = next(i for i in range(300, 400) if not toxic[i])
    texts[clean] += " password = hunter2222"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(t)) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["toxicity"](spark, docs, str(tmp_path)).cache()
    assert {r.doc_id for r in kept.collect()} == {i for i in range(400) if not toxic[i]}
    once = stage["near_duplicates"](spark, kept, str(tmp_path)).cache()
    assert {r.doc_id for r in kept.collect()} - {r.doc_id for r in once.collect()} <= {200}
    safe = stage["secrets"](spark, once, str(tmp_path)).cache()
    assert safe.count() == once.count() and safe.where(f"doc_id = {clean}").first().text.endswith(" [SECRET]")
    mixed = stage["mixture"](spark, safe, str(tmp_path))
    assert mixed.columns == docs.columns
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in mixed.select("doc_id").distinct().collect()}


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Null and empty texts, null sources and ids, repeated rows and columns of the operators' own names."""
    texts = [words(60, i) for i in range(30)] + [None, "", " \n ", words(60, 0), "password=hunter2222 " + words(60, 99), words(60, 5)]
    rows = [(None if i == 7 else i, t, None if i % 4 == 0 else "en", None if i % 3 == 0 else f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[2]], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[docs["n_chars"].alias(c) for c in ("_k1", "_copies", "row", "toxicity", "spans", "a.b")])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path)).cache()
        assert kept.columns == docs.columns
        got = kept.collect()
        if name == "near_duplicates":  # one of the three without words, one of each repeated text, by the smallest doc_id
            assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i == 7, 0 if i == 7 else i) for i in range(36) if i not in (31, 32, 33, 35))
        if name == "secrets":
            assert [r.text for r in got if r.doc_id == 34] == ["[SECRET] " + words(60, 99)]
    assert {r.text for r in got} <= {t for t in texts if t and t.strip()} | {"[SECRET] " + words(60, 99)}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in got}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def edited(text, share, seed):
    """``text`` with single words changed until the five-word Jaccard similarity is just above ``share``."""
    parts, same = text.split(), set(shingle_dedup.shingles(text).tolist())
    for k, at in enumerate(np.random.default_rng(seed).permutation(len(parts))):
        was, parts[at] = parts[at], f"new{seed}x{k}"
        now = set(shingle_dedup.shingles(" ".join(parts)).tolist())
        if len(same & now) < share * len(same | now):
            parts[at] = was
            break
    return " ".join(parts)


def test_near_copies_from_four_fifths_on_go(spark):
    texts = [words(150 + i, 1000 + i, 5000) for i in range(60)]
    copies = [edited(t, share, i) for i, t in enumerate(texts) for share in (0.8, 0.85, 0.9, 0.95)]
    apart = [edited(t, 0.6, 500 + i) for i, t in enumerate(texts[:20])]
    cloud = [edited(texts[0], 0.8 + 0.01 * (i % 15), 2000 + i) for i in range(80)]
    every = [*texts, *copies, *cloud, *apart, None, "", "two words", "Two  words"]
    sets = [set(shingle_dedup.shingles(t or "").tolist()) for t in every]
    root = list(range(len(every)))
    for i in range(len(every)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    docs = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string").repartition(3)
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert {r.doc_id for r in stage(spark, docs, "").collect()} == set(root)
    assert {r.doc_id for r in shingle_dedup.keep_one(docs, block=8).collect()} == set(root)


def test_no_pair_at_four_fifths_is_lost(spark):
    """4,000 pairs at 0.8 exactly, which share 80 of 100 shingles, and 20 more that share 78 of 100, which stay."""
    texts = []
    for i in range(4020):
        same, parts = 84 if i < 4000 else 82, words(94, 9000 + i, 1 << 40).split()
        texts += [" ".join(parts), " ".join(parts[:same] + [f"new{i}x{k}" for k in range(94 - same)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").select("doc_id").collect()}
    assert kept == set(range(0, 8000, 2)) | set(range(8000, 8040))


def test_fingerprints_are_simhash_and_meet_by_segments():
    cut, mask = shingle_dedup.segments_for(1000), (1 << 64) - 1
    s = shingle_dedup.shingles(words(300, 1))

    def mixed(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> shift)) * factor & mask
        return x ^ (x >> 31)

    got = shingle_dedup.fingerprint(s, cut.words)
    assert len(got) == 8 * cut.words and cut.width * cut.count <= 64 * cut.words
    for k in range(0, cut.words, 5):
        seen = [mixed(int(h) + (k + 1) * 0x9E3779B97F4A7C15 & mask).to_bytes(8, "little") for h in s]
        for byte in range(8):
            bits = [2 * sum(x[byte] >> (7 - b) & 1 for x in seen) > len(s) for b in range(8)]
            assert got[8 * k + byte] == int("".join("01"[b] for b in bits), 2)
    # Tables grow: wider segments, more of them, and a pair at 4/5 is as sure as before.
    for n in (0, 10**5, 10**7, 10**9):
        cut = shingle_dedup.segments_for(n)
        assert n >> cut.width < 1 << shingle_dedup.SPARE and (1 - (1 - shingle_dedup.DIFFER) ** cut.width) ** cut.count < 1.1e-4


def test_near_records_of_other_roots_are_candidates(monkeypatch):
    rng = np.random.default_rng(5)
    records = np.zeros(600, shingle_dedup._RECORD)
    records["value"] = np.sort(rng.integers(0, 12, 600))
    records["root"], records["node"] = rng.integers(0, 40, 600), np.arange(600)
    base = rng.integers(0, 1 << 64, (8, 2), dtype=np.uint64)
    records["check"] = base[rng.integers(0, 8, 600)] ^ (np.uint64(1) << rng.integers(0, 64, (600, 2), dtype=np.uint64))
    far = np.bitwise_count(records["check"][:, None] ^ records["check"][None]).sum(axis=2)
    near = (far <= shingle_dedup.NEAR) & (records["value"][:, None] == records["value"]) & (records["root"][:, None] != records["root"])
    assert 0 < near.any(axis=1).sum() < 601
    assert (shingle_dedup._met(records) == near.any(axis=1)).all()
    monkeypatch.setattr(shingle_dedup, "CROWD", 20)
    assert (shingle_dedup._met(records) == near.any(axis=1)).all()
    monkeypatch.setattr(shingle_dedup, "CROWD_LOOKS", 0)
    assert (shingle_dedup._met(records) >= near.any(axis=1)).all()


def test_a_cloud_below_four_fifths_is_not_compared_at_each_segment(spark, monkeypatch):
    """Texts that are near one another by two words of their fingerprints, not by all of it, bring few rows to compare; pairs at 4/5 among them are linked."""
    base = words(150, 1, 5000)
    texts = [edited(base, 0.74, i) for i in range(60)]
    texts += [edited(texts[0], 0.8, 900), *(" ".join(words(9, 70 + i).split()[:n]) for i in range(3) for n in (9, 8))]
    rows, materialize = [], shingle_dedup.materialize

    def counted(df, label="settled"):
        out = materialize(df, label)
        if label == "members":
            rows.append(out.count())
        return out

    monkeypatch.setattr(shingle_dedup, "materialize", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in shingle_dedup.keep_one(docs).select("doc_id").collect()}
    assert kept == {*range(60), 61, 63, 65}
    assert sum(rows) < 500  # by two words alone: thousands


def test_pairs_at_four_fifths_are_near_by_the_whole_fingerprint():
    cut, rng = shingle_dedup.segments_for(1000), np.random.default_rng(8)
    for size in (12, 13, 20, 22, 30, 40, 100, 300):
        for _ in range(10):
            s = rng.integers(0, 1 << 64, size + size // 4, dtype=np.uint64)
            cut_off = rng.integers(0, size // 4 + 1)
            a, b = (np.frombuffer(shingle_dedup.fingerprint(x, cut.words), "<u8") for x in (s[: size + cut_off], np.concatenate([s[:size], s[size + cut_off :]])))
            assert np.bitwise_count(a ^ b).sum() <= shingle_dedup.whole_near(cut.words)
