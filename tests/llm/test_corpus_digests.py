"""Merkle manifest, suffix-array repeats and source divergence against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tests.llm.test_operators import ODD, empty, table, words
from tidegate.llm import merkle, radix_audit, suffix_dedup
from tidegate.llm.suffix_arrays import common_prefixes, suffix_array

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, r long, uid string"


def documents(spark, rows):
    """(doc_id, text, lang, source) rows beside columns whose names the operators use too."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "x", 7, "y") for i, t, lang, s in rows], DOCS)


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# 11


def h(*values):
    return hashlib.sha256("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in values).encode()).hexdigest()


def joined(nodes):
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([joined(out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def manifest(rows, fanout=16):
    """Sorted (doc_id, leaf, subroot, root, proof, folded root, verified)."""
    by, out = defaultdict(list), []
    for i, t, lang, s in rows:
        by[s].append((i, s, lang, None if t is None else len(t), t))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, h(*r)))
    trees = {s: levels([h(*r) for r in by[s]], fanout) for s in order}
    top = levels([trees[s][-1][0] for s in order], fanout)
    root = top[-1][0]
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            path = []
            for tree, j in ((trees[s], i), (top, k)):
                for level in tree[:-1]:
                    path.append((j % fanout, level[j // fanout * fanout :][:fanout]))
                    j //= fanout
            struck = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            got = h(*r[:4], low(r[4])) if struck else h(*r)
            for j, run in path:
                got = joined([*run[:j], got, *run[j + 1 :]])
            out.append((r[0], h(*r), trees[s][-1][0], root, joined(x for j, run in path for n, x in enumerate(run) if n != j), got, got == root))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def odd_rows():
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate([*ODD, "Upper Case Words"] * 30)]
    rows += [(5000, "ALONE", "en", "lone"), (None, None, None, None), (None, "x", "en", None), (7, "Ab", "en", "ü"), (7, "Ab", "en", "ü"), (7, "Ac", "de", "ü")]
    return rows + [(10_000 + i, f"One of many {i}", "en", "hot") for i in range(300)]


@pytest.mark.parametrize("n", [1, 16, 17, 600])
def test_manifest(spark, n):
    rows = odd_rows()[-n:]
    got = merkle.check(documents(spark, rows)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == manifest(rows)
    if n == 600:
        assert 0 < sum(not r.verified for r in got) < len(got) / 4


def test_manifest_of_many_sources_and_a_narrow_tree(spark):
    rows = [(i, f"T{i}", "en", f"s{i % 40}") for i in range(130)]
    docs = documents(spark, rows)
    fields = [docs[c] for c in ("doc_id", "source", "lang", "n_chars", "text")]
    made = merkle.build(docs, "source", "doc_id", merkle.digest(*fields), fanout=2)
    got = {r.key: r for r in merkle.proofs(made, fanout=2).collect()}
    want = {r[0]: r for r in manifest(rows, 2)}
    assert len(made.levels) >= 1 and len(made.sources) == 6
    assert all((got[i].subroot, got[i].root, got[i].proof_sha256) == want[i][2:5] and got[i].verified for i in want)
    assert all(merkle.folded(r.leaf, r.path) == made.root and merkle.folded("0" * 64, r.path) != made.root for r in got.values())


def test_manifest_of_nothing(spark):
    assert merkle.check(empty(spark)).count() == 0
    assert merkle.check(table(spark, [None])).first().verified


# 12


@pytest.mark.parametrize("symbols", [1, 2, 4, 200])
def test_suffix_array(symbols):
    rng = np.random.default_rng(symbols)
    for trial in range(60):
        text = rng.integers(0, symbols, rng.integers(0, 130)).astype(np.uint8)
        if trial % 3 == 0 and len(text):
            text = np.tile(text[: 1 + len(text) // 7], 8)
        data = text.tobytes()
        want = sorted(range(len(data)), key=lambda i: data[i:])
        order = suffix_array(text)
        assert order.tolist() == want
        shared = [0] * len(data)
        for a, b in zip(want, want[1:], strict=False):
            while max(a, b) + shared[b] < len(data) and data[a + shared[b]] == data[b + shared[b]]:
                shared[b] += 1
        assert common_prefixes(text, order).tolist() == shared


def repeats(texts, length):
    """(n_bytes, spans, kept bytes) of each text, by a table of all windows."""
    data = [(t or "").encode() for t in texts]
    times = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        spans = []
        for i in range(len(d) - length + 1):
            if times[d[i : i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        edges = [0, *(x for s in spans for x in s), len(d)]
        out.append((len(d), spans, b"".join(d[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))))
    return out


def repeating_texts():
    rng = np.random.default_rng(7)
    passage, near = words(30, 1), [*words(40, 2)]
    texts = [*ODD, "a" * 300, "a" * 299 + "b", "ab" * 200, "é" * 90, passage, passage + "x"]
    for i in range(40):
        copy = near.copy()
        copy[int(rng.integers(0, len(near)))] = "#"
        texts += [words(10 + i % 5, 100 + i) + " " + passage + " " + words(8, 200 + i), "".join(copy), words(20, 300 + i % 30)]
    return texts + [words(25, 500)] * 5 + [words(9, 600) + words(9, 600)]


#: As in production, each context crowded, texts cut into short pieces, and a shard a context.
SIZES = [{}, {"mark_bytes": 1}, {"piece": 150}, {"shard_bytes": 500, "mark_bytes": 3000}]


@pytest.mark.parametrize("sizes", SIZES, ids=["plain", "crowded", "pieces", "shards"])
def test_repeats(spark, sizes, monkeypatch):
    if "piece" in sizes:
        monkeypatch.setattr(suffix_dedup, "RUN", 5)
    texts = repeating_texts()
    docs = documents(spark, [(i if i else None, t, "en", "s") for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in suffix_dedup.digest(docs, length=60, gram=16, **sizes).collect()}
    for i, (n, spans, kept) in enumerate(repeats(texts, 60)):
        want = (n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())
        r = got[i if i else None]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want, i


def test_repeats_in_the_table(spark):
    texts = repeating_texts()
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).withColumn("kept", F.lit("own"))
    got = {r.doc_id: r for r in suffix_dedup.without_repeats(docs, length=60, gram=16).collect()}
    for i, (_, spans, kept) in enumerate(repeats(texts, 60)):
        assert [[s.start, s.end] for s in got[i].removed] == spans and bytes(got[i].kept_) == kept and (got[i].kept, got[i].text) == ("own", texts[i])


def test_repeats_of_production_length_and_of_nothing(spark):
    page = words(90, 1)
    texts = [page[:399], page[:400] + "!", "?" + page[:400], page[1:400] + "&", None, words(3000, 5), page[:400]]
    got = sorted(tuple(r) for r in suffix_dedup.digest(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect())
    assert [(r[0], r[2], r[3]) for r in got] == [(0, 0, 0), (1, 400, 1), (2, 400, 1), (3, 0, 0), (4, 0, 0), (5, 0, 0), (6, 400, 1)]
    assert got[1][4] == hashlib.sha256(b"!").hexdigest() and got[6][4] == hashlib.sha256(b"").hexdigest()
    assert suffix_dedup.digest(empty(spark)).count() == 0


# 13

TERM = regex.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def divergence(rows, least=3, top=200):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        terms = TERM.findall(low(text or ""))
        groups.add((lang or "", source or ""))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = {s: counts[a, s] for a, s in groups if a == lang}
        share = lambda c, n, v=len(kept): 1 + 10**9 * (c + 1) // (n + v)
        n = {s: sum(c[t] for t in kept) for s, c in own.items()}
        p = {s: {t: share(own[s][t], n[s]) for t in kept} for s in own}
        q = {t: share(sum(c[t] for c in own.values()), sum(n.values())) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in own:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in own if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if own[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, x.decode(), -v, k) for part, rows in (("pair", pairs), ("term", terms)) for k, (v, x) in enumerate(rows, 1)]
    return sorted(out)


def plain(df):
    return sorted(tuple(r) for r in df.collect())


def mixed(n=200):
    out = []
    for i in range(n):
        out.append((words(60 + i % 50, i) + (" Ünï中 ÜNï" if i % 3 else " straße"), ("en", "de", None)[i % 3], ("hot", "hot", "a", None, f"s{i % 5}")[i % 5]))
    return out + [(None, "en", "none"), ("", "fr", "x"), ("once only", "fr", "y"), ("1234 --", "it", None), *[("Same words here", "en", "hot")] * 5]


def test_divergence(spark, monkeypatch):
    rows = [(t, a, b) for t, a, b in mixed()] + [(t, "en", "odd") for t in ODD]
    # Letters only, so that many terms differ by the digits the generator uses for its words.
    spell = lambda t: None if t is None else t.translate(str.maketrans("0123456789", "abcdefghij"))
    rows = [(spell(t), a, b) for t, a, b in rows]
    docs = documents(spark, [(i, *r) for i, r in enumerate(rows)])
    want = divergence(rows)
    assert plain(radix_audit.audit(docs)) == want
    assert any(r[2] == "pair" and r[4] == 0 and r[0] == "fr" for r in want) and max(r[5] for r in want if r[2] == "term") == 200
    # Small tries, groups a few at a time and texts cut into pieces give the same.
    for name, value in (("TRIE_LEAVES", 60), ("GATHERED", 50), ("CHUNK", 4), ("PIECE", 9)):
        monkeypatch.setattr(radix_audit, name, value)
    assert plain(radix_audit.audit(docs)) == want


def test_divergence_of_nothing(spark):
    assert radix_audit.audit(empty(spark)).count() == 0


def test_radix_trie():
    rng = np.random.default_rng(1)
    tries, want = [radix_audit.RadixTrie() for _ in range(3)], defaultdict(Counter)
    for k in range(3000):
        term, source = bytes(rng.integers(97, 100, rng.integers(1, 7)).tolist()), int(rng.integers(0, 4))
        tries[k % 3].add(term, 1, {source: k})
        want[term][source] += k
    whole = radix_audit.RadixTrie()
    for trie in tries:
        for leaf in trie.walk():
            whole.add(*leaf)
    got = list(whole.walk())
    assert [t for t, _, _ in got] == sorted(want) and whole.leaves == len(want) and sum(d for _, d, _ in got) == 3000
    assert all(c == dict(want[t]) for t, _, c in got)


def test_shares():
    for total in (7, 10**9 + 7, 4 * 10**12):
        counts = [c for c in (0, 1, 6, 10**6, 10**9, 3 * 10**12) if c < total]
        got = radix_audit.share(np.array(counts), np.array([total] * len(counts)))
        assert got.tolist() == [1 + 10**9 * (c + 1) // total for c in counts]


def test_terms_in_order_go_on_from_the_last_leaf():
    terms = sorted({f"{a}{b}".encode() for a in ("", "s", "stem", "stern", "é") for b in range(60)})
    ordered, mixed = radix_audit.RadixTrie(), radix_audit.RadixTrie()
    for k, term in enumerate(terms):
        ordered.add(term, 1, {k: 2})
        assert ordered.path[-1] == (term, ordered.leaf(term))
    for k in np.random.default_rng(1).permutation(len(terms)).tolist():
        mixed.add(terms[k], 1, {k: 2})
    assert list(ordered.walk()) == list(mixed.walk()) == [(t, 1, {k: 2}) for k, t in enumerate(terms)]


def test_bytes_are_cut_into_terms_as_the_contract_says():
    """Every byte beside every kind of byte, and blanks beyond ASCII, which are parts of terms."""
    text = bytes(c for a in range(256) for b in b"aZ\x85\xa0 [" for c in (a, b)) + "A b\u0085C　d E".encode()
    assert text.translate(radix_audit.TERMS).split() == [t.lower() for t in re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
