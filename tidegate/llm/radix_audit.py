"""How the words of sources differ, counted in mergeable radix tries.

Tasks count terms in byte tries whose leaves hold a counter for each source and the number
of documents.  A trie is written leaf by leaf in UTF-8 order; leaves are dealt out by ranges
of (language, term), where tries are merged by adding up equal leaves.  Walking the merged
tries in order gives each pair of sources its sum, and each source its candidates with ties
already in order.

Scale: a task's trie is written out and begun anew at ``TRIE_LEAVES`` leaves, a merging one
gives away all leaves it has passed, so neither grows with the corpus.  A frequent term has
one leaf from each task's trie, however many documents hold it.  Sources are handled
``CHUNK`` at a time on either side of a pair, so what tasks are told has a fixed size.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import bounded_batches, materialize, quoted, text_or_empty

#: A term's bytes, ASCII letters (here in lower case) and all of a character beyond ASCII; the others become blanks.
TERMS = bytes(c if c > 127 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_GAP = re.compile(rb"[^A-Za-z\x80-\xff]")
#: Bytes of a text that are cut into terms at once.
PIECE = 4 << 20
#: Documents of its language that a term must be in.
LEAST_DOCS = 3
#: Shares are counted in billionths.
UNIT = 1_000_000_000
#: Leaves of a trie in a task.
TRIE_LEAVES = 400_000
#: Counters (term, source) that a task gathers before they go to its trie.
GATHERED = 1_000_000
#: (language, source) groups of one side of the comparison that tasks are told at once.
CHUNK = 2_000
TOP = 200

_LEAF = "lang string, term binary, docs long, ids array<long>, counts array<long>"


class _Node:
    __slots__ = ("label", "kids", "docs", "counts")

    def __init__(self, label: bytes):
        self.label, self.kids, self.docs, self.counts = label, None, 0, None


class RadixTrie:
    """A byte trie with compressed edges; its leaves hold counters by source and a number of documents.

    ``path`` has the nodes that led to the last leaf, with what they stand for: terms that
    come in order are not looked up from the root.
    """

    def __init__(self) -> None:
        self.root, self.leaves = _Node(b""), 0
        self.path = [(b"", self.root)]

    def leaf(self, term: bytes) -> _Node:
        path, n = self.path, len(term)
        while not term.startswith(path[-1][0]):
            path.pop()
        before, node = path[-1]
        i = len(before)
        while i < n:
            kid = node.kids.get(term[i]) if node.kids else None
            if kid is None:
                kid = _Node(term[i:])
                if node.kids is None:
                    node.kids = {}
                node.kids[term[i]] = kid
                node, i = kid, n
            elif term.startswith(kid.label, i):
                node, i = kid, i + len(kid.label)
            else:  # the edge splits where they part
                k, most = 1, min(len(kid.label), n - i)
                while k < most and kid.label[k] == term[i + k]:
                    k += 1
                fork = _Node(kid.label[:k])
                fork.kids, kid.label = {kid.label[k]: kid}, kid.label[k:]
                node.kids[term[i]], node, i = fork, fork, i + k
            path.append((term[:i], node))
        if node.counts is None:
            node.counts = {}
            self.leaves += 1
        return node

    def add(self, term: bytes, docs: int, counts: dict[int, int]) -> None:
        """Adds a leaf of another trie."""
        node = self.leaf(term)
        node.docs += docs
        own = node.counts
        for k, n in counts.items():
            own[k] = own.get(k, 0) + n

    def walk(self) -> Iterator[tuple[bytes, int, dict[int, int]]]:
        """(term, documents, counters) in byte order, which is the order of UTF-8 strings."""
        above = [(b"", self.root)]
        while above:
            before, node = above.pop()
            term = before + node.label
            if node.counts is not None:
                yield term, node.docs, node.counts
            if kids := node.kids:
                above.extend([(term, kids[k]) for k in sorted(kids, reverse=True)] if len(kids) > 1 else [(term, kid) for kid in kids.values()])


def _uncollected(f):
    """``f`` without the search for cycles, which tries have none of and which walks every node again and again."""

    def run(batches: Iterator) -> Iterator:
        import gc

        gc.disable()
        try:
            yield from f(batches)
        finally:
            gc.enable()

    return run


def _batch(langs: list[str], terms: list[bytes], docs: list[int], counts: list[dict]):
    """Leaves as an Arrow batch."""
    import numpy as np
    import pyarrow as pa

    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(list(map(len, counts)), out=ends[1:])
    lists = lambda values: pa.ListArray.from_arrays(ends, pa.array(np.fromiter(values, np.int64, ends[-1])))
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), pa.array(terms, pa.binary()), pa.array(docs, pa.int64()), lists(chain.from_iterable(counts)), lists(chain.from_iterable(map(dict.values, counts)))],
        names=["lang", "term", "docs", "ids", "counts"],
    )


def _written(tries: dict[str, RadixTrie], size: int = 20_000) -> Iterator:
    columns: tuple[list, ...] = ([], [], [], [])
    langs, terms, docs, counts = columns
    for lang in sorted(tries, key=str.encode):
        for term, n, own in tries[lang].walk():
            langs.append(lang)
            terms.append(term)
            docs.append(n)
            counts.append(own)
            if len(terms) >= size:
                yield _batch(*columns)
                for c in columns:
                    c.clear()
    if terms:
        yield _batch(*columns)


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces that end where no term goes on."""
    at = 0
    while len(text) - at > PIECE:
        gap = _GAP.search(text, at + PIECE)
        if gap is None:
            break
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


def _count(batches: Iterator) -> Iterator:
    """Tries of (lang, source id, text) rows."""
    tries: dict[str, RadixTrie] = defaultdict(RadixTrie)
    counts: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[str, Counter] = defaultdict(Counter)

    def gather() -> None:
        cells: dict[str, dict[bytes, dict]] = defaultdict(dict)
        for (lang, source), own in counts.items():
            found = cells[lang]
            for term, n in own.items():
                if term in found:
                    found[term][source] = n
                else:
                    found[term] = {source: n}
        for lang, found in cells.items():
            leaf, own = tries[lang].leaf, docs[lang]
            for term in sorted(found):
                node = leaf(term)
                node.docs += own[term]
                if at := node.counts:
                    for source, n in found[term].items():
                        at[source] = at[source] + n if source in at else n
                else:
                    node.counts = found[term]
        counts.clear()
        docs.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch[k].to_pylist() for k in range(3)), strict=True):
            seen: set[bytes] = set()
            for piece in _pieces(text):
                terms = piece.translate(TERMS).split()
                counts[lang, source].update(terms)
                seen.update(terms)
            docs[lang].update(seen)
        if sum(map(len, counts.values())) >= GATHERED:
            gather()
        if sum(t.leaves for t in tries.values()) >= TRIE_LEAVES:
            yield from _written(tries)
            tries.clear()
    gather()
    yield from _written(tries)


def _ends(batch):
    """Where each row's counters begin and end."""
    offsets = batch["ids"].offsets.to_numpy()
    return offsets - offsets[0]


def _runs(batch) -> tuple[list[int], list[int]]:
    """(first rows of the runs of one (lang, term), documents of each run)."""
    import numpy as np
    import pyarrow.compute as pc

    n = batch.num_rows
    if n < 2:
        return list(range(n)), batch["docs"].to_pylist()
    new = pc.or_(*[pc.not_equal(batch[c].slice(1), batch[c].slice(0, n - 1)) for c in ("lang", "term")]).to_numpy(zero_copy_only=False)
    first = np.concatenate([[0], np.flatnonzero(new) + 1])
    return first.tolist(), np.add.reduceat(batch["docs"].to_numpy(), first).tolist()


def _merge(batches: Iterator) -> Iterator:
    """Leaves in order of (lang, term), those of a term as one."""
    import pyarrow as pa

    tries: dict[str, RadixTrie] = defaultdict(RadixTrie)
    last = None

    def passed() -> Iterator:
        """All leaves but the last term's, which the next batch may go on with."""
        kept = RadixTrie()
        lang, term = last
        node = tries[lang].leaf(term)
        kept.add(term, node.docs, node.counts)
        node.counts = None
        yield from _written(tries)
        tries.clear()
        tries[lang] = kept

    for batch in batches:
        ends = _ends(batch)
        ids, counts = batch["ids"].flatten().to_pylist(), batch["counts"].flatten().to_pylist()
        first, docs = _runs(batch)
        langs, terms = (batch[c].take(pa.array(first, pa.int64())).to_pylist() for c in ("lang", "term"))
        edges = ends[[*first, batch.num_rows]].tolist()
        for lang, term, n, a, b in zip(langs, terms, docs, edges, edges[1:], strict=False):
            node = tries[lang].leaf(term)
            node.docs += n
            own = node.counts
            if b - a == 1 and not own:
                own[ids[a]] = counts[a]
                continue
            for k, count in zip(ids[a:b], counts[a:b], strict=True):
                own[k] = own[k] + count if k in own else count
        if langs:
            last = (langs[-1], terms[-1])
        if sum(t.leaves for t in tries.values()) >= TRIE_LEAVES // 4:
            yield from passed()
    yield from _written(tries)


def count_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, docs, ids, counts): terms in ``least_docs`` documents of their language, with counts by source id.

    docs: (lang, source, text) without nulls.  Rows are in ranges of (lang, term), in order.
    """
    told = bounded_batches(docs).select("lang", F.xxhash64("source").alias("id"), F.col("text").cast("binary").alias("text"))
    tries = materialize(told.mapInArrow(_uncollected(_count), _LEAF), "tries")
    by = ("lang", "term")
    return materialize(tries.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_uncollected(_merge), _LEAF).where(F.col("docs") >= least_docs), "terms")


def share(count, total):
    """1 + floor(UNIT * (count + 1) / total) of 64-bit integers, without a product beyond them."""
    whole, rest = (count + 1) // total, (count + 1) % total
    for _ in range(3):
        rest = rest * 1000
        whole, rest = whole * 1000 + rest // total, rest % total
    return 1 + whole


def groups_of(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, id, n, n_lang, n_terms) of every occurring group: sums over its own and its language's kept terms."""
    each = terms.select("lang", F.explode(F.arrays_zip("ids", "counts")).alias("c")).groupBy("lang", F.col("c.ids").alias("id")).agg(F.sum("c.counts").alias("n"))
    langs = terms.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n_lang"), F.count(F.lit(1)).alias("n_terms"))
    known = docs.select("lang", "source").distinct().withColumn("id", F.xxhash64("source"))
    none = F.lit(0).cast("long")
    found = known.join(each, ["lang", "id"], "left").join(langs, "lang", "left")
    return found.select("lang", "source", "id", *[F.coalesce(c, none).alias(c) for c in ("n", "n_lang", "n_terms")])


def _compare(mine: list[tuple], others: list[tuple], with_terms: bool, top: int):
    """What a task does with ranges of terms: (lang, id, other, term, value) sums and candidates.

    mine, others: (lang, id, n, n_lang, n_terms) of the groups compared.
    """
    import numpy as np
    import pyarrow as pa

    alike = mine is others

    def told(groups: list[tuple]) -> dict:
        out: dict[str, list] = defaultdict(list)
        for lang, *rest in groups:
            out[lang].append(rest)
        return {lang: np.array(sorted(rows), np.int64).T for lang, rows in out.items()}

    def spread(ids, counts, rows, n_rows, known):
        """Counts as a matrix of terms by groups."""
        out = np.zeros((n_rows, len(known)), np.int64)
        at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
        hit = known[at] == ids
        out[rows[hit], at[hit]] = counts[hit]
        return out

    def run(batches: Iterator) -> Iterator:
        left = told(mine)
        right = left if alike else told(others)
        sums = {lang: np.zeros((a.shape[1], right[lang].shape[1]), np.int64) for lang, a in left.items() if lang in right}
        names = ("lang", "id", "other", "term", "value")
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
        batch_of = lambda *cols: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        def block(lang: str, terms, ids, counts, rows) -> Iterator:
            a, b = left[lang], right.get(lang)
            have = spread(ids, counts, rows, len(terms), a[0])
            p = share(have, (a[1] + a[3])[None, :])
            if b is not None:
                q = p if b is a else share(spread(ids, counts, rows, len(terms), b[0]), (b[1] + b[3])[None, :])
                for k in range(p.shape[1]):
                    far = p[:, k : k + 1] - q
                    sums[lang][k] += (far * far // q).sum(axis=0)
            if with_terms:
                whole = np.zeros(len(terms), np.int64)
                np.add.at(whole, rows, counts)
                q = share(whole, a[2, 0] + a[3, 0])
                for k in range(p.shape[1]):
                    on = np.flatnonzero((have[:, k] > 0) & (p[:, k] > q))
                    far = p[on, k] - q[on]
                    value = far * far // q[on]
                    best = np.argsort(-value, kind="stable")[:top]  # terms are in order, so ties stay in theirs
                    if len(best):
                        yield batch_of([lang] * len(best), np.full(len(best), a[0, k]), [None] * len(best), [terms[i] for i in on[best]], value[best])

        for batch in batches:
            langs, terms = np.array(batch["lang"].to_pylist(), object), batch["term"].to_pylist()
            ends = _ends(batch)
            ids, counts = (batch[k].flatten().to_numpy() for k in ("ids", "counts"))
            starts = [0, *(np.flatnonzero(langs[1:] != langs[:-1]) + 1).tolist(), len(terms)] if len(terms) else [0]
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                if langs[s] not in left:
                    continue
                width = left[langs[s]].shape[1] + (right[langs[s]].shape[1] if langs[s] in right else 0)
                step = max(1, 2_000_000 // width)
                for i in range(s, e, step):
                    j = min(e, i + step)
                    rows = np.repeat(np.arange(j - i), np.diff(ends[i : j + 1]))
                    yield from block(langs[s], terms[i:j], ids[ends[i] : ends[j]], counts[ends[i] : ends[j]], rows)
        for lang, found in sums.items():
            a, b = left[lang][0], right[lang][0]
            for k, row in enumerate(found):
                on = np.flatnonzero((row != 0) & (b != a[k]))
                if len(on):
                    yield batch_of([lang] * len(on), np.full(len(on), a[k]), b[on], [None] * len(on), row[on])

    return run


def _chunks(groups: DataFrame) -> list[list[tuple]]:
    """The groups that have kept terms, about CHUNK at a time."""
    some = groups.where("n_terms > 0")
    n = max(1, -(-some.count() // CHUNK))
    cols = ("lang", "id", "n", "n_lang", "n_terms")
    return [[tuple(r) for r in some.where(F.pmod(F.xxhash64("lang", "id"), F.lit(n)) == k).select(*cols).collect()] for k in range(n)]


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far a source's terms are from its language's other sources.

    A term is a run of ASCII letters and characters beyond ASCII, A-Z lower-cased; a
    language keeps the terms in ``least_docs`` of its documents.  p of a group and a term is
    1 + floor(10^9 (count + 1) / (N + V)), and f = floor((p - q)^2 / q).  ``pair``: for each
    other source of the language, f over all kept terms, summed.  ``term``: the group's
    terms that are more frequent than in the language, the ``top`` largest f.  Ranks are by
    value, then by item in UTF-8 order.

    Null text, lang and source count as ''; repeated rows count each; a group without terms
    has pairs; of a language without kept terms all pairs are 0; an empty table gives none;
    other columns count for nothing.
    """
    plain = docs.select(*[text_or_empty(docs[quoted(c)]).alias(c) for c in ("lang", "source", "text")])
    terms = count_terms(plain, least_docs)
    groups = materialize(groups_of(plain, terms), "groups")
    kind = "lang string, id long, other long, term binary, value long"
    chunks = _chunks(groups)
    jobs = [terms.mapInArrow(_compare(a, b, a is b, top), kind) for a in chunks for b in chunks]
    found = materialize(reduce(DataFrame.unionByName, jobs), "divergences")
    own = groups.select("lang", "id", "source")
    other = groups.select("lang", F.col("id").alias("other"), F.col("source").alias("item"))
    sums = found.where("other IS NOT NULL").groupBy("lang", "id", "other").agg(F.sum("value").alias("value"))
    # Every pair of a language has a row, also one whose sum is 0.
    pairs = own.join(other, "lang").where("id <> other").join(sums, ["lang", "id", "other"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    best = found.where("other IS NULL").join(own, ["lang", "id"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(best).where(F.col("rank") <= top))
