"""Language-model scoring by cross-entropy difference (after Moore and Lewis, 2010).

Two bigram models of one shared vocabulary and one smoothing, one of target texts and one
of background texts.  A document's score is its mean loss under the target less its mean
loss under the background: the lower, the more the document is like the target.

The models hold every word and every bigram, as 64-bit hashes, and stay distributed: each
batch of texts sends its bigrams to buckets by their word, a bucket counts what all batches
sent and returns the losses of each batch's documents.  A word too frequent for one bucket
is dealt by bigram, with its count known beforehand; the few bigrams as frequent as that are
counted beforehand and scored where the texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidegate.llm.common import bounded_batches, materialize, text_or_empty

#: Pseudo-count of the unigram estimate in a bigram estimate, and of the pooled one in that.
PRIOR_UNIGRAM, PRIOR_POOLED = 1.0, 1.0
#: Bytes of text for each bucket, and the part of a bucket that one word or bigram may be before it is dealt apart.
BUCKET_BYTES, HEAVY_PART = 48 << 20, 1 / 16
#: Tokens of a bucket's bytes that are sampled for frequent ones, and the bytes a token is taken to have for that.
SAMPLES, TOKEN_BYTES = 6400, 6
#: Hashes of a text's end, which is predicted like a word, and of its start.
_END, _START = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def tokens(texts):
    """(hash of each distinct word, word numbers of all texts, words of each text) of an Arrow array of strings.

    Words are runs of anything but the six ASCII gaps, lower-cased letter by letter.  A text
    that has words is followed by its end; the last two numbers are the end and the start.
    """
    import numpy as np
    import pyarrow.compute as pc
    import xxhash

    cut = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    coded = cut.flatten().dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    number = coded.indices.to_numpy()
    sizes = pc.list_value_length(cut).to_numpy().astype(np.int64)
    if "" in words:  # beside a leading or trailing gap
        real = number != words.index("")
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[real], minlength=len(sizes))
        number = number[real]
    some = np.flatnonzero(sizes)
    number = np.insert(number.astype(np.int64), np.cumsum(sizes)[some], len(words))
    hashes = np.array([*map(xxhash.xxh3_64_intdigest, words), _END, _START], dtype=np.uint64)
    return hashes, number, sizes


def _pairs(hashes, number, sizes) -> tuple:
    """(text, number of the word before, bigram's hash) of each token."""
    import numpy as np

    spans = np.where(sizes > 0, sizes + 1, 0)
    before = np.empty(len(number), np.int64)
    before[1:] = number[:-1]
    ends = np.cumsum(spans)
    before[(ends - spans)[spans > 0]] = len(hashes) - 1
    x = hashes[before] * np.uint64(0xD6E8FEB86659FD93) + hashes[number]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    return np.repeat(np.arange(len(sizes)), spans), before, x ^ (x >> np.uint64(32))


def _place(keys, asked):
    """(place in sorted ``keys``, whether it is there) of each asked key."""
    import numpy as np

    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.searchsorted(keys, asked).clip(0, len(keys) - 1)
    return at, keys[at] == asked


def _candidates(texts: DataFrame, share: float, rate: float) -> DataFrame:
    """(kind, key) of words (0) and bigrams (1) that are at least half of ``share`` in a random sample of tokens: at most 2/share of each.

    The sample is the same if a batch is read again.  Something as frequent as ``share`` has
    about SAMPLES * HEAVY_PART sampled tokens, so that it falls below half of them practically
    never; if it did, its bucket would be larger and the losses the same.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for turn, b in enumerate(batches):
            hashes, number, sizes = tokens(b.column("text"))
            _, _, bigram = _pairs(hashes, number, sizes)
            drawn = np.flatnonzero(np.random.default_rng([part, turn]).random(len(number)) < rate)
            for kind, keys in ((0, hashes[number[drawn]]), (1, bigram[drawn]), (2, np.zeros(len(drawn), np.uint64))):
                found, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), kind), pa.int32()), pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])

    counts = materialize(texts.select("text").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "sample")
    total = counts.where("kind = 2").agg(F.sum("n")).first()[0] or 0
    return counts.where((F.col("kind") < 2) & (F.col("n") >= F.lit(share / 2 * total))).select("kind", "key")


def _counted(texts: DataFrame, asked: dict) -> DataFrame:
    """(kind, key, n0, n1): counts on either side of the asked words (0) and bigrams (1); kinds 2 and 3 are all tokens and all texts."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        sums = {k: np.zeros((len(keys), 2), np.int64) for k, keys in asked.items()}
        total, n_texts = np.zeros(2, np.int64), np.zeros(2, np.int64)
        for b in batches:
            for side in (0, 1):
                part = b.filter(pc.equal(b.column("side"), side))
                if not len(part):
                    continue
                hashes, number, sizes = tokens(part.column("text"))
                total[side] += len(number)
                n_texts[side] += np.count_nonzero(sizes)
                at, known = _place(asked[0], hashes)
                sums[0][at[known], side] += np.bincount(number, minlength=len(hashes))[known]
                if len(asked[1]):
                    often = known.copy()
                    often[-1] = True
                    _, before, bigram = _pairs(hashes, number, sizes)
                    at, known = _place(asked[1], bigram[often[number] & often[before]])
                    sums[1][:, side] += np.bincount(at[known], minlength=len(asked[1]))
        rows = [(k, keys, sums[k]) for k, keys in asked.items()] + [(2, np.zeros(1, np.uint64), total[None]), (3, np.zeros(1, np.uint64), n_texts[None])]
        for kind, keys, n in rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind), pa.int32()), pa.array(keys.view(np.int64)), pa.array(n[:, 0].copy()), pa.array(n[:, 1].copy())], names=["kind", "key", "n0", "n1"])

    counts = texts.select("side", "text").mapInArrow(run, "kind int, key long, n0 long, n1 long")
    return counts.groupBy("kind", "key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _known_beforehand(texts: DataFrame, share: float, rate: float) -> dict:
    """Totals and the counts of what is too frequent for one bucket: at most 1/share words and as many bigrams, of at most twice as many candidates."""
    import numpy as np

    asked = {0: [], 1: []}
    if share < 1:
        for r in _candidates(texts, share, rate).collect():
            asked[r["kind"]].append(r["key"] % 2**64)
    asked = {k: np.array(sorted(v), dtype=np.uint64) for k, v in asked.items()}
    counts = _counted(texts, asked)
    totals = {r["kind"]: (r["n0"], r["n1"]) for r in counts.where("kind > 1").collect()}
    found = {"total": np.array(totals.get(2, (0, 0)), float), "texts": np.array(totals.get(3, (0, 0)), float)}
    least = share * found["total"].sum()
    kept = sorted((r["kind"], r["key"] % 2**64, r["n0"], r["n1"]) for r in counts.where((F.col("kind") < 2) & (F.col("n0") + F.col("n1") >= F.lit(least))).collect())
    for kind, name in ((0, "words"), (1, "bigrams")):
        found[name] = np.array([k[1] for k in kept if k[0] == kind], dtype=np.uint64), np.array([k[2:] for k in kept if k[0] == kind], dtype=float).reshape(-1, 2)
    return found


def _loss(bigrams, words, total):
    """Losses of tokens, both sides, but for the count of what stands before: from counts of the bigram and of the word."""
    import numpy as np

    pooled = np.maximum(words.sum(1, keepdims=True), 1) / (total.sum() + 1)
    unigram = (words + PRIOR_POOLED * pooled) / (total + PRIOR_POOLED)
    return -np.log(bigrams + PRIOR_UNIGRAM * unigram)


def _by_text(text, values, n: int):
    import numpy as np

    return np.stack([np.bincount(text, weights=values[:, k], minlength=n) for k in (0, 1)], axis=1)


_BYTES = ("words", "spread", "codes", "docs", "sizes", "places")


def _cells(texts: DataFrame, known, buckets: int) -> DataFrame:
    """One row for each batch, role and bucket: the bucket's words, bigrams and documents; and one with the documents' ids.

    words, spread: hashes, and how many of ``codes`` (bigram hashes) each has.  docs, sizes,
    places: documents, how many tokens each has here, and each token's place in ``codes``;
    of texts that aren't scored, places are counts of the codes.
    """
    key = texts.schema["id"].dataType
    schema = T.StructType([
        T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.LongType()), T.StructField("side", T.IntegerType()), T.StructField("scored", T.BooleanType()),
        *[T.StructField(c, T.BinaryType()) for c in _BYTES], T.StructField("ids", T.ArrayType(key)),
    ])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        hot, hot_n = known.value["words"]
        heavy, heavy_n = known.value["bigrams"]
        total = known.value["total"]
        turn = TaskContext.get().partitionId() << 32
        for b in batches:
            for side, scored in ((0, True), (0, False), (1, False), (-1, True)):
                mine = pc.and_(pc.equal(b.column("side"), side), pc.equal(b.column("scored"), scored))
                part = b.filter(mine)
                if not len(part):
                    continue
                turn += 1
                hashes, number, sizes = tokens(part.column("text"))
                text, before, bigram = _pairs(hashes, number, sizes)
                hot_at, is_hot = _place(hot, hashes)
                out: list[list] = [[] for _ in kinds]

                def tell(row, out=out):
                    for c, v in zip(out, row, strict=True):
                        c.append(v)

                here = np.zeros(len(number), bool)
                both = np.flatnonzero(is_hot[number]) if len(heavy) else np.empty(0, int)
                at, found = _place(heavy, bigram[both])
                here[both[found]] = True
                if scored:
                    sums = np.zeros((len(sizes), 2))
                    if found.any():
                        own = both[found]
                        sums += _by_text(text[own], _loss(heavy_n[at[found]], hot_n[hot_at[number[own]]], total), len(sizes))
                    own = np.flatnonzero(is_hot[number] & (number < len(hashes) - 2))
                    if len(own):
                        sums += _by_text(text[own], np.log(hot_n + PRIOR_UNIGRAM)[hot_at[number[own]]], len(sizes))
                    ids = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column("id"))
                    tell((turn % buckets, turn, side, True, None, None, None, sizes.astype("<u4").tobytes(), sums.tobytes(), None, ids[0]))
                # Distinct bigrams by bucket, word and hash.
                left = np.flatnonzero(~here)
                codes, first, place = np.unique(bigram[left], return_index=True, return_inverse=True)
                word = number[left[first]]
                bucket = (np.where(is_hot[word], codes, hashes[word]) >> np.uint64(7)) % np.uint64(buckets)
                order = np.lexsort((word, bucket))
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                codes, word, bucket, place = codes[order], word[order], bucket[order].astype(np.int64), rank[place]
                ends = np.searchsorted(bucket, np.arange(buckets + 1))
                of = bucket[place]
                dealt = np.argsort(of.astype(np.min_scalar_type(buckets)), kind="stable")
                cuts = np.searchsorted(of[dealt], np.arange(buckets + 1))
                for k in np.flatnonzero(np.diff(ends)).tolist():
                    lo, hi = ends[k], ends[k + 1]
                    turns = np.flatnonzero(np.diff(word[lo:hi], prepend=-1))
                    told = (hashes[word[lo:hi][turns]].tobytes(), np.diff(turns, append=hi - lo).astype("<u4").tobytes(), codes[lo:hi].tobytes())
                    own = dealt[cuts[k] : cuts[k + 1]]
                    places = place[own] - lo
                    if scored:
                        t = text[left[own]]
                        starts = np.flatnonzero(np.diff(t, prepend=-1))
                        told += (t[starts].astype("<u4").tobytes(), np.diff(starts, append=len(t)).astype("<u4").tobytes(), places.astype("<u2" if hi - lo <= 1 << 16 else "<u4").tobytes())
                    else:
                        told += (None, None, np.bincount(places, minlength=hi - lo).astype("<u4").tobytes())
                    tell((k, turn, side, scored, *told, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=schema.names)

    return texts.mapInArrow(run, schema)


def _answers(cells: DataFrame, known, buckets: int) -> DataFrame:
    """(batch, bucket, docs, sums, ids): summed losses of a batch's documents in each bucket; a batch's own row has bucket -1.

    A task holds one bucket, which is bounded by BUCKET_BYTES of text.
    """
    fields = [cells.schema["batch"], cells.schema["bucket"], T.StructField("docs", T.BinaryType()), T.StructField("sums", T.BinaryType()), cells.schema["ids"]]
    schema = T.StructType(fields)
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        told = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)
        cells = []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("bucket", "batch", "side", "scored", *_BYTES)), b.column("ids"), strict=True):
                if row[6] is None:  # a batch's own row
                    yield told([(row[1], -1, row[7], row[8], row[10])])
                else:
                    cells.append(row[:10])
        if not cells:
            return
        hot, hot_n = known.value["words"]
        total = known.value["total"]
        read = lambda c, kind: [np.frombuffer(x[c], kind) for x in cells]
        words, spread, codes = read(4, "<u8"), [x.astype(np.int64) for x in read(5, "<u4")], read(6, "<u8")
        places = [np.frombuffer(x[9], ("<u2" if len(c) <= 1 << 16 else "<u4") if x[3] else "<u4") for x, c in zip(cells, codes, strict=True)]
        counts = [np.bincount(p, minlength=len(c)) if x[3] else p for x, p, c in zip(cells, places, codes, strict=True)]
        own_words, word_at = np.unique(np.concatenate(words), return_inverse=True)
        own_codes, code_at = np.unique(np.concatenate(codes), return_inverse=True)
        word_n, code_n = np.zeros((len(own_words), 2)), np.zeros((len(own_codes), 2))
        w = c = 0
        for x, ws, s, cs, n in zip(cells, words, spread, codes, counts, strict=True):
            if x[2] >= 0:  # a cell's codes are distinct, and so are its words
                code_n[code_at[c : c + len(cs)], x[2]] += n
                word_n[word_at[w : w + len(ws)], x[2]] += np.add.reduceat(n, np.cumsum(s) - s)
            w, c = w + len(ws), c + len(cs)
        at, is_hot = _place(hot, own_words)
        word_n[is_hot] = hot_n[at[is_hot]]
        # As the word before the next one; of frequent words that is summed where the texts are read, and an end has none.
        context = np.where((is_hot | (own_words == np.uint64(_END)))[:, None], 0, np.log(word_n + PRIOR_UNIGRAM))
        w = c = 0
        for x, ws, s, cs, p in zip(cells, words, spread, codes, places, strict=True):
            if x[3]:
                of = np.repeat(word_at[w : w + len(ws)], s)
                loss = _loss(code_n[code_at[c : c + len(cs)]], word_n[of], total) + context[of]
                n = np.frombuffer(x[8], "<u4").astype(np.int64)
                yield told([(x[1], x[0], x[7], np.add.reduceat(loss[p], np.cumsum(n) - n).tobytes(), None)])
            w, c = w + len(ws), c + len(cs)

    return cells.repartitionById(buckets, F.col("bucket")).mapInArrow(run, schema)


def _summed(answers: DataFrame, known) -> DataFrame:
    """(doc_id, n_tokens, target, background) of each document of each batch."""
    key = answers.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", key), T.StructField("n_tokens", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("background", T.DoubleType())])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        start = np.log(known.value["texts"] + PRIOR_UNIGRAM)
        ids = sizes = sums = None

        def told():
            background, target = (sums + start).T
            return pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(target.copy()), pa.array(background.copy())], names=schema.names)

        for b in batches:
            for bucket, docs, raw, own in zip(b.column("bucket").to_pylist(), b.column("docs").to_pylist(), b.column("sums").to_pylist(), b.column("ids"), strict=True):
                part = np.frombuffer(raw, float).reshape(-1, 2)
                if bucket < 0:
                    if ids is not None:
                        yield told()
                    ids, sizes, sums = own.values, np.frombuffer(docs, "<u4").astype(np.int64), part.copy()
                else:
                    sums[np.frombuffer(docs, "<u4")] += part
        if ids is not None:
            yield told()

    return answers.repartition("batch").sortWithinPartitions("batch", "bucket").mapInArrow(run, schema)


def scores(docs: DataFrame, target: DataFrame, background: DataFrame | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, difference) for each row of ``docs``.

    target, background: tables with a ``text`` column (background: ``docs`` itself unless
    given).  Losses are nats an event, the events being a text's words and its end; null for
    texts of no words (null, empty, gaps alone), which are in no model either.  A bigram's
    estimate is backed by its word's, and that by the word's in both models' texts pooled;
    all words in neither are one unknown word of count 1.  Repeated rows are scored each;
    null doc_ids like others; other columns are left out; an empty table gives none.
    """
    bounded_batches(docs)
    key = docs.schema["doc_id"].dataType
    rows = lambda df, side, scored, id_: df.select(F.lit(side).alias("side"), F.lit(scored).alias("scored"), id_.alias("id"), text_or_empty(df["text"]).alias("text"))
    none = F.lit(None).cast(key)
    texts = rows(target, 1, False, none)
    if background is None:
        texts = texts.unionByName(rows(docs, 0, True, docs["doc_id"]))
    else:
        texts = texts.unionByName(rows(background, 0, False, none)).unionByName(rows(docs, -1, True, docs["doc_id"]))
    modelled = texts.where("side >= 0")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + size // bucket_bytes
    found = _known_beforehand(modelled, HEAVY_PART / buckets if buckets > 1 else 1.0, min(1.0, SAMPLES * TOKEN_BYTES / bucket_bytes))
    known = docs.sparkSession.sparkContext.broadcast(found)  # at most 16 words and 16 bigrams a bucket
    sums = _summed(_answers(_cells(texts, known, buckets), known, buckets), known)
    n = F.col("n_tokens")
    return sums.select(
        "doc_id", "n_tokens", F.when(n > 0, F.col("target") / (n + 1)).alias("target_loss"), F.when(n > 0, F.col("background") / (n + 1)).alias("background_loss")
    ).withColumn("difference", F.col("target_loss") - F.col("background_loss"))
