"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017), trained in numpy.

Confirmed toxic documents are the positives and a sample of all documents is unlabelled.
The risk weighs the positives by the class prior and takes from the unlabelled loss what
hidden positives add to it; where that difference turns negative, its gradient is reversed,
so that the classifier can't gain by fitting noise.

Features are the presence of a word or of a word's first letters.  Only those clearly more
frequent among the positives are kept, so a model is a short list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.llm.common import bounded_batches, columns_of, quoted, text_or_empty, unused

#: Bounds of the training sample, met on average (documents are drawn by a hash of doc_id).
MAX_POSITIVE = 3000
MAX_UNLABELLED = 6000
PREFIXES = (4, 5)
#: A feature needs this many positives and this many standard errors of difference.
LEAST_POSITIVES, LEAST_Z = 3, 4.0
STEPS, RATE, DECAY = 400, 0.05, 1e-3
_EDGES = ".,;:!?\"'()[]{}<>*#-_&$%|="
_KEPT_WORDS = 200_000


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of doc_id as text, modulo ``folds`` (null: 0)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def word_features(word: str) -> tuple[int, ...]:
    """32-bit hashes of a lower-case word and of its beginnings."""
    import xxhash

    word = word.strip(_EDGES)
    if not word:
        return ()
    return tuple(xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass")) for x in (f"={word}", *(f"{word[:p]}~" for p in PREFIXES if len(word) > p)))


@dataclass
class Model:
    bias: float
    weights: dict[int, float]
    prior: float
    _known: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)

    def score(self, text: str) -> float:
        """Probability of label 1, from the features of the whole text."""
        import math

        known, weights = self._known, self.weights
        found: set[int] = set()
        for w in set(text.lower().split()):
            kept = known.get(w)
            if kept is None:
                if len(known) > _KEPT_WORDS:
                    known.clear()
                kept = known[w] = tuple(f for f in word_features(w) if f in weights)
            if kept:
                found.update(kept)
        g = self.bias + sum(weights[f] for f in sorted(found))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, g))))

    def __getstate__(self):
        return {**self.__dict__, "_known": {}}


def _gather(docs: DataFrame, labels: DataFrame, folds: int) -> tuple[list, list, float]:
    """Feature arrays of sampled positives and unlabelled documents of the training folds, and the prior."""
    import numpy as np

    known = labels.where((fold(labels["doc_id"], folds) != 0) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_pos = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0))).first()
    if not n_pos:
        return [], [], 0.0
    train = docs.where(fold(docs["doc_id"], folds) != 0)
    n_docs = train.select("doc_id").count()
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("draw")), 33) / F.lit(2.0**31)
    positives = known.where((F.col("toxic") == 1) & (draw < MAX_POSITIVE / n_pos)).select("doc_id", F.lit(True).alias("_p"))
    sample = (
        train.select("doc_id", text_or_empty(train["text"]).alias("_text"))
        .join(F.broadcast(positives), "doc_id", "left")  # about MAX_POSITIVE rows at most
        .select(F.coalesce("_p", F.lit(False)).alias("p"), (draw < MAX_UNLABELLED / max(1, n_docs)).alias("u"), "_text")
        .where("p OR u")
    )

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            told = []
            for t in b.column("_text").to_pylist():
                feats = {f for w in set(t.lower().split()) for f in word_features(w)}
                told.append(np.array(sorted(feats), dtype="<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("p"), b.column("u"), pa.array(told, pa.binary())], names=["p", "u", "f"])

    pos, unl = [], []
    for r in sample.mapInArrow(run, "p boolean, u boolean, f binary").toLocalIterator():
        f = np.frombuffer(bytes(r["f"]), "<u4")
        if r["p"]:
            pos.append(f)
        if r["u"]:
            unl.append(f)
    return pos, unl, n_pos / n


def _soft(g):
    """Logistic loss of label 0 at score ``g``; of label 1 it is that of ``-g``."""
    import numpy as np

    return np.logaddexp(0, g)


def rest_risk(positive, unlabelled, prior: float) -> float:
    """Risk of label 0 among the negatives: the unlabelled loss less what hidden positives add to it."""
    return _soft(unlabelled).mean() - prior * _soft(positive).mean()


def slopes(positive, unlabelled, prior: float) -> tuple:
    """What each score of positives and unlabelled adds to the gradient.

    That of the whole risk, prior times the loss of label 1 among positives plus
    :func:`rest_risk`; where the latter is negative, which only overfitting makes it, the
    reverse of its own gradient.
    """
    import numpy as np

    logistic = lambda g: 0.5 * (1 + np.tanh(g / 2))
    if rest_risk(positive, unlabelled, prior) >= 0:
        return prior * (-logistic(-positive) - logistic(positive)) / len(positive), logistic(unlabelled) / len(unlabelled)
    return prior * logistic(positive) / len(positive), -logistic(unlabelled) / len(unlabelled)


def train(pos: list, unl: list, prior: float) -> Model:
    """The model of positives and unlabelled documents (arrays of distinct features)."""
    import numpy as np

    if not pos or not unl or not 0 < prior < 1:
        return Model(-20.0 if prior < 0.5 else 20.0, {}, prior)
    pos, unl = (sorted(xs, key=lambda x: x.tobytes()) for xs in (pos, unl))  # whatever order they came in
    feats, df_p = np.unique(np.concatenate(pos), return_counts=True)
    feats, df_p = feats[df_p >= LEAST_POSITIVES], df_p[df_p >= LEAST_POSITIVES]
    all_u, n_u = np.unique(np.concatenate(unl), return_counts=True)
    at = np.searchsorted(all_u, feats).clip(0, len(all_u) - 1)
    df_u = np.where(all_u[at] == feats, n_u[at], 0)
    p, u = (df_p + 0.5) / (len(pos) + 1), (df_u + 0.5) / (len(unl) + 1)
    both = (df_p + df_u + 1) / (len(pos) + len(unl) + 2)
    z = (p - u) / np.sqrt(both * (1 - both) * (1 / len(pos) + 1 / len(unl)))
    # Were all hidden positives like the known ones, negatives would have the feature this often.
    negative = np.maximum(u - prior * p, 0) / (1 - prior)
    feats = feats[(z >= LEAST_Z) & (negative < 0.5 * p)]
    if not len(feats):
        return Model(float(np.log(prior / (1 - prior))), {}, prior)

    def matrix(docs):
        rows, cols = [], []
        for k, x in enumerate(docs):
            at = np.searchsorted(feats, x).clip(0, len(feats) - 1)
            at = at[feats[at] == x]
            cols.append(at)
            rows.append(np.full(len(at), k))
        return np.concatenate(rows), np.concatenate(cols), len(docs)

    sets = matrix(pos), matrix(unl)
    w, bias = np.zeros(len(feats)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(feats) + 1), np.zeros(len(feats) + 1)

    for step in range(1, STEPS + 1):
        push = slopes(*(bias + np.bincount(r, w[c], n) for r, c, n in sets), prior)
        grad = np.zeros(len(feats) + 1)
        for (r, c, _), d in zip(sets, push, strict=True):
            grad[:-1] += np.bincount(c, d[r], len(feats))
            grad[-1] += d.sum()
        grad[:-1] += DECAY * prior * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Model(float(bias), {int(f): float(x) for f, x in zip(feats, w, strict=True)}, prior)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5) -> Model:
    """Trains on rows whose fold is not 0.  Without a confirmed toxic row every score is near 0."""
    return train(*_gather(docs, labels, folds))


def with_scores(docs: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """``docs`` with the model's score of each whole text (null: empty) in a further column, which replaces one of that name.

    Each row is scored by itself; columns are kept whatever their names; an empty table
    gives none.
    """
    rest = docs.select(*[docs[quoted(c)] for c in docs.columns if c.lower() != score.lower()], docs["text"].cast("string").alias(unused(docs, "text_to_score")))
    *kept, text = columns_of(rest)
    schema = T.StructType([T.StructField("row", T.StructType(rest.schema.fields[:-1]), False), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            told = pa.array([model.score(t or "") for t in b.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), told], names=schema.names)

    scored = bounded_batches(rest).select(F.struct(*kept).alias("row"), text.alias("text")).mapInArrow(run, schema)
    return scored.select("row.*", F.col("score").alias(score))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    Only the text decides a score; null and empty texts score by the bias.  Null doc_ids
    are held out.  Ties and repeated rows are scored alike; an empty table gives none.
    """
    scored = with_scores(docs.select("doc_id", "text"), fit(docs, labels, folds))
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
