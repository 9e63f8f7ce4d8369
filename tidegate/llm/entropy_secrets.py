"""Secret scans: known shapes by pattern, unknown ones by sliding-window entropy, in built-in expressions.

Positions come from cutting the text at a pattern's matches: the lengths of the parts and
of the matches add up to where each match stands, in code points.  Running sums and maxima
go by blocks of blocks, so a text costs in proportion to its length and its matches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import columns_of, text_or_empty, whole_row

# The three base kinds.  A match of `assign` counts if group 2 has MIN_VALUE characters.
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
MIN_VALUE = 6
#: Runs are maximal, so a least length in the pattern equals dropping shorter matches.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"


@dataclass(frozen=True)
class EntropyClass:
    """A character class: candidates are its runs of at least ``window`` characters.

    What the allow-list matches is cut out of a candidate.  A stretch that is left is a
    secret if some window of it has ``bits`` of Shannon entropy or more and it has a
    character of each pattern in ``needs``.
    """

    kind: str
    alphabet: str
    window: int
    bits: float
    needs: tuple[str, ...] = ()

    @property
    def pattern(self) -> str:
        return "[" + "".join("\\" + c if c in "-]^\\[" else c for c in self.alphabet) + "]{%d,}" % self.window


_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
CLASSES = (
    EntropyClass("entropy_base64", _UPPER + _LOWER + _DIGITS + "+/_=-", 20, 3.7, ("[0-9]", "[A-Za-z]")),
    EntropyClass("entropy_hex", _DIGITS + "ABCDEFabcdef", 32, 3.0, ("[0-9]", "[A-Fa-f]")),
)
#: Known harmless strings: runs of one character, UUIDs, samples of documentation, counting alphabets (one alternation; a backreference counts all groups).
ALLOWED = (
    r"(.)\1{5,}",
    "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY",
    "(?i:example|sample|placeholder|dummy|changeme)",
    "(?i:abcdefghij)|0123456789",
)
KINDS = ("assign", "access", "hex", *(c.kind for c in CLASSES))
_SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Numbers in one block of a running sum; blocks of blocks are summed in turn.
_BLOCK = 64


def running(xs: Column, combine=lambda a, b: a + b, levels: int = 3) -> Column:
    """For an array of non-negative longs what all numbers before each come to (0 before the first)."""
    zero = F.lit(0).cast("long")
    empty = F.array().cast("array<bigint>")

    def within(block: Column) -> Column:
        start = F.struct(zero.alias("sum"), empty.alias("out"))
        step = lambda acc, x: F.struct(combine(acc["sum"], x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))
        return F.aggregate(block, start, step, lambda acc: acc["out"])

    if levels == 1:
        return within(xs)

    def by_blocks(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _BLOCK).cast("int")), lambda k: F.slice(xs, k * _BLOCK + 1, F.lit(_BLOCK)))
        total = lambda block: F.aggregate(block, zero, combine)
        place = lambda b: F.zip_with(b, running(F.transform(b, total), combine, levels - 1), lambda block, base: F.transform(within(block), lambda x: combine(x, base)))
        return F.flatten(_let(blocks, place))

    return F.when(F.size(xs) <= _BLOCK, within(xs)).otherwise(by_blocks(xs))


def _pieces(text: Column, pattern: str) -> Column:
    """(start, part, match) of each match of a pattern, leftmost and not overlapping: the part before it, which begins at ``start``; last the rest, with no match."""
    parts, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(parts, matches, lambda p, m: F.struct(p.alias("part"), m.alias("match")))
    size = lambda x: (F.length(x["part"]) + F.coalesce(F.length(x["match"]), F.lit(0))).cast("long")
    placed = lambda xs: F.zip_with(xs, running(F.transform(xs, size)), lambda x, at: F.struct(at.alias("start"), x["part"].alias("part"), x["match"].alias("match")))
    return _let(both, placed)


def _span(start: Column, length: Column, kind: str) -> Column:
    start = start.cast("long")
    return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (start + length).alias("end"), F.lit(kind).alias("kind"))


def _found(text: Column, pattern: str, kind: str, least: Column | None = None) -> Column:
    """Spans of a pattern's matches; ``least``, if given, is an array that says of each match whether it counts."""
    spans = F.transform(
        F.filter(_pieces(text, pattern), lambda x: x["match"].isNotNull()), lambda x: _span(x["start"] + F.length(x["part"]), F.length(x["match"]), kind)
    )
    if least is not None:
        told = F.zip_with(spans, least, lambda x, good: F.struct(x.alias("x"), good.alias("good")))
        spans = F.transform(F.filter(told, lambda v: v["good"]), lambda v: v["x"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPANS))


def max_entropy(s: Column, alphabet: str, window: int) -> Column:
    """Highest Shannon entropy (bits a character) of the windows of ``s``, whose characters are of ``alphabet``.

    One pass: a character enters as another leaves, each changes one count c and the sum of
    c * log2(c); entropy is log2(window) - sum/window.  Counts are some bits each of a few
    longs, and the sum is kept in fixed point, so nothing drifts.
    """
    bits = window.bit_length()
    each = 63 // bits
    unit = 1 << 40
    weight = F.array(*[F.lit(0 if c < 2 else round(c * math.log2(c) * unit)).cast("long") for c in range(window + 1)])
    chars = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    none = F.array(*[F.lit(-1)] * window)
    events = _let(chars, lambda c: F.zip_with(c, F.concat(none, c), lambda i, o: F.struct(i.alias("come"), o.alias("gone"))))
    counts = F.array(*[F.lit(0).cast("long")] * -(-len(alphabet) // each))
    start = F.struct(counts.alias("n"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("size"), F.lit(window * unit * 64).cast("long").alias("least"))

    def changed(state: Column, k: Column, by: int) -> Column:
        """(n, sum) after one character more or less; a negative k changes nothing."""
        slot, shift = F.floor(k / each).cast("int"), F.pmod(k, F.lit(each)) * bits
        count = F.call_function("shiftright", F.element_at(state["n"], slot + 1), shift).bitwiseAND((1 << bits) - 1).cast("int")
        new = lambda c: F.struct(
            F.transform(state["n"], lambda x, i: F.when(i == slot, x + F.call_function("shiftleft", F.lit(by).cast("long"), shift)).otherwise(x)).alias("n"),
            (state["sum"] + F.element_at(weight, c + by + 1) - F.element_at(weight, c + 1)).alias("sum"),
        )
        return F.when(k < 0, F.struct(state["n"].alias("n"), state["sum"].alias("sum"))).otherwise(_let(count, new))

    def step(acc: Column, e: Column) -> Column:
        size = acc["size"] + 1
        told = lambda x: F.struct(x["n"].alias("n"), x["sum"].alias("sum"), size.alias("size"), F.when(size >= window, F.least(acc["least"], x["sum"])).otherwise(acc["least"]).alias("least"))
        return _let(_let(changed(acc, e["gone"], -1), lambda x: changed(x, e["come"], 1)), told)

    return F.aggregate(events, start, step, lambda acc: F.lit(math.log2(window)) - acc["least"] / F.lit(float(window * unit)))


def _entropy(text: Column, c: EntropyClass, allowed: tuple[str, ...]) -> Column:
    """Spans of the stretches of high entropy of a class's candidates, allow-listed ones cut out."""
    cut = "|".join(f"(?:{p})" for p in allowed)
    runs = F.transform(F.filter(_pieces(text, c.pattern), lambda x: x["match"].isNotNull()), lambda x: F.struct((x["start"] + F.length(x["part"])).alias("start"), x["match"].alias("part")))
    if cut:
        left = lambda r: F.transform(_pieces(r["part"], cut), lambda x: F.struct((r["start"] + x["start"]).alias("start"), x["part"].alias("part")))
        plain = lambda r: F.array(F.struct(r["start"].alias("start"), r["part"].alias("part")))
        runs = F.flatten(F.transform(runs, lambda r: F.when(r["part"].rlike(cut), left(r)).otherwise(plain(r))))

    def secret(x: Column) -> Column:
        good = F.length(x["part"]) >= c.window
        for p in c.needs:
            good = good & x["part"].rlike(p)
        return F.when(good, max_entropy(x["part"], c.alphabet, c.window) >= c.bits).otherwise(F.lit(False))

    spans = F.transform(F.filter(runs, secret), lambda x: _span(x["start"], F.length(x["part"]), c.kind))
    return F.when(text.rlike(c.pattern), spans).otherwise(F.array().cast(_SPANS))


def secret_spans(text: Column, classes=CLASSES, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """All spans of a text: array of (start, rank, end, kind), by start and then kind; end is exclusive.

    Null and empty texts have none.  Base kinds stay whatever the allow-list says.
    """
    text = text_or_empty(text)
    assign = _found(text, ASSIGN, "assign", F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= MIN_VALUE))
    spans = [assign, _found(text, ACCESS, "access"), _found(text, HEX, "hex"), *(_entropy(text, c, allowed) for c in classes)]
    return F.sort_array(F.concat(*spans))


def scan_secrets(docs: DataFrame, spans: str = "secret_spans") -> DataFrame:
    """``docs`` with the spans of ``text`` in a further column (which replaces one of that name).

    Each row is scanned by itself and whole: nulls, ties, repeated rows and empty tables
    need no rule; very long texts cost in proportion to their length.
    """
    kept = [c for c, name in zip(columns_of(docs), docs.columns, strict=True) if name.lower() != spans.lower()]
    return docs.select(*kept, secret_spans(docs["text"]).alias(spans))


#: Characters in one of the parts that a changed text is cut from.
_CHUNK = 4096


def _without(text: Column, spans: Column, mark: str) -> Column:
    """A text with each span, or run of overlapping ones, replaced by ``mark``."""

    def piece(chunks: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / _CHUNK).cast("int")
        one = lambda k: F.element_at(chunks, k + 1).substr((F.greatest(a - k * _CHUNK, F.lit(0)) + 1).cast("int"), (F.least(b - k * _CHUNK, F.lit(_CHUNK)) - F.greatest(a - k * _CHUNK, F.lit(0))).cast("int"))
        whole = F.array_join(F.transform(F.sequence(first, F.greatest(first, F.floor((b - 1) / _CHUNK).cast("int"))), one), "")
        return F.when(b > a, whole).otherwise(F.lit(""))

    ends = F.transform(spans, lambda x: x["end"])
    upto = running(ends, lambda a, b: F.greatest(a, b))
    # A span opens a piece if it begins after the ends of all before it; the piece runs from the last of these.
    opens = F.filter(F.zip_with(spans, upto, lambda x, m: F.struct(m.alias("a"), x["start"].alias("b"), x["end"].alias("end"))), lambda x: (x["b"] > x["a"]) | (x["a"] == 0))
    bounds = F.concat(F.transform(opens, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))), F.array(F.struct(F.array_max(ends).alias("a"), F.length(text).cast("long").alias("b"))))
    chunks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % _CHUNK), F.lit(0))
    return F.array_join(_let(chunks, lambda c: F.transform(bounds, lambda x: piece(c, x["a"], x["b"]))), mark)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` and ``n_chars``, if there, set anew in changed rows.

    Overlapping spans are replaced as one.  No row goes; null and empty texts and rows
    without secrets stay as they are, repeated rows are changed alike, other columns are
    kept whatever their names, and an empty table gives none.
    """
    found = docs.select(whole_row(docs), docs["text"].cast("string").alias("text"), secret_spans(docs["text"]).alias("spans"))
    changed = F.size("spans") > 0
    found = found.select("row", changed.alias("changed"), F.when(changed, _without(F.col("text"), F.col("spans"), mark)).alias("new"))

    def column(name: str) -> Column:
        old = F.col("row").getField(name)
        new = {"text": F.col("new"), "n_chars": F.length("new")}.get(name)
        return (old if new is None else F.when(F.col("changed"), new).otherwise(old).cast(docs.schema[name].dataType)).alias(name)

    return found.select(*[column(c) for c in docs.columns])


def digest(scanned: DataFrame, spans: str = "secret_spans") -> DataFrame:
    """The query's columns from scanned rows, each by itself: doc_id, counts of the base kinds, a hash of their spans, all spans."""
    told = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter(spans, lambda x: x["rank"] < 3)
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(told(base), 256).alias("base_sha256"), told(F.col(spans)).alias("spans"))
