"""What the text operators share: word rules, row keys, batches; intermediate tables are written to the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.plans.tables import fresh_path  # noqa: F401
from tidegate.plans.tables import settled as materialize  # noqa: F401

#: Words are maximal runs of anything but these six characters.
GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"

#: Bytes of one batch between Spark and Python: long texts make short batches.
BATCH_BYTES = 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``; from now on its session hands Python at most BATCH_BYTES (or one row) at a time."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(df.sparkSession.conf.get(name, "2147483646").rstrip("bB")) > BATCH_BYTES:
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text (null: none)."""
    bare = F.btrim(text_or_empty(text), F.lit(GAP_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP, -1))


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def null_coded(c: Column) -> Column:
    """A string that tells null from every value, for grouping and joining."""
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), c.cast("string")))


def quoted(name: str) -> str:
    """A column's name as it is, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def columns_of(df: DataFrame) -> list[Column]:
    return [df[quoted(c)] for c in df.columns]


def whole_row(df: DataFrame) -> Column:
    """All columns as one, ``row``, beside which no name clashes; ``select("row.*")`` gives them back."""
    return F.struct(*columns_of(df)).alias("row")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _hashed(c: Column, kind: T.DataType, seed: int) -> Column:
    """A 64-bit hash of a value of any type that tells nulls and their places apart."""
    if isinstance(kind, T.StructType):
        parts = [_hashed(c.getField(f.name), f.dataType, seed) for f in kind.fields]
    elif isinstance(kind, T.ArrayType):
        parts = [F.size(c), F.transform(c, lambda x: _hashed(x, kind.elementType, seed))]
    elif isinstance(kind, T.MapType):
        entry = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        parts = [F.size(c), F.array_sort(F.transform(F.map_entries(c), lambda x: _hashed(x, entry, seed)))]
    else:
        parts = [c]
    return F.xxhash64(F.lit(seed), c.isNull(), *parts)


def row_key(df: DataFrame) -> list[Column]:
    """_k1, _k2: two 64-bit hashes of all columns, nulls and their places included; unequal rows share both by chance alone."""
    return [F.xxhash64(F.lit(k), *[_hashed(df[quoted(f.name)], f.dataType, k) for f in df.schema.fields]).alias(f"_k{k}") for k in (1, 2)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)
