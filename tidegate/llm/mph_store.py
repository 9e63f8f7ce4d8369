"""Token-id output: raw id payloads with a minimal perfect hash index.

A store is a folder of shards.  Shard k is ``ids-k.bin``, the ids of its documents end to
end in ascending doc_id order (little-endian unsigned, 16 or 32 bits), and ``ids-k.mph``,
the index: a hash-and-displace function that gives each distinct key its own slot, and for
each slot a 32-bit fingerprint of its key, the key's first document and how many follow.
A lookup hashes the key once, reads one displacement and one slot, compares fingerprints,
then the stored key itself, and slices the payload.  ``manifest.json`` lists the shards,
``bounds.arrow`` their first and last keys in the keys' own type.
"""

from __future__ import annotations

import bisect
import functools
import json
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidegate.llm.common import bounded_batches, text_or_empty
from tidegate.llm.token_ids import encoder

MAGIC = b"TGMPH001"
KEYS_PER_BUCKET = 4
END_ID = 2
#: Input bytes (as stored) a shard holds about.
SHARD_BYTES = 16 << 20


def file_system(path: str):
    """(file system, path in it) of a local path or a URI."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _told(key) -> bytes:
    """A key as bytes; null, 1 and "1" are three keys, 0.0 and -0.0 one."""
    if key is None:
        return b"n"
    return f"{type(key).__name__}:{key + 0.0 if isinstance(key, float) else key}".encode("utf-8", "surrogatepass")


def _hashes(told: list[bytes]) -> tuple:
    """Two 64-bit hashes of each key."""
    import numpy as np
    import xxhash

    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in told), dtype="<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _slots(h, shift, n: int):
    import numpy as np

    x = h + (shift.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return (x % np.uint64(n)).astype(np.int64)


def build_index(told: list[bytes]) -> tuple:
    """(displacements, slot of each key) for distinct keys, as bytes.

    Buckets of several keys, the largest first, try displacements until all their keys
    fall on free slots; a bucket of one key names its slot, as -1 - slot.
    """
    import numpy as np

    n = len(told)
    h1, h2 = _hashes(told)
    m = max(1, -(-n // KEYS_PER_BUCKET))
    bucket = (h1 % np.uint64(m)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    size = np.bincount(bucket, minlength=m)
    start = np.cumsum(size) - size
    shift, slot, free = np.zeros(m, np.int64), np.empty(n, np.int64), np.ones(n, bool)
    for b in np.argsort(-size, kind="stable"):
        own = order[start[b] : start[b] + size[b]]
        if len(own) < 2:
            break
        h, first = h2[own], 0
        while True:
            tried = _slots(h[None, :], np.arange(first, first + 64)[:, None], n)
            ranked = np.sort(tried, axis=1)
            fits = free[tried].all(1) & (ranked[:, 1:] != ranked[:, :-1]).all(1)
            if fits.any():
                break
            first += 64
            if first > 1 << 22:
                raise ValueError("two keys share all hash bits")
        d = int(fits.argmax())
        shift[b], slot[own] = first + d, tried[d]
        free[tried[d]] = False
    left = np.flatnonzero(free)
    single = np.flatnonzero(size == 1)
    alone = order[start[single]]
    slot[alone] = left
    shift[single] = -1 - left
    return shift.astype("<i4"), slot


class Shard:
    """An open shard.  ``get(key)``: the id arrays of the documents of that key (none if unknown)."""

    def __init__(self, folder: str, name: str):
        import numpy as np
        import pyarrow as pa

        self._fs, root = file_system(folder)
        self._payload = f"{root}/{name}.bin"
        with self._fs.open_input_file(f"{root}/{name}.mph") as f:
            raw = f.read()
        if raw[:8] != MAGIC:
            raise ValueError(f"{name} is no index")
        n_keys, n_docs, m, width, keys = struct.unpack("<5q", raw[8:48])
        at = 48
        take = lambda kind, n: np.frombuffer(raw, kind, n, at)
        self.shift, at = take("<i4", m), at + 4 * m
        self.mark, at = take("<u4", n_keys), at + 4 * n_keys
        self.first, at = take("<u4", n_keys), at + 4 * n_keys
        self.count, at = take("<u4", n_keys), at + 4 * n_keys
        self.offsets, at = take("<u8", n_docs + 1).astype(np.int64), at + 8 * (n_docs + 1)
        self.keys = pa.ipc.open_stream(raw[at : at + keys]).read_all().column(0)
        self.kind = "<u2" if width == 2 else "<u4"
        self.width = width

    def find(self, keys: list):
        """(first document, number of documents) of each key; 0 documents of an unknown key."""
        import numpy as np
        import pyarrow as pa

        told = [_told(k) for k in keys]
        if not len(self.mark) or not told:
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        h1, h2 = _hashes(told)
        shift = self.shift[(h1 % np.uint64(len(self.shift))).astype(np.int64)].astype(np.int64)
        slot = np.where(shift < 0, -1 - shift, _slots(h2, np.maximum(shift, 0), len(self.mark)))
        first = self.first[slot].astype(np.int64)
        known = self.mark[slot] == (h1 >> np.uint64(32)).astype("<u4")
        at = np.flatnonzero(known)
        stored = self.keys.take(pa.array(first[at])).to_pylist()
        known[at] = [_told(k) == told[i] for k, i in zip(stored, at.tolist(), strict=True)]
        return first, np.where(known, self.count[slot], 0).astype(np.int64)

    def read(self, start: int, end: int):
        """Ids start to end of the payload."""
        import numpy as np

        with self._fs.open_input_file(self._payload) as f:
            f.seek(start * self.width)
            return np.frombuffer(f.read((end - start) * self.width), self.kind)

    def found(self, keys: list) -> Iterator[tuple]:
        """(document, first id, ids) of each document of some distinct keys, by way of the index; neighbours in the payload are read at once."""
        import numpy as np

        first, count = self.find(keys)
        doc = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        for part in np.split(doc, np.flatnonzero(np.diff(doc) != 1) + 1):
            for k in range(0, len(part), 2000):
                lo, hi = int(part[k]), int(part[min(k + 2000, len(part)) - 1]) + 1
                at = self.offsets[lo : hi + 1].tolist()
                ids = self.read(at[0], at[-1])
                yield from ((d, a, ids[a - at[0] : b - at[0]]) for d, a, b in zip(range(lo, hi), at, at[1:], strict=False))

    def get(self, key) -> list:
        return [ids for _, _, ids in self.found([key])]


@functools.total_ordering
class _Rank:
    """Orders keys as Spark does: null first, NaN last."""

    def __init__(self, key):
        self.at = (0,) if key is None else (2,) if key != key else (1, key)

    def __eq__(self, other) -> bool:
        return self.at == other.at

    def __lt__(self, other: _Rank) -> bool:
        return self.at < other.at


class Store:
    """A written store.  The shard of a key comes from the shards' bounds, its ids from the shard's index."""

    def __init__(self, path: str):
        import pyarrow as pa

        fs, root = file_system(path)
        with fs.open_input_file(f"{root}/manifest.json") as f:
            self.shards = json.loads(f.read())
        with fs.open_input_file(f"{root}/bounds.arrow") as f:
            bounds = pa.ipc.open_stream(f.read()).read_all()
        self._low, self._high = ([_Rank(k) for k in bounds.column(c).to_pylist()] for c in ("low", "high"))
        self.path, self._open = path, {}

    def shard(self, name: str) -> Shard:
        if name not in self._open:
            self._open[name] = Shard(self.path, name)
        return self._open[name]

    def get(self, key) -> list:
        """Id arrays of all documents of a key (a key may run over from one shard into the next)."""
        rank, found = _Rank(key), []
        for k in range(bisect.bisect_right(self._low, rank) - 1, -1, -1):
            if self._high[k] < rank:
                break
            found = self.shard(self.shards[k]["name"]).get(key) + found
        return found


def _stream(table) -> bytes:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _write(fs, path: str, chunks, mark: str) -> None:
    """To another name first: a file that has its name is whole, whichever attempt wrote it."""
    with fs.open_output_stream(f"{path}.{mark}") as f:
        for c in chunks:
            f.write(c)
    fs.move(f"{path}.{mark}", path)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> list[dict]:
    """Writes ``docs`` (doc_id, text) as a store; returns the manifest.

    Documents are range-sorted by doc_id (nulls first; ties by a hash of the text, so a
    repeated key may span shards).  Null and empty texts are the end id alone; an empty
    table gives a store of no shards.  A task streams its range through, holding only keys
    and offsets; a lost task is run again and writes the same files.
    """
    from tokenizers import Tokenizer

    width = 2 if Tokenizer.from_file(tokenizer).get_vocab_size(True) <= 1 << 16 and end_id < 1 << 16 else 4
    spark = docs.sparkSession
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    shards = max(spark.sparkContext.defaultParallelism, min(200_000, size // SHARD_BYTES + 1))
    rows = bounded_batches(docs).select(docs["doc_id"], text_or_empty(docs["text"]).alias("text")).withColumn("_tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(shards, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie")
    schema = "number long, name string, n_docs long, n_ids long, bounds binary"
    kind = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        name, mark = f"ids-{task.partitionId():06d}", f"{task.taskAttemptId()}.part"
        fs, root = file_system(path)
        fs.create_dir(root, recursive=True)
        keys: list = []
        sizes: list[int] = []

        def payload():
            for b in batches:
                if len(b):
                    keys.append(b.column("doc_id"))
                    ids, ends = encoder(tokenizer).encode(b.column("text"), end_id)
                    sizes.extend(np.diff(ends).tolist())
                    yield ids.astype(f"<u{width}").tobytes()

        _write(fs, f"{root}/{name}.bin", payload(), mark)
        if not sizes:
            fs.delete_file(f"{root}/{name}.bin")
            return
        table = pa.table({"key": pa.chunked_array(keys, kind)})
        told = [_told(k) for k in table.column(0).to_pylist()]
        first = [k for k in range(len(told)) if not k or told[k] != told[k - 1]]
        distinct = [told[k] for k in first]
        shift, slot = build_index(distinct)
        h1, _ = _hashes(distinct)
        counts = np.diff(np.array([*first, len(told)]))
        cols = [np.empty(len(first), "<u4") for _ in range(3)]
        for c, v in zip(cols, ((h1 >> np.uint64(32)), np.array(first), counts), strict=True):
            c[slot] = v
        stored = _stream(table)
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype("<u8")
        head = MAGIC + struct.pack("<5q", len(first), len(told), len(shift), width, len(stored))
        _write(fs, f"{root}/{name}.mph", [head, shift.tobytes(), *(c.tobytes() for c in cols), offsets.tobytes(), stored], mark)
        bounds = _stream(pa.table({"low": table.column(0).slice(0, 1), "high": table.column(0).slice(len(told) - 1)}))
        yield pa.RecordBatch.from_arrays(
            [pa.array([task.partitionId()]), pa.array([name]), pa.array([len(told)]), pa.array([int(offsets[-1])]), pa.array([bounds], pa.binary())],
            names=["number", "name", "n_docs", "n_ids", "bounds"],
        )

    import pyarrow as pa

    manifest, start = [], 0
    bounds = [pa.table({"low": pa.array([], kind), "high": pa.array([], kind)})]
    for r in sorted(rows.mapInArrow(run, schema).collect()):  # one row a shard
        manifest.append({"name": r["name"], "n_docs": r["n_docs"], "n_ids": r["n_ids"], "start": start})
        bounds.append(pa.ipc.open_stream(bytes(r["bounds"])).read_all())
        start += r["n_ids"]
    fs, root = file_system(path)
    fs.create_dir(root, recursive=True)
    _write(fs, f"{root}/bounds.arrow", [_stream(pa.concat_tables(bounds, promote_options="permissive"))], "part")
    _write(fs, f"{root}/manifest.json", [json.dumps(manifest).encode()], "part")
    return manifest


def read_store(spark: SparkSession, path: str, key: T.DataType) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document of a store.

    Every distinct key a shard lists is looked up in the shard's index, and what the index
    names is read from the payload; an empty store gives no rows.

    start: ids of all documents before it.  ids_crc32: of its ids as little-endian unsigned
    32-bit integers.
    """
    long = T.LongType()
    schema = T.StructType([T.StructField("doc_id", key), *[T.StructField(c, long) for c in ("start", "n_tokens", "ids_crc32")]])
    shards = [(s["name"], s["start"]) for s in Store(path).shards]
    listed = spark.createDataFrame(shards, "name string, start long").repartition(max(1, len(shards)))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for name, base in zip(b.column("name").to_pylist(), b.column("start").to_pylist(), strict=True):
                shard = Shard(path, name)
                asked = shard.keys.unique()
                for lo in range(0, len(asked), 2000):
                    rows = [(doc, base + at, len(ids), zlib.crc32(ids.astype("<u4"))) for doc, at, ids in shard.found(asked.slice(lo, 2000).to_pylist())]
                    doc, *told = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([shard.keys.take(doc).combine_chunks(), *told], names=schema.names)

    return listed.mapInArrow(run, schema)
