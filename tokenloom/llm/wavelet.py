"""Token ids in wavelet matrices: one compressed file per shard that answers access, count and occurrence."""
from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, new_path, open_ranges, write_file
from .tokens import encoder, texts_of

MAGIC = b"WVMX0003"
#: Bits between two stored ranks.
BLOCK = 512
#: Bytes of a plane that are compressed together, and so read together.
CHUNK = 1 << 16
#: Pieces of text that a worker remembers here, where it holds little else.
REMEMBERED = 800_000
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def parted(one: np.ndarray, width: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, slice]]:
    """Where zeros and ones stand in each part of a plane, and the part."""
    for i in range(0, len(one), width):
        here = slice(i, i + width)
        yield np.flatnonzero(~one[here]), np.flatnonzero(one[here]), here


def coded(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids in ascending order, and for each id its place among them."""
    if ids.dtype.itemsize > 2:
        alphabet, codes = np.unique(ids, return_inverse=True)
        return alphabet.astype("<u4"), codes.astype(np.uint32)
    seen = np.zeros(1 << 16, bool)
    seen[ids] = True
    return np.flatnonzero(seen).astype("<u4"), np.take((np.cumsum(seen) - 1).astype(np.uint16), ids, mode="clip")


def rank_directory(plane: np.ndarray) -> np.ndarray:
    """How many ones a plane has before each block of BLOCK bits."""
    if not len(plane):
        return np.zeros(1, "<u8")
    sums = np.add.reduceat(_ONES[plane], np.arange(0, len(plane), BLOCK // 8), dtype=np.int64)
    return np.concatenate(([0], np.cumsum(sums))).astype("<u8")


class StoredPlane:
    """A plane in a file; its chunks are read and decompressed when they are asked for."""

    def __init__(self, read, at: int, sizes: list[int]):
        self.read, self.sizes, self.starts, self.held = read, sizes, [at + x for x in np.cumsum([0, *sizes]).tolist()], {}

    def chunk(self, i: int) -> np.ndarray:
        if i not in self.held:
            self.held[i] = np.frombuffer(unpacked(self.read(self.starts[i], self.sizes[i])), np.uint8)
        return self.held[i]

    def __getitem__(self, key):
        """A byte, or a slice of bytes inside one chunk."""
        if isinstance(key, slice):
            i = key.start // CHUNK
            return self.chunk(i)[key.start - i * CHUNK : key.stop - i * CHUNK] if key.stop > key.start else np.zeros(0, np.uint8)
        return self.chunk(key // CHUNK)[key % CHUNK]

    def whole(self) -> np.ndarray:
        return np.concatenate([self.chunk(i) for i in range(len(self.sizes))]) if self.sizes else np.zeros(0, np.uint8)


def unpacked(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


class WaveletMatrix:
    """A sequence of ids as bit planes over its effective alphabet: a code is an id's place among the distinct
    ids, and there are as many planes as the largest code has bits.  Highest bit first, each plane lists one
    bit of all codes, and the next plane has the codes stably parted into zeros, then ones."""

    def __init__(self, n: int, planes: list, zeros: list[int], alphabet: np.ndarray, ranks: list):
        self.n, self.planes, self.zeros, self.alphabet, self.ranks = n, planes, zeros, alphabet, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        planes, zeros, (alphabet, now) = [], [], coded(ids)
        for k in range(max(len(alphabet) - 1, 1).bit_length() - 1, -1, -1):
            one = (now & now.dtype.type(1 << k)) != 0
            planes.append(np.packbits(one, bitorder="little"))
            z = len(one) - int(np.count_nonzero(one))
            zeros.append(z)
            up, at, to = np.empty_like(now), 0, z
            for low, high, here in parted(one):  # indices into a part are much faster than masks of all
                up[at : at + len(low)], up[to : to + len(high)] = now[here][low], now[here][high]
                at, to = at + len(low), to + len(high)
            now = up
        return cls(len(ids), planes, zeros, alphabet, [rank_directory(p) for p in planes])

    def decode(self) -> np.ndarray:
        """All ids in order: from the last plane up, each plane says where its zeros and ones came from."""
        now = np.zeros(self.n, dtype=np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k, (plane, z) in enumerate(zip(self.planes[::-1], self.zeros[::-1], strict=True)):
            plane = plane.whole() if isinstance(plane, StoredPlane) else plane
            one = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            now[z:] |= now.dtype.type(1 << k)
            up, at, to = np.empty_like(now), 0, z
            for low, high, here in parted(one):
                up[here][low], up[here][high] = now[at : at + len(low)], now[to : to + len(high)]
                at, to = at + len(low), to + len(high)
            now = up
        return np.take(self.alphabet, now, mode="clip") if self.n else np.zeros(0, "<u4")

    def ones(self, level: int, i: int) -> int:
        """Rank: how many ones the first i bits of a plane have."""
        block, plane = i // BLOCK, self.planes[level]
        full, rest = i // 8, i % 8
        count = int(self.ranks[level][block]) + int(_ONES[plane[block * BLOCK // 8 : full]].sum())
        return count + (bin(int(plane[full]) & ((1 << rest) - 1)).count("1") if rest else 0)

    def place(self, level: int, bit: int, nth: int) -> int:
        """Select: the index of the nth (from 0) bit of this value in a plane."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            seen = self.ones(level, middle + 1)
            low, high = (low, middle) if (seen if bit else middle + 1 - seen) > nth else (middle + 1, high)
        return low

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, z in enumerate(self.zeros):
            bit = int(self.planes[level][i // 8]) >> (i % 8) & 1
            value = value << 1 | bit
            i = z + self.ones(level, i) if bit else i - self.ones(level, i)
        return int(self.alphabet[value])

    def _code(self, token: int) -> int | None:
        code = int(np.searchsorted(self.alphabet, token))
        return code if code < len(self.alphabet) and self.alphabet[code] == token else None

    def _span(self, code: int | None, start: int, end: int) -> tuple[int, int]:
        if code is None:
            return 0, 0
        for level, z in enumerate(self.zeros):
            a, b = self.ones(level, start), self.ones(level, end)
            start, end = (z + a, z + b) if code >> (len(self.planes) - 1 - level) & 1 else (start - a, end - b)
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        a, b = self._span(self._code(token), start, self.n if end is None else end)
        return b - a

    def occurrence(self, token: int, nth: int) -> int:
        """The index of the nth occurrence (from 0) of a token."""
        code = self._code(token)
        a, b = self._span(code, 0, self.n)
        if not 0 <= nth < b - a:
            raise IndexError(nth)
        i = a + nth
        for level in range(len(self.planes) - 1, -1, -1):
            bit = code >> (len(self.planes) - 1 - level) & 1
            i = self.place(level, bit, i - self.zeros[level] if bit else i)
        return i


def pack_shard(doc_ids: list, lengths: list[int], ids: np.ndarray, bits: int = 16) -> bytes:
    """A shard as one file: magic, header length, JSON header, then zstd frames of document ids, lengths,
    alphabet and rank directories, and of each plane's chunks.  Ids must be below 2**bits."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    made = WaveletMatrix.build(ids)
    if len(made.alphabet) and int(made.alphabet[-1]) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    frames = [squeeze(json.dumps(doc_ids).encode()), squeeze(np.asarray(lengths, dtype="<i8").tobytes()), squeeze(made.alphabet.tobytes()), squeeze(np.concatenate(made.ranks).tobytes())]
    chunks = [[squeeze(p[i : i + CHUNK].tobytes()) for i in range(0, len(p), CHUNK)] for p in made.planes]
    header = json.dumps({"n": made.n, "n_docs": len(doc_ids), "zeros": made.zeros, "frames": list(map(len, frames)), "chunks": [list(map(len, c)) for c in chunks]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *frames, *(x for c in chunks for x in c)])


class Shard:
    """A shard file, read by ranges: read(at, size) gives bytes of it.  Opening it reads the header alone."""

    def __init__(self, read):
        first = read(0, 4096)
        if first[:8] != MAGIC:
            raise ValueError("not a wavelet shard")
        (size,) = struct.unpack_from("<I", first, 8)
        self.read, self.at = read, 12 + size
        self.header = json.loads(first[12 : self.at] if self.at <= len(first) else read(12, size))
        self.n, self.n_docs = self.header["n"], self.header["n_docs"]

    def _frame(self, i: int) -> bytes:
        sizes = self.header["frames"]
        return unpacked(self.read(self.at + sum(sizes[:i]), sizes[i]))

    @property
    def doc_ids(self) -> list:
        return json.loads(self._frame(0))

    @property
    def lengths(self) -> np.ndarray:
        return np.frombuffer(self._frame(1), dtype="<i8")

    def matrix(self) -> WaveletMatrix:
        """Alphabet and rank directories are read, planes when they are used."""
        at, planes = self.at + sum(self.header["frames"]), []
        for sizes in self.header["chunks"]:
            planes.append(StoredPlane(self.read, at, sizes))
            at += sum(sizes)
        ranks = np.frombuffer(self._frame(3), dtype="<u8")
        return WaveletMatrix(self.n, planes, self.header["zeros"], np.frombuffer(self._frame(2), dtype="<u4"), np.split(ranks, len(planes)))


def open_shard(data: bytes) -> tuple[list, np.ndarray, WaveletMatrix]:
    shard = Shard(lambda at, size: data[at : at + size])
    return shard.doc_ids, shard.lengths, shard.matrix()


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, shard_tokens: int = 4_000_000, bits: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes documents in ascending order of id into shard files; returns their manifest: part, seq (the
    files' order), path, n_docs, n_tokens.

    Range partitions follow the ids; a partition writes a file whenever shard_tokens are full, so a task
    holds one file's ids at most (or one document's).  A file is renamed in place when whole, under a name
    that a repeated task writes again.  Ids are integers or strings, null ids come first, and rows with one
    id (however many) stand next to each other in the table's order, which must be the same whenever it is
    read.  A null text is empty and gives the end id alone.  An empty table gives no files; other columns
    are not looked at."""
    import pyarrow as pa

    where = path or new_path(docs.sparkSession, "wavelet")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), encoder(tokenizer, REMEMBERED).encode_all
        end, seq, held, names, lengths, total = np.array([end_id], "<u2").tobytes(), 0, [], [], [], 0

        def flush():
            name = f"{where}/shard-{part:06d}-{seq:04d}.wvm"
            write_file(name, [pack_shard(names, lengths, np.frombuffer(b"".join(held), dtype="<u2"), bits)])
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [name], "n_docs": pa.array([len(names)], pa.int64()), "n_tokens": pa.array([total], pa.int64())})

        for batch in batches:
            for doc_id, own in zip(batch.column(0), encode(texts_of(batch.column(1))), strict=True):
                ids = own + end
                names.append(doc_id.as_py()), lengths.append(len(ids) // 2), held.append(ids)
                total += len(ids) // 2
                if total >= shard_tokens:
                    yield flush()
                    seq, held, names, lengths, total = seq + 1, [], [], [], 0
        if names:
            yield flush()

    order = [F.col("doc_id").asc_nulls_first(), F.col("row")]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row")).repartitionByRange(*order)
    return materialize(map_arrow(rows.sortWithinPartitions(*order).drop("row"), run, "part int, seq int, path string, n_docs long, n_tokens long"), "manifest")


def placed_shards(manifest: DataFrame) -> DataFrame:
    """part, seq, path, start (tokens of all files before), n_tokens, both from the files' own headers."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for path in batch.column(2).to_pylist():
                with open_ranges(path) as read:
                    sizes.append(Shard(read).n)
            yield batch.append_column("n_tokens", pa.array(sizes, pa.int64()))

    found = materialize(map_arrow(manifest.select("part", "seq", "path"), run, "part int, seq int, path string, n_tokens long"), "placed")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as files
    return found.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def over_shards(placed: DataFrame, run, schema: str) -> DataFrame:
    """run(shard, row) gives rows of schema for each file; placed has path and what else row needs."""
    import pyarrow as pa

    names = placed.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = dict(zip(names, values, strict=True))
                with open_ranges(row["path"]) as read:
                    yield from run(Shard(read), row)

    n = max(1, min(placed.count(), 100_000))
    return map_arrow(placed.repartitionByRange(n, "path"), each, schema)


def read_shards(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """doc_id, start, ids (little-endian unsigned 32-bit) per document, from the files."""
    import pyarrow as pa

    kind = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[id_type]

    def run(shard: Shard, row: dict) -> Iterator[pa.RecordBatch]:
        names, lengths, start = shard.doc_ids, shard.lengths, row["start"]
        ids, ends = shard.matrix().decode(), np.cumsum(lengths)
        for i in range(0, len(names), 2000):
            j = min(i + 2000, len(names))
            at = [int(ends[k] - lengths[k]) for k in range(i, j)]
            yield pa.RecordBatch.from_arrays([pa.array(names[i:j], kind), pa.array([start + x for x in at], pa.int64()), pa.array([ids[x : x + int(lengths[i + k])].tobytes() for k, x in enumerate(at)], pa.binary())], ["doc_id", "start", "ids"])

    return over_shards(placed_shards(manifest).select("path", "start"), run, f"doc_id {id_type}, start long, ids binary")


def tokens_at(manifest: DataFrame, positions: list[int]) -> DataFrame:
    """position, token for each of these positions in the whole sequence of all files; one beyond it gives no row."""
    import pyarrow as pa

    def run(shard: Shard, row: dict) -> Iterator[pa.RecordBatch]:
        matrix = shard.matrix()
        yield pa.RecordBatch.from_pydict({"position": pa.array(row["wanted"], pa.int64()), "token": pa.array([matrix.access(p - row["start"]) for p in row["wanted"]], pa.int64())})

    mine = F.filter(F.array(*[F.lit(p).cast("long") for p in sorted(set(positions))]), lambda p: (p >= F.col("start")) & (p < F.col("start") + F.col("n_tokens")))
    return over_shards(placed_shards(manifest).select("path", "start", mine.alias("wanted")).where("size(wanted) > 0"), run, "position long, token long")


def token_counts(manifest: DataFrame, tokens: list[int]) -> DataFrame:
    """token, n: how often each of these stands in all files."""
    import pyarrow as pa

    wanted = sorted(set(tokens))

    def run(shard: Shard, row: dict) -> Iterator[pa.RecordBatch]:
        matrix = shard.matrix()
        yield pa.RecordBatch.from_pydict({"token": pa.array(wanted, pa.int64()), "n": pa.array([matrix.count(t) for t in wanted], pa.int64())})

    return over_shards(manifest.select("path"), run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def token_positions(manifest: DataFrame, token: int) -> DataFrame:
    """position of every occurrence of token in the whole sequence of all files."""
    import pyarrow as pa

    def run(shard: Shard, row: dict) -> Iterator[pa.RecordBatch]:
        matrix = shard.matrix()
        found = [row["start"] + matrix.occurrence(token, k) for k in range(matrix.count(token))]
        yield pa.RecordBatch.from_pydict({"position": pa.array(found, pa.int64())})

    return over_shards(placed_shards(manifest).select("path", "start"), run, "position long")


def shard_report(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    read = read_shards(write_shards(docs, tokenizer, end_id), docs.schema["doc_id"].dataType.simpleString())
    return read.select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
