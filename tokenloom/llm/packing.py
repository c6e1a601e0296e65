"""Packing documents into sequences: linear grouping of the large ones, best fit of the rest.

The plan needs only how many pieces there are of each length (as many numbers as a sequence has tokens).
It keeps sequences as runs: a pattern of lengths and how many sequences look like it.  Large lengths, in
order, are cut into groups of equal cardinality and rounded up to the group's largest; a linear program
over configurations of these few sizes (column generation) is rounded down; the actual pieces take the
places of their group, in order; pieces left over and small ones then go best-fit, longest first."""
from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_names, map_arrow, materialize, ship
from .tokens import encoder

#: (part, groups): pieces longer than capacity / part are large, and in so many groups.  Each is planned
#: and the plan with the fewest sequences holds, of equal ones the first.  The last is best fit alone in all
#: but name (one large piece fills a configuration), and wins only if it needs fewer sequences than the others.
GRAINS = ((4, 96), (6, 96), (2, 48))
#: So many counts (a partition's pieces of a length) are broadcast at most: 16 bytes each and some overhead.
SMALL_BASES = 1_000_000
#: Tokens that a worker hands over together.
FLUSHED = 1 << 20


def group_sizes(large: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """(length, count), longest first, cut into groups of near equal cardinality; a length may be in two."""
    total, out, room = sum(c for _, c in large), [], 0
    if len(large) <= groups:
        return [[x] for x in large]
    each = -(-total // groups)
    for length, count in large:
        while count:
            if not room:
                out.append([])
                room = each
            take = min(count, room)
            out[-1].append((length, take))
            count, room = count - take, room - take
    return out


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and how often each: the linear program, solved until no configuration improves it, rounded down."""
    m = len(sizes)
    if not m:
        return []
    s, d = np.array(sizes), np.array(demand, float)
    columns = [tuple(capacity // sizes[i] if i == j else 0 for j in range(m)) for i in range(m)]
    basis = np.array(columns, float).T
    most = capacity // int(s.min())
    apart = d + np.random.default_rng(0).random(m) * 1e-4  # ties among the ratios could make the pivots go in a circle
    while True:
        inverse = np.linalg.inv(basis)
        price = np.maximum(inverse.sum(axis=0), 0)
        # the most valuable configuration: best[c] over up to `most` pieces, remembered layer by layer
        best, picks = np.zeros(capacity + 1), []
        for _ in range(most):
            offers = np.full((m, capacity + 1), -1.0)
            for i, size in enumerate(sizes):
                offers[i, size:] = best[: capacity + 1 - size] + price[i]
            pick = offers.argmax(axis=0)
            value = offers[pick, np.arange(capacity + 1)]
            better = value > best + 1e-12
            picks.append(np.where(better, pick, -1))
            best = np.where(better, value, best)
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(m), capacity
        for pick in picks[::-1]:
            if pick[room] >= 0:
                column[pick[room]] += 1
                room -= sizes[pick[room]]
        move, now = inverse @ column, inverse @ apart
        ratio = np.where(move > 1e-9, now / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        columns[out] = tuple(int(x) for x in column)
        basis[:, out] = column
    times = np.floor(np.maximum(np.linalg.solve(basis, d), 0) + 1e-6).astype(int)
    left, chosen = np.array(demand), []
    for column, n in sorted(zip(columns, times.tolist(), strict=True), key=lambda x: -x[1]):
        n = min([n, *(int(left[i]) // k for i, k in enumerate(column) if k)])
        if n > 0:
            chosen.append((column, n))
            left = left - n * np.array(column)
    return chosen


def plan(counts: dict[int, int], capacity: int = 2048, grains: tuple[tuple[int, int], ...] = GRAINS) -> list[tuple[list[tuple[int, int]], int]]:
    """The best of the grains' plans."""
    return min((grouped_plan(counts, capacity, *g) for g in grains), key=lambda runs: sum(n for _, n in runs))


def grouped_plan(counts: dict[int, int], capacity: int, part: int, groups: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Runs ([(length, copies), ...], number of sequences) that hold all pieces of counts (length -> pieces)."""
    limit = capacity // part
    large = sorted(((n, c) for n, c in counts.items() if n > limit), reverse=True)
    rest = {n: c for n, c in counts.items() if n <= limit}
    members = group_sizes(large, groups)
    chosen = configurations([g[0][0] for g in members], [sum(c for _, c in g) for g in members], capacity)
    stock = [[list(x) for x in g] for g in members]
    gaps: list[int] = []
    open_runs: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}

    def put(pattern: list[tuple[int, int]], times: int) -> None:
        gap = capacity - sum(n * k for n, k in pattern)
        if gap not in open_runs:
            open_runs[gap] = []
            insort(gaps, gap)
        open_runs[gap].append((pattern, times))

    for column, times in chosen:
        wanted = [(g, k) for g, k in enumerate(column) if k]
        while times:
            many = min([times, *(stock[g][0][1] // k for g, k in wanted)])
            pattern: dict[int, int] = {}
            for g, k in wanted:
                for _ in range(k):
                    head = stock[g][0]
                    pattern[head[0]] = pattern.get(head[0], 0) + 1
                    head[1] -= max(many, 1)
                    if not head[1]:
                        stock[g].pop(0)
            put(list(pattern.items()), max(many, 1))
            times -= max(many, 1)
    for g in stock:
        for length, count in g:
            rest[length] = rest.get(length, 0) + count

    for length, count in sorted(rest.items(), reverse=True):
        while count:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                pattern, times = open_runs[gap].pop()
                if not open_runs[gap]:
                    del open_runs[gap], gaps[at]
            else:
                gap, pattern, times = capacity, [], count
            each = gap // length
            full = min(times, count // each)
            if full:
                put([*pattern, (length, each)], full)
                count -= full * each
                if times > full and pattern:
                    put(pattern, times - full)
            else:
                put([*pattern, (length, count)], 1)
                count = 0
                if times > 1 and pattern:
                    put(pattern, times - 1)
    return [run for gap in gaps for run in open_runs[gap]]


def slots(runs: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, tuple[int, int, int, int, int]]]:
    """(length, (rank of the first, how many, first sequence, copies in each, offset)) for each block of places."""
    out, seen, first = [], {}, 0
    for pattern, times in runs:
        offset = 0
        for length, copies in pattern:
            before = seen.get(length, 0)
            out.append((length, (before, copies * times, first, copies, offset)))
            seen[length] = before + copies * times
            offset += length * copies
        first += times
    return out


def ranks_of(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The rank of each length among the equal ones so far; seen, how many there were of each, is counted on."""
    order = lengths.argsort(kind="stable")
    rank = np.empty(len(lengths), np.int64)
    rank[order] = np.arange(len(lengths)) - np.searchsorted(lengths[order], lengths[order]) + seen[lengths[order]]
    seen += np.bincount(lengths, minlength=len(seen))
    return rank


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids: documents with their end id, only longer ones cut; and place, which pack() takes."""
    import pyarrow as pa

    names = ["doc_id", "piece", "start", "length", "ids", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, encode = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), encoder(tokenizer).encode_column

        def flush(doc: pa.Array, piece: np.ndarray, length: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
            rank = ranks_of(length, seen)
            place = pa.StructArray.from_arrays([pa.array(np.full(len(rank), part, np.int32)), pa.array(rank)], ["part", "rank"])
            at = np.concatenate([[0], np.cumsum(length) * 4]).astype(np.int32)
            ids = pa.Array.from_buffers(pa.binary(), len(rank), [None, pa.py_buffer(at), pa.py_buffer(data.astype("<u4"))])
            return pa.RecordBatch.from_arrays([doc, pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), ids, place], names)

        for batch in batches:
            done = 0
            for counts, ids in encode(batch.column(1)):
                ids, whole = np.insert(ids, np.cumsum(counts), end_id), counts + 1
                pieces = -(-whole // capacity)
                doc = np.repeat(np.arange(len(whole)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                length = np.minimum(whole[doc] - piece * capacity, capacity)
                reach = np.cumsum(length)
                bounds = [0, *(np.flatnonzero(np.diff(reach // FLUSHED)) + 1).tolist(), len(doc)]
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    own = slice(a, b)
                    yield flush(batch.column(0).take(pa.array(doc[own] + done)), piece[own], length[own], ids[reach[a] - length[a] : reach[b - 1]])
                done += len(whole)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, f"doc_id {rows.schema[0].dataType.simpleString()}, piece int, start long, length long, ids binary, place struct<part:int,rank:bigint>")


def pack(pieces: DataFrame, capacity: int = 2048, place: str | None = None) -> DataFrame:
    """pieces (any columns, with length long from 1 to capacity) with sequence_id and offset, and without place:
    the column, if there is one, that has each row's partition and rank among those of its length.

    Pieces of one length are interchangeable, so each needs only its rank among them: its rank inside its
    partition, numbered as the pieces are written, and how many the partitions before have.  Beside that
    one write no piece is moved.  The driver sees one count per length.  The partitions' counts and the
    plan's blocks of places are broadcast up to SMALL_BASES of them, and joined by an exchange beyond."""
    import pandas as pd

    def number(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for lengths in batches:
            rank = ranks_of(lengths.to_numpy(), seen)
            yield pd.DataFrame({"part": np.full(len(rank), part, np.int32), "rank": rank})

    number.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    place_name, base_name, part_name = fresh_names(pieces, "place", "bases", "part")
    ship(pieces.sparkSession)
    kept = pieces.withColumn(place_name, F.pandas_udf(number, "part int, rank long")("length")) if place is None else pieces.withColumnRenamed(place, place_name)
    kept = materialize(kept, "pieces")
    counts = kept.groupBy(F.col(f"{place_name}.part").alias("part"), "length").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "lengths")
    runs = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    bases = bases.groupBy(F.col("part").alias(part_name)).agg(F.map_from_entries(F.collect_list(F.struct("length", "base"))).alias(base_name))
    few = counts.select("part", "length").limit(SMALL_BASES + 1).count() <= SMALL_BASES
    based = kept.join(F.broadcast(bases) if few else bases, F.col(f"{place_name}.part") == F.col(part_name))

    at_name, seat_name, rank = *fresh_names(based, "at", "seat"), F.col(base_name)[F.col("length")] + F.col(f"{place_name}.rank")
    seats = pieces.sparkSession.createDataFrame(slots(runs), f"{at_name} long, `{seat_name}` struct<first:long,n:long,base:long,copies:long,offset:long>")
    seated = based.withColumn(base_name, rank).join(F.broadcast(seats) if seats.count() <= SMALL_BASES else seats, (F.col("length") == F.col(at_name)) & (F.col(base_name) >= F.col(f"{seat_name}.first")) & (F.col(base_name) < F.col(f"{seat_name}.first") + F.col(f"{seat_name}.n")))
    inner = F.col(base_name) - F.col(f"{seat_name}.first")
    sequence = F.col(f"{seat_name}.base") + F.expr(f"({base_name} - {seat_name}.first) div {seat_name}.copies")
    offset = F.col(f"{seat_name}.offset") + inner % F.col(f"{seat_name}.copies") * F.col("length")
    return seated.select(*[F.col(f"`{c}`") for c in pieces.columns if c != place], sequence.alias("sequence_id"), offset.alias("offset"))


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (of the packed ids), ids, sequence_id, offset.

    A null or empty text is one piece with the end id alone.  Repeated rows are packed each; an empty table
    gives no rows; other columns are not looked at."""
    packed = pack(tokenized_pieces(docs, tokenizer, capacity, end_id), capacity, "place")
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "ids", "sequence_id", "offset")


def packed_report(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """packed_documents with the ids packed, but for their sum not given out."""
    return packed_documents(docs, tokenizer, capacity, end_id).drop("ids")
