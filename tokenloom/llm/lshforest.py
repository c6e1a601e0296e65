"""Jaccard join over word shingles: a MinHash LSH forest for candidates, exact verification, classes.

Each tree labels a text with DEEPEST MinHash values.  A tree's labels are sorted, so that its prefix trie lies
in order and a text's longest matched prefix is the longer of what it shares with its two neighbours.  The
search starts at whole labels: texts below one node of a trie are candidates.  Each found pair of likeness s
stands for 1 / (1 - (1 - s^depth)^trees) pairs, which tells what share has been found; while that is below the
target, the prefixes are shortened to the longest depth that is expected to reach it, and the pairs that are
new there are verified.  The last depth is that at which every pair at the threshold itself is found with the
target probability, so a shorter prefix is never needed.

Equal texts are one node.  A pair is verified once: at the longest of the depths searched at which it shares a
prefix, in the first tree where it does.  Nodes with more than BLOCK texts are cut into blocks, which are
written once; a unit of work names two of them, so no pair is ever a row, no text is sent more than once per
node, and no task holds more than two blocks."""
from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, integral, join_hot, key_of, map_arrow, materialize, new_path, read_file, text_of, write_file
from .graph import components
from .tokens import release, texts_of

SHINGLE, THRESHOLD, TARGET, TREES, DEEPEST, BLOCK = 5, 0.8, 0.9995, 20, 8, 512
#: Likenesses from the threshold to 1 are counted in so many bins.
BINS = 20
#: Bytes of a label's value.
WIDE = 2
_MIX = np.uint64(0x9E3779B97F4A7C15)


def chance(likeness: float, depth: int, trees: int = TREES) -> float:
    """The probability that a pair shares a prefix of this depth in one of the trees."""
    return 1 - (1 - likeness**depth) ** trees


def last_depth(threshold: float = THRESHOLD, target: float = TARGET, trees: int = TREES, deepest: int = DEEPEST) -> int:
    """The longest prefix that still finds a pair at the threshold with the target probability."""
    for depth in range(deepest, 0, -1):
        if chance(threshold, depth, trees) >= target:
            return depth
    raise ValueError("too few trees for this recall")


def expected(bins: list[int], depth: int, wanted: int, threshold: float, trees: int) -> float:
    """The share of all pairs that depth `wanted` is expected to find, by the pairs (per bin of likeness) that `depth` found."""
    edges = [threshold + (1 - threshold) * b / len(bins) for b in range(len(bins))]
    stand_for = [n / chance(s, depth, trees) for n, s in zip(bins, edges, strict=True)]
    return sum(w * chance(s, wanted, trees) for w, s in zip(stand_for, edges, strict=True)) / sum(stand_for)


def next_depth(bins: list[int], depth: int, last: int, threshold: float, target: float, trees: int) -> int:
    """The longest depth, from this one on, that is expected to reach the target; without any pair to go by, the last."""
    if not sum(bins):
        return last
    return next((d for d in range(depth, last, -1) if expected(bins, depth, d, threshold, trees) >= target), last)


class Shingler:
    """Sorted distinct hashes of the n-word shingles of a text; fewer words but one are one shingle."""

    def __init__(self, n: int = SHINGLE):
        import re

        from xxhash import xxh64_intdigest

        self.n, self.words, self.hash, self.known = n, re.compile(r"[^\x20\x09-\x0D]+").findall, xxh64_intdigest, {}

    def __call__(self, text: str) -> np.ndarray:
        words = self.words(text)
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > 500_000:
            self.known.clear()
        known = self.known
        for w in set(words):
            if w not in known:
                known[w] = self.hash(w.encode("utf-8", "surrogatepass"))
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = (out ^ h[k : len(h) - n + 1 + k]) * _MIX
            out ^= out >> np.uint64(29)
        return np.unique(out)


def permutations(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def label_of(shingles: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> bytes:
    """The MinHash values of all trees, one after the other, WIDE bytes of each."""
    least, short = np.full(len(factors), np.iinfo(np.uint32).max, np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 512):
        least = np.minimum(least, (short[i : i + 512, None] * factors + offsets).min(axis=0))
    return (least * np.uint32(0x9E3779B1) >> np.uint32(16)).astype("<u2").tobytes()  # minima are small numbers: mix them


def text_id(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def signatures(rows: DataFrame, trees: int, deepest: int, n: int) -> DataFrame:
    """_id, _k, h and labels (null for a text without words) of rows (_id, _k, h, _text)."""
    import pyarrow as pa

    factors, offsets = permutations(deepest * trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        shingles = Shingler(n)
        for batch in batches:
            sets = (shingles(text) for text in texts_of(batch.column(3)))
            labels = [label_of(s, factors, offsets) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(labels, pa.binary())], ["_id", "_k", "h", "labels"])

    return map_arrow(rows.select("_id", "_k", "h", "_text"), run, f"_id {rows.schema['_id'].dataType.simpleString()}, _k long, h binary, labels binary")


def matched_prefixes(texts: DataFrame, trees: int, deepest: int, last: int) -> DataFrame:
    """The sorted tries: t, label, h, reach for each text and tree whose longest matched prefix (reach) is `last` or more.

    The labels are ranged and sorted by tree, label and text, so that a label that many texts have fills as many
    partitions as it needs.  A row meets its neighbours as the partition streams by; at a partition's ends, where
    one is not seen, the whole label is taken as matched (nodes of one text are left out later)."""
    import pyarrow as pa

    wide = WIDE * deepest
    rows = texts.select("h", F.expr(f"posexplode(transform(sequence(0, {trees - 1}), i -> substring(labels, i * {wide} + 1, {wide}))) as (t, label)"))
    rows = rows.repartitionByRange("t", "label", "h").sortWithinPartitions("t", "label", "h").select("t", "label", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, deepest  # the batch before, and what its first row shares with the row before it

        def values(batch):
            trees_ = batch.column(0).to_numpy()
            return trees_, np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(len(trees_), deepest)

        def shared(t, label):  # of each row with the next
            same = np.cumprod(label[1:] == label[:-1], axis=1).sum(axis=1)
            return np.where(t[1:] == t[:-1], same, 0)

        def out(batch, inner, before, after):
            reach = np.maximum(np.append(before, inner), np.append(inner, after))
            found = batch.append_column("reach", pa.array(reach, pa.int32()))
            return found.filter(pa.array(reach >= last))

        for batch in batches:
            if not batch.num_rows:
                continue
            t, label = values(batch)
            if held is not None:
                old, (ot, ol) = held, values(held)
                joint = int(shared(np.append(ot[-1:], t[:1]), np.concatenate((ol[-1:], label[:1])))[0])
                yield out(old, shared(ot, ol), before, joint)
                before = joint
            held = batch
        if held is not None:
            yield out(held, shared(*values(held)), before, deepest)

    return materialize(map_arrow(rows, run, "t int, label binary, h binary, reach int"), "tries")


def prefix_keys(labels: np.ndarray, depth: int) -> np.ndarray:
    """For each text (row of texts x trees x deepest) and tree a hash of the first depth values."""
    key = np.zeros(labels.shape[:2], np.uint64)
    for k in range(depth):
        key = (key ^ labels[:, :, k]) * _MIX
        key ^= key >> np.uint64(31)
    return key


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """How many shingles sets[left] x sets[right] share, exact; only where wanted if that is rare."""
    shared = np.zeros((len(left), len(right)), np.float32)
    i, j = np.nonzero(wanted)
    if len(i) <= 2 * (len(left) + len(right)):
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            a, b = sets[left[x]], sets[right[y]]
            shared[x, y] = (a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum()
        return shared
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values = np.concatenate(sets)
    order = values.argsort(kind="stable")
    values, owner = values[order], owner[order]
    start = np.concatenate(([True], values[1:] != values[:-1]))
    term = start.cumsum() - 1
    often = np.bincount(term)[term] > 1  # a shingle of one set alone is shared with none
    term, owner = term[often], owner[often]
    _, term = np.unique(term, return_inverse=True)
    terms = int(term[-1]) + 1 if len(term) else 0
    width = max(1, min(terms, 8_000_000 // len(sets)))
    cuts = np.searchsorted(term, np.arange(0, terms + width, width))
    for k in range(len(cuts) - 1):
        part = slice(cuts[k], cuts[k + 1])
        grid = np.zeros((len(sets), width), np.float32)
        grid[owner[part], term[part] - k * width] = 1
        shared += grid[left] @ grid[right].T
    return shared


class Texts:
    """Texts of a node, or of a block of it: their ids, labels and sorted shingles."""

    def __init__(self, ids: list[bytes], labels: list[bytes], shingles: list[bytes], trees: int, deepest: int):
        self.ids, self.sets = ids, [np.frombuffer(s, np.uint64) for s in shingles]
        self.labels = np.frombuffer(b"".join(labels), "<u2").reshape(len(ids), trees, deepest).astype(np.uint64)

    def __add__(self, other: Texts) -> Texts:
        out = Texts.__new__(Texts)
        out.ids, out.sets, out.labels = self.ids + other.ids, self.sets + other.sets, np.concatenate((self.labels, other.labels))
        return out


def links_between(texts: Texts, left: np.ndarray, right: np.ndarray, tree: int, depth: int, before: int | None, threshold: float) -> tuple[list[tuple[bytes, bytes, int]], np.ndarray]:
    """(id, root: a text of these that it hangs together with, links) of linked texts, and the pairs per bin of likeness."""
    keys = prefix_keys(texts.labels, depth)
    new = left[:, None] < right[None, :] if left is right else np.ones((len(left), len(right)), bool)
    for t in range(tree):  # pairs that meet in an earlier tree are looked at there
        new &= keys[left, t][:, None] != keys[right, t][None, :]
    if before is not None:  # and those that shared a longer prefix were before
        longer = prefix_keys(texts.labels, before)
        for t in range(longer.shape[1]):
            new &= longer[left, t][:, None] != longer[right, t][None, :]
    bins = np.zeros(BINS, np.int64)
    if not new.any():
        return [], bins
    sizes = np.array([len(s) for s in texts.sets])
    shared = intersections(texts.sets, left, right, new)
    union = sizes[left][:, None] + sizes[right][None, :] - shared
    i, j = np.nonzero(new & (shared >= threshold * union - 1e-6))
    np.add.at(bins, np.clip(((shared[i, j] / union[i, j] - threshold) / (1 - threshold) * BINS).astype(int), 0, BINS - 1), 1)
    i, j = left[i], right[j]
    links, parent = np.zeros(len(texts.ids), int), list(range(len(texts.ids)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    np.add.at(links, i, 1), np.add.at(links, j, 1)
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(texts.ids[x], texts.ids[top(x)], int(links[x])) for x in np.flatnonzero(links).tolist()], bins


LINKS = "h binary, root binary, links long, bins array<long>"


def link_batch(found: list[tuple], bins: np.ndarray):
    """A batch of LINKS: the linked texts, and a row without text that has the pairs per bin."""
    import pyarrow as pa

    columns = zip(*[(*x, None) for x in found], (None, None, 0, bins.tolist()), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, (pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["h", "root", "links", "bins"])


def verify(members: DataFrame, shape: tuple[int, int], depth: int, before: int | None, threshold: float) -> DataFrame:
    """LINKS among the texts of each node; members (t, key, h, labels, shingles) come sorted by node, and a task holds one at a time."""

    def run(batches: Iterator) -> Iterator:
        now, rows, out, bins = None, [], [], np.zeros(BINS, np.int64)

        def solve():
            if len(rows) < 2:
                return
            texts, every = Texts(*map(list, zip(*rows, strict=True)), *shape), np.arange(len(rows))
            found, counted = links_between(texts, every, every, now[0], depth, before, threshold)
            out.extend(found)
            bins.__iadd__(counted)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for node, row in zip(zip(*columns[:2], strict=True), zip(*columns[2:], strict=True), strict=True):
                if node != now:
                    solve()
                    now, rows = node, []
                    if len(out) > 5000:
                        yield link_batch(out, bins)
                        out.clear()
                        bins[:] = 0
                rows.append(row)
        solve()
        yield link_batch(out, bins)

    rows = members.repartition("t", "key").sortWithinPartitions("t", "key")
    return map_arrow(rows.select("t", "key", "h", "labels", "shingles"), run, LINKS)


def write_blocks(members: DataFrame) -> DataFrame:
    """Writes each block of large nodes (t, key, block, h, labels, shingles) as a file; t, key, block, path."""
    import pyarrow as pa

    where = new_path(members.sparkSession, "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def flush():
            t, key, block = now
            name, out = f"{where}/{t}-{key.hex()}-{block}", io.BytesIO()
            table = pa.table({n: pa.array(c, pa.binary()) for n, c in zip(("h", "labels", "shingles"), zip(*rows, strict=True), strict=True)})
            with pa.ipc.new_stream(out, table.schema) as sink:
                sink.write_table(table)
            write_file(name, [out.getvalue()])
            return pa.RecordBatch.from_arrays([pa.array([x], y) for x, y in zip((t, key, block, name), (pa.int32(), pa.binary(), pa.int32(), pa.string()), strict=True)], ["t", "key", "block", "path"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for block, row in zip(zip(*columns[:3], strict=True), zip(*columns[3:], strict=True), strict=True):
                if block != now:
                    if rows:
                        yield flush()
                    now, rows = block, []
                rows.append(row)
        if rows:
            yield flush()

    rows = members.repartition("t", "key", "block").sortWithinPartitions("t", "key", "block").select("t", "key", "block", "h", "labels", "shingles")
    return materialize(map_arrow(rows, run, "t int, key binary, block int, path string"), "block-names")


def verify_blocks(blocks: DataFrame, shape: tuple[int, int], depth: int, before: int | None, threshold: float) -> DataFrame:
    """LINKS among the texts of nodes whose blocks are files: one unit of work for each two blocks of a node."""
    import pyarrow as pa

    other = blocks.select("t", "key", F.col("block").alias("other"), F.col("path").alias("other_path"))
    units = blocks.join(other, ["t", "key"]).where("block <= other").select("t", "path", "other_path")
    n = max(1, min(units.count(), 20_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Texts] = {}

        def texts_in(path: str) -> Texts:
            if path not in held:
                while len(held) > 1:
                    held.pop(next(iter(held)))
                table = pa.ipc.open_stream(read_file(path)).read_all()
                held[path] = Texts(*(table.column(c).to_pylist() for c in ("h", "labels", "shingles")), *shape)
            return held[path]

        for batch in batches:
            for t, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = texts_in(a)
                if a == b:
                    every = np.arange(len(mine.ids))
                    yield link_batch(*links_between(mine, every, every, t, depth, before, threshold))
                else:
                    both = mine + texts_in(b)
                    k = len(mine.ids)
                    yield link_batch(*links_between(both, np.arange(k), np.arange(k, len(both.ids)), t, depth, before, threshold))

    return map_arrow(units.repartition(n, "path", "other_path"), run, LINKS)


def shingle_sets(rows: DataFrame, n: int) -> DataFrame:
    """h, labels, shingles of rows (h, labels, _text)."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        shingles = Shingler(n)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((shingles(t).tobytes() for t in texts_of(batch.column(2))), pa.binary())], ["h", "labels", "shingles"])

    return map_arrow(rows.select("h", "labels", "_text"), run, "h binary, labels binary, shingles binary")


def links_at(tries: DataFrame, sets: DataFrame, shape: tuple[int, int], depth: int, before: int | None, threshold: float) -> DataFrame:
    """LINKS among texts that share a prefix of this depth, and none of the depth searched before."""
    rows = tries.where(F.col("reach") >= depth).select("t", "h", F.expr(f"substring(label, 1, {WIDE * depth})").alias("key"), F.expr(f"substring(label, 1, {WIDE * (before or depth)})").alias("longer"))
    nodes = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("h")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "h")).alias("y"), F.min(F.xxhash64("longer")).alias("z"), F.max(F.xxhash64("longer")).alias("w")).where("n > 1")
    if before:  # one branch alone has nothing new
        nodes = nodes.where("z <> w")
    # nodes with the same texts in several trees: the first does
    kept = materialize(nodes.groupBy("n", "x", "y").agg(F.min(F.struct("t", "key")).alias("b")).select("n", F.col("b.t").alias("t"), F.col("b.key").alias("key")), "nodes")
    members = materialize(join_hot(rows, kept, ["t", "key"], "n").select("t", "key", "n", "h"), "members")
    small = verify(members.where(F.col("n") <= BLOCK).join(sets, "h"), shape, depth, before, threshold)
    if members.where(F.col("n") > BLOCK).limit(1).count():
        block = F.pmod(F.xxhash64(F.lit(2), "h"), F.ceil(F.col("n") / F.lit(BLOCK))).cast("int")
        large = members.where(F.col("n") > BLOCK).withColumn("block", block).join(sets, "h")
        small = small.union(verify_blocks(write_blocks(large), shape, depth, before, threshold))
    return materialize(small, "links")


def forest_links(signed: DataFrame, rows: DataFrame, texts: DataFrame, threshold: float, target: float, trees: int, deepest: int, n: int, trace: list | None = None) -> DataFrame:
    """LINKS of all depths that are searched; trace gets (depth, pairs found so far, share of all that they are expected to be)."""
    last = last_depth(threshold, target, trees, deepest)
    tries = matched_prefixes(texts, trees, deepest, last)
    wanted = tries.select("h").distinct().join(texts.select("h", "labels", "_rep"), "h")
    once = rows.select("h", "_k", "_text").join(wanted, "h").where("_k = _rep").dropDuplicates(["h"])
    sets = materialize(shingle_sets(once, n), "sets")
    depth, before, bins, found = deepest, None, [0] * BINS, None
    while True:
        now = links_at(tries, sets, (trees, deepest), depth, before, threshold)
        found = now if found is None else found.union(now)
        counted = now.where("h is null").agg(*[F.sum(F.col("bins")[b]) for b in range(BINS)]).first()
        bins = [a + (b or 0) for a, b in zip(bins, counted, strict=True)]
        wanted_depth = next_depth(bins, depth, last, threshold, target, trees)
        if trace is not None:
            trace.append((depth, sum(bins), expected(bins, depth, depth, threshold, trees) if sum(bins) else None))
        if wanted_depth == depth:
            return found.where("h is not null").select("h", "root", "links")
        before, depth = depth, wanted_depth


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, target: float = TARGET, trees: int = TREES, n: int = SHINGLE, deepest: int = DEEPEST, trace: list | None = None) -> DataFrame:
    """Per row of docs: _id, _k, h (id of its text), root (a text of its class), _worded, class_id, n_links, n_copies.

    n_links counts the different texts with a Jaccard likeness of the threshold or more; n_copies the rows
    with this very text.  class_id is the least id (null counts as the least) of all rows whose texts are
    equal or linked, directly or over others.  A text without words (null, empty, blank) is like none; its
    class is that of its own id.  Repeated rows are copies.  An empty table gives no rows.  Ids are integers;
    others are refused."""
    integral(docs, id_col)
    rows = docs.select(F.col(id_col).alias("_id"), key_of(id_col).alias("_k"), text_id(text_of(text_col)).alias("h"), text_of(text_col).alias("_text"))
    signed = materialize(signatures(rows, trees, deepest, n), "signatures")
    texts = signed.where("labels is not null").groupBy("h").agg(F.first("labels").alias("labels"), F.min("_k").alias("_rep"), F.count(F.lit(1)).alias("n_copies"))
    texts = materialize(texts, "texts")
    pairs = forest_links(signed, rows, texts, threshold, target, trees, deepest, n, trace)
    links = pairs.groupBy("h").agg(F.sum("links").alias("n_links"))
    roots = components(pairs.select("h", "root"))
    own = texts.select("h", "n_copies", "_rep").join(links, "h", "left").join(roots, "h", "left").select("h", "n_copies", "_rep", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "h").alias("root"))
    own = materialize(own, "own")
    # a text that is its class alone needs no join, and the least id of the others is joined to texts, not to rows
    grouped = own.where("n_links > 0")
    least = materialize(grouped.groupBy("root").agg(F.min("_rep").alias("class_id"), F.count(F.lit(1)).alias("n")), "classes")
    placed = own.where("n_links = 0").select("h", "n_copies", "n_links", "root", F.col("_rep").alias("class_id")).union(join_hot(grouped, least, "root", "n").select("h", "n_copies", "n_links", "root", "class_id"))
    mine = signed.select("_id", "_k", "h", F.col("labels").isNotNull().alias("_worded")).join(placed, "h", "left")
    return mine.select("_id", "_k", "h", F.coalesce("root", "h").alias("root"), "_worded", F.when(F.col("_worded"), F.col("class_id")).otherwise(F.col("_k")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def class_report(docs: DataFrame) -> DataFrame:
    return jaccard_classes(docs).select(F.col("_id").alias("doc_id"), "class_id", "n_links", "n_copies")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each class the document with the least id (then hash of text), with all its columns; of rows that
    repeat it, one.  Texts without words all stay.  Columns may have any names."""
    classes = materialize(jaccard_classes(docs.select("doc_id", "text")), "classes").where("_worded")
    stay = classes.groupBy("root").agg(F.min(F.struct("_k", "h")).alias("s")).select(F.col("s._k").alias("k"), F.col("s.h").alias("h"), F.lit(True).alias("first"))
    wordless = F.regexp_replace(text_of(), BLANKS, "") == ""
    rows = docs.select(key_of("doc_id").alias("k"), text_id(text_of()).alias("h"), wordless.alias("wordless"), F.struct("*").alias("row"))
    if classes.groupBy("_k", "h").count().where("count > 1").limit(1).count():
        once = rows.where("not wordless").join(stay, ["k", "h"]).dropDuplicates(["k", "h"]).select("row.*")
        return once.union(rows.where("wordless").select("row.*"))
    return rows.join(stay, ["k", "h"], "left").where("first or wordless").select("row.*")
