"""Repeated passages removed by winnowing over line hashes.

A gram is the shortest run of lines from a line on with at least gram_words words, a window the shortest
with at least pass_words.  Of each window the gram with the least hash is a fingerprint, so two equal runs
of pass_words words or more share one in each window.  Around equal fingerprints runs are compared that just
reach pass_words words, from their first line on or from their last line back; any longer common run is made
up of such.  The lines of a run are deleted if an equal run comes earlier in order of document and line, so
what is shared in runs of fewer words stays."""
from __future__ import annotations

from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, integral, join_hot, key_of, map_arrow, materialize, text_of
from .tokens import release, texts_of

PASS_WORDS = 50
GRAM_WORDS = 25


def ends(counts: list[int], least: int) -> list[int]:
    """For each line the end (exclusive) of the shortest run from it with least words, or -1."""
    out, end, total = [], 0, 0
    for i, count in enumerate(counts):
        while end < len(counts) and total < least:
            total += counts[end]
            end += 1
        out.append(end if total >= least else -1)
        total -= count
    return out


def winnow(hashes: list[bytes], counts: list[int], pass_words: int, gram_words: int, digest) -> dict[int, bytes]:
    """Fingerprints: first line of the gram -> hash of the gram."""
    grams, windows = ends(counts, gram_words), ends(counts, pass_words)
    known: dict[int, bytes] = {}
    chosen: dict[int, bytes] = {}
    for start, stop in enumerate(windows):
        if stop < 0:
            break
        best = None
        for p in range(start, stop):
            if not 0 < grams[p] <= stop:
                break
            if p not in known:
                known[p] = digest(b"".join(hashes[p : grams[p]]))
            if best is None or known[p] < known[best]:
                best = p
        chosen[best] = known[best]
    return chosen


def line_table(docs: DataFrame, pass_words: int, gram_words: int) -> DataFrame:
    """Per text with fingerprints: _k, _t (its key), lines (numbers of its lines with words), hashes, counts, prints."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("at", pa.int32()), ("gram", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest as digest

        release()
        for batch in batches:
            rows = []
            for k, t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), strict=True):
                lines, hashes, counts = array("i"), [], []
                for i, line in enumerate(text.split("\n")):
                    if n := len(line.split()):
                        lines.append(i), hashes.append(digest(line.strip().encode())), counts.append(n)
                prints = winnow(hashes, counts, pass_words, gram_words, digest)
                if prints:
                    rows.append((k, t, lines.tobytes(), b"".join(hashes), array("i", counts).tobytes(), [{"at": p, "gram": g} for p, g in prints.items()]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), kind), strict=True)], ["_k", "_t", "lines", "hashes", "counts", "prints"])

    return map_arrow(docs.select("_k", "_t", "_text"), run, "_k long, _t long, lines binary, hashes binary, counts binary, prints array<struct<at:int,gram:binary>>")


def runs_around(counts: list[int], prints: list[int], pass_words: int, gram_words: int) -> set[tuple[int, int]]:
    """Runs (first line, end) of just pass_words words, counted from either side, with the gram of one of prints."""
    n = len(counts)
    grams, windows = ends(counts, gram_words), ends(counts, pass_words)
    starts = [n - e if e >= 0 else -1 for e in reversed(ends(counts[::-1], pass_words))]  # by last line
    out = set()
    for p in prints:
        first, last = p, grams[p] - 1
        while first >= 0 and (windows[first] < 0 or windows[first] > last):
            if windows[first] > 0:
                out.add((first, windows[first]))
            first -= 1
        while last < n and starts[last] <= p:
            if starts[last] >= 0:
                out.add((starts[last], last + 1))
            last += 1
    return out


def extended(table: DataFrame, pass_words: int, gram_words: int) -> DataFrame:
    """A row for each run of pass_words words around a shared fingerprint: _k, _t, line (its first), lines (numbers of
    its lines), and run, which is equal where the lines are."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest as digest

        release()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for k, t, lines, hashes, counts, shared in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                number = array("i", lines)
                for at, end in runs_around(array("i", counts).tolist(), shared, pass_words, gram_words):
                    out[0].append(k), out[1].append(t), out[2].append(number[at]), out[3].append(number[at:end]), out[4].append(digest(hashes[16 * at : 16 * end]))
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary()), strict=True)], ["_k", "_t", "line", "lines", "run"])

    return map_arrow(table.select("_k", "_t", "lines", "hashes", "counts", "shared"), run, "_k long, _t long, line int, lines array<int>, run binary")


def repeated_lines(keyed: DataFrame, pass_words: int = PASS_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """_k, _t, gone (numbers of the lines to delete) of the texts in keyed (_k, _t, _text) that lose any.

    Each hash is grouped to its first occurrence before anything is joined, so a passage that a third of
    the texts share costs rows in proportion to its copies, never pairs of them."""
    table = materialize(line_table(keyed, pass_words, gram_words), "lines")
    prints = table.select("_k", "_t", F.explode("prints").alias("p")).select("_k", "_t", F.col("p.at").alias("at"), F.col("p.gram").alias("gram"))
    many = materialize(prints.groupBy("gram").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "grams")
    shared = join_hot(prints, many, "gram", "_n").groupBy("_k", "_t").agg(F.array_sort(F.collect_set("at")).alias("shared"))
    reached = materialize(extended(table.join(shared, ["_k", "_t"]), pass_words, gram_words), "reached")
    place = F.struct("_k", "_t", "line")
    first = materialize(reached.groupBy("run").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1"), "firsts")
    return join_hot(reached, first, "run", "_n").where(place != F.col("first")).groupBy("_k", "_t").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("gone"))


def freed(docs: DataFrame, id_col: str, text_col: str, pass_words: int, gram_words: int) -> DataFrame:
    """row (all columns of docs), text (what is left), n_lines, n_gone per row of docs."""
    integral(docs, id_col)
    keys = [key_of(id_col).alias("_k"), F.xxhash64(text_of(text_col)).alias("_t")]
    gone = repeated_lines(docs.select(*keys, text_of(text_col).alias("_text")), pass_words, gram_words)
    joined = docs.select(*keys, F.struct("*").alias("row")).join(gone, ["_k", "_t"], "left")
    text = F.col(f"row.`{text_col}`")
    lines = F.split(text, "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)), "\n")
    left = F.when(F.col("gone").isNull(), text).when(F.regexp_replace(left, BLANKS, "") == "", F.lit("")).otherwise(left)
    return joined.select("row", left.alias("text"), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_gone"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pass_words: int = PASS_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """docs with text_col freed of later repeats, and n_lines, n_gone (lines deleted) beside it.

    The order is that of id (null first), then of a hash of the text, then of lines.  Lines are compared
    without blanks around them; lines without words are passed over, and stay.  A text that loses all its
    words is empty.  Rows that repeat id and text are one text in the comparison, and keep the same lines;
    a null text stays null.  An empty table gives no rows.  n_lines and n_gone replace columns of that name;
    other columns may have any names.  Ids are integers; others are refused."""
    cols = [c for c in docs.columns if c.lower() not in ("n_lines", "n_gone")]
    made = freed(docs, id_col, text_col, pass_words, gram_words)
    return made.select(*[F.col("text" if c == text_col else f"row.`{c}`").alias(c) for c in cols], "n_lines", "n_gone")


def dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, text (what is left), n_lines, n_gone per document."""
    return drop_repeated_lines(docs.select("doc_id", "text")).select("doc_id", "text", "n_lines", "n_gone")


def dedup_documents(docs: DataFrame) -> DataFrame:
    """docs without their later repeats; n_chars, where there is one, counts what is left.  A document whose
    words are all repeats is dropped; one that had no words before stays.  Columns may have any names."""
    made = freed(docs, "doc_id", "text", PASS_WORDS, GRAM_WORDS)
    made = made.where((F.col("n_gone") == 0) | (F.coalesce("text", F.lit("")) != ""))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_gone") == 0, F.col("row.n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType)
    return made.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
