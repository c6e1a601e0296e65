"""One-permutation MinHash with optimal densification and b-bit codes, in built-in expressions only."""
from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, key_of, let, materialize, text_of, words_of

SHINGLE = 5
BIN_BITS = 8
BINS = 1 << BIN_BITS
CODE_BITS = 8
PROBES = 16
#: Codes are kept as signed bytes.
CODE_SHIFT = 1 << (CODE_BITS - 1)


def _ints(values) -> Column:
    return F.expr(f"array({', '.join(map(str, values))})")


def _probe_tables() -> list[Column]:
    """For each attempt, the bin that an empty bin looks at: a random order of all other bins for each bin."""
    orders = []
    for b in range(BINS):
        others = [x for x in range(BINS) if x != b]
        random.Random(b).shuffle(others)
        orders.append(others)
    return [_ints(orders[b][j] for b in range(BINS)) for j in range(PROBES)]


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """Hashes of all n-word shingles; a text with fewer words but one is one shingle, one without has none."""
    def of(w: Column) -> Column:
        size = F.size(w)
        return (
            F.when(size == 0, F.array().cast("array<bigint>"))
            .when(size < n, F.array(F.xxhash64(F.concat_ws(" ", w))))
            .otherwise(F.transform(F.sequence(F.lit(0), size - n), lambda i: F.xxhash64(*[w[i + k] for k in range(n)])))
        )

    return let(words_of(text), of)


def codes_of(text: Column) -> Column:
    """BINS codes of CODE_BITS each, or an empty array for a text without words.

    Each hash falls in the bin of its high bits.  Sorting the hashes together with each bin's largest
    possible value puts a bin's minimum, or that mark of an empty bin, first in the bin.  An empty bin
    takes the value of the first non-empty bin in its own random order of bins."""
    shift = 64 - BIN_BITS
    marks = _ints(f"{((b << shift) | ((1 << shift) - 1))}L" for b in range(-BINS // 2, BINS // 2))
    probes = _probe_tables()

    def minima(s: Column) -> Column:
        first = F.filter(s, lambda h, k: (k == 0) | (F.shiftright(h, shift) != F.shiftright(F.get(s, k - 1), shift)))
        return F.transform(first, lambda h: F.when(h.bitwiseAND(F.lit((1 << shift) - 1)) != F.lit((1 << shift) - 1), h))

    def fill(d: Column) -> Column:
        far = lambda i: F.array_min(F.transform(d, lambda v, b: F.when(v.isNotNull(), F.struct(F.xxhash64(i, b).alias("order"), v.alias("value")))))["value"]
        full = F.transform(d, lambda v, i: F.coalesce(v, *[F.get(d, F.get(p, i)) for p in probes], far(i)))
        return F.transform(full, lambda v: (v.bitwiseAND(F.lit((1 << CODE_BITS) - 1)) - CODE_SHIFT).cast("tinyint"))

    none = F.array().cast("array<tinyint>")
    return let(shingle_hashes(text), lambda h: F.when(F.size(h) == 0, none).otherwise(let(F.sort_array(F.concat(h, marks)), lambda s: let(minima(s), fill))))


def hex_of(codes: Column) -> Column:
    table = F.expr("array(" + ", ".join(f"'{i:02x}'" for i in range(1 << CODE_BITS)) + ")")
    return F.array_join(F.transform(codes, lambda c: F.get(table, c.cast("int") + CODE_SHIFT)), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness: the share of equal codes, corrected for codes that agree by chance.
    Two texts without words are alike (1), one with and one without are not (0)."""
    equal = F.aggregate(F.sequence(F.lit(0), F.lit(BINS - 1)), F.lit(0), lambda n, i: n + F.when(F.get(a, i) == F.get(b, i), 1).otherwise(0))
    chance = 1.0 / (1 << CODE_BITS)
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), (equal / F.lit(float(BINS)) - chance) / (1 - chance)))
    )


def neighbours(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(_k, _next, _need): each id, the next lower id (after the lowest: the highest) and how many of its
    characters the edit needs; and whether an id occurs twice.  Only ids and lengths are moved."""
    half = F.floor(F.char_length(text_of(text_col)) / 2)
    ids = docs.select(key_of(id_col).alias("_k"), half.alias("_need")).groupBy("_k").agg(F.max("_need").alias("_need"), F.count(F.lit(1)).alias("_n"))
    kept = materialize(ids.repartitionByRange(F.col("_k").desc()).withColumn("_pid", F.spark_partition_id()), "ids")
    heads = kept.groupBy("_pid").agg(F.max("_k").alias("_head"))  # a row per partition
    order = Window.orderBy("_pid")
    heads = heads.select("_pid", F.coalesce(F.lead("_head").over(order), F.max("_head").over(Window.partitionBy())).alias("_after"))
    pairs = kept.withColumn("_lead", F.lead("_k").over(Window.partitionBy("_pid").orderBy(F.col("_k").desc()))).join(F.broadcast(heads), "_pid")
    twice = kept.where("_n > 1").limit(1).count() > 0
    return pairs.select("_k", F.coalesce("_lead", "_after").alias("_next"), "_need"), twice


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, codes, edited (codes as bytes), near_edited, next_codes per document.

    The next document is that with the next lower id; a null id is the lowest.  Rows with one id are
    kept each; as someone's next document they count once, with the smallest text.  A null text is
    empty; an empty table gives no rows; other columns are not looked at."""
    rows = docs.select(key_of(id_col).alias("_k"), text_of(text_col).alias("_text"))  # one exchange of texts serves both joins
    pairs, twice = neighbours(docs, id_col, text_col)
    tails = pairs.join(rows.select(F.col("_k").alias("_next"), "_text"), "_next").select(F.col("_k").alias("_own"), F.expr("substring(_text, 1, cast(_need as int))").alias("_tail"), "_next")
    if twice:
        tails = tails.groupBy("_own").agg(F.min("_tail").alias("_tail"), F.max("_next").alias("_next"))
    joined = rows.join(tails, rows["_k"] == tails["_own"])
    n = F.char_length("_text")
    edited = F.expr("concat(substring(_text, 1, char_length(_text) - char_length(_text) div 2), substring(_tail, 1, cast(char_length(_text) div 2 as int)))")
    made = joined.select("_k", "_next", n.cast("long").alias("n_chars"), F.col("_text"), edited.alias("_edited"))
    made = made.select("_k", "_next", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), codes_of(F.col("_text")).alias("codes"), codes_of(F.col("_edited")).alias("_e"))
    made = made.select("_k", "_next", "n_chars", "edited_sha256", "codes", F.unhex(hex_of(F.col("_e"))).alias("edited"), likeness(F.col("codes"), F.col("_e")).alias("near_edited"))
    made = materialize(made, "codes")
    nexts = made.select(F.col("_k").alias("_nk"), F.col("codes").alias("next_codes"))
    if twice:
        nexts = nexts.groupBy("_nk").agg(F.min("next_codes").alias("next_codes"))
    return made.join(nexts, F.col("_next") == F.col("_nk")).select(F.nullif(F.col("_k"), F.lit(NULL_ID)).cast(docs.schema[id_col].dataType).alias("doc_id"), "n_chars", "edited_sha256", "codes", "edited", "near_edited", "next_codes")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    f = fingerprints(docs)
    return f.select(
        "doc_id", "n_chars", "edited_sha256", hex_of(F.col("codes")).alias("fingerprint"), F.lower(F.hex("edited")).alias("edited_fingerprint"),
        "near_edited", likeness(F.col("codes"), F.col("next_codes")).alias("near_next"))
