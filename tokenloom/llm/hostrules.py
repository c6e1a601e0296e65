"""Quality rules decided with the host: failure rates by rule and host, shrunk by empirical beta priors."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, let, materialize, text_of, words_of

#: A host is rejected if its shrunk rate of documents that fail a rule, or any rule, exceeds this.
HOST_LIMIT = 0.5
RULES = ("short", "repeats", "symbols", "dup_lines")
#: Weight of the prior, in documents, where the hosts' rates don't vary more than chance.
FLAT_PRIOR = 100.0
#: So many host names are broadcast at most.
FEW_HOSTS = 100_000
SYMBOLS = "#*$%&|<>"


def repeat_words(words: Column, n: int = 5) -> Column:
    """Words inside n-word windows that occur twice or more in the text, the first included.

    Windows are hashed; only a text with two equal hashes is looked at again, then with the windows
    themselves sorted next to each other, so that a chance collision of hashes counts nothing."""
    size = F.size(words)
    starts = F.sequence(F.lit(0), size - n)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[words[i + k] for k in range(n)]))

    def covered(w: Column, h: Column) -> Column:
        grams = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), F.slice(w, i + 1, n).alias("g"), i.alias("i"))))

        def places(s: Column) -> Column:
            last = F.size(s) - 1
            same = lambda a, k: F.coalesce((a["h"] == F.get(s, k)["h"]) & (a["g"] == F.get(s, k)["g"]), F.lit(False))
            return F.array_sort(F.transform(F.filter(s, lambda a, k: ((k > 0) & same(a, k - 1)) | ((k < last) & same(a, k + 1))), lambda a: a["i"]))

        def cover(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(n), F.coalesce(F.get(p, k + 1) - x, F.lit(n)))), F.lit(0), lambda a, b: a + b)

        return let(grams, lambda s: let(places(s), cover))

    return F.when(size <= n, F.lit(0)).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(words, h)))).cast("long")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", keep: list[str] = ()) -> DataFrame:
    """Per document: _id, _host, _n_words, _chars, _symbols, _dup_lines, _repeat_words, _rules (which of RULES it fails), _base_failed, and keep.

    All in built-in expressions.  A null or empty text has no words and so fails."""
    text = text_of(text_col)
    worded = F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, BLANKS, "") != "")
    found = docs.select(*[F.col(c) for c in keep], F.col(id_col).alias("_id"), F.col(host_col).alias("_host"), let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"))).alias("_w"),
        F.char_length(F.regexp_replace(text, BLANKS, "")).cast("long").alias("_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("_symbols"),
        let(worded, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("_l"),
    )
    n, repeated = F.col("_w.n_words"), F.col("_w.n_repeat_words")
    found = found.select(*[F.col(c) for c in keep], F.col("_id"), F.col("_host"), n.alias("_n_words"), F.col("_chars"), F.col("_symbols"), F.col("_l.dup").alias("_dup_lines"), repeated.alias("_repeat_words"), F.struct(
        (n < 10).alias("short"), (100 * repeated > 20 * n).alias("repeats"), (F.col("_symbols") * 10 > n).alias("symbols"), (F.col("_l.dup") * 10 > F.col("_l.n") * 3).alias("dup_lines")).alias("_rules"))
    return found.withColumn("_base_failed", F.col("_rules.short") | F.col("_rules.repeats"))


def host_verdicts(measured: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """Per host: n, rates (failures, rate and shrunk rate for each rule and for any), rejected.  A document without
    host counts to the host null.

    Each rule's beta prior has the mean of all documents and the weight by which the hosts' rates vary beyond
    chance (moments, weighted by documents); the priors are two numbers each, so they are cross-joined as one row."""
    fails = {r: F.col(f"_rules.{r}") for r in RULES} | {"any": F.exists(F.array(*[F.col(f"_rules.{r}") for r in RULES]), lambda x: x)}
    hosts = measured.groupBy("_host").agg(F.count(F.lit(1)).alias("n"), *[F.sum(x.cast("long")).alias(r) for r, x in fails.items()])
    moments = hosts.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"), *[x for r in fails for x in (F.sum(r).alias(f"{r}_sum"), F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"{r}_square"))])

    def prior(rule: str) -> Column:
        mean = F.col(f"{rule}_sum") / F.col("all")
        between, by_chance = F.col(f"{rule}_square") / F.col("all") - mean * mean, mean * (1 - mean) * F.col("k") / F.col("all")
        weight = F.when((between > by_chance) & (mean * (1 - mean) > between), F.greatest(F.lit(1.0), mean * (1 - mean) / (between - by_chance) - 1)).otherwise(F.lit(FLAT_PRIOR))
        return F.struct(mean.alias("mean"), weight.alias("weight")).alias(f"{rule}_prior")

    joined = hosts.crossJoin(F.broadcast(moments.select(*[prior(r) for r in fails])))
    shrunk = lambda r: (F.col(r) + F.col(f"{r}_prior.mean") * F.col(f"{r}_prior.weight")) / (F.col("n") + F.col(f"{r}_prior.weight"))
    rates = F.struct(*[F.struct(F.col(r).alias("fails"), (F.col(r) / F.col("n")).alias("rate"), shrunk(r).alias("shrunk")).alias(r) for r in fails])
    return joined.select("_host", "n", rates.alias("rates"), F.greatest(*[shrunk(r) for r in fails]).alias("worst")).withColumn("rejected", F.col("worst") > limit)


def judge(measured: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """measured with `_kept`: neither base_failed nor of a rejected host.

    Only rejected hosts are joined back, broadcast while they are at most FEW_HOSTS, so that no text moves;
    beyond that Spark splits a hot host's rows over tasks (adaptive skew join)."""
    bad = materialize(host_verdicts(measured, limit).where("rejected").select(F.col("_host").alias("_bad_host"), F.lit(True).alias("_bad")), "hosts")
    few = bad.limit(FEW_HOSTS + 1).count() <= FEW_HOSTS
    joined = measured.join(F.broadcast(bad) if few else bad, F.col("_host").eqNullSafe(F.col("_bad_host")), "left")
    return joined.withColumn("_kept", ~F.col("_base_failed") & F.col("_bad").isNull()).drop("_bad", "_bad_host")


def quality_report(docs: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """One row per document with the base counts and the verdict.  Repeated rows are judged each; an empty
    table gives no rows; columns beyond doc_id, text and source are not looked at."""
    measured = materialize(measure(docs), "measured")
    return judge(measured, limit).select(
        F.col("_id").alias("doc_id"), F.col("_n_words").alias("n_words"), F.col("_chars").alias("word_chars"), F.col("_symbols").alias("n_symbols"),
        F.col("_dup_lines").alias("n_dup_lines"), F.col("_repeat_words").alias("n_repeat_words"), F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def keep_good(docs: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """The documents that pass, with all their columns.  The texts that pass the base rules are written once
    with their measures; the host verdict is joined to them without moving a text.  Columns may have any names;
    repeated rows are judged each, and an empty table gives no rows."""
    m = measure(docs.select("doc_id", "text", "source", F.struct("*").alias("row")), keep=["row"])
    slim = m.select(F.when(~F.col("_base_failed"), F.col("row")).alias("row"), "_host", "_base_failed", "_rules")
    return judge(materialize(slim, "measured"), limit).where("_kept").select("row.*")
