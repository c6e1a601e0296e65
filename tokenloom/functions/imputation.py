"""Token counts made up where a source has only a total, or only text."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shares of input, output, cache read, cache write and reasoning in a total of unknown make-up.
SHARES = [2_182_896_619, 112_659_190, 24_546_162_069, 104_142_575, 35_553_511]


def estimate(text: Column) -> Column:
    """A token for each four characters begun."""
    return F.ceil(F.char_length(F.coalesce(text, F.lit(""))) / 4).cast("bigint")


def largest_remainder(df: DataFrame, total: str, weights: list[int]) -> DataFrame:
    """df with `parts`: the total split by weights; what flooring leaves goes to the largest remainders, the
    earlier part first among equals.  Array functions only, so rows are neither exploded nor shuffled."""
    whole = sum(weights)
    t = F.col(total).cast("decimal(38,0)")
    cells = F.array(*[F.struct(F.floor(t * w / whole).cast("bigint").alias("f"), (-(t * w % whole)).cast("bigint").alias("r"), F.lit(i).alias("i")) for i, w in enumerate(weights)])
    floors = F.transform("_cells", lambda c: c["f"])
    rest = F.col(total) - F.aggregate("_floors", F.lit(0).cast("bigint"), lambda a, b: a + b)
    ranked = F.transform(F.array_sort(F.transform("_cells", lambda c: F.struct(c["r"].alias("r"), c["i"].alias("i")))), lambda x: x["i"])
    made = df.withColumn("_cells", cells).withColumn("_floors", floors).withColumn("_rest", rest).withColumn("_order", ranked)
    parts = F.transform("_floors", lambda f, i: f + (F.array_position("_order", i) <= F.col("_rest")).cast("bigint"))
    return made.withColumn("parts", parts).drop("_cells", "_floors", "_rest", "_order")


def allocate_batch(totals: list[int], weights: list[int]) -> list[list[int]]:
    """Rows and columns both exact: each row sums to its total, each column to the split of the grand total.

    Rows give what flooring left them in order of how much that is; each takes one for the buckets with the
    most room, then the largest own remainder, then the first."""
    whole = sum(weights)
    rows = [[t * w // whole for w in weights] for t in totals]
    spare = [t - sum(r) for t, r in zip(totals, rows, strict=True)]
    grand = split_total(sum(totals), weights)
    room = [g - sum(r[i] for r in rows) for i, g in enumerate(grand)]
    for n in sorted(range(len(totals)), key=lambda n: (-spare[n], n)):
        rank = sorted(range(len(weights)), key=lambda i: (-room[i], -(totals[n] * weights[i] % whole), i))
        for i in [i for i in rank if room[i] > 0][: spare[n]]:
            rows[n][i] += 1
            room[i] -= 1
    return rows


def split_total(total: int, weights: list[int]) -> list[int]:
    whole = sum(weights)
    parts = [total * w // whole for w in weights]
    for i in sorted(range(len(weights)), key=lambda i: (-(total * weights[i] % whole), i))[: total - sum(parts)]:
        parts[i] += 1
    return parts
