"""Profiles: statistics of all columns of a table in one scan, value counts in a second one."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.ordered import chunk_of, with_running_sum
from millrace.operators.windows import sample_rows
from millrace.runtime import stored
from millrace.spec import DEFAULTS, is_numeric, is_temporal

PERCENTILES = (0.25, 0.5, 0.75, 0.95, 0.99)

# Text patterns tried in this order, with the lengths a matching text can have.
PATTERNS = [
    (r"^\d{3}-\d{2}-\d{4}$", r"\d{3}-\d{2}-\d{4}", "BETWEEN 11 AND 12"),
    (r"^\d{5}(-\d{4})?$", r"\d{5}(-\d{4})?", "BETWEEN 5 AND 11"),
    (r"^[A-Z]{2}\d+$", r"[A-Z]{2}\d+", ">= 3"),
    (r"^\d{4}-\d{2}-\d{2}$", r"\d{4}-\d{2}-\d{2}", "BETWEEN 10 AND 11"),
    (r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+$", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+", ">= 3"),
]


def _all_match(name: str, pattern: str, lengths: str) -> Column:
    """Do all values match? The regular expression is only tried on values of a possible length."""
    value = _q(name)
    return F.bool_and(F.when(value.isNotNull(), F.expr(f"length(`{name}`) {lengths}") & value.rlike(pattern)))


NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)


def profiled_columns(df: DataFrame) -> list[str]:
    """All columns. Nested and binary ones have counts and their share of NULLs, but no values, range or pattern."""
    return list(df.columns)


def grouped_columns(df: DataFrame) -> list[str]:
    """Columns whose values can be counted and shown as text."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, NESTED)]


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def statistics(
    df: DataFrame, cols: list[str] | None = None, accuracy: int = 10000, distinct: bool = True, text_range: bool = False
) -> DataFrame:
    """One row per column from a single aggregate: counts, estimated distinct values, range, mean, deviation,
    percentiles, text lengths and the pattern all values share.

    ``text_range`` adds the smallest and largest text; text buffers make Spark aggregate without code generation.
    """
    cols = cols or profiled_columns(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    aggs, rows = [F.count(F.lit(1)).alias("n")], []
    for i, c in enumerate(cols):
        kind, v = types[c], _q(c)
        numeric, temporal, text = is_numeric(kind), is_temporal(kind), isinstance(kind, T.StringType)
        aggs.append(F.count(v).alias(f"c{i}"))
        nested = isinstance(kind, NESTED)
        ranged = (text_range or not text) and not nested
        if ranged:
            aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
        if distinct and not nested:
            aggs.append(F.approx_count_distinct(v).alias(f"d{i}"))
        if numeric:
            x = v.cast("double")
            aggs += [F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}")]
            if accuracy:
                aggs.append(F.percentile_approx(x, list(PERCENTILES), accuracy).alias(f"p{i}"))
        if text:
            aggs += [F.min(F.length(v)).alias(f"l{i}"), F.max(F.length(v)).alias(f"len{i}")]
            aggs += [_all_match(c, p, n).alias(f"r{i}_{j}") for j, (p, _, n) in enumerate(PATTERNS)]
        none_d, none_s = F.lit(None).cast("double"), F.lit(None).cast("string")
        has_p = numeric and accuracy
        pattern = F.coalesce(*[F.when(F.col(f"r{i}_{j}"), F.lit(p)) for j, (_, p, _) in enumerate(PATTERNS)]) if text else none_s
        rows.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("column_name"),
                F.lit(kind.simpleString()).alias("data_type"),
                F.col("n").alias("row_count"),
                F.col(f"c{i}").alias("non_null_count"),
                (F.col("n") - F.col(f"c{i}")).alias("null_count"),
                F.coalesce((F.col("n") - F.col(f"c{i}")) / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)).alias("null_ratio"),
                (F.col(f"d{i}") if distinct and not nested else F.lit(None).cast("bigint")).alias("distinct_count"),
                (F.col(f"lo{i}").cast("string") if ranged else none_s).alias("min_value"),
                (F.col(f"hi{i}").cast("string") if ranged else none_s).alias("max_value"),
                (F.col(f"lo{i}").cast("double") if numeric else none_d).alias("min_number"),
                (F.col(f"hi{i}").cast("double") if numeric else none_d).alias("max_number"),
                (F.col(f"m{i}") if numeric else none_d).alias("mean"),
                (F.col(f"s{i}") if numeric else none_d).alias("stddev"),
                *[
                    (F.get(F.col(f"p{i}"), F.lit(j)) if has_p else none_d).alias(f"p{round(q * 100)}")
                    for j, q in enumerate(PERCENTILES)
                ],
                (F.col(f"l{i}") if text else F.lit(None).cast("int")).alias("min_length"),
                (F.col(f"len{i}") if text else F.lit(None).cast("int")).alias("max_length"),
                pattern.alias("pattern"),
                F.lit(temporal).alias("is_temporal"),
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def exact_percentiles(df: DataFrame, cols: list[str], probs: tuple[float, ...] = PERCENTILES, accuracy: int = 10000) -> DataFrame:
    """(column_name, probability, value): the smallest value with at least that share of the non-null rows up to it.

    Two scans for any number of columns. The first makes a sketch of every column, which brackets each percentile. In the second
    every column of a row gives one entry: its value if that lies in a bracket (about 4 in 10,000 for each), else only the number of
    bracket ends below it. Entries are counted in the tasks, stored, and ranked. The driver holds a few numbers per column.
    """
    spark = df.sparkSession
    margin = 2.0 / accuracy
    asked = [b for p in probs for b in (max(p - margin, 0.0), min(p + margin, 1.0))]
    x = {c: _q(c).cast("double") for c in cols}
    sketch = df.agg(
        *[F.percentile_approx(x[c], asked, accuracy).alias(f"q{i}") for i, c in enumerate(cols)],
        *[F.count(x[c]).alias(f"n{i}") for i, c in enumerate(cols)],
    ).first()
    done, spots, entries = [], [], []
    for i, c in enumerate(cols):
        n, q = sketch[f"n{i}"], sketch[f"q{i}"]
        if not n:
            continue
        done += [(c, float(p), q[2 * j]) for j, p in enumerate(probs) if q[2 * j] == q[2 * j + 1]]
        brackets = [(float(p), q[2 * j], q[2 * j + 1]) for j, p in enumerate(probs) if q[2 * j] != q[2 * j + 1]]
        if not brackets:
            continue
        ends = sorted({e for _, lo, hi in brackets for e in (lo, hi)})
        spots += [(len(spots) + k, i, c, p, lo, hi, ends.index(lo), max(1, math.ceil(round(p * n, 6)))) for k, (p, lo, hi) in enumerate(brackets)]
        inside = reduce(Column.__or__, [x[c].between(lo, hi) for _, lo, hi in brackets])
        entries.append(F.when(x[c].isNotNull(), F.struct(F.lit(i).alias("c"), F.when(inside, x[c]).alias("v"), F.when(~inside, chunk_of(x[c], ends)).alias("r"))))
    known = spark.createDataFrame(done, "column_name string, probability double, value double")
    if not spots:
        return known
    counts = stored(df.select(F.inline(F.array_compact(F.array(*entries)))).groupBy("c", "v", "r").agg(F.count(F.lit(1)).alias("n")), "percentile-entries")
    # one row per asked percentile
    asked_rows = F.broadcast(spark.createDataFrame(spots, "k int, c int, column_name string, probability double, lo double, hi double, j int, rank bigint"))
    placed = counts.join(asked_rows, "c")
    below = placed.groupBy("k").agg(F.sum(F.when((F.col("v") < F.col("lo")) | (F.col("r") <= F.col("j")), F.col("n")).otherwise(0)).alias("before"))
    near = placed.filter(F.col("v").between(F.col("lo"), F.col("hi"))).join(F.broadcast(below), "k")
    chunk = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 1024)
    running = with_running_sum(near, ["k"], "v", chunk, {"upto": "n"}).filter("before + upto >= rank")
    found = running.groupBy("k", "column_name", "probability").agg(F.min("v").alias("value"))
    return known.unionByName(found.drop("k"))


LONG_TEXT = 256


def _is_long(df: DataFrame, c: str) -> Column:
    if not isinstance(df.schema[c].dataType, T.StringType):
        return F.lit(False)
    return F.coalesce(F.length(_q(c)) > LONG_TEXT, F.lit(False))


def _key(df: DataFrame, c: str) -> Column:
    if not isinstance(df.schema[c].dataType, T.StringType):
        return _q(c)
    return F.when(_is_long(df, c), F.sha2(_q(c), 256)).otherwise(_q(c))


def _counted(df: DataFrame, c: str) -> DataFrame:
    grouped = df.select(_key(df, c).alias("value"), _is_long(df, c).alias("is_long")).groupBy("value", "is_long")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("column_name"), F.col("value").cast("string"), "is_long", "n")


def value_counts(df: DataFrame, cols: list[str] | None = None, one_pass: bool = False) -> DataFrame:
    """(column_name, value, is_long, n) over all columns; a text of more than 256 characters is counted, and shuffled, as
    its SHA-256 (see :func:`restore`).

    Each column is counted by itself in its own type: a columnar source then reads every column once, and no row is
    multiplied. ``one_pass`` unpivots instead, for an input that is costly to compute and not stored.
    """
    cols = cols or grouped_columns(df)
    if one_pass:
        cells = [
            F.struct(F.lit(c).alias("column_name"), _key(df, c).cast("string").alias("value"), _is_long(df, c).alias("is_long")) for c in cols
        ]
        return df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").groupBy("column_name", "value", "is_long").agg(F.count(F.lit(1)).alias("n"))
    return reduce(DataFrame.unionAll, [_counted(df, c) for c in cols])


BUCKETS = 65536


def frequent(df: DataFrame, cols: list[str], k: int) -> DataFrame:
    """(column_name, value, is_long, n, rank): what ``top_of(value_counts(df, cols), k)`` gives, without shuffling all values.

    One scan estimates how many values each column has. Columns of no more than 65,536 are counted as they are, which shuffles no more
    than that many counts a task. The values of the others are hashed into buckets, and the rows of a bucket bound the count of each of its values from above. First the rows of
    every bucket are counted, at most 65,536 counts a task and column. Then the values of the 4 k fullest buckets are
    counted exactly; the k-th of these counts is a lower bound for the k-th of all. Last, the values of the other buckets with at
    least that many rows are counted; no other value can be among the first k, ties included. Only where the bound does not
    decide, as in a column of almost unique values, are those all of them. What is broadcast are bucket numbers. The estimate
    chooses the way only; both give the same rows.
    """
    about = df.agg(*[F.approx_count_distinct(_q(c)).alias(f"d{i}") for i, c in enumerate(cols)]).first()
    few = [c for i, c in enumerate(cols) if about[f"d{i}"] <= BUCKETS]
    many = [c for c in cols if c not in few]
    parts = [top_of(value_counts(df, few), k)] if few else []
    return reduce(DataFrame.unionByName, parts + ([_frequent_of_many(df, many, k)] if many else []))


def _frequent_of_many(df: DataFrame, cols: list[str], k: int) -> DataFrame:
    """:func:`frequent` by buckets."""

    def bucket(c: str) -> Column:
        # zeros of both signs are one value
        v = _q(c) + F.lit(0.0).cast(df.schema[c].dataType) if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) else _q(c)
        return F.pmod(F.xxhash64(v), F.lit(BUCKETS)).cast("int")

    def sizes_of(c: str) -> DataFrame:
        rows = df.filter(_q(c).isNotNull()).groupBy(bucket(c).alias("b")).agg(F.count(F.lit(1)).alias("size"))
        return rows.select(F.lit(c).alias("column_name"), "b", "size")

    def counted_in(buckets: DataFrame) -> DataFrame:
        parts = []
        for c in cols:
            chosen = buckets.filter(F.col("column_name") == c).select(F.col("b").alias("__b"))
            rows = df.select(_q(c)).filter(_q(c).isNotNull())
            parts.append(_counted(rows.join(F.broadcast(chosen), bucket(c) == F.col("__b"), "left_semi"), c))
        return reduce(DataFrame.unionAll, parts)

    fullest = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("size"), "b"))
    sizes = stored(reduce(DataFrame.unionAll, [sizes_of(c) for c in cols]).withColumn("place", fullest), "bucket-sizes")
    first = stored(top_of(counted_in(sizes.filter(F.col("place") <= 4 * k)), k), "frequent-first")
    bound = first.filter(F.col("rank") == k).select(F.col("column_name").alias("__c"), F.col("n").alias("__least"))
    others = sizes.filter(F.col("place") > 4 * k).join(F.broadcast(bound), F.col("column_name") == F.col("__c"), "left")
    rest = counted_in(others.filter(F.col("size") >= F.coalesce("__least", F.lit(1))))
    return top_of(first.drop("rank").unionByName(rest), k)


def top_of(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent non-null values per column; each task keeps k before the shuffle."""
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    return counts.filter("value is not null").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def restore(tops: DataFrame, df: DataFrame, cols: list[str]) -> DataFrame:
    """Put the texts back where ``tops`` has digests. There are at most k per column; without any, adaptive execution
    drops the scan."""
    texts = [c for c in cols if isinstance(df.schema[c].dataType, T.StringType)]
    if not texts:
        return tops.drop("is_long")
    wanted = tops.filter("is_long").select(F.col("column_name").alias("__c"), F.col("value").alias("__d"))
    parts = [df.select(F.lit(c).alias("c"), _q(c).alias("v")).filter(F.length("v") > LONG_TEXT) for c in texts]
    long = reduce(DataFrame.unionAll, parts).withColumn("d", F.sha2("v", 256))
    hits = long.join(F.broadcast(wanted), (F.col("c") == F.col("__c")) & (F.col("d") == F.col("__d")), "left_semi")
    found = hits.groupBy("c", "d").agg(F.any_value("v").alias("__text"))
    out = tops.join(found, (F.col("column_name") == F.col("c")) & (F.col("value") == F.col("d")), "left")
    return out.withColumn("value", F.coalesce("__text", "value")).drop("c", "d", "__text", "is_long")


def top_values(df: DataFrame, k: int = DEFAULTS.top_values, cols: list[str] | None = None) -> DataFrame:
    """(column_name, rank, value, n, frequency); frequency is the share of all rows, NULLs included."""
    cols = cols or grouped_columns(df)
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    tops = restore(frequent(df, cols, k), df, cols)
    return tops.select("column_name", "rank", "value", "n").withColumn("frequency", F.col("n") / total)


def exact_distinct(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column_name, distinct_count), exact; counted per task and merged."""
    return value_counts(df, cols).groupBy("column_name").agg(F.count("value").alias("distinct_count"))


def exact_statistics(df: DataFrame, cols: list[str] | None = None, accuracy: int = 0) -> DataFrame:
    """:func:`statistics` with exact distinct counts (NULL for nested and binary columns), without top values."""
    base = statistics(df, cols, accuracy, distinct=False).drop("distinct_count")
    return base.join(exact_distinct(df, _countable(df, cols)), "column_name", "left")


def _countable(df: DataFrame, cols: list[str] | None) -> list[str]:
    able = grouped_columns(df)
    return [c for c in able if cols is None or c in cols]


def profile(
    df: DataFrame, cols: list[str] | None = None, k: int = DEFAULTS.top_values, exact: bool = False,
    accuracy: int = 10000, sample: int | None = None, domain: int = 0,
) -> DataFrame:
    """Statistics and top values, one row per column. ``exact`` counts distinct values exactly; ``sample`` profiles that many
    rows, chosen by a hash of the row. A column of at most ``domain`` values has all of them as top values."""
    if sample:
        df = sample_rows(df, sample)
    base = statistics(df, cols, accuracy, distinct=not exact)
    entry = F.struct("rank", "value", "n")
    able = _countable(df, cols)
    if able:
        most = max(k, domain + 1 if domain else 0)
        counts = value_counts(df, able) if exact else None
        listed = top_of(counts, most) if exact else frequent(df, able, most)
        if domain:  # a few rows per column
            whole = F.max("rank").over(Window.partitionBy("column_name")) <= domain
            listed = listed.withColumn("__whole", whole).filter((F.col("rank") <= k) | F.col("__whole")).drop("__whole")
        tops = restore(listed, df, able).groupBy("column_name").agg(F.array_sort(F.collect_list(entry)).alias("__top"))
        distinct = counts.groupBy("column_name").agg(F.count("value").alias("distinct_count")) if exact else None
    else:
        tops = df.sparkSession.createDataFrame([], "column_name string, __top array<struct<rank:int,value:string,n:bigint>>")
        distinct = df.sparkSession.createDataFrame([], "column_name string, distinct_count bigint")
    if exact:
        base = base.drop("distinct_count").join(distinct, "column_name", "left")
    frequency = F.transform("__top", lambda t: F.struct(t["value"].alias("value"), (t["n"] / F.col("row_count")).alias("frequency")))
    return base.join(tops, "column_name", "left").withColumn("top_values", frequency).drop("__top")


def column_summary(df: DataFrame, k: int = 5) -> DataFrame:
    """Per column: counts, then number statistics if more than half the rows are numbers, else distinct values and the
    most frequent ones as text."""
    cols = grouped_columns(df)
    aggs, rows = [F.count(F.lit(1)).alias("n")], []
    for i, c in enumerate(cols):
        x = _q(c).try_cast("double") if not is_temporal(df.schema[c].dataType) else F.lit(None).cast("double")
        aggs += [
            F.count(_q(c)).alias(f"c{i}"), F.count(x).alias(f"x{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"),
            F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
        ]
        number = F.col(f"x{i}") > F.col("n") * 0.5
        rows.append(
            F.struct(
                F.lit(c).alias("column_name"), F.col(f"c{i}").alias("non_null_count"),
                (F.col("n") - F.col(f"c{i}")).alias("null_count"), number.alias("is_number"),
                *[F.when(number, F.round(F.col(f"{p}{i}"), 4)).alias(q) for p, q in (("lo", "min"), ("hi", "max"), ("m", "mean"), ("s", "stddev"))],
            )
        )
    base = df.agg(*aggs).select(F.inline(F.array(*rows)))
    counts = value_counts(df, cols)
    distinct = counts.groupBy("column_name").agg(F.count("value").alias("distinct_values"))
    tops = restore(top_of(counts, k), df, cols).groupBy("column_name")
    tops = tops.agg(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("t"))
    shown = F.array_join(F.transform("t", lambda t: F.format_string("%s(%d)", t["value"], t["n"])), ", ")
    out = base.join(distinct, "column_name", "left").join(tops, "column_name", "left")
    return out.withColumns(
        {
            "distinct_values": F.when(~F.col("is_number"), F.col("distinct_values")),
            "top_values": F.when(~F.col("is_number"), shown),
        }
    ).drop("t", "is_number")


def detect_patterns(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, pattern) judged on all rows; NULL if the values share none of the patterns."""
    return statistics(df, cols, accuracy=0, distinct=False).select("column_name", "pattern")
