"""Summaries, pivots, quality tables and window-style reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.functions.text import is_filled


def count_by(df: DataFrame, *keys: str, fill: str | None = None, top: int | None = None) -> DataFrame:
    """Counts by keys, nulls kept as a group (or filled), most frequent first, ties by key."""
    rows = df.fillna(fill, list(keys)) if fill is not None else df
    out = rows.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)
    return out.limit(top) if top else out


def tag_frequency(df: DataFrame, tags: str = "tags") -> DataFrame:
    """(tag, n, ratio) of filled values in a map column, by count and name; one pass and one small shuffle."""
    total = df.agg(F.count("*").alias("total"))
    pairs = df.select(F.explode(tags).alias("tag", "value")).where(is_filled("value")).groupBy("tag").agg(F.count("*").alias("n"))
    return pairs.crossJoin(total).select("tag", "n", F.bround(F.col("n") / F.col("total"), 4).alias("ratio")).orderBy(F.desc("n"), "tag")


def column_frequency(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same for plain columns: one aggregate, then unpivoted."""
    one = df.agg(F.count("*").alias("_total"), *[F.count_if(is_filled(c)).alias(c) for c in columns])
    out = one.unpivot("_total", columns, "tag", "n").where("n > 0")
    return out.select("tag", "n", F.bround(F.col("n") / F.col("_total"), 4).alias("ratio")).orderBy(F.desc("n"), "tag")


def category_summary(df: DataFrame, category: str = "category", total: bool = True) -> DataFrame:
    """Per category: n, neighbourhoods, located, with_area, high, medium; TOTAL adds up the rows, distinct counts too."""
    flag = lambda c: F.count(c)
    out = df.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("n"), F.countDistinct("neighbourhood").alias("neighbourhoods"), flag("latitude").alias("located"), flag("footprint_m2").alias("with_area"), F.count_if(F.col("confidence") == "high").alias("high"), F.count_if(F.col("confidence") == "medium").alias("medium"))
    numbers = out.columns[1:]
    return out.unionByName(out.agg(*[F.sum(c).alias(c) for c in numbers]).select(F.lit("TOTAL").alias("category"), *numbers)) if total else out


def neighbourhood_pivot(df: DataFrame, categories: list[str], row: str = "neighbourhood", column: str = "category", total_row: bool = False, top: int | None = None) -> DataFrame:
    """Counts per row and category with TOTAL; null keys are left out. Categories are given, so the schema is fixed."""
    known = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    out = known.groupBy(row).pivot(column, categories).agg(F.count(F.lit(1))).na.fill(0)
    out = out.withColumn("TOTAL", reduce(lambda a, b: a + b, [F.col(f"`{c}`") for c in categories]))
    if top:
        out = out.orderBy(F.desc("TOTAL"), row).limit(top)
    if total_row:
        sums = out.agg(*[F.sum(f"`{c}`").alias(c) for c in [*categories, "TOTAL"]])
        out = out.unionByName(sums.withColumn(row, F.lit("TOTAL")))
    return out


def quality(df: DataFrame, category: str = "category", columns: dict[str, str] | None = None, drop_area_under: float | None = None) -> DataFrame:
    """Share of filled values in percent per category and their mean; an area share under the limit doesn't count."""
    columns = columns or {"neighbourhood": "neighbourhood_pct", "latitude": "coordinate_pct", "footprint_m2": "area_pct"}
    out = df.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("n"), *[F.bround(F.avg(F.col(c).isNotNull().cast("double")) * 100, 1).alias(name) for c, name in columns.items()])
    names = list(columns.values())
    mean = reduce(lambda a, b: a + b, [F.col(n) for n in names]) / len(names)
    if drop_area_under is not None:
        rest = reduce(lambda a, b: a + b, [F.col(n) for n in names[:-1]]) / (len(names) - 1)
        low = F.col(names[-1]) < drop_area_under
        mean = F.when(low, rest).otherwise(mean)
        return out.withColumn("mean_pct", F.bround(mean, 1)).withColumn(names[-1], F.when(~low, F.col(names[-1])))
    return out.withColumn("mean_pct", F.bround(mean, 1))


def key_figures(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.countDistinct("category").alias("categories"), F.countDistinct("neighbourhood").alias("neighbourhoods"), F.avg(F.col("neighbourhood").isNotNull().cast("double")).alias("with_neighbourhood"), F.avg((F.col("confidence") == "high").cast("double")).alias("high_share"))


def most_frequent(df: DataFrame, key: str) -> DataFrame:
    """The commonest value, its count and share."""
    n = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return n.agg(F.min_by(key, F.struct(-F.col("n"), F.col(key))).alias("value"), F.max("n").alias("n"), (F.max("n") / F.sum("n")).alias("share"))


def resolution(counts: DataFrame) -> DataFrame:
    """From rows of (raw, resolved) per rule: totals and rate, 0 where there is nothing."""
    return counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("resolved"), F.lit(0)).alias("resolved")).withColumn("rate", F.when(F.col("raw") > 0, F.col("resolved") / F.col("raw")).otherwise(0.0))


def running_sum(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Adds the sum of `value` over all rows up to this one by `order` (no repeats, not null), without sorting everything in one task.

    Rows are dealt by quantiles of the order, summed within each range, and what the ranges before hold is added; there are as many ranges as
    shuffle partitions.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = sorted(set(df.approxQuantile(order, [k / n for k in range(1, n)], 0.2 / n))) if n > 1 else []
    at = F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<double>"), lambda e: F.col(order).cast("double") > e)) if edges else F.lit(0)
    dealt = df.withColumn("_part", at)
    before = dealt.groupBy("_part").agg(F.sum(value).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    own = F.sum(value).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn(out, own).join(F.broadcast(before), "_part").withColumn(out, F.col(out) + F.col("_before")).drop("_part", "_before")


def weighted_percentile(df: DataFrame, value: str, weight: str, q: float, *groups: str) -> DataFrame:
    """Smallest value whose cumulative weight reaches q of the total. NaN and null values don't count, infinity does.

    Weights are added per distinct value first, so the running sum sorts values and not rows.
    """
    good = df.where(F.col(value).isNotNull() & ~F.isnan(value) & F.col(weight).isNotNull())
    per = good.groupBy(*groups, F.col(value).alias("_v")).agg(F.sum(weight).alias("_w"))
    if groups:
        w = Window.partitionBy(*groups)
        run = per.withColumn("_c", F.sum("_w").over(w.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_t", F.sum("_w").over(w))
    else:
        run = running_sum(per, "_v", "_w", "_c").crossJoin(per.agg(F.sum("_w").alias("_t")))
    hit = F.min(F.when((F.col("_t") > 0) & (F.col("_c") >= F.lit(q) * F.col("_t")), F.col("_v"))).alias("percentile")
    return run.groupBy(*groups).agg(hit) if groups else run.agg(hit)


def weighted_cdf(df: DataFrame, value: str, weight: str) -> DataFrame:
    """(value, share): weight up to and including each distinct value over the total."""
    per = df.groupBy(F.col(value).alias("value")).agg(F.sum(weight).alias("w"))
    return running_sum(per, "value", "w", "c").crossJoin(per.agg(F.sum("w").alias("t"))).select("value", (F.col("c") / F.col("t")).alias("share"))


def histogram(df: DataFrame, value: str, size: float = 2.5, start: float = 0.0) -> DataFrame:
    at = F.floor((F.col(value) - F.lit(start)) / F.lit(size)) * F.lit(size) + F.lit(start)
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def unique_names(df: DataFrame, name: str, order: list[str | Column], sep: str = " ({})") -> DataFrame:
    """Adds display: repeats of a name are numbered from 2."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return df.withColumn("_k", k).withColumn("display", F.when(F.col("_k") == 1, F.col(name)).otherwise(F.concat(name, F.lit(sep.split("{}")[0]), "_k", F.lit(sep.split("{}")[1])))).drop("_k")


def number_blanks(df: DataFrame, name: str, order: str, prefix: str) -> DataFrame:
    """Blank names become prefix and a running number over the blanks only, by `order`, a number without repeats."""
    blank = F.coalesce(F.trim(name), F.lit("")) == ""
    numbered = running_sum(df.where(blank).withColumn("_one", F.lit(1)), order, "_one", "_k")
    numbered = numbered.withColumn(name, F.concat(F.lit(prefix), F.col("_k"))).select(df.columns)
    return df.where(~blank).unionByName(numbered)


def sample_rows(df: DataFrame, key: str, n: int = 500, seed: int = 42) -> DataFrame:
    """n rows by a seeded hash of the key: the same for the same rows, however they are partitioned."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def name_length_p90(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.percentile(F.length(column), 0.9).alias("p90"))


def map_centre(df: DataFrame, lat: str, lon: str) -> DataFrame:
    return df.agg(F.avg(lat).alias("lat"), F.avg(lon).alias("lon"))


def fill_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of filled cells per column and whether it reaches 80 percent."""
    one = df.agg(*[F.avg(is_filled(c).cast("double")).alias(c) for c in columns])
    return one.unpivot([], columns, "column", "filled").withColumn("ok", F.col("filled") >= 0.8)


def compare_runs(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Members of two sets of open areas: key and one of both, first, second."""
    left, right = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    return left.join(right, key, "full").select(key, F.when(F.col("_a").isNull(), "second").when(F.col("_b").isNull(), "first").otherwise("both").alias("member"))


def delta(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """b minus a of one value by key."""
    return a.select(key, F.col(value).alias("first")).join(b.select(key, F.col(value).alias("second")), key, "full").withColumn("delta", F.col("second") - F.col("first"))


def select_values(df: DataFrame, chosen: dict[str, list]) -> DataFrame:
    """Rows whose columns each hold one of the chosen values; a column without any chosen value doesn't filter, None stands for null."""
    for c, values in chosen.items():
        if values:
            some = F.col(f"`{c}`").isin([v for v in values if v is not None])
            df = df.where(some | F.col(f"`{c}`").isNull() if None in values else some)
    return df


def count_values(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """One row: how many rows hold one of the values (trimmed, small letters), and how many there are."""
    hit = F.lower(F.trim(F.col(column))).isin(values)
    return df.agg(F.count_if(hit).alias("hits"), F.count("*").alias("n"))


def preview(df: DataFrame, order: list, n: int = 8) -> DataFrame:
    """The first rows by an order that is given, as tables have none of their own."""
    return df.orderBy(*order).limit(n)


def audit_order(df: DataFrame, value: str, *ties: str) -> DataFrame:
    """Largest value first, rows without one last."""
    return df.orderBy(F.desc_nulls_last(value), *ties)


def sample_names(df: DataFrame, name: str, n: int = 10) -> DataFrame:
    """One row: the number of distinct names and the first n of them in order. No list of all names is built."""
    names = df.where(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct()
    first = names.orderBy("name").limit(n).agg(F.array_sort(F.collect_list("name")).alias("first"))
    return names.agg(F.count("*").alias("n")).join(first, F.lit(True), "cross")  # one row each


def shape_counts(df: DataFrame, rings: str = "rings", x: str = "x") -> DataFrame:
    """One row: features with polygons, with a point only, with neither."""
    polygon = F.coalesce(F.size(rings) > 0, F.lit(False))
    point = ~polygon & F.col(x).isNotNull()
    return df.agg(F.count_if(polygon).alias("polygons"), F.count_if(point).alias("points"), F.count_if(~polygon & ~point).alias("bare"))


def split_open(areas: DataFrame, opened: DataFrame, key: str = "area_idx") -> tuple[DataFrame, DataFrame]:
    """(open, closed) areas."""
    names = opened.select(key).distinct()
    return areas.join(names, key, "left_semi"), areas.join(names, key, "left_anti")
