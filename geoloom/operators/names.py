"""Place names resolved against named features by tokens.

A score needs a common word, so candidates come from an equi-join on words, which loses nothing; equal inputs are scored once.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from geoloom.functions.text import GENERIC_STOPWORDS, neighbourhood_tokens, normalize_name, pattern_matches, sorted_canonical, strip_place, tokens

# Order of keys that describe a feature, and names and scores of how its tags agree with a category.
DESCRIBING = ["amenity", "shop", "healthcare", "leisure", "tourism", "office", "historic", "railway", "highway", "landuse", "natural", "man_made", "building"]
AGREEMENT = {"match": (0, 100), "support": (1, 70), "unknown": (2, 50), "mismatch": (3, 0)}


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence: a row of the table is the bits of one number, so a step takes a word of them at a time."""
    at: dict[str, int] = {}
    for k, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & at.get(y, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * _lcs(a, b) / (len(a) + len(b))


def set_ratio(a: str, b: str) -> float:
    """Of two texts' word sets: 100 if one holds the other, else the best of three ratios of their common and own words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if common and (not left or not right):
        return 100.0
    both = [" ".join(p for p in (common, own) if p) for own in (left, right)]
    # Common words against common and own words differ in length only.
    short = [200.0 * len(common) / (len(common) + len(t)) for t in both] if common else []
    return max([indel_ratio(*both), *short])


@F.pandas_udf(T.DoubleType())
def _set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([set_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])


def token_set_ratio(a: Column | str, b: Column | str) -> Column:
    """100 without leaving the JVM where one side holds the other; only the rest goes to Python."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    x, y = (F.array_distinct(F.filter(F.split(c, " "), lambda t: t != "")) for c in (a, b))
    n = F.size(F.array_intersect(x, y))
    inside = (n > 0) & ((n == F.size(x)) | (n == F.size(y)))
    return F.when(inside, 100.0).otherwise(_set_ratio(F.when(~inside, a), F.when(~inside, b)))


def jaccard(x: Column, y: Column) -> Column:
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def score(x: Column, y: Column, a: Column, b: Column) -> Column:
    """Ratio of the canonical texts times the root of the word sets' Jaccard similarity."""
    j = jaccard(x, y)
    return F.when(j > 0, token_set_ratio(a, b) * F.sqrt(j)).otherwise(0.0)


def verdict(best: Column, second: Column, threshold: float, over: Column) -> Column:
    """over: how many of the ranked candidates reach the threshold."""
    return F.when(F.coalesce(best, F.lit(0.0)) <= 0, "Not found").when((best >= threshold) & (over >= 2) & (best - F.coalesce(second, F.lit(0.0)) < 5), "Ambiguous").when(best >= threshold, "Matched").otherwise("Possible match")


def candidates(features: DataFrame, feature_id: str, variants: Column, stopwords: list[str] | None = None) -> DataFrame:
    """(cand_id, variant, words, text): a row per name variant that keeps a word."""
    rows = features.select(F.col(feature_id).alias("cand_id"), F.posexplode(variants).alias("variant", "name"))
    rows = rows.withColumn("words", F.array_distinct(tokens("name", stopwords)))
    return rows.where(F.size("words") > 0).select("cand_id", "variant", "words", sorted_canonical(F.col("words")).alias("text"), "name")


def ranked(inputs: DataFrame, pool: DataFrame, keep: int = 3, extra: list[str] | None = None) -> DataFrame:
    """inputs: key, words, text (and `extra` columns that must be equal in the pool). Best variant per candidate, best `keep` candidates.

    Adds rank from 1, second and over_n are left to the caller, which knows the threshold.
    """
    on = ["word", *(extra or [])]
    left = inputs.withColumn("word", F.explode("words"))
    right = pool.select("cand_id", "variant", F.col("words").alias("cand_words"), F.col("text").alias("cand_text"), F.col("name").alias("cand_name"), *(extra or []), F.explode("words").alias("word"))
    pairs = left.join(right, on).dropDuplicates(["key", "cand_id", "variant"])
    scored = pairs.withColumn("score", score(F.col("words"), F.col("cand_words"), F.col("text"), F.col("cand_text"))).where("score > 0")
    best = scored.groupBy("key", "cand_id").agg(F.max(F.struct("score", (-F.col("variant")).alias("v"), "cand_name", "cand_words", "cand_text")).alias("b"))
    best = best.select("key", "cand_id", "b.score", "b.cand_name", "b.cand_words", "b.cand_text")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "cand_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= keep)


def summarize(top: DataFrame, threshold: float) -> DataFrame:
    """One row per key: best candidate, its score, the runner-up's, and the status."""
    g = top.groupBy("key").agg(F.min_by("cand_id", "rank").alias("cand_id"), F.max("score").alias("score"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"), F.count_if(F.col("score") >= threshold).alias("over"), F.min_by("cand_name", "rank").alias("cand_name"))
    return g.withColumn("status", verdict(F.col("score"), F.col("second"), threshold, F.col("over")))


def group_inputs(names: DataFrame, name: str, row: str, neighbourhood: str | None = None) -> DataFrame:
    """Adds key: equal normalised names (and neighbourhood words) are one group; empty names have none."""
    from geoloom.functions.text import is_empty_input

    hint = F.array_join(F.array_sort(neighbourhood_tokens(neighbourhood)), " ") if neighbourhood else F.lit("")
    return names.withColumn("key", F.when(~is_empty_input(name), F.concat_ws("|", normalize_name(name), hint)))


def match_names(names: DataFrame, name: str, row: str, tier1: DataFrame, tier2: DataFrame | None = None, rule_stopwords: list[str] | None = None, threshold: float = 80.0, lite_threshold: float = 85.0) -> DataFrame:
    """Every input row with row, name, status, cand_id, cand_name, score, tier.

    Tier 1 uses the category's stopwords; names that it doesn't settle try tier 2 with the generic ones, whose hits may be
    tagged wrongly; what is left shows tier 1's near miss. Candidate tables come from `candidates`.
    """
    keyed = group_inputs(names, name, row)
    groups = keyed.where("key is not null").groupBy("key").agg(F.min_by(name, row).alias("raw"))

    def of(stop: list[str], pool: DataFrame, t: float) -> DataFrame:
        g = groups.withColumn("words", F.array_distinct(tokens("raw", stop))).withColumn("text", sorted_canonical(F.col("words")))
        return summarize(ranked(g.select("key", "words", "text"), pool), t)

    first = of([*GENERIC_STOPWORDS, *(rule_stopwords or [])], tier1, threshold).select("key", *[F.col(c).alias(f"{c}1") for c in ("cand_id", "cand_name", "score", "status")])
    out = groups.join(first, "key", "left")
    good = F.col("status1").isin("Matched", "Ambiguous")
    if tier2 is not None:
        second = of(GENERIC_STOPWORDS, tier2, lite_threshold).select("key", *[F.col(c).alias(f"{c}2") for c in ("cand_id", "cand_name", "score", "status")])
        out = out.join(second, "key", "left")
        mistag = ~F.coalesce(good, F.lit(False)) & F.col("status2").isin("Matched", "Ambiguous")
    else:
        out = out.withColumns({f"{c}2": F.lit(None).cast(t) for c, t in (("cand_id", "long"), ("cand_name", "string"), ("score", "double"), ("status", "string"))})
        mistag = F.lit(False)
    pick = lambda c: F.when(mistag, F.col(f"{c}2")).otherwise(F.col(f"{c}1"))
    out = out.select("key", pick("cand_id").alias("cand_id"), pick("cand_name").alias("cand_name"), F.coalesce(pick("score"), F.lit(0.0)).alias("score"), F.when(mistag, "Possible mistag").otherwise(F.coalesce("status1", F.lit("Not found"))).alias("status"), F.when(mistag, 2).when(F.col("status1").isNotNull(), 1).alias("tier"))
    joined = keyed.join(out, "key", "left")
    return joined.select(F.col(row), F.col(name), F.when(F.col("key").isNull(), "Empty").otherwise(F.col("status")).alias("status"), "cand_id", "cand_name", F.coalesce("score", F.lit(0.0)).alias("score"), "tier")


def detect_category(names: DataFrame, name: str, patterns: DataFrame, umbrellas: list[str], key: str) -> DataFrame:
    """(key, rule_code): the longest pattern that matches; then one that hits the last word, then no umbrella, then the code's order.

    patterns: pattern (normalised), rule_code. There are a few hundred, and each name meets each, so they are folded into one expression per name.
    """
    table = patterns.where("pattern <> ''").select("pattern", "rule_code").distinct().collect()
    norm = names.select(key, normalize_name(name).alias("n"))
    pairs = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(c).alias("c")) for p, c in table]) if table else F.array().cast("array<struct<p:string,c:string>>")
    last = F.element_at(F.split("n", " "), -1)
    hits = F.transform(F.filter(pairs, lambda t: pattern_matches(t["p"], F.col("n"))), lambda t: F.struct((-F.length(t["p"])).alias("a"), F.when(pattern_matches(F.element_at(F.split(t["p"], " "), -1), last), 0).otherwise(1).alias("b"), F.when(t["c"].isin(umbrellas), 1).otherwise(0).alias("u"), t["c"].alias("rule_code")))
    return norm.select(key, F.array_min(hits)["rule_code"].alias("rule_code"))


def category_label(tags: Column) -> Column:
    """The first describing key=value; building=yes only if there is nothing else."""
    at = [(k, F.try_element_at(tags, F.lit(k))) for k in DESCRIBING]
    sure = [F.when(v.isNotNull() & (v != "") & ~((F.lit(k) == "building") & (v == "yes")), F.concat(F.lit(f"{k}="), v)) for k, v in at]
    return F.coalesce(*sure, F.when(F.try_element_at(tags, F.lit("building")) == "yes", F.lit("building=yes")))


def tag_agreement(tags: Column, rule) -> Column:
    """match, mismatch, support or unknown of a feature's tags with a rule's."""
    from geoloom.operators.rules import condition, matches_any

    def against(k: str, v: str) -> Column:
        at = F.try_element_at(tags, F.lit(k))
        return F.coalesce(at.isNotNull() & (at != F.lit(v)), F.lit(False))

    wrong = reduce(lambda a, b: a | b, [against(k, v) for d in rule.strict for k, v in d.items() if v != "*"], F.lit(False))
    helps = reduce(lambda a, b: a | b, [condition(tags, k, v) for k, v in rule.support.items()], F.lit(False))
    return F.when(matches_any(tags, rule.strict), "match").when(wrong, "mismatch").when(helps, "support").otherwise("unknown")


def match_mixed(names: DataFrame, name: str, row: str, features: DataFrame, feature_id: str, feature_name: str, rules: dict, patterns: DataFrame, umbrellas: list[str], stopwords: dict[str, list[str]] | None = None, neighbourhood: str | None = None, feature_neighbourhood: str | None = None, place: list[str] | None = None, threshold: float = 80.0) -> DataFrame:
    """Names of mixed kinds: each one's category is detected, then scored against all named features with its stopwords.

    A neighbourhood hint restricts candidates to features whose neighbourhood shares a word. Equal scores go to the feature whose tags
    agree better, and an ambiguous name is matched if the best one's tags agree strictly better than the runner-up's.
    """
    stopwords = stopwords or {}
    keyed = group_inputs(names, name, row, neighbourhood)
    hint = neighbourhood_tokens(neighbourhood) if neighbourhood else F.array().cast("array<string>")
    groups = keyed.where("key is not null").groupBy("key").agg(F.min_by(name, row).alias("raw"), F.min_by(hint, row).alias("hint"))
    groups = groups.join(detect_category(groups, "raw", patterns, umbrellas, "key"), "key")
    codes = sorted({c for c in rules})
    stop = F.coalesce(F.try_element_at(F.create_map(*[x for c in codes for x in (F.lit(c), F.array(*[F.lit(w) for w in [*GENERIC_STOPWORDS, *stopwords.get(c, [])]]))]), F.col("rule_code")), F.array(*[F.lit(w) for w in GENERIC_STOPWORDS]))
    words = F.filter(F.split(normalize_name("raw"), " "), lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t))
    words = strip_place(F.array_distinct(words), F.array(*[F.lit(p) for p in place])) if place else F.array_distinct(words)
    groups = groups.withColumn("words", words).withColumn("view", F.coalesce("rule_code", F.lit("lite"))).withColumn("text", sorted_canonical(F.col("words")))
    # Only the views that some name needs are tokenised.
    views = groups.select("view").distinct()
    cand = features.select(F.col(feature_id).alias("cand_id"), F.col(feature_name).alias("name"), F.col("tags"), (neighbourhood_tokens(feature_neighbourhood) if feature_neighbourhood else F.array().cast("array<string>")).alias("cand_hint"))
    vstop = F.coalesce(F.try_element_at(F.create_map(*[x for c in codes for x in (F.lit(c), F.array(*[F.lit(w) for w in [*GENERIC_STOPWORDS, *stopwords.get(c, [])]]))]), F.col("view")), F.array(*[F.lit(w) for w in GENERIC_STOPWORDS]))
    pool = cand.crossJoin(F.broadcast(views)).withColumn("cand_words", F.array_distinct(F.filter(F.split(normalize_name("name"), " "), lambda t: (F.length(t) >= 2) & ~F.array_contains(vstop, t)))).withColumn("cand_text", sorted_canonical(F.col("cand_words")))
    left, right = groups.withColumn("word", F.explode("words")), pool.withColumn("word", F.explode("cand_words"))
    pairs = left.join(right, ["view", "word"]).dropDuplicates(["key", "cand_id"])
    pairs = pairs.where((F.size("hint") == 0) | F.arrays_overlap("hint", "cand_hint"))
    scored = pairs.withColumn("score", score(F.col("words"), F.col("cand_words"), F.col("text"), F.col("cand_text"))).where("score > 0")
    agree = reduce(lambda rest, c: F.when(F.col("rule_code") == c, tag_agreement(F.col("tags"), rules[c])).otherwise(rest), codes, F.lit("unknown"))
    scored = scored.withColumn("agreement", agree)
    order = reduce(lambda rest, kv: F.when(F.col("agreement") == kv[0], kv[1][0]).otherwise(rest), AGREEMENT.items(), F.lit(2))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "place_rank", "cand_id"))
    top = scored.withColumn("place_rank", order).withColumn("rank", rank).where("rank <= 3").withColumnRenamed("name", "cand_name")
    got = summarize(top, threshold)
    ranks = top.groupBy("key").agg(F.max(F.when(F.col("rank") == 1, F.col("place_rank"))).alias("r1"), F.max(F.when(F.col("rank") == 2, F.col("place_rank"))).alias("r2"), F.min_by("agreement", "rank").alias("agreement"))
    got = got.join(ranks, "key").withColumn("status", F.when((F.col("status") == "Ambiguous") & (F.col("r1") < F.col("r2")), "Matched").otherwise(F.col("status")))
    out = groups.select("key", "rule_code").join(got, "key", "left")
    return keyed.join(out, "key", "left").select(F.col(row), F.col(name), F.when(F.col("key").isNull(), "Empty").otherwise(F.coalesce("status", F.lit("Not found"))).alias("status"), "rule_code", "cand_id", "cand_name", F.coalesce("score", F.lit(0.0)).alias("score"), "agreement")


def explain_score(top: DataFrame, agreement: str | None = None) -> DataFrame:
    """Adds the parts of each ranked pair's score and a line that says them in order. Needs words, text, cand_words, cand_text."""
    out = top.withColumn("name_part", F.bround(token_set_ratio("text", "cand_text"), 1)).withColumn("word_part", F.bround(jaccard(F.col("words"), F.col("cand_words")) * 100, 1))
    parts = [F.concat(F.lit("name "), F.col("name_part").cast("string")), F.concat(F.lit("words "), F.col("word_part").cast("string"))]
    if agreement:
        tag = reduce(lambda rest, kv: F.when(F.col(agreement) == kv[0], float(kv[1][1])).otherwise(rest), AGREEMENT.items(), F.lit(50.0))
        out = out.withColumn("tag_part", tag)
        parts.append(F.concat(F.lit("tags "), F.col("tag_part").cast("string")))
    return out.withColumn("explanation", F.concat_ws(" · ", *parts))


def golden_metrics(expected: DataFrame, results: DataFrame, row: str = "input_row") -> DataFrame:
    """expected: row, expected_status, expected_ids; results: row, status, cand_id, top_ids. Incomplete rows don't count."""
    rows = expected.where(~F.exists("expected_ids", lambda x: F.contains(F.upper(x), F.lit("TODO")))).join(results, row, "left").withColumn("status", F.coalesce("status", F.lit("Not found")))
    absent = F.col("expected_status") == "Not found"
    hit1 = ~absent & F.coalesce(F.array_contains("expected_ids", F.col("cand_id").cast("string")), F.lit(False))
    hit3 = ~absent & F.coalesce(F.arrays_overlap("expected_ids", F.transform("top_ids", lambda x: x.cast("string"))), F.lit(False))
    pct = lambda n, d: F.when(d > 0, n / d * 100).otherwise(0.0)
    return rows.agg(F.count("*").alias("n"), pct(F.count_if(hit1), F.count_if(~absent)).alias("top1_pct"), pct(F.count_if(hit3), F.count_if(~absent)).alias("top3_pct"), pct(F.count_if(absent & (F.col("status") == "Not found")), F.count_if(absent)).alias("not_found_pct"))


def pattern_table(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(pairs, "pattern string, rule_code string").select(normalize_name("pattern").alias("pattern"), "rule_code").where("pattern <> ''")
