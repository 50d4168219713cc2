"""Declarative tag rules: each rule is compiled to one struct column, and the best verdict of a row is the array's maximum.

`tags` is a map of strings. A condition asks for a value or, with the value "*", for presence.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.text import confidence_label, normalize_value

Tags = dict[str, str]
ANY = "*"


@dataclass(frozen=True)
class Rule:
    code: str
    group: str
    key: str
    label_en: str = ""
    label_tr: str = ""
    query: list[Tags] = field(default_factory=list)
    strict: list[Tags] = field(default_factory=list)
    support: Tags = field(default_factory=dict)
    patterns: list[str] = field(default_factory=list)
    name_fallback: bool = False
    yes_mapping: bool = False
    accept_query: bool = True
    query_score: int = 3
    family: str = "poi"
    geometry: tuple[str, ...] = ("Point", "Polygon")

    def __post_init__(self) -> None:
        problems = [n for n, kind in (("query", list), ("strict", list), ("support", dict), ("patterns", list)) if not isinstance(getattr(self, n), kind)]
        if not self.code or problems or not all(isinstance(d, dict) and d for d in [*self.query, *self.strict]) or not isinstance(self.query_score, int):
            raise ValueError(f"rule {self.code!r} is not well formed: {problems or 'code, conditions or score'}")




def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(False)


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def normalized_tags(tags: Column | str) -> Column:
    """Every value normalised, empty ones dropped."""
    t = F.col(tags) if isinstance(tags, str) else tags
    return F.map_filter(F.transform_values(F.coalesce(t, F.create_map().cast("map<string,string>")), lambda k, v: normalize_value(v)), lambda k, v: v != "")


def condition(tags: Column, key: str, value: str) -> Column:
    at = F.try_element_at(tags, F.lit(key))
    return at.isNotNull() if value == ANY else F.coalesce(at == F.lit(value.strip().lower()), F.lit(False))


def matches_all(tags: Column, wanted: Tags) -> Column:
    """All conditions; none at all match nothing."""
    return _all([condition(tags, k, v) for k, v in wanted.items()])


def matches_any(tags: Column, alternatives: list[Tags]) -> Column:
    return _any([matches_all(tags, d) for d in alternatives])


_ORDERED = "struct<matched:boolean,score:int,place:int,rule_code:string,confidence:string,reason:string,used_strict:boolean,matched_support_keys:array<string>,matched_name_patterns:array<string>>"


def _facts(tags: Column, rule: Rule, order: int) -> Column:
    """What one rule finds in normalised tags. Every condition occurs once, so that the expression stays small."""
    name = F.lower(F.coalesce(F.try_element_at(tags, F.lit("name")), F.lit("")))
    none = F.array().cast("array<string>")
    keys = F.array_compact(F.array(*[F.when(condition(tags, k, v), k) for k, v in rule.support.items()])) if rule.support else none
    named = F.array_compact(F.array(*[F.when(F.contains(name, F.lit(p)), p) for p in rule.patterns])) if rule.patterns else none
    return F.struct(
        F.lit(-order).alias("place"),
        F.lit(rule.code).alias("code"),
        matches_any(tags, rule.strict).alias("strict"),
        (matches_any(tags, rule.query) if rule.accept_query else F.lit(False)).alias("query"),
        keys.alias("keys"),
        named.alias("names"),
        F.lit(rule.name_fallback).alias("fallback"),
        F.lit(bool(rule.strict)).alias("has_strict"),
        F.lit(not rule.support and not rule.patterns).alias("tag_only"),
        F.lit(rule.query_score).alias("query_score"),
    )


def _judge(f: Column) -> Column:
    """The verdict on one rule's facts; its first fields sort as the choice between rules does.

    3 points for strict tags, 1 for each supporting tag, 1 for a name where names may decide. Strict tags match; where there are any,
    else a supporting tag and a name together do; where there are none, either. Failing that, a full query does if it may. Rules with nothing but
    tags are as sure as can be when these match.
    """
    support, named = F.size(f["keys"]), f["fallback"] & (F.size(f["names"]) > 0)
    reason = (
        F.when(f["strict"], "strict_match")
        .when(f["has_strict"] & (support > 0) & named, "support_match")
        .when(~f["has_strict"] & (support > 0), "support_match")
        .when(~f["has_strict"] & named, "name_fallback")
        .when(f["query"], "query_tag_match")
    )
    points = F.when(f["strict"], 3).otherwise(0) + support + named.cast("int")
    return F.struct(reason.alias("reason"), points.alias("points"), f.alias("f"))


def _finish(v: Column) -> Column:
    f, by_query = v["f"], F.coalesce(v["reason"] == "query_tag_match", F.lit(False))
    score = v["points"] + F.when(by_query, f["query_score"]).otherwise(0)
    sure = f["tag_only"] & (f["strict"] | (by_query & (f["query_score"] >= 3)))
    return F.struct(v["reason"].isNotNull().alias("matched"), F.when(v["reason"].isNull(), 0).when(sure, F.greatest(score, F.lit(4))).otherwise(score).alias("score"), v.alias("v"))


def _label(x: Column) -> Column:
    f = x["v"]["f"]
    return F.struct(x["matched"].alias("matched"), x["score"].alias("score"), f["place"].alias("place"), f["code"].alias("rule_code"), F.when(x["matched"], confidence_label(x["score"])).otherwise("none").alias("confidence"), F.coalesce(x["v"]["reason"], F.lit("no_match")).alias("reason"), f["strict"].alias("used_strict"), f["keys"].alias("matched_support_keys"), f["names"].alias("matched_name_patterns"))


def verdicts(tags: Column, rules: list[Rule]) -> Column:
    """Array of every rule's verdict, in registry order."""
    facts = F.array(*[_facts(tags, r, k) for k, r in enumerate(rules)])
    return F.transform(F.transform(F.transform(facts, _judge), _finish), _label)


def evaluate(tags: Column, rules: list[Rule]) -> Column:
    """Verdicts of all rules, the best first: matched, score, then registry order."""
    return F.reverse(F.array_sort(verdicts(tags, rules)))


def best(tags: Column, rules: list[Rule]) -> Column:
    """The best matched verdict, else an empty one."""
    none = F.array().cast("array<string>")
    empty = F.struct(F.lit(False).alias("matched"), F.lit(0).alias("score"), F.lit(0).alias("place"), F.lit(None).cast("string").alias("rule_code"), F.lit("none").alias("confidence"), F.lit("no_match").alias("reason"), F.lit(False).alias("used_strict"), none.alias("matched_support_keys"), none.alias("matched_name_patterns")).cast(_ORDERED)
    if not rules:
        return empty
    return F.array_max(F.concat(F.filter(verdicts(tags, rules), lambda v: v["matched"]).cast(f"array<{_ORDERED}>"), F.array(empty)))


def post_filter(features: DataFrame, rule: Rule, tags: str = "tags") -> DataFrame:
    """Looser than the rule: strict, or any single pair of a query, or any support tag."""
    t = F.transform_values(F.coalesce(F.col(tags), F.create_map().cast("map<string,string>")), lambda k, v: F.lower(F.trim(v)))
    pairs = [condition(t, k, v) for d in rule.query for k, v in d.items()]
    support = [condition(t, k, v) for k, v in rule.support.items()]
    return features.where(matches_any(t, rule.strict) | _any(pairs) | _any(support))


def religion_filter(features: DataFrame, expected: str, tags: str = "tags") -> DataFrame:
    """Rows whose religion is the expected one or isn't given."""
    value = normalize_value(F.try_element_at(F.col(tags), F.lit("religion")))
    return features.where((value == "") | (value == expected))


UNRESOLVED_YES = "building_yes_unresolved"


def classify(features: DataFrame, rules: list[Rule], all_rules: list[Rule] | None = None, tags: str = "tags", handle_yes: bool = True) -> DataFrame:
    """Adds rule_code, matched, score, confidence, reason, matched_support_keys, matched_name_patterns and the rule's group, key and labels.

    A building=yes row is judged again, by the rules that map such rows whatever `rules` holds; without a match it is unresolved.
    """
    every = all_rules or rules
    # A generated column is computed once per row, however many columns and filters use it later.
    out = features.withColumn("_t", normalized_tags(tags)).select("*", F.explode(F.array(best(F.col("_t"), rules))).alias("_v"))
    columns = ["rule_code", "matched", "score", "confidence", "reason", "matched_support_keys", "matched_name_patterns"]
    picked = {c: F.col(f"_v.{c}") for c in columns}
    if handle_yes:
        out = out.select("*", F.explode(F.array(F.when(condition(F.col("_t"), "building", "yes"), best(F.col("_t"), [r for r in every if r.yes_mapping])))).alias("_y"))
        yes, hit = F.col("_y").isNotNull(), F.col("_y.matched")
        for c in columns:
            mapped = F.col(f"_y.{c}")
            if c == "rule_code":
                mapped = F.when(hit, mapped).otherwise(UNRESOLVED_YES)
            elif c == "reason":
                mapped = F.when(hit, F.concat(F.lit("building_yes_mapped:"), mapped)).otherwise(UNRESOLVED_YES)
            picked[c] = F.when(yes, mapped).otherwise(picked[c])
    out = out.withColumns(picked).drop("_t", "_v", "_y")
    table = {r.code: r for r in every}
    for name, attribute in (("category_group", "group"), ("subcategory", "key"), ("label_tr", "label_tr"), ("label_en", "label_en")):
        pairs = F.create_map(*[F.lit(x) for code, r in table.items() for x in (code, getattr(r, attribute))]) if table else F.create_map().cast("map<string,string>")
        out = out.withColumn(name, F.try_element_at(pairs, F.col("rule_code")))
    return out


def is_resolved() -> Column:
    return F.col("rule_code").isNotNull() & (F.col("rule_code") != UNRESOLVED_YES) & (F.coalesce(F.col("confidence"), F.lit("none")) != "none") & F.coalesce(F.col("matched"), F.lit(False))


def split_resolved(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    return classified.where(is_resolved()), classified.where(~F.coalesce(is_resolved(), F.lit(False)))


def rule_table(spark, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(k, r.code, r.group, r.key, r.label_en, r.label_tr, r.family) for k, r in enumerate(rules)], "rule_ord int, rule_code string, category_group string, subcategory string, label_en string, label_tr string, family string")
