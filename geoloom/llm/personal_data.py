"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Base spans are the places of four fixed forms (e-mail addresses, IP addresses, card numbers, telephone numbers), leftmost and
non-overlapping per kind, that pass their kind's check. They are the seeds.

Method. Every text's identifier-like places (chains of words with digits or an at sign) are slots. A slot that holds a base form is a seed
of that kind, all others are unknown. A slot's lexical patterns are the two words before it, the word before it and the word
after it, each together with the slot's build (holds an at sign; digits with signs between; letters and digits). Patterns and instances
(the slots' texts) form a graph, one edge a pair however often it occurs, so copies of a document add nothing. Spark scores it in ROUNDS rounds:
a pattern's score for a kind is the share of its instances that are of the kind, SMOOTH added below, and counts from SUPPORT such instances
on; an unknown instance takes its best pattern's kind once that score reaches LEAST. Instances found so raise further patterns in the next
round. Slots whose own pattern and whose instance both agree at the end are added as spans, without the signs that enclose them; a span never
overlaps a base span.

Edges meet scores by joins that split frequent patterns over SPLIT parts; only sums of edges are shuffled. Rounds are written
to the shared folder.

A null or empty text has no spans. Ids may be null or repeated: rows that share id and text are alike, each gives one row. Places are code
points, ends exclusive. Matching is linear in a text's length. Empty tables give no rows.
Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm import arrow

# The kinds in their order.
KINDS = ["email", "ip", "card", "phone"]

# The four forms, written so that no part is tried from two starts or in two lengths:
# email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), card [0-9]([\x20-]?[0-9])+, phone \+[0-9][\x20().0-9-]+[0-9]
FORMS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

#: What a text must hold for a form to occur.
_GATES = {"email": "[A-Za-z0-9._%+-]@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}

#: Identifier-like places: words with a digit or an at sign, and those of digits and signs that follow them.
SLOT = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:(?<![,;:.!?])[\x20-][(\[]?+[0-9][0-9()./:-]*+[,;!?]*+(?!\S))*+"
#: Rounds; instances that a pattern needs; what is added to its count; score from which on it tells a kind; parts of a frequent pattern.
ROUNDS, SUPPORT, SMOOTH, LEAST, SPLIT = 3, 4, 1.0, 0.75, 16
_NEAR = 64  # code points of context that are looked at
_RUN = 128  # places whose lengths are summed up together

_SPANS = "array<struct<start:bigint,stop:bigint,before:string,text:string,after:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with a value that is computed once, also where the body is run for each member of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def places(text: Column, form: str) -> Column:
    """Array of (start, stop, what lies before, text, what lies after) of all matches, from the lengths of what lies between and of themselves.

    Lengths are summed up in runs of _RUN places, as Spark copies what a sum over an array has gathered at each member.
    """
    none = F.array().cast(_SPANS)
    fields = lambda g, x: F.struct(g["before"].alias("before"), x.alias("text"), g["after"].alias("after"), (F.length(g["before"]) + F.length(x)).cast("bigint").alias("size"))
    pieces = _let(F.split(text, form, -1), lambda gaps: F.zip_with(F.arrays_zip(gaps.alias("before"), F.slice(gaps, 2, 1 << 30).alias("after")), F.regexp_extract_all(text, F.lit(form), F.lit(0)), fields))

    def in_runs(found: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(found) - 1, F.lit(0)), F.lit(_RUN)), lambda k: F.slice(found, k + 1, _RUN))

    def of(run: Column, before: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            stop = acc["at"] + x["size"]
            one = F.struct((stop - F.length(x["text"])).alias("start"), stop.alias("stop"), F.right(x["before"], F.lit(_NEAR)).alias("before"), x["text"].alias("text"), F.left(x["after"], F.lit(_NEAR)).alias("after"))
            return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(one).cast(_SPANS)).alias("out"))

        return F.aggregate(run, F.struct(before.alias("at"), none.alias("out")), step)["out"]

    def placed(runs: Column) -> Column:
        add = lambda a, x: a + x
        zero = F.lit(0).cast("bigint")
        totals = F.transform(runs, lambda run: F.aggregate(F.transform(run, lambda x: x["size"]), zero, add))
        return _let(totals, lambda sums: F.flatten(F.transform(runs, lambda run, k: of(run, F.aggregate(F.slice(sums, 1, k), zero, add)))))

    # The last piece has no match behind it.
    return _let(F.filter(pieces, lambda x: x["text"].isNotNull()), lambda found: F.when(F.size(found) > 0, _let(in_runs(found), placed)).otherwise(none))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _check(kind: str) -> Callable[[Column], Column]:
    """What a text of the kind's form must fulfil."""
    digits = lambda x: F.length(_digits(x))
    return {
        "email": lambda x: x.isNotNull(),
        "ip": lambda x: x.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"),
        "card": lambda x: digits(x).between(16, 19) & F.call_function("luhn_check", _digits(x)),
        "phone": lambda x: digits(x).between(8, 15),
    }[kind]


def _passes(kind: str) -> Callable[[Column], Column]:
    return lambda span: _check(kind)(span["text"])


def _of(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def base_spans(text: Column) -> dict[str, Column]:
    """By kind, the array of (start, stop, text) of the fixed forms that pass their check."""
    none = F.array().cast(_SPANS)
    return {k: F.when(text.rlike(_GATES[k]), F.filter(places(text, FORMS[k]), _passes(k))).otherwise(none) for k in KINDS}


def _slots(text: Column) -> Column:
    """Array of a text's slots: their place without enclosing signs, instance, kind as a seed ('several' if it holds more), and patterns."""
    # An opening bracket belongs to the slot if it is closed before the slot's end.
    head, tail = r"^[\"'<{=:,;.!?]*(?:[(\[]+(?=[^)\]]*[)\]]*[\"',;:.!?]*$))?", r"[\"')\]>}=:,;.!?]*$"

    def of(s: Column) -> Column:
        before, after = F.lower(s["before"]), F.lower(s["after"])
        inner = F.regexp_replace(F.regexp_replace(s["text"], head, ""), tail, "")
        start = s["start"] + F.length(F.regexp_extract(s["text"], head, 0))
        first = lambda k: _let(F.regexp_extract(s["text"], FORMS[k], 0), lambda x: F.when((x != "") & _check(k)(x), F.lit(k)))
        kind = _let(F.array_compact(F.array(*map(first, KINDS))), lambda ks: F.when(F.size(ks) == 1, F.get(ks, F.lit(0))).when(F.size(ks) > 1, "several"))
        build = F.when(F.contains(s["text"], F.lit("@")), "at").when(inner.rlike(r"^[0-9()\[\]./:+\x20-]+$"), "digits").otherwise("mixed")
        words = F.array(
            F.concat_ws(" ", F.lit("<<"), F.regexp_extract(before, r"(\S+\s+\S+)\s*$", 1)),
            F.concat_ws(" ", F.lit("<"), F.regexp_extract(before, r"(\S+)\s*$", 1)),
            F.concat_ws(" ", F.lit(">"), F.regexp_extract(after, r"^\s*(\S+)", 1)),
        )
        patterns = F.transform(F.filter(words, lambda w: w.rlike(r"\p{L}")), lambda w: F.concat_ws(" ", build, F.regexp_replace(w, r"\s+", " ")))
        return F.struct(start.alias("start"), (start + F.length(inner)).alias("stop"), F.concat_ws(" ", build, F.lower(inner)).alias("instance"), kind.alias("kind"), patterns.alias("patterns"))

    return F.filter(F.transform(places(text, SLOT), of), lambda s: s["stop"] - s["start"] >= 5)


def _scores(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(pattern, kind, score) of the patterns that tell a kind: of all their instances the share that is known to be of it."""
    sized = edges.join(known, "instance", "left")
    each = sized.groupBy("pattern").agg(F.count("*").alias("n"), *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])
    best = F.greatest(*[F.struct(F.col(k).alias("hits"), F.lit(k).alias("kind")) for k in KINDS])
    each = each.withColumn("best", best).where(F.col("best.hits") >= SUPPORT)
    return each.select("pattern", "best.kind", (F.col("best.hits") / (F.col("n") + SMOOTH)).alias("score")).where(F.col("score") >= LEAST)


def _by_pattern(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Rows with a pattern joined to its score; a frequent pattern's rows go to SPLIT parts."""
    part = F.pmod(F.xxhash64("instance"), F.lit(SPLIT)).cast("int")
    copies = scores.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1))))
    return rows.withColumn("part", part).join(copies, ["pattern", "part"]).drop("part")


def _apart(spots: DataFrame, rows: DataFrame) -> DataFrame:
    """Spots that overlap no base span of their text; both are dealt to cells of _NEAR code points, which few of either share."""
    cells = F.explode(F.expr(f"sequence(start div {_NEAR}, (stop - 1) div {_NEAR})"))
    texts = spots.select("doc_id", "digest").distinct().withColumnsRenamed({"doc_id": "same_id", "digest": "same_digest"})
    same = F.col("doc_id").eqNullSafe(F.col("same_id")) & (F.col("digest") == F.col("same_digest"))
    base = rows.join(texts, same, "left_semi").select("doc_id", "digest", F.explode(F.concat(*KINDS)).alias("b")).distinct()
    base = base.select(F.col("doc_id").alias("same_id"), F.col("digest").alias("same_digest"), F.col("b.start").alias("start"), F.col("b.stop").alias("stop")).withColumn("near", cells).withColumnsRenamed({"start": "from", "stop": "to"})
    met = spots.withColumn("cell", cells).join(base, same & (F.col("cell") == F.col("near")) & (F.col("from") < F.col("stop")) & (F.col("to") > F.col("start")), "left_semi")
    key = ["doc_id", "digest", "kind", "start", "stop"]
    met = met.select(*key).distinct().withColumnsRenamed({k: f"met_{k}" for k in key})
    return spots.join(met, [F.col(k).eqNullSafe(F.col(f"met_{k}")) for k in key], "left_anti")


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (array of kind, start, stop) and added (the same) for every row."""
    stash = arrow.Stash(df.sparkSession, "personal")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    gate = F.col("text").rlike("[0-9@]")
    plain = F.array().cast(_SPANS)
    rows = rows.select("doc_id", F.when(gate, F.col("text")).alias("text"))
    base = base_spans(F.col("text"))
    rows = rows.select("*", *[F.when(F.col("text").isNotNull(), base[k]).otherwise(plain).alias(k) for k in KINDS])
    slots = F.when(F.col("text").isNotNull(), _slots(F.col("text")))
    digest = F.when(F.col("text").isNotNull(), F.sha2("text", 256))
    bare = lambda k: F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))).alias(k)
    rows = stash.keep(rows.select("doc_id", digest.alias("digest"), *[bare(k) for k in KINDS], slots.alias("slots")), "rows")

    # The graph: one edge for each pattern and instance; instances that are seeds of one kind only.
    each = rows.where(F.size("slots") > 0).select(F.explode("slots").alias("s")).select("s.*")
    edges = stash.keep(each.select(F.explode("patterns").alias("pattern"), "instance").distinct(), "edges")
    kinds = each.groupBy("instance").agg(F.min("kind").alias("kind"), F.max("kind").alias("other"))
    seeds = stash.keep(kinds.where("kind = other").select("instance", "kind"), "seeds")
    unknown = stash.keep(kinds.where("kind is null").select("instance"), "unknown")
    open_edges = stash.keep(edges.join(unknown, "instance"), "open")
    known = seeds
    for k in range(ROUNDS):
        scores = stash.keep(_scores(edges, known), f"scores{k}")
        found = _by_pattern(open_edges, scores).groupBy("instance").agg(F.max(F.struct("score", "kind")).alias("best")).select("instance", "best.kind")
        known = stash.keep(seeds.unionByName(found), f"known{k}")

    # Unknown slots whose own pattern tells the kind of their instance.
    spots = rows.where(F.exists("slots", lambda s: s["kind"].isNull())).select("doc_id", "digest", F.explode("slots").alias("s")).where("s.kind is null")
    spots = spots.select("doc_id", "digest", "s.start", "s.stop", "s.instance", F.explode("s.patterns").alias("pattern"))
    spots = _by_pattern(spots, scores).join(known.withColumnRenamed("kind", "known"), "instance").where("kind = known")
    spots = _apart(spots.select("doc_id", "digest", "kind", "start", "stop").distinct(), rows)
    spots = spots.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("kind", "start", "stop")).alias("added"))
    spots = spots.withColumnsRenamed({"doc_id": "same_id", "digest": "same_digest"})
    out = rows.join(spots, F.col("doc_id").eqNullSafe(F.col("same_id")) & (F.col("digest") == F.col("same_digest")), "left")
    kind = lambda k: F.transform(k, lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    added = F.coalesce(F.col("added"), F.array().cast("array<struct<kind:string,start:bigint,stop:bigint>>"))
    return out.select("doc_id", F.concat(*[kind(k) for k in KINDS]).alias("base"), added.alias("added"))


def _listed(spans: Column) -> Column:
    """kind:start:stop by kind, then start, comma-joined."""
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(order[s["kind"]].alias("order"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base counts by kind, base_sha256 and all spans."""
    rows = find(df, id_col, text_col)
    counts = [F.size(F.filter("base", _of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "added")).alias("spans"))


