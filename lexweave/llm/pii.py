"""Personal data: patterns, and information-theoretic sanitisation of the terms that reveal them.

DataFrame functions only. Four kinds of entities are found by pattern. What surrounds an entity is its
context. Over the whole corpus, a term t discloses an entity e if enough different contexts of e hold
t (copies of one context count once), if knowing t makes e likely, P(e|t) = n(t,e) / n(t), and if it
tells enough bits, log2 n(t,e) N / (n(t) n(e)). All n count documents, copies included: those with t near
e, with t, with e, and all. So a term may disclose several entities. Such terms become spans of kind
`term` wherever they stand and are generalised with the entities, or removed.

A span's start is the length of what splits before it, so all offsets count code points. Patterns are
anchored to where a run begins or the last match ended, and possessive: the same matches as the plain
pattern, in linear time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

_MAIL = "[A-Za-z0-9._%+-]"
#: Kinds in order, with their patterns.
PATTERNS = {
    "email": rf"(?:(?<!{_MAIL})|\G){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
#: What a text must hold for a pattern to have a match that counts.
_HINTS = {
    "email": lambda t: F.instr(t, "@") > 0,
    "ip": lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")),
    "card": lambda t: F.rlike(t, F.lit(r"[0-9](?:[\x20-]?[0-9]){13}")),
    "phone": lambda t: F.instr(t, "+") > 0,
}
_CHUNK = 256
_FOUND = "array<struct<start:int,kind:int,end:int,value:string>>"


@dataclass(frozen=True)
class Disclosure:
    """When a term counts as revealing an entity."""

    reach: int = 60  # code points on each side of an entity
    contexts: int = 3  # different contexts of the entity that hold the term
    likely: float = 0.5  # P(entity | term)
    bits: float = 5.0  # pointwise information


def _running(sizes: Column) -> Column:
    """Sums of all that stands before each place; in pieces, so that long lists stay cheap."""

    def plain(xs: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("at"))
        return F.aggregate(xs, start, lambda a, x: F.struct(F.concat(a["out"], F.array(a["at"])).alias("out"), (a["at"] + x).alias("at")))["out"]

    at = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _CHUNK).cast("int"))
    parts = F.transform(at, lambda c: F.slice(sizes, c * _CHUNK + 1, _CHUNK))
    bases = plain(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x)))
    return F.flatten(F.transform(F.arrays_zip(parts.alias("p"), bases.alias("b")), lambda z: F.transform(plain(z["p"]), lambda x: x + z["b"])))


def matches(text: Column, pattern: Column, kind: int) -> Column:
    """Leftmost non-overlapping matches, as (start, kind, end, value)."""
    values, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    sizes = F.zip_with(values, F.slice(gaps, 1, F.size(values)), lambda v, g: F.length(g) + F.length(v))
    ends = F.zip_with(_running(sizes), sizes, lambda a, b: a + b)
    spans = F.zip_with(values, ends, lambda v, e: F.struct((e - F.length(v)).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), v.alias("value")))
    return F.when(F.size(values) > 0, spans).otherwise(F.array().cast(_FOUND))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.rlike(p, F.lit("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
    if kind == "card":
        n = F.length(_digits(value))
        return F.when(n.between(14, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _of(kind: str):
    return lambda s: _valid(kind, s["value"])


def base_spans(text: Column) -> Column:
    """Valid matches of the four kinds, by start, then kind."""
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        here = F.filter(matches(text, F.lit(pattern), k), _of(kind))
        found.append(F.when(_HINTS[kind](text), here).otherwise(F.array().cast(_FOUND)))
    return F.array_sort(F.concat(*found))


_TERM = r"\p{L}{3,}"


def disclosing_terms(found: DataFrame, text: str, rule: Disclosure) -> DataFrame:
    """term, entity, joint, p, bits of each disclosing pair. found: `text` and `base`.

    Only terms near an entity can disclose it, so those are gathered first, and then counted over the
    documents of the whole corpus."""
    ends = lambda s: (F.greatest(s["start"] + 1 - rule.reach, F.lit(1)), F.least(s["start"], F.lit(rule.reach)))
    context = lambda s: F.struct(F.concat_ws(":", s["kind"].cast("string"), s["value"]).alias("entity"), F.substring(F.col(text), *ends(s)).alias("b"), F.substring(F.col(text), s["end"] + 1, F.lit(rule.reach)).alias("a"))
    held = written(found.where(F.size("base") > 0).select(F.transform("base", context).alias("near")))
    # a term cut off by the edge of the context doesn't count
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.concat(F.regexp_replace(c["b"], r"^\p{L}+", ""), F.lit(" "), F.regexp_replace(c["a"], r"\p{L}+$", "")), F.lit(_TERM), F.lit(0)))
    near = held.select(F.explode("near").alias("c")).select("c.entity", "c.b", "c.a").distinct()
    contexts = near.select("entity", F.explode(words({"b": F.col("b"), "a": F.col("a")})).alias("term")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") >= rule.contexts)
    # how many documents hold the entity, the term near it, and the term near any entity
    documents = lambda each, name: held.select(F.explode(F.array_distinct(each)).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias(name))
    entities = documents(F.col("near.entity"), "n_entity").withColumnRenamed("x", "entity")
    beside = documents(F.flatten(F.transform("near", words)), "n_beside").withColumnRenamed("x", "term")
    told = documents(F.flatten(F.transform("near", lambda c: F.transform(words(c), lambda w: F.struct(c["entity"].alias("entity"), w.alias("term"))))), "joint")
    joint = told.select("x.entity", "x.term", "joint")
    # the term stands in as many documents at least as it does near entities
    likely = contexts.drop("contexts").join(joint, ["entity", "term"]).join(beside, "term").where(F.col("joint") >= rule.likely * F.col("n_beside")).drop("n_beside")
    pairs = written(likely.join(entities, "entity"))
    if pairs.isEmpty():
        return pairs.selectExpr("term", "entity", "joint", "0D AS p", "0D AS bits")
    each = found.select(F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(_TERM), F.lit(0)))).alias("term"))
    # counted before the join, so that no join sees a row for each use of a common term
    counts = each.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    total = found.count()
    shown = pairs.join(counts, "term").select("term", "entity", "joint", (F.col("joint") / F.col("n_term")).alias("p"), F.log2(F.col("joint") * F.lit(float(total)) / (F.col("n_term") * F.col("n_entity"))).alias("bits"))
    return shown.where((F.col("p") >= rule.likely) & (F.col("bits") >= rule.bits))


def find(docs: DataFrame, *, rule: Disclosure | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text, base and spans (arrays of start, kind, end, value; spans holds base's too, by start,
    then kind) of every row's whole text.

    A null text counts as empty; an empty table gives no rows; repeated rows get one row each, and copies
    of one context are one context in the statistics, but as many documents. Other columns are ignored. Term spans never overlap an
    entity.
    """
    rule = rule or Disclosure()
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    # the patterns run once; what follows reads their spans beside the texts
    found = written(rows.withColumn("base", base_spans(F.col("text"))))
    terms = written(disclosing_terms(found, "text", rule).select("term").distinct())
    if terms.isEmpty():
        return found.select("doc_id", "text", "base", F.col("base").alias("spans"))
    holding = found.select("row", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_TERM), F.lit(0)))).alias("term")).join(terms, "term", "left_semi")
    # per row at most as many terms as it has words
    lists = holding.groupBy("row").agg(F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(F.sort_array(F.collect_list("term")), "|"), F.lit(r")(?!\p{L})")).alias("pattern"))
    both = found.join(written(lists), "row", "left")
    extra = F.when(F.col("pattern").isNotNull(), matches(F.col("text"), F.col("pattern"), len(PATTERNS))).otherwise(F.array().cast(_FOUND))
    clear = F.filter(extra, lambda t: ~F.exists("base", lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])))
    return both.select("doc_id", "text", "base", F.array_sort(F.concat(F.col("base"), clear)).alias("spans"))


def sanitised(found: DataFrame, *, remove: bool = False) -> DataFrame:
    """doc_id and text, each span generalised to its kind in angle brackets, or removed. Of overlapping
    spans the first in order is replaced."""
    names = F.array(*[F.lit("" if remove else f"<{k}>") for k in KINDS])
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, s: F.when(s["start"] >= a["at"], F.struct(F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.element_at(names, s["kind"] + 1)).alias("out"), s["end"].alias("at"))).otherwise(a)
    folded = F.aggregate("spans", start, step)
    return found.select("doc_id", F.concat(folded["out"], F.substring(F.col("text"), folded["at"] + 1, F.length("text"))).alias("text"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest_of(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(PATTERNS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
