"""URL filters: explicit rules first, then gradient-boosted trees on lexical features.

DataFrame functions only. Features are length, depth, digit ratio, entropy, parameter counts and
target statistics: how often labelled urls were blocked whose host has the same last label, and whose
path begins with the same two-letter segment, by hash. The trees
are learned from labelled URLs, here those that a rule covers. Features are cut into a few bins, so a
tree level is one aggregation over (leaf, feature, bin), and a finished model is a plain expression.
Gradients are summed as integers, so the same rows give the same trees in any order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

BUCKETS = 256
_SCALE = 1_000_000


@dataclass(frozen=True)
class Rule:
    """verdict for a host with all its subdomains, where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @staticmethod
    def parse(text: str) -> Rule:
        verdict, where = text.split(" ", 1)
        host, slash, path = where.partition("/")
        return Rule(verdict, host, slash + path)


def parts_of(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty where there is no `://`."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, lower).otherwise(""), F.when(has, path).otherwise("")


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))


def matched(rules: list[Rule], host: Column, path: Column, what: str) -> Column:
    """name or verdict of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        out = F.when(fits(r, host, path), F.lit(getattr(r, what))).otherwise(out)
    return out


def keys_of(host: Column, path: Column) -> dict[str, Column]:
    """The hashed keys of the target statistics."""
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")
    return {"suffix": bucket(F.substring_index(host, ".", -1)), "language": bucket(F.regexp_extract(path, r"^/([a-z]{2})/", 1))}


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    n = F.length(text).cast("double")
    runs = F.regexp_extract_all(F.array_join(F.sort_array(F.split(text, "")), ""), F.lit(r"(?s)(.)\1*+"), F.lit(0))  # of equal characters
    return F.when(n > 0, F.aggregate(runs, F.lit(0.0), lambda a, r: a - F.length(r) / n * F.log2(F.length(r) / n))).otherwise(0.0)


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Each rounded to 6 places, so that equal urls land in equal bins everywhere."""
    whole = F.coalesce(url, F.lit(""))
    count = lambda c, pattern: F.length(F.regexp_replace(c, f"[^{pattern}]", "")).cast("double")
    query = F.when(F.instr(whole, "?") > 0, F.substring_index(F.substring(whole, F.instr(whole, "?") + 1, F.length(whole)), "#", 1)).otherwise("")
    out = {
        "length": F.length(whole).cast("double"),
        "host_length": F.length(host).cast("double"),
        "labels": count(host, ".") + 1,
        "hyphens": count(host, r"\-"),
        "depth": count(path, "/"),
        "digits": count(whole, "0-9") / F.greatest(F.lit(1.0), F.length(whole).cast("double")),
        "path_digits": count(path, "0-9"),
        "entropy": _entropy(whole),
        "host_entropy": _entropy(host),
        "parameters": F.when(F.length(query) > 0, count(query, "&") + 1).otherwise(0.0),
        "extension": F.length(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).cast("double"),
        "secure": F.startswith(whole, F.lit("https:")).cast("double"),
    }
    return {k: F.round(v, 6) for k, v in out.items()}


@dataclass
class Trees:
    """Target statistics by bucket, bin edges of each feature, and trees of nested (feature, bin, left,
    right)."""

    rates: dict[str, list[float]]
    edges: dict[str, list[float]]
    trees: list = field(default_factory=list)
    bias: float = 0.0

    def bins(self, values: dict[str, Column]) -> dict[str, Column]:
        """How many edges lie below the value."""
        return {k: reduce(lambda a, b: a + b, [(values[k] > e).cast("int") for e in edges], F.lit(0)) for k, edges in self.edges.items()}

    def values(self, url: Column, host: Column, path: Column) -> dict[str, Column]:
        """All features; a statistic is the blocked share of the url's bucket."""
        keys = keys_of(host, path)
        return features(url, host, path) | {k: F.element_at(F.array(*[F.lit(x) for x in rate]), keys[k] + 1) for k, rate in self.rates.items()}

    def margin(self, binned: dict[str, Column]) -> Column:
        return reduce(lambda a, b: a + b, [_value(t, binned) for t in self.trees], F.lit(self.bias))


def _value(tree, binned: dict[str, Column]) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    name, at, left, right = tree
    return F.when(binned[name] <= at, _value(left, binned)).otherwise(_value(right, binned))


def _split(stats: dict[tuple[str, int], tuple[int, int]], least: float, ridge: float):
    """Best (gain, feature, bin) of one leaf from its (gradient, hessian) sums by feature and bin."""
    by: dict[str, dict[int, tuple[int, int]]] = {}
    for (name, b), s in stats.items():
        by.setdefault(name, {})[b] = s
    score = lambda g, h: (g / _SCALE) ** 2 / (h / _SCALE + ridge)
    best = (1e-9, "", 0)
    for name in sorted(by):
        bins = sorted(by[name])
        gs, hs = sum(by[name][b][0] for b in bins), sum(by[name][b][1] for b in bins)
        g = h = 0
        for b in bins[:-1]:
            g, h = g + by[name][b][0], h + by[name][b][1]
            if min(h, hs - h) / _SCALE >= least and (gain := score(g, h) + score(gs - g, hs - h) - score(gs, hs)) > best[0] + 1e-9:
                best = (gain, name, b)
    return best


def learn(labelled: DataFrame, *, rounds: int = 6, depth: int = 3, rate: float = 0.5, bins: int = 8, most_rows: int = 20_000, least: float = 1.0, ridge: float = 1.0) -> Trees:
    """Trees from rows of (url, host, path, blocked 0/1); about `most_rows` of them at most, those
    with the smallest hash of the url. Without rows every url is allowed."""
    rows = labelled.where("blocked is not null").select("url", "host", "path", F.col("blocked").cast("int").alias("y"))
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), b.alias("b")) for k, b in keys_of(F.col("host"), F.col("path")).items()])).alias("at")
    totals = rows.select("y", keys).groupBy("at.k", "at.b").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).collect()  # statistics x buckets
    n, blocked = sum(r["n"] for r in totals if r["k"] == "suffix"), sum(r["y"] for r in totals if r["k"] == "suffix")
    prior = (blocked + 0.5) / (n + 1)
    rates = {k: [round(prior, 6)] * BUCKETS for k in ("suffix", "language")}
    for r in totals:
        rates[r["k"]][r["b"]] = round((r["y"] + 10 * prior) / (r["n"] + 10), 6)
    model = Trees(rates, {}, [], round(math.log(prior / (1 - prior)), 6) if n else -1.0)
    if not n or blocked in (0, n):
        model.bias = 1.0 if n and blocked == n else -1.0
        return model
    share = int(min(1.0, most_rows / n) * (2**62 - 1))
    picked = rows.where(F.shiftrightunsigned(F.xxhash64("url"), 2) <= share)
    values = model.values(F.col("url"), F.col("host"), F.col("path"))
    table = picked.select("y", *[v.alias(k) for k, v in values.items()])
    names = list(values)
    quantiles = table.agg(*[F.percentile(k, F.array(*[F.lit(q / bins) for q in range(1, bins)])).alias(k) for k in names]).first()
    model.edges = {k: sorted({round(x, 6) for x in quantiles[k]} | ({0.0} if k in ("parameters", "extension", "hyphens") else set())) for k in names}
    binned = model.bins({k: F.col(k) for k in names})
    packed = written(table.select("y", *[b.alias(k) for k, b in binned.items()]).groupBy("y", *names).agg(F.count(F.lit(1)).alias("w")))
    cols = {k: F.col(k) for k in names}
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-model.margin(cols)))
        base = packed.select(*names, (F.round((F.col("y") - p) * _SCALE).cast("long") * F.col("w")).alias("g"), (F.round(F.greatest(p * (1 - p), F.lit(1e-4)) * _SCALE).cast("long") * F.col("w")).alias("h"))
        leaves: dict[int, list] = {1: []}  # node number -> tests on the way
        made: dict[int, tuple[str, int]] = {}
        sums: dict[int, tuple[int, int]] = {}
        for _ in range(depth + 1):
            if not leaves:
                break
            leaf = F.lit(0)
            for node, tests in leaves.items():
                here = reduce(lambda a, b: a & b, [(F.col(k) <= at) if left else (F.col(k) > at) for k, at, left in tests], F.lit(True))
                leaf = F.when(here, F.lit(node)).otherwise(leaf)
            long = base.select(leaf.alias("leaf"), "g", "h", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("b")) for k in names])).alias("f")).where("leaf > 0")
            found: dict[int, dict] = {}
            for r in long.groupBy("leaf", "f.k", "f.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():  # leaves x features x bins
                found.setdefault(r["leaf"], {})[r["k"], r["b"]] = (r["g"], r["h"])
            grown = {}
            for node, stats in found.items():
                some = names[0]
                sums[node] = (sum(s[0] for (k, _), s in stats.items() if k == some), sum(s[1] for (k, _), s in stats.items() if k == some))
                gain, name, at = _split(stats, least, ridge)
                if name and node < 2**depth:
                    made[node] = (name, at)
                    grown[2 * node] = [*leaves[node], (name, at, True)]
                    grown[2 * node + 1] = [*leaves[node], (name, at, False)]
            leaves = grown

        def tree(node: int, made=made, sums=sums):
            if node not in made:
                g, h = sums.get(node, (0, 0))
                return round(rate * (g / _SCALE) / (h / _SCALE + ridge), 6)
            return (*made[node], tree(2 * node), tree(2 * node + 1))

        model.trees.append(tree(1))
        if not made:
            break
    return model


def judge(pages: DataFrame, rules: list[Rule], *, model: Trees | None = None, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict, score (the method's probability of block) of every row.

    A null url, or one without `://`, has an empty host and path: no rule fits, the method judges it.
    Repeated rows get one row each; an empty table gives none; other columns are ignored. Of rules that
    fit, the longest wins, of equally long ones the last in order. Without a model one is learned from
    the urls that a rule covers.
    """
    host, path = parts_of(F.col("url"))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    ruled = rows.withColumns({"rule": matched(rules, F.col("host"), F.col("path"), "name"), "said": matched(rules, F.col("host"), F.col("path"), "verdict")})
    if model is None:
        model = learn(ruled.where("said is not null").select("url", "host", "path", (F.col("said") == "block").cast("int").alias("blocked")))
    values = model.values(F.col("url"), F.col("host"), F.col("path"))
    used = {k: v for k, v in values.items() if k in model.edges}
    scored = ruled.withColumns({f"__{k}": b for k, b in model.bins(used).items()})
    margin = model.margin({k: F.col(f"__{k}") for k in used})
    p = F.round(1 / (1 + F.exp(-margin)), 6)
    return scored.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(p > 0.5, "block").otherwise("allow")).alias("verdict"), p.alias("score"))
