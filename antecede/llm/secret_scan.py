"""Operator 8: secret scans through a trigram inverted index, in built-in functions only.

A Boolean query over trigrams is derived from each rule's regex: the regex is walked into the runs of
letters that a match must hold, in each of its alternatives, and every text that it matches holds all
trigrams of at least one alternative. One pass over the texts keeps, for each document, the trigrams
that some query names; these become posting lists (trigram, block of documents, sorted ids), whose
intersections and unions inside each block are the candidates. Only candidates are read again and
verified by the regexes. A rule without mandatory trigrams is run over every text, in the first pass.
"""

from __future__ import annotations

import re
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from antecede.llm.common import marked, text_of, written

#: A class of at most this many characters is walked one by one, and at most so many alternatives are kept apart.
FEW, ALTERNATIVES = 8, 512
#: Documents are dealt into this many blocks of postings for each partition's worth of rows, so a list stays short.
BLOCK_ROWS = 65_536


class Rule(NamedTuple):
    kind: str
    regex: str
    #: Group whose length is held against `least`.
    group: int
    least: int


# The rules, in the order in which equal starts are listed.
RULES = (
    Rule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
    Rule("pem", r"-----BEGIN[A-Z\x20]*PRIVATE\x20KEY-----", 0, 1),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
)

SPANS = "array<struct<start:int,order:int,kind:string,end:int>>"


#: A match as pieces that follow each other: letters in lower case, or None for a gap that may hold anything.
Skeleton = tuple[str | None, ...]


def joined(a: Skeleton, b: Skeleton) -> Skeleton:
    if a and b and a[-1] is not None and b[0] is not None:
        return (*a[:-1], a[-1] + b[0], *b[1:])
    return a + b[1:] if a[-1:] == b[:1] == (None,) else a + b


def characters(members) -> set[str] | None:
    """Those of a class in lower case, or None if they are many or not listed."""
    out: set[str] = set()
    for kind, value in members:
        name = str(kind)
        if name == "RANGE" and value[1] - value[0] < 4 * FEW:
            out |= {chr(x).lower() for x in range(value[0], value[1] + 1)}
        elif name == "LITERAL":
            out.add(chr(value).lower())
        else:
            return None
    return out if len(out) <= FEW else None


def skeletons(parsed) -> set[Skeleton]:
    """Every match of a parsed regex is, in lower case, one of these; a gap stands for what isn't followed further."""
    out: set[Skeleton] = {()}
    for kind, value in parsed:
        name = str(kind)
        if name == "LITERAL":
            ways = {(chr(value).lower(),)}
        elif name == "IN":
            few = characters(value)
            ways = {(x,) for x in few} if few else {(None,)}
        elif name == "SUBPATTERN":
            ways = skeletons(value[3])
        elif name == "BRANCH":
            ways = set().union(*map(skeletons, value[1]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and (value[0] or value[1] == 1):
            least, most, inner = value
            ways = skeletons([*list(inner) * min(least, 3), *([("GAP", None)] if least > 3 or most > least > 0 else [])])
            ways |= set() if least else skeletons(inner) | {()}
        else:
            ways = {()} if name == "AT" else {(None,)}
        if len(out) * len(ways) > ALTERNATIVES:
            ways = {(None,)}
        out = {joined(a, b) for a, b in product(out, ways)}
    return out


def trigram_query(regex: str) -> list[list[str]] | None:
    """In disjunctive form: any of the alternatives, all of whose trigrams are needed. None: scan fully."""
    found = {frozenset(run[i : i + 3] for run in s if run for i in range(len(run) - 2)) for s in skeletons(re._parser.parse(regex))}
    needed = [x for x in found if not any(y < x for y in found)]  # who has all of x has all of y
    return sorted(map(sorted, needed)) if all(needed) else None


#: Matches whose spans are gathered in one array; those arrays are gathered in another, so that no long one is copied at each match.
CHUNK = 256


def spans_of(rule: Rule, order: int, text: Column) -> Column:
    """Spans of one rule's matches, leftmost and not overlapping, in code points.

    split() gives what lies between the matches that regexp_extract_all() gives, so the places are sums of lengths.
    """
    regex, none = F.lit(rule.regex), F.expr(f"cast(array() as {SPANS})")
    found = F.regexp_extract_all(text, regex, 0)
    measured = F.regexp_extract_all(text, regex, rule.group)
    size = lambda c: F.coalesce(F.char_length(c), F.lit(0))
    parts = F.arrays_zip(F.transform(F.split(text, rule.regex, -1), size).alias("gap"), F.transform(found, size).alias("hit"), F.transform(measured, size).alias("part"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["hit"], F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.coalesce(x["part"], F.lit(-1)) < rule.least, acc["spans"]).otherwise(F.concat(acc["spans"], span)).alias("spans"))

    def chunk(acc: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.struct(acc["at"].alias("at"), none.alias("spans")), step)
        return F.struct(inner["at"].alias("at"), F.when(F.size(inner["spans"]) > 0, F.concat(acc["all"], F.array(inner["spans"]))).otherwise(acc["all"]).alias("all"))

    def walk(some: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(some) - 1) / CHUNK).cast("int")), lambda k: F.slice(some, k * CHUNK + 1, CHUNK))
        return F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{SPANS}>)").alias("all")), chunk, lambda acc: F.flatten(acc["all"]))

    # Bound to a variable, so that the regexes run once for a text and not once for each chunk.
    walked = F.element_at(F.transform(F.array(parts), walk), 1)
    return F.when(text.rlike(at_least(rule)), walked).otherwise(none)


def at_least(rule: Rule) -> str:
    """A regex that finds something in every text with a span of the rule, to pass most texts by quickly."""
    return rf"{rule.regex[:-1]}{{{rule.least},}}" if rule.group == 0 and re.fullmatch(r"\[[^]]*\]\+", rule.regex) else rule.regex


def all_spans(rules: list[tuple[int, Rule]], text: Column) -> Column:
    return F.array_sort(F.concat(F.expr(f"cast(array() as {SPANS})"), *(spans_of(r, k, text) for k, r in rules)))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and `found`, the spans (start, order, kind, end) by start and rule: one row for each row of `docs`.

    A null text has no spans. Repeated doc_ids share their place in the index, and each row is
    verified by itself; rows whose doc_id is null aren't in the index and are all verified. Other
    columns are not read.
    """
    ordered = list(enumerate(rules))
    queries = {k: q for k, r in ordered if (q := trigram_query(r.regex))}
    full = [(k, r) for k, r in ordered if k not in queries]
    grams = sorted({g for q in queries.values() for one in q for g in one})
    texts = docs.select("doc_id", text_of().alias("text"))

    lower = texts.select("doc_id", "text", F.lower("text").alias("low"))
    held = F.filter(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(k).cast("short")) for k, g in enumerate(grams))), lambda x: x.isNotNull())
    scanned = written(lower.select("doc_id", held.alias("grams"), all_spans(full, F.col("text")).alias("found")), "scanned")

    ids = scanned.where("doc_id IS NOT NULL")
    # A block of ids whose lists are intersected together; blocks are as many as the rows ask for.
    blocks = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-scanned.count() // BLOCK_ROWS)))).cast("int")
    postings = ids.where(F.size("grams") > 0).select(blocks.alias("block"), F.explode("grams").alias("gram"), "doc_id").groupBy("block", "gram").agg(F.array_sort(F.collect_set("doc_id")).alias("ids"))
    lists = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "ids"))).alias("lists"))
    none = F.expr("cast(array() as array<bigint>)")

    def posting(gram: str) -> Column:
        return F.coalesce(F.try_element_at("lists", F.lit(grams.index(gram)).cast("short")), none)

    def meet(one: list[str]) -> Column:
        out = posting(one[0])
        for g in one[1:]:
            out = F.array_intersect(out, posting(g))
        return out

    union = none
    for q in queries.values():
        for one in q:
            union = F.array_union(union, meet(one))
    candidates = written(lists.select(F.explode(union).alias("doc_id")), "candidates")

    # Rows that the index doesn't name go by in a bitmap's test, without a shuffle of their texts.
    asked = marked(texts, F.col("doc_id"), candidates, F.col("doc_id")).where("__may").drop("__may")
    verified = asked.join(candidates, "doc_id", "left_semi").unionByName(texts.where("doc_id IS NULL")).select("doc_id", all_spans(ordered, F.col("text")).alias("found"))
    known = marked(ids.select("doc_id", "found"), F.col("doc_id"), candidates, F.col("doc_id"))
    seen = known.where("__may").drop("__may").join(candidates, "doc_id", "left_anti")
    return verified.unionByName(known.where("NOT __may").drop("__may")).unionByName(seen)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, base: tuple[str, ...] = ("assign", "access", "hex")) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: counts and digests of what `find_secrets` gives."""
    found = find_secrets(docs)
    of = lambda kinds: F.filter("found", lambda x: x["kind"].isin(*kinds))
    return found.select(
        "doc_id", *(F.size(of([k])).cast("long").alias(f"n_{k}") for k in base), F.sha2(listed(of(base)), 256).alias("base_sha256"), listed(F.col("found")).alias("spans")
    )
