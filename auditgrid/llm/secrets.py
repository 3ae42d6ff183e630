"""Secret scan over a trigram inverted index, in DataFrame expressions only.

From every rule's regular expression a Boolean query over lower-case trigrams is derived:
an OR of ANDs that every match must satisfy.  The index holds postings (trigram, text key)
of the trigrams that the queries name; a rule's candidates are the intersections of its
postings lists, and only candidates are verified with the expression itself.  A rule
without a mandatory trigram (a run of hex digits) is verified on every text.

A text's key is a 64-bit hash of the text: copies share their postings, and two texts of
one key would only share candidates, as each is verified.  Candidates go back to their
texts as a broadcast while ``broadcast_candidates`` rows hold them (16 bytes each), else
as a shuffled join; either way each text is verified in one scan.

Places are code points, ends exclusive.  A null text is an empty one.  Repeated rows each
get their result.  Other columns are ignored.  The time for a text grows with its length
and with the square of its number of matches.
"""

from __future__ import annotations

import re._parser as regex_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

BROADCAST_CANDIDATES = 1_000_000
_MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length must be `least` or more
    least: int = 0


#: In the order of their kinds.  The first three are the base rules.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # the longest run is the leftmost match either way
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
)

# ------------------------------------------------------------------- trigram queries

Query = frozenset[frozenset[str]]  # an OR of ANDs; an empty AND holds for every text
ANY: Query = frozenset([frozenset()])


def _simple(clauses) -> Query:
    """Without clauses that a weaker clause makes needless."""
    clauses = set(clauses)
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _both(a: Query, b: Query) -> Query:
    return _simple(x | y for x in a for y in b)


def _grams(strings: set[str]) -> Query:
    return _simple(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _strings(op, arg) -> set[str] | None:
    """All strings that a part matches, in lower case; None if they are too many."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}
    if name == "AT":
        return {""}
    if name == "IN":
        out: set[str] = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                out.add(chr(value).lower())
            elif str(kind) == "RANGE" and value[1] - value[0] < 8:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if name == "SUBPATTERN":
        return _joined(arg[-1])
    if name == "BRANCH":
        parts = [_joined(x) for x in arg[1]]
        return set().union(*parts) if all(p is not None for p in parts) else None
    if name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] <= 4:
        one = _joined(arg[2])
        out = set()
        for n in range(arg[0], arg[1] + 1):
            some = {""}
            for _ in range(n):
                some = {a + b for a in some for b in one} if one is not None and len(some) * len(one) <= _MOST_STRINGS else None
                if some is None:
                    return None
            out |= some
        return out
    return None


def _joined(parts) -> set[str] | None:
    out = {""}
    for op, arg in parts:
        each = _strings(op, arg)
        if each is None or len(out) * len(each) > _MOST_STRINGS:
            return None
        out = {a + b for a in out for b in each}
    return out


def _query(parts) -> Query:
    found, run = ANY, {""}
    for op, arg in parts:
        each = _strings(op, arg)
        if each is not None and len(run) * len(each) <= _MOST_STRINGS:
            run = {a + b for a in run for b in each}
            continue
        found, run = _both(found, _grams(run)), {""}
        name = str(op)
        if name == "SUBPATTERN":
            found = _both(found, _query(arg[-1]))
        elif name == "BRANCH":
            found = _both(found, _simple(c for x in arg[1] for c in _query(x)))
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
            found = _both(found, _query(arg[2]))
    return _both(found, _grams(run))


def trigram_query(pattern: str) -> Query:
    """What the lower-case trigrams of any text with a match must satisfy."""
    return _query(regex_parser.parse(pattern))


# ------------------------------------------------------------------------------ index


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (gram, key): the position in ``trigrams`` of each that a text holds."""
    low = docs.select(text_key(F.col("text")).alias("key"), F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(trigrams)]))
    return low.select("key", F.explode(held).alias("gram"))


def candidates(index: DataFrame, queries: list[Query], trigrams: list[str]) -> DataFrame:
    """(key, mask): bit r is set where query r holds, by intersecting postings."""
    number = {g: i for i, g in enumerate(trigrams)}
    clauses = [(r, c) for r, q in enumerate(queries) for c in sorted(map(sorted, q)) if c]
    rows = [(number[g], k, 1 << r, 1 << i, (1 << len(c)) - 1) for k, (r, c) in enumerate(clauses) for i, g in enumerate(c)]
    asked = index.sparkSession.createDataFrame(rows, "gram int, clause int, rule int, bit long, all long")
    # a copy's postings repeat: distinct trigrams are counted, as bits
    met = index.join(F.broadcast(asked), "gram").groupBy("key", "clause", "rule", "all").agg(F.bit_or("bit").alias("bits"))
    return met.filter(F.col("bits") == F.col("all")).groupBy("key").agg(F.bit_or("rule").alias("mask"))


# ------------------------------------------------------------------------------- scan


def _spans(rule: Rule, order: int, wanted: Column) -> Column:
    """start, order, end of a rule's matches, leftmost and without overlap."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    sizes = F.transform(found, F.length)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    value = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else sizes
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    at = F.transform(F.arrays_zip(sizes.alias("n"), value.alias("v")), lambda m, i: F.struct((total(F.slice(gaps, 1, i + 1)) + total(F.slice(sizes, 1, i))).alias("start"), F.lit(order).alias("kind"), m["n"].alias("n"), m["v"].alias("v")))
    kept = F.transform(F.filter(at, lambda m: m["v"] >= rule.least), lambda m: F.struct(m["start"], m["kind"], (m["start"] + m["n"]).alias("end")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return F.when(wanted & F.regexp_like(text, pattern), kept).otherwise(none)


def _written_out(spans: Column, kinds: list[str]) -> Column:
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE, broadcast_candidates: int = BROADCAST_CANDIDATES) -> DataFrame:
    """doc_id, n_<kind> of each base rule, base_sha256, spans."""
    rules = [*base, *more]
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted({g for q in queries for c in q for g in c})
    if len(rules) > 31 or any(len(c) > 63 for q in queries for c in q):
        raise ValueError("at most 31 rules, of 63 trigrams a clause: scan more rules in parts")
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = written(candidates(trigram_index(rows, trigrams), queries, trigrams), "candidates")
    side = F.broadcast(found) if found.count() <= broadcast_candidates else found
    full = sum(1 << r for r, q in enumerate(queries) if frozenset() in q)
    mask = F.coalesce(F.col("mask"), F.lit(0)).bitwiseOR(F.lit(full))
    keyed = rows.withColumn("key", text_key(F.col("text"))).join(side, "key", "left").select("doc_id", "text", mask.alias("mask"))
    spans = keyed.select("doc_id", *[_spans(r, i, F.col("mask").bitwiseAND(F.lit(1 << i)) != 0).alias(f"s{i}") for i, r in enumerate(rules)])
    kinds = [r.kind for r in rules]
    own = F.concat(*[F.col(f"s{i}") for i in range(len(base))])
    every = F.concat(*[F.col(f"s{i}") for i in range(len(rules))])
    return spans.select("doc_id", *[F.size(f"s{i}").cast("long").alias(f"n_{r.kind}") for i, r in enumerate(base)], F.sha2(_written_out(own, kinds).cast("binary"), 256).alias("base_sha256"), _written_out(every, kinds).alias("spans"))
