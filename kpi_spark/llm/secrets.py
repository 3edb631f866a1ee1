r"""Secret scans with a trigram inverted index.

:func:`scan` adds ``secrets``, an array of (kind, start, end), offsets in code points,
end exclusive, ordered by start, then by the order of the rules.  DataFrame functions only.

1. Each rule's pattern gives a Boolean query of trigrams that any match must hold (an OR
   of ANDs, lower case); a pattern from which none follows is a rule that scans fully.
2. One pass over the texts writes the postings (trigram, document) of all trigrams that
   the queries name; rows of one document and its trigrams are intersected after a
   shuffle by document, so that a trigram that most documents hold is spread as well.
3. The documents that pass a query are candidates of its rule.  Joined back to the
   texts (sent to all tasks up to ``BROADCAST`` candidates, else by a shuffle), they are
   verified by the pattern itself.  Fully scanning rules look at every text in that pass.

Matches are leftmost and don't overlap within a rule; those whose value is too short are
dropped and the search goes on behind them.  Offsets come from the lengths of matches and
of what lies between them: their running sums are taken in blocks of ``BLOCK``, whose totals
are summed the same way, so that a text takes time in proportion to its matches.

A trigram is looked for by ``contains``, one pass over the text each: texts have no native
list of their trigrams that would not copy or rescan a long text for each of them.

Defined results: null and empty texts hold none; rows that repeat an id share their
candidates but each text is verified by itself; rows with a null id are verified by all
rules; other columns pass through and an existing ``secrets`` column is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from re import _parser as pattern_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpi_spark.llm.store import Tables

#: Candidates that are sent to all tasks at most (an id and the numbers of a few rules each).
BROADCAST = 500_000
#: Lengths summed one by one, and levels of blocks of blocks (beyond BLOCK ** (LEVELS + 1) matches of a text the top level is longer).
BLOCK, LEVELS = 32, 4
#: Trigrams of one bit mask.
BITS = 62


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and which group of it must have how many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# fixed values: the patterns of well-known credentials.  Runs of one class with a least length are written {n,}.
# A token of three parts starts where its first part's run does: from within a run it would be looked for again and again.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
BASE = ("assign", "access", "hex")


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The OR of ANDs of lower-case trigrams that every match holds; an empty AND: the rule must scan fully."""

    def walk(nodes, states: list[tuple[frozenset[str], str]]) -> list[tuple[frozenset[str], str]]:
        for op, value in nodes:
            name = str(op)
            if name == "LITERAL":
                states = [(need | ({run[-2:] + c} if len(run) > 1 else set()), run + c) for need, run in states for c in [chr(value).lower()]]
            elif name == "SUBPATTERN":
                states = walk(value[-1], states)
            elif name == "BRANCH":
                states = [s for branch in value[1] for s in walk(branch, states)]
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
                states = walk(value[2], states)
                for _ in range(value[0] - 1 if str(value[2][0][0]) == "LITERAL" and len(value[2]) == 1 else 0):
                    states = walk(value[2], states)
                if value[1] != value[0] or str(value[2][0][0]) != "LITERAL":
                    states = [(need, "") for need, _ in states]
            elif name != "AT":
                states = [(need, "") for need, _ in states]
        return states

    return sorted({need for need, _ in walk(pattern_parser.parse(pattern), [(frozenset(), "")])}, key=sorted)


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id) of each of the trigrams that a document's lower-cased text holds."""
    low = docs.where("text is not null and doc_id is not null").select("doc_id", F.lower("text").alias("low"))
    held = F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams))
    return low.select("doc_id", F.explode(F.array_compact(held)).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, rules: their numbers) of the documents that pass the query of an indexed rule."""
    queries = {i: q for i, r in enumerate(rules) if all(q := trigram_query(r.pattern))}
    trigrams = sorted({t for q in queries.values() for need in q for t in need})
    masks = [trigrams[i : i + BITS] for i in range(0, len(trigrams), BITS)] or [[]]
    found = F.col("trigram")
    bits = [reduce(lambda e, i, m=mask: F.when(found == m[i], F.lit(1 << i)).otherwise(e), range(len(mask)), F.lit(0)).cast("long") for mask in masks]
    held = postings(docs, trigrams).groupBy("doc_id").agg(*(F.bit_or(b).alias(f"held{k}") for k, b in enumerate(bits)))

    def holds(need: frozenset[str]) -> Column:
        every = [sum(1 << i for i, t in enumerate(mask) if t in need) for mask in masks]
        return reduce(lambda p, q: p & q, (F.col(f"held{k}").bitwiseAND(F.lit(m).cast("long")) == m for k, m in enumerate(every) if m))

    passes = (F.when(reduce(lambda p, q: p | q, map(holds, query)), F.lit(i)) for i, query in queries.items())
    return held.select("doc_id", F.array_compact(F.array(F.lit(None).cast("int"), *passes)).alias("rules")).where("size(rules) > 0")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda acc, x: acc + x)


def starts(lengths: Column, levels: int = LEVELS) -> Column:
    """Sums of all lengths before each one."""

    def before(part: Column, base: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(part) - 1), lambda j: base + _sum(F.slice(part, F.lit(1), j)))

    if not levels:
        return before(lengths, F.lit(0))

    def blocks(values: Column) -> Column:
        last = F.floor((F.size(values) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))

    def summed(parts: Column) -> Column:
        return F.flatten(F.zip_with(parts, starts(F.transform(parts, _sum), levels - 1), before))

    return _let(lengths, lambda values: F.when(F.size(values) <= BLOCK, before(values, F.lit(0))).otherwise(_let(blocks(values), summed)))


def pieces(text: Column, rule: Rule, rank: int) -> Column:
    """The lengths of a rule's matches, of their values and of what lies between them, in a text that has some."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    size = lambda texts: F.transform(texts, lambda t: F.length(t))
    return F.struct(F.lit(rank).alias("rank"), F.lit(rule.least).alias("least"), size(F.split(text, rule.pattern, -1)).alias("between"), size(whole).alias("whole"), size(value).alias("value"))


def spans(part: Column) -> Column:
    """(start, rank, end) of the matches whose lengths :func:`pieces` gave."""

    def placed(between: Column) -> Column:
        steps = F.zip_with(between, part["whole"], lambda b, m: b + m)
        rows = F.arrays_zip(starts(steps).alias("before"), between.alias("between"), part["whole"].alias("whole"), part["value"].alias("value"))
        good = F.filter(rows, lambda r: r["value"] >= part["least"])
        return F.transform(good, lambda r: F.struct((r["before"] + r["between"]).alias("start"), part["rank"].alias("rank"), (r["before"] + r["between"] + r["whole"]).alias("end")))

    return _let(F.slice(part["between"], F.lit(1), F.size(part["whole"])), placed)


def scan(docs: DataFrame, tables: Tables, rules: tuple[Rule, ...] = RULES, broadcast: int = BROADCAST) -> DataFrame:
    """``docs`` (doc_id, text and others) with ``secrets``."""
    keep = [c for c in docs.columns if c.lower() not in ("secrets", "_rules", "_found")]
    docs = docs.select(*keep)
    found = tables.put(candidates(docs, rules), "candidates")
    few = found.count() <= broadcast
    side = found.withColumnsRenamed({"doc_id": "_id", "rules": "_rules"})
    joined = docs.join(F.broadcast(side) if few else side, docs["doc_id"] == F.col("_id"), "left")
    parts = []
    for i, rule in enumerate(rules):
        full = not all(trigram_query(rule.pattern))
        wanted = F.lit(True) if full else F.coalesce(F.array_contains("_rules", i), F.lit(False)) | F.col("doc_id").isNull()
        parts.append(F.when(wanted & F.coalesce(F.col("text").rlike(rule.pattern), F.lit(False)), pieces(F.col("text"), rule, i)))
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    named = lambda s: F.struct(kinds[s["rank"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    placed = F.array_sort(F.flatten(F.transform(F.array_compact(F.array(*parts)), spans)))
    return joined.withColumn("_found", placed).select(*keep, F.transform("_found", named).alias("secrets"))
