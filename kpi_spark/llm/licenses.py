r"""License scans with a positional rare-token index.  DataFrame functions only.

Words: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the lower-cased text (other scripts'
letters are lower-cased too, which changes neither the number of words nor the phrases).

1. One pass counts in how many documents each word of the templates stands; a phrase's
   anchors are its ``ANCHORS`` words of highest IDF.
2. Each document's postings are the positions of anchor words only.  Postings of a
   phrase's anchors, moved by their offsets in it, are intersected by relative
   position; what is left are the places at which the phrase may start.
3. There the whole phrase is verified word by word.  A template's label is given when all
   its mandatory phrases stand in the text.

Everything after the count is per-row: no shuffle, whole texts.  Defined results: null and
empty texts have no words and no labels, score 0; repeated rows are scanned one by one;
other columns pass through and columns named like a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a phrase that are looked up in the index.
ANCHORS = 3
RESULT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@dataclass(frozen=True)
class Template:
    """A license: its label, the phrases that must all stand in a text, and whether it is one of the base ones."""

    label: str
    phrases: tuple[str, ...]
    base: bool = False


# fixed values: names and opening words of well-known licenses
TEMPLATES = (
    Template("gpl", ("gnu general public license",), base=True),
    Template("apache", ("apache license",), base=True),
    Template("cc-by", ("cc by",), base=True),
    Template("mit", ("mit license",), base=True),
    Template("apache-2.0", ("apache license version 2 0",)),
    Template("gpl-2.0", ("gnu general public license version 2",)),
    Template("gpl-3.0", ("gnu general public license version 3",)),
    Template("lgpl", ("gnu lesser general public license",)),
    Template("agpl", ("gnu affero general public license",)),
    Template("mpl-2.0", ("mozilla public license version 2 0",)),
    Template("cc-by-nc", ("cc by nc",)),
    Template("cc-by-nd", ("cc by nd",)),
    Template("cc-by-sa", ("cc by sa",)),
    Template("bsd", ("redistribution and use in source and binary forms", "this software is provided by the copyright holders")),
    Template("mit-text", ("permission is hereby granted free of charge", "the software is provided as is")),
    Template("isc-text", ("permission to use copy modify and or distribute this software", "the software is provided as is")),
    Template("unlicense", ("free and unencumbered software released into the public domain",)),
)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def document_counts(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, int]:
    """In how many documents each word stands (one row a word of the templates comes back)."""
    known = F.array(*map(F.lit, vocabulary))
    counts = docs.select(F.explode(F.array_intersect(words(F.col(text)), known)).alias("word")).groupBy("word").count()
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["count"] for r in counts.collect()}


def _places(phrase: list[str], rare: list[str]) -> Column:
    """Positions at which the phrase stands, from the columns _words and _postings."""
    token = lambda i: F.get(F.col("_words"), i)

    def moved(word: str) -> Column:
        shift = phrase.index(word)
        return F.transform(F.filter("_postings", lambda i: token(i) == word), lambda i: i - shift)

    maybe = reduce(F.array_intersect, map(moved, rare))
    whole = F.array(*map(F.lit, phrase))
    return F.filter(maybe, lambda i: (i >= 0) & (F.slice("_words", i + 1, F.lit(len(phrase))) == whole))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels and score.

    score: the largest share of a template's mandatory phrases that stand in the text.
    """
    keep = [c for c in docs.columns if c.lower() not in RESULT and (keep_text or c != text)]
    phrases = sorted({p for t in templates for p in t.phrases})
    seen = document_counts(docs, sorted({w for p in phrases for w in p.split()}), text)
    rare = {p: sorted(dict.fromkeys(p.split()), key=lambda w: (seen[w], w))[:ANCHORS] for p in phrases}
    anchors = sorted({w for ws in rare.values() for w in ws})
    split = docs.select(*keep, words(F.col(text)).alias("_words"))
    last = F.size("_words") - 1
    inside = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.coalesce(F.get(F.col("_words"), i).isin(anchors), F.lit(False)))
    indexed = split.select(*keep, "_words", inside.alias("_postings"))
    none = F.array().cast("array<int>")
    column = {p: f"_p{k}" for k, p in enumerate(phrases)}
    found = indexed.select(*keep, F.size("_words").cast("long").alias("n_words"), *(F.when(F.size("_postings") > 0, _places(p.split(), rare[p])).otherwise(none).alias(column[p]) for p in phrases))
    base = [column[p] for t in templates if t.base for p in t.phrases]
    share = {t.label: sum((F.size(column[p]) > 0).cast("int") for p in t.phrases) / F.lit(float(len(t.phrases))) for t in templates}
    labels = lambda some: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(share[t.label] == 1, F.lit(t.label)) for t in some))))), ",")
    return found.select(
        *keep,
        "n_words",
        reduce(lambda x, y: x + y, (F.size(c) for c in base)).cast("long").alias("n_base"),
        F.array_min(F.concat(*base)).cast("long").alias("first_word"),
        F.array_max(F.concat(*base)).cast("long").alias("last_word"),
        labels([t for t in templates if t.base]).alias("base_labels"),
        labels(templates).alias("labels"),
        F.greatest(*share.values()).alias("score"),
    )
