"""URL filters: rules on hosts and paths, and a list of canonical URLs behind a blocked Bloom filter.

:func:`judge` gives each row host, path, the rule that decides and a verdict.  Where no
rule fits, the list does: a filter of its canonical URLs, of bounded size, lets
possible hits through to an exact join, which takes out false positives; what the
filter stops needs no join.  A list of up to ``BROADCAST`` bytes is sent to all tasks,
so that one pass over the pages does; for a longer one the tested pages are written,
and only possible hits are shuffled.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path:
from there up to ``?``, ``#`` or the end.  A canonical URL is the host without a leading
``www.`` or ``m.`` label and without a default port, and the path without a final ``/`` or ``.html``.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule
and is allowed; an empty list blocks nothing; repeated rows are judged one by one; other
columns pass through and columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpi_spark.llm import bloom
from kpi_spark.llm.store import Tables

#: Bytes of listed URLs that are sent to all tasks at most.
BROADCAST = 16 << 20
RESULT = ("host", "path", "rule", "verdict", "canonical")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains and the paths that start like ``path``."""

    verdict: str
    host: str
    path: str

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)

    def __str__(self) -> str:
        return self.host + self.path


def host(url: Column) -> Column:
    return F.translate(_part(url, 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return _part(url, 2)


def _part(url: Column, k: int) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    return F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", k), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Null where there is no host."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^(?:www|m)\.", ""), r":(?:80|443)$", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, r"(?:\.html)?/*$", "")))


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host, path and canonical."""
    keep = [c for c in pages.columns if c.lower() not in RESULT]
    parts = pages.select(*keep, host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    return parts.withColumn("canonical", canonical(F.col("host"), F.col("path")))


def judge(pages: DataFrame, rules: tuple[Rule, ...], listed: DataFrame, tables: Tables, url: str = "url", broadcast: int = BROADCAST) -> DataFrame:
    """``pages`` with host, path, rule and verdict.  listed: a DataFrame with a column ``canonical``, the blocked URLs."""
    parts = with_parts(pages, url)
    listed = tables.put(listed.select("canonical").where("canonical is not null").distinct(), "listed")
    size = listed.agg(F.sum(F.octet_length("canonical") + 16)).first()[0] or 0
    filter_ = pages.sparkSession.sparkContext.broadcast(bloom.build(F.col("canonical"), listed))  # bounded, see bloom
    hashed = parts.withColumn("_h", F.xxhash64("canonical"))
    names = hashed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maybe = bloom.maybe(filter_.value, np.asarray(batch.column("_h"))) & np.asarray(batch.column("canonical").is_valid())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe)], [*names, "_maybe"])

    tested = hashed.mapInArrow(run, T.StructType([*hashed.schema.fields, T.StructField("_maybe", T.BooleanType())]))
    known = listed.select(F.col("canonical").alias("_listed"))
    if size <= broadcast:
        both = tested.join(F.broadcast(known), F.when(F.col("_maybe"), F.col("canonical")) == F.col("_listed"), "left")
    else:
        tested = tables.put(tested, "tested")
        hits = tested.where("_maybe").join(known, F.col("canonical") == F.col("_listed"), "left")
        both = hits.unionByName(tested.where("not _maybe").withColumn("_listed", F.lit(None).cast("string")))
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("_listed").isNotNull(), "block").otherwise("allow")
    for r in sorted(rules, key=lambda r: len(str(r))):  # the longest is asked first
        fits = r.fits(F.col("host"), F.col("path"))
        rule, verdict = F.when(fits, str(r)).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    keep = [c for c in names if c not in ("_h", "host", "path", "canonical")]
    return both.select(*keep, "host", "path", rule.alias("rule"), verdict.alias("verdict"))
