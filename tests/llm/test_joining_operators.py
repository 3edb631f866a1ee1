"""Operators that bring rows together, and the pipeline, against brute force and on odd input."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kpi_spark.llm import bloom, chat, components, neardup, store, urls
from kpi_spark.llm import queries as Q
from kpi_spark.llm.store import Tables

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def shingle_set(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_groups(docs, k, percent):
    sets = {i: shingle_set(t, k) for i, t in docs}
    ids = sorted(sets)
    links = []
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                links.append((a, b))
    root = roots(ids, links)
    return {i: (len(sets[i]), root[i], root[i] == i) for i in ids}


def near_copies(seed, groups=6, size=25, words=120):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(words)]
        for _ in range(size):
            copy = list(base)
            for _ in range(r.randint(0, 8)):
                copy[r.randrange(words)] = r.choice(vocabulary)
            out.append(" ".join(copy))
    return out + [out[0], out[0].upper(), None, "", " \t", "one", "one", "one two", "x " * 5000]


@pytest.mark.parametrize(("k", "percent", "many"), [(3, 85, 150_000), (5, 80, 10)])
def test_groups(spark, monkeypatch, k, percent, many):
    monkeypatch.setattr(neardup, "MANY", many)
    docs = list(enumerate(near_copies(k)))
    df = spark.createDataFrame([(i, t, "own") for i, t in docs], "doc_id long, text string, kept string")
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.groups(df.repartition(3), Tables(spark, "t"), k, percent).collect()}
    assert out == brute_groups(docs, k, percent)
    left = neardup.dedup(df, Tables(spark, "t"), k, percent)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, v in out.items() if v[2])


def test_groups_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.groups(empty, Tables(spark, "t")).count() == 0 == neardup.dedup(empty, Tables(spark, "t")).count()
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id long, text string")
    out = sorted(neardup.groups(df, Tables(spark, "t")).collect(), key=str)
    assert [(r["doc_id"], r["component_id"], r["kept"]) for r in out] == [(1, 1, True), (2, 2, True), (3, 1, False), (3, 1, False), (None, None, True)]


def test_large_buckets_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PART", 3)
    docs = list(enumerate(near_copies(9, groups=3, size=12)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.groups(df, Tables(spark, "t"), 3, 85).collect()}
    assert out == brute_groups(docs, 3, 85)


def test_shared_folder_must_be_named_on_a_cluster():
    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.folder(Session())


def test_collision_correction():
    scheme = neardup.B_BIT
    assert scheme.bands(0.85) * scheme.rows <= scheme.slots and scheme.least(0.85) < scheme.slots * 0.8875


def test_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)] + [(7, 7), (1, 0)]
    nodes = {n for a, b in links if a != b for n in (a, b)}
    df = spark.createDataFrame(links, "a long, b long")
    out = {q["node"]: q["component"] for q in components.components(df, Tables(spark, "t")).collect()}
    assert out == roots(nodes, links)
    assert components.components(df.limit(0), Tables(spark, "t")).count() == 0


def test_merged_components(spark):
    """Components joined by links between them are those of all links together; unknown nodes are components of their own."""
    tables = Tables(spark, "t")
    first, more = [(1, 2), (3, 4), (5, 6), (20, 21)], [(1, 3), (3, 5), (7, 8), (5, 9), (1, 3)]
    found = components.components(spark.createDataFrame(first, "a long, b long"), tables)
    joined = components.merged(found, spark.createDataFrame(more, "p long, q long"), tables, "more")
    whole = components.components(spark.createDataFrame(first + more, "a long, b long"), tables, "whole")
    assert sorted(map(tuple, joined.select("node", "component").collect())) == sorted(map(tuple, whole.select("node", "component").collect()))
    none = spark.createDataFrame([], "p long, q long")
    assert components.merged(found, none, tables, "none").count() == 8


def test_bloom_has_no_false_negatives(spark):
    import numpy as np

    df = spark.range(5000).select(F.concat(F.lit("u"), "id").alias("k"))
    filter_ = bloom.build(F.col("k"), df)
    hashes = np.array([q[0] for q in df.select(F.xxhash64("k")).collect()], dtype=np.int64)
    other = np.array([q[0] for q in df.select(F.xxhash64(F.concat("k", F.lit("x")))).collect()], dtype=np.int64)
    assert bloom.maybe(filter_, hashes).all() and bloom.maybe(filter_, other).mean() < 0.15
    tiny = bloom.build(F.col("k"), df, most=64)
    assert len(tiny) == 64 and bloom.maybe(tiny, hashes).all()


# -- URLs --------------------------------------------------------------------------------


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(UPPER), re.match(r"[^?#]*", rest[len(host) :])[0]


def brute_rule(url):
    host, path = split(url)
    fits = [r for r in Q.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(str(r)), default=None)


def test_urls(spark):
    r = random.Random(5)
    hosts = ["com", "example.com", "a.Example.COM", "notexample.com", "x.net", "example.net", "b.example.net", "q.org", "spam.example.net", "www.spam.example.net:80", ""]
    paths = ["", "/", "/en/", "/en/7", "/en/75.html", "/de/", "/de/8/", "/de/80", "/es/1", "/EN/", "/x//", "/a\nb"]
    made = [f"{r.choice(['http', 'https'])}://{h}{p}{q}" for h in hosts for p in paths for q in ("", "?a=http://z/en/", "#top")]
    made += ["x" * 50_000, "x" * 50_000 + "://a.net/de/" + "y" * 50_000, None, "", "no scheme", "example.com/en/", "://", "a://b://c/en/"]
    pages = spark.createDataFrame([(i, u, "own") for i, u in enumerate(made)], "page_id long, url string, rule string")
    listed = spark.createDataFrame([("spam.example.net/x",), ("spam.example.net",), (None,)], "canonical string")
    tables = Tables(spark, "t")
    out = {q["page_id"]: q for q in urls.judge(pages, Q.URL_RULES, listed, tables).collect()}
    assert len(out) == len(made) and out == {q["page_id"]: q for q in urls.judge(pages, Q.URL_RULES, listed, tables, broadcast=0).collect()}
    for i, u in enumerate(made):
        rule, (host, path) = brute_rule(u), split(u)
        bare = re.sub(r":(80|443)$", "", re.sub(r"^(www|m)\.", "", host)) + re.sub(r"(\.html)?/*\Z", "", path)
        verdict = rule.verdict if rule else "block" if bare in ("spam.example.net/x", "spam.example.net") else "allow"
        assert (out[i]["host"], out[i]["path"], out[i]["rule"], out[i]["verdict"]) == (host, path, str(rule) if rule else None, verdict), u
    assert urls.judge(pages.limit(0), Q.URL_RULES, listed, tables).count() == 0
    free = urls.judge(pages, (), listed.limit(0), tables)
    assert free.where("verdict <> 'allow' or rule is not null").count() == 0


# -- conversations -----------------------------------------------------------------------


def brute_chat(rows):
    convs = {}
    for c, t, role, text in set(rows):
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, role, text))
    turns = {c: [(role, text) for _, _, role, text in sorted(v, key=str)] for c, v in convs.items()}
    return {c for c, v in turns.items() if not any(d != c and w[: len(v)] == v and (len(w) > len(v) or d < c) for d, w in turns.items())}, turns


def test_chat(spark):
    r = random.Random(6)
    rows = []
    for c in range(120):
        base = r.randrange(6)
        n = r.randint(1, 6)
        rows += [(c, t, ("user", "assistant")[t % 2], f"text {base} {t}" if t < 5 or c % 7 else f"end {c}") for t in range(n)]
    rows += [rows[0], (None, 0, "user", "x"), (500, 0, None, None), (501, 0, None, ""), (502, 0, None, None), (502, 1, "user", "")]
    df = spark.createDataFrame([(*q, "own") for q in rows], "conv_id long, turn long, role string, text string, chat string").withColumns({"n_turns": F.lit("own"), "n_copies": F.lit(1)})
    out = {q["conv_id"]: q for q in chat.collapse(df, Tables(spark, "t")).collect()}
    kept, turns = brute_chat(rows)
    assert set(out) == kept
    for c, q in out.items():
        assert q["n_turns"] == len(turns[c]) and q["chat"] == "".join(f"<|{role or 'unknown'}|>\n{text or ''}\n" for role, text in turns[c])
        assert q["n_copies"] == sum(v == turns[c] for v in turns.values())
    assert chat.collapse(df.limit(0), Tables(spark, "t")).count() == 0


# -- pipeline ----------------------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
    tables = Tables(spark, "test")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, kept = kept, tables.put(stage(spark, kept, SF), f"s{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert kept.columns == columns
        if k == 1:
            rows_ = [(q["doc_id"], q["text"]) for q in before.collect()]
            assert sorted(q["doc_id"] for q in kept.collect()) == sorted(i for i, v in brute_groups(rows_, 5, 80).items() if v[2])
    assert kept.where("not round_trip").count() == 0 and 0 < kept.count() < docs.count()
    assert kept.agg(F.sum("n_tokens")).first()[0] == kept.agg(F.sum(F.size("ids"))).first()[0]


def test_control_characters_are_parts_of_words(spark):
    """U+0000, U+0001 and A (lower-cased to a) are three different letters."""
    texts = ["a\x00 b c d", "a\x01 b c d", "aA b c d", "aa b c d", "a\x00 b c d"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r["doc_id"]: r["component_id"] for r in neardup.groups(df, Tables(spark, "t"), 3, 85).collect()}
    assert out == {0: 0, 1: 1, 2: 2, 3: 2, 4: 0}
    prints = {r["doc_id"]: r["fingerprint"] for r in Q.fingerprints.fingerprints(df.selectExpr("doc_id", "concat(text, ' e f g') as text")).collect()}
    assert len({prints[i] for i in range(4)}) == 3 and prints[0] == prints[4] and prints[2] == prints[3]


def test_long_conversations_span_ranges(spark):
    """3,000 turns, a prefix of them, and one that differs in its first turn."""
    rows = [(1, t, "user", f"turn {t}") for t in range(3000)] + [(2, t, "user", f"turn {t}") for t in range(2990)] + [(3, t, "user", f"turn {t + (t == 0)}") for t in range(50)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    out = {r["conv_id"]: (r["n_turns"], r["chat"]) for r in chat.collapse(df, Tables(spark, "t")).collect()}
    assert {c: n for c, (n, _) in out.items()} == {1: 3000, 3: 50}
    assert out[1][1] == "".join(f"<|user|>\nturn {t}\n" for t in range(3000))
