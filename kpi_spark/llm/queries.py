"""The registered queries of this subpackage and their SQL.

Every query reads its whole tables through its operator and derives the digest
columns that its result is compared by.
"""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpi_spark.llm import bpe, chat, decontam, fingerprints, licenses, neardup, packing, pii, quality, secrets, spelling, trie, urls
from kpi_spark.llm.store import Tables

#: Name of the rank file of the byte-level encoder.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: The ranks of byte_bpe_50k.json, for packing.
PACKED_VOCABULARY = "byte_bpe_50k.tiktoken"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rank_lines(name: str = VOCABULARY) -> str:
    with open(public_tokenizers.path(name), encoding="ascii") as f:
        return f.read()


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document."""
    return bpe.round_trip(documents(spark, sf_dir).select("doc_id", "text"), rank_lines(), keep_text=False).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.with_edits(documents(spark, sf_dir))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of every document."""
    return licenses.scan(documents(spark, sf_dir).select("doc_id", "text"), keep_text=False)


def op3_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, by a model learned from the labelled ones that aren't held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, keep_text=False).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def _digest(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, plain and disguised."""
    found = pii.detect(documents(spark, sf_dir).select("doc_id", "text"), keep_text=False)
    plain = F.filter("pii", lambda s: s["plain"])
    of = lambda kind: F.size(F.filter(plain, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(of, pii.KINDS), F.sha2(_digest(plain).cast("binary"), 256).alias("base_sha256"), _digest(F.col("pii")).alias("spans"))


def op5_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document repeats of the benchmark."""
    found = decontam.search(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_text=False)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        decontam.contaminated().alias("contaminated"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["length"])), F.lit(0)).cast("long").alias("longest_match"),
    )


def op7_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations that no longer one extends, rendered."""
    return chat.collapse(spark.read.parquet(f"{sf_dir}/conversations.parquet"), Tables(spark, "op7"))


def op8_bbit_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicates by three-word shingles at 85 percent."""
    return neardup.groups(documents(spark, sf_dir), Tables(spark, "op8"), shingle=3, percent=85)


#: Rules of op9, and the words in a host that put a page's canonical URL on its list.
URL_RULES = (
    urls.Rule("block", "com", "/en/"),
    urls.Rule("allow", "example.com", "/en/7"),
    urls.Rule("allow", "net", "/de/"),
    urls.Rule("block", "example.net", "/de/8"),
    urls.Rule("block", "org", "/es/"),
)
LISTED_HOSTS = "casino|bets|pills|spam|ads-"


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's URL; the list holds the canonical URLs of hosts that look like spam."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    listed = urls.with_parts(pages).where(F.col("host").rlike(LISTED_HOSTS)).select("canonical")
    return urls.judge(pages, URL_RULES, listed, Tables(spark, "op9")).drop("url")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    found = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"), Tables(spark, "op10")).drop("text")
    base = F.filter("secrets", lambda s: s["kind"].isin(*secrets.BASE))
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(of, secrets.BASE), F.sha2(_digest(base).cast("binary"), 256).alias("base_sha256"), _digest(F.col("secrets")).alias("spans"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in a sequence of 2048 tokens."""
    tables = Tables(spark, "op11")
    parts = tables.put(packing.pieces(documents(spark, sf_dir), rank_lines(PACKED_VOCABULARY)), "pieces")
    return packing.pack(parts, tables).drop("row", "certified")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations' prefixes."""
    return trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), Tables(spark, "op12"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word, its more frequent form at one edit and that chain's end."""
    return spelling.group(documents(spark, sf_dir), Tables(spark, "op13"))


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_licenses": op2_licenses,
    "op3_subword_quality": op3_subword_quality,
    "op4_pii": op4_pii,
    "op5_suffix_decontamination": op5_suffix_decontamination,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_chat_snapshots": op7_chat_snapshots,
    "op8_bbit_near_dedup": op8_bbit_near_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_secrets": op10_secrets,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_spelling_variants": op13_spelling_variants,
}

_ALNUM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_NONSPACE = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


#: CRC-32 of a list of bytes, a bit at a time.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {bytes}), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))))"


def _licenses_sql() -> str:
    """Every phrase looked for at every word."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    phrases = sorted({p for t in licenses.TEMPLATES for p in t.phrases})
    stands = {p: "(" + " AND ".join(f"w{k} = {quoted(w)}" for k, w in enumerate(p.split())) + ")" for p in phrases}
    following = ", ".join(f"lead(w0, {k}) OVER o AS w{k}" for k in range(1, max(len(p.split()) for p in phrases)))
    counts = ", ".join(f"count(*) FILTER ({stands[p]}) AS p{k}" for k, p in enumerate(phrases))
    base = [t for t in licenses.TEMPLATES if t.base]
    any_base = " OR ".join(stands[p] for t in base for p in t.phrases)
    share = {t.label: "(" + " + ".join(f"(coalesce(p{phrases.index(p)}, 0) > 0)::INT" for p in t.phrases) + f") / {len(t.phrases)}.0" for t in licenses.TEMPLATES}
    labels = lambda some: "coalesce(array_to_string(list_sort([x FOR x IN [" + ", ".join(f"CASE WHEN {share[t.label]} = 1 THEN {quoted(t.label)} END" for t in some) + "] IF x IS NOT NULL]), ','), '')"
    n_base = " + ".join(f"coalesce(p{phrases.index(p)}, 0)" for t in base for p in t.phrases)
    return f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS ws FROM documents), u AS (SELECT doc_id, unnest(ws) AS w0, unnest(range(len(ws))) AS i FROM d),
     l AS (SELECT *, {following} FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
     c AS (SELECT doc_id, {counts}, min(i) FILTER ({any_base}) AS first_word, max(i) FILTER ({any_base}) AS last_word FROM l GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST({n_base} AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       {labels(base)} AS base_labels, {labels(licenses.TEMPLATES)} AS labels, CAST(greatest({", ".join(share.values())}) AS DOUBLE) AS score FROM d LEFT JOIN c USING (doc_id)"""


def _secrets_sql() -> str:
    """Every pattern over every text; offsets by running sums of lengths."""
    plain = lambda p: re.sub(r"^\(\?<!\[(.*?)\]\)(.*)$", r"(?:^|[^\1])(\2)", p)  # noqa: E731  no lookbehind there: the sign before is matched, and the rest is the group
    caseless = lambda p: re.sub(r"\(\?i:(\([^)]*\))\)", lambda m: re.sub("[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", m[1]), plain(p))
    own = lambda r: 1 if "(?<!" in r.pattern else 0
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    parts = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS rank, {quoted(r.kind)} AS kind, {r.least} AS least, regexp_extract_all(t, {quoted(caseless(r.pattern))}) AS m, regexp_extract_all(t, {quoted(caseless(r.pattern))}, {own(r)}) AS o, regexp_extract_all(t, {quoted(caseless(r.pattern))}, {r.group or own(r)}) AS v, regexp_split_to_array(t, {quoted(caseless(r.pattern))}) AS b FROM d" for k, r in enumerate(secrets.RULES)
    )
    text = "kind || ':' || a || ':' || e"
    kinds = ", ".join(f"CAST(coalesce(count(*) FILTER (kind = '{k}'), 0) AS BIGINT) AS n_{k}" for k in secrets.BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), p AS (SELECT * FROM ({parts}) WHERE len(m) > 0),
     u AS (SELECT doc_id, rank, kind, least, unnest(range(len(m))) AS i, length(unnest(m)) AS m, length(unnest(o)) AS o, length(unnest(v)) AS v, length(unnest(b[1:len(m)])) AS b FROM p),
     s AS (SELECT *, CAST(sum(b + m) OVER (PARTITION BY doc_id, rank ORDER BY i) AS BIGINT) AS e FROM u), g AS (SELECT *, e - o AS a FROM s WHERE v >= least)
SELECT d.doc_id, {kinds}, sha256(coalesce(string_agg({text}, ',' ORDER BY a, rank) FILTER (rank < {len(secrets.BASE)}), '')) AS base_sha256, coalesce(string_agg({text}, ',' ORDER BY a, rank), '') AS spans
FROM d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id"""


def _urls_sql() -> str:
    """Rules by strings, the list by a plain join."""
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    rules = sorted(URL_RULES, key=lambda r: -len(str(r)))
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{value(r)}'" for r in rules)
    return rf"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
     h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
     c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^(?:www|m)\.', ''), ':(?:80|443)$', '') || regexp_replace(path, '(?:\.html)?/*$', '') END AS canonical FROM h),
     l AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(host, '{LISTED_HOSTS}'))
SELECT page_id, host, path, {case(str)} END AS rule, {case(lambda r: r.verdict)} WHEN canonical IN (SELECT canonical FROM l WHERE canonical IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict FROM c"""


ORACLE: dict[str, str] = {
    "op12_prefix_trie": f"""
WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p,
            [coalesce(role, ''), coalesce(text, '')] AS x, length(coalesce(text, '')) AS n_chars FROM conversations WHERE conv_id IS NOT NULL),
     s AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 100 AS base, {_CRC.format(bytes="list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)")} % 6 AS h FROM t GROUP BY conv_id),
     c AS (SELECT s.conv_id, s.base, s.n, s.h, least(s.h, coalesce(b.n, 0)) AS head FROM s LEFT JOIN s AS b ON b.conv_id = s.base),
     r AS (SELECT c.conv_id, t.p, t.x, t.n_chars FROM c JOIN t ON t.conv_id = c.base AND t.p <= c.head UNION ALL SELECT c.conv_id, t.p - c.h + c.head, t.x, t.n_chars FROM c JOIN t USING (conv_id) WHERE t.p > c.h),
     k AS (SELECT conv_id, p AS depth, md5(CAST(list(x) OVER o AS VARCHAR)) AS k, n_chars FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY p)),
     m AS (SELECT conv_id, depth, k, n_chars, coalesce(lag(k) OVER (PARTITION BY conv_id ORDER BY depth), 'root') AS parent FROM k UNION ALL SELECT conv_id, 0, 'root', 0, NULL FROM s),
     n AS (SELECT k, depth, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(n_chars) AS saved FROM m GROUP BY k, depth),
     v AS (SELECT n.*, (SELECT count(*) FROM n AS y WHERE y.parent = n.k) AS n_children FROM n),
     u AS (SELECT m.k, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved_tokens FROM v JOIN m ON m.conv_id = v.conv_id AND m.depth <= v.depth GROUP BY m.k),
     e AS (SELECT k, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max_by(k, depth) AS k FROM m GROUP BY conv_id) GROUP BY k)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, a.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM v JOIN u USING (k) LEFT JOIN e USING (k) LEFT JOIN n AS a ON a.k = v.parent""",
    "op13_spelling_variants": f"""
WITH RECURSIVE w AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
     d AS (SELECT w, count(*) AS n, {_CRC.format(bytes="flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195, ord(c)::BIGINT - 64] END))")} AS h FROM w GROUP BY doc_id, w),
     t AS (SELECT CASE WHEN h % 97 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, n FROM d),
     v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM t WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
     i AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
     x AS (SELECT DISTINCT i.word, i.n, v.word AS other, v.n AS m FROM i JOIN v ON v.word = i.rest),
     p AS (SELECT * FROM x UNION ALL SELECT other, m, word, n FROM x UNION ALL SELECT a.word, a.n, b.word, b.n FROM i AS a JOIN i AS b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word),
     f AS (SELECT word, n, count(*) AS n_near, first(other ORDER BY m DESC, other COLLATE C) AS form, max(m) AS form_n FROM p GROUP BY word, n),
     l AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * v.n THEN form END AS form, CASE WHEN form_n >= 2 * v.n THEN form_n END AS form_n FROM v LEFT JOIN f USING (word)),
     r AS (SELECT word, word AS root FROM l UNION ALL SELECT r.word, l.form FROM r JOIN l ON l.word = r.root WHERE l.form IS NOT NULL)
SELECT l.word, form, root, n, n_near, form_n FROM l JOIN (SELECT word, arg_min(root, k) AS root FROM (SELECT r.word, root, form IS NOT NULL AS k FROM r JOIN l ON l.word = r.root) GROUP BY word) USING (word)""",
    "op2_licenses": _licenses_sql(),
    "op9_url_filter": _urls_sql(),
    "op10_secrets": _secrets_sql(),
    "op7_chat_snapshots": """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
     c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn) AS l FROM t GROUP BY conv_id),
     p AS (SELECT DISTINCT md5(CAST(l[1:i] AS VARCHAR)) AS h FROM (SELECT l, unnest(range(1, len(l))) AS i FROM c)),
     u AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies, l FROM c GROUP BY l)
SELECT conv_id, CAST(len(l) AS BIGINT) AS n_turns, n_copies, array_to_string(['<|' || coalesce(x.role, 'unknown') || '|>' || chr(10) || coalesce(x.text, '') || chr(10) FOR x IN l], '') AS chat
FROM u WHERE md5(CAST(l AS VARCHAR)) NOT IN (SELECT h FROM p)""",
    "op8_bbit_near_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_NONSPACE} AS ws FROM documents),
     i AS (SELECT doc_id, ws, unnest(CASE WHEN len(ws) >= 3 THEN range(1, len(ws) - 1) WHEN len(ws) > 0 THEN [1] ELSE [] END) AS i FROM d),
     s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM i),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s AS x JOIN s AS y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
     l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
     e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
     r AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.node = d.doc_id GROUP BY doc_id, n""",
    "op5_suffix_decontamination": f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS ws FROM documents),
     b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS ws FROM benchmark),
     bi AS (SELECT item, ws, least(13, len(ws)) AS k, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0),
     bw AS (SELECT item, i, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM bi),
     di AS (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM bw) WHERE len(ws) >= k),
     h AS (SELECT doc_id, item, i, p, bw.k FROM (SELECT doc_id, p, k, array_to_string(ws[p:p + k - 1], ' ') AS g FROM di) AS dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
     n AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS w FROM h) GROUP BY doc_id),
     t AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM h GROUP BY doc_id),
     r AS (SELECT doc_id, item, i - row_number() OVER (PARTITION BY doc_id, item, p - i ORDER BY i) AS run, p - i AS diagonal, i, k FROM (SELECT DISTINCT doc_id, item, i, p, k FROM h)),
     m AS (SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, max(i + k) - min(i) AS n FROM r GROUP BY doc_id, item, diagonal, run) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest_match
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN m USING (doc_id)""",
}
