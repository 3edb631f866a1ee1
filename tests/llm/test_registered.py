"""The registered queries over given tables: against their SQL, and against plain Python where SQL can't express them."""

import hashlib
import os
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
import tiktoken
from kpi_spark.llm import bpe, fingerprints, pii
from kpi_spark.llm import queries as Q
from kpi_spark.llm.queries import rank_lines

sys.path[:0] = [os.path.dirname(__file__), os.path.dirname(os.path.dirname(__file__))]
from test_queries import duck, values  # noqa: E402, F401
from test_text_operators import brute_pii  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_sql(spark, duck, name):  # noqa: F811
    assert values(Q.QUERIES[name](spark, SF).toPandas()) == values(duck.execute(Q.ORACLE[name]).df())


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard(x, y):
    x, y = shingles(x), shingles(y)
    return len(x & y) / len(x | y) if x or y else 1.0


def test_fingerprints_estimate_jaccard(spark, texts):
    out = Q.op1_fingerprints(spark, SF).orderBy("doc_id").collect()
    ids = sorted(texts)
    assert [r["doc_id"] for r in out] == ids
    errors = []
    for k, r in enumerate(out):
        t, after = texts[ids[k]], texts[ids[(k + 1) % len(ids)]]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors += [r["near_edited"] - jaccard(t, edited), r["near_next"] - jaccard(t, after)]
    # a share of 128 slots has a standard deviation of 0.045 at most
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.045 and np.abs(errors).max() < 5 * 0.045


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    out = Q.op3_subword_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == h for i, h in zip(out["doc_id"], out["held_out"], strict=True))
    assert ((out["score"] >= 0.7) == (out["predicted"] == 1)).all() and out["score"].between(0, 1).all()
    held = out[out["held_out"]]
    good, bad = held.loc[held["quality"] == 1, "score"].to_numpy(), held.loc[held["quality"] == 0, "score"].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.98 and (held["predicted"] == held["quality"]).mean() > 0.95


def test_personal_data(spark, texts):
    out = {r["doc_id"]: r for r in Q.op4_pii(spark, SF).collect()}
    assert set(out) == set(texts) and any(r["n_email"] for r in out.values())
    for i, t in texts.items():
        base = sorted(brute_pii(t), key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        told = [":".join(map(str, s)) for s in base]
        assert [out[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert out[i]["base_sha256"] == hashlib.sha256(",".join(told).encode()).hexdigest() and set(told) <= set(out[i]["spans"].split(","))


def test_tokens(spark, texts):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(rank_lines()), special_tokens={})
    for r in Q.op6_byte_bpe(spark, SF).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_similar_groups_by_fingerprints(spark):
    """Recall and precision of one: the groups are those of all pairs compared."""
    from kpi_spark.llm.store import Tables
    from test_joining_operators import brute_groups, near_copies

    docs = list(enumerate(near_copies(7, groups=4)))
    df = spark.createDataFrame([(i, t) for i, t in docs], "doc_id long, text string")
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in fingerprints.similar_groups(df, Tables(spark, "t")).collect()}
    assert out == brute_groups(docs, 5, 80)
    keys = fingerprints.fingerprints(df).where(F.length("text") > 100).select("doc_id", F.explode(F.array(*(F.concat_ws("-", F.lit(b), F.substring("fingerprint", 16 * b + 1, 16)) for b in range(27)))).alias("band"))
    met = {(r[0], r[1]) for r in keys.alias("x").join(keys.alias("y"), "band").where("x.doc_id < y.doc_id").select("x.doc_id", "y.doc_id").distinct().collect()}
    near = {(a, b) for a, x in docs for b, y in docs if a < b and len(x or "") > 100 and len(y or "") > 100 and jaccard(x, y) >= 0.8}
    assert near and near <= met
