"""Ranked search against brute force, SQL and hand-made cases; the tree against all rows."""

from __future__ import annotations

import heapq
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from srcloom.llm import lexical
from tests.support import same_as_sql

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]


def brute(docs, items, k=10):
    """docs: (id, text); items: (id, text). Rows (item, rank, id, score), all in whole numbers."""
    counted = [(i, Counter(words(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in dict.fromkeys((i, t) for i, t in items if t is not None):
        scored = []
        for i, c in counted:
            m = 100 - 75 + (75 * c.total() * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in words(text))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return out


def rows(df):
    return [(r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()]


def key(r):
    return tuple((x is not None, x or 0) for x in r)


def test_query_equals_brute_force_and_sql(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = lexical.op13_lexical_search(spark, SF)
    assert found.dtypes == [("item_id", dict(spark.read.parquet(f"{SF}/benchmark.parquet").dtypes)["item_id"]), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(rows(found)) == sorted(brute(docs, items))
    same_as_sql(spark, "op13_lexical_search", SF)


@pytest.mark.parametrize("how", [{}, {"block": 8}, {"query_bytes": 30}, {"cells": 16}])
def test_nulls_ties_repeats_long_texts_and_blocks(spark, how):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["Straße", "ÄB", "日本"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 30))) for _ in range(300)]
    texts += [None, "", " .!? ", "W1,w1;w1", "the same"] + ["the same"] * 40 + ["w3 " * 20_000]
    ids = [*range(1000, 1000 + len(texts) - 3), 7, 7, None]
    docs = list(zip(ids, texts, strict=True))
    items = [(1, "w1 w2 W3 w3"), (1, "w1 w2 W3 w3"), (2, None), (3, "?"), (4, "the same"), (5, "nothing here"), (6, "Straße ÄB 日本 äb"), (6, "w5"), (None, "w7 w8")]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, item_id string").repartition(3)
    q = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id int, text string, rank int")
    assert sorted(rows(lexical.search(d, q, **how)), key=key) == sorted(brute(docs, items), key=key)
    assert lexical.search(d.where(F.lit(False)), q, **how).collect() == []
    assert lexical.search(d, q.where(F.lit(False)), **how).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_tree_finds_what_a_scan_finds_and_its_bounds_hold(seed):
    rng = np.random.default_rng(seed)
    n, width = int(rng.integers(1, 900)), 60
    groups = [rng.choice(width, 5, replace=False) for _ in range(12)]
    at, values, starts = [], [], [0]
    for _ in range(n):
        places = np.unique(np.concatenate([groups[rng.integers(12)], rng.choice(width, rng.integers(1, 4))]))
        at += places.tolist()
        values += rng.integers(1, 10**6, len(places)).tolist() if seed % 2 else [1000] * len(places)
        starts.append(len(at))
    tree = lexical.BallTree(np.array(at), np.array(values), np.array(starts), width, leaf=8)
    dense = np.zeros((n, width), np.int64)
    for k in range(n):
        dense[k, at[starts[k] : starts[k + 1]]] = values[starts[k] : starts[k + 1]]
    assert sorted(np.concatenate(tree.rows).tolist()) == list(range(n))
    fewest = n
    for _ in range(20):
        places = rng.choice(width, 4, replace=False)
        weights = rng.integers(1, 20_000, 4)
        scores = dense[:, places] @ weights
        heap: list = []
        fewest = min(fewest, tree.search(places, weights, heap, 5, lambda row: lexical._Last(row)))
        best = heapq.nsmallest(5, [(-int(s), k) for k, s in enumerate(scores) if s > 0])
        assert sorted((-s, i.id) for s, i in heap) == best
        for node, held in enumerate(tree.rows):
            if len(held):
                assert tree.bounds(places, weights, [node])[0] >= scores[held].max()
    assert n < 400 or fewest < n  # some subtree was pruned
