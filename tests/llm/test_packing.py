"""Packing: the counted form against one piece after the other, and the operator on small tables."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from srcloom.llm import packing

SF = "/root/testdata/sf0.001"


def one_by_one(lengths, capacities, weights, by):
    """Each piece to the best open sequence, as the module says it."""
    opened = []
    scale, weights = np.array(capacities, float), np.array(weights, float)
    for n in sorted(lengths, reverse=True):
        item, best = np.array([n, 1, n * n]), None
        for k, (rooms, _) in enumerate(opened):
            if (rooms >= item).all():
                score = (weights * ((rooms - item) / scale) ** 2).sum() if by == "norm" else -(weights * (rooms / scale) * (item / scale)).sum()
                found = (score, tuple(rooms), k)
                best = found if best is None or found < best else best
        if best is None:
            opened.append([np.array(capacities), []])
            best = (0, (), len(opened) - 1)
        opened[best[2]][0] = opened[best[2]][0] - item
        opened[best[2]][1].append(n)
    return Counter(tuple(x) for _, x in opened)


def unrolled(runs):
    held = defaultdict(list)
    for length, lo, hi, first, offset in runs:
        for r in range(lo, hi):
            held[first + r - lo].append((offset, length, r))
    return held


@pytest.mark.parametrize("by", ["norm", "dot"])
@pytest.mark.parametrize("seed", range(12))
def test_counted_form_places_like_one_by_one(by, seed):
    rng = random.Random(seed)
    cap = rng.choice([16, 40, 100])
    capacities = (cap, rng.choice([3, 5, cap]), rng.choice([cap * cap, cap * cap // 2 + 1]))
    most = int(min(cap, capacities[2] ** 0.5))
    lengths = [min(most, rng.choice([rng.randint(1, cap), rng.randint(1, 6), cap // 3 + 1])) for _ in range(rng.randint(1, 250))]
    weights = rng.choice([(1.0, 0.001, 0.001), (1.0, 1.0, 1.0), (0.2, 1.0, 0.5)])
    held = unrolled(packing.best_fit(Counter(lengths), capacities, weights, by))
    for of in held.values():
        of.sort()
        assert [o for o, _, _ in of] == list(np.cumsum([0] + [n for _, n, _ in of])[:-1])
        assert sum(n for _, n, _ in of) <= capacities[0] and len(of) <= capacities[1] and sum(n * n for _, n, _ in of) <= capacities[2]
    assert sorted((n, r) for of in held.values() for _, n, r in of) == sorted((n, r) for n, c in Counter(lengths).items() for r in range(c))
    assert Counter(tuple(n for _, n, _ in of) for of in held.values()) == one_by_one(lengths, capacities, weights, by)


def test_large_counts_take_few_runs():
    rng = random.Random(5)
    counts = {n: rng.randint(0, 10**9) for n in range(1, 1025)}
    runs = packing.best_fit(counts, (1024, 1024, 1 << 20))
    tokens, used = sum(n * c for n, c in counts.items()), max(s + hi - lo for _, lo, hi, s, _ in runs)
    assert len(runs) < 100_000 and used <= 1.02 * tokens / 1024


def test_too_large_a_piece_is_an_error():
    with pytest.raises(ValueError, match="exceeds"):
        packing.best_fit({10: 1}, (16, 16, 50))
    with pytest.raises(ValueError, match="score by"):
        packing.best_fit({1: 1}, (16, 16, 50), by="x")


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


def checked(rows, ids_of, capacity=1024):
    """What the contract says of the rows of documents with distinct ids."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(ids_of)
    for doc, of in by_doc.items():
        of.sort(key=lambda r: r.piece)
        ids, at = ids_of[doc], 0
        assert [r.piece for r in of] == list(range(len(of)))
        assert all(r.length == capacity for r in of[1:]) and of[0].length <= capacity
        for r in of:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for of in by_seq.values():
        of.sort(key=lambda r: r.offset)
        assert [r.offset for r in of] == list(np.cumsum([0] + [r.length for r in of])[:-1])
        assert sum(r.length for r in of) <= capacity
    return len(by_seq)


def test_query_holds_its_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    ids_of = dict(zip([d.doc_id for d in docs], reference_ids([d.text for d in docs]), strict=True))
    used = checked(packing.op11_best_fit(spark, SF).collect(), ids_of)
    assert used <= 1.02 * sum(map(len, ids_of.values())) / 1024 + 1


def test_nulls_repeats_clashing_columns_and_limits(spark):
    texts = [None, "", "a", "a", "word " * 3000, "<|endoftext|> x", "café　 1"]
    rows = [(i, t, 7, 8, 9) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int, length int, `a.b` int")
    found = packing.pack(docs, capacity=64, max_documents=2, keep_ids=True)
    ids_of = dict(enumerate(reference_ids(texts)))
    checked(found.collect(), ids_of, 64)
    assert all(r["count"] <= 2 for r in found.groupBy("sequence_id").count().collect())
    made = packing.sequences(found).collect()
    assert sum(r.n_tokens for r in made) == sum(map(len, ids_of.values())) and all(len(r.ids) == 4 * r.n_tokens for r in made)
    joined = sorted(np.concatenate([np.frombuffer(r.ids, "<u4") for r in made]).tolist())
    assert joined == sorted(x for ids in ids_of.values() for x in ids)
    far = packing.pack(docs, capacity=64, max_documents=2, broadcast=0)
    assert sorted(far.collect()) == sorted(found.drop("ids").collect())


def test_repeated_and_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "x"), (1, None)], "doc_id long, text string")
    found = packing.pack(docs).collect()
    assert len(found) == 4 and len({r.sequence_id for r in found}) == 1
    assert [r.offset for r in sorted(found, key=lambda r: r.offset)][0] == 0
    assert packing.pack(docs.where(F.lit(False))).collect() == []
    assert sorted(r.length for r in packing.pack(docs, end_id=None).collect()) == [1, 3, 3]
