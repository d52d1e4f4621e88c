"""Near-duplicates by overlap of shingles against brute force."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline as P
from srcloom.llm import overlap, simhash


def brute_shingles(t: str | None) -> set[str]:
    w = (t or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(x: set, y: set) -> bool:
    return 10 * len(x & y) >= 8 * len(x | y)


def edited_texts(seed: int) -> list[str | None]:
    """Texts with copies whose edits leave a similarity below, at and above the bound; one line that most have; chains of copies of copies."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    line = " ".join(r.choice(words) for _ in range(30))
    texts: list[str | None] = [None, "", "  ", "a", "A", "a b c d", "a b c d e", "a b c d e f"]
    for k in range(14):
        base = [r.choice(words) for _ in range(r.choice([12, 40, 100, 400]))] + line.split() * (k % 3 > 0)
        texts.append(" ".join(base))
        for _ in range(8):
            copy = list(base if r.random() < 0.6 else texts[-1].split())
            for _ in range(r.randint(1, max(1, len(copy) // 30))):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(" ".join(copy))
    # 100 words have 96 shingles; 9 of them changed at the end leave 87 of 105, 10 leave 86 of 106, 11 leave 85 of 107 (0.794)
    base = [f"u{k}" for k in range(100)]
    return texts + [" ".join(base[: 100 - k] + [f"v{k}_{j}" for j in range(k)]) for k in (0, 9, 10, 11, 12)]


def brute_kept(texts: list[str | None]) -> tuple[set[int], int]:
    """The least of each component, and how many links only the overlap makes."""
    sets, prints = [brute_shingles(t) for t in texts], [simhash.fingerprint(t) for t in texts]
    root, far = list(range(len(texts))), 0
    for a in range(len(texts)):
        for b in range(a):
            near = (prints[a] ^ prints[b]).bit_count() <= 4
            if near or (sets[a] and sets[b] and similar(sets[a], sets[b])):
                far += not near
                x, y = sorted((root[a], root[b]))
                root = [x if v == y else v for v in root]
    return {i for i, v in enumerate(root) if i == v}, far


@pytest.mark.parametrize(("seed", "hot", "sample"), [(1, 2_000, 20_000), (2, 1, 20_000), (3, 3, 10)])
def test_stage_drops_what_overlaps(spark, monkeypatch, seed, hot, sample):
    for name, v in (("HOT", hot), ("SAMPLE", sample), ("LEAST", 2), ("FEW", hot)):
        monkeypatch.setattr(overlap, name, v)
    texts = edited_texts(seed)
    want, far = brute_kept(texts)
    assert far > 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in P.near_duplicates(spark, docs, "").collect()}
    assert got == want
    assert P.near_duplicates(spark, docs.where("false"), "").count() == 0


def test_prefix_length():
    for n in range(1, 200):
        assert overlap.prefix_length(n) == n - min(k for k in range(n + 1) if 10 * k >= 8 * n) + 1


@pytest.mark.parametrize("similar", [False, True])
def test_rows_of_one_id_are_judged_by_their_texts(spark, similar):
    a, b, c = (" ".join(f"{x}{k}" for k in range(200)) for x in "abc")
    rows = [(1, a), (2, a + " end"), (2, b), (2, c), (3, b), (3, b), (4, "alone here"), (4, "alone here"), (None, a), (None, a), (None, None), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(simhash.one_of_each(docs, similar=similar).collect(), key=str)
    assert kept == sorted(docs.where("doc_id is null").collect() + [r for r in docs.dropDuplicates().collect() if r in {(1, a), (2, b), (2, c), (4, "alone here"), (5, None)}], key=str)


@pytest.mark.parametrize("few", [0, 200_000])
def test_ties_of_id_and_text_do_not_depend_on_order(spark, monkeypatch, few):
    """Of rows equal in id and text the same one stays however they are dealt; nothing is left in the shared folder."""
    monkeypatch.setattr(simhash, "FEW_KEYS", few)
    rows = [(1, "some words of a text", f"s{k}", k) for k in range(6)] + [(2, "some words of a text", None, 0), (3, None, "x", 1)]
    found = set()
    for parts in (1, 2, 5):
        docs = spark.createDataFrame(rows[parts:] + rows[:parts], "doc_id long, text string, source string, first int").repartition(parts)
        found.add(tuple(sorted(map(tuple, simhash.one_of_each(docs, similar=True).collect()))))
    assert len(found) == 1
    assert [r[0] for r in next(iter(found))] == [1, 3]


def test_scratch_tables_and_setting_are_given_back(spark, tmp_path):
    from pathlib import Path

    from srcloom.llm import common

    was = spark.conf.get(common.FREE_SHUFFLES)
    scratch = common.Scratch(spark, "scratch-test")
    assert scratch.stored(spark.range(5), "a").count() == 5
    here = Path(scratch.path.removeprefix("file:"))
    assert here.is_dir()
    scratch.drop("a")
    assert here.is_dir() and not (here / "a").exists()
    scratch.drop()
    assert not here.exists()
    with pytest.raises(ValueError), common.shuffles_freed(spark):
        assert spark.conf.get(common.FREE_SHUFFLES) == "true"
        raise ValueError
    assert spark.conf.get(common.FREE_SHUFFLES) == was


def test_one_shingle_in_five_thousand_texts(spark, monkeypatch):
    """Its hash is so small that it is in the prefix of every text; texts that are alike otherwise too are found, and no task gets all texts."""
    monkeypatch.setattr(overlap, "LEAST", 10**9)
    monkeypatch.setattr(overlap, "HOT", 100)
    r = random.Random(9)
    line = next(x for x in (" ".join(f"s{k}_{j}" for j in range(5)) for k in range(10**6)) if overlap.shingles(x)[0] < 2**64 // 20_000)
    texts = [line + " " + " ".join(f"t{k}_{j}" for j in range(r.choice([8, 20, 60, 150]))) for k in range(5_000)]
    copies = {k: texts[k].rsplit(" ", 1)[0] + " other" for k in range(0, 5_000, 250) if len(texts[k].split()) > 30}
    docs = spark.createDataFrame(list(enumerate(texts)) + [(10_000 + k, t) for k, t in copies.items()], "doc_id long, text string")
    assert {x.doc_id for x in simhash.one_of_each(docs, similar=True).collect()} == set(range(5_000))
