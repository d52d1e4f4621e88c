"""The text operators against brute force, on small tables with every odd case."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from srcloom.llm import decontam, langid, pieces, planes, revisits, sharding, simhash, token_counts, toxicity, winnowing
from srcloom.llm.components import components

WORDS = "the of and house river stone light dark run walk green blue über straße façade 中文 été niño x1 42 don't".split()


def some_texts(n: int = 60, seed: int = 5) -> list[str | None]:
    """Null, empty, blank, signs only, very long, copies and near copies among plain texts."""
    r = random.Random(seed)
    make = lambda k: " ".join(r.choice(WORDS) + r.choice(["", "", ",", ".\n", "  "]) for _ in range(k))
    texts: list[str | None] = [None, "", "   \t\n", "!!! ... ???", "²³", "a", make(20_000), "z" * 50_000, "😀́ 　 <|endoftext|> ▁ <0x0A>"]
    plain = [make(r.randint(1, 80)) for _ in range(n)]
    return texts + plain + plain[:7] + [p + " end" for p in plain[:7]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "junk", 0.5, {"a": 1}) for i, t in enumerate(some_texts())]
    rows += [rows[9], rows[12], (None, "a null id", "junk", 0.5, None)]  # repeated rows, a null id
    # columns that clash with those the operators add or use inside
    return spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, score double, __text map<string,int>").repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def low(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


# --- 1


def lang_rows():
    r = random.Random(1)
    words = {"aa": ["kala", "mako", "lamak"], "bb": ["strin", "brost", "trisk"], "cc": ["ueou", "ioau", "eoui"]}
    return [(i, " ".join(r.choice(words[k]) for _ in range(r.randint(3, 30))), k) for i in range(300) for k in [r.choice(list(words))]]


def test_language_id(spark, docs, nothing):
    table = spark.createDataFrame(lang_rows(), "doc_id long, text string, lang string")
    filters = langid.learn(table)
    found = {r.doc_id: r for r in langid.predict(table.drop("lang"), filters).collect()}
    held = [(found[i], k) for i, _, k in lang_rows() if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(r.lang_pred == k for r, k in held) >= 0.98 * len(held)
    odd = {r.text: r for r in langid.predict(docs, filters).collect()}
    assert [odd[t].lang_pred for t in (None, "", "   \t\n", "!!! ... ???", "²³")] == ["und"] * 5
    assert all(0 <= r.score <= 1 for r in odd.values()) and odd["a"].lang_pred in {"aa", "bb", "cc"}
    assert langid.predict(docs, filters).columns == ["doc_id", "text", "fingerprint", "__text", "lang_pred", "score"]
    assert langid.predict(nothing, filters).count() == 0
    empty = langid.learn(table.where("false"))
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}


def test_filters_have_no_false_negatives():
    word = {"aa": " alpha ", "bb": " beta "}
    rows = [(k, w[i : i + n]) for k, w in word.items() for n in langid.SIZES for i in range(len(w) - n + 1)]
    f = langid.build(rows)
    for k, g in rows:
        mask = f.masks(langid.gram_hashes(langid.codes(g), len(g))[-1])
        assert int(mask[0, 0]) >> f.langs.index(k) & 1


def test_long_words_are_learned_whole(spark):
    """n-grams of words of any length, each as often as it stands there, against plain counting."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdé") for _ in range(n)) for n in (1, 2, 30, 31, 32, 33, 34, 35, 64, 100, 3000)]
    rows = [(k, " ".join(words), "aa") for k in range(10)] + [(k, "xyz", "bb") for k in range(10, 20)]
    f = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), n_grams=10**6)
    for w in words:
        for n in langid.SIZES:
            for i in range(len(w) + 2 - n + 1):
                g = f" {w} "[i : i + n]
                assert int(f.masks(langid.gram_hashes(langid.codes(g), n)[-1])[0, 0]) >> f.langs.index("aa") & 1


def test_predictions_against_exact_sets(spark, docs):
    """Bloom filters against the sets they were made from: corrected counts differ from exact counts by false positives only."""
    table = spark.createDataFrame(lang_rows(), "doc_id long, text string, lang string")
    filters = langid.learn(table)
    learned: dict[str, set[str]] = {}
    for i, t, k in lang_rows():
        if zlib.crc32(str(i).encode()) % 5:
            for w in re.findall(r"[^\W\d_]+", t.lower()):
                learned.setdefault(k, set()).update(f" {w} "[a : a + n] for n in langid.SIZES for a in range(len(w) + 2 - n + 1))
    for text in [t for _, t, _ in lang_rows()[:60]] + ["kala strin", "Mako, ioau!", "q"]:
        grams = [f" {w} "[a : a + n] for w in re.findall(r"[^\W\d_]+", text.lower()) for n in langid.SIZES for a in range(len(w) + 2 - n + 1)]
        total = filters.counts(re.findall(r"[^\W\d_]+", text.lower())).sum(axis=0)
        assert total[0] == len(grams)
        for k, lang in enumerate(filters.langs):
            exact = sum(g in learned[lang] for g in grams)
            assert exact <= total[k + 1] <= exact + 3 + len(grams) * 0.05
        best = max(sorted(learned), key=lambda x: sum(g in learned[x] for g in grams))
        if any(g in learned[best] for g in grams) and len({sum(g in learned[x] for g in grams) for x in learned}) == 3:
            assert filters.predict_all([text])[0][0] == best


def test_learning_ignores_the_test_fold(spark):
    rows = lang_rows()
    changed = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 5 == 0 else k) for i, t, k in rows]
    a, b = (langid.learn(spark.createDataFrame(x, "doc_id long, text string, lang string")) for x in (rows, changed))
    assert a.langs == b.langs and (a.slices == b.slices).all()


# --- 2


def brute_fingerprint(t: str | None) -> int:
    import xxhash

    w = re.findall("[^\x20\x09-\x0d]+", low(t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def brute_components(ids, near):
    root = {i: i for i in ids}
    for a, b in near:
        while root[a] != root[root[a]]:
            root[a] = root[root[a]]
        x, y = root[a], root[b]
        root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    return root


def test_simhash_components(docs, nothing):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    prints = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    ids = [i for i in prints if i is not None]
    root = brute_components(ids, [(a, b) for a in ids for b in ids if a < b and bin(prints[a] ^ prints[b]).count("1") <= 4])
    assert {i: got[i] for i in ids} == {i: (f"{prints[i]:016x}", root[i]) for i in ids}
    assert simhash.near_duplicates(docs).count() == docs.count()
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize(("lead", "block", "hot"), [(3, 4_000_000, 100_000), (6, 2_000, 100_000), (11, 300, 100_000), (6, 4_000_000, 5), (11, 300, 0)])
def test_links_keep_every_component(spark, monkeypatch, lead, block, hot):
    monkeypatch.setattr(simhash, "HOT_KEYS", 10**9)
    r = random.Random(lead)
    base = [r.getrandbits(64) for _ in range(12)]
    prints = {0, 1, (1 << 64) - 1} | set(base)
    for b in base:  # chains of near fingerprints, so groups are larger than a ball
        for _ in range(12):
            b ^= sum(1 << r.randrange(64) for _ in range(r.randint(1, 5)))
            prints.add(b & ((1 << 64) - 1))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), lead=lead, block_variants=block, hot_rows=hot)
    got = {x.node: x.root for x in components(edges).collect()}
    want = brute_components(signed, [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 4])
    assert {p: got.get(p, p) for p in signed} == want


@pytest.mark.parametrize("hot", [0, 3])
def test_hot_keys_meet_by_broadcast(spark, docs, monkeypatch, hot):
    from srcloom.llm import common

    want = rows_of(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id")
    stay = rows_of(simhash.one_of_each(docs, similar=True), "doc_id", "text")
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    assert rows_of(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    assert rows_of(simhash.one_of_each(docs, similar=True), "doc_id", "text") == stay


def test_components_of_a_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(None, 3), (500, 500), (7, 6)], "a long, b long")
    assert {(r.node, r.root) for r in components(edges).collect()} == {(i, 0) for i in range(n + 1)}
    assert components(edges.where("false")).count() == 0


def test_one_of_each(docs):
    kept = simhash.one_of_each(docs)
    ids = [r.doc_id for r in kept.collect()]
    named = [i for i in ids if i is not None]
    assert len(named) == len(set(named)) and [f.dataType for f in kept.schema] == [f.dataType for f in docs.schema] and kept.columns == docs.columns
    assert set(named) == {r.component_id for r in simhash.near_duplicates(docs).collect() if r.doc_id is not None}
    assert ids.count(None) == 1


# --- 3


def test_revisits(spark):
    m = lambda **k: {a.replace("_", "-"): b for a, b in k.items()}
    rows = [
        ("f1", "http://www.A.example:80/p/?b=2&a=1#x", 100, False, m(etag="1", content_length="9", vary="x"), "d1"),
        ("f2", "https://a.example/p?a=1&b=2", 200, False, m(etag="2", last_modified="L"), "d2"),
        ("f2b", "https://a.example/p?a=1&b=2", 200, False, m(last_modified="M"), "d2b"),
        ("r0", "https://a.example/p?a=1&b=2", 100, True, m(etag="1"), None),  # not strictly later
        ("r1", "https://a.example/p?a=1&b=2", 150, True, m(etag="W/1", content_length="0", vary="y"), None),
        ("r2", "https://a.example/p?a=1&b=2", 10_000_000, True, m(last_modified="M"), None),
        ("r3", "https://a.example/p?a=1&b=2", 201, True, m(last_modified="other"), None),
        ("r4", None, 300, True, None, None),
        ("r5", "https://a.example/p?a=1&b=2", None, True, m(etag="1"), None),
        ("r6", "https://a.example/p?a=1&b=2", 250, True, None, None),
        ("r6", "https://a.example/p?a=1&b=2", 250, True, None, None),
    ]
    table = spark.createDataFrame(rows, "record_id string, url string, ts long, is_revisit boolean, headers map<string,string>, digest string")
    for chunk in (50, 1000, 10**9):
        got = [(r.record_id, r.status, r.refers_to, r.digest, r.headers) for r in revisits.resolve(table, chunk).orderBy("record_id").collect()]
        assert got == [
            ("r0", "missing", None, None, None),
            ("r1", "resolved", "f1", "d1", {"etag": "W/1", "content-length": "9", "vary": "y"}),
            ("r2", "resolved", "f2b", "d2b", {"last-modified": "M"}),
            ("r3", "mismatch", None, None, None),
            ("r4", "missing", None, None, None),
            ("r5", "missing", None, None, None),
            ("r6", "unverified", "f2b", "d2b", {"last-modified": "M"}),
            ("r6", "unverified", "f2b", "d2b", {"last-modified": "M"}),
        ]
    assert revisits.resolve(table.where("false")).count() == 0


def test_header_names_in_any_case(spark):
    rows = [("f", "http://a/x", 1, False, {"ETag": "1", "Vary": "a", "Content-Length": "5"}, "d", 1, "m"), ("r1", "http://a/x", 2, True, {"etag": "2"}, None, 1, "m"), ("r2", "http://a/x", 2, True, {"ETAG": "1", "VARY": "b", "vary": "c"}, None, 2, None), ("n", "http://a/x", 5, None, {"ETag": "9"}, "e", 1, "m"), ("r3", "http://a/x", 6, True, {"Etag": "9"}, None, 1, "m")]
    table = spark.createDataFrame(rows, "record_id string, url string, ts long, is_revisit boolean, headers map<string,string>, digest string, canonical int, status string")
    got = {r.record_id: (r.status, r.refers_to, r.headers) for r in revisits.resolve(table).collect()}  # with columns that bear names of the result
    assert got == {"r1": ("mismatch", None, None), "r2": ("resolved", "f", {"etag": "1", "vary": "b", "content-length": "5"}), "r3": ("resolved", "n", {"etag": "9"})}


# --- 4


@pytest.fixture(scope="module")
def sp():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=pieces.model_path())


def test_pieces_equal_the_library(sp):
    p = pieces.loaded(pieces.model_path())
    r = random.Random(3)
    alphabet = list("abcdeéß  ▁▁ \n\t\0ﬁ中文😀�01239'.,-") + ["<0x0A>", "<s>", "</s>", "<unk>", "the", "ing", "er"]
    texts = [t for t in some_texts() if t] + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    for t in texts:
        ids = sp.encode(t)
        assert list(p.encode(t)) == ids
        assert p.decode(ids) == sp.decode(ids)
    for _ in range(2000):
        ids = [r.choice([r.randrange(3, 260), r.randrange(32000), 0, 1, 28705]) for _ in range(r.randint(0, 8))]
        assert p.decode(ids) == sp.decode(ids)


def test_compatible_is_merging_again():
    p = pieces.loaded(pieces.model_path())
    r = random.Random(5)
    ids, blanks = sorted(p.ids.values()), [i for t, i in p.ids.items() if set(t) == {"▁"}]
    repeats = [i for t, i in p.ids.items() if len(set(t)) <= 2 and len(t) <= 4]
    for _ in range(20_000):
        a, b = (r.choice(r.choice([ids, blanks, repeats])) for _ in range(2))
        x, y = p.text[a], p.text[b]
        alone = len(p.merged(x)) == 1 and len(p.merged(y)) == 1
        assert p.compatible(a, b) == (alone and p.merged(x + y) == [x, y])


def test_words_together_equal_words_alone(sp):
    """All words of a slice at once, and one by one: short and long ones, with and without characters that have a piece."""
    p = pieces.Pieces(pieces.model_path())
    r = random.Random(6)
    words = ["▁" * r.randint(0, 20) + "".join(r.choice("abcdeingthéß中,.1😀") for _ in range(r.choice([0, 1, 5, 12, 30, 62, 63, 64, 65, 200]))) for _ in range(2000)]
    words = sorted(set(words) - {""})
    found = p._words(words)
    assert all(list(np.frombuffer(found[w], "<i4")) == list(p._stretch_ids(w)) for w in words)
    assert list(found) and pieces.decimal_lists([p.encode("a b"), p.encode("")]) == [",".join(map(str, sp.encode("a b"))).encode(), b""]


def test_pieces_on_tables(docs, nothing, sp):
    found = pieces.digests(docs).collect()
    assert len(found) == docs.count()
    for r in found:
        ids = sp.encode(r.text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert pieces.digests(nothing).count() == 0
    both = pieces.decode(pieces.encode(docs.where("text is not null"))).collect()
    assert all(r.decoded == sp.decode(sp.encode(r.text)) for r in both)


# --- 5


def test_planes_round_trip():
    r = np.random.default_rng(1)
    for by in ("byte", "bit"):
        for n in (0, 1, 7, 1000, 1001, 5000):
            for top in (1, 2, 256, 50_257, 1 << 32):
                ids = r.integers(0, top, n, dtype=np.uint64).astype("<u4")
                raw = planes.write_file(ids, [n], by, 1000)
                assert (planes.read_ids(raw) == ids).all()
                assert all((planes.read_ids(raw, [k]) == ids[1000 * k : 1000 * k + 1000]).all() for k in range(-(-n // 1000)))


def test_token_files(docs, nothing):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(planes.tokenizer_path())
    plain = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in planes.write_and_read(plain, file_ids=500, block=128).collect()}
    at = 0
    for r in plain.orderBy("doc_id").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [2]
        assert got[r.doc_id] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    every = planes.write_and_read(docs).collect()  # repeated and null ids keep their rows
    assert len(every) == docs.count() and sum(r.n_tokens for r in every) == max(r.start + r.n_tokens for r in every)
    assert planes.write_and_read(nothing).count() == 0


def test_encoder_equals_the_library():
    e = planes.loaded(planes.tokenizer_path())
    r = random.Random(2)
    wide = list("abcdeéß   \n\t\0\x1c\x1d\x85\xa0 　ﬁ中文😀01239'.,-'s'll") + ["<|endoftext|>"]
    latin = list("abcdeéßªµº²½×÷  \n\t\x85\xa001239'.,-'s'll't'reS")
    texts = ["".join(r.choice(wide if k % 2 else latin) for _ in range(r.randint(0, 30))) for k in range(4000)]
    for raw, t in zip(e.encode_all(texts), texts, strict=True):
        assert list(np.frombuffer(raw, "<u4")) == e.library.encode(t, add_special_tokens=False).ids


# --- 6


@pytest.mark.parametrize("limit", [1, 200, 3000, 10**9])
def test_shards_fit(docs, limit):
    found = sharding.assign(docs, limit=limit)
    rows = found.collect()
    assert len(rows) == docs.count()
    size = {r.doc_id: len((r.text or "").encode()) for r in docs.collect()}
    shards: dict = {}
    for r in rows:
        shards.setdefault((r.shard, r.page), []).append(r)
    for members in shards.values():
        total = sum(size[r.doc_id] for r in members)
        assert (total <= limit or len(members) == 1) and {(r.shard_bytes, r.shard_rows) for r in members} == {(total, len(members))}
    names = sorted({s for s, p in shards if p is None})
    assert all(not b.startswith(a) for a, b in zip(names, names[1:], strict=False))  # no shard is a prefix of another
    # a bucket was split only because it was too large
    for (s, p) in shards:
        if s and p is None:
            above = [r for r in rows if r.shard.startswith(s[:-1])]
            assert sum(size[r.doc_id] for r in above) > limit


def test_equal_rows_overflow(spark):
    same = spark.range(500).select(F.lit(7).alias("doc_id"), F.lit("x" * 10).alias("text"))
    rows = sharding.assign(same, limit=95).collect()
    assert len(rows) == 500 and max(r.shard_bytes for r in rows) <= 95 and len({r.page for r in rows}) == -(-500 // 9)
    assert sharding.assign(same.where("false")).count() == 0


@pytest.mark.parametrize("limit", [300, 10**9])
def test_shards_are_written(docs, tmp_path, limit):
    """The written folders hold every row with its columns, and each fits."""
    many = docs.drop("__text").unionByName(docs.drop("__text").where("doc_id = 10")).withColumn("page", F.lit("clash"))
    sharding.write_shards(many, str(tmp_path / "shards"), limit=limit)
    back = docs.sparkSession.read.parquet(str(tmp_path / "shards"))
    cols = ["doc_id", "text", "fingerprint", "score"]
    assert rows_of(back, *cols) == rows_of(many, *cols) and set(back.columns) == {*cols, "shard", "page"}
    sizes = back.groupBy("shard", "page").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("b"), F.count("*").alias("n")).collect()
    assert all(r.b <= limit or r.n == 1 for r in sizes) and (len(sizes) > 5 or limit > 300)


# --- 7


def brute_unigram(trie: token_counts.Trie, word: str) -> tuple[int, float]:
    best = [(0.0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - trie.longest), end):
            s, n = trie.scores.get(word[start:end]), 1
            if s is None and end - start == 1:
                n = len(word[start:end].encode())
                s = trie.worst * n
            if s is not None:
                c = (best[start][0] + s, best[start][1] - n)
                best[end] = c if best[end] is None or c > best[end] else best[end]
    return -best[-1][1], best[-1][0]


@pytest.mark.parametrize("letters", ["abcdeéthingß中😀", "ab", "▁x"])
def test_trie_equals_plain_scores(letters):
    """Pre-tokens that share prefixes, of every length around the bound of the trie, and very long ones."""
    trie = token_counts.loaded(token_counts.model_path())
    r = random.Random(7)
    words = ["▁" + "".join(r.choice(letters) for _ in range(r.choice([0, 1, 3, 9, 20, 62, 63, 64, 65, 66, 150]))) for _ in range(400)] + ["".join(r.choice(letters) for _ in range(3000))]
    words += [w[:k] for w in words for k in (2, 5, 64) if w[:k]]
    for w, got in zip(words, trie.counts_of([words])[0], strict=True):
        assert got == brute_unigram(trie, w)


def test_recent_values_are_bounded():
    from srcloom.llm.common import Recent

    made = []
    kept = Recent(lambda keys: made.extend(keys) or {k: k.upper() for k in keys}, 10, longest=5)
    for k in range(200):
        keys = [f"k{j}" for j in range(k % 60, k % 60 + 4)] + ["toolong", "k0"]
        assert kept.of([keys, [], ["k0"]]) == [[x.upper() for x in keys], [], ["K0"]]
        assert len(kept.now) <= 10 and len(kept.older) <= 10 and "toolong" not in kept.now
    assert made == [x for x in made if x] and len(made) > 60


def test_token_counts(docs, nothing):
    trie = token_counts.loaded(token_counts.model_path())
    r = random.Random(4)
    for _ in range(300):
        w = "▁" + "".join(r.choice("abcdeéthingß中😀") for _ in range(r.randint(0, 14)))
        assert trie.counts(w) == brute_unigram(trie, w)
    found = {x.doc_id: x for x in token_counts.token_counts(docs).collect()}
    assert (found[0].n_pretokens, found[0].n_tokens, found[1].n_tokens) == (0, 0, 0)
    for x in list(found.values()):
        words = re.findall("▁*[^▁]+|▁+", "▁" + x.text.replace(" ", "▁")) if x.text else []
        assert (x.n_pretokens, x.n_tokens) == (len(words), sum(brute_unigram(trie, w)[0] for w in words))
    assert token_counts.token_counts(nothing).count() == 0


# --- 8


def toxic_rows():
    r = random.Random(8)
    clean = ["river", "stone", "light", "green", "walk", "house", "paper", "garden"]
    out = []
    for i in range(900):
        grade = r.choice([0, 0, 1, 2])
        words = [r.choice(clean) for _ in range(r.randint(5, 40))] + (["vilesome"] if grade == 1 else ["monstrouz" + r.choice("abc"), "vilesome"] if grade == 2 else [])
        r.shuffle(words)
        out.append((i, " ".join(words), grade))
    return out


def test_ordinal_regression(spark, docs, nothing):
    rows = toxic_rows()
    table = spark.createDataFrame(rows, "doc_id long, text string, g int")
    model = toxicity.learn(table.where("doc_id < 600"), table, "g")
    assert model.grades == [0, 1, 2] and model.thresholds[0] < model.thresholds[1]
    got = {r.doc_id: r for r in toxicity.grade(table.where("doc_id >= 600"), model).collect()}
    truth = {i: g for i, _, g in rows if i >= 600}
    assert sum(got[i].toxic == (g > 0) for i, g in truth.items()) >= 0.97 * len(truth)
    assert sum(got[i].grade == g for i, g in truth.items()) >= 0.9 * len(truth)
    mean = [np.mean([got[i].severity for i, g in truth.items() if g == k]) for k in range(3)]
    assert mean[0] < mean[1] < mean[2]
    assert toxicity.grade(docs, model).count() == docs.count() and toxicity.grade(nothing, model).count() == 0
    none = toxicity.learn(table.where("false"), table, "g")
    assert {(r.grade, r.toxic) for r in toxicity.grade(docs, none).collect()} == {(0, False)}
    assert toxicity.learn(table, table.where("g = 1"), "g").grades == [1]


def test_scores_are_those_of_the_formula(spark):
    """Every output from the weights and thresholds by the definition, feature by feature."""
    rows = toxic_rows()
    table = spark.createDataFrame(rows, "doc_id long, text string, g int")
    model = toxicity.learn(table.where("doc_id < 600"), table, "g")
    for r in toxicity.grade(table.where("doc_id >= 600"), model).collect():
        seen = [f for w in re.findall(r"[^\W_]+", r.text.lower()) for f in toxicity.features_of(w)]
        link = sum(model.weights.get(f + k * toxicity.DIMENSIONS, 0.0) for f in set(seen) for k, least in enumerate(toxicity.LEVELS) if seen.count(f) >= least)
        above = [1 / (1 + np.exp(t - link)) for t in model.thresholds]
        assert r.severity == pytest.approx(sum(above)) and r.toxic == (above[0] >= 0.5) and r.grade == sum(a >= 0.5 for a in above)


def test_fit_lowers_the_ordinal_loss():
    """The fit against a plain ordinal likelihood: near its least value, which small moves of any parameter do not lower by much."""
    r = np.random.default_rng(8)
    x = r.random((400, 6)) < 0.4
    grade = np.digitize(x @ np.array([2.0, -1.5, 1.0, 0, 0, 0.5]) + r.logistic(size=400), [0.5, 2.0])
    row, column = np.nonzero(x)
    model = toxicity.fit(grade, np.bincount(row, minlength=400), column, min_rows=1, penalty=0.0, rounds=800)

    def loss(thresholds, weights):
        below = 1 / (1 + np.exp(-(np.r_[-np.inf, thresholds, np.inf][None, :] - (x @ weights)[:, None])))
        return -np.log(below[np.arange(400), grade + 1] - below[np.arange(400), grade]).mean()

    weights = np.array([model.weights.get(k, 0.0) for k in range(6)])
    least = loss(model.thresholds, weights)
    assert least < loss(np.array([0.5, 2.0]), np.array([2.0, -1.5, 1.0, 0, 0, 0.5])) and list(model.thresholds) == sorted(model.thresholds)
    for k in range(8):
        for step in (-0.05, 0.05):
            t, w = model.thresholds.copy(), weights.copy()
            (t if k < 2 else w)[k if k < 2 else k - 2] += step
            assert loss(t, w) > least - 1e-4


def test_toxicity_of_repeated_labels_and_texts(spark):
    rows = toxic_rows()
    table = spark.createDataFrame(rows, "doc_id long, text string, g int").where("doc_id < 600")
    model = toxicity.learn(table, table, "g")
    again = table.unionByName(table.where("doc_id = 5").crossJoin(spark.range(10_000)).drop("id"))
    for labels, docs in ((again, table), (table, again), (again, again)):  # counted once, so the same model
        other = toxicity.learn(docs, labels, "g")
        assert other.grades == model.grades and other.weights.keys() == model.weights.keys()
        assert all(other.weights[k] == pytest.approx(v) for k, v in model.weights.items())
    # ten thousand texts of one id: about TEXTS_EACH are learned from
    many = table.unionByName(spark.range(10_000).selectExpr("5L as doc_id", "concat('other words ', id) as text", "0 as g"))
    assert toxicity.learn(many, table, "g").grades == model.grades


def test_toxicity_on_rows_not_learned_from(spark):
    """Held-out rows of the tables given: a model of four fifths of the labels, judged on the last fifth."""
    from pathlib import Path

    sf = "/root/testdata/sf0.1"
    if not Path(sf).exists():
        pytest.skip("no tables here")
    d, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.learn(d, labels.where(~held), toxicity.GRADE)
    named = toxicity.grade(d.where(held), model).withColumnRenamed("toxic", "flag").join(labels, "doc_id").collect()
    toxic, clean = [r.flag for r in named if r.toxic == 1], [r.flag for r in named if r.toxic == 0]
    print("held out:", len(toxic), "toxic rows, found", sum(toxic), "of them;", len(clean), "others, wrongly found", sum(clean))
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.01 * len(clean)


# --- 9


def brute_choices(text: str, k: int = 5, w: int = 8) -> list[tuple[int, int]]:
    from xxhash import xxh64_intdigest

    words = [x for x in re.split("[ \t\n\x0b\x0c\r]+", text.lower()) if x]
    grams = []
    for i in range(max(min(1, len(words)), len(words) - k + 1)):
        h = 42
        for x in words[i : i + k]:
            h = xxh64_intdigest(x.encode(), h)
        grams.append(h >> 27)
    out = []
    for i in range(max(min(1, len(grams)), len(grams) - w + 1)):
        part = grams[i : i + w]
        at = max(j for j, h in enumerate(part) if h == min(part)) + i
        if (grams[at], at) not in out:
            out.append((grams[at], at))
    return out


def test_winnowing(docs, nothing):
    plain = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text or "" for r in plain.collect()}
    ids = sorted(texts, reverse=True)
    for bucket in (4, 1000):
        got = {r.doc_id: r for r in winnowing.edited_likeness(plain, bucket_rows=bucket).collect()}
        assert len(got) == len(ids)
        for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
            t, n, half = texts[i], texts[j], len(texts[i]) // 2
            edited = t[: len(t) - half] + n[:half]
            r = got[i]
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            if len(t) < 200_000:
                a, b = brute_choices(t), brute_choices(edited)
                assert r.fingerprint == " ".join(f"{h:x}@{p}" for h, p in a)
                x, y = {h for h, _ in a}, {h for h, _ in b}
                assert r.near_edited == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0)
                z = {h for h, _ in brute_choices(n)}
                assert r.near_next == pytest.approx(len(x & z) / len(x | z) if x | z else 1.0)
    assert winnowing.edited_likeness(nothing).count() == 0
    assert winnowing.edited_likeness(docs).count() == docs.count()
    one = winnowing.edited_likeness(plain.where("doc_id = 9")).first()
    assert one.near_next == 1.0


@pytest.mark.parametrize("bits", [4, 5, 8])
def test_positions_beyond_their_bits(spark, bits):
    """With few bits for a position, long texts cross their border often: choices are those of plain comparison, ties to the right."""
    r = random.Random(bits)
    texts = [" ".join(r.choice("abcd" if k % 2 else "a") + ("" if k % 3 else str(r.randrange(4))) for _ in range(r.choice([3, 17, 40, 100, 400]))) for k in range(40)]
    t = spark.createDataFrame([(x,) for x in texts], "t string").withColumn("e", winnowing.choices(F.col("t"), position_bits=bits))
    for row in t.collect():
        assert [(c["hash"], c["position"]) for c in row.e] == brute_choices(row.t)


@pytest.mark.parametrize("bucket", [2, 5, 50])
def test_neighbours_of_hot_ids(spark, bucket):
    """Ids that very many rows have, null ids and equal rows: the rows in their order, each with the next one."""
    from xxhash import xxh64_intdigest

    r = random.Random(bucket)
    rows = [(r.choice([3, 3, 3, 7, None, None, *range(12)]), f"t{r.randrange(25)} " * 3) for _ in range(150)]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    ordered = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, signed(xxh64_intdigest(x[1].encode(), 42)), x[1]), reverse=True)
    want = sorted(((i, hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()) for (i, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1], strict=True)), key=str)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = winnowing.edited_likeness(docs, bucket_rows=bucket)
    assert rows_of(got, "doc_id", "edited_sha256") == want


def test_winnowing_guarantee(spark):
    r = random.Random(9)
    for _ in range(20):
        shared = [f"s{r.randrange(10**6)}" for _ in range(winnowing.GRAM + winnowing.WINDOW - 1)]
        side = lambda: " ".join([f"w{r.randrange(10**6)}" for _ in range(r.randrange(30))] + shared + [f"w{r.randrange(10**6)}" for _ in range(r.randrange(30))])  # noqa: B023, E731
        a, b = ({h for h, _ in brute_choices(side())} for _ in range(2))
        assert a & b


# --- 10


def test_decontamination(spark, docs, nothing):
    r = random.Random(10)
    pool = [f"b{k}" for k in range(40)]
    items = [(k, " ".join(r.choice(pool) for _ in range(r.choice([3, 9, 10, 25])))) for k in range(30)] + [(30, None), (None, "b1 b2 b3"), (31, ""), (31, "..."), (5, "B1, b2; b3")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [(1000 + k, " ".join(r.choice(pool) for _ in range(50)) + ". " + items[r.randrange(30)][1].upper() + "! é") for k in range(40)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(texts, "doc_id long, text string")).withColumn("n_hit", F.lit("clash"))
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows: dict = {}
    for i, t in items:
        if i is not None and t and (w := word.findall(low(t))):
            for k in range(max(1, len(w) - 9)):
                windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    for how in ({}, {"block_bytes": 300}, {"block_bytes": 300, "buffer_bytes": 2_000}):  # one automaton, and several
        found = decontam.contamination(table, bench, **how)
        assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        got = found.collect()
        assert len(got) == table.count()
        for x in got:
            w, hit, ids = word.findall(low(x.text or "")), set(), set()
            for n in {len(k) for k in windows}:
                for k in range(len(w) - n + 1):
                    if owners := windows.get(tuple(w[k : k + n])):
                        ids |= owners
                        hit |= set(range(k, k + n))
            assert (x.n_words, x.n_hit, x.n_items, x.contaminated) == (len(w), len(hit), len(ids), bool(hit))
            assert x.items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
            covered = [v for a, b in x.hit_spans for v in word.findall(low(x.text[a:b]))]
            assert covered == [w[k] for k in sorted(hit)]
    assert decontam.original_spans("é a, ü b 中 c", [(0, 1), (1, 3), (4, 6)]) == [(0, 1), (2, 6), (9, 12)]
    assert decontam.contamination(nothing.select("doc_id", "text"), bench).count() == 0
    assert not any(x.contaminated for x in decontam.contamination(table, bench.where("false")).collect())
