import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from foliograph.llm import exact, simhash
from foliograph.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, component_id int, keep_id int, recipe string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, 2, "r") for i, t in rows], SCHEMA)


def plain_fingerprint(text, width=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, distance=3):
    root = {i: i for i, _ in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in combinations(items, 2):
        if (x ^ y).bit_count() <= distance:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return {i: find(i) for i in root}


def test_fingerprint_matches_the_definition():
    rng = random.Random(1)
    texts = ["", "  \t ", "A", "one Two", "É a\x0bB  c", "x " * 70_000]
    texts += [" ".join(rng.choice("ab cd ef gh Ij".split()) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    for text in texts[:5] + texts[6:]:
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)
    assert simhash.fingerprint(texts[5].encode()) == xxhash.xxh64_intdigest(b"x x x", 42)


def test_components_on_small_tables_match_brute_force(spark, sf_dir):
    rows = simhash.op3_simhash(spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {i: plain_fingerprint(t) for i, t in docs.items()}
    expected = brute_components(list(prints.items()))
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in rows} == {i: (prints[i], expected[i]) for i in docs}


def brute_like(entries, pairs):
    """The least entry that links reach, for each; links are real."""
    root = {int(x): int(x) for x in entries}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        assert (int(a) ^ int(b)).bit_count() <= 3
        lo, hi = sorted((find(int(a)), find(int(b))))
        root[hi] = lo
    return {x: find(x) for x in root}


def test_links_of_random_fingerprints_match_brute_force(spark):
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(40)]
    for v in list(values):
        for _ in range(3):
            flips = rng.sample(range(64), rng.randint(1, 4))
            values.append(v ^ sum(1 << b for b in flips))
    values = sorted(set(values))
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    expected = brute_components(list(zip(signed, values, strict=True)))
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    found = {r.node: r.root for r in components(links, "a", "b").collect()}
    assert {x: found.get(x, x) for x in signed} == {x: min(y for y in signed if expected[y] == expected[x]) for x in signed}
    y2 = dict(zip(values, signed, strict=True)).__getitem__
    for longest in (2, 3, simhash.LIST):  # with lists of any length keyed further
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(simhash, "LIST", longest)
            own = [p for m in simhash.byte_masks(3) for p in np.concatenate(list(simhash._forest(np.array(values, np.uint64), m, 3)))]
        assert brute_like(np.array(values, np.uint64), own) == {x: min(y for y in values if expected[y2(y)] == expected[y2(x)]) for x in values}


def test_a_long_list_is_keyed_further(spark):
    """6,000 fingerprints that share five bytes: far more than LIST, in groups and alone."""
    rng = np.random.default_rng(6)
    free = rng.choice(1 << 24, 3000, replace=False).astype(np.uint64)
    free = np.unique(np.concatenate([free, free ^ np.uint64(1 << 3) ^ np.uint64(1 << 12)]))
    values = free | np.uint64(0xABCDEF0123 << 24)
    distinct = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    found = {r.node: r.root for r in components(simhash.links(distinct), "a", "b").collect()}
    near = np.bitwise_count(free[:, None] ^ free[None, :]) <= 3
    root = np.arange(len(free))
    while True:  # the least index that each reaches
        new = np.where(near, root[None, :], len(free)).min(axis=1)
        if (new == root).all():
            break
        root = new
    signed = values.view(np.int64)
    for i in range(len(free)):
        assert found.get(int(signed[i]), int(signed[i])) == int(signed[root[i]])


def test_components_walk_long_chains_and_empty_input(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (7, 7)], "a long, b long")
    found = {r.node: r.root for r in components(chain, "a", "b").collect()}
    assert found == dict.fromkeys(range(201), 0)
    assert components(chain.filter("a < 0"), "a", "b").count() == 0


def test_near_duplicates_with_nulls_ties_and_empty_tables(spark):
    rows = [(1, None), (2, ""), (3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "alone here now")]
    found = simhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in found if r.component_id is not None) == [(-1, 3), (1, 1), (2, 1), (3, 3), (3, 3)]
    assert [r.component_id for r in found].count(None) == 1
    assert simhash.near_duplicates(frame(spark, rows).filter("doc_id < 0")).count() == 0
    kept = simhash.keep_one(frame(spark, rows))
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 1, 3]
    assert kept.columns == frame(spark, rows).columns
    assert simhash.keep_one(frame(spark, rows).filter("doc_id < 0")).count() == 0


def test_rows_that_repeat_an_id_are_judged_by_their_texts(spark):
    other = " ".join(f"v{i}" for i in range(40))
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (5, other), (6, text + " more"), (7, "third text of its own kind"), (5, text), (8, other), (5, text.upper()), (9, None), (9, "")]
    kept = sorted(((r.doc_id, (r.text or "").lower()) for r in simhash.keep_one(frame(spark, rows)).collect()))
    assert kept == sorted([(5, text), (5, other), (7, "third text of its own kind"), (9, "")])


def test_cut_points_follow_the_content():
    rng = random.Random(3)
    body = bytes(rng.getrandbits(8) for _ in range(60_000))
    for data in (b"", b"x", body[:512], body, b"a" * 70_000):
        parts = exact.chunks(data)
        assert b"".join(parts) == data
        assert all(len(p) <= exact.MOST for p in parts)
    shifted = set(exact.chunks(b"some words before" + body))
    assert len(shifted & set(exact.chunks(body))) > 0.8 * len(exact.chunks(body))


def test_exact_duplicates_match_sql(spark, sf_dir):
    import duckdb

    from foliograph.llm.queries import ORACLE

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    expected = sorted(con.execute(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({ORACLE['op8_exact_dedup']})").fetchall())
    found = exact.op8_exact_dedup(spark, sf_dir).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, found)) == expected


def test_exact_duplicates_with_nulls_ties_and_long_texts(spark):
    long = "word " * 50_000
    rows = [(1, None), (2, ""), (3, long), (4, long), (5, long + "."), (6, "a"), (6, "a"), (None, "a"), (None, "b")]
    found = {}
    for r in exact.exact_duplicates(frame(spark, rows)).collect():
        found.setdefault(r.doc_id, []).append((r.keep_id, r.group_size, r.kept))
    assert found[1] == [(2, 2, False)] and found[2] == [(2, 2, True)]
    assert found[3] == [(4, 2, False)] and found[4] == [(4, 2, True)] and found[5] == [(5, 1, True)]
    assert found[6] == [(6, 3, True)] * 2
    assert sorted(found[None], key=str) == sorted([(6, 3, False), (None, 1, True)], key=str)
    assert exact.exact_duplicates(frame(spark, rows).filter("doc_id < 0")).count() == 0


def test_clashing_digests_are_told_apart(spark):
    """With a digest of one bit every recipe is full of clashes, and the result is that of the texts."""
    rng = random.Random(14)
    long = "".join(rng.choice("abcdef ") for _ in range(20_000))
    texts = ["aa", "bb", "aa", "ccc", "", None, long, long + "x", long, "x" + long, "c" * 600, "cc" * 300]
    docs = frame(spark, list(enumerate(texts)))
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.exact_duplicates(docs, named=lambda chunk: bytes([len(chunk) % 2])).collect()}
    groups = {i: [j for j, t in enumerate(texts) if (t or "") == (texts[i] or "")] for i in range(len(texts))}
    assert found == {i: (max(g), len(g), i == max(g)) for i, g in groups.items()}
    assert exact.clashes(docs, named=lambda chunk: bytes([len(chunk) % 2])).count() == 2 and exact.clashes(docs).count() == 0
    with pytest.raises(ValueError):
        exact.recipes(docs, named=lambda chunk: bytes([len(chunk) % 2]), most=1)


@pytest.mark.parametrize("size", [1, 2000])
def test_one_hot_text(spark, size):
    docs = spark.range(size).select(F.col("id").alias("doc_id"), F.lit("same text here").alias("text"))
    near = simhash.near_duplicates(docs).agg(F.max("component_id"), F.count(F.lit(1))).head()
    assert tuple(near) == (0, size)
    own = exact.exact_duplicates(docs).agg(F.min("keep_id"), F.max("keep_id"), F.sum(F.col("kept").cast("int")), F.max("group_size")).head()
    assert tuple(own) == (size - 1, size - 1, 1, size)


def test_similar_texts_keep_one(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = [rng.choice(vocabulary) for _ in range(600)]

    def edited(n):
        own = list(base)
        for at in rng.sample(range(600), n):
            own[at] = "edit"
        return " ".join(own)

    rows = [(10, " ".join(base)), (11, edited(3)), (12, edited(6)), (13, edited(60)), (14, " ".join(base).upper()), (15, " ".join(rng.choice(vocabulary) for _ in range(600)))]
    assert sorted(r.doc_id for r in simhash.keep_one(frame(spark, rows)).collect()) == [10, 13, 15]


def test_recall_of_similar_pairs_on_larger_tables(spark):
    """Of the pairs that are surely similar by brute force, at least nine in ten end in one group."""
    from tests.llm.test_pipeline import five_words, groups

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    shingles = {r.doc_id: five_words(r.text) for r in docs.collect()}
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    surely = groups(shingles, 0.8)
    gone, wanted = sum(len(g - kept) for g in surely), sum(len(g) - 1 for g in surely)
    assert gone >= 0.97 * wanted
    assert len(shingles) - len(kept) <= sum(len(g) - 1 for g in groups(shingles, 0.75))


def kept_and_expected(spark, texts):
    """What keep_one keeps of the texts, and what brute force keeps."""
    from tests.llm.test_pipeline import five_words, groups

    rows = list(enumerate(texts))
    gone = {i for g in groups({i: five_words(t) for i, t in rows}, 0.8) for i in g if i != min(g)}
    return {r.doc_id for r in simhash.keep_one(frame(spark, rows)).collect()}, {i for i, _ in rows} - gone


def test_cut_extended_and_short_copies_match_brute_force(spark):
    rng = random.Random(21)
    fresh = lambda n: [f"w{rng.randrange(40_000)}" for _ in range(n)]
    texts = []
    for _ in range(40):
        base, short, at = fresh(rng.randint(150, 400)), fresh(rng.randint(9, 20)), rng.randrange(100)
        n = len(base)
        copies = [base[: int(n * 0.84)], base[: int(n * 0.78)], base[:at] + fresh(int(n * 0.15)) + base[at:], base[int(n * 0.1) :]]
        texts += [" ".join(t) for t in (base, rng.choice(copies), short, [*short, "more"])]
    found, expected = kept_and_expected(spark, texts)
    assert len(expected) < 110 and found == expected


def test_every_pair_of_a_long_list_is_compared(spark, monkeypatch):
    """Pages that share most of a template or all of their words, with true pairs between them, in lists of many parts."""
    monkeypatch.setattr(simhash, "CHUNK", 2)
    rng = random.Random(22)
    template = [f"t{i}" for i in range(120)]
    pages = [template + [f"p{k}x{i}" for i in range(rng.randint(20, 24))] for k in range(60)]
    pages += [rng.sample(template, 120) for _ in range(80)]
    copies = [[*p, "more"] for p in pages[::2]]
    found, expected = kept_and_expected(spark, [" ".join(p) for p in pages + copies])
    assert len(expected) == 140 and found == expected
    lists = [(k, 1, 1, k % 4, k, np.zeros(32, np.uint64)) for k in range(9)]
    ids, n, left, _, root, bits = (np.array(c) for c in zip(*lists, strict=True))
    meet = lambda i, j: np.flatnonzero(np.isin(ids % 4, (i, j)))
    own = [m for i in range(4) for j in range(i, 4) for m in [meet(i, j)]]
    pairs = {p for m in own for p in simhash.crossing(ids[m], n[m], left[m], ids[m] % 4, root[m], bits[m], 0.8)}
    assert pairs == set(combinations(range(9), 2))


def test_a_family_of_thousands_is_one_group(spark):
    """Each of 4,500 texts is similar to the first and to hardly any other, in lists of more than one part."""
    base = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(base))]
    for i in range(4500):
        at = i % 60
        rows.append((i + 1, " ".join([*base[:at], f"x{i}", *base[at + 1 :]])))
    rows += [(10_000 + i, " ".join(f"y{i}z{j}" for j in range(60))) for i in range(300)]
    kept = {r.doc_id for r in simhash.keep_one(frame(spark, rows)).collect()}
    assert kept == {0, *range(10_000, 10_300)}


def test_long_texts_that_share_passages_match_brute_force(spark):
    """Texts long enough that a pair has to share several shingles, with passages in common, copies and parts."""
    rng = random.Random(24)
    fresh = lambda n: [f"w{rng.randrange(400_000)}" for _ in range(n)]
    passages = [fresh(rng.randint(20, 90)) for _ in range(6)]
    texts = []
    for _ in range(60):
        own = fresh(rng.randint(200, 1500))
        for passage in rng.sample(passages, 3):
            own += passage
        texts.append(own)
    for own in texts[:30]:
        n = len(own)
        cut = int(n * rng.choice([0.76, 0.79, 0.81, 0.84, 0.9]))
        copy = own[:cut] if rng.random() < 0.5 else own[n - cut :]
        for at in rng.sample(range(len(copy)), rng.choice([0, 1, n // 60])):
            copy[at] = "edited"
        texts.append(copy)
    found, expected = kept_and_expected(spark, [" ".join(t) for t in texts])
    assert 60 < len(expected) < 90 and found == expected


def test_the_threshold_is_exact(spark):
    rng = random.Random(23)
    fresh = lambda n: [f"w{rng.randrange(40_000)}" for _ in range(n)]
    texts = []
    for n in (7, 8, 9, 10, 11, 36, 37, 100, 101, 400):
        base, kept = fresh(n), n - 4
        for total in (kept * 5 // 4, kept * 5 // 4 + 1):  # shingles of the longer text: at 0.8 or just above, and below
            texts += [" ".join([f"s{total}x{n}", *base]), " ".join([f"s{total}x{n}", *base, *fresh(total - kept)])]
    found, expected = kept_and_expected(spark, texts)
    assert len(expected) < len(texts) and found == expected


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from foliograph.llm.common import shared_folder

    asked = []
    session = lambda master, folder: SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: "there" if asked else None, setCheckpointDir=asked.append, master=master), conf=SimpleNamespace(get=lambda *_: folder))
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,3000]"):
        with pytest.raises(RuntimeError):
            shared_folder(session(master, None))
    assert shared_folder(session("yarn", "hdfs://x")) == "there" and asked == ["hdfs://x"]
