import math
from collections import Counter

import corpus_pipeline
from foliograph.llm import contamination, langid

SF = "/root/testdata/sf0.01"


def five_words(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups(shingles, similarity):
    """Brute force: groups of more than one text that links of this similarity connect."""
    root = {i: i for i in shingles}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    frequency = Counter(s for own in shingles.values() for s in own)
    holders = {}
    for i, own in shingles.items():
        ordered = sorted(own, key=lambda s: (frequency[s], s))
        for s in ordered[: len(own) - math.ceil(similarity * len(own)) + 1] or [None]:  # similar sets share one of these
            holders.setdefault(s, []).append(i)
    for pair in {(a, b) for h in holders.values() for n, b in enumerate(h) for a in h[:n]}:
        x, y = (shingles[i] for i in pair)
        if len(x & y) >= similarity * len(x | y):
            lo, hi = sorted(map(find, pair))
            root[hi] = lo
    out = {}
    for i in root:
        out.setdefault(find(i), set()).add(i)
    return [g for g in out.values() if len(g) > 1]


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "sharding":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = kept[name] = spark.read.parquet(str(tmp_path / name))
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in kept.items()}

    languages = {r.doc_id: r.lang_pred for r in langid.identify(kept["documents"], langid.learn(kept["documents"])).collect()}
    assert ids["language_id"] == {i for i, x in languages.items() if x != "und"}

    texts = {r.doc_id: r.text for r in kept["language_id"].collect()}
    shingles = {i: five_words(t) for i, t in texts.items()}
    sure, doubtful = groups(shingles, 0.83), groups(shingles, 0.77)
    out = ids["near_dedup"]
    for group in sure:  # no group that is surely similar keeps two
        assert len(group & out) <= 1
    for group in doubtful:  # no text that is surely unlike others goes
        assert group & out and min(group) in out
    assert all(i in out for i in texts if not any(i in g for g in doubtful))

    leaks = contamination.overlaps(kept["near_dedup"], spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert ids["decontaminate"] == ids["near_dedup"] - {r.doc_id for r in leaks.collect()}
    assert ids["mixing"] <= ids["decontaminate"]
    assert kept["sharding"].count() == kept["mixing"].count()


def test_run_returns_what_the_stages_give(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "shard", "slot"} <= set(rows.columns) and rows.count() > 0


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_nulls_ties_and_clashing_columns(spark, tmp_path):
    """Every stage takes rows without text or id, repeated rows and columns with names of its own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    odd = docs.limit(3).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "lang", "source", "n_chars").unionByName(docs.limit(3)).unionByName(docs.limit(2).selectExpr("doc_id + 90000000 AS doc_id", "CAST(NULL AS STRING) AS text", "lang", "source", "n_chars"))
    own = docs.unionByName(odd).selectExpr("*", "1 AS shard", "2 AS row", "3 AS id", "4 AS text_key", "5 AS node", "'x' AS body", "6 AS domain", "7 AS part")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, own, SF)
        if name != "sharding":
            assert out.columns == own.columns
        out.write.parquet(str(tmp_path / name))
        own = spark.read.parquet(str(tmp_path / name))
        assert own.count() > 0
