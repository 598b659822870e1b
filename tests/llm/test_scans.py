import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliograph.llm import contamination, langid, licenses, ngrams, pii, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, spans string, held_out string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x", "y", "z") for i, t, lang in rows], SCHEMA)


# -- decontamination --------------------------------------------------------------------------------------------
def plain_tiles(item, text, shortest):
    """Greedy string tiling by its definition: again and again the longest unmarked common run."""
    a, b, found = [False] * len(item), [False] * len(text), []
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] >= 0 and not a[p + n] and not b[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, t)
        n, p, t = best
        if n < shortest or not n:
            return found
        a[p : p + n] = b[t : t + n] = [True] * n
        found.append((p, t, n))


def test_tiles_are_those_of_the_definition():
    """Where what is left of a match and shorter ones compete, too."""
    rng = random.Random(11)
    for _ in range(4000):
        item, text = ([rng.randint(0, 2) for _ in range(rng.randint(0, n))] for n in (12, 20))
        shortest = rng.randint(2, 3)
        assert contamination.tiles(item, text, shortest) == plain_tiles(item, text, shortest)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(-1, 3), max_size=24), st.integers(2, 4))
def test_tiles_cover_as_the_definition_does(item, text, shortest):
    found, expected = contamination.tiles(item, text, shortest), plain_tiles(item, text, shortest)
    assert all(item[p : p + n] == text[t : t + n] and n >= shortest for p, t, n in found)
    used = [i for p, _, n in found for i in range(p, p + n)]
    assert len(used) == len(set(used))
    assert sum(n for *_, n in found) == sum(n for *_, n in expected)


def test_reordered_passages_are_found_and_clean_texts_are_not(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(40)), None) for i in range(20)]
    own = items[3][1].split()
    moved = " ".join([*own[20:], "in", "between", *own[:20]])
    rows = [
        (1, f"before {items[0][1].upper()}, after", "en"),
        (2, f"some {moved} more", "en"),
        (3, " ".join(own[:12]), "en"),
        (4, " ".join(rng.choice(words) for _ in range(3000)), "en"),
        (5, None, "en"),
        (6, "", None),
        (None, items[7][1], "en"),
        (1, items[0][1], "en"),
    ]
    benchmark = frame(spark, [*items, (98, "too short", None), (99, None, None)]).withColumnRenamed("doc_id", "item_id")
    found = contamination.overlaps(frame(spark, rows), benchmark).collect()
    assert sorted((r.doc_id or -1, r.item_id, r.coverage) for r in found) == [(-1, 7, 1.0), (1, 0, 1.0), (1, 0, 1.0), (2, 3, 1.0)]
    assert next(r.n_tiles for r in found if r.doc_id == 2) == 2
    clean = contamination.remove_leaks(frame(spark, rows), benchmark)
    assert sorted(r.doc_id for r in clean.collect()) == [3, 4, 5, 6] and clean.columns == frame(spark, rows).columns
    assert contamination.overlaps(frame(spark, rows), benchmark.filter("item_id < 0")).count() == 0
    assert contamination.remove_leaks(frame(spark, rows).filter("doc_id < 0"), benchmark).count() == 0
    blocks = contamination.overlaps(frame(spark, rows), benchmark, block_bytes=500).collect()
    assert sorted(map(str, blocks)) == sorted(map(str, found))
    blocks = contamination.remove_leaks(frame(spark, rows), benchmark, block_bytes=500)
    assert sorted(r.doc_id for r in blocks.collect()) == [3, 4, 5, 6]
    nameless = frame(spark, [(None, items[0][1], None), (-1, items[3][1], None), (-1, items[3][1], None)]).withColumnRenamed("doc_id", "item_id")
    found = contamination.overlaps(frame(spark, rows), nameless).collect()
    assert sorted(((r.doc_id, r.item_id) for r in found), key=str) == [(1, None), (1, None), (2, -1)]


def test_coverage_on_small_tables_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    found = {(r.doc_id, r.item_id) for r in contamination.op1_decontaminate(spark, sf_dir).collect()}
    expected = set()
    for d in docs:
        words = contamination.tokens((d.text or "").encode())
        grams = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        for item in items:
            own = contamination.tokens(item.text.encode())
            if any(tuple(own[i : i + 5]) in grams for i in range(len(own) - 4)):
                code = {w: i for i, w in enumerate(own)}
                covered = sum(n for *_, n in plain_tiles([code[w] for w in own], [code.get(w, -1) for w in words], 5))
                if covered >= 0.5 * len(own):
                    expected.add((d.doc_id, item.item_id))
    assert found == expected and found


# -- personal data ----------------------------------------------------------------------------------------------
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@@..%+- ()0125979é\n", max_size=60))
def test_base_spans_follow_the_patterns(text):
    assert [tuple(s) for s in pii.detect(text)] == plain_base(text)


def test_base_spans_on_small_tables(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in pii.op2_pii(spark, sf_dir).collect():
        base = plain_base(docs[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in base) for kind in pii.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))


def test_disguises_map_back_to_the_source():
    cases = {
        "write to john.doe [at] mail (dot) example [dot] com now": ("email", "john.doe [at] mail (dot) example [dot] com"),
        "write to jane at mail dot example dot org today": ("email", "jane at mail dot example dot org"),
        "mail jоhn@exаmple.com please": ("email", "jоhn@exаmple.com"),
        "mail bob@example​.com please": ("email", "bob@example​.com"),
        "host 192[.]168[.]0[.]1 is down": ("ip", "192[.]168[.]0[.]1"),
        "host 10 dot 0 dot 0 dot 7 is down": ("ip", "10 dot 0 dot 0 dot 7"),
        "card ４１１１ 1111 1111 1111 ok": ("card", "４１１１ 1111 1111 1111"),
        "call plus one five five five one two three four five six seven soon": ("phone", "plus one five five five one two three four five six seven"),
        "mail kate @ example . org today": ("email", "kate @ example . org"),
        "host 192.168.O.l is down": ("ip", "192.168.O.l"),
        "call +1 (55O) l23-4567 now": ("phone", "+1 (55O) l23-4567"),
        "mail me: jane at mail.example.org now": ("email", "jane at mail.example.org"),
        "call plus one double five oh triple two nine nine four one": ("phone", "plus one double five oh triple two nine nine four one"),
        "ruf plus vier neun drei null eins zwei drei vier fünf sechs an": ("phone", "plus vier neun drei null eins zwei drei vier fünf sechs"),
    }
    for text, (kind, span) in cases.items():
        base, added = pii.find(text)
        assert [(s.kind, text[s.start : s.end]) for s in added] == [(kind, span)], (text, base, added)
        assert pii.redact(text) == text.replace(span, f"[{kind}]")


def test_plain_prose_gains_no_span():
    for text in ("We met at noon and the dot com era ended.", "one two three go", "un deux trois", "f(at) and [dot]", "Das ist ein Punkt hier", "see me @ home. Thanks", "Il o 1l O2 x", "contact us at www.example.com/help or meet at example.com", ""):
        assert pii.find(text) == ([], [])


def test_long_runs_stay_linear():
    n = 200_000
    texts = ["a" * n, "1" * n, "1." * n, "+1 " * n, "@" * n, "a@" * n, "zero " * n, " dot a" * n, "1l" * n, "1o " * n, "a @ b . " * n, "double " * n]
    texts += ["-" * n + " 0O", "." * n + " 1l", " " * n + "x a [at] b", " at b dot" * n, "a at" * n, "( " * n + "[at]", "(at" * n, "O-" * n + "1", "x" * n + " dot a at b", "mail " * n, "1 dot " * n]
    for text in texts:
        began = time.process_time()
        pii.find(text)
        assert time.process_time() - began < 2 * max(1, len(text) / n), text[:20]


def test_spelled_addresses_of_any_length_are_found():
    for name, domain in (("a" * 400, "example"), ("joe", "b" * 400), ("x" * 50_000, "y" * 50_000)):
        text = f"see {name} at {domain} dot com today"
        assert [(s.kind, text[s.start : s.end]) for s in pii.find(text)[1]] == [("email", f"{name} at {domain} dot com")]
    chain = " dot ".join(f"p{i}" for i in range(200))
    text = f"to {chain} at x dot y, and jo at a dot b dot c"
    assert [text[s.start : s.end] for s in pii.find(text)[1]] == [f"{chain} at x dot y", "jo at a dot b dot c"]


def test_pii_rows_with_nulls_and_empty_tables(spark):
    rows = [(1, None, None), (2, "", "en"), (2, "a@b.c", "en"), (None, "a@b.c", "en")]
    found = pii.scan(frame(spark, rows)).collect()
    assert sorted((r.doc_id or -1, len(r.spans)) for r in found) == [(-1, 1), (1, 0), (2, 0), (2, 1)]
    assert pii.scan(frame(spark, rows).filter("doc_id < 0")).count() == 0


# -- language ---------------------------------------------------------------------------------------------------
def plain_phrases(training, text):
    count = at = 0
    while at < len(text):
        n = 0
        while at + n < len(text) and text[at : at + n + 1] in training:
            n += 1
        at += max(n, 1)
        count += 1
    return count


def test_phrases_match_the_definition():
    """Texts of many blocks, of symbols with and without a column, some of which repeat so that no block meets its own parse."""
    rng = random.Random(7)
    letters = [chr(0x4E00 + i) for i in range(100)]
    training = "".join(rng.choice("abc d") for _ in range(400)) + "xxx " + "".join(rng.choice(letters) for _ in range(300))
    other = "".join(rng.choice("abz d") for _ in range(300))
    parser = langid.build(langid.Samples((("xx", (training,)), ("yy", (other,)))))
    assert len(parser.rare)
    known = [parser_text(langid.encode(t, parser.symbols)) for t in (training, other)]
    texts = ["", "a", "x" * 5000, "x" * 3000 + "ab", training * 8, "abcd" * 2000, "Ж" * 2100]
    texts += ["".join(rng.choice("abcz d") for _ in range(n)) for n in (5, 300, 1024, 1025, 3000, 9000)]
    texts += ["".join(rng.choice(letters) for _ in range(4000)), "".join(rng.choice(["x" * 1500, "ab", training]) for _ in range(20))]
    coded = [langid.encode(t, parser.symbols) for t in texts]
    expected = [[plain_phrases(t, parser_text(c)) for t in known] for c in coded]
    assert langid.phrases(parser, coded).tolist() == expected
    for block, cells in ((16, 64), (7, 4096), (1, 1 << 20)):  # the execution's sizes change nothing
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(langid, "BLOCK", block)
            patch.setattr(langid, "CELLS", cells)
            assert langid.phrases(parser, coded[:12]).tolist() == expected[:12]


def test_every_label_is_learned(spark):
    rows = [(1000 * k + i, chr(0x4E00 + 40 * k) * 3 + "".join(chr(0x4E00 + 40 * k + j % 30) for j in range(i * 7)), f"l{k}") for k in range(70) for i in range(8)]
    rows.append((99_999, "only one very long text " * 9000, "long"))
    docs = frame(spark, rows)
    samples = langid.learn(docs)
    assert len(samples.texts) == 71 and sum(len(t) for _, own in samples.texts for t in own) <= 262_144
    found = {r.doc_id: r.lang_pred for r in langid.identify(docs, samples).collect()}
    assert found == {i: lang for i, _, lang in rows}
    with pytest.raises(ValueError):
        langid.learn(docs, languages=70)


def parser_text(symbols):
    return "".join(chr(97 + int(s)) if s else chr(33 + n % 2) for n, s in enumerate(symbols))  # unseen letters match nothing


def test_languages_of_held_out_documents(spark, sf_dir):
    rows = langid.op7_langid(spark, "/root/testdata/sf0.01").collect()
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    apart = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in apart) >= 0.98 * len(apart)


def test_language_corner_cases(spark):
    text = "the quick brown fox jumps over the lazy dog " * 40
    other = "der schnelle braune fuchs springt über den faulen hund " * 40
    rows = [(i, text if i % 2 else other, "en" if i % 2 else "de") for i in range(40)]
    odd = [(100, None, "en"), (101, "", "en"), (102, "123 !!", None), (103, "the lazy fox", None), (104, "Ж" * 5, None), (None, other, "de"), (103, "the lazy fox", None)]
    found = langid.identify(frame(spark, odd), langid.learn(frame(spark, rows))).collect()
    assert sorted((r.doc_id or -1, r.lang_pred) for r in found if r.doc_id != 104) == [(-1, "de"), (100, "und"), (101, "und"), (102, "und"), (103, "en"), (103, "en")]
    nothing = langid.learn(frame(spark, odd).filter("lang IS NULL"))
    assert {r.lang_pred for r in langid.identify(frame(spark, odd), nothing).collect()} == {"und"}
    kept = langid.keep_known(frame(spark, rows + odd))
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted([*range(40), 103, 103, 104, -1])
    assert langid.identify(frame(spark, odd).filter("doc_id < 0"), nothing).count() == 0


# -- toxicity ---------------------------------------------------------------------------------------------------
def test_toxicity_of_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = toxicity.op9_toxicity(spark, sf_dir).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    apart = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    toxic = [p for y, p in apart if y]
    assert sum(toxic) >= 0.9 * len(toxic)
    assert sum(p for y, p in apart if not y) <= 0.01 * len(apart)


def test_toxicity_corner_cases(spark):
    docs = frame(spark, [(i, "nice and calm words" if i % 3 else "you awful villain", "en") for i in range(90)] + [(200, None, "en"), (201, "", None), (None, "awful villain", "en")])
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)] + [(None, 1, 1), (5, None, None), (6, 0, 7)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels)
    found = toxicity.rate(docs, model).collect()
    assert len(found) == docs.count()
    assert next(r.predicted for r in found if r.doc_id is None) == 1
    empty = {r.score for r in found if r.doc_id in (200, 201)}
    assert len(empty) == 1
    none = toxicity.learn(docs, labels.filter("toxic = 9"))
    nothing = toxicity.rate(docs, none).collect()
    assert len(nothing) == docs.count() and {r.predicted for r in nothing} == {0} and max(r.score for r in nothing) < 1e-15
    assert {r.predicted for r in toxicity.rate(docs, toxicity.learn(docs, labels.filter("toxic = 0"))).collect()} == {0}
    assert toxicity.rate(docs.filter("doc_id < 0"), model).count() == 0
    again = frame(spark, [(i, f"text {k} of a repeated id", "en") for i in (0, 4) for k in range(500)])
    assert ngrams.sample(again, spark.createDataFrame([(0, 1), (4, 0)], "id long, label int"), 1000, 100, 10_000).count() == 2
    short = ngrams.sample(docs, spark.createDataFrame([(i, 0) for i in range(90)], "id long, label int"), 10_000, 100, 450).collect()
    assert len(short) == 90 and sum(len(r.body) for r in short) <= 450


def slot_of(gram):
    """The slot of one n-gram, character by character."""
    value = 0
    for c in gram:
        value = (value + ord(c) + 1) * 0x9E3779B1 % 2**32
        value ^= value >> 15
    return (value + len(gram)) * 0x9E3779B1 % 2**32 >> 12


def plain_slots(text):
    padded = f" {text.lower()} "
    return Counter(slot_of(padded[i : i + n]) for n in (3, 4, 5, 6) for i in range(len(padded) - n + 1))


def test_ratios_and_weights_match_brute_force(spark):
    rng = random.Random(13)
    words, bad = "alpha beta gamma delta épsilon ζήτα 漢字".split(), "awful vile scheußlich".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(3, 9)) + rng.choices(bad, k=2 * (i % 3 == 0))), i % 3 == 0) for i in range(120)]
    counted = [plain_slots(t) for _, t, _ in rows]
    for own, (_, text, _) in zip(counted, rows, strict=True):
        assert ngrams.present(text.encode()).tolist() == sorted(own)
    toxic = sum(y for *_, y in rows)
    held = Counter(s for own, (*_, y) in zip(counted, rows, strict=True) for s in own if y)
    others = Counter(s for own, (*_, y) in zip(counted, rows, strict=True) for s in own if not y)
    ratio, sure = {}, {}
    for s in {*held, *others}:
        a, b = held[s] + 1, others[s] + 1
        ratio[s] = math.log(a / (toxic + 2)) - math.log(b / (len(rows) - toxic + 2))
        sure[s] = abs(ratio[s]) / math.sqrt(1 / a + 1 / b)
    model = ngrams.fit([t.encode() for _, t, _ in rows], [int(y) for *_, y in rows], 2)
    chosen = {s: int(k) for s, k in enumerate(model.slots) if k}
    assert set(chosen) == {s for s in sure if sure[s] >= 3} and chosen
    # the weights minimise the ridge logistic loss over the scaled features: its gradient is zero
    values = np.zeros((len(rows), 1 + len(chosen)))
    for r, own in enumerate(counted):
        for s, n in own.items():
            if s in chosen:
                values[r, chosen[s]] = ratio[s] * math.log1p(n)
    scale = np.array([0.0, *(ratio[s] for s, _ in sorted(chosen.items(), key=lambda x: x[1]))])
    solved = np.divide(model.weights[:, 1], scale, out=np.zeros(len(scale)), where=scale != 0)
    y = np.array([y for *_, y in rows], float)
    p = 1 / (1 + np.exp(-(values @ solved + model.bias[1])))
    slope = values.T @ (p - y) + 1e-4 * len(rows) * solved
    start = np.abs(values.T @ (0.5 - y)).max()
    assert np.abs(slope).max() < 2e-2 * start and abs((p - y).sum()) < 2e-2 * len(rows)
    for (_, text, _), q in zip(rows, p, strict=True):
        assert abs(ngrams.probabilities(model, text.encode())[1] - q) < 1e-9
    rows_frame = spark.createDataFrame([(i, int(y), t.encode()) for i, t, y in rows], "id long, label int, body binary")
    spread = ngrams.fit_frame(rows_frame.repartition(5), 2)
    assert (spread.slots == model.slots).all() and np.allclose(spread.weights, model.weights, atol=1e-3) and np.allclose(spread.bias, model.bias, atol=1e-2)


def test_long_texts_are_counted_in_steps():
    text = ("some words and ä 漢 " * 40).encode()
    slots = np.arange(1 << ngrams.TABLE_BITS) % 7
    whole = ngrams.present(text).tolist(), [x.tolist() for x in ngrams.features(slots, text)]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ngrams, "STEP", 64)
        assert (ngrams.present(text).tolist(), [x.tolist() for x in ngrams.features(slots, text)]) == whole


# -- licenses ---------------------------------------------------------------------------------------------------
def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_license_scan_matches_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    templates = [(label, set(t.split())) for label, t in licenses.TEMPLATES]
    for r in licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect():
        own = plain_words(docs[r.doc_id])
        places = {label: [i for i in range(len(own)) if own[i : i + len(p.split())] == p.split()] for p, label in licenses.PHRASES}
        starts = [i for found in places.values() for i in found]
        blocks = sorted(
            (n, label, len(t & set(plain_words(line))) / len(t))
            for n, line in enumerate(docs[r.doc_id].split("\n"))
            for label, t in templates
            if len(t & set(plain_words(line))) >= 0.8 * len(t) - 1e-9
        )
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(own), len(starts), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted(x for x, found in places.items() if found))
        assert sorted((b.line, b.label, b.containment) for b in r.blocks) == blocks
        assert r.labels == ",".join(sorted({x for x, found in places.items() if found} | {label for _, label, _ in blocks}))
        assert 0 <= r.score <= 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("released under the mit license licensed cc by 4 0 nc sa other words".split()), max_size=12), st.sampled_from([0.3, 0.5, 0.8, 1.0]))
def test_filters_lose_no_match(block, threshold):
    index = licenses.Templates({b"the": 50, b"license": 9, b"under": 20}, threshold)
    own = {w.encode() for w in block}
    expected = sorted((t.label, len(own & set(t.words)) / len(t.words)) for t in index.all if len(own & set(t.words)) >= t.needed)
    assert sorted(index.matches(own)) == expected


def test_license_corner_cases(spark):
    rows = [(1, None, None), (2, "", "en"), (2, "Released under the\nMIT License.", "en"), (None, "CC BY 4.0, licensed!", "en"), (3, "mit-license É mit license", "en")]
    found = licenses.scan(frame(spark, rows)).collect()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))
    assert by[1] == [(0, 0, None, None, "")]
    assert sorted(by[2], key=str) == sorted([(0, 0, None, None, ""), (5, 1, 3, 3, "mit")], key=str)
    assert by[None] == [(5, 1, 0, 0, "cc-by")]
    assert by[3] == [(5, 2, 0, 3, "mit")]
    assert licenses.scan(frame(spark, rows).filter("doc_id < 0")).count() == 0


def test_wrapped_notices_are_found(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted"
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted"
    apart = "redistribution and use in source and binary\n" + "word " * 30 + "\nforms with or without modification are permitted"
    rows = [(1, bsd, "en"), (2, mit, "en"), (3, "x y\n" + isc, "en"), (4, apart, "en")]
    found = {r.doc_id: (r.labels, r.score) for r in licenses.scan(frame(spark, rows)).collect()}
    assert found == {1: ("bsd-terms", 1.0), 2: ("mit-grant", 1.0), 3: ("isc-grant", 1.0), 4: ("", 0.0)}


def test_license_sql_gives_what_the_scan_does(spark, tmp_path):
    import duckdb

    from foliograph.llm.queries import ORACLE

    rng = random.Random(15)
    texts = [None, "", "MIT\nLicense", "see the mit license\nand cc by 4 0 licensed"]
    for _ in range(120):
        own = rng.choice(licenses.TEMPLATES)[1].split()
        for at in rng.sample(range(len(own)), rng.choice([0, 0, 1, 3])):
            own[at] = rng.choice(["x", "the", "license"])
        own = [*rng.choices("some words before the license".split(), k=rng.randint(0, 6)), *own, *rng.choices("and after of".split(), k=rng.randint(0, 6))]
        texts.append("".join(w + rng.choice([" ", " ", " ", "\n", ", "]) for w in own))
    docs = frame(spark, [(i, t, "en") for i, t in enumerate(texts)] + [(None, texts[5], None), (3, texts[6], None)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = [*"doc_id n_words n_base first_word last_word base_labels labels".split(), "round(score, 9)"]
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE['op10_licenses']})").fetchall()
    found = licenses.op10_licenses(spark, str(tmp_path)).selectExpr(*columns).collect()
    assert sorted(map(str, expected)) == sorted(str(tuple(r)) for r in found)
    assert len({e[6] for e in expected}) > 10
