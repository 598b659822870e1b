"""Language identification by cross-parsing entropy.

For every language a suffix automaton of labelled text is built. A text is
parsed against it greedily: each phrase is the longest match of what follows
with any substring of the training text, and the next phrase starts where the
match ends. The fewer phrases a text needs, the closer it is to that language;
the counts are divided by the symbols parsed, and the lowest wins.

Texts are lower-cased; each letter is a symbol and every run of other
characters is one separator. The walk of the automata runs over many blocks of
symbols at a time in array operations. A text of several blocks is parsed as a
whole all the same: each block is first parsed as if a phrase began at its
start, and then the phrase that reaches into it from the block before is
followed until it ends where a phrase of the block begins. From there on both
parses are one, because they continue alike from equal places.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.llm.common import held_out, resident, small_batches, table, text_bytes, windows

#: Symbols of a block, and cells (blocks by languages by symbols) that are walked at a time; neither changes a result.
BLOCK, CELLS = 1024, 1 << 23
#: The most frequent symbols have a column of the transition table; the transitions of others are looked up.
COLUMNS = 64
UNSEEN, SEPARATOR = 0, 1
UNKNOWN = "und"
#: Sharpness of the score: languages weigh as (1 / phrase rate) to this power.
SHARPNESS = 8


@dataclass(frozen=True)
class Samples:
    """Labelled text by language: all that the model is made from, and bounded."""

    texts: tuple[tuple[str, tuple[str, ...]], ...]


@dataclass(frozen=True)
class Parser:
    languages: tuple[str, ...]
    symbols: np.ndarray  # code point -> symbol
    step: np.ndarray  # state * COLUMNS + symbol -> state, or -1
    rare: np.ndarray  # state << 21 | symbol of the transitions beyond COLUMNS, in order
    rare_step: np.ndarray  # their states
    restart: np.ndarray  # language, symbol -> state after a phrase's first symbol
    roots: np.ndarray

    def move(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The state after a symbol, -1 where no match goes on."""
        if not len(self.rare):
            return self.step[state * COLUMNS + symbol]
        to = self.step[state * COLUMNS + np.minimum(symbol, COLUMNS - 1)]
        beyond = np.broadcast_to(symbol >= COLUMNS, to.shape)
        if beyond.any():
            key = (state.astype(np.int64)[beyond] << 21) + np.broadcast_to(symbol, to.shape)[beyond]
            at = np.minimum(np.searchsorted(self.rare, key), len(self.rare) - 1)
            to[beyond] = np.where(self.rare[at] == key, self.rare_step[at], -1)
        return to


def suffix_automaton(symbols: list[int]) -> tuple[np.ndarray, dict[int, dict[int, int]]]:
    """Transitions of the smallest automaton that accepts every substring; state 0 is the root.

    The moves by the first ``COLUMNS`` symbols are a table of states, -1 for
    none; those by other symbols are given by state.
    """
    wide = COLUMNS
    table = array("i", [-1]) * (wide * (2 * len(symbols) + 1))
    rare: dict[int, dict[int, int]] = {}
    link, length, last, states = [-1], [0], 0, 1

    def move(state: int, c: int) -> int:
        return table[state * wide + c] if c < wide else rare.get(state, {}).get(c, -1)

    def put(state: int, c: int, to: int) -> None:
        if c < wide:
            table[state * wide + c] = to
        else:
            rare.setdefault(state, {})[c] = to

    for c in symbols:
        cur, states = states, states + 1
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and move(p, c) < 0:
            put(p, c, cur)
            p = link[p]
        if p >= 0:
            q = move(p, c)
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy, states = states, states + 1
                table[copy * wide : (copy + 1) * wide] = table[q * wide : (q + 1) * wide]
                if q in rare:
                    rare[copy] = dict(rare[q])
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and move(p, c) == q:
                    put(p, c, copy)
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return np.frombuffer(table, np.int32).reshape(-1, wide)[:states], rare


def encode(text: str, symbols: np.ndarray) -> np.ndarray:
    """Symbols of a text: lower case, runs without letters as one separator."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    coded = symbols[points]
    apart = coded == SEPARATOR
    if len(coded):
        coded = coded[~(apart & np.concatenate(([True], apart[:-1])))]
    return coded


def build(samples: Samples) -> Parser:
    seen = Counter(c for _, texts in samples.texts for t in texts for c in t.lower() if c.isalpha())
    alphabet = sorted(seen, key=lambda c: (-seen[c], c))
    symbols = np.full(0x110000, SEPARATOR, np.int32)
    symbols[[i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()]] = UNSEEN
    symbols[[ord(c) for c in alphabet]] = np.arange(2, 2 + len(alphabet))
    width = max(2 + len(alphabet), COLUMNS)
    parts, roots, restarts, rare, base = [], [], [], [], 0
    for _, texts in samples.texts:
        moves, beyond = suffix_automaton(encode(" ".join(texts), symbols).tolist())
        dense = np.full((len(moves) + 1, COLUMNS), -1, np.int32)  # the last state is where a phrase of one unseen symbol ends
        dense[:-1] = np.where(moves < 0, -1, moves + base)
        rare += [((base + state << 21) + c, base + to) for state, own in beyond.items() for c, to in own.items()]
        restart = np.full(width, base + len(moves), np.int32)
        first = np.flatnonzero(moves[0] >= 0)
        restart[first] = base + moves[0][first]
        for c, to in beyond.get(0, {}).items():
            restart[c] = base + to
        restarts.append(restart)
        roots.append(base)
        parts.append(dense)
        base += len(dense)
    step = np.concatenate(parts).ravel() if parts else np.zeros(0, np.int32)
    keys = np.array(sorted(rare), np.int64).reshape(-1, 2)
    return Parser(
        tuple(x for x, _ in samples.texts), symbols, step, keys[:, 0].copy(), keys[:, 1].astype(np.int32), np.array(restarts, np.int32).reshape(len(parts), width), np.array(roots, np.int32)
    )


def _walk(parser: Parser, grid: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrases, last states, phrase starts) of blocks side by side, longest first, each as if a phrase began at its start."""
    k, (height, lanes) = len(parser.languages), grid.shape
    starts = np.zeros((height, k, lanes), bool)
    starts[0] = True
    state = parser.restart[:, grid[0]]
    live = lanes
    for j in range(1, height):
        while sizes[live - 1] <= j:
            live -= 1
        now = grid[j, :live]
        to = parser.move(state[:, :live], now)
        ended = to < 0
        starts[j, :, :live] = ended
        state[:, :live] = np.where(ended, parser.restart[:, now], to)
    return starts.sum(axis=0), state, starts


def _follow(parser: Parser, symbols: np.ndarray, language: int, state: int, starts: np.ndarray) -> tuple[int, int]:
    """(phrases, last state) of a block whose first phrase began in the block before; -1 for the state of its own parse."""
    step, restart, begins = memoryview(parser.step), memoryview(parser.restart[language]), starts.tolist()
    own = 0
    for j, symbol in enumerate(symbols.tolist()):
        if symbol < COLUMNS:
            to = step[state * COLUMNS + symbol]
        else:
            key = (state << 21) + symbol
            at = int(np.searchsorted(parser.rare, key))
            to = int(parser.rare_step[at]) if at < len(parser.rare) and parser.rare[at] == key else -1
        if to < 0:
            if begins[j]:
                return own + sum(begins[j:]), -1
            own, to = own + 1, restart[symbol]
        state = to
    return own, state


def phrases(parser: Parser, coded: list[np.ndarray]) -> np.ndarray:
    """Phrase counts, text by language."""
    k = len(parser.languages)
    counts = np.zeros((len(coded), k), np.int64)
    blocks = [(i, at) for i, own in enumerate(coded) for at in range(0, len(own), BLOCK)]
    lanes = max(1, CELLS // (k * BLOCK))
    carried = np.zeros(k, np.int32)  # the states at the end of the last block of the group before
    for first in range(0, len(blocks), lanes):
        group = blocks[first : first + lanes]
        size_of = np.array([min(BLOCK, len(coded[i]) - at) for i, at in group])
        order = np.argsort(-size_of, kind="stable")
        sizes = size_of[order]
        grid = np.zeros((len(group), sizes[0]), np.int32)
        for row, n in enumerate(order):
            i, at = group[n]
            grid[row, : sizes[row]] = coded[i][at : at + BLOCK]
        grid = np.ascontiguousarray(grid.T)
        made, state, starts = _walk(parser, grid, sizes)
        lane_of = np.empty(len(group), np.int64)
        lane_of[order] = np.arange(len(group))
        owner = np.array([i for i, _ in group])
        later = np.flatnonzero([at > 0 for _, at in group])  # blocks into which a phrase may reach
        # all of them at once, as if the block before had ended in the state of its own parse
        place, tongue = (x.ravel() for x in np.meshgrid(lane_of[later], np.arange(k), indexing="ij"))
        before = np.stack([carried if n == 0 else state[:, lane_of[n - 1]] for n in later]).ravel() if len(later) else np.zeros(0, np.int32)
        total, last = made.copy(), state.copy()
        met = np.ones_like(made, dtype=bool)
        own, passed, j = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64), 0
        while len(place):
            over = sizes[place] <= j  # never met
            if over.any():
                total[tongue[over], place[over]], last[tongue[over], place[over]], met[tongue[over], place[over]] = own[over], before[over], False
                place, tongue, before, own, passed = (x[~over] for x in (place, tongue, before, own, passed))
                continue
            symbol = grid[j, place]
            to = parser.move(before, symbol)
            ended, begins = to < 0, starts[j, tongue, place]
            meets = ended & begins
            total[tongue[meets], place[meets]] = own[meets] + made[tongue[meets], place[meets]] - passed[meets]
            before = np.where(ended, parser.restart[tongue, symbol], to)
            own, passed = own + ended, passed + begins
            place, tongue, before, own, passed = (x[~meets] for x in (place, tongue, before, own, passed))
            j += 1
        # where a parse has not met its block's own, what was assumed for the next block is put right in order
        wrong = np.zeros(k, bool)
        for n in range(len(group)) if not met.all() else ():
            lane = lane_of[n]
            if group[n][1] == 0:
                wrong[:] = False
            for language in np.flatnonzero(wrong):
                count, end = _follow(parser, grid[: sizes[lane], lane], language, int(last[language, lane_of[n - 1]]), starts[: sizes[lane], language, lane])
                total[language, lane], met[language, lane] = count, end < 0
                last[language, lane] = state[language, lane] if end < 0 else end
            wrong = ~met[:, lane]
        carried = last[:, lane_of[-1]]
        np.add.at(counts, owner, total[:, lane_of].T)
    return counts


def parser_of(samples: Samples) -> Parser:
    """The automata of these samples, built once in a worker process."""
    return resident(("parser", zlib.crc32(repr(samples).encode()), samples), lambda: build(samples))


def classify(samples: Samples, texts: list[str]) -> tuple[list[str], list[float]]:
    """Language and score of each text; ``und`` and 0 without letters or without languages."""
    parser = parser_of(samples)
    if not parser.languages:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    coded = [encode(t, parser.symbols) for t in texts]
    counts = phrases(parser, coded)
    lettered = np.array([bool((own != SEPARATOR).any()) for own in coded], bool)
    rates = np.maximum(counts, 1) / np.maximum(np.array([len(x) for x in coded]), 1)[:, None]
    weights = (rates.min(axis=1, keepdims=True) / rates) ** SHARPNESS
    best = rates.argmin(axis=1)  # of equal rates the first language by name
    scores = np.where(lettered, weights.max(axis=1) / weights.sum(axis=1), 0.0)
    return [parser.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)], scores.tolist()


def learn(docs: DataFrame, sample_rows: int = 60, sample_chars: int = 32_768, all_chars: int = 262_144, languages: int = 4096) -> Samples:
    """Labelled text for the automata, from rows that are not held out.

    The sample is bounded: about ``2 * sample_rows`` rows a language, chosen by
    a hash of id and text length, of which the beginnings are taken until they
    hold ``sample_chars`` characters; with more than eight languages each has an
    equal part of ``all_chars``, of 64 characters at least. Every label is
    learned, and a table with more than ``languages`` labels is refused. Rows
    whose text is null or has no letter teach nothing, and rows that repeat an
    id and a length count as one.
    """
    rows = docs.select(
        F.col("lang").cast("string").alias("lang"),
        F.left(F.col("text").cast("string"), F.lit(sample_chars)).alias("piece"),
        F.xxhash64(F.col("doc_id").cast("string"), F.length("text")).alias("h"),
        held_out().alias("held"),
    ).filter(F.col("lang").isNotNull() & ~F.col("held") & F.col("piece").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").count().limit(languages + 1).collect()
    if len(counts) > languages:
        raise ValueError(f"lang has more than {languages} values")
    if not counts:
        return Samples(())
    room = min(sample_chars, all_chars // len(counts))
    share = {r["lang"]: min(1.0, 2.0 * sample_rows / r["count"]) for r in counts}
    rate = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.col("lang")]
    low = (F.pmod(F.col("h"), F.lit(1 << 40)) / float(1 << 40)) < rate
    taken = rows.filter(low).groupBy("lang", "h").agg(F.min(F.left("piece", F.lit(room))).alias("piece")).collect()
    texts: dict[str, list[str]] = {}
    for lang, _, text in sorted(taken, key=lambda r: (r["lang"], r["h"])):
        own = texts.setdefault(lang, [])
        left = room - sum(map(len, own))
        if left > 0:
            own.append(text[:left])
    return Samples(tuple(sorted((x, tuple(own)) for x, own in texts.items())))


def identify(docs: DataFrame, samples: Samples) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per input row.

    Only the text decides. Null texts and texts without a letter are ``und``
    with score 0; with one language learned every other text is that language
    with score 1; of equal phrase counts the first language by name wins.
    Repeated rows give repeated rows; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in windows(batches, "body", 4 << 20):
            texts = [t.decode("utf-8", "replace") for t in batch.column(2).to_pylist()]
            langs, scores = classify(samples, texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_bytes().alias("body"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, samples: Samples | None = None) -> DataFrame:
    """The rows of ``docs`` in some language: those predicted ``und`` go, null texts and texts without a letter.

    The decision is taken row by row in the scan, so nothing is shuffled and
    columns of any name pass through untouched.
    """
    small_batches(docs.sparkSession)
    learned = learn(docs) if samples is None else samples

    @F.arrow_udf("boolean")
    def known(texts: pa.Array) -> pa.Array:
        verdicts: list[bool] = []
        for at in range(0, len(texts), 512):  # a bounded number of texts is decoded at a time
            langs, _ = classify(learned, [t if t is not None else "" for t in texts.slice(at, 512).to_pylist()])
            verdicts += [x != UNKNOWN for x in langs]
        return pa.array(verdicts, pa.bool_())

    return docs.filter(known(docs["text"].cast("string")))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: doc_id, held_out, lang_pred, score for every document."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))
