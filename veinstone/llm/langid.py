"""Language ID by cross-parsing entropy.

For each language a suffix automaton of labelled text gives, at any place of another text, the longest
match that begins there. Cross-parsing cuts a text into such longest matches; a language's entropy
estimate is phrases * log2(size of its training text) / length, and the lowest one wins.

The automaton is turned into one table: a state is a place in it, and its transition by a symbol stands that
many entries on, if the entry says that it belongs to the state; if not, no longer match exists: there a phrase ends
and the next begins with that symbol. Parsing is then one lookup a symbol, done for thousands of blocks of the texts in
step. A block is first parsed as if a phrase began with it, and then corrected from the state
in which the block before it ended, up to where both begin a phrase, so that phrases are those of
the whole text. Two rounds of that do for nearly all blocks; where phrases are longer, blocks are parsed again in the order of their text,
each once. Symbols are the letters of the training texts, lower-cased, one symbol for any other
letter, and one for each run of anything else.

Training: of the labelled rows of each language those with the lowest hashes, until they have `characters`
characters or are `rows_per_language`; of a row at most `longest` characters are learnt. This is a
bounded sample of labelled rows, and the bound is these parameters. Every text is parsed whole, very long ones too.

The prediction is `und`, score 0, for null texts and texts without a letter, or if nothing is
labelled. Ties, up to a thousandth, go to the language with most labelled rows. The score is the margin,
1 - best / second best (1 if there is one language only). Repeated rows are judged alike; an empty
table gives an empty result; a null doc_id is never held out and never learnt from.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, small_batches

BLOCK = 256
#: Characters that are parsed in step; bounds a worker's memory.
CHUNK = 600_000
#: From so many texts on it is cheaper to correct their blocks in step than one by one.
TOGETHER = 48


class Model(NamedTuple):
    """Sorted (language, training text) pairs, already folded to the letters that count, and those letters."""

    texts: tuple[tuple[str, str], ...]  # languages with most labelled rows first
    letters: str

    @property
    def key(self) -> str:
        return hashlib.sha256(repr(tuple(self)).encode()).hexdigest()


def train(labelled: DataFrame, rows_per_language: int = 128, characters: int = 48_000, longest: int = 4000) -> Model:
    """A model of `labelled` (doc_id, text, lang); rows with a null among these are skipped."""
    full = labelled.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    rows_of = {r.lang: r.n for r in full.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    draw = F.xxhash64("doc_id", "text")
    # Rows whose draw is below their language's share: some more than asked for, of which the lowest are kept.
    share = F.create_map(*[F.lit(x) for lang, n in rows_of.items() for x in (lang, (rows_per_language + 6 * rows_per_language**0.5) / n)]) if rows_of else F.create_map().cast("map<string,double>")
    low = (draw.cast("double") / 2.0**64 + 0.5) <= share[F.col("lang")]
    rows = full.where(low).select("lang", draw.alias("draw"), F.left("text", F.lit(longest)).alias("text")).distinct()
    parts: dict[str, list] = {}
    for r in sorted(rows.collect(), key=lambda r: (r.lang, r.draw, r.text)):
        own = parts.setdefault(r.lang, [])
        if len(own) < rows_per_language and sum(map(len, own)) < characters:
            own.append(r.text.lower())
    letters = "".join(sorted({c for texts in parts.values() for t in texts for c in t if c.isalpha()}))
    return Model(tuple((lang, "\n".join(parts[lang])) for lang in sorted(parts, key=lambda x: (-rows_of[x], x))), letters)


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The transitions of the smallest automaton that reads every substring; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


def packed_table(moves: list[dict[int, int]], width: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The transitions in one table, and the place of each state in it.

    The transition of a state at place p by symbol c is entry p + c; its upper half has p, its lower half the place it leads to.
    Places are drawn at random until no two transitions want one entry; states with many transitions first.
    """
    rng = np.random.default_rng(seed)
    degree = np.array([len(m) for m in moves], np.int64)
    source = np.repeat(np.arange(len(moves)), degree)
    symbol = np.array([c for m in moves for c in m], np.int64)
    target = np.array([t for m in moves for t in m.values()], np.int64)
    size = 1 << max(10, int(4 * max(len(source), len(moves))).bit_length())
    place, taken, used = np.zeros(len(moves), np.int64), np.zeros(size + width, bool), np.zeros(size, bool)
    for low, high in ((9, width + 1), (3, 9), (0, 3)):
        pending = np.flatnonzero((degree >= low) & (degree < high))
        while len(pending):
            place[pending] = rng.integers(0, size, len(pending))
            own = np.flatnonzero(np.isin(source, pending))
            slots = place[source[own]] + symbol[own]
            _, first = np.unique(slots, return_index=True)
            bad = np.ones(len(own), bool)
            bad[first] = False
            bad |= taken[slots]
            _, alone = np.unique(place[pending], return_index=True)
            good = np.zeros(len(moves), bool)
            good[pending[alone]] = True
            good[pending[used[place[pending]]]] = False
            good[source[own[bad]]] = False
            done = good[source[own]]
            taken[slots[done]] = True
            used[place[good]] = True
            pending = pending[~good[pending]]
    table = np.full(size + width, -1, np.int64)
    table[place[source] + symbol] = place[source] << 32 | place[target]
    return table, place


def _advance(table: np.ndarray, first: np.ndarray, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states after one more symbol, and where it begins a phrase."""
    got = table[state + symbol]
    new = (got >> 32) != state
    return np.where(new, first[symbol], got & 0xFFFFFFFF), new


class Parser:
    """The lookup tables of a model; made once in each Python worker."""

    def __init__(self, model: Model):
        self.languages = [lang for lang, _ in model.texts]
        self.symbol = np.zeros(0x110000, np.int32)
        for cp in range(0x110000):
            if unicodedata.category(chr(cp))[0] == "L":
                self.symbol[cp] = 1
        for k, c in enumerate(model.letters):
            self.symbol[ord(c)] = k + 2
        self.width = len(model.letters) + 2
        self.tables, self.firsts, self.sizes = [], [], []
        for _, text in model.texts:
            symbols = self.symbols(text)
            # The last state follows a symbol that never occurs, which is a phrase of its own.
            moves = [*suffix_automaton(symbols.tolist()), {}]
            table, place = packed_table(moves, self.width)
            first = np.full(self.width, place[-1], np.int64)
            for c, state in moves[0].items():
                first[c] = place[state]
            self.tables.append(table)
            self.firsts.append(first)
            self.sizes.append(max(2, len(symbols)))

    def symbols(self, text: str) -> np.ndarray:
        """Symbols of a text; runs of other than letters are one symbol, none at the start."""
        made = self.symbol[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
        letter = made > 0
        return made[letter | np.r_[False, letter[:-1]]]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text by each language."""
        lengths = np.array([len(t) for t in texts], np.int64)
        every = np.concatenate([*texts, np.zeros(BLOCK, np.int32)])
        blocks = -(-lengths // BLOCK)
        of = np.repeat(np.arange(len(texts)), blocks)
        within = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = np.repeat(np.cumsum(lengths) - lengths, blocks) + within * BLOCK
        size = np.minimum(BLOCK, np.repeat(lengths, blocks) - within * BLOCK)
        order = np.argsort(-size, kind="stable")
        follows = np.full(len(of), -1)  # the block behind each, by place in that order
        place = np.argsort(order, kind="stable")
        inner = np.flatnonzero(within > 0)
        follows[place[inner - 1]] = place[inner]
        of, start, size = of[order], start[order], size[order]
        grid = every[np.arange(BLOCK)[:, None] + start[None, :]]
        active = np.searchsorted(-size, -np.arange(BLOCK), side="left")  # blocks longer than each step
        out = np.zeros((len(texts), len(self.tables)), np.int64)
        for k, (table, first) in enumerate(zip(self.tables, self.firsts, strict=True)):
            begins = np.zeros((BLOCK, len(of)), bool)
            begins[0] = True
            state = first[grid[0]]
            for step in range(1, BLOCK):
                n = active[step]
                if not n:
                    break
                state[:n], begins[step, :n] = _advance(table, first, state[:n], grid[step, :n])
            counts = self._corrected(table, first, grid, size, state, begins, follows, place)
            out[:, k] = np.bincount(of, counts, minlength=len(texts))
        return out

    @staticmethod
    def _corrected(table: np.ndarray, first: np.ndarray, grid: np.ndarray, size: np.ndarray, end: np.ndarray, begins: np.ndarray, follows: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Phrases that begin in each block, if it is entered in the state in which the block before it ends.

        `follows` has the block behind each, `place` the blocks in the order of the texts.
        """
        sums = np.concatenate([np.zeros((1, len(size)), np.int32), np.cumsum(begins, axis=0, dtype=np.int32)])
        plain, counts, end = end, sums[-1].astype(np.int64), end.copy()
        moves, starts = memoryview(table), first.tolist()

        def together(lane: np.ndarray, state: np.ndarray) -> np.ndarray:
            """Parse blocks again, all in step; their ends."""
            made, lanes, at = np.zeros(len(lane), np.int64), lane, np.arange(len(lane))
            final = plain[lane]  # where both parses meet, the rest is the plain one
            for step in range(len(grid)):
                if not len(lanes):
                    break
                state, new = _advance(table, first, state, grid[step, lanes])
                met = new & begins[step, lanes]
                counts[lanes[met]] = made[at[met]] + sums[-1, lanes[met]] - sums[step, lanes[met]]
                made[at] += new
                over = ~met & (size[lanes] == step + 1)
                counts[lanes[over]] = made[at[over]]
                final[at[over]] = state[over]
                go = ~(met | over)
                lanes, at, state = lanes[go], at[go], state[go]
            return final

        def alone(lane: int, state: int) -> int:
            made = 0
            for step, c in enumerate(grid[: size[lane], lane].tolist()):
                got = moves[state + c]
                if got >> 32 == state:
                    state = got & 0xFFFFFFFF
                    continue
                if begins[step, lane]:
                    counts[lane] = made + sums[-1, lane] - sums[step, lane]
                    return int(plain[lane])
                made, state = made + 1, starts[c]
            counts[lane] = made
            return state

        changed = np.flatnonzero(follows >= 0)
        for _ in range(2):
            if not len(changed):
                return counts
            lane = follows[changed]
            final = together(lane, end[changed])
            moved = final != end[lane]
            end[lane] = final
            changed = lane[moved & (follows[lane] >= 0)]
        # What is left goes in the order of the texts, the first open block of each at a time.
        order, open_ = np.argsort(place, kind="stable"), np.zeros(len(size) + 1, bool)
        open_[order[follows[changed]]] = True
        text = np.cumsum(np.r_[1, follows[place[:-1]] < 0])
        while open_.any():
            at = np.flatnonzero(open_)
            at = at[np.unique(text[at], return_index=True)[1]]
            if len(at) >= TOGETHER:
                lane = place[at]
                final = together(lane, end[place[at - 1]])
                moved = (final != end[lane]) & (follows[lane] >= 0)
                end[lane] = final
                open_[at] = False
                open_[at[moved] + 1] = True
                continue
            for k in at.tolist():
                while k < len(size) and follows[place[k - 1]] == place[k]:
                    if open_[k]:
                        open_[k] = False
                        final = alone(place[k], int(end[place[k - 1]]))
                        if final != end[place[k]] and follows[place[k]] >= 0:
                            open_[k + 1] = True
                        end[place[k]] = final
                    k += 1
        return counts

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        made = [self.symbols(t) if t else np.empty(0, np.int32) for t in texts]
        full = [k for k, m in enumerate(made) if len(m)]
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if full and self.tables:
            counts = self.phrases([made[k] for k in full])
            entropy = counts * np.log2(self.sizes) / np.array([len(made[k]) for k in full])[:, None]
            # Within a thousandth it is a tie, which the language with most labelled rows wins.
            best = (entropy <= entropy.min(axis=1, keepdims=True) * 1.001).argmax(axis=1)
            low = np.sort(entropy, axis=1)
            margin = 1 - low[:, 0] / low[:, 1] if entropy.shape[1] > 1 else np.ones(len(full))
            for k, b, m in zip(full, best, margin, strict=True):
                langs[k], scores[k] = self.languages[b], float(m)
        return langs, scores


_parsers: dict[str, Parser] = {}


def parser(model: Model) -> Parser:
    key = model.key
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = Parser(model)
    return _parsers[key]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of `docs` with lang_pred and score added (in place of input columns of these names)."""
    small_batches(docs.sparkSession)
    keep = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    names = [f.name for f in keep]
    at = names.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the parameters of train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = parser(sent.value)
        for batch in batches:
            langs, scores, part, chars = [], [], [], 0
            for text in batch.column(at):
                part.append(text.as_py())
                chars += len(part[-1] or "")
                if chars >= CHUNK:
                    for all_of, new in zip((langs, scores), own.judge(part), strict=True):
                        all_of += new
                    part, chars = [], 0
            for all_of, new in zip((langs, scores), own.judge(part), strict=True):
                all_of += new
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    schema = docs.select(*names).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*names).mapInArrow(released(run), schema)


def held_out(doc_id: str = "doc_id"):
    """True for the documents that are never learnt from: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; learns from the rows that are not held out."""
    model = train(docs.where(~held_out()).select("doc_id", "text", "lang"), **bounds)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
