"""Toxicity of texts whose words may be disguised: restore by a noisy channel, then score.

Channel: a writer has words in mind and writes letters as look-alikes (``1d10t``), apart (``i d i o t``, ``i.d.i.o.t``)
or several times (``idiooot``). A suspicious token is a lattice of what each character may stand for; Viterbi search
finds the reading with the best sum of channel costs and of a character language model (4-grams with back-off, words
in lower case without accents) that is counted over all documents. Tokens of plain letters have one reading and
pass as they are. Letters of other forms (full width, with marks, with characters of no width between) are read as the
letters they are; Greek and Cyrillic look-alikes are read as Latin ones in a word that has Latin letters as well.

Time is linear in the length of a token: at most some milliseconds a character, where wildcards keep all
``28 ** 3`` states of the lattice alive. Empty and NULL texts have no tokens.

Scorer: logistic regression on the restored text's words and word beginnings (hashed, present or not). It is fitted
on at most ``max_training_rows`` labelled rows, those of the lowest hash of their key; features are the ``max_features``
that go with the label most by chi-square. Weights are not negative: words are evidence for toxicity or none.

The language model is bounded by its alphabet (``28 ** 4`` counts), the scorer by its features; both are sent to all
tasks.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake.llm import texts

MAX_TRAINING_ROWS = 16_000
MAX_FEATURES = 4_096
FEATURE_BITS = 20
PREFIXES = (3, 4, 5, 6)
HOLDOUT = 5

LOOK_ALIKES = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c",
}
WILD = "*"
DIVIDERS = "._-*'~,"

# Letters of other scripts, and the Latin letters they look like.
OTHER_SCRIPTS = {
    "а": "a", "в": "b", "г": "r", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "п": "n", "р": "p", "с": "c",
    "т": "t", "у": "y", "х": "x", "ь": "b", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ӏ": "l", "ԁ": "d", "ԛ": "q",
    "ԝ": "w",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p",
    "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
}
_SCRIPTS = str.maketrans(OTHER_SCRIPTS)

SYMBOLS = 28
"""Alphabet of the language model: 0 is the border of a word, 1 to 26 are letters, 27 is any other character."""

COST_LOOK_ALIKE, COST_KEPT, COST_REPEAT, COST_DIVIDER, COST_WILD = 0.7, 6.0, 0.4, 0.3, 2.0
COST_SPACE = 2.0
KNOWN_LENGTH = 64
"""Longest token whose reading is remembered, so that what is remembered is bounded in bytes too."""
KEPT_BYTES = 32 << 20
"""Links of a wide lattice that are kept before the part all its readings share is settled."""

PLAIN = str.maketrans({"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "«": '"', "»": '"',
                       "‹": "'", "›": "'", "–": "-", "—": "-", "‐": "-", "‑": "-", "…": "...", "•": "*", "·": ".",
                       "¡": "!", "¿": "?"})
"""Punctuation beyond ASCII, as the ASCII marks that disguises are read with."""


def _second_bytes() -> np.ndarray:
    """For the second byte of U+00C0 to U+00FF, the plain lower-case letter it folds to (0: none)."""
    table = np.zeros(256, np.uint8)
    for point in range(0xC0, 0x100):
        base = unicodedata.normalize("NFKD", chr(point).lower())[0]
        base = {"ß": "s", "æ": "a", "ø": "o", "ð": "d", "þ": "t"}.get(base, base)
        if "a" <= base <= "z":
            table[0x80 | (point & 0x3F)] = ord(base)
    return table


_FOLD = _second_bytes()
_LETTER = np.zeros(256, np.uint8)
_LETTER[0x61:0x7B] = np.arange(1, 27)
_DISGUISE = np.zeros(256, bool)
_DISGUISE[[ord(c) for c in "".join(LOOK_ALIKES) + DIVIDERS]] = True


def fold(part: texts.Slice) -> texts.Slice:
    """Lower case without accents, on bytes."""
    data = part.data.copy()
    upper = (data >= 0x41) & (data <= 0x5A)
    data[upper] += 0x20
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[_FOLD[data[lead + 1]] > 0]
    data[lead + 1] = _FOLD[data[lead + 1]]
    keep = np.ones(len(data), bool)
    keep[lead] = False
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    return texts.Slice(data[keep], before[part.offsets], part.first)


def _ngram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS ** 4, np.int64)
    for batch in batches:
        for part in texts.slices(batch.column(0)):
            part = fold(part)
            starts, ends, _ = part.words()
            codes = np.where(_LETTER[part.data] > 0, _LETTER[part.data], 27).astype(np.int64)
            # Words laid out with three borders before each and one behind the last.
            lengths = ends - starts
            at = np.cumsum(lengths + 3) - lengths
            line = np.zeros(int(lengths.sum()) + 3 * len(lengths) + 3, np.int64)
            inside = np.repeat(at - starts, lengths) + _spans(starts, lengths)
            line[inside] = codes[_spans(starts, lengths)]
            grams = ((line[:-3] * SYMBOLS + line[1:-2]) * SYMBOLS + line[2:-1]) * SYMBOLS + line[3:]
            total += np.bincount(grams, minlength=len(total))
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["gram", "n"])


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the spans, one after the other."""
    return np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def language_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log-probabilities of a character after three others, from the counts of all documents. Each order backs off
    to the next lower one with weight 2."""
    rows = docs.select(F.col(text)).mapInArrow(_ngram_counts, "gram int, n long").groupBy("gram").agg(
        F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SYMBOLS ** 4)
    counts[rows["gram"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    counts = counts.reshape((SYMBOLS,) * 4)
    model = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(1, 5):
        level = counts.sum(axis=tuple(range(4 - order)))
        model = (level + 2 * model) / (level.sum(-1, keepdims=True) + 2)
    return np.log(model).astype(np.float32)


class Restorer:
    """Viterbi search for what a disguised token stands for."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.wide = _WideLattice(model)
        self.known: dict[tuple[str, bool], str] = {}

    def restore(self, token: str, apart: bool = False) -> str:
        """The best reading of a token in lower case without accents; digits that stand for nothing are kept. Letters
        that were ``apart`` may be several words."""
        found = self.known.get((token, apart))
        if found is None:
            found = self.wide.search(token, apart) if token.count(WILD) > 1 else self._search(token, apart)
            if len(token) > KNOWN_LENGTH:
                return found
            if len(self.known) >= 200_000:
                self.known.clear()
            self.known[token, apart] = found
        return found

    def _search(self, token: str, apart: bool) -> str:
        """All states of the lattice are kept; a state links to the one before it, so that time is linear in length."""
        model = self.model
        layers: list[dict] = [{} for _ in range(len(token) + 1)]
        layers[0] = {(0, 0, 0): (0.0, None)}
        runs = _runs(token)
        for i, char in enumerate(token):
            if not layers[i]:
                continue
            if apart and i:
                (a, b, c), (spent, said) = min(layers[i].items(), key=lambda item: (
                    item[1][0] - model[item[0][0]][item[0][1]][item[0][2]][0], item[0]))
                total = spent - model[a][b][c][0] + COST_SPACE
                if (a, b, c) != (0, 0, 0):
                    layers[i][0, 0, 0] = min(layers[i].get((0, 0, 0), (math.inf, None)), (total, (said, " ")),
                                             key=lambda state: state[0])
            run = runs[i]
            options = _steps(char, run)
            for (a, b, c), (spent, said) in layers[i].items():
                for letters, cost, used in options:
                    x, y, z, total = a, b, c, spent + cost
                    for letter in letters:
                        code = ord(letter) - 96 if "a" <= letter <= "z" else 27
                        if code != 27:
                            total -= model[x][y][z][code]
                        x, y, z = y, z, code
                    target = layers[i + used]
                    if (x, y, z) not in target or total < target[x, y, z][0]:
                        target[x, y, z] = (total, (said, letters) if letters else said)
            layers[i] = {}
        (_, _, _), (_, said) = min(layers[-1].items(), key=lambda item: (
            item[1][0] - model[item[0][0]][item[0][1]][item[0][2]][0], item[0]))
        pieces = []
        while said:
            said, letters = said
            pieces.append(letters)
        return "".join(reversed(pieces))


def _runs(token: str) -> list[int]:
    """For each character, how often it follows itself from there on."""
    runs = [1] * len(token)
    for i in range(len(token) - 2, -1, -1):
        if token[i] == token[i + 1]:
            runs[i] = runs[i + 1] + 1
    return runs


def _options(char: str) -> list[tuple[str, float]]:
    """What a character may stand for, and the costs."""
    if "a" <= char <= "z":
        return [(char, 0.0)]
    options = [(letter, COST_LOOK_ALIKE) for letter in LOOK_ALIKES.get(char, "")]
    if char in DIVIDERS:
        options.append(("", COST_DIVIDER))
    if char == WILD:
        options += [(chr(97 + k), COST_WILD) for k in range(26)]
    return [*options, (char, COST_KEPT)]


def _steps(char: str, run: int) -> list[tuple[str, float, int]]:
    """Letters, cost and number of characters of each step from the first of ``run`` equal characters."""
    steps = [(letters, cost, 1) for letters, cost in _options(char)]
    if run > 1 and char not in DIVIDERS:
        steps += [(letters * times, cost + COST_REPEAT, run) for letters, cost in _options(char)
                  for times in ((1, 2) if run > 2 else (1,)) if letters]
    return steps


class _WideLattice:
    """The same search for tokens with several wildcards, a layer of states at a time in arrays.

    A row of wildcards is cut to ``longest``: a letter read from a wildcard costs at least 1.7 more than reading
    nothing, and only the last three letters count for what follows. Reading more than ``longest - 1`` letters thus
    costs more than the last three of them alone, whatever stands before; the wildcards left over are read as nothing.
    """

    def __init__(self, model: np.ndarray):
        self.cost = -model.reshape(SYMBOLS ** 3, SYMBOLS).astype(float)
        self.longest = 4 + int(3 * self.cost.max() / (COST_WILD - COST_DIVIDER))
        self.row = re.compile(re.escape(WILD) + "{%d,}" % (self.longest + 1))

    def search(self, token: str, apart: bool) -> str:
        return self._best(self.row.sub(WILD * self.longest, token), apart)

    def _best(self, token: str, apart: bool) -> str:
        # A layer: its states in order, their costs, and for each the layer, state and letters it comes from.
        runs, said, kept, bound = _runs(token), "", 0, KEPT_BYTES
        states, spent = np.zeros(1, np.int64), np.zeros(1)
        layers, ahead = {0: (states, None, None, None, None)}, []
        for i, char in enumerate(token):
            if i and runs[i - 1] == 1 and kept > bound:
                said, layers = self._settle(layers, i, said)
                kept = sum(_size(layer) for layer in layers.values())
                bound = max(KEPT_BYTES, 2 * kept)
            spaced = False
            if apart and i:
                ends = spent + self.cost[states, 0]
                best = int(np.argmin(ends))
                total = ends[best] + COST_SPACE
                zero = states[0] == 0
                if states[best] != 0 and not (zero and spent[0] <= total):
                    spaced, source = True, int(states[best])
                    if zero:
                        spent = spent.copy()
                        spent[0] = total
                    else:
                        states, spent = np.append(0, states), np.append(total, spent)
            here, moved = [], []
            steps = _steps(char, runs[i])
            if char == WILD and len(states) > SYMBOLS ** 2:
                here = self._any_letter(states, spent, i)
                steps = [step for step in steps if step[1] != COST_WILD]
            for letters, cost, used in steps:
                new, total = states, spent + cost
                for letter in letters:
                    code = ord(letter) - 96 if "a" <= letter <= "z" else 27
                    if code != 27:
                        total = total + self.cost[new, code]
                    new = new % SYMBOLS ** 2 * SYMBOLS + code
                (here if used == 1 else moved).append((new, total, i, states, letters))
            if spaced:
                # The state behind a space is one of this layer; its link leads to the state before the space.
                layers[i] = (*layers[i], source)
            ahead += moved
            if runs[i] == 1:
                here, ahead = here + ahead, []
            layers[i + 1], spent = _merge(here)
            states = layers[i + 1][0]
            kept += _size(layers[i + 1])
        last = int(states[np.argmin(spent + self.cost[states, 0])])
        return said + _read(layers, len(token), last)

    def _any_letter(self, states: np.ndarray, spent: np.ndarray, i: int) -> list:
        """The steps of a wildcard's letters: of the states that differ in their first letter only the best goes on."""
        full = np.full(SYMBOLS ** 3, np.inf)
        full[states] = spent + COST_WILD
        table = (full[:, None] + self.cost).reshape(SYMBOLS, SYMBOLS ** 2, SYMBOLS)
        first = table.argmin(0)
        total = np.take_along_axis(table, first[None], 0)[0]
        found = []
        for code in range(1, 27):
            ends = np.flatnonzero(total[:, code] < np.inf)
            found.append((ends * SYMBOLS + code, total[ends, code], i, first[ends, code] * SYMBOLS ** 2 + ends,
                          chr(96 + code)))
        return found

    @staticmethod
    def _settle(layers: dict, at: int, said: str) -> tuple[str, dict]:
        """If all states of layer ``at`` come from one state of an earlier layer, what is read up to there and the
        layers from there on."""
        first = min(layers)
        where, states = np.full(len(layers[at][0]), at), layers[at][0].copy()
        for layer in range(at, first, -1):
            if (where == layer).all() and (states == states[0]).all():
                found = int(states[0])
                said += _read(layers, layer, found)
                rest = {k: v for k, v in layers.items() if k > layer}
                rest[layer] = (np.array([found]), None, None, None, None)
                return said, rest
            here = np.flatnonzero(where == layer)
            if not len(here):
                continue
            now = states[here]
            if len(layers[layer]) > 5:
                now = np.where(now == 0, layers[layer][5], now)
            place = np.searchsorted(layers[layer][0], now)
            where[here], states[here] = layers[layer][1][place], layers[layer][2][place]
        return said, layers


def _merge(steps: list) -> tuple[tuple, np.ndarray]:
    """The cheapest step into each state, as a layer, and its costs."""
    into = np.concatenate([step[0] for step in steps])
    total = np.concatenate([step[1] for step in steps])
    best = np.full(SYMBOLS ** 3, np.inf)
    np.minimum.at(best, into, total)
    states = np.flatnonzero(best < np.inf)
    at = np.flatnonzero(total == best[into])[::-1]
    chosen = np.zeros(SYMBOLS ** 3, np.int64)
    chosen[into[at]] = at
    chosen = chosen[states]
    sizes = [len(step[0]) for step in steps]
    number = np.searchsorted(np.cumsum(sizes), chosen, side="right")
    source = np.concatenate([step[3] for step in steps])[chosen]
    layer = np.array([step[2] for step in steps], np.int32)[number]
    words = [step[4] for step in steps]
    return (states.astype(np.int16), layer, source.astype(np.int16), number.astype(np.int16), words), best[states]


def _size(layer: tuple) -> int:
    return 0 if layer[1] is None else 10 * len(layer[0]) + 500


def _read(layers: dict, at: int, state: int) -> str:
    """The letters on the way to a state, back to the first layer that is kept."""
    pieces = []
    while True:
        states, before, source, number, words, *space = layers[at]
        if space and state == 0:
            pieces.append(" ")
            state = space[0]
        if before is None:
            break
        place = int(np.searchsorted(states, state))
        pieces.append(words[number[place]])
        at, state = int(before[place]), int(source[place])
    return "".join(reversed(pieces))


def _suspicious(part: texts.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (first byte, end, whether spaced letters) of what may be disguised in folded texts."""
    data = part.data
    starts, ends, bounds = part.words()
    if not len(starts):
        return starts, ends, np.zeros(0, bool)
    letter, disguise = _LETTER[data] > 0, _DISGUISE[data]
    triple = np.zeros(len(data), bool)
    triple[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & letter[2:]

    def has(flags):
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(flags, out=sums[1:])
        return sums[ends] > sums[starts]

    mixed = np.zeros(len(data), bool)
    mixed[1:-1] = disguise[1:-1] & (letter[2:] | disguise[2:])
    first = np.zeros(len(data), bool)
    first[:-1] = disguise[:-1] & letter[1:]
    foreign, styled = _other_forms(data)
    token = (has(letter) & (has(mixed & ~_is_start(starts, len(data))) | has(first) | has(foreign))) | has(
        triple) | has(styled)
    single = ((ends - starts) == 1) & (letter[starts] | disguise[starts])
    letters = np.zeros(len(data) + 1, np.int32)
    np.cumsum(letter | disguise, out=letters[1:])
    # The last of some letters apart may have punctuation behind it.
    last = single | (((ends - starts) <= 4) & letter[starts] & (letters[np.minimum(starts + 1, ends)] - letters[starts] == 1)
                     & ~letter[np.minimum(starts + 1, len(data) - 1)])
    owner = np.repeat(np.arange(part.size), np.diff(bounds))
    joined = np.zeros(len(starts) + 1, bool)
    joined[1:-1] = last[1:] & single[:-1] & (owner[1:] == owner[:-1]) & (starts[1:] - ends[:-1] == 1)
    heads = np.flatnonzero(last & ~joined[:-1])
    tails = np.flatnonzero(last & ~joined[1:])
    long = tails - heads >= 2
    heads, tails = heads[long], tails[long]
    covered = np.zeros(len(starts) + 1, np.int32)
    np.add.at(covered, heads, 1)
    np.add.at(covered, tails + 1, -1)
    plain = np.flatnonzero(token & ~single & (np.cumsum(covered)[:-1] == 0))
    low = np.concatenate([starts[plain], starts[heads]])
    high = np.concatenate([ends[plain], ends[tails]])
    spaced = np.concatenate([np.zeros(len(plain), bool), np.ones(len(heads), bool)])
    order = np.argsort(low, kind="stable")
    return low[order], high[order], spaced[order]


def _other_forms(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where bytes begin Greek, Cyrillic, a mark on a letter or a character without width, and where letters of full
    width, in circles or of mathematical styles."""
    foreign, styled = (data >= 0xCC) & (data <= 0xD4), np.zeros(len(data), bool)
    if not (data >= 0xE2).any() and not (data == 0xC2).any():
        return foreign, styled
    second, third = np.append(data[1:], 0), np.append(data[2:], [0, 0])[: len(data)]
    foreign |= (data == 0xC2) & (second == 0xAD)
    foreign |= (data == 0xE2) & (second == 0x80) & (third >= 0x8B) & (third <= 0x8F)
    foreign |= (data == 0xE2) & (second == 0x81) & (third == 0xA0)
    foreign |= (data == 0xEF) & (second == 0xBB) & (third == 0xBF)
    styled |= (data == 0xEF) & (((second == 0xBC) & (third >= 0xA1) & (third <= 0xBA))
                                | ((second == 0xBD) & (third >= 0x81) & (third <= 0x9A)))
    styled |= (data == 0xE2) & ((second == 0x92) | (second == 0x93)) | (data == 0xF0) & (second == 0x9D)
    return foreign, styled


def _latin(token: str) -> str:
    """A token with letters of other forms as plain ones."""
    if token.isascii():
        return token
    plain = "".join(c for c in unicodedata.normalize("NFKD", token.translate(PLAIN)).lower()
                    if unicodedata.category(c) not in ("Mn", "Cf"))
    return plain.translate(_SCRIPTS) if any("a" <= c <= "z" for c in plain) else token


def _is_start(starts: np.ndarray, size: int) -> np.ndarray:
    flags = np.zeros(size, bool)
    flags[starts] = True
    return flags


_TRIPLE = re.compile(r"(.)\1\1", re.DOTALL)
_EDGE = ".,;:?\"'()[]{}&%#*|<>~^=/\\_-!"


def _core(token: str) -> tuple[str, str, str]:
    """Punctuation before and after a token, and what is between; ``!`` and ``$`` go with the end only in a row."""
    core = token.rstrip(_EDGE)
    while core.endswith("$$"):
        core = core.rstrip("$").rstrip(_EDGE)
    tail = token[len(core):]
    start = core.lstrip(_EDGE)
    return core[: len(core) - len(start)], start, tail


def restored(part: texts.Slice, restorer: Restorer) -> texts.Slice:
    """The folded texts of a slice with disguised tokens replaced by their best readings."""
    part = fold(part)
    low, high, spaced = _suspicious(part)
    raw = part.data.tobytes()
    pieces, at, grown, where = [], 0, [], []
    for a, b, apart in zip(low.tolist(), high.tolist(), spaced.tolist(), strict=True):
        found = raw[a:b].decode(errors="replace")
        token = _latin(found)
        head, core, tail = _core(token.replace(" ", ""))
        if core.isalpha() and not apart and not _TRIPLE.search(core):
            if token == found:
                continue
            new = token.encode()
        else:
            new = (head + (core if core.isdigit() else restorer.restore(core, apart)) + tail).encode()
        pieces += [raw[at:a], new]
        at = b
        where.append(a)
        grown.append(len(new) - (b - a))
    if not where:
        return part
    data = np.frombuffer(b"".join([*pieces, raw[at:]]), np.uint8)
    shift = np.concatenate([[0], np.cumsum(grown)])
    return texts.Slice(data, part.offsets + shift[np.searchsorted(where, part.offsets)], part.first)


_WORD = np.ones(256, bool)
_WORD[0x61:0x7B] = False


def _features(part: texts.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and word beginnings of restored texts, and the text of each."""
    starts, ends, bounds = part.words(_WORD[part.data])
    hashes = texts.prefix_hashes(part.data)
    owner = np.repeat(np.arange(part.size), np.diff(bounds))
    keys, owners = [texts.span_hashes(hashes, starts, ends)], [owner]
    for size in PREFIXES:
        long = np.flatnonzero(ends - starts > size)
        keys.append(texts.mix(texts.span_hashes(hashes, starts[long], starts[long] + size) + np.uint64(size)))
        owners.append(owner[long])
    return (np.concatenate(keys) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64), np.concatenate(owners)


def held_out(key: str) -> Column:
    """Whether a row is kept from learning; a NULL key is."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % HOLDOUT == 0


def _fit(table: pa.Table, max_features: int) -> pa.Table:
    """Weights of the selected features; bucket -1 has the intercept."""
    label = np.array(table["toxic"].to_pylist(), float)
    lists = table["features"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(label)), sizes)
    n, n1 = len(label), label.sum()
    have = np.bincount(values, minlength=1 << FEATURE_BITS).astype(float)
    have1 = np.bincount(values, label[owner], 1 << FEATURE_BITS)
    expected = have * n1 / max(n, 1)
    spread = np.maximum(expected * (1 - have / max(n, 1)) * (1 - n1 / max(n, 1)), 1e-9)
    score = np.where((have >= 3) & (have1 > expected), (have1 - expected) ** 2 / spread, 0)
    chosen = np.argsort(-score, kind="stable")[:max_features]
    chosen = np.sort(chosen[score[chosen] > 4])
    place = np.full(1 << FEATURE_BITS, -1)
    place[chosen] = np.arange(len(chosen))
    use = place[values] >= 0
    rows, columns = owner[use], place[values[use]]
    weights, bias = np.zeros(len(chosen)), math.log((n1 + 1) / (n - n1 + 2))
    moment, ahead = np.zeros(len(chosen) + 1), np.append(weights, bias)
    point = ahead.copy()
    if n:
        step = 4.0 / max(1.0, np.bincount(rows, minlength=n).max(initial=1))
        for turn in range(1, 2001):
            margin = np.bincount(rows, point[columns], n) + point[-1]
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label)
            slope = np.append(np.bincount(columns, error[rows], len(chosen)), error.sum()) / n
            slope[:-1] += 1e-5 * point[:-1]
            new = point - step * 4 * slope
            new[:-1] = np.maximum(new[:-1], 0)
            point = new + (turn - 1) / (turn + 2) * (new - moment) if turn > 1 else new
            moment = new
        point = moment
    return pa.table({"bucket": pa.array(np.append(chosen, -1)), "weight": pa.array(point)})


def train(
    docs: DataFrame, labels: DataFrame, model: np.ndarray, *, key: str = "doc_id", text: str = "text",
    label: str = "toxic", max_training_rows: int = MAX_TRAINING_ROWS, max_features: int = MAX_FEATURES,
) -> tuple[np.ndarray, float]:
    """Weights by feature bucket and the intercept, from labelled rows that are not held out. A key with several
    labels counts as toxic if one says so; NULL keys and labels are left out."""
    spark = docs.sparkSession
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).groupBy(key).agg(
        F.max(label).cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64(F.col(key)), key).limit(max_training_rows)
    rows = docs.select(F.col(key), F.col(text).alias("_text")).join(F.broadcast(chosen), key).select(
        "_text", "toxic")
    sent = spark.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(sent.value)
        for batch in batches:
            toxic = batch.column(1)
            for part in texts.slices(batch.column(0)):
                buckets, owner = _features(restored(part, restorer))
                pairs = np.unique((owner << FEATURE_BITS) | buckets)
                bounds = np.searchsorted(pairs >> FEATURE_BITS, np.arange(part.size + 1))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()),
                                                 pa.array((pairs & ((1 << FEATURE_BITS) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([toxic.slice(part.first, part.size), lists],
                                                 names=["toxic", "features"])

    fitted = rows.mapInArrow(features, "toxic int, features array<int>").groupBy(F.lit(0).alias("_all")).applyInArrow(
        lambda t: _fit(t.sort_by("toxic"), max_features), "bucket long, weight double").toPandas()
    weights, bias = np.zeros(1 << FEATURE_BITS), math.log(1 / 2)
    for bucket, weight in zip(fitted["bucket"], fitted["weight"], strict=True):
        if bucket < 0:
            bias = weight
        else:
            weights[bucket] = weight
    return weights, bias


def score(
    docs: DataFrame, model: np.ndarray, scorer: tuple[np.ndarray, float], *, text: str = "text",
    keep: list[str] | None = None, with_text: bool = False,
) -> DataFrame:
    """Columns ``keep``, ``score`` (0 to 1) and, if asked for, ``restored``: the text in lower case without accents,
    with disguised tokens replaced. Empty and NULL texts get the score of the intercept. Rows are worked on one by
    one; input columns of these names are replaced; an empty table gives no rows."""
    spark = docs.sparkSession
    keep = [name for name in keep or [] if name not in ("score", "restored")]
    sent = spark.sparkContext.broadcast((model, *scorer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, weights, bias = sent.value
        restorer = texts.worker_cache(f"restorer_{hash(table.tobytes())}", lambda: Restorer(table))
        for batch in batches:
            for part in texts.slices(batch.column(0)):
                clear = restored(part, restorer)
                buckets, owner = _features(clear)
                hit = weights[buckets] != 0
                pairs = np.unique((owner[hit] << FEATURE_BITS) | buckets[hit])
                margin = bias + np.bincount(pairs >> FEATURE_BITS, weights[pairs & ((1 << FEATURE_BITS) - 1)],
                                            part.size)
                columns = [batch.column(i).slice(part.first, part.size) for i in range(1, batch.num_columns)]
                names = [*batch.schema.names[1:], "score"]
                columns.append(pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30)))))
                if with_text:
                    raw, bounds = clear.data.tobytes(), clear.offsets.tolist()
                    columns.append(pa.array([raw[a:b].decode("utf-8", "replace")
                                             for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string()))
                    names.append("restored")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = [f"`{name}` {docs.schema[name].dataType.simpleString()}" for name in keep]
    return docs.select(F.col(text).alias("_text"), *keep).mapInArrow(
        run, ", ".join([*fields, "score double", *["restored string"] * with_text]))
