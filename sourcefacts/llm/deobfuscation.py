"""Noisy-channel restoration of disguised words.

A disguised word is a lattice: each place has the letters it may stand for,
with the cost of writing them that way. The cheapest path under a character
language model of the corpus is its restored reading.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: What the usual signs for letters can stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
#: Signs that only stand between letters.
JOINERS = "._-*~^'’`,;:/\\#%&=​‌‍­"
#: Costs in nats of writing a letter as a sign, of a sign put between letters, of a repeated
#: letter, of a word end where a separator is read, and of a separator that means nothing.
SIGN_COST, NOISE_COST, REPEAT_COST, BREAK_COST, JOIN_COST = 1.0, 1.5, 0.5, 2.0, 0.2
#: Longer tokens with signs are read in pieces of so many characters.
MAX_PLACES = 40
#: Readings that a restorer remembers; a full memory is emptied.
KNOWN_PIECES = 100_000

#: Letter codes: 0 is the edge of a word, a-z, then à-ÿ, then any other letter.
CODES = 60
_EDGE_MARKS = ".,;:!?\"'()[]{}…«»“”„‘’*#%&$~^_-=+<>|/\\"
_DOUBLE = re.compile(r"(.)\1")
_SIGN_RUN = re.compile(r"([^\w\s])\1\1+")
_URL = re.compile(r"(?:https?|ftp)://\S+")
_JOINED = re.compile(f"[{re.escape(JOINERS)}]+")
_SINGLE = r"[^\W_]|[@$!|+(<€£¡]"
_SPACED = re.compile(rf"(?<!\S)(?:(?:{_SINGLE})[ .\-_*]{{1,3}}){{2,}}(?:{_SINGLE})(?![^\s.,;:!?])")

#: Where no three single signs stand apart like this, nothing is spaced.
_MAYBE_SPACED = re.compile(rf"\s(?:{_SINGLE})[ .\-_*]{{1,3}}(?:{_SINGLE})[ .\-_*]{{1,3}}(?:{_SINGLE})")
_BEYOND_LATIN = re.compile("[^\x00-ɏ]")


@cache
def code_of(letter: str) -> int:
    o = ord(letter)
    return o - 96 if 97 <= o <= 122 else o - 0xE0 + 27 if 0xE0 <= o <= 0xFF and o != 0xF7 else CODES - 1


def _code_table() -> np.ndarray:
    table = np.zeros(0x110000, dtype=np.uint8)
    for o in range(0x110000):
        if chr(o).isalpha():
            table[o] = code_of.__wrapped__(chr(o))  # not remembered: so many letters
    return table


_TABLE: list[np.ndarray] = []


def trigram_counts(texts: Iterator[str]) -> np.ndarray:
    """Counts of letter triples of lower-cased words, edges included."""
    if not _TABLE:
        _TABLE.append(_code_table())
    total = np.zeros(CODES**3, dtype=np.int64)
    held, size = [], 0

    def add() -> None:
        points = np.frombuffer("\n\n".join(["", *held, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        codes = _TABLE[0][points]
        keep = np.ones(len(codes), dtype=bool)
        keep[2:] = (codes[2:] > 0) | (codes[1:-1] > 0) | (codes[:-2] > 0)
        codes = codes[keep].astype(np.int32)
        total[:] += np.bincount(codes[:-2] * CODES**2 + codes[1:-1] * CODES + codes[2:], minlength=CODES**3)

    for text in texts:
        held.append(text.lower())
        size += len(text)
        if size > 2_000_000:
            add()
            held, size = [], 0
    if held:
        add()
    return total


class LetterModel:
    """Trigram letter model; costs in nats."""

    def __init__(self, counts: np.ndarray):
        # two edges stand before a word: (edge, edge, a) is read off (edge, a) by summing
        tri = counts.reshape(CODES, CODES, CODES).astype(np.float64)
        first = tri.sum(axis=2)  # pairs
        tri[0, 0, :] = first[0, :]
        one = tri.sum(axis=(0, 1)) + 0.5
        one /= one.sum()
        pairs = tri.sum(axis=0)
        two = (pairs + 4 * one[None, :]) / (pairs.sum(axis=1, keepdims=True) + 4)
        three = (tri + 4 * two[None, :, :]) / (tri.sum(axis=2, keepdims=True) + 4)
        self.cost = -np.log(three)
        #: costs by the two letters before and the letter
        self.rows = self.cost.tolist()


def letter_model(docs: DataFrame, text_col: str = "text") -> LetterModel:
    """The model of all texts of the table. Each task sends one row for each
    triple it saw, at most ``CODES ** 3``; so many numbers are all that is kept."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CODES**3, dtype=np.int64)
        for batch in batches:
            total += trigram_counts(t for t in batch.column("text").to_pylist() if t)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["triple", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "triple int, n long").groupBy("triple").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(CODES**3, dtype=np.int64)
    for r in rows:
        counts[r["triple"]] = r["n"]
    return LetterModel(counts)


#: A place of a lattice: readings as (letters, cost); " " is the end of a word.
Place = list[tuple[str, float]]


def lattice(token: str, spaced: bool = False) -> list[Place]:
    """The places of a lower-cased token and their readings."""
    places: list[Place] = []
    i = 0
    while i < len(token):
        c = token[i]
        j = i
        while j < len(token) and token[j] == c:
            j += 1
        run = j - i
        if c.isalpha():
            places.append([(c, 0.0 if run == 1 else REPEAT_COST), *([(c * 2, 0.0 if run == 2 else REPEAT_COST)] if run > 1 else [])])
        elif c in LEET:
            readings = [(x, SIGN_COST) for x in LEET[c]]
            if run > 1:
                readings += [(x * 2, SIGN_COST) for x in LEET[c]]
            if not c.isdigit():
                readings.append(("", NOISE_COST * run))
            places.append(readings)
        elif spaced and (c == " " or c in JOINERS):
            places.append([("", JOIN_COST), (" ", BREAK_COST)])
        else:
            places.append([("", NOISE_COST), (" ", NOISE_COST)])
        i = j
    return places


def token_lattice(token: str) -> list[Place]:
    """The lattice of a token; where there is no letter, no sign means nothing."""
    places = lattice(token)
    return places if any(map(str.isalpha, token)) else [[r for r in place if r[0].strip()] or place for place in places]


def decode(places: list[Place], model: LetterModel) -> str:
    """The cheapest reading of a lattice (Viterbi over the last two letters)."""
    rows = model.rows
    best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    at = 0
    while at < len(places):
        if len(best) == 1:
            # one state, and places of one letter, as most are: the same sums without a table
            (((a, b), (cost, out)),) = best.items()
            while at < len(places) and len(place := places[at]) == 1 and len(place[0][0]) == 1 and place[0][0] != " ":
                letter, extra = place[0]
                c = code_of(letter)
                cost += extra
                cost += rows[a][b][c]
                a, b, out, at = b, c, out + letter, at + 1
            best = {(a, b): (cost, out)}
            if at == len(places):
                break
        place = places[at]
        at += 1
        readings = [(letters, extra, [0 if x == " " else code_of(x) for x in letters]) for letters, extra in place]
        nxt: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (cost, out) in best.items():
            for letters, extra, codes in readings:
                x, y, total = a, b, cost + extra
                for c in codes:
                    if c:
                        total += rows[x][y][c]
                        x, y = y, c
                    else:
                        total += rows[x][y][0] if y else 0.0
                        x = y = 0
                known = nxt.get((x, y))
                if known is None or total < known[0]:
                    nxt[x, y] = (total, out + letters)
        best = nxt
    ends = [(cost + (rows[a][b][0] if b else 0.0), out) for (a, b), (cost, out) in best.items()]
    return min(ends)[1] if ends else ""


def _bare(token: str) -> str:
    """The token without runs of signs and marks at its ends."""
    return _SIGN_RUN.sub("", token).strip(_EDGE_MARKS)


def is_disguised(token: str) -> bool:
    """Signs among letters or alone, or a letter repeated; numbers and whole URLs are not."""
    if token.isalpha():
        return bool(_DOUBLE.search(token))
    letters = sum(map(str.isalpha, token))
    signs = sum(map(LEET.__contains__, token))
    worded = letters >= 1 or any(c in LEET and not c.isdigit() for c in token)
    return worded and letters + signs >= 3 and not _URL.fullmatch(token)


def pieces(token: str) -> list[str]:
    """A token in lattices of bounded size: what stands between joiners, and overlapping parts of the whole."""
    if token.isalpha() or len(token) <= MAX_PLACES:
        return [token]
    half = MAX_PLACES // 2
    windows = lambda t: [t[i : i + MAX_PLACES] for i in range(0, max(len(t) - half, 1), half)]
    parts = [w for part in _JOINED.split(token) if part for w in windows(part)]
    return [w for w in dict.fromkeys([*parts, *windows(token)]) if is_disguised(w)]


class Restorer:
    """Restores words; readings of short pieces are remembered, whole tokens by the caller."""

    def __init__(self, model: LetterModel):
        self.model = model
        self._known: dict[str, list[str]] = {}

    def words(self, token: str) -> list[str]:
        """Words of one lower-cased token without white space."""
        if token.isalpha():
            return [token, *self._read(token)] if is_disguised(token) else [token]
        edge_signs = token if any(c in "$@+!|(<" for c in token[:1] + token[-1:]) else ""
        bare = _bare(token)
        out = [w for w in re.split(r"[^\w]+|_", bare) if w] if not bare.isalpha() else [bare]
        for shape in {bare, _SIGN_RUN.sub("", edge_signs).strip(".,;:?\"'")}:
            if shape and is_disguised(shape):
                out += [w for piece in pieces(shape) for w in self._read(piece)]
        return out

    def _read(self, piece: str) -> list[str]:
        read = self._known.get(piece)
        if read is None:
            read = [w for w in decode(token_lattice(piece), self.model).split(" ") if w]
            if len(piece) <= MAX_PLACES:
                if len(self._known) >= KNOWN_PIECES:
                    self._known.clear()
                self._known[piece] = read
        return read

    def spaced_words(self, text: str) -> list[str]:
        """Words written letter by letter in a lower-cased text."""
        out = []
        if not _MAYBE_SPACED.search(f" {text}"):
            return out
        size = 4 * MAX_PLACES
        for m in _SPACED.finditer(text):
            shape = m.group()
            # a long run is read in lattices of bounded size that overlap by half, so that a
            # word of up to ``2 * MAX_PLACES`` characters is whole in one of them
            for i in range(0, max(len(shape) - size // 2, 1), size // 2):
                places = lattice(shape[i : i + size], spaced=True)
                joined = [[r for r in place if r[0] != " "] for place in places]
                out += [w for reading in (places, joined) for w in decode(reading, self.model).split(" ") if len(w) > 2]
        return out

    def restore(self, text: str) -> str:
        """The text with every disguised word restored, lower-cased."""
        low = prepared(text)
        low = _SPACED.sub(lambda m: decode(lattice(m.group(), spaced=True), self.model), low)
        return re.sub(r"\S+", lambda m: self._whole(_bare(m.group())) if is_disguised(_bare(m.group())) else m.group(), low)

    def _whole(self, token: str) -> str:
        size = len(token) if token.isalpha() else MAX_PLACES
        return "".join(decode(token_lattice(token[i : i + size]), self.model) for i in range(0, len(token), size))


def prepared(text: str) -> str:
    """Lower case; compatibility letters (full width, styled) become plain ones."""
    if not text.isascii() and _BEYOND_LATIN.search(text):
        text = unicodedata.normalize("NFKC", text)
    return text.lower()
