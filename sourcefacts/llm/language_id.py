"""Language identification by cross-parsing.

Labelled text of each language becomes a suffix automaton. A text is parsed
against it greedily: each phrase is the longest match that begins where the
last ended. The language with the fewest phrases for the length of the text
wins. All texts of a batch walk all automata side by side, one letter at a
time, so that the work is array look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

#: Letters of labelled text in one automaton; the bound of the fitted sample.
SAMPLE_LETTERS = 24_000
#: At most this many labelled documents of a language, and a window of so many characters of each.
SAMPLE_DOCS = 96
SAMPLE_DOC_CHARS = 6_000
#: Columns of the table of moves: the most frequent letters and one for letters no
#: sample shows. Every other letter has its moves in a sorted list.
ALPHABET = 96
UNKNOWN = "und"
#: Letters that walk at once; bounds the memory of a batch.
BATCH_LETTERS = 1 << 22

_RESTART = np.int32(1 << 30)
_STATE = np.int32((1 << 30) - 1)
_CODE_SPACE = 0x110000


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased letters; a run of anything else is one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = np.where(_letter_table()[points], points, 32)
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    return out[keep]


_TABLES: dict[str, np.ndarray] = {}


def _letter_table() -> np.ndarray:
    """For every code point, whether it is a letter."""
    if "letters" not in _TABLES:
        _TABLES["letters"] = np.fromiter((chr(i).isalpha() for i in range(_CODE_SPACE)), dtype=bool, count=_CODE_SPACE)
    return _TABLES["letters"]


def suffix_automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """Moves (code to state) of every state of the automaton of all substrings; the start is state 1."""
    nxt: list[dict[int, int]] = [{}, {}]
    link, length = [0, 0], [0, 0]
    last = 1
    for c in codes.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(1)
        p = last
        while p and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


@dataclass
class CrossParser:
    """Automata of all languages in one table of moves, and a list for rarer letters.

    A move that the automaton lacks starts a new phrase at the letter: it
    leads where the start leads with that letter, and carries a flag that is
    added up. A letter the language never shows is a phrase by itself. Every
    letter of a sample has its own code; those from ``width`` on are looked up
    in the list, which grows with the samples and not with the letters.
    """

    languages: list[str]
    letters: np.ndarray  # code points told apart, those of the table first
    moves: np.ndarray  # flattened state by code
    starts: np.ndarray  # start state of each language
    width: int
    listed: np.ndarray  # state and code of the moves by rarer letters, as sorted numbers
    targets: np.ndarray  # where they lead
    restarts: np.ndarray  # language by rarer letter: where a new phrase begins

    @classmethod
    def fit(cls, samples: dict[str, list[str]], sample_letters: int = SAMPLE_LETTERS) -> CrossParser:
        texts = {k: np.concatenate([np.zeros(0, "<u4"), *[np.append(letters_of(t), 32) for t in v]])[:sample_letters] for k, v in sorted(samples.items())}
        known, n = np.unique(np.concatenate([np.zeros(0, "<u4"), *texts.values()]), return_counts=True)
        ranked = known[np.argsort(-n, kind="stable")]
        letters = np.concatenate([np.sort(ranked[: ALPHABET - 1]), np.sort(ranked[ALPHABET - 1 :])])
        width = min(len(letters), ALPHABET - 1) + 1
        span = len(letters) + 1
        tables, starts, rare, base = [], [], [np.zeros((0, 2), np.int64)], 0
        restarts = np.zeros((len(texts), span - width), dtype=np.int32)
        for k, text in enumerate(texts.values()):
            moves = suffix_automaton(_codes(text, letters, width))
            flat = np.array([(state, c, to) for state, row in enumerate(moves) for c, to in row.items()], dtype=np.int64).reshape(-1, 3)
            state, code, to = flat[flat[:, 1] < width].T
            table = np.zeros((len(moves), width), dtype=np.int32)
            table[state, code] = to
            first = table[1]
            tables.append(np.where(table > 0, table, np.where(first > 0, first, 1) | _RESTART) + base)
            state, code, to = flat[flat[:, 1] >= width].T
            rare.append(np.stack([(state + base) * span + code, to + base], axis=1))
            restarts[k] = (1 + base) | _RESTART
            restarts[k, code[state == 1] - width] = (to[state == 1] + base) | _RESTART
            starts.append(1 + base)
            base += len(table)
        moves = np.concatenate(tables) if tables else np.zeros((1, width), np.int32)
        pairs = np.concatenate(rare)
        pairs = pairs[np.argsort(pairs[:, 0])]
        return cls(list(texts), letters, np.ascontiguousarray(moves.ravel(), dtype=np.int32), np.array(starts, dtype=np.int32), width, pairs[:, 0].copy(), pairs[:, 1].astype(np.int32), restarts)

    def _by_list(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Moves by letters that the table has no column for."""
        key = state.astype(np.int64) * (len(self.letters) + 1) + code
        at = np.minimum(np.searchsorted(self.listed, key), len(self.listed) - 1)
        return np.where(self.listed[at] == key, self.targets[at], self.restarts[:, code - self.width])

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Number of phrases of each text (rows) in each language (columns)."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        sizes = np.array([len(texts[i]) for i in order])
        langs = len(self.starts)
        counts = np.zeros((langs, len(texts)), dtype=np.int64)
        if not len(texts) or not langs or not sizes[0]:
            return np.zeros((len(texts), langs), dtype=np.int64)
        flat = _codes(np.concatenate([texts[i] for i in order]), self.letters, self.width)
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        state = np.repeat(self.starts[:, None], len(texts), axis=1)
        alive = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
        width = np.int32(self.width)
        any_rare = bool((flat >= width).any())
        for step in range(int(sizes[0])):
            n = int(alive[step])
            code = flat[at[:n] + step]
            if any_rare and len(rare := np.flatnonzero(code >= width)):
                move = self.moves[state[:, :n] * width + np.minimum(code, width - 1)]
                move[:, rare] = self._by_list(state[:, rare], code[rare])
            else:
                move = self.moves[state[:, :n] * width + code]
            counts[:, :n] += move >> 30
            state[:, :n] = move & _STATE
        out = np.empty((len(texts), langs), dtype=np.int64)
        out[order] = counts.T + 1
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text.

        The score is the share of the winner when languages are weighed by
        two to the power of phrases saved for every 16 letters.
        """
        coded = [letters_of(t) if t else np.zeros(0, "<u4") for t in texts]
        real = [i for i, c in enumerate(coded) if (c != 32).any()]
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        for group in _groups(real, coded):
            rates = self.phrases([coded[i] for i in group]) / np.array([len(coded[i]) for i in group])[:, None]
            best = rates.argmin(axis=1)
            weights = np.exp2(-16 * (rates - rates.min(axis=1, keepdims=True)))
            for i, b, s in zip(group, best, 1 / weights.sum(axis=1), strict=True):
                names[i], scores[i] = self.languages[b], s
        return names, scores


def _codes(points: np.ndarray, letters: np.ndarray, width: int) -> np.ndarray:
    """Codes of code points: places among the known letters, past ``width - 1``, which is any other."""
    key = "codes" + letters.tobytes().hex()
    if key not in _TABLES:
        table = np.full(_CODE_SPACE, width - 1, dtype=np.int32)
        places = np.arange(len(letters))
        table[letters] = places + (places >= width - 1)
        _TABLES[key] = table
    return _TABLES[key][points]


def _groups(which: list[int], coded: list[np.ndarray]) -> Iterator[list[int]]:
    held, size = [], 0
    for i in which:
        held.append(i)
        size += len(coded[i])
        if size >= BATCH_LETTERS:
            yield held
            held, size = [], 0
    if held:
        yield held


def labelled_sample(docs: DataFrame, allowed: Column, per_language: int = SAMPLE_DOCS) -> dict[str, list[str]]:
    """A bounded sample of labelled texts of each language.

    Of the allowed rows with a label and a letter, those with the smallest
    hashes of their text, however long it is; of a long one a window of its
    letters, placed by the hash. Hashes are ranked first; only the chosen texts
    are read. Lists grow with the number of languages, not with the corpus.
    """
    rows = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    keyed = rows.select("lang", F.xxhash64("text").alias("h"), F.crc32(F.col("text").cast("binary")).alias("c")).distinct()
    # first inside shares of a language, so that a frequent one is ranked by many tasks
    shares = keyed.withColumn("s", F.pmod("h", F.lit(97))).withColumn("r", F.row_number().over(W.partitionBy("lang", "s").orderBy("h", "c"))).where(F.col("r") <= per_language)
    ranked = shares.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h", "c"))).where(F.col("r") <= per_language)
    chosen = {(r["lang"], r["h"], r["c"]) for r in ranked.select("lang", "h", "c").collect()}
    if not chosen:
        return {}
    letters = F.regexp_replace("text", r"[^\p{L}]+", " ")
    start = F.pmod(F.xxhash64("text"), F.greatest(F.length(letters) - SAMPLE_DOC_CHARS, F.lit(0)) + 1)
    window = F.substring(letters, (start + 1).cast("int"), F.lit(SAMPLE_DOC_CHARS)).alias("text")
    got = rows.where(F.xxhash64("text").isin(sorted({h for _, h, _ in chosen}))).select("lang", window, F.xxhash64("text").alias("h"), F.crc32(F.col("text").cast("binary")).alias("c")).dropDuplicates(["lang", "h", "c"]).collect()
    out: dict[str, list[tuple[int, str]]] = {}
    for r in got:
        if (r["lang"], r["h"], r["c"]) in chosen:
            out.setdefault(r["lang"], []).append((r["h"], r["text"]))
    return {lang: [t for _, t in sorted(v)] for lang, v in out.items()}


def identify(docs: DataFrame, parser: CrossParser, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text; ``und`` and 0 where there is no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def language_report(docs: DataFrame) -> DataFrame:
    """Learn from three folds of four and predict every document."""
    remainder = fold(F.col("doc_id"), 4)
    parser = CrossParser.fit(labelled_sample(docs, remainder != 2))
    return identify(docs, parser).select("doc_id", (remainder == 2).alias("held_out"), "lang_pred", "score")
