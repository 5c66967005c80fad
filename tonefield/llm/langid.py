"""Operator 6: language identification by segmentation-marginalised unigrams.

Every language has probabilities over the pieces of a fixed public vocabulary. A word's probability in a language is the sum
over all its segmentations into pieces, found by the forward algorithm; a text's is the product over its words
(letter runs, lower-cased). Piece probabilities come from expectation maximisation over the same lattices.

The fit reads a bounded sample of labelled rows (`train_docs` a language, by hashes of their ids);
prediction reads whole texts and nothing but the text. Words are scored once a worker and remembered.

Sums are formed in the log domain, so words of any length score by their own pieces: nothing is cut and no score has a floor.

Null texts and texts without a letter: `und`, score 0. Empty training data: every text is `und`; an empty table gives no rows. Repeated rows
keep a row each. Ties: of languages with equal totals the one that sorts first; the score then says so (one half for two). A null id is never
held out and never trains. Columns that are carried along (`keep`) never meet the operator's own names on the way.
"""

from __future__ import annotations

import functools
import itertools
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import public

WORDS = re.compile(r"[^\W\d_]+")
START = "▁"
UNKNOWN = 1e-9
MEMORY = 300_000
#: Characters that are worked on at once.
GROUP = 50_000
#: Longer words are scored in segments of so many characters and not remembered.
LONG = 2_000


@dataclass
class Model:
    languages: list[str]
    vocabulary: str
    probability: np.ndarray  # (pieces + 1, languages); the last row is for characters outside the vocabulary


class Pieces:
    """All pieces of a vocabulary, and where they lie in a string."""

    def __init__(self, name: str):
        import ahocorasick
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=public(name))
        kept = [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]
        self.row = {x: i for i, x in enumerate(sorted(set(kept)))}
        self.size = np.array([len(x) for x in self.row] + [1], np.int64)  # the last row is one character that has no piece
        self.longest = int(self.size.max())
        self.automaton = ahocorasick.Automaton()
        for x, i in self.row.items():
            if START not in x[1:]:  # words begin with the mark and hold no other
                self.automaton.add_word(x, i)
        self.automaton.make_automaton()

    def arcs(self, marked: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first character, character after the last, piece); a character that is no piece by itself is an arc of the last row."""
        found = np.fromiter(itertools.chain.from_iterable(self.automaton.iter(marked)), np.int64).reshape(-1, 2)
        end, piece = found[:, 0] + 1, found[:, 1]
        start = end - self.size[piece]
        alone = np.ones(len(marked), bool)
        alone[start[self.size[piece] == 1]] = False
        other = np.flatnonzero(alone)
        return np.append(start, other), np.append(end, other + 1), np.append(piece, np.full(len(other), len(self.row)))


@functools.lru_cache(maxsize=2)
def vocabulary_pieces(name: str) -> Pieces:
    return Pieces(name)


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def _by_place(place: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of arcs by (place, node), and where each place's run begins."""
    order = np.lexsort((node, place))
    return order, np.searchsorted(place[order], np.arange(int(place.max(initial=0)) + 2))


class Lattice:
    """All segmentations of some words. Nodes are the places between characters, one word after another; arcs are pieces."""

    def __init__(self, words: list[str], pieces: Pieces):
        size = np.array([len(w) + 1 for w in words], np.int64)
        begin = np.cumsum(size) - size  # in the joined string
        start, end, self.piece = pieces.arcs(START + START.join(words))
        self.word = np.repeat(np.arange(len(words)), size)[start]
        self.start, self.end = start + self.word, end + self.word  # a word has a node more than characters
        self.first, self.last = begin + np.arange(len(words)), begin + np.arange(len(words)) + size
        self.size = size
        self.ahead = _by_place(end - begin[self.word], self.end)
        self.back = _by_place(size[self.word] - (start - begin[self.word]), self.start)

    def sums(self, log_p: np.ndarray, forward: bool) -> np.ndarray:
        """(node, language): log of the summed probabilities of all ways from the word's first node, or to its last one."""
        (order, cuts), come, go, edge = (self.ahead, self.start, self.end, self.first) if forward else (self.back, self.end, self.start, self.last)
        out = np.zeros((int(self.last[-1]) + 1, log_p.shape[1]))
        out[edge] = 0
        for a, b in zip(cuts[1:-1].tolist(), cuts[2:].tolist(), strict=True):
            arc = order[a:b]
            to = go[arc]
            seg = np.flatnonzero(np.diff(to, prepend=-1))
            out[to[seg]] = log_sums(out[come[arc]] + log_p[arc], seg)
        return out


def log_sums(v: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """log of the sum of exp(v) for each run of rows that begins at seg, whatever v's size."""
    top = np.maximum.reduceat(v, seg)
    return top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, np.diff(np.append(seg, len(v))), axis=0)), seg))


def grouped(words: list[str]) -> list[list[int]]:
    """Numbers of the words by length, in groups of some GROUP characters; a longer word is a group."""
    out, held = [], 0
    for i in sorted(range(len(words)), key=lambda i: len(words[i])):
        if not out or held + len(words[i]) > GROUP:
            out.append([])
            held = 0
        out[-1].append(i)
        held += len(words[i]) + 1
    return out


def long_score(word: str, pieces: Pieces, log_p: np.ndarray) -> np.ndarray:
    """Log probability of one long word in each language: the same sums, with the last places alone in memory."""
    marked, keep = START + word, pieces.longest
    state = np.full((keep, log_p.shape[1]), -np.inf)  # of the places before a
    state = np.concatenate([state, np.zeros((1, log_p.shape[1]))])
    for a in range(0, len(marked), LONG):
        b, low = min(len(marked), a + LONG), max(0, a - keep + 1)
        start, end, piece = pieces.arcs(marked[low:b])
        start, end = start + low - a, end + low - a
        inside = end > 0
        start, end, piece = start[inside], end[inside], piece[inside]
        order, cuts = _by_place(end, start)
        lp = log_p[piece[order]]
        come = start[order] + keep
        state = np.concatenate([state, np.zeros((b - a, state.shape[1]))])
        for place in range(1, b - a + 1):
            arc = slice(cuts[place], cuts[place + 1])
            state[keep + place] = log_sums(state[come[arc]] + lp[arc], np.zeros(1, np.int64))[0]
        state = state[-keep - 1 :]
    return state[-1]


def log_scores(words: list[str], model: Model) -> np.ndarray:
    """Log probability of each word in each language."""
    pieces = vocabulary_pieces(model.vocabulary)
    out = np.zeros((len(words), len(model.languages)))
    log_p = np.log(model.probability)
    short = [i for i, w in enumerate(words) if len(w) <= LONG]
    for at in grouped([words[i] for i in short]):
        group = [short[k] for k in at]
        lattice = Lattice([words[i] for i in group], pieces)
        out[group] = lattice.sums(log_p[lattice.piece], True)[lattice.last]
    for i, w in enumerate(words):
        if len(w) > LONG:
            out[i] = long_score(w, pieces, log_p)
    return out


def fit_counts(words: list[str], counts: np.ndarray, languages: list[str], vocabulary: str, rounds: int = 3) -> Model:
    """counts[word, language] -> piece probabilities by expectation maximisation, started from every piece's
    occurrences in any segmentation."""
    pieces = vocabulary_pieces(vocabulary)
    n, nl = len(pieces.row) + 1, len(languages)
    probability = np.ones((n, nl)) / n
    groups = [(at, Lattice([words[i] for i in at], pieces)) for at in grouped(words)] if nl else []
    for turn in range(rounds):
        expected, log_p = np.zeros((n, nl)), np.log(probability)
        for at, lattice in groups:
            c = counts[at][lattice.word]
            if turn == 0:
                share = 1 / lattice.size[lattice.word, None]
            else:
                lp = log_p[lattice.piece]
                ahead, back = lattice.sums(lp, True), lattice.sums(lp, False)
                share = np.exp(ahead[lattice.start] + lp + back[lattice.end] - ahead[lattice.last][lattice.word])
            for k in range(nl):
                expected[:, k] += np.bincount(lattice.piece, (share * c)[:, k], n)
        expected += 0.01
        expected[-1] = 0
        probability = expected / expected.sum(0)
        probability[-1] = UNKNOWN
    return Model(languages, vocabulary, probability)


def held_out(id_column: str = "doc_id"):
    """The fold that never trains: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", vocabulary: str = "piece_bpe_32k.model", train_docs: int = 400) -> Model:
    """Reads about `train_docs` labelled rows a language (all, if there are fewer): those whose id's hash falls below the share that
    gives that number; held-out rows never."""
    rows = docs.select(F.col(id_column).alias("i"), F.col(text_column).alias("t"), F.col(lang_column).alias("l"), held_out(id_column).alias("out"))
    rows = rows.where("l IS NOT NULL AND t IS NOT NULL AND i IS NOT NULL AND NOT out")
    rates = {r["l"]: min(1.0, train_docs / r["n"]) for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}  # a row a language, as the model has
    if not rates:
        return fit_counts([], np.zeros((0, 0)), [], vocabulary)
    rate = F.create_map(*[F.lit(x) for kv in rates.items() for x in kv])[F.col("l")]
    chosen = rows.where(F.pmod(F.xxhash64("i"), F.lit(1 << 30)) < rate * float(1 << 30))

    def count(batches):
        from collections import Counter, defaultdict

        import pandas as pd

        seen = defaultdict(Counter)
        for pdf in batches:
            for text, lang in zip(pdf["t"], pdf["l"], strict=True):
                seen[lang].update(words_of(text))
        yield pd.DataFrame([(lang, w, n) for lang, c in seen.items() for w, n in c.items()], columns=["l", "w", "n"])

    counted = chosen.select("t", "l").mapInPandas(count, "l string, w string, n long")
    pdf = counted.groupBy("l", "w").agg(F.sum("n").alias("n")).toPandas()  # bounded by train_docs
    languages, words = sorted(pdf["l"].unique()), sorted(pdf["w"].unique())
    counts = np.zeros((len(words), len(languages)))
    counts[np.searchsorted(np.array(words, dtype=object), pdf["w"].to_numpy(dtype=object)) if len(words) else [], [languages.index(x) for x in pdf["l"]]] = pdf["n"]
    return fit_counts(words, counts, languages, vocabulary)


class Scorer:
    """Texts -> (language, posterior under equal priors)."""

    def __init__(self, model: Model):
        self.model, self.at, self.rows = model, {}, np.zeros((0, len(model.languages)))

    def __call__(self, texts) -> list[tuple[str, float]]:
        found = [words_of(t) if isinstance(t, str) else [] for t in texts]
        every = set().union(*found)
        long = {w for w in every if len(w) > LONG}
        every -= long
        new = list(every - self.at.keys())
        if len(self.at) + len(new) > MEMORY:
            self.at, self.rows = {}, self.rows[:0]
            new = list(every)
        if new and self.model.languages:
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, log_scores(new, self.model)])
        out = []
        for ws in found:
            if not self.model.languages or not any(map(str.isalpha, ws)) and not any(c.isalpha() for w in ws for c in w):
                out.append(("und", 0.0))
                continue
            apart = [w for w in ws if w in long] if long else []
            known = [w for w in ws if w not in long] if apart else ws
            total = self.rows[np.fromiter(map(self.at.__getitem__, known), dtype=np.int64, count=len(known))].sum(0)
            if apart:
                total = total + log_scores(apart, self.model).sum(0)
            best = int(total.argmax())
            out.append((self.model.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return out


_scorers: dict = {}


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, held_out, lang_pred, score); with keep: these columns of docs, then lang_pred and score."""
    import uuid

    own = uuid.uuid4().hex
    names = keep if keep is not None else [id_column]
    kinds = {c: docs.schema[c].dataType.simpleString() for c in names}
    kept = [F.col(f"`{c}`").alias(f"kept_{k}") for k, c in enumerate(names)]
    text = f"kept_{names.index(text_column)}" if text_column in names else "t"  # the text travels once
    rows = docs.select(*kept, *([] if text_column in names else [F.col(f"`{text_column}`").alias("t")]), held_out(id_column).alias("held_out"))
    made = "held_out boolean, lang_pred string, score double" if keep is None else "lang_pred string, score double"

    def run(batches):
        import pandas as pd

        if own not in _scorers:
            _scorers.clear()  # of an earlier model
            _scorers[own] = Scorer(model)
        score = _scorers[own]
        for whole in batches:
            for k in range(0, len(whole), 500):
                pdf = whole.iloc[k : k + 500]
                out = {c: pdf[f"kept_{j}"].array for j, c in enumerate(names)}
                if keep is None:
                    out["held_out"] = pdf["held_out"].array
                found = score(pdf[text])
                yield pd.DataFrame(out | {"lang_pred": [x for x, _ in found], "score": [x for _, x in found]})

    return rows.mapInPandas(common.trimmed(run), ", ".join([*(f"`{c}` {t}" for c, t in kinds.items()), made]))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
