"""Language identification by unigram models over the pieces of a fixed public vocabulary, summed over all segmentations.

A word is its letters in lower case behind a mark of its beginning. Under a language it has the probability of all ways to cut it
into pieces of the vocabulary, each the product of the language's piece probabilities; a forward pass over the word sums them. A
text's score is the product over its words and the language's share of texts. The piece probabilities are learned by expectation
maximisation from all labelled texts: Spark counts words by language, each round spreads a word's count over the pieces of its
segmentations by how likely they are, and Spark adds up what the pieces got.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain, groupby, islice
from typing import NamedTuple

import ahocorasick
import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_rows, materialise, table

VOCABULARY = "piece_bpe_32k.model"
ROUNDS = 2
#: Added to what each piece got in a language.
SMOOTHING = 0.1
#: Most bytes of probabilities that are sent to every task; more raise an error.
MODEL_BYTES = 256 << 20
UNDETERMINED = "und"

START, UNKNOWN = "▁", "\x00"
BATCH_CHARACTERS = 200_000
#: Characters of texts that are counted before their new words are scored together.
BATCH_TEXT = 2_000_000
#: Distinct words of which a task keeps the counts or scores before it lets them go; results don't depend on it.
KEPT_WORDS = 800_000
#: Letters of a word whose probability no piece's, 1e-10 say, makes too small for a double.
SHORT = 25

_WORD = re.compile(r"[^\W\d_]+")


class Pieces(NamedTuple):
    """The vocabulary's pieces in an automaton that finds them all, the characters that it has, and the pieces' lengths."""

    automaton: ahocorasick.Automaton
    known: frozenset[str]
    lengths: np.ndarray


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """Pieces of letters behind at most one mark of a word's beginning, and one for every character that has none."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    usable = [UNKNOWN, *sorted({x for x in found if _WORD.fullmatch(x.removeprefix(START)) or x == START} | {START})]
    automaton = ahocorasick.Automaton()
    for i, piece in enumerate(usable):
        automaton.add_word(piece, i)
    automaton.make_automaton()
    return Pieces(automaton, frozenset(x for x in usable if len(x) == 1), np.array([len(x) for x in usable]))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class Lattice:
    """All occurrences of pieces in words written one after the other: each covers the characters from ``start`` to ``end``."""

    def __init__(self, words: list[str], vocabulary: Pieces) -> None:
        joined = [START + (w if vocabulary.known.issuperset(w) else "".join(c if c in vocabulary.known else UNKNOWN for c in w)) for w in words]
        sizes = np.array([len(w) for w in joined])
        last, piece = np.fromiter(chain.from_iterable(vocabulary.automaton.iter("".join(joined))), np.int64).reshape(-1, 2).T
        length = vocabulary.lengths[piece]
        self.first = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(words)), sizes)
        inside = last - length + 1 >= self.first[word[last]]
        # A node lies before each character and one behind each word.
        self.word, self.piece = word[last[inside]], piece[inside]
        self.end = last[inside] + self.word + 1
        self.start = self.end - length[inside]
        self.first = self.first + np.arange(len(words))
        self.last = self.first + sizes
        self.nodes = int(self.last[-1]) + 1 if words else 0

    def _sums(self, order: np.ndarray, at: np.ndarray, origin: np.ndarray, place: np.ndarray, step: int, weight: np.ndarray, long: bool) -> np.ndarray:
        """Sums over all ways to each node, node by node of all words together; logarithms if ``long``, else plain numbers.

        ``order`` sorts the pieces by ``place``, then ``at``. A node ``step`` before ``at`` has a sum, which long words scale by.
        """
        weight = weight if long else np.exp(weight)
        total = np.zeros((self.nodes, weight.shape[1])) if long else np.ones((self.nodes, weight.shape[1]))
        at, origin, piece, place = at[order], origin[order], self.piece[order], place[order]
        for lo, hi in zip(*_runs(place), strict=True):
            to = at[lo:hi]
            begins, _ = _runs(to)
            if long:
                near = total[to - step]
                ways = np.exp(total[origin[lo:hi]] - near + weight[piece[lo:hi]])
                total[to[begins]] = near[begins] + np.log(np.add.reduceat(ways, begins, axis=0))
            else:
                total[to[begins]] = np.add.reduceat(total[origin[lo:hi]] * weight[piece[lo:hi]], begins, axis=0)
        return total

    def forward(self, weight: np.ndarray, long: bool = True) -> np.ndarray:
        place = self.end - self.first[self.word]
        # Pieces come by where they end.
        order = np.argsort(place.astype(np.uint16) if place.max(initial=0) < 2**16 else place, kind="stable")
        return self._sums(order, self.end, self.start, place, 1, weight, long)

    def backward(self, weight: np.ndarray, long: bool = True) -> np.ndarray:
        place = self.last[self.word] - self.start
        return self._sums(np.lexsort((self.start, place)), self.start, self.end, place, -1, weight, long)

    def scores(self, weight: np.ndarray, long: bool = True) -> np.ndarray:
        """Log probability of each word by column of ``weight``, the pieces' log probabilities."""
        total = self.forward(weight, long)[self.last]
        return total if long else np.log(total)

    def expected(self, weight: np.ndarray, times: np.ndarray, long: bool = True) -> np.ndarray:
        """How often each piece is expected in the segmentations of the words, which occur ``times``; ``weight`` has one column."""
        ahead, behind = self.forward(weight, long), self.backward(weight, long)
        whole = ahead[self.last[self.word]]
        if long:
            share = np.exp(ahead[self.start] + weight[self.piece] + behind[self.end] - whole)
        else:
            share = ahead[self.start] * np.exp(weight)[self.piece] * behind[self.end] / whole
        return np.bincount(self.piece, share[:, 0] * times[self.word], len(weight))


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of equal numbers."""
    begins = np.flatnonzero(np.diff(x, prepend=x[:1] - 1))
    return begins, np.append(begins[1:], len(x))


def _lattices(words: Iterable[str], vocabulary: Pieces) -> Iterator[tuple[list[str], Lattice, bool]]:
    """Batches of words, their lattices and whether they are too long for sums without logarithms."""
    short, long = [], []
    for word in words:
        (short if len(word) <= SHORT else long).append(word)
    for part in (short, long):
        for batch in _batches(part):
            yield batch, Lattice(batch, vocabulary), part is long


def _batches(items: Iterable, length: Callable = len, most: int = BATCH_CHARACTERS) -> Iterator[list]:
    """Lists of items, each but the last of ``most`` characters or more, by one item's at most."""
    batch, size = [], 0
    for item in items:
        batch.append(item)
        size += length(item)
        if size >= most:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


class Model(NamedTuple):
    """Languages by name, the log share of each one's texts, and its log probability of each piece."""

    path: str
    languages: list[str]
    share: np.ndarray
    weight: np.ndarray

    def predict(self, counts: Counter, scores: WordScores) -> tuple[str, float]:
        """The likeliest language, of a tie the first by name, and its probability; ``und`` and 0 without a word."""
        if not counts or not self.languages:
            return UNDETERMINED, 0.0
        total = self.share + np.fromiter(counts.values(), float, len(counts)) @ scores.of(counts)
        best = int(total.argmax())
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())


class WordScores:
    """Scores of distinct words under a model, as a task meets them."""

    def __init__(self, model: Model) -> None:
        self.model, self.place, self.parts, self.size = model, {}, [], 0

    def add(self, words: Iterator[str]) -> None:
        if self.size > KEPT_WORDS:
            self.place, self.parts, self.size = {}, [], 0
        new = dict.fromkeys(w for w in words if w not in self.place)
        for batch, lattice, long in _lattices(new, pieces(self.model.path)):
            self.parts.append(lattice.scores(self.model.weight, long))
            self.place.update(zip(batch, range(self.size, self.size + len(batch)), strict=True))
            self.size += len(batch)
        self.parts = [np.concatenate(self.parts)] if self.parts else []

    def of(self, words: Counter) -> np.ndarray:
        return self.parts[0][np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))]


def labelled_words(docs: DataFrame) -> DataFrame:
    """lang, word, n: occurrences by language, and as the null word the number of its texts."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        counts: dict[str, Counter] = {}
        size = 0
        for text, lang in rows:
            own = counts.setdefault(lang, Counter())
            size -= len(own)
            own[None] += 1
            own.update(words_of(text))
            size += len(own)
            if size > KEPT_WORDS:
                yield from ((name, *x) for name, c in counts.items() for x in c.items())
                counts, size = {}, 0
        yield from ((name, *x) for name, c in counts.items() for x in c.items())

    return map_rows(docs.where("lang is not null"), ["text", "lang"], "lang string, word string, n long", run).groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _expectations(words: DataFrame, model: Model) -> DataFrame:
    """lang, piece, n: what the pieces get of the words' counts under the model."""
    of = {name: i for i, name in enumerate(model.languages)}

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        got = np.zeros_like(model.weight)
        for lang, own in groupby(rows, key=lambda r: r[0]):
            column = of[lang]
            pairs = ((w, n) for _, w, n in own)
            while batch := list(islice(pairs, 20_000)):
                times = dict(batch)
                for part, lattice, long in _lattices(times, pieces(model.path)):
                    got[:, column] += lattice.expected(model.weight[:, column : column + 1], np.array([times[w] for w in part], float), long)
        for piece, column in zip(*np.nonzero(got), strict=True):
            yield model.languages[column], int(piece), float(got[piece, column])

    ordered = words.sortWithinPartitions("lang")
    return map_rows(ordered, ["lang", "word", "n"], "lang string, piece int, n double", run).groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, rounds: int = ROUNDS, path: str | None = None) -> Model:
    """A model from all texts of ``docs`` (text, lang) with a language. Repeated rows count as often; no such text, no languages."""
    path = path or public_tokenizers.path(VOCABULARY)
    vocabulary = pieces(path)
    counted = materialise(labelled_words(docs))
    # One row a language; too many of them for MODEL_BYTES raise an error below.
    most = MODEL_BYTES // (8 * len(vocabulary.lengths))
    texts = sorted(tuple(r) for r in counted.where("word is null").select("lang", "n").limit(most + 1).collect())
    if len(texts) > most:
        raise ValueError(f"over {most} languages")
    languages = [lang for lang, _ in texts]
    number = np.array([n for _, n in texts], float)
    model = Model(path, languages, np.log(number / number.sum()) if len(number) else number, np.full((len(vocabulary.lengths), len(languages)), -np.log(len(vocabulary.lengths))))
    words = counted.where("word is not null")
    for _ in range(rounds if languages else 0):
        got = np.full_like(model.weight, SMOOTHING)
        for lang, piece, n in _expectations(words, model).toLocalIterator():
            got[piece, languages.index(lang)] += n
        model = model._replace(weight=np.log(got / got.sum(axis=0)))
    discard(counted)
    return model


def identify(docs: DataFrame, model: Model, keep: list[str], columns: list[str]) -> DataFrame:
    """``keep`` columns of ``docs``, then lang_pred and score, the probability of that language, for every row.

    A text that is null or has no letter is ``und`` with score 0, as all are without a learned language. Very long texts are
    scored whole, repeated rows alike; an empty table gives no rows, and other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        model = sent.value
        scores = WordScores(model)
        for batch in _batches(rows, lambda r: 100 + len(r[-1] or ""), BATCH_TEXT):
            texts = [Counter(words_of(text)) for *_, text in batch]
            scores.add(chain.from_iterable(texts))
            for (*kept, _), counts in zip(batch, texts, strict=True):
                yield *kept, *model.predict(counts, scores)

    return map_rows(docs, [*keep, "text"], ", ".join([*columns, "lang_pred string", "score double"]), run)


def held_out(of: int = 4, remainder: int = 2) -> Column:
    """Whether a row is kept from learning: crc32 of doc_id's decimal text modulo ``of``; a null doc_id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == remainder, F.lit(False))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = train(docs.where("not held_out"))
    return identify(docs, model, ["doc_id", "held_out"], ["doc_id long", "held_out boolean"])
