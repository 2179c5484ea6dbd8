"""Language identification by unigrams marginalised over segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability
is the sum over all its segmentations into pieces, found by the forward algorithm; a text's
log-probability is the sum over its words. The piece probabilities are fitted by
expectation-maximisation: a Spark pass over the distinct training words sums the expected number
of uses of each piece (forward-backward), and only the table of pieces by languages, bounded by the
vocabulary, comes back to the driver.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from uuid import uuid4

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from garimpo.llm.common import keep_memos, models, small_batches, texts_of
from garimpo.llm.registry import query
from garimpo.schema import stage

UNKNOWN = "und"
#: The parameter that bounds the training sample: documents per language, chosen by a hash.
TRAINING_DOCS = 800
ROUNDS = 2
WORD_START = "▁"
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Added to the expected uses of every piece; probability of a character outside the vocabulary.
SMOOTHING, UNSEEN_CHARACTER = 0.05, 1e-9
MEMO_WORDS = 350_000
#: Letters below which a text is never rejected for being unlike its language.
SHORT = 20
#: Standard deviation of a language's fluency that is allowed even where its texts hardly differ.
LEAST_DEVIATION = 0.25
PIECES: dict[str, dict[str, int]] = models()


def pieces_of(path: str) -> dict[str, int]:
    """The text pieces of a sentencepiece file, numbered from 0; bytes and control pieces are left out."""
    if path not in PIECES:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = [
            model.id_to_piece(i) for i in range(model.get_piece_size())
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
        ]
        PIECES[path] = {piece: i for i, piece in enumerate(dict.fromkeys(found))}
    return PIECES[path]


AUTOMATA: dict[str, ahocorasick.Automaton] = models()


def automaton_of(path: str) -> ahocorasick.Automaton:
    """Finds all pieces in a text; a match tells the piece's length and number."""
    if path not in AUTOMATA:
        found = ahocorasick.Automaton()
        for piece, i in pieces_of(path).items():
            found.add_word(piece, len(piece) << 32 | i)
        found.make_automaton()
        AUTOMATA[path] = found
    return AUTOMATA[path]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass
class Model:
    """``table``: piece probabilities, pieces by languages; its last row is an unseen character's."""

    path: str
    languages: list[str]
    table: np.ndarray
    index: dict[str, int] = field(default_factory=dict, repr=False)
    scores: np.ndarray | None = field(default=None, repr=False)

    def arcs(self, word: str) -> list[list[tuple[int, int]]]:
        """For each end position the pieces that end there: ``(start, piece)``."""
        pieces = pieces_of(self.path)
        longest = self.longest
        unseen = len(pieces)
        found = []
        for end in range(1, len(word) + 1):
            here = [
                (start, pieces[word[start:end]])
                for start in range(max(0, end - longest), end) if word[start:end] in pieces
            ]
            if not here or here[-1][0] != end - 1:
                here.append((end - 1, unseen))
            found.append(here)
        return found

    @property
    def longest(self) -> int:
        pieces = pieces_of(self.path)
        if getattr(self, "_longest", None) is None:
            self._longest = max(map(len, pieces), default=1)
        return self._longest

    def forward(self, word: str, arcs=None) -> tuple[np.ndarray, np.ndarray]:
        """Sums over all segmentations of each beginning of ``word`` (scaled), and log scales."""
        arcs = arcs or self.arcs(word)
        alpha = np.empty((len(word) + 1, len(self.languages)))
        scale = np.zeros(len(word) + 1)
        alpha[0] = 1.0
        for end, here in enumerate(arcs, 1):
            starts, pieces = zip(*here)
            starts = list(starts)
            parts = alpha[starts] * self.table[list(pieces)]
            if end > 24:  # keep long words within the range of a double
                base = scale[starts].max()
                parts *= np.exp(scale[starts] - base)[:, None]
                total = parts.sum(0)
                top = total.max()
                alpha[end], scale[end] = total / top, base + math.log(top)
            else:
                alpha[end] = parts.sum(0)
        return alpha, scale

    def word_score(self, word: str) -> np.ndarray:
        alpha, scale = self.forward(WORD_START + word)
        return np.log(np.maximum(alpha[-1], 1e-300)) + scale[-1]

    def learn(self, words: set[str]) -> None:
        """Score the words not met before, those of one length together."""
        new = words.difference(self.index)
        if not new:
            return
        if self.scores is None or len(self.index) + len(new) > len(self.scores):
            self.index.clear()
            new = words
            self.scores = np.empty((max(MEMO_WORDS, len(words)), len(self.languages)))
        by_length: dict[int, list[str]] = {}
        for word in new:
            by_length.setdefault(len(word), []).append(word)
        for length, group in by_length.items():
            if length < 24:
                parts = [group[i : i + 2000] for i in range(0, len(group), 2000)]
                found = np.concatenate([self.group_scores([WORD_START + w for w in p], length + 1) for p in parts])
            else:
                found = [self.word_score(w) for w in group]
            at = len(self.index)
            self.scores[at : at + len(group)] = found
            self.index.update(zip(group, range(at, at + len(group))))

    def group_scores(self, group: list[str], size: int) -> np.ndarray:
        """The forward algorithm over words of ``size`` characters, a row each."""
        m, text = len(group), "".join(group)
        matches = list(automaton_of(self.path).iter(text))
        last = np.array([x[0] for x in matches], np.int64)
        found = np.array([x[1] for x in matches], np.int64)
        length, piece = found >> 32, found & 0xFFFFFFFF
        word, end = last // size, last % size + 1
        inside = length <= end
        word, end, length, piece = word[inside], end[inside], length[inside], piece[inside]
        # characters outside the vocabulary
        single = np.zeros((m, size), bool)
        single[word[length == 1], end[length == 1] - 1] = True
        w, e = np.nonzero(~single)
        word, end = np.r_[word, w], np.r_[end, e + 1]
        length = np.r_[length, np.ones(len(w), np.int64)]
        piece = np.r_[piece, np.full(len(w), len(self.table) - 1)]
        # arcs by end, then by length: no word occurs twice in a stretch
        order = np.lexsort((length, end))
        word, end, length, piece = word[order], end[order], length[order], piece[order]
        edges = np.flatnonzero(np.r_[True, (end[1:] != end[:-1]) | (length[1:] != length[:-1])]).tolist()
        alpha = np.zeros((size + 1, m, len(self.languages)))
        alpha[0] = 1.0
        for i, j in zip(edges, [*edges[1:], len(end)]):
            at = word[i:j]
            alpha[end[i], at] += alpha[end[i] - length[i], at] * self.table[piece[i:j]]
        return np.log(np.maximum(alpha[size], 1e-300))

    def text_scores(self, words: list[str]) -> np.ndarray:
        """Log-probability in each language of words that were all learned."""
        index = self.index
        return self.scores[np.fromiter(map(index.__getitem__, words), np.int64, len(words))].sum(0)

    def __getstate__(self):
        return {"path": self.path, "languages": self.languages, "table": self.table, "index": {}, "scores": None}


def _expected(model: Model, lang: int, word: str, n: int, uses: dict[int, float]) -> None:
    """Add the expected uses of each piece in ``n`` occurrences of ``word`` (forward-backward).

    A word is at most 64 letters here; longer ones come in parts."""
    arcs = model.arcs(word)
    p = model.table[:, lang]
    size = len(word)
    alpha, beta = [1.0] + [0.0] * size, [0.0] * size + [1.0]
    for end, here in enumerate(arcs, 1):
        alpha[end] = sum(alpha[s] * p[k] for s, k in here)
    for end in range(size, 0, -1):
        for s, k in arcs[end - 1]:
            beta[s] += p[k] * beta[end]
    if alpha[size] > 0:
        for end, here in enumerate(arcs, 1):
            for s, k in here:
                uses[k] = uses.get(k, 0.0) + n * alpha[s] * p[k] * beta[end] / alpha[size]


def sample_of(labelled: DataFrame, per_language: int) -> tuple[DataFrame, list[str]]:
    """About ``per_language`` rows of each language by a hash of ``doc_id``, and the languages."""
    rows = labelled.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    found = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    steps = 1_000_000
    shares = [x for k in found for x in (F.lit(k), F.lit(int(math.ceil(min(1.0, per_language / found[k]) * steps))))]
    if found:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(steps)) < F.element_at(F.create_map(*shares), F.col("lang")))
    return rows, sorted(found)


def fit(labelled: DataFrame, vocabulary: str, per_language: int = TRAINING_DOCS, rounds: int = ROUNDS) -> Model:
    """Fit on ``doc_id, text, lang`` rows; rows without ``lang`` or ``text`` are not used.

    At most about ``per_language`` documents of a language are taken, by a hash of ``doc_id``, so a
    language with a third of all rows costs no more than another. No labelled row: no languages.
    """
    sample, languages = sample_of(labelled, per_language)
    pieces = pieces_of(vocabulary)
    uniform = np.full((len(pieces) + 1, max(1, len(languages))), 1.0 / len(pieces))
    uniform[-1] = UNSEEN_CHARACTER
    model = Model(vocabulary, languages, uniform)
    if not languages:
        return model

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in small_batches(batches):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                counts.update((lang, w) for w in words_of(text))
        yield pa.RecordBatch.from_pydict(
            {
                "lang": pa.array([k[0] for k in counts], pa.string()), "word": pa.array([k[1] for k in counts], pa.string()),
                "n": pa.array(list(counts.values()), pa.int64()),
            }
        )

    words = stage(
        sample.select("text", "lang").mapInArrow(count, "lang string, word string, n bigint")
        .groupBy("lang", "word").agg(F.sum("n").alias("n"))
    )
    # little data but much work: spread it over the executors
    words = words.repartition(int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for _ in range(rounds):
        current = model

        def expect(batches: Iterator[pa.RecordBatch], current=current) -> Iterator[pa.RecordBatch]:
            uses: dict[int, dict[int, float]] = {}
            at = {k: i for i, k in enumerate(current.languages)}
            for batch in batches:
                for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))):
                    word = WORD_START + word
                    for cut in range(0, len(word), 64):
                        _expected(current, at[lang], word[cut : cut + 64], n, uses.setdefault(at[lang], {}))
            flat = [(k, piece, u) for k, of in uses.items() for piece, u in of.items()]
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([x[0] for x in flat], pa.int32()), "piece": pa.array([x[1] for x in flat], pa.int32()),
                    "uses": pa.array([x[2] for x in flat], pa.float64()),
                }
            )

        sums = words.mapInArrow(expect, "lang int, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses"))
        table = np.full((len(pieces) + 1, len(languages)), SMOOTHING)
        for r in sums.collect():  # at most pieces x languages rows
            table[r["piece"], r["lang"]] += r["uses"]
        table /= table.sum(0)
        table[-1] = UNSEEN_CHARACTER
        model = Model(vocabulary, languages, table)
    return model


PREDICTED = "doc_id bigint, lang_pred string, score double"


def _predictions(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    langs, scores = [], []
    found = [words_of(text) if text else [] for text in texts]
    if model.languages:
        model.learn(set().union(*found))
    for words in found:
        if not words or not model.languages:
            langs.append(UNKNOWN)
            scores.append(0.0)
            continue
        logs = model.text_scores(words)
        best = int(np.argmax(logs))
        langs.append(model.languages[best])
        scores.append(float(1.0 / np.exp(np.clip(logs - logs[best], -700, 0)).sum()))
    return langs, scores


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row; ``und`` and 0 if there is no text or no letter.

    The score is the posterior of the language predicted, with equal priors. Ties take the first
    language by name. Rows are independent, so repeated rows and null ids change nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memos(PIECES, AUTOMATA)
        for batch in small_batches(batches, 200):
            langs, scores = _predictions(model, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())}
            )

    return texts_of(docs).mapInArrow(run, PREDICTED)


def fluency(model: Model, texts: list[str | None]) -> list[tuple[int, int, float]]:
    """``letters, language, log-probability a character`` of each text in its best language.

    It does not grow or shrink with the length of the text, unlike the posterior, which tends to 1.
    """
    found = [words_of(text) if text else [] for text in texts]
    model.learn(set().union(*found))
    out = []
    for words in found:
        letters = sum(map(len, words))
        logs = model.text_scores(words) if words else np.full(len(model.languages), -np.inf)
        best = int(np.argmax(logs))
        out.append((letters, best, float(logs[best]) / max(1, letters + len(words))))
    return out


def judged(docs: DataFrame, model: Model, names: tuple[str, str, str]) -> DataFrame:
    """``docs`` with three more columns, called ``names``: what ``fluency`` says of each text."""
    kinds = ("integer", "integer", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memos(PIECES, AUTOMATA)
        for batch in small_batches(batches, 200):
            found = fluency(model, batch.column("text").to_pylist())
            more = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    schema = StructType(list(docs.schema.fields))  # a copy: ``add`` changes it
    for name, kind in zip(names, kinds):
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema)


def floors(rows: DataFrame, names: tuple[str, str, str], languages: int, deviations: float) -> list[float]:
    """Per language the least fluency that counts as that language: mean less ``deviations`` standard deviations.

    Measured on all labelled texts of ``SHORT`` letters or more; ``rows`` are judged.
    """
    letters, best, fluent = names
    known = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col(letters) >= SHORT))
    spread = known.groupBy(F.col(best).alias("best")).agg(
        F.avg(fluent).alias("mean"), F.coalesce(F.stddev(fluent), F.lit(0.0)).alias("deviation")
    )
    least = [-math.inf] * languages
    for r in spread.collect():  # a row a language
        least[r["best"]] = r["mean"] - deviations * max(r["deviation"], LEAST_DEVIATION)
    return least


def identified(docs: DataFrame, model: Model, deviations: float) -> DataFrame:
    """Rows of ``docs`` in a language of ``model``; all columns stay.

    A text without a letter has no language. One of ``SHORT`` letters or more is rejected if its
    fluency in its best language is below that language's floor; a shorter one tells too little to
    be rejected. Every text is judged once and written with its judgement, from which the floors
    and then the rows follow.
    """
    mark = uuid4().hex
    letters, best, fluent = names = (f"letters_{mark}", f"best_{mark}", f"fluent_{mark}")
    rows = stage(judged(docs, model, names))
    least = F.array(*[F.lit(x) for x in floors(rows, names, len(model.languages), deviations)])
    fits = (F.col(letters) < SHORT) | (F.col(fluent) >= F.element_at(least, F.col(best) + 1))
    return rows.where((F.col(letters) > 0) & fits).drop(*names)


def remainder(modulus: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


@query("op2_language")
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(remainder(5) != 0), public_tokenizers.path("piece_bpe_32k.model"))
    return predict(docs, model).select(
        "doc_id", (remainder(5) == 0).alias("held_out"), "lang_pred", "score"
    )
