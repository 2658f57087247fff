"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. A word's probability is
the sum over all its segmentations into pieces, from the forward algorithm; a text's is the product
over its words. Words are runs of letters, lower-cased. Both passes work on the distinct words of a
batch, in lattices over their places, and look repeated words up. A trie finds the pieces; sums are
kept as logarithms, so neither a piece nor a word is ever cut for its length.

Learning takes one pass: expected piece counts under a uniform model (forward and backward), summed
over the table by language and piece and smoothed towards all languages. The model has at most
pieces x languages numbers. ``train_rows`` bounds the sample of labelled rows: every language has an
equal part of it, what small languages leave goes to the larger ones, and within a language a hash
of id and text chooses. Prediction covers every row.

Null text, or a text without a letter, is ``und`` with score 0; so is every text if nothing could be
learned (``has_letter`` tells the two apart). Rows with null lang or null id teach nothing; a null
id counts as not held out. Ties go to
the first language by name. Repeated rows are predicted alike, row for row. Only the id, text and
lang columns are read; ``carry`` keeps the input row as a struct. An empty table gives an empty
table. Texts are read whole, long words included.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import field, slices, unicode_text, whole_row

#: Expected rows of the labelled sample.
TRAIN_ROWS = 40_000
#: Weight of the distribution over all languages, in pieces, and of a uniform one within that.
POOLED = 200.0
UNIFORM = 0.5
_WORD = re.compile(r"[^\W\d_]+")
_KEPT = 200_000
#: Steps of a share in the sample.
_STEPS = 1_000_000_000
#: Characters of the words that one lattice holds; a longer word has one of its own.
_CHARACTERS = 1 << 17
_MARK = "▁"


def has_letter(column: str = "text"):
    """Whether ``predict`` finds a letter in a text."""
    return unicode_text(column).rlike(r"\p{L}")


@lru_cache(maxsize=2)
def lexicon(path: str) -> Lexicon:
    return Lexicon(path)


class Lexicon:
    """Pieces of a sentencepiece vocabulary as a trie; number 0 stands for any one unknown character."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.number = {piece: i + 1 for i, piece in enumerate(dict.fromkeys(plain))}
        self.size = len(self.number) + 1
        moves: dict[int, int] = {}
        pieces = [-1]
        for piece, number in self.number.items():
            state = 0
            for c in piece:
                state = moves.setdefault(state << 21 | ord(c), len(pieces))
                if state == len(pieces):
                    pieces.append(-1)
            pieces[state] = number
        #: Sorted (state, character) keys, the states they lead to, and the piece that ends in a state.
        self.moves = np.array(sorted(moves), np.int64)
        self.to = np.array([moves[k] for k in self.moves.tolist()], np.int64)
        self.pieces = np.array(pieces, np.int64)

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of every piece within the characters; 0 parts words. A character that
        is no piece is number 0."""
        start, state, found = np.flatnonzero(text), np.zeros(np.count_nonzero(text), np.int64), []
        size = 0
        while len(start):
            size += 1
            key = state << 21 | text[start + size - 1]
            at = np.minimum(np.searchsorted(self.moves, key), len(self.moves) - 1)
            on = self.moves[at] == key
            if size == 1:
                single = np.zeros(len(text), bool)
            start, state = start[on], self.to[at[on]]
            piece = self.pieces[state]
            whole = piece >= 0
            if size == 1:
                single[start[whole]] = True
                rest = np.flatnonzero((text > 0) & ~single)
                found.append((rest, rest + 1, np.zeros(len(rest), np.int64)))
            found.append((start[whole], start[whole] + size, piece[whole]))
            inside = start + size < len(text)
            start, state = start[inside], state[inside]
        a, b, n = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
        return a, b, n


@dataclass
class Model:
    languages: list[str]
    #: [piece, language]: log probabilities.
    logs: np.ndarray


class Lattice:
    """Words laid end to end, a place before each character and one behind each word, with the pieces
    between places as edges."""

    def __init__(self, words: list[str], lex: Lexicon) -> None:
        length = np.array([len(w) + 1 for w in words])
        self.last = np.cumsum(length + 1) - 1
        self.first = self.last - length
        text = np.frombuffer((_MARK + f"\0{_MARK}".join(words) + "\0").encode("utf-32-le"), np.uint32).astype(np.int64)
        start, end, piece = lex.edges(text)
        depth = np.arange(len(text)) - np.repeat(self.first, length + 1)
        self.places, self.depth = len(text), depth
        by = np.lexsort((end, depth[end]))
        self.start, self.end, self.piece = start[by], end[by], piece[by]

    def levels(self, towards: np.ndarray, backward: bool = False):
        """(edges, their groups' first ones, groups' places) for the edges into places of each depth,
        or, backward, out of them."""
        depth = self.depth[towards]
        cuts = np.flatnonzero(np.diff(depth)) + 1
        bounds = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(towards)], strict=True)) if len(towards) else []
        for a, b in bounds:
            own = towards[a:b]
            groups = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            yield slice(a, b), groups, own[groups]

    def forward(self, logs: np.ndarray) -> np.ndarray:
        """[place, column]: log probability of all segmentations up to a place, for each column of
        piece log probabilities. Logarithms, so nothing underflows however long a word is."""
        alpha = np.full((self.places, logs.shape[1]), -np.inf)
        alpha[self.first] = 0
        for edges, groups, places in self.levels(self.end):
            alpha[places] = _log_sums(alpha[self.start[edges]] + logs[self.piece[edges]], groups)
        return alpha

    def backward(self, logs: np.ndarray) -> np.ndarray:
        """As ``forward``, from a place to the end of its word."""
        beta = np.full((self.places, logs.shape[1]), -np.inf)
        beta[self.last] = 0
        by = np.lexsort((self.start, -self.depth[self.start]))
        start, end, piece = self.start[by], self.end[by], self.piece[by]
        for edges, groups, places in self.levels(start):
            beta[places] = _log_sums(beta[end[edges]] + logs[piece[edges]], groups)
        return beta


def _log_sums(values: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Logarithms of the sums of exponentials of consecutive groups of rows."""
    most = np.maximum.reduceat(values, groups, axis=0)
    size = np.diff(np.append(groups, len(values)))
    return most + np.log(np.add.reduceat(np.exp(values - np.repeat(most, size, axis=0)), groups, axis=0))


def _lattices(words: list[str], lex: Lexicon):
    """(numbers of words, lattice), words of like length together, in parts of bounded size."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    part: list[int] = []
    held = 0
    for i in order:
        if part and (held + len(words[i]) > _CHARACTERS or len(words[i]) > 2 * len(words[part[0]]) + 8):
            yield part, Lattice([words[k] for k in part], lex)
            part, held = [], 0
        part.append(i)
        held += len(words[i]) + 2
    if part:
        yield part, Lattice([words[k] for k in part], lex)


def word_scores(words: list[str], lex: Lexicon, logs: np.ndarray) -> np.ndarray:
    """[word, language]: log probability of each word, summed over its segmentations."""
    out = np.empty((len(words), logs.shape[1]))
    for part, lattice in _lattices(words, lex):
        out[part] = lattice.forward(logs)[lattice.last]
    return out


def expected_counts(words: list[str], weight: np.ndarray, lex: Lexicon) -> np.ndarray:
    """Expected uses of each piece, by weight, when all pieces are equally likely."""
    total = np.zeros(lex.size)
    flat = np.full((lex.size, 1), -np.log(lex.size))
    for part, lattice in _lattices(words, lex):
        alpha, beta = lattice.forward(flat)[:, 0], lattice.backward(flat)[:, 0]
        length = np.diff(np.append(lattice.first, lattice.places))
        whole = np.repeat(alpha[lattice.last], length)[lattice.start]
        share = np.repeat(weight[part], length)[lattice.start]
        uses = share * np.exp(alpha[lattice.start] + flat[0, 0] + beta[lattice.end] - whole)
        total += np.bincount(lattice.piece, uses, lex.size)
    return total


def shares(many: dict[str, int], most: int) -> dict[str, float]:
    """The part of each language's rows to take, so that ``most`` are expected in all and no language
    has fewer than another unless it is taken whole."""
    out, left = {}, most
    for k, lang in enumerate(sorted(many, key=many.get)):
        take = min(many[lang], left / (len(many) - k))
        out[lang], left = take / many[lang], left - take
    return out


def learn(labelled: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from rows with a language. All of them if there are at most ``train_rows``, else, per
    language, those whose hashed id and text are below the language's share."""
    rows = labelled.where(field(lang_col).isNotNull() & field(id_col).isNotNull() & field(text_col).isNotNull())
    many = dict(rows.groupBy(field(lang_col).alias("lang")).count().collect())  # a row per language
    if sum(many.values()) > train_rows:
        share = F.create_map(*[F.lit(x) for lang, part in shares(many, train_rows).items() for x in (lang, round(part * _STEPS))])
        rows = rows.where(F.pmod(F.xxhash64(field(id_col), field(text_col)), F.lit(_STEPS)) < F.element_at(share, field(lang_col)))

    def run(batches):
        lex = lexicon(path)
        counts: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            words: dict[str, dict[str, int]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = words.setdefault(lang, {})
                for word in _WORD.findall(text.lower()):
                    own[word] = own.get(word, 0) + 1
            for lang, own in words.items():
                found = expected_counts(list(own), np.fromiter(own.values(), float, len(own)), lex)
                counts[lang] = counts[lang] + found if lang in counts else found
        for lang, total in counts.items():
            on = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(on), pa.string()), pa.array(on, pa.int64()), pa.array(total[on])], names=["lang", "piece", "n"])

    summed = (
        rows.select(field(lang_col).alias("lang"), field(text_col).alias("text"))
        .mapInArrow(run, "lang string, piece long, n double")
        .groupBy("lang", "piece")
        .agg(F.sum("n").alias("n"))
        .toPandas()  # at most pieces x languages rows
    )
    size = lexicon(path).size
    languages = sorted(summed["lang"].unique())
    counts = np.zeros((size, len(languages)))
    counts[summed["piece"], summed["lang"].map({x: i for i, x in enumerate(languages)})] = summed["n"]
    pooled = counts.sum(axis=1, keepdims=True) + UNIFORM
    pooled /= pooled.sum()
    chance = (counts + POOLED * pooled) / (counts.sum(axis=0, keepdims=True) + POOLED)
    return Model(languages, np.log(chance))


class Scorer:
    """Log probabilities of texts, with the distinct words of a task kept."""

    def __init__(self, model: Model, lex: Lexicon) -> None:
        self.model, self.lex = model, lex
        self.code: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.languages)))

    def texts(self, texts: list[str]) -> list[np.ndarray | None]:
        """Per text, the log probability by language, or None without a letter."""
        if len(self.code) > _KEPT:
            self.code, self.rows = {}, self.rows[:0]
        split = [_WORD.findall(text.lower()) for text in texts]
        new = sorted(set().union(*split).difference(self.code))
        if new:
            scores = word_scores(new, self.lex, self.model.logs)
            # runs of superscript digits and the like have no letter
            scores[[not w.isalpha() and not any(map(str.isalpha, w)) for w in new]] = np.nan
            self.code.update(zip(new, range(len(self.code), len(self.code) + len(new)), strict=True))
            self.rows = np.vstack([self.rows, scores])
        out: list[np.ndarray | None] = []
        for words in split:
            own = self.rows[np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))]
            own = own[~np.isnan(own[:, 0])] if own.shape[1] else own[:0]
            out.append(own.sum(axis=0) if len(own) else None)
        return out


def predict(docs: DataFrame, model: Model, path: str, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per input row: id, ``lang_pred`` and ``score``, the posterior of that language; with
    ``carry``, the input row too, as the struct ``row``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages

    def run(batches):
        scorer = Scorer(shared.value, lexicon(path))
        for batch in slices(batches, "text", 4 << 20):
            names, scores = [], []
            for logs in scorer.texts(batch.column("text").to_pylist()):
                if logs is None:
                    names.append("und")
                    scores.append(0.0)
                    continue
                best = int(logs.argmax())
                names.append(shared.value.languages[best])
                scores.append(float(1 / np.exp(logs - logs[best]).sum()))
            held = ["id", *(["row"] if carry else [])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in held), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*held, "lang_pred", "score"])

    rows = docs.select(
        field(id_col).alias("id"),
        *([whole_row(docs)] if carry else []),
        unicode_text(text_col).alias("text"),
    )
    schema = T.StructType([f for f in rows.schema.fields if f.name != "text"]).add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    """The fold that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(field(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
