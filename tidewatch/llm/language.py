"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary. Each language has a probability for
every piece, and a word's probability is the sum over all its segmentations into
pieces, by the forward algorithm. Pieces never cross a word boundary, so a text's sum
is the product of its words' sums, and each distinct word is run once per batch. Words of
usual length go through it in blocks; those beyond `SHORT` characters, and those whose sum
would be too small a number (scripts that are spelled in bytes), are run one by one in
logarithms, whole however long they are.

The probabilities are learned by expectation maximisation over the distinct words of
the training texts: forward and backward sums give the expected use of each piece.
Training takes about `sample` labelled rows, the same number of each language, chosen by
a hash of key and text, and all rows of a language that has fewer; the model hardly changes
beyond that. Prediction is over every text.
A task returns its sums over the vocabulary, whatever the number of its words, and
only the table of pieces by languages reaches the driver.

Defined cases: NULL texts and texts without a letter are `und` with score 0, as are all
texts if nothing was learned; rows without a label are not learned from; a tie goes to
the first language by name; repeated rows are learned from and scored as often as
they occur. More labels than `MAX_LANGUAGES` raise an error rather than lose any.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.texts import SPACE
from tidewatch.session import stored

VOCABULARY = "piece_bpe_32k.model"
ROUNDS = 2
#: About how many labelled rows are learned from.
SAMPLE = 20_000
SMOOTHING = 0.1
#: Bounds the model that every task holds.
MAX_LANGUAGES = 200
UNKNOWN = "und"
#: Words per block of the forward algorithm, and the longest word that goes into one.
BLOCK, SHORT = 8192, 40
#: Sums below this are taken again in logarithms.
TINY = 1e-250
EDGE = "▁"


class Pieces(dict):
    """Piece to index, and every proper prefix of a piece to -1."""

    @cached_property
    def trie(self) -> "Trie":
        return Trie(self)


class Trie:
    """The same as sorted edges, so that many positions of many texts go a letter further at once."""

    def __init__(self, pieces: Pieces):
        node = {piece: i + 1 for i, piece in enumerate(pieces)}
        edges = np.array([node.get(piece[:-1], 0) << 21 | ord(piece[-1]) for piece in node], np.int64)
        order = np.argsort(edges)
        self.edges, self.target = edges[order], order + 1
        #: Of each node its piece, or -1.
        self.piece = np.array([-1, *pieces.values()], np.int64)

    def step(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The node behind each node's edge of that letter, 0 if there is none."""
        wanted = nodes << 21 | letters
        at = np.minimum(np.searchsorted(self.edges, wanted), len(self.edges) - 1)
        return np.where(self.edges[at] == wanted, self.target[at], 0)


def read_pieces(vocabulary: str = VOCABULARY) -> Pieces:
    """The pieces of a vocabulary; characters outside it are spelled with its 256 byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))
    pieces = Pieces()
    for i in range(model.vocab_size()):
        text = model.id_to_piece(i)
        if not (model.is_control(i) or model.is_unknown(i)) and EDGE not in text[1:]:
            pieces[text] = i
    for piece in list(pieces):
        for end in range(1, len(piece)):
            pieces.setdefault(piece[:end], -1)
    return pieces


def _spelling(letter: str, pieces: Pieces) -> list[int]:
    return [i for i in (pieces.get(f"<0x{b:02X}>", -1) for b in letter.encode()) if i >= 0]


class Lattice:
    """The arcs of many words, by position, as arrays.

    An arc is a piece, or the byte spelling of a character that is no piece. `p` below
    is the probability table, a row per piece and a last row of ones.
    """

    def __init__(self, words: list[str], pieces: Pieces, ones: int):
        trie = pieces.trie
        letters = np.frombuffer("".join([EDGE + word for word in words]).encode("utf-32-le"), "<u4").astype(np.int64)
        self.lengths = np.array([len(word) + 1 for word in words], np.int64)
        word = np.repeat(np.arange(len(words)), self.lengths)
        start = np.arange(len(letters)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        left = self.lengths[word] - start
        # all positions go on together, each as long as there are pieces that begin so
        live, nodes, size, found = np.arange(len(letters)), np.zeros(len(letters), np.int64), 0, []
        unspelled = live
        while len(live):
            nodes = trie.step(nodes, letters[live + size])
            size += 1
            piece = trie.piece[nodes]
            whole = piece >= 0
            found.append((live[whole], size, piece[whole]))
            if size == 1:
                unspelled = np.flatnonzero(~whole)
            onward = (nodes > 0) & (left[live] > size)
            live, nodes = live[onward], nodes[onward]
        found.append((unspelled, 1, np.full(len(unspelled), ones)))
        at = np.concatenate([places for places, _, _ in found])
        self.first = np.concatenate([piece for _, _, piece in found])
        self.word, self.start = word[at], start[at]
        self.end = self.start + np.repeat([n for _, n, _ in found], [len(places) for places, _, _ in found])
        used = {letter: _spelling(chr(letter), pieces) for letter in set(letters[unspelled].tolist())}
        begin = len(at) - len(unspelled)
        self.spelled = [(begin + i, used[letter]) for i, letter in enumerate(letters[unspelled].tolist())]

    def arc_p(self, p: np.ndarray) -> np.ndarray:
        out = p[self.first]
        for arc, used in self.spelled:
            out[arc] = p[used].prod(axis=0) if used else 1e-12
        return out

    def _sweep(self, arc_p: np.ndarray, source: np.ndarray, target: np.ndarray, order: np.ndarray, begin: np.ndarray,
               steps: range) -> np.ndarray:
        """Sums over all paths that reach each position."""
        n, top = len(self.lengths), int(self.lengths.max(initial=0))
        sums = np.zeros((n, top + 1, arc_p.shape[1]))
        sums[np.arange(n), begin] = 1.0
        at = np.searchsorted(target[order], np.arange(top + 2))
        for step in steps:
            chosen = order[at[step]:at[step + 1]]
            if len(chosen):
                words = self.word[chosen]
                flow = sums[words, source[chosen]] * arc_p[chosen]
                heads = np.flatnonzero(np.diff(words, prepend=-1))
                sums[words[heads], step] += np.add.reduceat(flow, heads, axis=0)
        return sums

    def forward(self, arc_p: np.ndarray) -> np.ndarray:
        order = np.lexsort((self.word, self.end))
        return self._sweep(arc_p, self.start, self.end, order, np.zeros(len(self.lengths), np.int64),
                           range(1, int(self.lengths.max(initial=0)) + 1))

    def backward(self, arc_p: np.ndarray) -> np.ndarray:
        order = np.lexsort((self.word, self.start))
        return self._sweep(arc_p, self.end, self.start, order, self.lengths,
                           range(int(self.lengths.max(initial=0)) - 1, -1, -1))

    def sums(self, p: np.ndarray) -> np.ndarray:
        """Each word's sum over all segmentations, per language; 0 where it is too small a number."""
        sums = self.forward(self.arc_p(p))
        return sums[np.arange(len(self.lengths)), self.lengths]

    def expected(self, p: np.ndarray, weights: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Adds the expected uses of each piece, words weighted per language, to `total`.

        Words whose sum is tiny add nothing; their numbers are returned.
        """
        arc_p = self.arc_p(p)
        ahead, behind = self.forward(arc_p), self.backward(arc_p)
        whole = ahead[np.arange(len(self.lengths)), self.lengths]
        tiny = (whole < TINY).any(axis=1)
        weights = np.where(tiny[:, None], 0.0, weights)
        whole = np.maximum(whole, TINY)
        use = ahead[self.word, self.start] * arc_p * behind[self.word, self.end] * (weights / whole)[self.word]
        for lang in range(total.shape[1]):
            total[:, lang] += np.bincount(self.first, weights=use[:, lang], minlength=len(total))
        for arc, used in self.spelled:
            for piece in used:
                total[piece] += use[arc]
        return np.flatnonzero(tiny)


class LongWord:
    """One word of any length, in logarithms; `log_p` is the logarithm of the probability table."""

    def __init__(self, word: str, pieces: Pieces, log_p: np.ndarray):
        text, get = EDGE + word, pieces.get
        self.n, self.arcs = len(text), []
        for start in range(self.n):
            for end in range(start + 1, self.n + 1):
                piece = get(text[start:end])
                if piece is None:
                    break
                if piece >= 0:
                    self.arcs.append((start, end, [piece], log_p[piece]))
            if get(text[start], -1) < 0:
                used = _spelling(text[start], pieces)
                cost = log_p[used].sum(axis=0) if used else np.full(log_p.shape[1], np.log(1e-12))
                self.arcs.append((start, start + 1, used, cost))
        self.ahead = np.full((self.n + 1, log_p.shape[1]), -np.inf)
        self.ahead[0] = 0.0
        for start, end, _, cost in self.arcs:  # in order of their start
            self.ahead[end] = np.logaddexp(self.ahead[end], self.ahead[start] + cost)

    def log_sum(self) -> np.ndarray:
        return self.ahead[self.n]

    def expected(self, weights: np.ndarray, total: np.ndarray) -> None:
        behind = np.full_like(self.ahead, -np.inf)
        behind[self.n] = 0.0
        for start, end, _, cost in reversed(self.arcs):
            behind[start] = np.logaddexp(behind[start], cost + behind[end])
        for start, end, used, cost in self.arcs:
            use = weights * np.exp(self.ahead[start] + cost + behind[end] - self.ahead[self.n])
            for piece in used:
                total[piece] += use


def _logs(p: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(p, 1e-300))


def log_words(words: list[str], pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Log probability of each word per language."""
    out = np.zeros((len(words), p.shape[1]))
    sizes = np.array(list(map(len, words)), np.int64)
    # words of about the same length share a block
    order = np.argsort(sizes, kind="stable").tolist()
    short, single = order[:int((sizes <= SHORT).sum())], order[int((sizes <= SHORT).sum()):]
    for at in range(0, len(short), BLOCK):
        block = short[at:at + BLOCK]
        sums = Lattice([words[i] for i in block], pieces, len(p) - 1).sums(p)
        out[block] = np.log(np.maximum(sums, TINY))
        single += [block[i] for i in np.flatnonzero((sums < TINY).any(axis=1))]
    logs = _logs(p) if single else None
    for i in single:
        out[i] = LongWord(words[i], pieces, logs).log_sum()
    return out


@dataclass
class Model:
    """Languages by name and the probability of each piece in each of them."""

    languages: list[str]
    p: np.ndarray
    vocabulary: str = VOCABULARY


def fit(texts: DataFrame, text: str = "text", lang: str = "lang", rounds: int = ROUNDS, sample: int = SAMPLE,
        vocabulary: str = VOCABULARY, key: str | None = None) -> Model:
    """Piece probabilities from about `sample` labelled rows, the same number of each language.

    `key` tells copies of a text apart when rows are drawn.
    """
    drawn = F.xxhash64(text, key) if key else F.xxhash64(text)
    labelled = texts.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), drawn.alias("h"))
    labelled = labelled.dropna(subset=["lang", "text"])
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    bound = F.lit(None).cast("bigint")
    for row in sizes:
        share = sample / len(sizes) / row.n
        if share < 1:
            # the hash is taken of all 64 bits, the lowest share of its range is kept
            bound = F.when(F.col("lang") == row.lang, int((2 * share - 1) * 2 ** 63)).otherwise(bound)
    labelled = labelled.filter(F.coalesce(F.col("h") < bound, F.lit(True)))
    words = labelled.select("lang", F.explode(F.split("text", SPACE)).alias("word")).filter("word <> ''")
    words = stored(words.groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    languages = sorted(r.lang for r in words.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    pieces = read_pieces(vocabulary)
    size, width = max(pieces.values()) + 1, len(languages)
    used = np.array(sorted({i for i in pieces.values() if i >= 0}))
    p = np.zeros((size + 1, width))
    p[used] = 1 / len(used)
    p[size] = 1.0
    for _ in range(rounds if languages else 0):
        counts = words.mapInArrow(_expectation(p, languages, vocabulary), "piece int, lang int, n double")
        total = np.zeros_like(p)
        # at most a row per piece and language
        sums = counts.groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        total[sums["piece"].to_numpy(int), sums["lang"].to_numpy(int)] = sums["n"].to_numpy(float)
        total[used] += SMOOTHING
        p = total / total.sum(axis=0)
        p[size] = 1.0
    return Model(languages, p, vocabulary)


def _expectation(p: np.ndarray, languages: list[str], vocabulary: str):
    column = {name: i for i, name in enumerate(languages)}

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, total = read_pieces(vocabulary), np.zeros_like(p)
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))))
            single = [row for row in rows if len(row[1]) > SHORT]
            short = [row for row in rows if len(row[1]) <= SHORT]
            for i in range(0, len(short), BLOCK):
                block = short[i:i + BLOCK]
                weights = np.zeros((len(block), len(languages)))
                weights[np.arange(len(block)), [column[lang] for lang, _, _ in block]] = [n for _, _, n in block]
                tiny = Lattice([word for _, word, _ in block], pieces, len(p) - 1).expected(p, weights, total)
                single += [block[j] for j in tiny]
            logs = _logs(p) if single else None
            for lang, word, n in single:
                weights = np.zeros(len(languages))
                weights[column[lang]] = n
                LongWord(word, pieces, logs).expected(weights, total)
        piece, lang = np.nonzero(total[:-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(total[piece, lang])],
            names=["piece", "lang", "n"])

    return summed


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`id`, `lang_pred` and `score` (the posterior under equal priors) of every row."""
    slim = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    languages, p, vocabulary = model.languages, model.p, model.vocabulary

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = read_pieces(vocabulary)
        for batch in batches:
            index: defaultdict[bytes, int] = defaultdict()
            index.default_factory = index.__len__
            rows = []
            for value in batch.column("text"):
                body = value.as_py()
                if body is None or not languages or not any(map(str.isalpha, body)):
                    rows.append(None)
                    continue
                rows.append(np.array(list(map(index.__getitem__, body.encode().split())), np.int64))
            table = log_words([w.decode() for w in index], pieces, p)
            names, scores = [], []
            for ids in rows:
                if ids is None:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                logs = np.zeros(len(languages))
                for i in range(0, len(ids), BLOCK):
                    logs += table[ids[i:i + BLOCK]].sum(axis=0)
                best = int(logs.argmax())
                names.append(languages[best])
                scores.append(float(1 / np.exp(logs - logs[best]).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["id", "lang_pred", "score"])

    return slim.mapInArrow(scored, f"id {kind}, lang_pred string, score double")


def fold(key: Column, folds: int = 5) -> Column:
    """Remainder of the CRC-32 of a key as text; NULL for a NULL key."""
    return F.crc32(key.cast("string")) % folds
