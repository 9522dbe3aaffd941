"""Language of documents, by a linear-chain conditional random field over their words.

States are the languages; a word's emission is the sum of learned weights of its affixes, its character n-grams and, if
the lexicon has it, the languages it is listed for; transitions between words are learned as well. The lexicon is a table
of words for each language, learned from the sample: words of at least two of its documents, listed for every language that
has a fifth of their uses. Training sequences are spans of documents of one language, and code-switched ones that are
spliced from spans of several, so staying and switching both are learned. Forward-backward gives the probability of each
language at each word; a document's language has the largest sum of them, and the score is its share.

Training runs on a bounded, documented sample: at most ``SAMPLE`` labelled documents, those with the smallest hashed ids, and
of each at most ``SPANS`` spans of ``SPAN`` words from places all over its text (a text of no more words is taken whole).
The spans are cut on the executors, so only they reach the driver. Stochastic gradients of the sequence likelihood follow. Prediction reads
every whole text, in Arrow batches: the words of a batch are laid out in blocks, transfer matrices of the blocks are
multiplied first, then messages pass from block to block and inside all blocks at once, so that a very long text costs no
more for each word than a short one.

Words are maximal runs of letters, in lower case; a run of more than ``LETTERS_MOST`` letters is several words, one after
another, so that each of its letters counts. Defined results: a text that is null or has no letter is ``und`` with
score 0. A tie goes to the first language by name. Training ignores null languages and null texts; without any labelled
document all languages are ``und``. Of rows that repeat an id, one is learned from, the least by language and words. Rows
with null or repeated ids are predicted as any others (held_out is null for a null id). An empty table gives an
empty result. Other columns may have any names.
"""

from __future__ import annotations

import functools
import pickle
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, tidy

#: Documents to learn from, the spans of each, and the words of a span.
SAMPLE, SPANS, SPAN = 600, 3, 80
#: Share of a document that its language must have to be its language in a filter.
LEAST_SHARE = 0.5
#: Letters of a word.
LETTERS_MOST = 24
#: Hashed features; those of one word are at most the columns below.
WIDTH = 1 << 15
BLOCK = 48
LETTERS = re.compile(r"[^\W\d_]{1,%d}" % LETTERS_MOST)
#: Words whose emissions a worker keeps.
KEPT = 60_000


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


Lexicon = dict[str, tuple[int, ...]]


def features(words: list[str], lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Hashed prefixes, suffixes and n-grams with borders, and the word's languages in the lexicon: which word, which feature."""
    texts = [f"<{w}>" for w in words]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    of = np.repeat(np.arange(len(words)), sizes)
    after = ends[of] - np.arange(len(chars))  # characters from here to the end of the word
    which, hashed = [], []
    listed = [(i, k) for i, w in enumerate(words) for k in lexicon.get(w, ())]

    def gram(kind: int, word: np.ndarray, at: np.ndarray, n: int) -> None:
        h = np.full(len(at), kind, np.uint64)
        for i in range(n):
            h = (h ^ chars[at + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        which.append(word)
        hashed.append(h)

    for n in (2, 3):
        at = np.flatnonzero(after >= n)
        gram(n, of[at], at, n)
    for n in (1, 2, 3):
        word = np.flatnonzero(sizes >= n + 2)
        gram(3 + n, word, begins[word] + 1, n)
        gram(6 + n, word, ends[word] - 1 - n, n)
    ids = (np.concatenate(hashed) % np.uint64(WIDTH)).astype(np.int64)
    own, language = np.array(listed, np.int64).reshape(-1, 2).T
    return np.concatenate([*which, own]), np.concatenate([ids, WIDTH + language])


def lexicon_of(split: list[tuple[list[str], int]]) -> Lexicon:
    """From words and language of each document."""
    uses: dict[str, Counter] = {}
    docs: Counter = Counter()
    for words, y in split:
        for w in words:
            uses.setdefault(w, Counter())[y] += 1
        docs.update(set(words))
    return {w: tuple(sorted(y for y, n in c.items() if 5 * n >= c.total())) for w, c in uses.items() if docs[w] > 1}


def scored(words: list[str], weights: np.ndarray, found: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Emission scores of each word, whose features are found."""
    which, ids = found
    return np.stack([np.bincount(which, weights[ids, k], len(words)) for k in range(weights.shape[1])], axis=1)


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, start: np.ndarray, moves: np.ndarray, lexicon: Lexicon):
        self.languages, self.weights, self.start, self.moves, self.lexicon = languages, weights, start, moves, lexicon
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(languages)))

    def emissions(self, words: list[str]) -> np.ndarray:
        """Row of emission scores for each word."""
        fresh = [w for w in dict.fromkeys(words) if w not in self.known]
        if fresh:
            if len(self.known) + len(fresh) > KEPT:
                self.known, self.rows = {}, self.rows[:0]
                fresh = list(dict.fromkeys(words))
            at = len(self.known)
            self.known.update(zip(fresh, range(at, at + len(fresh)), strict=True))
            if at + len(fresh) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((max(len(fresh), len(self.rows)), self.rows.shape[1]))])
            self.rows[at : at + len(fresh)] = scored(fresh, self.weights, features(fresh, self.lexicon))
        return self.rows[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]

    def shares(self, texts: list[list[str]]) -> np.ndarray:
        """For each text, a list of at least one word, the mean probability of each language over its words."""
        sizes = np.array([len(t) for t in texts])
        scores = self.emissions([w for t in texts for w in t])
        return np.stack([*marginals(scores, sizes, self.start, self.moves)])


def marginals(scores: np.ndarray, sizes: np.ndarray, start: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Mean state probabilities of each sequence by forward-backward, over blocks of BLOCK words at once.

    scores: a row for each word, the sequences one after another; sizes: words of each sequence, none 0.
    """
    k = scores.shape[1]
    blocks = -(-sizes // BLOCK)
    of = np.repeat(np.arange(len(sizes)), blocks)  # sequence of each block
    first = np.cumsum(blocks) - blocks
    last = np.cumsum(blocks) - 1
    begin = np.cumsum(sizes) - sizes
    number = np.arange(len(of)) - first[of]
    length = np.minimum(BLOCK, sizes[of] - number * BLOCK)
    places = (begin[of] + number * BLOCK)[:, None] + np.arange(BLOCK)
    real = np.arange(BLOCK) < length[:, None]
    emit = np.exp(scores - scores.max(1, keepdims=True))[np.where(real, places, 0)]  # block, step, state
    step = np.exp(moves)
    # A block's transfer matrix leads from the state before its first word to the state at its last.
    whole = np.broadcast_to(np.eye(k), (len(of), k, k)).copy()
    for t in range(BLOCK):
        on = real[:, t]
        more = (whole[on] @ step) * emit[on, t][:, None, :]
        whole[on] = more / more.sum((1, 2), keepdims=True)
    # The first word of a sequence has the start scores instead of a transition: a row that yields them.
    enter = np.empty((len(of), k))
    leave = np.empty((len(of), k))
    lead = np.linalg.solve(step.T, np.exp(start))  # lead @ step = exp(start)
    enter[first] = lead
    leave[last] = 1.0
    for d in range(1, blocks.max()):
        at = (first + d)[blocks > d]
        x = np.einsum("bi,bij->bj", enter[at - 1], whole[at - 1])
        enter[at] = x / np.abs(x).sum(1, keepdims=True)
        at = (last - d)[blocks > d]
        x = np.einsum("bij,bj->bi", whole[at + 1], leave[at + 1])
        leave[at] = x / x.sum(1, keepdims=True)
    ahead = np.empty_like(emit)
    now = enter
    for t in range(BLOCK):
        x = (now @ step) * emit[:, t]
        x = x / x.sum(1, keepdims=True)
        ahead[:, t] = x
        now = np.where(real[:, t][:, None], x, now)
    total = np.zeros((len(of), k))
    back = leave
    for t in range(BLOCK - 1, -1, -1):
        on = real[:, t][:, None]
        x = ahead[:, t] * back
        total += np.where(on, x / x.sum(1, keepdims=True), 0)
        y = (emit[:, t] * back) @ step.T
        back = np.where(on, y / y.sum(1, keepdims=True), back)
    return np.add.reduceat(total, first, axis=0) / sizes[:, None]


def spans_of(text: str, seed: int) -> list[list[str]]:
    """The words of a text, or of SPANS spans that begin anywhere in it."""
    words = LETTERS.findall(text.lower())
    if len(words) <= SPANS * SPAN:
        return [words[i : i + SPAN] for i in range(0, len(words), SPAN)]
    rng = random.Random(seed)
    return [words[at : at + SPAN] for at in sorted(rng.randrange(len(words) - SPAN + 1) for _ in range(SPANS))]


def learn(docs: list[tuple[list[list[str]], str]], seed: int = 7, epochs: int = 3, rate: float = 0.25) -> Model | None:
    """From (spans of words, language); Adagrad on the likelihood of the state sequences."""
    languages = sorted({lang for _, lang in docs})
    spans = [(span, languages.index(lang)) for own, lang in docs for span in own if span]
    split = [([w for span in own for w in span], languages.index(lang)) for own, lang in docs if any(own)]
    if not split:
        return None
    k, rng, lexicon = len(languages), random.Random(seed), lexicon_of(split)
    sequences = [(words, [y] * len(words)) for words, y in spans]
    for _ in range(len(sequences) // 3):  # code-switched: spans of documents, one after another
        words, states = [], []
        for _ in range(rng.randint(2, 4)):
            own, y = rng.choice(split)
            at, n = rng.randrange(len(own)), rng.randint(5, 40)
            words += own[at : at + n]
            states += [y] * len(own[at : at + n])
        sequences.append((words, states))
    weights, start, moves = np.zeros((WIDTH + k, k)), np.zeros(k), np.zeros((k, k))
    grown = [np.full_like(x, 1e-2) for x in (weights, start, moves)]
    known = [features(words, lexicon) for words, _ in sequences]
    order = list(range(len(sequences)))
    for _ in range(epochs):
        rng.shuffle(order)
        for at in order:
            (words, states), (which, ids) = sequences[at], known[at]
            node, pair = expected(scored(words, weights, (which, ids)), start, moves)
            y = np.array(states)
            node[np.arange(len(y)), y] -= 1
            np.subtract.at(pair, (y[:-1], y[1:]), 1)
            rows, inverse = np.unique(ids, return_inverse=True)
            gradient = np.stack([np.bincount(inverse, node[which, j], len(rows)) for j in range(k)], axis=1)
            gradient += 1e-3 * weights[rows]
            grown[0][rows] += gradient**2
            weights[rows] -= rate * gradient / np.sqrt(grown[0][rows])
            for x, g, s in ((start, node[0], 1), (moves, pair, 2)):
                g = g + 1e-2 * x
                grown[s] += g**2
                x -= rate * g / np.sqrt(grown[s])
    moves = np.clip(moves, -8, 8) + 1e-6 * np.eye(k)
    return Model(languages, weights.astype(np.float32), start, moves, lexicon)


def expected(scores: np.ndarray, start: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State probabilities of each word, and expected transitions, of one sequence."""
    n, k = scores.shape
    emit, step = np.exp(scores - scores.max(1, keepdims=True)), np.exp(moves)
    ahead, back = np.empty((n, k)), np.empty((n, k))
    x = np.exp(start - start.max()) * emit[0]
    ahead[0] = x / x.sum()
    for t in range(1, n):
        x = (ahead[t - 1] @ step) * emit[t]
        ahead[t] = x / x.sum()
    back[-1] = 1
    for t in range(n - 2, -1, -1):
        x = step @ (emit[t + 1] * back[t + 1])
        back[t] = x / x.sum()
    node = ahead * back
    node /= node.sum(1, keepdims=True)
    pair = np.einsum("ti,ij,tj->tij", ahead[:-1], step, emit[1:] * back[1:]) if n > 1 else np.zeros((0, k, k))
    pair = (pair / pair.sum((1, 2), keepdims=True)).sum(0) if n > 1 else np.zeros((k, k))
    return node, pair


def sample(docs: DataFrame, most: int = SAMPLE) -> list[tuple[list[list[str]], str]]:
    """Spans and language of at most so many labelled documents that are not held out: those with the smallest hashed ids. Only ids are ordered."""
    able = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id", F.lit(3))
    chosen = able.select("doc_id", order.alias("o")).distinct().orderBy("o", "doc_id").limit(most).select("doc_id")
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [spans_of(t, zlib.crc32(str(d).encode())) for d, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, pa.list_(pa.list_(pa.string())))], names=["doc_id", "lang", "spans"])

    rows = able.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text", F.col("doc_id").alias("own"))
    rows = rows.join(F.broadcast(chosen.withColumnRenamed("doc_id", "own")), "own").select("doc_id", "lang", "text")
    rows = rows.mapInArrow(tidy(cut), "doc_id string, lang string, spans array<array<string>>")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("lang", "spans")).alias("x")).orderBy("doc_id").collect()  # `most` rows of a few spans
    return [(r.x.spans, r.x.lang) for r in rows]


@functools.lru_cache(maxsize=1)
def loaded(data: bytes) -> Model:
    return pickle.loads(data)


def forget() -> None:
    loaded.cache_clear()


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """row (a struct of all columns), lang_pred, score. docs has a column text."""
    small_batches(docs.sparkSession)
    data = model and pickle.dumps(Model(model.languages, model.weights, model.start, model.moves, model.lexicon))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = ["und"] * b.num_rows, np.zeros(b.num_rows)
            words = [LETTERS.findall((t or "").lower()) for t in b.column(0).field(place).to_pylist()]
            full = [i for i, w in enumerate(words) if w] if data else []
            while full:  # some ten thousand words at once
                part, size = [], 0
                while full and (not part or size + len(words[full[-1]]) <= 60_000):
                    part.append(full.pop())
                    size += len(words[part[-1]])
                own = loaded(data)
                shares = own.shares([words[i] for i in part])
                best = shares.argmax(1)
                scores[part] = np.clip(shares[np.arange(len(part)), best], 0, 1)
                for i, k in zip(part, best, strict=True):
                    langs[i] = own.languages[k]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores)], names=["row", "lang_pred", "score"])

    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(tidy(run, forget), schema)


def languages(docs: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    model = learn(sample(docs, most))
    out = predicted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return out.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


def in_some_language(docs: DataFrame, least: float = LEAST_SHARE, most: int = SAMPLE) -> DataFrame:
    """The rows of docs, with all their columns, in which one language has a share of at least ``least``; a null lang becomes that language.

    Rows without a letter go. Where nothing can be learned from (no row has a language), all others stay as they are.
    """
    model = learn(sample(docs, most))
    if model is None:
        return docs.where(F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False)))
    out = predicted(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    own = lambda c: F.coalesce("row.lang", "lang_pred") if c == "lang" else F.col(f"row.`{c}`")
    return out.select(*(own(c).alias(c) for c in docs.columns))
