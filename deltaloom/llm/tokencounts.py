"""Token counts by a look-up in two tiers on the map side: a broadcast table of frequent pre-tokens, then worker caches.

A vocabulary whose pre-tokens never hold white space gives a text the tokens of its runs between ASCII white space, one
run after the other; such a run is a pre-token here. First every task counts the pre-tokens of its texts in a summary of
bounded size, and the summaries are merged in two steps, whole summaries at a time, so that no pre-token is ever the key of a
shuffle. The heaviest pre-tokens of all texts are encoded once, and their numbers of tokens go to every worker as one
compact table. A pre-token outside the table is looked up in the cache of its Python worker, which lives on from task
to task, and is encoded by the library on a miss. The summaries choose what is fast and never what is counted.

Vocabularies with white space in their pre-tokens (byte-level ones that keep a leading space, sentencepiece models) have no
such independent runs; their texts are encoded whole by the library.

Defined results: a null text counts as an empty one, with 0 bytes and 0 tokens. Texts of any length are read whole, in slices that
end at white space; a run without white space is encoded as one, however long. Each row is counted on its own, so rows
that repeat an id or a text stay, null ids too. Strings of special tokens inside a text are handled as the library does by default. An
empty table gives an empty result. Other columns may have any names and are not read.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import uuid
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .common import small_batches, tidy

#: Entries of the broadcast table, of a task's summary and of half a worker's cache, longest pre-token (bytes) that they hold.
TABLE, SUMMARY, CACHE, LONGEST = 131_072, 32_768, 262_144, 64
#: Bytes of a text that are split at once, summaries that the driver merges.
SLICE, LAST = 1 << 20, 8
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: ASCII letters with marks behind them: two pre-tokens of a vocabulary that parts letters from the rest.
MARKED = re.compile(rb"([A-Za-z]+)([,.;:!?]+)")
#: What a worker holds from task to task: tables by their key, caches by the path of the vocabulary.
TABLES: dict[str, dict[bytes, int]] = {}
CACHES: dict[str, Cache] = {}


def slices(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about SLICE bytes that end at white space."""
    at = 0
    while len(text) - at > SLICE:
        cut = SPACE.search(text, at + SLICE)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def library(path: str):
    """The library's tokenizer for the file at path."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def whole_text_length(path: str) -> Callable[[str], int]:
    """Number of tokens of a text by the library, without tokens that are not in the text."""
    own = library(path)
    if path.endswith(".model"):
        return lambda text: len(own.encode(text))
    return lambda text: len(own.encode(text, add_special_tokens=False))


class Form(NamedTuple):
    """Whether white space always ends a token and is no token; whether a run of ASCII letters is, in lower case, one word of the model, whatever stands beside it."""

    parted: bool
    letters: bool


def form(path: str) -> Form:
    """Only forms that are known to be so count. Special tokens must not take white space in at their sides or hold it."""
    if not path.endswith(".json"):
        return Form(False, False)
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    before = rules.get("pre_tokenizer") or {}
    first, *others = before["pretokenizers"] if before.get("type") == "Sequence" else [before]
    kept = first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed"
    # Fixed value: alternatives of letters, digits and the rest; none matches white space.
    known = kept and first.get("pattern", {}).get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    steps = (rules.get("normalizer") or {}).get("normalizers", [rules.get("normalizer") or {"type": "NFC"}])
    plain = all(s["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase") or (s["type"], s["pattern"], s["content"]) == ("Replace", {"Regex": r"\s+"}, " ") for s in steps)
    special = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])) for t in rules.get("added_tokens", []))
    parted = bool((known or first.get("type") in ("Whitespace", "WhitespaceSplit")) and special and plain)
    bytewise = all((p["type"], p["add_prefix_space"], p["use_regex"]) == ("ByteLevel", False, False) for p in others)
    unmarked = all(re.search(r"[^A-Za-z,.;:!?]", t["content"]) for t in rules.get("added_tokens", []))  # no special token lies within letters and marks
    return Form(parted, bool(parted and known and others and bytewise and unmarked and any(s["type"] == "Lowercase" for s in steps)))


class Cache:
    """Lengths of rare pre-tokens in two generations: what is asked for stays, the rest goes when the younger one is full."""

    def __init__(self, path: str, letters: bool = False):
        self.encode = whole_text_length(path)
        self.model = library(path).model if letters else None
        self.young: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    def encoded(self, word: bytes) -> int:
        """By the library: its model alone for a word of letters, the parts of a word with marks, the whole tokenizer for others."""
        if self.model and word.isalpha():
            return len(self.model.tokenize(word.lower().decode("ascii")))
        if self.model and (parts := MARKED.fullmatch(word)):
            return self.length(parts[1]) + self.length(parts[2])
        return self.encode(word.decode("utf-8"))

    def length(self, word: bytes) -> int:
        n = self.young.get(word)
        if n is None:
            n = self.old.get(word)
            if n is None:
                n = self.encoded(word)
            if len(word) <= LONGEST:
                if len(self.young) >= CACHE:
                    self.old, self.young = self.young, {}
                self.young[word] = n
        return n


class Lengths(dict):
    """The frequent pre-tokens; others come from the worker's cache."""

    def __init__(self, table: dict[bytes, int], cache: Cache):
        super().__init__(table)
        self.cache = cache

    def __missing__(self, word: bytes) -> int:
        return self.cache.length(word)


def heaviest(counts: Counter, most: int) -> Counter:
    return Counter(dict(heapq.nlargest(most, counts.items(), key=lambda x: (x[1], x[0]))))


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    """The UTF-8 of each text, empty for null."""
    return [t or b"" for t in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()]


def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a task: its heaviest pre-tokens with their counts."""
    counts: Counter = Counter()
    for b in batches:
        for text in texts_of(b):
            for part in slices(text):
                counts.update(part.split())
                if len(counts) > 16 * SUMMARY:
                    counts = heaviest(counts, 2 * SUMMARY)
    yield row_of(counts, SUMMARY)


def row_of(counts: Counter, most: int) -> pa.RecordBatch:
    top = heaviest(Counter({w: n for w, n in counts.items() if len(w) <= LONGEST}), most)
    return pa.RecordBatch.from_arrays([pa.array([list(top)], pa.list_(pa.binary())), pa.array([list(top.values())], pa.list_(pa.int64()))], names=["words", "counts"])


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for all summaries of a task."""
    counts: Counter = Counter()
    for b in batches:
        for words, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            counts.update(dict(zip(words, n, strict=True)))
            if len(counts) > 4 * TABLE:
                counts = heaviest(counts, TABLE)
    yield row_of(counts, TABLE)


def frequent(texts: DataFrame) -> list[bytes]:
    """The heaviest pre-tokens of all texts: summaries of tasks are merged in as many tasks as a shuffle has, then in LAST ones, then here."""
    schema = "words array<binary>, counts array<bigint>"
    one = texts.mapInArrow(tidy(summarised), schema)
    some = one.repartition(F.spark_partition_id()).mapInArrow(tidy(merged), schema)
    counts: Counter = Counter()
    for row in some.repartition(LAST, F.spark_partition_id()).mapInArrow(tidy(merged), schema).toLocalIterator():
        counts.update({bytes(w): n for w, n in zip(row.words, row.counts, strict=True)})
    return list(heaviest(counts, TABLE))


def lengths_by(table: Broadcast | None, path: str, letters: bool) -> Callable[[bytes], int]:
    """A worker's counter of tokens of one text."""
    if path not in CACHES:
        CACHES[path] = Cache(path, letters)
    cache = CACHES[path]
    if table is None:
        return lambda text: cache.encode(text.decode("utf-8"))
    key, words, sizes = table.value
    if key not in TABLES:
        TABLES.clear()
        TABLES[key] = Lengths(dict(zip(words.split(b" "), array("L", sizes), strict=True)) if words else {}, cache)
    look = TABLES[key].__getitem__
    return lambda text: sum(sum(map(look, part.split())) for part in slices(text))


def counted(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs (doc_id, text) by the vocabulary at path, a place that every worker can read."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", "text")
    table = None
    kind = form(path)
    if kind.parted:
        words = frequent(rows.select("text"))
        encoded = Cache(path, kind.letters).encoded
        lengths = array("L", map(encoded, words))
        table = spark.sparkContext.broadcast((uuid.uuid4().hex, b" ".join(words), lengths.tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = lengths_by(table, path, kind.letters)
        for b in batches:
            n = pa.array([length(t) for t in texts_of(b)], pa.int64())
            size = pc.fill_null(pc.binary_length(b.column(1)).cast(pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([b.column(0), size, n, pc.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    more = [StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())]
    return rows.mapInArrow(tidy(run), StructType([rows.schema["doc_id"], *more]))
