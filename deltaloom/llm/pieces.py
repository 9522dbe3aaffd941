"""SentencePiece encoding that keeps the place of every piece in the original bytes, and decoding.

The model's normaliser is applied here, byte for byte: at each place the longest key of the compiled character map (a
double-array trie over UTF-8) is replaced, else one character stays; spaces are collapsed if the model says so, a dummy
prefix is set, and white space becomes the visible space sign. Each byte of the result keeps the place in the original it
came from. A byte-pair model is applied here too: of the neighbouring symbols whose union is a piece, the pair with the best
score merges first, of equal ones the first; what no piece covers becomes byte pieces or the unknown piece. Where no piece holds
a space sign behind another sign, words are encoded one by one and the latest ones are kept. A word ends where no piece can go on:
before a space sign, on either side of a character that no longer piece holds, and between a letter and a mark that no piece has behind letters. Other models are segmented by the
library, whose pieces run over the same normalised text. The byte lengths of the pieces and the
kept places turn the borders of each piece into a half-open span of original bytes. Spans follow one another without gaps
from the first byte that the normaliser keeps; begin and end ids have empty spans. Decoding is the library's.

Tasks read Arrow batches of bounded size; the model travels with the task as its serialised bytes, so executors need no
file. A very long text is encoded whole, in time that grows with n log n for n characters without a space. A null text is encoded as the empty text. Rows with null or repeated ids are rows as any others. An empty table
gives an empty result. Other columns may have any names; only the columns named are read. A byte-pair model with pieces
that are user-defined or unused is refused with a ValueError.
"""

from __future__ import annotations

import array
import functools
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy

SPACE_SIGN = "▁".encode()
NEVER = float("-inf")
#: Words that a worker keeps: so many of the latest, and at most as many of those before.
KEPT = 60_000


class CharacterMap:
    """The compiled map of a model: trie size, double-array units, then the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        n = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + n], "<u4").tolist()
        self.texts = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key at this place, and its replacement."""
        if not self.units:
            return None
        unit = self.units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        found = None
        for i in range(at, len(data)):
            node ^= data[i]
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                value = self.units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.texts[value : self.texts.index(b"\0", value)])
        return found


class Normaliser:
    def __init__(self, charsmap: bytes, dummy_prefix: bool, collapse: bool, escape: bool, suffix: bool = False):
        self.map, self.dummy_prefix, self.collapse, self.suffix = CharacterMap(charsmap), dummy_prefix, collapse, suffix
        self.space = SPACE_SIGN if escape else b" "

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them, and their end, the place in data that it comes from."""
        if not data:
            return b"", np.zeros(1, np.int64)
        if not self.map.units and not self.collapse and not self.suffix:
            return self.plain(data)
        return self.mapped(data)

    def plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Without a map only spaces change."""
        raw = np.frombuffer(data, np.uint8)
        wide = np.where(raw == 32, len(self.space), 1)
        places = np.append(np.repeat(np.arange(len(raw)), wide), len(raw))
        out = data.replace(b" ", self.space)
        if self.dummy_prefix:
            out, places = self.space + out, np.concatenate([np.zeros(len(self.space), np.int64), places])
        return out, places

    def step(self, data: bytes, at: int) -> tuple[int, bytes]:
        found = self.map.longest(data, at)
        if found:
            return found
        first = data[at]
        n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        try:
            data[at : at + n].decode()
        except UnicodeDecodeError:
            return 1, "�".encode()
        return n, data[at : at + n]

    def mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        out, places, at, end = bytearray(), [], 0, len(data)
        if self.collapse:
            while at < end:
                n, text = self.step(data, at)
                if text != b" ":
                    break
                at += n
            if at == end:
                return b"", np.zeros(1, np.int64)
        def put(text: bytes, place: int) -> None:
            out.extend(text)
            places.extend([place] * len(text))
        if self.dummy_prefix and not self.suffix:
            put(self.space, at)
        space_before = self.collapse
        while at < end:
            n, text = self.step(data, at)
            if space_before:
                text = text.lstrip(b" ")
            if text:
                for part in text:
                    put(self.space if part == 32 else bytes([part]), at)
                space_before = self.collapse and text.endswith(b" ")
            at += n
        if self.collapse:
            while out.endswith(self.space):
                at = places[len(out) - len(self.space)]
                del out[-len(self.space) :], places[-len(self.space) :]
        if self.dummy_prefix and self.suffix:
            put(self.space, at)
        return bytes(out), np.array([*places, at])


def word_pattern(pieces: Iterable[str]) -> re.Pattern:
    """Words that no piece reaches beyond; a space sign stands only at the beginning of pieces.

    Two characters that no piece has side by side never come into one symbol, so a text may be cut between them.
    """
    sign = SPACE_SIGN.decode()
    beside = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
    inner = set("".join(beside)) | {sign}
    marks = {c for c in inner if not c.isalpha()} - {sign}
    while behind := {y for x, y in beside if y in marks and x != sign and x not in marks}:
        marks -= behind
    one_of = lambda chars: f"[{re.escape(''.join(sorted(chars)))}]" if chars else "(?!)"
    rest, marks = one_of(inner - marks - {sign}), one_of(marks)
    return re.compile(f"{sign}*{rest}+|{sign}*{marks}+(?:{rest}+)?|{sign}+|[^{one_of(inner)[1:]}", re.DOTALL)


class Merges(dict):
    """Byte-pair encoding: ids of a word as little-endian 32-bit integers, kept while a worker has room."""

    def __init__(self, pieces: dict[str, int], scores: dict[str, float], byte_ids: list[int] | None, unknown: int):
        super().__init__()
        self.pieces, self.scores, self.byte_ids, self.unknown = pieces, scores, byte_ids, unknown
        sign = SPACE_SIGN.decode()
        self.apart = not any(sign in p.lstrip(sign) for p in pieces)
        self.words = word_pattern(pieces).findall
        self.before: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(word) > 48:
            return self.packed(self.queued(word))
        if (out := self.before.get(word)) is None:
            out = self.packed(self.scanned(word))
        if len(self) >= KEPT:
            self.before = dict(self)
            self.clear()
        self[word] = out
        return out

    def packed(self, parts: list[str]) -> bytes:
        return array.array("I", self.named(parts)).tobytes()

    def scanned(self, word: str) -> list[str]:
        """The symbols of a short word: all pairs are looked through for the best."""
        score, parts = self.scores.get, list(word)
        pairs = [score(x + y, NEVER) for x, y in zip(parts, parts[1:], strict=False)]
        while pairs and (best := max(pairs)) > NEVER:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = score(parts[i - 1] + parts[i], NEVER)
            if i < len(pairs):
                pairs[i] = score(parts[i] + parts[i + 1], NEVER)
        return parts

    def queued(self, word: str) -> list[str]:
        """The same with a queue of pairs, for words of any length."""
        scores, n = self.scores, len(word)
        ends, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        queue: list[tuple[float, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < n and (found := scores.get(word[left : ends[right]])) is not None:
                heapq.heappush(queue, (-found, left, right, ends[right]))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, left, right, end = heapq.heappop(queue)
            if ends[left] != right or ends[right] != end:  # one of them has merged since
                continue
            ends[left], ends[right] = end, -1
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            offer(before[left], left)
            offer(left, after[left])
        parts, at = [], 0
        while at < n:
            parts.append(word[at : ends[at]])
            at = after[at]
        return parts

    def named(self, parts: list[str]) -> list[int]:
        """Ids of the symbols; those that are no piece become byte pieces."""
        ids = []
        for part in parts:
            if (found := self.pieces.get(part)) is not None:
                ids.append(found)
            else:
                ids += [self.byte_ids[x] for x in part.encode()]
        return ids

    def encode(self, text: str) -> np.ndarray:
        words = map(self.__getitem__, self.words(text)) if self.apart else [self.packed(self.queued(text))]
        return np.frombuffer(b"".join(words), np.uint32)

    def unknown_encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids and widths for a model without byte pieces; symbols without a piece that follow one another are one unknown piece."""
        ids, widths = [], []
        for part in self.queued(text):
            found, wide = self.pieces.get(part, self.unknown), len(part.encode())
            if ids and found == self.unknown == ids[-1]:
                widths[-1] += wide
            else:
                ids.append(found)
                widths.append(wide)
        return ids, widths


class Codec:
    """A model's pieces and its normaliser."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        self.normalise = Normaliser(norm.precompiled_charsmap, norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces, proto.trainer_spec.treat_whitespace_as_suffix)
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.begin, self.end, self.unknown = self.library.bos_id(), self.library.eos_id(), self.library.unk_id()
        # A byte piece stands for one byte; control pieces, begin and end among them, for none.
        self.width = np.array([1 if p.type == kinds.BYTE else 0 if p.type == kinds.CONTROL else len(p.piece.encode()) for p in proto.pieces])
        self.merges = None
        if proto.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE:
            if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
                raise ValueError("user-defined and unused pieces are not supported")
            normal = [(i, p) for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL]
            pieces, scores = {p.piece: i for i, p in normal}, {p.piece: p.score for _, p in normal}
            byte_ids = [self.library.piece_to_id(f"<0x{x:02X}>") for x in range(256)] if proto.trainer_spec.byte_fallback else None
            self.merges = Merges(pieces, scores, byte_ids, self.unknown)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text its ids with begin and end, and where each piece begins and ends in the text's UTF-8."""
        out = []
        for text in texts:
            data = text.encode("utf-8", "surrogatepass")
            normal, places = self.normalise(data)
            ids, widths = self.pieces_of(text, normal.decode())
            ids = np.concatenate([[self.begin], ids, [self.end]]).astype(np.uint32)
            widths = self.width[ids] if widths is None else np.array([0, *widths, 0])
            ends = np.cumsum(widths)
            if ends[-1] != len(normal):
                raise ValueError("the pieces do not cover the normalised text")
            out.append((ids, places[ends - widths], places[ends]))
        return out

    def pieces_of(self, text: str, normal: str) -> tuple[Sequence[int], list[int] | None]:
        """Ids and, where the ids don't tell them, widths."""
        if self.merges is None:  # another kind of model: as the library gives them
            ids, pieces = self.library.encode(text), self.library.encode(text, out_type=str)
            return ids, [1 if self.library.is_byte(i) else len(p.encode()) for i, p in zip(ids, pieces, strict=True)]
        return (self.merges.encode(normal), None) if self.merges.byte_ids else self.merges.unknown_encode(normal)

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


@functools.lru_cache(maxsize=1)
def codec(model: bytes) -> Codec:
    return Codec(model)


def forget() -> None:
    codec.cache_clear()


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:  # on the driver, which the path is a parameter of
        return f.read()


def encoded(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, and ids, begins, ends (arrays; spans in bytes of the original text)."""
    model = model_bytes(path)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = codec(model).encode([t or "" for t in b.column(len(keep)).to_pylist()])
            cols = [pa.array([x[0] for x in found], pa.list_(pa.int32())), *(pa.array([x[k] for x in found], pa.list_(pa.int64())) for k in (1, 2))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *cols], names=[*keep, "ids", "begins", "ends"])

    kept = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text).cast("string").alias("text_"))
    types = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes[: len(keep)])
    return kept.mapInArrow(tidy(run, forget), f"{types}, ids array<int>, begins array<bigint>, ends array<bigint>")


def digests(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, span_bytes (the bytes of the text that the spans of its pieces cover),
    spans_sha256 (of the begins and then the ends of the spans, little-endian signed 64-bit integers), and the ids if asked for."""
    model = model_bytes(path)
    small_batches(docs.sparkSession)
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), *([pa.list_(pa.int32())] if with_ids else [])]
    names = ["n_tokens", "ids_sha256", "decoded_sha256", "span_bytes", "spans_sha256", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            rows = []
            own = codec(model)
            for ids, begins, ends in own.encode([t or "" for t in b.column(1).to_pylist()]):
                rows.append((len(ids), sha(ids.astype("<u4").tobytes()), sha(own.decode(ids).encode()), int((ends - begins).sum()), sha(np.r_[begins, ends].astype("<i8").tobytes()), *([ids] if with_ids else [])))
            cols = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run, forget), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, span_bytes long, spans_sha256 string" + ", ids array<int>" * with_ids)
