from __future__ import annotations

import hashlib

import numpy as np
import pytest

from deltaloom.llm import pieces

P = pytest.importorskip("public_tokenizers")
sp = pytest.importorskip("sentencepiece")
TEXTS = ["", " ", "  two  spaces ", "Hello world", "naïve ﬁne ½ ｆｕｌｌ", "\tTab\nline\r\n", "emoji 😀 and ​ zero", "a" * 3000, "<s> </s> <unk> <0x41>", "▁ sign", "日本語 テキスト", "x́ y", "mixed 中文 und Ä"]


def test_spans_tile_the_text():
    own = pieces.codec(pieces.model_bytes(P.path("piece_bpe_32k.model")))
    lib = sp.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for text, (ids, begins, ends) in zip(TEXTS, own.encode(TEXTS), strict=True):
        assert ids.tolist() == lib.encode(text, add_bos=True, add_eos=True)
        assert own.decode(ids) == lib.decode(ids.tolist())
        data = text.encode()
        assert b"".join(data[a:b] for a, b in zip(begins, ends, strict=True)) == data
        assert (begins[1:] == ends[:-1]).all()
        for i, a, b in zip(ids.tolist(), begins, ends, strict=True):
            piece = lib.id_to_piece(i)
            if not lib.is_control(i) and not lib.is_byte(i):
                assert piece.replace("▁", " ").lstrip() == data[a:b].decode().replace("▁", " ").lstrip()


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("collapse", [True, False])
def test_normaliser_agrees_with_the_library(rule, collapse):
    from sentencepiece import sentencepiece_model_pb2

    lib = sp.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=collapse)
    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(lib.serialized_model_proto())
    own = pieces.Normaliser(spec.normalizer_spec.precompiled_charsmap, True, collapse, True)
    for text in TEXTS:
        normal, places = own(text.encode())
        want, offsets = lib.normalize(text, with_offsets=True)
        assert normal.decode() == want
        assert len(places) == len(normal) + 1 and (np.diff(places) >= 0).all()
        chars = [0, *np.cumsum([len(c.encode()) for c in text])]
        starts = [0, *np.cumsum([len(c.encode()) for c in want])]
        assert [chars[o] for o in offsets] == [places[s] for s in starts]


def test_digests(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, None])] + [(None, "n", "x")], "doc_id long, text string, ids string")
    lib = sp.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in pieces.digests(docs, P.path("piece_bpe_32k.model")).collect()}
    assert len(got) == len(TEXTS) + 2
    for i, t in enumerate([*TEXTS, ""]):
        ids = lib.encode(t, add_bos=True, add_eos=True)
        assert got[i].n_tokens == len(ids) and got[i].span_bytes == len(t.encode())
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    rows = pieces.encoded(docs.limit(3), P.path("piece_bpe_32k.model"), keep=("doc_id", "ids")).drop("ids")
    assert rows.columns == ["doc_id", "begins", "ends"]
    assert pieces.digests(docs.limit(0), P.path("piece_bpe_32k.model")).count() == 0


def test_own_merges_equal_the_library():
    import random

    path, rng = P.path("piece_bpe_32k.model"), random.Random(1)
    own, lib = pieces.Codec(pieces.model_bytes(path)), sp.SentencePieceProcessor(model_file=path)
    signs = [*map(chr, [*range(1, 300), 0x4E2D, 0x6587, 0x1F600, 0x2581, 0x200D, 0xFFFD, 0x3000]), *" " * 60, *"etaoin" * 20]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 200))) for _ in range(500)]
    texts += [" " * 3000, "ab" * 3000 + " x", "the cat sat on " * 2000, "in" * 24, "▁▁ ▁a▁"]
    assert [x[0].tolist() for x in own.encode(texts)] == lib.encode(texts, add_bos=True, add_eos=True)
    for text in texts[:200]:
        assert own.merges.scanned(text) == own.merges.queued(text)


def test_unsupported_pieces_are_refused():
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(pieces.model_bytes(P.path("piece_bpe_32k.model")))
    proto.pieces[400].type = sentencepiece_model_pb2.ModelProto.SentencePiece.USER_DEFINED
    with pytest.raises(ValueError, match="user-defined"):
        pieces.Codec(proto.SerializeToString())


def test_words_end_where_no_piece_goes_on():
    import random

    path, rng = P.path("piece_bpe_32k.model"), random.Random(2)
    own, lib = pieces.Codec(pieces.model_bytes(path)), sp.SentencePieceProcessor(model_file=path)
    words = [f"word{chr(97 + i)}" for i in range(20)]
    text = " ".join(f"{x}.\n{y},7" for x in words for y in words)
    assert own.encode([text])[0][0].tolist() == lib.encode(text, add_bos=True, add_eos=True)
    assert len(own.merges) < 60  # not one for each pair of words
    sayings = list(own.merges.pieces)
    texts = ["".join(rng.choice(sayings).replace("▁", " ") for _ in range(rng.randint(1, 60))) for _ in range(1000)]
    assert [x[0].tolist() for x in own.encode(texts)] == lib.encode(texts, add_bos=True, add_eos=True)


def test_pattern_of_words():
    cut = lambda kinds, text: pieces.word_pattern(kinds).findall(text)
    assert cut(["ab", "▁a", "..", ".c"], "▁ab..cb.▁▁a7\n▁.a▁") == ["▁ab", "..cb", ".", "▁▁a", "7", "\n", "▁.a", "▁"]
    assert cut(["ab", "b."], "ab.a▁ab-") == ["ab.a", "▁ab", "-"]  # a mark that a piece has behind a letter is no border
    assert cut([], "a▁b") == ["a", "▁", "b"]


def test_frequent_words_stay(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 10)
    own = pieces.Codec(pieces.model_bytes(P.path("piece_bpe_32k.model"))).merges
    looked, scanned = [], own.scanned
    monkeypatch.setattr(own, "scanned", lambda word: looked.append(word) or scanned(word))
    for i in range(100):
        own.encode(f"▁often▁once{chr(97 + i // 26)}{chr(97 + i % 26)}")
    assert looked.count("▁often") == 1 and len(looked) == 101 and len(own) + len(own.before) <= 20
