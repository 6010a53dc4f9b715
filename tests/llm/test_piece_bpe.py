"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from evidex.llm import piece_bpe as S

PATH = public_tokenizers.path(S.MODEL)
TEXTS = ["", " ", "a", "  a  b", "▁▁x", " ▁ ", "中文" * 50, "😀é́\0\r\n\t", "<s>hello</s><unk>", "<0x41>", " " * 3001, "=" * 999, "ab" * 4000, "a" * 5000, "x" * 70_000]


@pytest.fixture(scope="module")
def model():
    return S.Model(open(PATH, "rb").read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(1)
    kinds = ["ab", "abc ", "aeioust ", "intheorao ", "▁ a", "0123456789", "=-*_ ", "的是中国人 ", "łóżßü ", " \n\t", "԰⿿\U0001f600a"]
    mixed = ["".join(rng.choice(kind) for _ in range(rng.randrange(1, 60))) for kind in kinds for _ in range(60)]
    long = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)), " ".join("".join(rng.choice("aeinrst") for _ in range(rng.randrange(1, 12))) for _ in range(20_000))]
    return TEXTS + mixed + long


def test_ids_and_decoded_texts(spark, library):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts())] + [(None, None, None, None), (3, TEXTS[3], "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string")
    want = []
    for d, t, *_ in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        decoded = library.decode(ids)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), ids, decoded))
    got = [tuple(r) for r in S.encoded(docs, PATH, chars=500).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert S.encoded(docs.limit(0), PATH).count() == 0


def test_marks_whose_ranks_tie(model, library):
    """Runs of marks have one score for every length, so that the order within a round decides."""
    for n in range(1, 70):
        for tail in ("", "a", "\n", "a  "):
            assert np.frombuffer(model.encode([" " * n + tail])[0], "<u4").tolist() == library.encode(" " * n + tail, add_bos=True, add_eos=True)


def test_decoding_of_any_ids(model, library):
    rng = random.Random(2)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(300), rng.choice([28705, 259, 0, 1, 2])]) for _ in range(rng.randrange(9))]
        assert model.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids)


def test_cache_is_bounded(monkeypatch, library):
    monkeypatch.setattr(S, "CACHED", 20)
    model = S.Model(open(PATH, "rb").read())
    for t in texts():
        assert np.frombuffer(model.encode([t])[0], "<u4").tolist() == library.encode(t, add_bos=True, add_eos=True)
        assert len(model.known) <= 20


def plain(model, word):
    """Symbols merged one pair at a time, the leftmost of the best rank first."""
    tokens = list(word)
    known = {(int(k) >> 32, int(k) & 0xFFFFFFFF): (int(r), int(p)) for k, r, p in zip(model.pairs[:-1], model.ranks, model.merged)}
    symbols = [int(model.symbols[i]) if model.chars[i := np.searchsorted(model.chars, ord(c))] == ord(c) else model.other for c in tokens]
    while found := [(*known[pair], i) for i, pair in enumerate(zip(symbols, symbols[1:])) if pair in known]:
        rank, piece, i = min((r, p, i) for r, p, i in found if r == min(found)[0] and i == min(i for q, _, i in found if q == min(found)[0]))
        symbols[i : i + 2] = [piece]
    return symbols


def small_model(pieces):
    """Bytes of a BPE model without byte fallback: (text, score) after the unknown, begin and end pieces."""
    import struct

    def field(number, kind, value):
        key = bytes([number << 3 | kind]) if number < 16 else bytes([(number << 3 | kind) & 127 | 128, number >> 4])
        return key + (bytes([len(value)]) + value if kind == 2 else value)

    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(t, s, 1) for t, s in pieces]
    out = b"".join(field(1, 2, field(1, 2, t.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k]))) for t, s, k in rows)
    return out + field(2, 2, field(3, 0, bytes([2]))) + field(3, 2, field(1, 2, b"identity") + field(4, 0, bytes([0])))


def test_models_of_tied_and_disordered_scores():
    """Pieces whose parts come later, ties between different pieces, and characters that are no piece, against plain merging."""
    rng = random.Random(3)
    for _ in range(60):
        pieces = {c: 0.0 for c in "▁abc"[: rng.randrange(2, 5)]}
        for _ in range(25):
            a, b = rng.choice(list(pieces)), rng.choice([*pieces, "d"])
            pieces[(a + b)[:8]] = float(rng.randrange(-6, 0))
        model = S.Model(small_model(pieces.items()))
        for _ in range(20):
            text = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 40)))
            ids = np.frombuffer(model.encode([text])[0], "<u4").tolist()[1:-1]
            assert ids == [s if s < model.count else model.unknown for s in plain(model, "▁" + text)]


def test_unknown_kinds_of_models():
    with pytest.raises(ValueError):
        S.Model(small_model([("a", 0.0)])[:-2] + bytes([4 << 3, 1]))
    with pytest.raises(ValueError):
        S.Model(b"")
