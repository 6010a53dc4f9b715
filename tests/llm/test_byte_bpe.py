"""Byte-level BPE against tiktoken, and the round trip."""

import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers
import tiktoken

from evidex.llm import byte_bpe as B

PATH = public_tokenizers.path(B.VOCABULARY)
TEXTS = ["", "a", " " * 300, "x" * 1500, "日本語テキスト" * 40, "😀🎉 mixed\n\n\n  text", "we'll don't I've", "aaab" * 700, "tab\tand\r\nline", "Straße été ñandú", "<|endoftext|> is text", "0123456789" * 30]


def reference():
    vocab = B.Vocabulary(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})


def texts():
    rng = random.Random(9)
    return TEXTS + ["".join(rng.choice("ab é\n漢1,.$") for _ in range(400)) for _ in range(20)] + ["".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(300))]


def test_ids_and_round_trip(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts())] + [(None, None, None, None), (3, TEXTS[3], "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens string")
    enc = reference()
    want = []
    for d, t, *_ in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    got = [tuple(r) for r in B.encoded(docs, PATH, chars=500).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert B.encoded(docs.limit(0), PATH).count() == 0


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(B, "CACHED", 20)
    vocab = B.Vocabulary(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    enc = reference()
    for t in texts():
        assert np.frombuffer(vocab.encode([t])[0], "<u4").tolist() == enc.encode_ordinary(t)
        assert len(vocab.known) <= 20


def test_long_matches(spark):
    rng, enc = random.Random(3), reference()
    vocab = B.Vocabulary(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    for alphabet in ("a", "ab", "abcdefghijklmnopqrstuvwxyz", "éàü", "theinaton", "漢字仮名"):
        for n in (2, 3, 5, 17, 300, 6000, 40000):
            t = "".join(rng.choices(alphabet, k=n))
            for word in vocab.find(t):
                raw = word.encode()
                if len(raw) > 1 and raw not in vocab.ranks:
                    assert np.frombuffer(vocab._merge_long(raw), "<u4").tolist() == enc.encode_ordinary(word)
    long = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1 << 20))
    began = time.process_time()
    assert np.frombuffer(vocab.encode([long])[0], "<u4").tolist() == enc.encode_ordinary(long)
    assert time.process_time() - began < 30


def test_merge_that_makes_a_lesser_pair():
    """bc comes before what it is merged into; a pair that a merge makes and that ranks below it goes first."""
    single = {bytes([i]): i for i in range(256)}
    ranks = {**single, b"abc": 300, b"cab": 301, b"bc": 302, b"ab": 303, b"bcab": 304}
    content = b"\n".join(base64.b64encode(k) + b" " + str(v).encode() for k, v in ranks.items())
    vocab = B.Vocabulary(content, ".+")
    rng = random.Random(1)
    for _ in range(300):
        word = "".join(rng.choices("abc", k=rng.randrange(2, 40))).encode()
        tokens = [bytes([c]) for c in word]
        while True:
            found = [(ranks[x + y], i) for i, (x, y) in enumerate(zip(tokens, tokens[1:])) if x + y in ranks]
            if not found:
                break
            i = min(found)[1]
            tokens[i : i + 2] = [tokens[i] + tokens[i + 1]]
        assert np.frombuffer(vocab._merge_long(word), "<u4").tolist() == [ranks[t] for t in tokens]
