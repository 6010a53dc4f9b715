"""The pipeline on a small table: every stage's decisions show, and each stage is itself tested against brute force elsewhere."""

import random
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline as P
from evidex.llm import byte_bpe
from evidex.llm.mixing import mix_amounts


def test_stages(spark, tmp_path):
    rng = random.Random(0)
    syllables = ["ba", "ko", "ri", "ten", "lu", "sa", "mi", "do"]
    line = lambda n: " ".join("".join(rng.choices(syllables, k=4)) for _ in range(n))
    clean = [(d, "\n".join(line(30) for _ in range(3)), "en", f"s{d % 3}", 0) for d in range(120)]
    toxic = [(200 + i, line(10) + " vermin scoundrel vermin " + line(10), "en", "s0", 0) for i in range(60)]
    shared = "this very line is repeated in many documents"
    clean[5] = (5, clean[5][1] + "\n" + shared, "en", "s1", 0)
    clean[9] = (9, clean[9][1] + "\n" + shared + "!", "en", "s1", 0)
    rows = clean + toxic + [(300, clean[1][1], "en", "s2", 0), (301, None, None, None, None), (302, clean[2][1].replace(clean[2][1].split()[0], "xx", 1), "en", "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, int(200 <= d < 300)) for d, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, after = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        previous, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        after[name] = docs.collect()
        if k < len(P.STAGES) - 1:
            assert docs.columns == previous.columns
        if name == "mixing":
            want = Counter({r.doc_id: r.taken for r in mix_amounts(previous).collect()})
    ids = {n: {r.doc_id for r in rows} for n, rows in after.items()}
    assert not {d for d in ids["toxicity"] if d and 200 <= d < 300} and set(range(120)) <= ids["toxicity"]
    assert 300 not in ids["line_dedup"] and set(range(120)) <= ids["line_dedup"]
    assert not any(shared in (r.text or "") for r in after["line_dedup"] if r.doc_id == 9)
    assert set(range(120)) <= ids["simhash_dedup"]
    got = Counter()
    for r in after["mixing"]:
        got[r.doc_id] += len((r.text or "").split())
    assert +got == +want
    vocab = byte_bpe.Vocabulary(open(public_tokenizers.path(byte_bpe.VOCABULARY), "rb").read(), public_tokenizers.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    assert Counter((r.doc_id, tuple(r.ids)) for r in after["byte_bpe"]) == Counter((r.doc_id, tuple(enc.encode_ordinary(r.text or ""))) for r in after["mixing"])
    assert len(P.run(spark, str(tmp_path)).collect()) == len(after["byte_bpe"])


ODD = "doc_id long, text string, lang string, source string, n_chars long, row string, t string, gone_lines string, n_lines int"


def odd_rows():
    rng = random.Random(4)
    text = lambda n: " ".join("w%d" % rng.randrange(5000) for _ in range(n))
    a, b = text(120), text(90)
    rows = [(1, a), (1, b), (1, b), (2, a + " more"), (None, text(20)), (None, text(20)), (4, None), (5, ""), (6, " \n "), (7, text(40_000)), (8, "x" * 50_000), (9, text(3)), (9, text(3))]
    return [(d, t, "en", (None, "s0", "s1")[i % 3], len(t or ""), f"r{i}", "t", None, i) for i, (d, t) in enumerate(rows)]


def test_stages_on_odd_rows_and_empty_tables(spark, tmp_path):
    labels = spark.createDataFrame([(100, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = odd_rows()
    docs = spark.createDataFrame(rows, ODD)
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    out = {name: stage(spark, docs, str(tmp_path)) for name, stage in P.STAGES}
    for name, _ in P.STAGES[:-1]:
        assert out[name].columns == docs.columns
    # nothing is labelled toxic, so nothing goes
    assert Counter(map(tuple, out["toxicity"].collect())) == Counter(rows)
    # the repeated row (1, b) stays as it is, for its lines' earliest place is both rows'
    lines = {(r.doc_id, r.row): r.text for r in out["line_dedup"].collect()}
    assert lines == {(r[0], r[5]): r[1] for r in rows}
    # (2, a more) is a near-copy of (1, a); (1, b) is a text of its own, told twice; of the blank texts the first stays
    assert {r.row for r in out["simhash_dedup"].collect()} == {r[5] for r in rows} - {"r3", "r7", "r8"}
    got, want = Counter(), Counter()
    for r in out["mixing"].collect():
        got[r.row] += len((r.text or "").split())
        assert set((r.text or "").split()) <= set((rows[int(r.row[1:])][1] or "").split())
    for r in mix_amounts(docs).collect():
        want[r.doc_id] += r.taken
    by_id = Counter()
    for k, n in got.items():
        by_id[rows[int(k[1:])][0]] += n
    assert +by_id == +want
    assert Counter(r.doc_id for r in out["byte_bpe"].collect()) == Counter(r[0] for r in rows)
