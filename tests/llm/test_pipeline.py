import os
import random
from hashlib import blake2b

import numpy as np
import pytest
from conftest import WORDS
from test_dedup import brute_lines, groups, shingle_set

import corpus_pipeline
from widegrain.llm import bpe, language_id, line_dedup, packing, pii, queries
from widegrain.llm.common import save

DATA = "/root/testdata/sf0.001"


def test_stages_on_awkward_rows(spark, awkward, empty):
    for rows in (awkward, empty):
        docs = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = save(stage(spark, docs, ""))
            assert docs.columns == awkward.columns, name
        assert (corpus_pipeline.packing_stage(spark, docs, "").count() > 0) == (docs.count() > 0)


def planted():
    """Documents in two languages with copies, near copies, shared blocks, personal data and junk."""
    rng = random.Random(12)
    other = ["der", "die", "strasse", "licht", "garten", "haus", "sieben", "papier", "nicht", "unter", "stein", "gr\u00fcn"]
    prose = lambda words, n: "\n".join(" ".join(rng.choice(words) for _ in range(9)) for _ in range(n))
    rows = [(i, prose(WORDS if i % 2 else other, 4 + i % 3), "en" if i % 2 else "de") for i in range(120)]
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(6)]
    long = [f"x{j}" for j in range(150)]
    for i in range(8):
        words = list(long)
        for j in range(i % 3):
            words[20 + 40 * j] = f"y{i}q{j}"
        rows.append((300 + i, " ".join(words) + f" the house of green light {i}", "en"))
    rows += [(400 + i, prose(WORDS, 2) + f"\nMr Holm{'abcdef'[i]} wrote from 10.0.0.{i} and mail{i}@ex.org", "en") for i in range(6)]
    rows += [(500, None, "en"), (501, "", "de"), (502, "12345 678", None), (503, prose(WORDS, 3), None)]
    return rows


def plain_pipeline(spark, rows, key):
    """Texts that the first four stages leave, without Spark; the trained network is given."""
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    told = {}
    for i, t, _ in rows:
        raw = language_id.fold(np.frombuffer((t or "").encode(), np.uint8))
        if t and any(c.isalpha() for c in t):
            sums = 0
            for lo in range(0, len(raw), language_id.WINDOW):
                x = np.zeros((1, language_id.WINDOW + 3), np.uint8)
                part = raw[lo : lo + language_id.WINDOW + 3]
                x[0, : len(part)] = part
                sums = sums + model.probabilities(x, model.pair_tables())[0] * min(len(raw) - lo, language_id.WINDOW)
            told[i] = (model.langs[int(sums.argmax())], float(sums.max()) / len(raw))
    import zlib

    held = sorted(told[i][1] for i, _, lang in rows if i in told and zlib.crc32(str(i).encode()) % 4 == 2 and told[i][0] == lang)
    least = held[max(int(np.ceil(language_id.REJECT * len(held))) - 1, 0)]
    docs = [(i, t) for i, t, _ in rows if i in told and told[i][1] >= least - 1e-9]
    gone = brute_lines(docs)
    docs = [(i, line_dedup.strip_lines(t, gone[i, t])[0]) for i, t in docs]
    sets = [shingle_set(t) for _, t in docs]
    near = [(a, b) for a in range(len(docs)) for b in range(a + 1, len(docs)) if sets[a] == sets[b] or 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    root = groups(len(docs), near)
    docs = [d for i, d in enumerate(docs) if root[i] == i]
    secret = blake2b(key.encode(), digest_size=32).digest()
    found = {(k, f) for _, t in docs for _, _, k, f in pii.detect(t)}
    made = [pii.surrogate(k, f, secret) for k, f in found]
    assert len(set(made)) == len(found) and not set(made) & {f for _, f in found}
    return {i: pii.rewrite(t, secret, {})[0] for i, t in docs}


def test_run_equals_plain_stages(spark, tmp_path):
    rows, key = planted(), "a secret of the test"
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set(pii.KEY_SETTING, key)
    try:
        out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    want = plain_pipeline(spark, rows, key)
    assert {500, 501, 502} & set(want) == set() and 110 < len(want) < 130
    tokenizer = bpe.BatchBpe(packing.default_tokenizer()).tokenizer
    pieces, seqs = {}, {}
    for r in out:
        pieces.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    whole = {i: [x for _, ids in sorted(p) for x in ids] for i, p in pieces.items()}
    assert whole == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in want.items()}
    for parts in seqs.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist() and sum(n for _, n in parts) <= 1024


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline_packs_what_its_stages_keep(spark):
    out = corpus_pipeline.run(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r[0] for r in out.select("doc_id").distinct().collect()}
    assert 0.8 * docs.count() < len(kept) <= docs.count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["op2_language_id", "op3_sentencepiece", "op4_line_dedup", "op7_quality_lm", "op8_pii_surrogates"])
def test_queries_return_every_document(spark, name):
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert queries.QUERIES[name](spark, DATA).count() == n
