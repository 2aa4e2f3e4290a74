"""The pipeline against a brute-force version of its stages on a small fixture."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from palimpsest.llm import bpe, mixing, quality, secret_scan, simhash, sketch

from .cases import prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    made = [" ".join(f"{rng.choice('abcdef')}{rng.randrange(10**5)}" for _ in range(rng.randint(60, 200))) for _ in range(60)]
    rows = list(enumerate(made))
    rows += [(100 + i, made[i]) for i in range(10)]  # exact copies
    for i in range(10, 20):  # near copies: a word in a hundred changed, and case
        words = made[i].split()
        words[len(words) // 2] = "Changed"
        rows.append((200 + i, " ".join(words).capitalize()))
    rows += [(300, ""), (301, None), (302, "too short"), (303, " ".join(["same three words"] * 60))]
    rows += [(310, made[21] + " password = hunter2hunter2 " + made[22]), (None, prose(rng, 150))]
    docs = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def test_stages_in_turn(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    texts = dict(rows)

    kept = corpus_pipeline.quality_rules(spark, docs, path)
    assert kept.columns == columns
    good = [i for i, t in rows if quality.measure([t])["kept"][0]]
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, good))
    assert not {300, 301, 302, 303} & set(good) and set(range(60)) <= set(good)

    one = corpus_pipeline.near_dedup(spark, kept, path)
    assert one.columns == columns
    ids = {r["doc_id"] for r in one.collect()}
    prints = {i: simhash.shingle_hashes(texts[i], 5) for i in good}
    alike = lambda a, b: sum(x == y for x, y in zip(sketch.sketch(prints[a]), sketch.sketch(prints[b]))) >= sketch.least_shared()
    assert set(range(60)) <= ids and None in ids
    for i in good:
        if i is not None and i not in ids:
            assert any(j is not None and j < i and alike(i, j) for j in ids)
    assert not {100 + i for i in range(10)} & ids and not {200 + i for i in range(10, 20)} & ids

    safe = corpus_pipeline.secret_scans(spark, one, path)
    assert safe.columns == columns
    after = {r["doc_id"]: r for r in safe.collect()}
    assert set(after) == ids and "hunter2" not in after[310]["text"] and "[SECRET]" in after[310]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())
    assert all(after[i]["text"] == texts[i] for i in range(60))

    mixed = corpus_pipeline.source_mix(spark, safe, path)
    assert mixed.columns == columns
    times = {r["doc_id"]: r["whole"] + r["extra"] for r in mixing.mix(safe).collect()}
    got = [r["doc_id"] for r in mixed.collect()]
    assert all(got.count(i) == n for i, n in times.items())


def test_run_gives_what_the_library_gives(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in docs.collect():
        ids = library.encode_ordinary(r["text"])
        want.append((str(r["doc_id"]), len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()))
    out = corpus_pipeline.run(spark, path).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out) == sorted(want)


def test_an_empty_table_gives_no_rows(spark, folder, tmp_path):
    path, _ = folder
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert secret_scan.redact(spark.read.parquet(f"{tmp_path}/documents.parquet")).count() == 0
