import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import lm_score, mixing, queries, quotes, sharding, vectors
from palimpsest.llm.components import connected_components

from .cases import documents, prose, texts


def naive_scores(docs, alpha=0.4):
    words = [(t or "").encode().split() for t in docs]
    grams = lambda w, k: [tuple(w[i - k : i + 1]) for i in range(k, len(w))]
    total = [Counter(g for w in words for g in grams(w, k)) for k in range(3)]
    n = sum(map(len, words))
    out = []
    for w in words:
        own = [Counter(grams(w, k)) for k in range(3)]
        count = lambda g: total[len(g) - 1][g] - own[len(g) - 1][g]  # noqa: B023, E731
        score = 0.0
        for i in range(len(w)):
            penalty = 0.0
            for k in (2, 1, 0):
                if i < k:
                    continue
                g = tuple(w[i - k : i + 1])
                if k and count(g) > 0:
                    score += penalty + math.log(count(g) / count(g[:-1]))
                    break
                if not k:
                    score += penalty + math.log(max(count(g), 1) / max(n - len(w), 1))
                penalty += math.log(alpha)
        out.append((len(w), score))
    return out


@pytest.mark.parametrize("per_block, per_bucket", [(8_000_000, 1_000_000), (1000, 500), (1000, 3)])
def test_language_model_scores(spark, monkeypatch, per_block, per_bucket):
    monkeypatch.setattr(lm_score, "PACKED_BUCKETS", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5" if per_bucket == 500 else "1000")
    monkeypatch.setattr(lm_score, "BLOCK_CHARS", per_block)
    monkeypatch.setattr(lm_score, "GRAMS_PER_BUCKET", per_bucket)
    rng = random.Random(1)
    made = texts()[:14] + [prose(rng, rng.randint(0, 200)) for _ in range(20)]
    docs = documents(spark, [(i, t, "", "", 0) for i, t in enumerate(made)] + [(None, made[0], "", "", 0)])
    want = naive_scores([*made, made[0]])
    for r in lm_score.lm_scores(docs).collect():
        n, score = want[r["doc_id"] if r["doc_id"] is not None else -1]
        assert r["n_words"] == n and r["score"] == pytest.approx(score, abs=1e-6)
        assert (r["mean_score"] is None) == (n == 0)
    assert lm_score.lm_scores(docs.limit(0)).count() == 0


def test_words_whose_hashes_begin_alike_keep_their_own_counts(spark):
    seen, pair = {}, None
    for i in range(200_000):
        word = f"w{i}"
        start = int(lm_score.spread(np.array([lm_score.xxhash.xxh64_intdigest(word.encode())], np.uint64) + np.uint64(1))[0]) >> 36
        pair = pair or ((seen[start], word) if start in seen else None)
        if pair:
            break
        seen[start] = word
    one, other = pair
    made = [f"a {one} b", *[f"c{i} {other} d" for i in range(12)]]
    want = naive_scores(made)
    for r in lm_score.lm_scores(documents(spark, [(i, t, "", "", 0) for i, t in enumerate(made)])).collect():
        assert r["score"] == pytest.approx(want[r["doc_id"]][1], abs=1e-6)


def test_an_ngram_that_clashes_backs_off_where_its_context_has_no_count():
    block = lm_score.Block([b"a b c d"], 3)
    grams, _ = block.grams()
    for clash in block.flat:
        assert np.isfinite(block.scores(5 * (grams == clash), 100, 0.4)).all()


@pytest.mark.parametrize("pack", [False, True])
def test_numbers_come_back_from_their_planes(pack):
    rng = random.Random(17)
    for lengths in ([], [1], [3, 1, 500], [7] * 40):
        values = np.array([rng.choice([0, 1, 254, 255, 256, 2**40]) for _ in range(sum(lengths))], np.uint64)
        low, more = lm_score.planes(values, np.cumsum(lengths, dtype=np.int64), pack)
        assert lm_score.read_planes(lm_score.pa.chunked_array([low]), lm_score.pa.chunked_array([more]), pack).tolist() == values.tolist()


def test_shards_are_even_gapless_and_stable(spark):
    rows = [(i, f"text {i % 50}" if i % 7 else None, "", "", 0) for i in range(997)]
    docs = documents(spark, rows + [(None, "a", "", "", 0), (None, "b", "", "", 0), rows[3]])
    got = sharding.shard_documents(docs).collect()
    assert len(got) == 1000
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    text = {r[0]: r[1] for r in rows}
    for r in got:
        if r["doc_id"] is not None:
            data = (text[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
    again = sharding.shard_documents(docs.repartition(3)).collect()
    key = lambda r: (str(r["doc_id"]), r["text_crc32"], r["shard"], r["slot"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert sharding.shard_documents(docs.limit(0)).count() == 0
    assert sharding.shard_documents(docs.limit(3)).count() == 3


def test_ring_homes_and_limited_movement(spark):
    nodes = sharding.ring(16)
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    home = {}
    for r in sharding.shard_documents(docs).collect():
        place = next((s for p, s in nodes if p >= r["pos"]), nodes[0][1])
        home[r["doc_id"]] = (place, r["shard"])
    assert sum(a == b for a, b in home.values()) > 0.85 * len(home)  # the rest overflowed
    more = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs.where("doc_id < 19800")).collect()}
    assert sum(home[i][1] != s for i, s in more.items()) < 0.1 * len(more)
    grown = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs, 17).collect()}
    assert sum(home[i][1] != s for i, s in grown.items()) < 0.3 * len(grown)


def test_bounded_plan_places_every_key_once():
    rng = random.Random(2)
    nodes = sharding.ring(5, 8)
    for _ in range(50):
        counts = [rng.choice([0, 1, 5, 400]) for _ in nodes]
        plan = sharding.bounded_plan(counts, nodes, 5)
        seen = {a: sorted((lo, hi) for arc, lo, hi, _, _ in plan if arc == a) for a in range(len(nodes))}
        for a, parts in seen.items():
            assert sum(hi - lo for lo, hi in parts) == counts[a] and all(x[1] == y[0] for x, y in zip(parts, parts[1:]))
        load = Counter()
        for _, lo, hi, s, slot in sorted(plan, key=lambda p: p[4]):
            assert slot == load[s]
            load[s] += hi - lo
        assert max(load.values()) - min(load[s] for s in range(5)) <= 1


def naive_targets(sizes, cap=3.0):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


def test_mix_meets_its_targets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 30, 200])), "", rng.choice(["a", "b", "b", "c", "d", None, "é"]), 0) for i in range(1500)]
    rows += [(9999, "w w", "", "lonely", 0), (8888, "", "", "wordless", 0), (7777, None, "", "a", 0)]
    docs = documents(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = naive_targets(dict(sizes))
    taken, biggest = Counter(), Counter()
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] <= 3 * r["size"] and r["taken"] % max(r["size"], 1) == 0
        taken[r["source"]] += r["taken"]
        biggest[r["source"]] = max(biggest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= biggest[s]
    again = {(r["doc_id"]): r["taken"] for r in mixing.mix(docs.repartition(3)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    copies = Counter(r["doc_id"] for r in mixing.mix_rows(docs).collect())
    assert copies == Counter({r["doc_id"]: r["whole"] + r["extra"] for r in got if r["whole"] + r["extra"]})
    assert mixing.mix_rows(docs).columns == docs.columns
    edge = documents(spark)
    assert mixing.mix(edge).count() == edge.count() and mixing.mix(edge.limit(0)).count() == 0 and mixing.mix_rows(edge.limit(0)).count() == 0


def naive_links(rows, cosine=0.98):
    sound = {}
    for i, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            sound[i] = (np.array(v, np.float32).astype(float), label)
    links = {i: set() for i in range(len(rows))}
    for i, (x, a) in sound.items():
        for j, (y, b) in sound.items():
            if i != j and a == b and len(x) == len(y) and x @ y / (math.sqrt(x @ x) * math.sqrt(y @ y)) >= cosine:
                links[i].add(j)
    return links


def test_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PER_LIST", 8)
    monkeypatch.setattr(vectors, "CENTRES", 6)  # so that there are two levels
    monkeypatch.setattr(vectors, "TILE_MEMBERS", 16)
    monkeypatch.setattr(vectors, "TILE_QUERIES", 32)
    rng = np.random.default_rng(4)
    rows = []
    for c in range(60):
        centre = rng.normal(size=12)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((len(rows), [float(np.float32(x)) for x in (centre + rng.normal(size=12) * 0.06) * rng.uniform(0.5, 2)], c % 3))
    centre = rng.normal(size=12)
    rows += [(len(rows) + i, [float(np.float32(x)) for x in centre + rng.normal(size=12) * 0.02], 0) for i in range(80)]
    n = len(rows)
    rows += [(n + i, rows[5][1], rows[5][2]) for i in range(4)]
    odd = [None, [], [0.0] * 12, [float("nan")] * 12, [1.0, None] + [0.0] * 10, [float("inf")] + [1.0] * 11]
    rows += [(n + 10 + i, v, 1) for i, v in enumerate(odd)] + [(n + 20, rows[0][1], None), (n + 21, rows[0][1][:6], rows[0][2])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, node string")
    links = naive_links(rows)
    got = {r["vec_id"]: r for r in vectors.near_vectors(table).collect()}
    assert len(got) == len(rows)
    for i, (v, *_) in enumerate(rows):
        assert got[v]["n_links"] == len(links[i]), v
        seen, todo = {i}, [i]
        while todo:
            more = links[todo.pop()] - seen
            seen |= more
            todo += more
        least = min(rows[j][0] for j in seen)
        assert got[v]["component_id"] == least and got[v]["kept"] == (v == least)
    assert vectors.near_vectors(table.limit(0)).count() == 0
    assert vectors.near_vectors(table.where("label is null")).first()["n_links"] == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(201)}) == 1 and len({got[i] for i in range(1000, 1100)}) == 1
    assert got[0] != got[1000] and len(got) == 301
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


TALK = [
    (1, 0, "user", "How do I sort a list?\nThanks in advance"),
    (1, 1, "assistant", "> How do I sort a list?\nUse sorted(x)."),
    (1, 2, "user", "On Monday A wrote:\n> > how do I  SORT a list?\n> Use sorted(x).\nThat works, thanks"),
    (1, 3, "user", "> never said\nhm"),
    (1, 4, "assistant", ">> How do I sort a list?\n> That works, thanks\nGood"),
    (2, 0, "user", "Use sorted(x)."),
    (2, 1, "user", "> How do I sort a list?\nno link to another conversation"),
    (None, 0, "user", "> x y z\nnull conversation"),
    (3, None, "user", None),
    (4, 0, "user", ""),
]


def test_quotes_are_linked_and_taken_out(spark):
    table = spark.createDataFrame([(*r, "x") for r in TALK], "conv_id long, turn long, role string, text string, thread string")
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link_quotes(table).collect()}
    assert len(got) == len(TALK)
    assert {k: r["reply_to"] for k, r in got.items() if r["reply_to"] is not None} == {(1, 1): 0, (1, 2): 1, (1, 4): 2}
    assert [got[1, t]["thread"] for t in range(5)] == [0, 0, 0, 3, 0]
    assert [got[1, t]["depth"] for t in range(5)] == [0, 1, 2, 0, 3]
    assert [got[1, t]["body"] for t in range(5)] == ["How do I sort a list?\nThanks in advance", "Use sorted(x).", "That works, thanks", "hm", "Good"]
    assert (got[1, 2]["n_quoted"], got[1, 2]["max_level"], got[1, 2]["n_linked"]) == (2, 2, 2)
    assert got[2, 1]["reply_to"] is None and got[None, 0]["body"] == "null conversation" and got[3, None]["body"] == ""
    twice = table.unionAll(table)
    assert quotes.link_quotes(twice).count() == 2 * len(TALK)
    assert quotes.link_quotes(table.limit(0)).count() == 0


def test_mix_meets_its_targets_with_null_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 100)  # rounds go on into the ties
    rng = random.Random(13)
    rows = [(None, " ".join(["w"] * rng.choice([1, 7, 20])), "", "a", 0) for _ in range(300)]
    rows += [(None, "one two three four", "", "b", 0)] * 200 + [(5, "x y z", "", "c", 0)] * 300 + [(None, None, "", "b", 0)] * 5
    rows += [(i, " ".join(["w"] * rng.choice([1, 7, 20])), "", "d", 0) for i in range(400)]
    docs = documents(spark, rows)
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = naive_targets(dict(sizes))
    taken, words = Counter(), Counter()
    for r in mixing.mix(docs).collect():
        assert r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for r in mixing.mix_rows(docs).collect():
        words[r["source"]] += len((r["text"] or "").split())
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 20 and abs(words[s] - want[s]) <= 20, s


@pytest.mark.parametrize("width", [2, 2048])
def test_vectors_of_very_large_and_very_small_components(spark, monkeypatch, width):
    monkeypatch.setattr(vectors, "MOST_WIDTH", width)
    near = [[1.0, 0.01 * i, 0.0, 0.0] for i in range(4)]
    rows = [(i, v, 1) for i, v in enumerate(near)]
    rows += [(10, [1e-200, 0.0, 0.0, 0.0], 1), (11, [1e200, 1e198, 0.0, 0.0], 1), (12, [0.0, 0.0, 0.0, 5e-324], 1), (13, [0.0, 0.0, 1e308, 1e308], 1), (14, [0.0, 0.0, 2.0, 2.0], 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {i: (5, 0) for i in (0, 1, 2, 3, 10, 11)} | {12: (0, 12), 13: (1, 13), 14: (1, 13)}


def naive_replies(rows, common=16):
    """reply_to of each (conv_id, turn) from texts whose quoted lines start with '> '."""
    own, quoted = {}, {}
    for conv, turn, text in rows:
        for line in text.split("\n"):
            level, rest = (1, line[2:]) if line.startswith("> ") else (0, line)
            if rest.strip():
                if level:
                    quoted.setdefault((conv, turn), []).append(rest)
                else:
                    own.setdefault((conv, rest), set()).add(turn)
    out = {}
    for (conv, turn), lines in quoted.items():
        votes = {}
        for line in lines:
            turns = own.get((conv, line), set())
            for t in [min(turns)] if len(turns) > common else turns:
                if t < turn:
                    votes.setdefault(t, [0, 0])[len(turns) > common] += 1
        if votes:
            out[conv, turn] = max(votes, key=lambda t: (*votes[t], t))
    return out


def test_quotes_vote_for_every_message_that_holds_them(spark):
    rng = random.Random(16)
    rows = []
    for conv in range(6):
        said = [["Best regards", "ok", f"line {conv}"]]
        for turn in range(40):
            lines = [rng.choice(["Best regards", f"n{rng.randrange(60)}", f"u{turn}", "ok"]) for _ in range(rng.randint(1, 5))]
            quoted = [f"> {x}" for x in rng.sample(rng.choice(said), 1)] + ["> Best regards"] * rng.randint(0, 3) + [f"> n{rng.randrange(60)}"]
            rows.append((conv, turn, "\n".join(quoted * (turn > 0) + lines)))
            said.append(lines)
    rows += [(9, 0, "> hello there\u2028friend\nown"), (9, 1, "> one\u0085two\r\nbody"), (9, 2, "x")]
    table = spark.createDataFrame([(c, t, "user", x, "", "") for c, t, x in rows], "conv_id long, turn long, role string, text string, `from` string, level string")
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link_quotes(table).collect()}
    want = naive_replies([r for r in rows if r[0] < 9])
    assert {k: r["reply_to"] for k, r in got.items() if r["reply_to"] is not None} == want
    assert got[9, 0]["body"] == "own" and got[9, 1]["body"] == "body" and got[9, 0]["n_quoted"] == 1


def test_every_earlier_message_gets_a_vote_without_a_bound(spark):
    rng = random.Random(17)
    rows = []
    for conv in range(3):
        for turn in range(60):
            quoted = [f"> {x}" for x in rng.sample(["Regards", "ok", "yes", f"n{rng.randrange(40)}"], rng.randint(1, 3))] * (turn > 0)
            rows.append((conv, turn, "\n".join(quoted + rng.sample(["Regards", "ok", "yes", f"n{rng.randrange(40)}", f"u{turn}"], 3))))
    table = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    bounded, every = [{(r["conv_id"], r["turn"]): r for r in quotes.link_quotes(table, c).collect()} for c in (16, None)]
    want = naive_replies(rows, common=len(rows))
    assert {k: r["reply_to"] for k, r in every.items() if r["reply_to"] is not None} == want != naive_replies(rows)
    assert all(every[k][f] == r[f] for k, r in bounded.items() for f in ("body", "n_quoted", "max_level", "n_linked"))


def test_chat_quotes_every_against_its_sql(spark, tmp_path):
    rng = random.Random(18)
    rows = []
    for conv, lines in [(0, 1), (1, 3), (2, 6), (3, 2)]:
        shared = [f"shared {i}" for i in range(lines)]
        for turn in rng.sample(range(-40, 400), 120):
            quoted = [f"> {x}" for x in rng.choices([*shared, f"n{rng.randrange(60)}", "nobody"], k=rng.randint(0, 4))]
            rows.append((conv, turn, "user", "\n".join(quoted + rng.sample([*shared, f"n{rng.randrange(60)}", f"u{turn}"], rng.randint(1, lines + 1)))))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.queries()["chat_quotes_every"](spark, str(tmp_path))
    sql = duckdb.connect()
    sql.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want, bounded = [Counter(sql.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[q]})").fetchall()) for q in ("chat_quotes_every", "op8_chat_quotes")]
    assert Counter(tuple(r) for r in got.collect()) == want != bounded


def test_shards_against_a_ring_walked_key_by_key(spark):
    shards = 5
    docs = spark.createDataFrame([(i if i % 9 else None, f"t{i % 40}") for i in range(700)], "doc_id long, text string")
    got = sharding.shard_documents(docs, shards).collect()
    nodes = sharding.ring(shards)
    room = [len(got) // shards + (s < len(got) % shards) for s in range(shards)]
    late: dict = {}
    arc = lambda pos: next((i for i, (p, _) in enumerate(nodes) if p >= pos), 0)
    order = sorted(got, key=lambda r: (arc(r["pos"]), r["pos"], r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]))
    want = []
    for r in order:  # first every key that finds room at home, then the others clockwise
        s = nodes[arc(r["pos"])][1]
        if room[s]:
            room[s] -= 1
            want.append((r, s))
        else:
            late.setdefault(arc(r["pos"]), []).append(r)
    for a in sorted(late):
        step = a
        for r in late[a]:
            while not room[nodes[step][1]]:
                step = (step + 1) % len(nodes)
            room[nodes[step][1]] -= 1
            want.append((r, nodes[step][1]))
    key = lambda r, s: (str(r["doc_id"]), r["text_crc32"], r["pos"], s)
    assert sorted(key(r, r["shard"]) for r in got) == sorted(key(r, s) for r, s in want)
