import itertools
import re
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pytest
import xxhash

from widegrain.llm import embedding_dedup, kernels, line_dedup, shingle_dedup, simhash_dedup, substring_dedup
from widegrain.llm.components import Forest, connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def groups(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components_on_paths_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 180)] + [(200, 201), (201, 202), (202, 200), (300, 300), (None, 4)]
    found = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 180)} | {i: 200 for i in (200, 201, 202)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_keeps_components():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 300, 400), rng.integers(0, 300, 400)
    f = Forest(300)
    f.add(a[:150], b[:150])
    f.add(a[150:], b[150:])
    x, y = f.edges()
    assert groups(300, zip(a.tolist(), b.tolist())) == groups(300, zip(x.tolist(), y.tolist())) and len(x) < 300


# -- SimHash


def fingerprint(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_xxh64_of_every_length():
    data = np.random.default_rng(1).integers(0, 256, 400).astype(np.uint8)
    at, size = np.arange(200), np.arange(200) % 120
    assert [int(h) for h in kernels.xxh64_spans(data, at, size)] == [xxhash.xxh64_intdigest(data[a : a + n].tobytes(), 42) for a, n in zip(at, size)]


def test_long_spans_and_unlike_words_of_equal_polynomials():
    data = np.random.default_rng(1).integers(0, 256, 4000).astype(np.uint8)
    assert int(kernels.xxh64_spans(data, np.array([3]), np.array([3500]), 7)[0]) == xxhash.xxh64_intdigest(data[3:3503].tobytes(), 7)
    # Words that every polynomial modulo 2**64 takes for equal.
    a, b = thue_morse()
    buf = np.frombuffer((a + b).encode(), np.uint8)
    x, y = kernels.span_hashes(buf, np.array([0, 1024]), np.array([1024, 2048]))
    assert x != y


def thue_morse():
    a = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_keys_meet_within_four_bits():
    rng, golay = np.random.default_rng(2), simhash_dedup.Golay()
    x = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, 4, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    sets = []
    for z in (x, y):
        own = defaultdict(set)
        for r, k in zip(*simhash_dedup.bucket_keys(z, golay)):
            own[r].add(k)
        sets.append(own)
    assert all(sets[0][i] & sets[1][i] for i in range(len(x)))


@pytest.mark.parametrize("rows", [8192, 3])
def test_simhash_equals_all_pairs(spark, awkward, monkeypatch, rows):
    monkeypatch.setattr(simhash_dedup, "BUCKET_ROWS", rows)
    found = simhash_dedup.simhash_components(awkward, shingle=4).collect()
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    fps = [fingerprint(t, 4) for _, t in rows]
    root = groups(len(rows), [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if bin(fps[a] ^ fps[b]).count("1") <= 4])
    least = {g: min((rows[i][0] for i in range(len(rows)) if root[i] == g and rows[i][0] is not None), default=None) for g in set(root)}
    want = Counter((rows[i][0], fps[i], least[root[i]]) for i in range(len(rows)))
    assert Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in found) == want


def test_simhash_keeps_one_of_each_group(awkward, empty):
    kept = simhash_dedup.simhash_keep_first(awkward)
    assert kept.columns == awkward.columns
    ids = Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    assert ids[20] == 2 and 21 not in ids and ids[23] == 1 and 24 not in ids and ids[None] == 2
    assert simhash_dedup.simhash_keep_first(empty).count() == 0


# -- shingle sets


def shingle_set(text, k=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


@pytest.mark.parametrize("rows, often", [(8192, 8), (3, 2)])
def test_shingle_links_equal_all_pairs(spark, awkward, monkeypatch, rows, often):
    import random

    import corpus_pipeline

    monkeypatch.setattr(shingle_dedup, "BUCKET_ROWS", rows)
    monkeypatch.setattr(shingle_dedup, "OFTEN", often)
    rng = random.Random(6)
    texts = []
    for _ in range(30):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(6, 250))]
        for edits in (0, 1, 1, 2, 3, 5):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 99999)}"
            texts.append(" ".join(copy))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{passage} {' '.join(f'q{i}x{j}' for j in range(rng.randint(3, 60)))}" for i in range(40)]
    docs = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").union(awkward.select("doc_id", "text"))
    data = [(r["doc_id"], shingle_set(r["text"])) for r in docs.collect()]
    near = [(a, b) for a, b in itertools.combinations(range(len(data)), 2) if data[a][1] == data[b][1] or 9 * len(data[a][1] & data[b][1]) >= 4 * (len(data[a][1]) + len(data[b][1]))]
    jaccard = [len(data[a][1] & data[b][1]) / len(data[a][1] | data[b][1]) for a, b in near if data[a][1]]
    assert sum(0.8 <= j < 0.95 for j in jaccard) > 50
    root = groups(len(data), near)
    least = {g: min((data[i][0] for i in range(len(data)) if root[i] == g and data[i][0] is not None), default=None) for g in set(root)}
    found = shingle_dedup.shingle_components(docs).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in found) == Counter((data[i][0], least[root[i]]) for i in range(len(data)))
    gone = {i for i, (d, _) in enumerate(data) if d is not None and d != least[root[i]]}
    gone = {data[i][0] for i in gone}
    kept = Counter(r["doc_id"] for r in corpus_pipeline.simhash_stage(spark, docs, "").collect())
    assert kept == Counter(d for d, _ in data if d not in gone)


def test_shingle_dedup_of_no_rows(empty):
    assert shingle_dedup.shingle_keep_first(empty).count() == 0


# -- substrings


def brute_substrings(rows, window):
    seen, out = {}, {}
    order = sorted({(i if i is not None else 1 << 63, t) for i, t in rows}, key=lambda r: r[0])
    for i, t in order:
        w = WORD.findall(t or "")
        gone = set()
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                gone |= set(range(s, s + window))
            seen.setdefault(k, (i, s))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i, t] = (len(w), len(gone), sha256(kept.encode()).hexdigest())
    return out


def test_substrings_equal_brute_force(spark, awkward, empty):
    rows = [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()]
    # Two texts of null id are ordered by hash, which brute force doesn't know: keep one.
    rows = [r for r in rows if r[0] is not None] + [(None, rows[-1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_substrings(rows, 20)
    found = substring_dedup.dedup_substrings(df, digest=True).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == Counter((i, *want[i if i is not None else 1 << 63, t]) for i, t in rows)
    assert substring_dedup.dedup_substrings(empty).count() == 0
    texts = {r["doc_id"]: r["kept_text"] for r in substring_dedup.dedup_substrings(awkward).where("doc_id in (21, 22, 30)").collect()}
    assert texts[21] == "" and texts[22].endswith("tail") and texts[30] == "no break café \U0001f44d"


def test_unlike_words_and_the_greatest_id_keep_their_rows(spark):
    x, y = thue_morse()
    tail = " ".join(f"t{i}" for i in range(19))
    rows = [(1, f"{x} {tail}"), (2, f"{y} {tail}"), ((1 << 63) - 1, f"{x} {tail}"), (None, f"{x} {tail} u")]
    found = {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 0, 2: 0, (1 << 63) - 1: 20, None: 20}


def test_periodic_texts_equal_sql(spark):
    import random

    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 70)))) for i in range(120)] + [(200, "x " * 100), (201, "a b " * 40)]
    found = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), digest=True).collect()
    want = brute_substrings(rows, 20)
    assert all((r["n_words"], r["n_removed"], r["kept_sha256"]) == want[rows[[x[0] for x in rows].index(r["doc_id"])]] for r in found)


# -- lines


def test_patience_finds_a_longest_run():
    import random

    rng = random.Random(5)
    for _ in range(200):
        places = rng.sample(range(30), rng.randint(1, 12))
        found = line_dedup.aligned(list(enumerate(places)))
        assert all(places[a] < places[b] for a, b in zip(found, found[1:]))
        best = max(len(c) for n in range(1, len(places) + 1) for c in itertools.combinations(places, n) if list(c) == sorted(c))
        assert len(found) == best


def brute_lines(rows, words=8):
    """Deleted lines of every row, by aligning each document with every earlier one."""
    order = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: r[0])
    anchors = {}
    for r in order:
        seen, own = Counter(), []
        for line in r[1].split("\n"):
            if WORD.search(line):
                line = line.strip(" \t\n\x0b\x0c\r")
                own.append((line, seen[line]))
                seen[line] += 1
        anchors[r] = own
    gone = {}
    for n, d in enumerate(order):
        lost = set()
        for e in order[:n]:
            place = {x: j for j, x in enumerate(anchors[e])}
            shared = [(i, place[x]) for i, x in enumerate(anchors[d]) if x in place]
            for first, size in line_dedup.common_blocks(shared):
                if sum(len(WORD.findall(x)) for x, _ in anchors[d][first : first + size]) >= words:
                    lost |= set(range(first, first + size))
        gone[d] = lost
    return gone


def test_blocks_go_from_the_later_document(spark, awkward, empty):
    a = "first line of eight words is right here\nsecond line of eight words is also here\n\nthird one"
    rows = [(1, a), (2, "own words at the start\n" + a + "\nown words at the end"), (3, "second line of eight words is also here\nfirst line of eight words is right here"), (4, None), (5, ""), (1, a)]
    # A block that its lines' first owner has in the other order, and two short lines of different documents.
    rows += [(11, "b1 two three four five\na1 two three four five"), (12, "a1 two three four five\nb1 two three four five"), (13, "x\na1 two three four five\nb1 two three four five")]
    rows += [(21, "c1 two three four five\nother"), (22, "d1 two three four five\nelse"), (23, "c1 two three four five\nd1 two three four five")]
    # Lines that a polynomial modulo 2**64 takes for equal.
    x, y = thue_morse()
    rows += [(31, x + " in a line of at least eight words"), (32, y + " in a line of at least eight words")]
    found = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed_lines"]) for r in line_dedup.dedup_blocks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1] == (a, 3, 0) and found[2] == ("own words at the start\nown words at the end", 5, 3) and found[3] == ("", 2, 2)
    assert found[4] == (None, 0, 0) and found[5] == ("", 0, 0)
    assert [found[i][2] for i in (11, 12, 13, 21, 22, 23, 31, 32)] == [0, 0, 2, 0, 0, 0, 0, 0] and found[13][0] == "x"
    out = line_dedup.dedup_blocks(awkward)
    assert out.columns == [*awkward.columns, "n_lines", "n_removed_lines"] and out.count() == awkward.count()
    assert line_dedup.dedup_blocks(empty).count() == 0


def test_deleted_lines_equal_aligning_all_pairs(spark):
    import random

    rng = random.Random(8)
    pool = [" ".join(f"p{j}w{k}" for k in range(rng.choice([1, 2, 3, 5, 8, 11]))) for j in range(14)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(70)]
    rows += [(i, rows[i][1]) for i in (3, 4, 5)] + [(100 + i, rows[i][1] + "\n\n" + rows[i + 1][1]) for i in range(10)]
    want = brute_lines(rows)
    found = line_dedup.dedup_blocks(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    assert sum(map(len, want.values())) > 60
    assert Counter((r["doc_id"], r["text"], r["n_removed_lines"]) for r in found) == Counter((i, line_dedup.strip_lines(t, want[i, t])[0], len(want[i, t])) for i, t in rows)


def test_query_and_stage_delete_blocks_of_any_group_size(spark, tmp_path):
    import corpus_pipeline

    line = "a common line that very many documents share"
    for n in (3, 64, 65, 200):
        rows = [(i, f"{line}\nbut document {i} has this other line as its own") for i in range(n)]
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{n}/documents.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{n}/documents.parquet")
        for out in (line_dedup.query(spark, f"{tmp_path}/{n}"), corpus_pipeline.line_stage(spark, docs, "")):
            assert [r["doc_id"] for r in out.collect() if line in r["text"]] == [0]


# -- embeddings


def test_plans_prune_clusters_and_never_exceed_all_pairs():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(200, 64))
    clustered = np.repeat(centres, 20, axis=0) + rng.normal(scale=0.1, size=(4000, 64))
    for x, most in ((clustered[rng.permutation(4000)], 0.1), (rng.normal(size=(4000, 64)), 1.0)):
        y = embedding_dedup.rotate(x, embedding_dedup.rotation(64))
        plan = embedding_dedup.choose_plan(y[:3000], 10_000_000, 0.1)
        tests, _ = embedding_dedup.plan_work(y, plan)
        assert tests.sum() <= most + 1e-9 and (most == 1.0 or len(plan[0].pivots) > 1)


@pytest.mark.parametrize("blocks,pivots,chunk", [(None, None, 16384), (4, 8, 7), (8, 40, 16384), (1, 5, 30)])
def test_embeddings_equal_all_pairs(spark, blocks, pivots, chunk):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 24))
    x = np.concatenate([c + rng.normal(scale=0.28, size=(25, 24)) for c in centres] + [rng.normal(size=(40, 24))]).astype(np.float32)
    x[30] = x[3]
    x[31] = x[3] * 2
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    bad = [(1000, None, 0), (1001, [0.0] * 24, 0), (1002, [float("nan")] + [1.0] * 23, 0), (1003, [None] + [1.0] * 23, 0), (1004, [], 0), (1005, [float("inf")] * 24, 0), (1006, x[3].tolist()[:23], 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int")
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_vectors(df, blocks=blocks, pivots=pivots, chunk=chunk).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T >= 0.95
    root = groups(len(x), [(a, b) for a, b in zip(*np.nonzero(np.triu(near, 1)))])
    assert near.sum() > 2 * len(x)
    assert {i: found[i] for i in range(len(x))} == {i: (int(near[i].sum()) - 1, root[i], root[i] == i) for i in range(len(x))}
    assert all(found[i] == (0, i, True) for i, *_ in bad)
    c = duckdb.connect()
    c.execute("CREATE TABLE embeddings(vec_id BIGINT, embedding FLOAT[])")
    c.executemany("INSERT INTO embeddings VALUES (?, ?)", [(i, v) for i, v, _ in rows + bad])
    assert {r[0]: r[1:] for r in c.sql(embedding_dedup.ORACLE_SQL).fetchall()} == found
    assert embedding_dedup.near_vectors(df.where("false")).count() == 0
    # Repeated ids, and columns whose names the operator uses itself.
    twice = df.where("vec_id < 3").union(df.where("vec_id = 1")).selectExpr("vec_id", "embedding", "1 AS cid", "'x' AS e", "2 AS n", "null AS block")
    again = {(r["vec_id"], r["n_links"]) for r in embedding_dedup.near_vectors(twice).collect()}
    one = near[:3, :3].sum(axis=1) + near[:3, 1] - 1
    assert again == {(i, int(one[i])) for i in range(3)}


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(9)
    for _ in range(200):
        base = rng.integers(0, 1 << 63, int(rng.integers(1, 900))).astype(np.uint64)
        other = np.concatenate([base[: int(rng.integers(0, len(base) + 1))], rng.integers(0, 1 << 63, int(rng.integers(0, 600))).astype(np.uint64)])
        gap = shingle_dedup.parity_gap(shingle_dedup.parities(base), shingle_dedup.parities(other))
        assert gap <= len(np.setxor1d(base, other)) and shingle_dedup.parity_gap(shingle_dedup.parities(other), shingle_dedup.parities(base)) == gap
