import numpy as np
import pytest

from paperloom.llm import op1_itq, op4_simhash
from paperloom.llm.common import components, tile_hot


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 130)}, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shared_folder_is_refused_on_a_cluster_without_the_setting(spark):
    from types import SimpleNamespace

    from paperloom.llm.common import dropped, shared_dir, written

    cluster = SimpleNamespace(sparkContext=SimpleNamespace(master="yarn"), conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(ValueError):
        shared_dir(cluster)
    df = written(spark.range(3), "test")
    assert df.count() == 3 and spark.sparkContext.applicationId in shared_dir(spark)
    dropped(df)
    with pytest.raises(Exception):
        spark.read.schema("id long").parquet(df._paperloom_path).count()


def test_tiles_let_every_pair_of_a_hot_group_meet_once(spark):
    df = spark.createDataFrame([("h", i) for i in range(30)] + [("c", 99)], "k string, id long")
    rows = tile_hot(df, ["k"], "id", 8).collect()
    met = {}
    for i in rows:
        for j in rows:
            if i.k == j.k and i.id < j.id and (i.cell_i, i.cell_j) == (j.cell_i, j.cell_j) and (i.cell_i == i.cell_j or i.tile != j.tile):
                met[i.id, j.id] = met.get((i.id, j.id), 0) + 1
    assert len(met) == 30 * 29 // 2 and set(met.values()) == {1}


def brute_fingerprint(text):
    """Bit by bit, as the contract says."""
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_match_spark_and_brute_force(spark, odd_docs):
    rows = {(r.doc_id, r.text): None for r in odd_docs.select("doc_id", "text").collect()}
    got = op4_simhash.fingerprints(odd_docs).collect()
    assert len(got) == odd_docs.count()
    want = sorted(brute_fingerprint(t) for _, t in rows)
    assert sorted({r.fp % (1 << 64) for r in got}) == sorted(set(want))
    h = spark.sql("select xxhash64('a b c d') h").first().h % (1 << 64)
    assert op4_simhash.fingerprint(b"A b C d") == h


def test_masks_share_a_file_for_any_four_bits():
    rng = np.random.default_rng(1)
    for _ in range(2000):
        x = int(rng.integers(0, 1 << 63)) * 2
        y = x
        for b in rng.choice(64, 4, replace=False):
            y ^= 1 << int(b)
        hit = [i for i, m in enumerate(op4_simhash.MASKS) if x & m == y & m]
        assert hit and all(any(x & m == y & m for m in op4_simhash.FINER[i]) for i in hit)


@pytest.mark.parametrize("hot_rows", [4096, 6])
def test_simhash_components_match_all_pairs(spark, hot_rows):
    rng = np.random.default_rng(3)
    centres = [int(rng.integers(0, 1 << 62)) for _ in range(20)]
    fps = []
    for c in centres:
        for _ in range(15):
            x = c
            for b in rng.choice(64, int(rng.integers(0, 5)), replace=False):
                x ^= 1 << int(b)
            fps.append(x)
    fps += [int(rng.integers(0, 1 << 62)) for _ in range(100)]
    n = len(fps)
    want = roots(n, [(i, j) for i in range(n) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4])
    docs = spark.createDataFrame([(i, op4_simhash._signed(x)) for i, x in enumerate(fps)], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in op4_simhash.components_of(docs, hot_rows).collect()}
    assert [got[op4_simhash._signed(x)] for x in fps] == want


def test_simhash_of_odd_rows(spark, odd_docs, no_docs):
    rows = op4_simhash.simhash(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[0].fingerprint == "0" * 16 and {by[i].component_id for i in (0, 1, 2)} == {0}
    assert by[5].component_id == by[6].component_id == 5
    null = next(r for r in rows if r.doc_id is None)  # the same text as document 9
    assert null.component_id == 9 == by[9].component_id
    kept = sorted(r.doc_id for r in op4_simhash.keep_first(odd_docs).collect())  # the row without an id is a copy of 9's
    assert kept == sorted({r.component_id for r in rows})
    assert op4_simhash.simhash(no_docs).count() == 0 and op4_simhash.keep_first(no_docs).count() == 0


def test_pivots_discard_all_but_near_pairs():
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 1 << 63, 1500, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 1500, dtype=np.uint64)
    for i in range(0, 300, 2):  # partners at 0 to 12 bits
        fp[i + 1] = fp[i] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, i % 13, replace=False)))
    group = np.repeat(np.arange(3), 500)
    table = op4_simhash.coordinates(fp).astype(int)
    assert len(set(map(int, op4_simhash.PIVOTS))) == 64 == len(table)
    x, y = np.triu_indices(1500, 1)
    d = np.bitwise_count(fp[x] ^ fp[y]).astype(int)
    spread = table[:, x[::997]] - table[:, y[::997]]
    assert ((spread**2).sum(0) == 64 * d[::997]).all()  # so every pair above 16 bits differs by more than 4 somewhere
    counts = {}
    a, b = op4_simhash.links(group, fp, counts)
    near = (d <= 4) & (group[x] == group[y])
    assert {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())} == set(zip(x[near].tolist(), y[near].tolist()))
    assert counts["filed"] == 3 * 500 * 499 // 2 > counts["window"] > 1000 * counts["pivots"] and counts["pivots"] <= int(((d <= 16) & (group[x] == group[y])).sum()) and counts["links"] == near.sum()


def test_every_component_keeps_one_row(spark):
    """One id on two texts, an id that names another component, rows without an id, repeated rows."""
    r = np.random.default_rng(4)
    words = [" ".join(r.choice(["ab", "cd", "ef", "gh", "ij", "kl", "mn"], 30)) for _ in range(6)]
    a, b, c, d, e, f = words
    rows = [(3, b), (5, a), (9, a), (5, b), (20, c), (20, d), (None, e), (None, e), (None, c), (7, f), (7, f), (7, None), (8, ""), (None, None)]
    rows = [(i, t, lang, None, None) for (i, t), lang in zip(rows, "de en fr es de en fr es de en fr es de en".split())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    kept = sorted(((x.doc_id, x.text, x.lang) for x in op4_simhash.keep_first(docs).collect()), key=str)
    fp = [brute_fingerprint(t) for _, t, *_ in rows]
    group = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bin(fp[i] ^ fp[j]).count("1") <= 4])
    assert len(kept) == len(set(group)) == 7
    assert kept == sorted([(3, b, "de"), (5, a, "en"), (20, c, "de"), (20, d, "en"), (None, e, "es" if "es" < "fr" else "fr"), (7, f, "en"), (7, None, "es")], key=str)
    assert kept == sorted(((x.doc_id, x.text, x.lang) for x in op4_simhash.keep_first(docs.repartition(2)).collect()), key=str)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n long, a long, id long, copies long, v string")


def test_itq_finds_what_brute_force_finds(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((700, 32))
    noise = rng.standard_normal((700, 32))
    x[300:600] = x[:300] / np.linalg.norm(x[:300], axis=1, keepdims=True) + 0.13 * noise[:300] / np.linalg.norm(noise[:300], axis=1, keepdims=True)
    x[650:] = x[0]  # copies
    x = x.astype(np.float32)
    label = [int(i % 2) for i in range(300)] + [int(i % 2) for i in range(300)] + [0] * 100
    df = vectors(spark, [(i, x[i].tolist(), label[i], *[None] * 5) for i in range(700)])
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (u @ u.T >= 0.98) & (np.array(label)[:, None] == np.array(label)[None, :])
    np.fill_diagonal(want, False)
    got = {r.vec_id: r for r in op1_itq.near_duplicates(df, hot_rows=16).collect()}
    n = np.array([got[i].n_links for i in range(700)])
    assert (n <= want.sum(1)).all() and n.sum() >= 0.97 * want.sum()
    assert got[650].n_links >= 50 and {got[i].component_id for i in range(650, 700)} == {got[0].component_id}
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    again = {r.vec_id: (r.n_links, r.component_id) for r in op1_itq.near_duplicates(df).collect()}
    assert again == {k: (r.n_links, r.component_id) for k, r in got.items()}  # cells change nothing


@pytest.mark.parametrize("dims, common", [(8, 0), (16, 0), (32, 0), (64, 2)])
def test_itq_recall_in_few_dimensions_and_around_a_common_mean(spark, dims, common):
    """Pairs just above the threshold; ``common``: norm of a part that all vectors share, against 1 for each one's own."""
    rng = np.random.default_rng(dims)
    x = rng.standard_normal((400, dims)) / np.sqrt(dims)
    x += common * np.eye(dims)[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = rng.standard_normal((400, dims))
    other -= (other * x).sum(1, keepdims=True) * x
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    angle = np.arccos(0.983)
    both = np.concatenate([x, np.cos(angle) * x + np.sin(angle) * other]).astype(np.float32)
    u = both.astype(float) / np.linalg.norm(both.astype(float), axis=1, keepdims=True)
    want = u @ u.T >= 0.98
    np.fill_diagonal(want, False)
    df = vectors(spark, [(i, v.tolist(), 1, *[None] * 5) for i, v in enumerate(both)])
    got = {r.vec_id: r.n_links for r in op1_itq.near_duplicates(df).collect()}
    n = np.array([got[i] for i in range(800)])
    assert (n <= want.sum(1)).all() and n.sum() >= 0.95 * want.sum()


def test_itq_of_two_lengths_in_one_label(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.standard_normal(40 if i % 2 else 64).tolist(), 1) for i in range(60)]
    rows += [(100 + i, [2 * x for x in rows[i][1]], 1) for i in range(60)]
    got = {r.vec_id: r for r in op1_itq.near_duplicates(vectors(spark, [(*r, *[None] * 5) for r in rows])).collect()}
    assert all(got[i].n_links == 1 and got[100 + i].component_id == i for i in range(60))


def test_itq_of_odd_rows(spark):
    e = [1.0, 2.0, 3.0]
    rows = [(1, e, 1), (2, e, 1), (3, e, 2), (4, e, None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 3.0], 1), (8, [1.0, float("nan"), 3.0], 1), (9, [float("inf"), 2.0, 3.0], 1), (10, [], 1), (11, [1.0, 2.0], 1), (None, e, 1), (2, e, 1), (12, [2.0, 4.0, 6.0], 1)]
    got = op1_itq.near_duplicates(vectors(spark, [(*r, *[None] * 5) for r in rows])).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert by[1] == [(4, 1, True)] and by[2] == [(4, 1, False)] * 2 and by[None] == [(4, 1, False)] and by[12] == [(4, 1, False)]
    assert all(by[i] == [(0, i, True)] for i in (3, 4, 5, 6, 7, 8, 9, 10, 11))
    assert op1_itq.near_duplicates(vectors(spark, [])).count() == 0
