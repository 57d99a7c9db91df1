import random
import re

from worksight.llm import near_dup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, width):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").encode().lower())
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def corpus(n, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["Straße", "ab", "été", "the", "word"]) + str(rng.randint(0, 80))
    bases = [[word() for _ in range(rng.choice([1, 2, 5, 30, 120]))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, max(1, len(w) // 12))):
            w[rng.randrange(len(w))] = word()
        rows.append((i * 3, rng.choice([" ", "\n", "\t "]).join(w)))
    return rows


def test_equals_brute_force(spark):
    rows = corpus(150, 1) + [(9001, None), (9002, ""), (9003, " \n "), (9004, "one"), (9005, "ONE"), (9006, "x" * 70000 + " y z"), (9007, "x" * 70000 + " Y z")]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, component_id string, n long")
    got = near_dup.near_duplicates(df, width=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 2)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_hot_family_and_hubs_that_miss(spark, monkeypatch):
    # many members of one bucket that no hub links: blocks of four, so that families meet across blocks
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 4)
    monkeypatch.setattr(near_dup, "SALT_ROWS", 3)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.choice([2, 3, 6, 7])):
            w[rng.randrange(60)] = f"x{rng.randint(0, 40)}"
        rows.append((i, " ".join(w)))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=1).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 1)


def test_empty_table_nulls_and_repeats(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (7, "q r s t u v"), (9, "q r s t u v")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.near_duplicates(df).collect()
    assert len(got) == 6 and {r.component_id for r in got if r.doc_id} == {7} and all(r.kept for r in got if r.doc_id is None)
    left = near_dup.deduplicate(df)
    assert left.columns == df.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 0, 7, 7, 7]


def test_estimates_follow_similarity():
    import numpy as np

    rng = np.random.default_rng(0)
    for share in (0.3, 0.8, 0.95):
        seen = []
        for _ in range(40):
            both, rest = rng.integers(0, 1 << 63, int(400 * share), dtype=np.uint64), rng.integers(0, 1 << 63, 400, dtype=np.uint64)
            n = (400 - len(both)) // 2
            sets = [np.unique(np.append(both, rest[:n])), np.unique(np.append(both, rest[n : 2 * n]))]
            regs = near_dup.registers(sets)
            true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
            seen.append(near_dup.estimate(regs[:1], regs[1:], np.array([len(sets[0])]), np.array([len(sets[1])]))[0] - true)
        assert abs(np.mean(seen)) < 0.02 and np.max(np.abs(seen)) < 0.2


def test_near_copies_of_each_text_of_a_repeated_id(spark):
    base = {p: [f"{p}{k}" for k in range(60)] for p in "ab"}
    rows = [(1, " ".join(base["a"])), (1, " ".join(base["b"])), (2, " ".join([*base["a"][:-1], "x"])), (3, " ".join([*base["b"][:-1], "y"])), (4, " ".join(f"c{k}" for k in range(60)))]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_sets_of_one_id_are_counted_apart(spark):
    """A document that shares one shingle only, beside a short one with the same id that has a near copy, hides no link of that one."""
    short = [f"s{k}" for k in range(30)]
    long = short[:2] + [f"l{k}" for k in range(400)]
    docs = spark.createDataFrame([(1, " ".join(short)), (1, " ".join(long)), (2, " ".join([*short[:-1], "other"]))], "doc_id long, text string")
    held = spark.createDataFrame([(7, 1, 30, 1), (7, 1, 401, 1), (7, 2, 29, 2)], "key long, rep long, n long, comp long")
    rows, sets = near_dup.linkable(docs, held, 2, 80)
    assert {r["rep"] for r in rows.collect()} == {1, 2} and sets.count() == 3
    assert {(r["doc_id"], r["component_id"]) for r in near_dup.near_duplicates(docs, width=2).collect()} == {(1, 1), (2, 1)}


def test_long_texts_link_by_their_whole_sets(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120_000)]
    near = words[:55_000] + [f"x{k}" for k in range(5_000)] + words[60_000:]
    far = words[:60_000] + [f"y{k}" for k in range(60_000)]
    docs = spark.createDataFrame([(5, " ".join(words)), (6, " ".join(near)), (7, " ".join(far))], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in near_dup.near_duplicates(docs).collect()} == {(5, 5), (6, 5), (7, 7)}
