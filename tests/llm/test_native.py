import hashlib
import math
import random
import re
import zlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from worksight.llm import decontaminate, mixing, queries, secrets, sharding, urls


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash") for i, t, s in rows], "doc_id long, text string, source string, size string")


def test_shards_hold_whole_groups_evenly(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["é", "b"]) * rng.randint(0, 900), None) for i in range(700)] + [(1000 + i, "copy" * 50, "s") for i in range(90)] + [(5000, None, None), (5001, "", None), (5001, "", None)]
    got = sharding.shard(docs(spark, rows)).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"} and all(r.grown_shard is None for r in got)
    texts = {i: (t or "") for i, t, _ in rows}
    for r in got:
        assert r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
    where, sizes = {}, Counter()
    for r in got:
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
        sizes[r.shard] += r["size"]
    assert all(len(s) == 1 for s in where.values()) and max(sizes.values()) - min(sizes.values()) <= 0.03 * sum(sizes.values()) / 8
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard(docs(spark, [])).count() == 0


def test_a_group_above_a_shard_is_cut(spark):
    got = sharding.shard(docs(spark, [(i, "x" * 99, "s") for i in range(400)] + [(999, "y", "s")])).collect()
    sizes = Counter(r.shard for r in got)
    assert len(sizes) == 8 and max(sizes.values()) < 75


def plain_packing(sizes, capacity):
    """Best-fit-decreasing item by item: the contents of the bins, as sorted sizes."""
    free, bins = [], []
    for size in sorted(sizes, reverse=True):
        fits = [(f, b) for b, f in enumerate(free) if f >= size]
        if fits:
            b = min(fits)[1]
            free[b] -= size
        else:
            b = len(free)
            free.append(capacity - size)
            bins.append([])
        bins[b].append(size)
    return sorted(sorted(b) for b in bins)


def test_best_fit_decreasing_equals_a_plain_one():
    rng = random.Random(3)
    for _ in range(60):
        sizes = [rng.randint(1, rng.choice([9, 60, 130])) for _ in range(rng.randint(1, 80))]
        bins: dict = {}
        for size, first, end, b in sharding.best_fit_decreasing(dict(Counter(sizes)), 100):
            bins.setdefault(b, []).extend([size] * (end - first))
        assert sorted(sorted(b) for b in bins.values()) == plain_packing(sizes, 100)


def test_shards_of_a_capacity_equal_a_plain_packing(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abc") for _ in range(rng.choice([0, 1, 2, 5, 30, 90]))), None) for i in range(900)] + [(2000 + i, "y" * 9, None) for i in range(120)] + [(3000, "z" * 500, None)]
    got = sharding.shard(docs(spark, rows), shards=None, capacity=256).collect()
    texts, groups, held, sizes = {i: t for i, t, _ in rows}, Counter(), {}, Counter()
    for t in texts.values():
        groups[t] += len(t) + 1
    for r in got:
        held.setdefault(texts[r.doc_id], set()).add(r.shard)
        sizes[r.shard] += r["size"]
    items = []
    for t, size in groups.items():
        items += [size] if size <= 256 else [len(t) + 1] * (size // (len(t) + 1))
        assert size > 256 or len(held[t]) == 1
    assert sorted(sizes.values()) == sorted(sum(b) for b in plain_packing(items, 256))
    assert sorted(got, key=lambda r: r.doc_id) and sum(v > 256 for v in sizes.values()) == 1 and len(got) == len(rows)
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_many_small_groups_stay_within_the_capacity(spark):
    small = spark.range(200_000).select(F.col("id").alias("doc_id"), F.substring(F.conv("id", 10, 36), 1, 6).alias("text"))
    got = sharding.shard(small, shards=None, capacity=2048).groupBy("shard").agg(F.sum("size").alias("b"), F.max("slot").alias("top"), F.count("slot").alias("n"))
    total, least, most, bins, good = got.agg(F.sum("b"), F.min("b"), F.max("b"), F.count("b"), F.bool_and(F.col("top") == F.col("n") - 1)).first()
    assert most <= 2048 and bins == -(-total // 2048) and good


def test_mix_meets_targets(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.choice([1, 2]) for _ in range(rng.choice([3, 30, 300, 900 if i % 50 == 0 else 10]))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(1200)]
    rows += [(5000, None, "a"), (5001, " \n", None), (5002, "tiny one", "zz")]
    df = docs(spark, rows)
    got = {r.doc_id: r for r in mixing.mixed(df).collect()}
    again = {r.doc_id: r.taken for r in mixing.mixed(df.repartition(7)).collect()}
    assert {k: r.taken for k, r in got.items()} == again
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    by = Counter()
    for i, _, s in rows:
        by[s] += size[i]
    names = sorted((s for s in by if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), sum(by.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * by[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3 * by[s]
            left -= 3 * by[s]
            free.discard(s)
    taken = Counter()
    for i, _, s in rows:
        assert got[i]["size"] == size[i] and got[i].taken <= 3 * size[i] and math.isclose(got[i].target, target[s], rel_tol=1e-9) and got[i].source_size == by[s]
        taken[s] += got[i].taken
    for s in names:
        assert abs(taken[s] - target[s]) <= max(10, 0.01 * target[s])
    mix = mixing.mix(df)
    assert mix.columns == df.columns and mix.agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0] == sum(taken.values())
    assert mixing.mixed(docs(spark, [])).count() == 0


def test_dependent_rounding_keeps_expectations(spark):
    rows = [(i, "w " * (1 + i % 7), "abc"[i % 3]) for i in range(240)]
    df = docs(spark, rows)
    total = Counter()
    for seed in range(12):
        for r in mixing.mixed(df, seed=seed * 10).collect():
            total[r.source] += r.copies
    wanted = {r.source: r.want for r in mixing.mixed(df).groupBy("source").agg(F.sum(F.col("target") / F.col("source_size")).alias("want")).collect()}
    assert all(abs(total[s] / 12 - w) < 0.1 * w + 1 for s, w in wanted.items())


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["Ünit", "alpha", "b2", "gamma", "Delta", "x"]) + rng.choice(["", "1", "22"])
    items = [(k, " ".join(word() for _ in range(rng.choice([3, 9, 10, 14, 25])))) for k in range(25)] + [(90, None), (91, "..."), (92, "solo")]
    rows = []
    for i in range(80):
        text = [word() for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            piece = (rng.choice(items[:25])[1]).split()
            text[rng.randint(0, len(text)) :][:0] = piece
            cut = rng.randint(0, len(text))
            text = text[:cut] + piece[rng.randint(0, 3) :] + text[cut:]
        rows.append((i, rng.choice([" ", "-", ", "]).join(text).upper() if i % 5 == 0 else " ".join(text), None))
    rows += [(900, None, None), (901, "", None), (902, "--- solo!", None), (902, "--- solo!", None)]
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(docs(spark, rows), bench).collect()
    assert len(got) == len(rows) and "size" in got[0].asDict()
    want = {}
    for i, t, _ in rows:
        w, hit, ids = find.findall(lower(t)), set(), set()
        for k, b in items:
            v = find.findall(lower(b))
            n = min(10, len(v))
            for s in range(len(v) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit |= set(range(p, p + n))
                        ids.add(str(k))
        want[i] = (len(w), len(hit), sorted(ids))
    assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in got} == want
    kept = {r.doc_id for r in decontaminate.remove_documents(docs(spark, rows), bench).collect()}
    assert kept == {i for i, w in want.items() if not w[1]}
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs(spark, rows), bench).collect()}
    assert all(len(find.findall(lower(cut[i]))) == w[0] - w[1] for i, w in want.items())
    assert decontaminate.report(docs(spark, []), bench).count() == 0
    assert decontaminate.report(docs(spark, rows), bench.limit(0)).filter("contaminated").count() == 0


def test_secrets(spark):
    key = "AKIA" + "A1" * 8
    texts = {
        1: f"é password = 'hunter2hunter2' and {key}", 2: "token:token:abcdefghijklmnop", 3: "deadbeef" * 4 + " ok", 4: None, 5: "", 6: "plain words only, nothing here",
        7: "cfg q9ZxK3vT7mLp2RwY8sBn4Jd6 end", 8: "id 123e4567-e89b-12d3-a456-426614174000", 9: "zzzzzzzzzzzzzzzzzzzzzzzz1", 10: "Secret: " + "x" * 40000 + "=9",
    }
    df = docs(spark, [(i, t, None) for i, t in texts.items()])
    got = {r.doc_id: r for r in secrets.scan(df).select("doc_id", "size", "base", secrets.written(F.col("spans")).alias("spans")).collect()}
    assert got[1].spans == f"assign:2:28,access:34:{34 + len(key)}"
    assert got[2].spans == "" and got[3].spans == "hex:0:32" and got[4].spans == got[5].spans == got[6].spans == ""
    assert got[7].spans == "entropy:4:28" and got[8].spans == "" and got[9].spans == "" and got[10].spans == "assign:0:40010"
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert "hunter2" not in clean[1] and key not in clean[1] and clean[7] == "cfg [secret] end" and clean[4] is None and clean[6] == texts[6]
    assert secrets.scan(docs(spark, [])).count() == 0


def test_secrets_in_very_long_texts(spark):
    rng = random.Random(9)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(24)) for _ in range(3000)]
    run = "".join(rng.choice(secrets.ALPHABET) for _ in range(20_000))
    texts = {1: "a-1-" * 20_000 + "Zq9", 2: " ".join(hexes), 3: run, 4: "z1" * 20_000, 5: "-".join(hexes)}
    got = {r.doc_id: r for r in secrets.scan(docs(spark, [(i, t, None) for i, t in texts.items()])).select("doc_id", F.size("base").alias("base"), secrets.written(F.col("spans")).alias("spans")).collect()}
    assert got[2].base == len(hexes) and got[2].spans.startswith("hex:0:24,hex:25:49") and got[2].spans.endswith(f"hex:{25 * len(hexes) - 25}:{25 * len(hexes) - 1}")
    assert got[1].spans == ""  # its windows are of four characters, the last ones of seven
    assert got[3].spans == f"entropy:0:{len(run)}" and got[4].spans == "" and got[5].base == len(hexes)


def test_entropy_windows(spark):
    rng = random.Random(7)
    values = ["".join(rng.choice(secrets.ALPHABET) for _ in range(rng.randint(20, 50))) for _ in range(30)] + ["ab" * 15]
    got = spark.createDataFrame([(v,) for v in values], "c string").select("c", secrets.best_entropy(F.col("c")).alias("h")).collect()

    def entropy(w):
        return -sum(n / 20 * math.log2(n / 20) for n in Counter(w).values())

    for r in got:
        assert abs(r.h - max(entropy(r.c[k : k + 20]) for k in range(len(r.c) - 19))) < 1e-9


def test_urls(spark):
    rows = [
        (1, "http://A.org/x?q#f", "a.org", "/x", "org/", "allow"), (2, "https://m.example.org/en/12", "m.example.org", "/en/12", "example.org/en/1", "block"), (3, "https://example.org/es/1", "example.org", "/es/1", "example.org/es/", "block"),
        (4, "http://x.com/fr/a", "x.com", "/fr/a", "com/fr/", "allow"), (5, "http://x.com/de/a", "x.com", "/de/a", "com/de/", "block"), (6, "http://notorg/", "notorg", "/", None, None), (7, None, "", "", None, None),
        (8, "no scheme", "", "", None, None), (9, "http://b.org", "b.org", "", None, None), (10, "http://c.net/a://b", "c.net", "/a://b", None, None), (10, "http://c.net/a://b", "c.net", "/a://b", None, None),
    ]
    df = spark.createDataFrame([(i, u, "clash") for i, u, *_ in rows], "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    for i, _, host, path, rule, verdict in rows:
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule) and (r.verdict == verdict if verdict else r.verdict in ("allow", "block"))
    assert urls.judge(df).count() == len(rows) and urls.judge(df.limit(0)).count() == 0


def plain_judgement(rows):
    """Scores of the urls, by counts in plain Python; fitted on three of four of the judged ones, cut by the others."""
    def grams(u):
        t = "\x02" * 4 + re.sub("[^\x21-\x7E]", "~", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in u or "")) + "\x03"
        return [t[k : k + 5] for k in range(len(t) - 4)]

    counts = {"allow": Counter(), "block": Counter()}
    apart = lambda u: int(hashlib.md5((u or "").encode()).hexdigest()[:4], 16) % 4 == 0
    for u, by in rows:
        if by and not apart(u):
            for g in grams(u):
                for k in range(5):
                    counts[by][g[4 - k :]] += 1
                    counts[by][g[4 - k : 4] + "\x00"] += 1  # uses of the context

    def p(side, g):
        out = 1 / 97
        for k in range(5):
            out = (counts[side][g[4 - k :]] + 4 * out) / (counts[side][g[4 - k : 4] + "\x00"] + 4)
        return out

    return {u: sum(round((math.log(p("allow", g)) - math.log(p("block", g))) * 1e6) for g in grams(u)) / len(grams(u)) / 1e6 for u, _ in rows}


def test_url_scores_equal_plain_counts_with_either_join(spark, monkeypatch):
    rng = random.Random(8)
    urls_ = [f"https://{rng.choice('abc')}{rng.randint(1, 30)}.{rng.choice(['org', 'com/de', 'com/fr', 'net'])}/{rng.choice(['news', 'spam', 'É'])}{rng.randint(1, 9)}" for _ in range(300)] + [None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls_)], "page_id long, url string")
    first = {r.url: r for r in urls.judge(df).collect()}
    want = plain_judgement([(u, first[u].verdict if first[u].rule else None) for u in urls_])
    assert all(abs(first[u].score - w) < 2e-6 for u, w in want.items())
    monkeypatch.setattr(urls, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(urls, "HEAVY", 200)
    assert {r.url: r for r in urls.judge(df).collect()} == first
    assert {r.url for r in urls.keep(df).collect()} == {u for u, r in first.items() if r.verdict == "allow"}


def test_findings_beyond_a_broadcast(spark, monkeypatch):
    rng = random.Random(12)
    items = [(k, " ".join(rng.choice("abcdefg") + str(rng.randint(0, 9)) for _ in range(14))) for k in range(20)]
    rows = [(i, "x y " + items[i % 25][1] + " z" if i % 25 < 20 else "clean text", None) for i in range(100)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    plain = lambda: sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.report(docs(spark, rows), bench).collect())
    want = plain()
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 2000)
    assert plain() == want and sum(w[2] > 0 for w in want) == 80
    assert decontaminate.remove_documents(docs(spark, rows), bench).count() == 20


def test_rounding_equals_a_plain_fold(spark):
    """Mass goes from one to the other of two units until one is whole, in the direction drawn; at the root a carried unit keeps the one it drew first."""
    rng = random.Random(13)
    nodes = [(k, [(0, rng.randrange(-(2**62), 2**62), float(rng.randint(1, 50)), rng.uniform(0.01, 0.99)) for _ in range(rng.randint(1, 40))]) for k in range(60)]

    def drawn(*ids, seed):
        h = 42
        for v in ids:
            h = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True) if v else b"\0\0\0\0", seed=h)  # the literal 0 is an int
        return (xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), seed=h) >> 11) / 2**53

    def fold(items, last, seed=7):
        (_, one, w, p), out = items[0], []
        p0 = p
        for _, other, v, q in items[1:]:
            to, fro = min((1 - p) * w, q * v), min(p * w, (1 - q) * v)
            u = drawn(one, 0 if last else other, seed=seed)
            if u < p0 if last else u * (to + fro) < fro:
                if (1 - p) * w <= q * v:
                    out.append((one, 1))
                    x = max(0.0, q - (1 - p) * w / v)
                    one, w, p, p0 = other, v, x, x
                else:
                    out.append((other, 0))
                    p = min(1.0, p + q * v / w)
            elif p * w <= (1 - q) * v:
                out.append((one, 0))
                x = min(1.0, q + p * w / v)
                one, w, p, p0 = other, v, x, x
            else:
                out.append((other, 1))
                p = max(0.0, p - (1 - q) * v / w)
        return one, round(p, 9), out

    df = spark.createDataFrame(nodes, "node int, items array<struct<r:int,id:bigint,w:double,p:double>>")
    for last in (False, True):
        got = {r["node"]: (r["a"]["id"], round(r["a"]["p"], 9), [tuple(x) for x in r["a"]["out"]]) for r in df.select("node", mixing._fold(7, last).alias("a")).collect()}
        assert got == {k: fold(items, last) for k, items in nodes}


CONTRACT = {
    "op1": "page_id url text n_chars", "op2": "doc_id n_shingles component_id kept", "op3": "page_id host path rule verdict", "op4": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op5": "doc_id held_out score predicted", "op6": "doc_id n_words n_hit n_items items_sha256 contaminated", "op7": "doc_id size text_crc32 law shard slot grown_shard", "op8": "doc_id held_out score predicted",
    "op9": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op10": "doc_id size source_size target taken",
    "op11": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256", "op12": "doc_id n_features weight score rank", "op13": "doc_id piece start length ids_crc32 sequence_id offset",
}


def test_queries_have_contract_columns(spark):
    known = {name.split("_")[0]: query for name, query in queries.queries().items()}
    assert known.keys() == CONTRACT.keys()
    for name, columns in CONTRACT.items():
        if name in ("op3", "op4", "op6", "op10"):  # the other queries' columns are read by the tests that hold them against plain versions
            assert set(columns.split()) <= set(known[name](spark, "/root/testdata/sf0.001").columns), name


def test_very_long_texts_pass_whole(spark):
    """Half a million characters, of which the last words decide."""
    filler = "word%d other%d " * 20_000 % tuple(range(40_000))
    window = "one two three four five six seven eight nine ten"
    rows = docs(spark, [(1, filler + window, "s"), (2, filler, "s"), (3, "short text", "t")])
    bench = spark.createDataFrame([(1, window)], "item_id long, text string")
    report = {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.report(rows, bench).collect()}
    assert report == {1: (40_010, 10), 2: (40_000, 0), 3: (2, 0)}
    shards = {r.doc_id: (r["size"], r.text_crc32) for r in sharding.shard(rows).collect()}
    assert shards[1] == (len(filler + window) + 1, zlib.crc32((filler + window).encode()))
    assert {r.doc_id: r["size"] for r in mixing.mixed(rows).collect()} == {1: 40_010, 2: 40_000, 3: 2}
    pages = spark.createDataFrame([(1, "https://a.org/" + "x" * 300_000, ""), (2, "https://b.example.org/es/" + "é" * 200_000, ""), (3, "http://c.net/" + "/z" * 100_000, "")], "page_id long, url string, rule string")
    judged = {r.page_id: (r.rule, r.verdict, len(r.path)) for r in urls.judge(pages).collect()}
    assert judged[1] == ("org/", "allow", 300_001) and judged[2] == ("example.org/es/", "block", 200_004) and judged[3][0] is None and judged[3][2] == 200_001
    assert urls.judge(pages.limit(0)).count() == 0
