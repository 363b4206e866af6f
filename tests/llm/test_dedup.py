"""SimHash, lattice and line dedup against brute force."""

import random

import numpy as np
import pytest
import xxhash

from patronage.llm import lattice, lines, simhash


def groups(n, links):
    low = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def plain_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [w[i:i + 4] for i in range(len(w) - 3)] or ([w] if w else [])
    h = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_simhash(rows):
    fp = [plain_fingerprint(t) for _, t in rows]
    low = groups(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if bin(fp[a] ^ fp[b]).count("1") <= 4])
    name = {}
    for (i, _), g in zip(rows, low):
        if i is not None:
            name[g] = min(i, name.get(g, i))
    return sorted([(i, f"{f:016x}", name.get(g)) for (i, _), f, g in zip(rows, fp, low)], key=str)


def test_simhash_equals_brute_force(spark, odd_docs, no_docs, small_docs):
    for docs in (odd_docs, small_docs):
        want = plain_simhash([tuple(r) for r in docs.select("doc_id", "text").collect()])
        got = simhash.near_duplicates(docs)
        assert got.columns == ["doc_id", "fingerprint", "component_id"]
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert simhash.near_duplicates(no_docs).count() == 0


def test_simhash_links_are_lossless_in_split_buckets(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 7))) for b in base for _ in range(25)})
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    links = [(a, b) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 4]
    want = groups(len(fps), links)
    classes = spark.createDataFrame([(s,) for s in signed], "fp long")
    edges = simhash.links(classes, block=4).collect()
    at = {s: k for k, s in enumerate(signed)}
    got = groups(len(fps), [(at[r["a"]], at[r["b"]]) for r in edges])
    assert got == want
    assert len(edges) < len(links) * 15


def test_simhash_keep_one(odd_docs, small_docs):
    for docs in (odd_docs, small_docs):
        rows = plain_simhash([tuple(r) for r in docs.select("doc_id", "text").collect()])
        kept = simhash.keep_one(docs)
        assert kept.columns == docs.columns
        got = [r["doc_id"] for r in kept.collect()]
        named = {c for _, _, c in rows if c is not None}
        assert sorted(x for x in got if x is not None) == sorted(named)


def plain_links(rows, least=0.93):
    out = {}
    ok = lambda v, l: l is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    good = [k for k, (i, v, l) in enumerate(rows) if i is not None and ok(v, l)]
    links = []
    for x, a in enumerate(good):
        for b in good[:x]:
            va, vb = np.array(rows[a][1], float), np.array(rows[b][1], float)
            if rows[a][2] == rows[b][2] and len(va) == len(vb) and va @ vb / np.sqrt((va @ va) * (vb @ vb)) >= least:
                links.append((a, b))
    low = groups(len(rows), links)
    for k, (i, _, _) in enumerate(rows):
        n = sum(k in e for e in links)
        comp = min((rows[m][0] for m in range(len(rows)) if low[m] == low[k] and rows[m][0] is not None), default=None) \
            if n else i
        out[k] = (i, n, comp, i == comp)
    return sorted(out.values(), key=str)


def test_lattice_equals_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    got = sorted(map(tuple, lattice.near_duplicates(df).collect()), key=str)
    assert got == plain_links(rows)


def test_lattice_odd_rows_and_hot_group(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=16)
    rows = [(k, (centre + 0.08 * rng.normal(size=16)).tolist(), 1) for k in range(150)]
    rows += [(200 + k, rng.normal(size=16).tolist(), k % 3) for k in range(60)]
    rows += [(300, rows[0][1], 1), (301, rows[0][1], 2), (302, None, 1), (303, [0.0] * 16, 1), (304, [float("nan")] * 16, 1),
             (305, [None] + [1.0] * 15, 1), (306, rows[0][1], None), (None, rows[0][1], 1), (307, [], 1),
             (308, [1.0, 2.0], 1), (309, [2.0, 4.0], 1), (310, [x * 3 for x in rows[0][1]], 1), (0, rows[0][1], 1),
             (311, [float("inf")] + [1.0] * 15, 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows],
                               "vec_id long, embedding array<double>, label int, rep string, n_links int")
    got = sorted(map(tuple, lattice.near_duplicates(df, block=16, tables=10, probes=16).collect()), key=str)
    assert got == plain_links(rows)
    none = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert lattice.near_duplicates(none).count() == 0


def test_e8_decoder_finds_the_nearest_point():
    x = np.random.default_rng(1).normal(size=(300, 8)) * 2
    home = lattice.decode_e8(x)
    assert len(lattice.NEIGHBOURS) == 240
    own = ((x - home) ** 2).sum(1)
    other = ((x[:, None] - home[:, None] - lattice.NEIGHBOURS) ** 2).sum(2).min(1)
    assert (own <= other + 1e-9).all()
    twice = np.rint(2 * home)
    assert (np.ptp(twice % 2, axis=1) == 0).all() and (home.sum(1) % 2 == 0).all()


def plain_runs(rows, least):
    """Lines of runs of ``least`` words or more that stand earlier."""
    docs = sorted({(i is None, i or 0, t or "") for i, t in rows})
    seqs = [[" ".join(x.split()) for x in t.split("\n") if x.split()] for _, _, t in docs]
    gone = [set() for _ in docs]
    for d, s in enumerate(seqs):
        for e in range(d + 1):
            r = seqs[e]
            for p in range(len(s)):
                for q in range(len(r)):
                    if e == d and q >= p:
                        continue
                    k, words = 0, 0
                    while p + k < len(s) and q + k < len(r) and s[p + k] == r[q + k]:
                        words += len(s[p + k].split())
                        k += 1
                    if words >= least:
                        gone[d].update(range(p, p + k))
    return {(None if n else i, t): g for (n, i, t), g in zip(docs, gone)}


def corpus(seed, n=40):
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choice("abcdefg") + rng.choice("xyz") for _ in range(rng.choice([1, 2, 3, 5, 9, 25])))
    shared = [[line() for _ in range(rng.randint(1, 9))] for _ in range(6)]
    docs = []
    for i in range(n):
        body = [line() for _ in range(rng.randint(0, 6))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) - 1)
            at = rng.randint(0, len(body))
            body[at:at] = s[a: a + rng.randint(1, 9)]
        if rng.random() < 0.2:
            body.insert(0, "")
        docs.append((i, "\n".join(body)))
    return docs + [(50, None), (51, ""), (None, docs[3][1]), (2, docs[2][1])]


@pytest.mark.parametrize("seed", range(3))
def test_lines_finds_every_repeated_run(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, runs string")
    want = plain_runs(rows, lines.MIN_WORDS)
    cut = {}
    got = lines.repeated_runs(df)
    keys = {(r["_k1"], r["_k2"]): (r["doc_id"], r["text"]) for r in df.select(
        "doc_id", "text", *lines.row_keys(df["doc_id"], df["text"])).collect()}
    for r in got.collect():
        i, t = keys[(r["_k1"], r["_k2"])]
        cut[(i, t or "")] = {k for x in r["runs"] for k in range(x["a"], x["z"] + 1)}
    # everything guaranteed is cut, and nothing is cut that does not stand earlier in a run with a fingerprint
    sure, may = want, plain_runs(rows, lines.GRAM_WORDS)
    for key in want:
        assert sure[key] <= cut.get(key, set()) <= may[key], key


def test_lines_output(spark, odd_docs, no_docs):
    out = lines.dedup_lines(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    by = {}
    for r in out.collect():
        by.setdefault(r["doc_id"], []).append(r["text"])
    assert by[2] == [None] and by[3] == [""]
    assert by[7][0].count("same line") < 40 and "same line" in by[7][0]
    assert lines.dedup_lines(no_docs).count() == 0
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen " * 4
    df = spark.createDataFrame([(1, f"alpha beta\n{long}\ngamma"), (2, f"other\n{long}\nend"), (3, long)],
                               "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(df, drop_emptied=True).collect()} == {
        1: f"alpha beta\n{long}\ngamma", 2: "other\nend"}


def test_lines_report_covers_small_table(spark, small_docs):
    rows = [tuple(r) for r in small_docs.select("doc_id", "text").collect()]
    want = plain_runs(rows, lines.MIN_WORDS)
    got = {r["doc_id"]: r for r in lines.dedup_report(small_docs).collect()}
    assert len(got) == len(rows)
    for (i, _), g in want.items():
        assert got[i]["n_removed"] >= len(g)


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_lines_cuts_every_later_line(spark, table):
    docs = spark.read.parquet(f"/root/testdata/{table}/documents.parquet")
    seen, want = set(), {}
    for r in docs.orderBy("doc_id").collect():
        out = want.setdefault(r["doc_id"], [])
        for i, line in enumerate(r["text"].split("\n")):
            if line.split():
                key = " ".join(line.split())
                out += [i] if key in seen else []
                seen.add(key)
    got = {r["doc_id"]: r["removed"] for r in lines.dedup_report(docs).collect()}
    assert got == {d: ",".join(map(str, gone)) for d, gone in want.items()}


def test_lines_of_few_words(spark):
    df = spark.createDataFrame([(1, "Menu\nown words"), (2, "Menu"), (3, "  Menu \n\nAll rights reserved.\nx"),
                                (4, "All rights  reserved.\nMenu\ny\nMenu")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(df).collect()} == {
        1: "Menu\nown words", 2: "", 3: "\nAll rights reserved.\nx", 4: "y"}


@pytest.mark.parametrize("seed", range(2))
def test_lines_wider_windows(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sure, may = plain_runs(rows, 20), plain_runs(rows, 10)
    keys = {(r["_k1"], r["_k2"]): (r["doc_id"], r["text"] or "") for r in df.select(
        "doc_id", "text", *lines.row_keys(df["doc_id"], df["text"])).collect()}
    cut = {keys[(r["_k1"], r["_k2"])]: {k for x in r["runs"] for k in range(x["a"], x["z"] + 1)}
           for r in lines.repeated_runs(df, gram=10, least=20).collect()}
    for key in sure:
        assert sure[key] <= cut.get(key, set()) <= may[key], key


@pytest.mark.parametrize("levels", [((1, 4), (1, 1)), ((1, 150), (1, 30), (1, 1)), ((1, 1),)])
def test_lines_levels_agree(spark, small_docs, levels):
    rows = corpus(7) + [(100 + i, "\n".join(["boiler plate of the site"] * (i % 3) + [f"own {i}"] + ["tail"])) for i in range(60)]
    for docs in (spark.createDataFrame(rows, "doc_id long, text string"), small_docs):
        runs = {(r["_k1"], r["_k2"]): {k for x in r["runs"] for k in range(x["a"], x["z"] + 1)}
                for r in lines.repeated_runs(docs, levels=levels).collect()}
        want = plain_runs([tuple(r) for r in docs.select("doc_id", "text").collect()], 1)
        got = {(r["doc_id"], r["text"] or ""): runs.get((r["_k1"], r["_k2"]), set()) for r in docs.select(
            "doc_id", "text", *lines.row_keys(docs["doc_id"], docs["text"])).collect()}
        assert got == want


def test_first_level_takes_passages_from_few_fingerprints(spark):
    rng = random.Random(1)
    line = lambda: " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 999)) for _ in range(12))
    shared = [line() for _ in range(40)]
    rows = [(i, "\n".join([line() for _ in range(10)] + shared + [line() for _ in range(10)])) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = lines.repeated_runs(df, levels=((1, 60),)).collect()
    # runs of the whole passage, in all documents but the first
    assert len(found) == 29
    for r in found:
        assert {k for x in r["runs"] for k in range(x["a"], x["z"] + 1)} == set(range(10, 50))
    h, w = lines.line_hashes(rows[0][1])
    assert len(lines.fingerprints(h, w, 1, 60)) < len(w) * 0.6
    assert set(lines.fingerprints(h, w, 1, 60, [(0, 49)])) <= set(range(50, 60))


def test_lattice_rows_that_share_an_id(spark):
    rng = np.random.default_rng(9)
    a, c = rng.normal(size=16), rng.normal(size=16)
    near = lambda v: (v + 0.01 * rng.normal(size=16)).tolist()
    rows = [(1, a.tolist(), 1), (1, c.tolist(), 1), (2, near(a), 1), (3, near(c), 1), (5, near(a), 1), (5, near(a), 1), (0, near(c), 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, lattice.near_duplicates(df).collect()))
    # rows of id 1 link with 2, 5, 5 and with 3; equal ids do not make vectors equal
    assert got == [(0, 0, 0, True), (1, 1, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 1, 1, False),
                   (5, 3, 1, False), (5, 3, 1, False)]


def test_exploded_buckets_are_never_broadcast(spark):
    """A small table exploded to many rows looks small to Spark: it stays off the driver."""
    from pyspark.sql import functions as F

    from patronage.llm.common import split_buckets
    rows = spark.range(1000).select(F.col("id").alias("fp"), F.explode(F.expr("sequence(0, 14)")).alias("bucket"))
    sigs = spark.range(1000).select(F.col("id").alias("fp"), (F.col("id") + 1).alias("sig"))
    got = split_buckets(rows, "bucket", "fp", 512, payload=sigs)
    assert got.select("fp", "sig").distinct().count() == 1000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") >= 2
