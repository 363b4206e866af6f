"""Block-Max MaxScore, periodic runs and host reputation against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from patronage.llm import hosts, maxscore, repetitions
from patronage.llm.queries import URL_RULES

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_search(docs, items, k=20):
    bags = [(i, TERM.findall(lower(t))) for i, t in docs]
    n_docs, words = sum(1 for _, b in bags if b), sum(len(b) for _, b in bags)
    df = Counter(t for _, b in bags for t in set(b))
    out = []
    for item, text in items:
        found = []
        for i, b in bags:
            tf, m = Counter(b), 75 + (25 * len(b) * n_docs) // max(1, words)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * (1000000000 * tf[t] // (1000 * tf[t] + 12 * m)) for t in TERM.findall(lower(text)) if t in tf)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_docs", [7, 8192])
def test_search_equals_brute_force(spark, odd_docs, small_docs, shard_docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = [tuple(r) for r in items.select("item_id", "text").collect()]
    rows += [(1000, None), (1001, ""), (1002, "same SAME line, of text"), (None, "card here Éa \U0001f600"), (1002, "the")]
    asked = spark.createDataFrame([(*r, 1) for r in rows], "item_id long, text string, score int")
    for docs in (odd_docs, small_docs):
        want = plain_search([tuple(r) for r in docs.select("doc_id", "text").collect()], rows)
        for chars in (4_000_000, 500):
            got = maxscore.search(docs, asked, shard_docs=shard_docs, query_chars=chars)
            assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
            assert sorted(map(tuple, got.collect()), key=str) == want


def test_search_of_nothing(spark, no_docs, small_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert maxscore.search(no_docs, some).count() == 0 and maxscore.search(small_docs, none).count() == 0


def test_block_maxima_skip_blocks_and_lose_nothing(spark):
    rng = random.Random(3)
    vocabulary = [f"t{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choices(vocabulary, [1 / (x + 1) for x in range(400)], k=rng.randint(1, 300)))) for i in range(4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(1)
    index = maxscore.build_index(df).toArrow().combine_chunks().to_batches()
    total = sum(r for b in index for r in b.column("words").to_pylist())
    shard = maxscore.Shard(index[0], 0, 4000, total)
    before = len(shard.first)
    for q in range(30):
        terms = {t.encode(): 100 + i for i, t in enumerate(rng.sample(vocabulary, 20))}
        d, s = shard.top(terms, 20)
        every = shard.top(terms, 4000)
        best = sorted(zip((-every[1]).tolist(), every[0].tolist()))
        assert sorted((-s).tolist())[:20] == [x for x, _ in best[:20]]
        assert {x for x in best if x[0] <= best[19][0]} == set(zip((-s).tolist(), d.tolist()))
    assert shard.skipped > 0 and before > 400


@pytest.mark.parametrize("numbers", [[5], [200, 3], [70000, 1, 300]])
def test_packed_blocks_come_back(numbers):
    lens = np.sort(np.array([sum(numbers)] * 300 + [1] * 70000))
    doc = np.repeat(np.arange(len(lens) - 300, len(lens)), sum(numbers))
    term = np.tile(np.repeat(np.arange(len(numbers)), numbers), 300)
    got = maxscore.pack(lens, doc, term, len(numbers))
    assert got["df"].tolist() == [300] * len(numbers)
    assert got["last"].max() == len(lens) - 1 and got["most"].max() == max(numbers)


def plain_runs(w, least=6, times=4):
    out, n = [], len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q) and not any(
                    q % p == 0 and all(w[x] == w[x + p] for x in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, j + q - i, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_report(i, text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(w), zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = plain_runs(w)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_runs_equal_brute_force(spark, no_docs, small_docs):
    rng = random.Random(8)
    rows = [(i, " ".join("abc"[rng.randint(0, 2)] for _ in range(rng.choice([0, 3, 6, 40])))) for i in range(300)]
    rows += [(300, None), (301, "x " * 500), (302, "a b c\td\n" * 30), (None, "x " * 9), (None, None), (301, "x " * 500)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_runs int, runs string")
    for docs in (df, small_docs):
        want = [plain_report(*r) for r in docs.select("doc_id", "text").collect() if len((r[1] or "").split()) < 600]
        got = {tuple(r) for r in repetitions.run_report(docs).collect()}
        assert set(want) <= got and len(got) >= len(set(want))
    assert sorted(map(tuple, repetitions.run_report(df).collect()), key=str) == sorted((plain_report(*r) for r in rows), key=str)
    assert repetitions.run_report(no_docs).count() == 0


@pytest.mark.parametrize("slice_words", [200, 10**6])
def test_runs_of_many_small_alphabets(slice_words):
    rng = random.Random(5)
    docs = []
    for _ in range(600):
        w = [rng.choice("ab") for _ in range(rng.choice([0, 1, 5, 7, 30, 90]))]
        for _ in range(rng.randint(0, 3)):
            x = [rng.choice("ab") for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17]))]
            x = (x[:max(1, len(x) // 3)] * 4)[:len(x)] if rng.random() < .4 else x
            at = rng.randint(0, len(w))
            w[at:at] = (x * 8)[: rng.randint(2, 6) * len(x) + rng.randint(0, len(x))]
        docs.append(w)
    got = [list(map(tuple, r.tolist())) for r in repetitions.find_runs([[c.encode() for c in d] for d in docs], slice_words=slice_words)]
    assert got == [plain_runs(d) for d in docs]


def test_wavelet_matrix_counts_and_ranks():
    rng = np.random.default_rng(2)
    v = rng.permutation(500)
    tree = repetitions.WaveletMatrix(v, 9)
    lo = rng.integers(0, 500, 400)
    hi = np.array([rng.integers(a, 501) for a in lo])
    x = rng.integers(0, 600, 400)
    assert tree.below(lo, hi, x).tolist() == [int((v[a:b] < y).sum()) for a, b, y in zip(lo, hi, x)]
    some = hi > lo
    assert tree.nth(lo[some], hi[some], (hi - lo)[some] // 2).tolist() == [
        int(np.sort(v[a:b])[(b - a) // 2]) for a, b in zip(lo[some], hi[some])]


def test_long_periodic_text_takes_seconds(spark):
    import time
    t = time.time()
    got = list(repetitions.find_runs([[b"x"] * 200000, [b"w%d" % (i % 4000) for i in range(80000)]]))
    assert [g.tolist() for g in got] == [[[0, 200000, 1]], [[0, 80000, 4000]]] and time.time() - t < 60


def plain_verdict(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = lower(re.match("[^/?#]*", rest).group())
        path = re.match("[^?#]*", rest[len(host):]).group()
    fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_hosts_paths_and_rules(spark):
    urls = [None, "", "no scheme", "://", "http://", "HTTP://A.Example.NET/en/x?q#f", "http://example.net/EN/", "http://net", "http://net/",
            "http://xnet/", "http://x.example.com/de", "http://x.example.com/de/1", "https://u@b.org:80/fr/9", "https://b.org/fr/a/b.html#x",
            "ftp://a.b.c.example.com/de/?x", "x://y://z.net/", "http://b.org?fr/", "http://É.org/fr/1", "http://b.org/a\n/fr/", "http://b.org/fr/\nx"]
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls * 2)] + [(None, "http://b.org/fr/", "y", 2)],
                               "page_id long, url string, host string, n int")
    none = spark.createDataFrame([], "host string, n long, bad long")
    got = hosts.judge(df, none, hosts.rule_table(spark, URL_RULES), spread=2).collect()
    assert len(got) == 2 * len(urls) + 1
    for r in got:
        want = plain_verdict("http://b.org/fr/" if r["page_id"] is None else (urls * 2)[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == want[:3]
        assert r["verdict"] == (want[3] or "allow")
    no_pages = spark.createDataFrame([], "page_id long, url string")
    assert hosts.judge(no_pages, none, hosts.rule_table(spark, URL_RULES)).count() == 0


def test_reputation_shrinks_and_blocks(spark):
    rows = [(f"h{i}.good.org", 200, 4) for i in range(20)] + [(f"h{i}.bad.com", 200, 190) for i in range(20)]
    rows += [("new.bad.com", 0, 0), ("new.good.org", 0, 0), ("one.good.org", 1, 1), ("h.bad.com:8080", 2, 0), ("", 0, 0),
             ("10.0.0.1", 5, 5), ("a.b.co.uk", 3, 0), ("localhost", 1, 0)]
    got = {r["host"]: r for r in hosts.reputation(spark.createDataFrame(rows, "host string, n long, bad long")).collect()}
    assert got["new.bad.com"]["blocked"] and not got["new.good.org"]["blocked"]
    assert not got["one.good.org"]["blocked"]
    # one bad host of a good domain is blocked for itself, and its domain's prior grows wide
    wide = {r["host"]: r for r in hosts.reputation(spark.createDataFrame(rows + [("worst.good.org", 500, 499)],
                                                                         "host string, n long, bad long")).collect()}
    assert wide["worst.good.org"]["blocked"] and not wide["new.good.org"]["blocked"]
    assert wide["new.bad.com"]["bound"] < got["new.bad.com"]["bound"]
    assert got["one.good.org"]["rate"] < 0.5 < got["h.bad.com:8080"]["rate"]
    assert got["a.b.co.uk"]["domain"] == "b.co.uk" and got["10.0.0.1"]["suffix"] == "" and got["h.bad.com:8080"]["domain"] == "bad.com"
    assert all(0 <= r["bound"] <= r["rate"] + 1e-6 for r in got.values())
    # the same sums in plain Python
    pages = hosts.with_host(spark.createDataFrame([("http://a.com/x/7",), ("http://a.com/x/7/",), ("http://a.com/x/8.html?x",),
                                                   ("http://b.com/x/y7",), ("http://b.com/7",), (None,)], "url string"))
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, None), (8, 1, 0), (9, 0, 1), (None, 0, 1), (8, None, None)],
                                   "doc_id long, quality int, toxic int")
    assert [tuple(r) for r in hosts.numbered_outcomes(pages, labels).collect()] == [("a.com", 3, 2)]


def test_reputation_without_labels_blocks_nothing(spark):
    got = hosts.reputation(spark.createDataFrame([("a.com", 0, 0), ("b.org", 0, 0)], "host string, n long, bad long")).collect()
    assert not any(r["blocked"] for r in got)
