"""URL filters, WARC bundles and neighbour search against brute force."""

import hashlib

import numpy as np
import pytest
import zstandard
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from claimlens.llm import neighbours, url_filter, warc
from claimlens.llm.common import filesystem, scratch

URLS = ["http://a.example.net/en/x", "https://EXAMPLE.net/en/", "http://example.net", "http://net/", "http://xnet/", "no scheme", None, "", "://", "http://",
        "http://a.b.org/fr/z?q=/x#y", "http://a.org?x=/fr/", "ftp://example.com/de/1", "http://example.com:80/de/1", "x://u@example.com/de/",
        "http://example.net/en/deep/page", "http://example.net/en/deep", "http://..net/", "http://a.example.net/en/x"]
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("example.net", "/en/deep/", "block"),
         ("example.net", "/en/deep/", "allow"), ("EXAMPLE.net", "/en/deep/p", "allow"), (None, "/", "block"), ("", "/", "block"), ("a.org", "", "block")]


def judged(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h) + len(p), len(h), h.lower() + p, a) for h, p, a in rules if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(fits, key=lambda f: (f[0], f[1], f[3]), default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("rules", [RULES[:4], RULES, []])
def test_url_verdicts(spark, rules):
    pages = spark.createDataFrame([(k, u, "h", "r", 1) for k, u in enumerate(URLS)] + [(None, URLS[0], "h", "r", 1)],
                                  "page_id long, url string, host string, rule string, salt int")
    got = url_filter.url_verdicts(pages, spark.createDataFrame(rules, url_filter.RULE_SCHEMA)).collect()
    want = [(k, *judged(u, rules)) for k, u in enumerate(URLS)] + [(None, *judged(URLS[0], rules))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_url_hot_domain_and_empty_pages(spark):
    pages = spark.range(3000).selectExpr("id as page_id", "concat('http://h', id % 7, '.example.net/', if(id % 2 = 0, 'en/', 'x/'), id) as url")
    got = url_filter.url_verdicts(pages, spark.createDataFrame(RULES[:4], url_filter.RULE_SCHEMA))
    assert {(r.rule, r.verdict): r["count"] for r in got.groupBy("rule", "verdict").count().collect()} == {("example.net/en/", "allow"): 1500, ("net/", "block"): 1500}
    assert url_filter.url_verdicts(pages.limit(0), spark.createDataFrame(RULES, url_filter.RULE_SCHEMA)).collect() == []


def test_warc_round_trip(spark):
    big, other = "é" * 500, "x" * 1000
    rows = [(1, "http://a/", big), (5, "http://b/", big), (3, None, big), (5, "http://b2/", big), (7, "u\r\nx", "short"), (8, "u", "short"), (9, "u", None),
            (10, "u", ""), (None, "u", big), (None, "u", other), (None, "u2", other), (12, "http://é/", "y" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "p", 1) for r in rows], "page_id long, url string, html string, payload string, size int")
    got = sorted(map(tuple, warc.archived(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    want = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        first = max((p for p, _, h in rows if h == html and p is not None), default=None) if len(payload) >= 1000 else None
        refers = first if first is not None and page_id != first else None
        want.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "response" if refers is None else "revisit", refers))
    assert got == sorted(want, key=str)
    assert warc.archived(pages.limit(0)).collect() == []


def test_warc_frames_are_seekable(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 5000)
    folder = scratch(spark, "warc-test")
    rows = [("00", k, f"http://a/{k}", f"{k}".encode() * 700, hashlib.sha1(b"").hexdigest()) for k in range(40)]
    fs, path = filesystem(folder)
    bundle = warc.Bundle(folder, 3)
    places = [bundle.add(warc.record(f"id-{k}", k, u, p, d, None, "2024-01-01T00:00:00Z")) for _, k, u, p, d in rows]
    bundle.close()
    table = warc.seek_table(folder, bundle.path)
    assert len(table) > 5 and len(table) == places[-1][0] + 1
    raw = open(bundle.path, "rb").read()
    for k in (39, 0, 17):  # any record, from its frame alone
        start, size = table[places[k][0]]
        plain = zstandard.ZstdDecompressor().decompress(raw[start:start + size])
        head, block = warc.parse(plain[places[k][1]:])
        assert head["X-Page-ID"] == str(k) and block.endswith(rows[k][3])
    whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()  # readers that know no seek table skip it
    assert whole.count(b"WARC/1.1\r\n") == 40
    index = spark.createDataFrame([(bundle.path, *places[k], 100_000, f"id-{k}") for k in (3, 30)], warc.INDEX)
    assert {r.page_id for r in warc.read(index, folder).collect()} == {3, 30}


def exact(rows, every, k):
    """Brute force over the usable rows."""
    use = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8}
    out = []
    for q, v in sorted(x for x in use if x[0] % every == 0):
        s = sorted(((-float(np.sum(np.array(v) * np.array(w))), i) for i, w in use if i != q))[:k]
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return out


def test_neighbours_small_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in np.float32(rng.standard_normal(8) * rng.uniform(0.5, 2))]) for i in range(300)]
    rows += [(1000 + i, rows[40][1]) for i in range(60)]  # a hot vector, ties
    rows += [(60, rows[60][1]), (2000, None), (2020, []), (2040, [0.0] * 8), (2060, [1.0] * 7 + [None]), (2080, [float("nan")] * 8), (2100, [float("inf")] + [1.0] * 7),
             (None, [1.0] * 8), (2120, [1.0] * 3)]
    frame = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<float>, cid int, score double")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(frame).orderBy("query_id", "rank").collect()]
    want = exact(rows, 20, 20)
    assert {(q, r) for q, r, _, _ in got} == {(q, r) for q, r, _, _ in want}
    found = {(q, i): s for q, _, i, s in got}
    assert sum((q, i) in found for q, _, i, _ in want) >= 0.9 * len(want)
    scores = {(q, i): s for q, _, i, s in exact(rows, 20, 400)}
    assert all(abs(s - scores[x]) < 1e-12 for x, s in found.items())
    few = frame.where("vec_id in (0, 1, 2, 20)")
    assert [(r.query_id, r["rank"]) for r in neighbours.nearest(few).orderBy("query_id", "rank").collect()] == [(q, r) for q in (0, 20) for r in (1, 2, 3)]
    assert neighbours.nearest(frame.limit(0)).collect() == []


def test_centroid_graph_finds_the_nearest():
    rng = np.random.default_rng(2)
    centroids = neighbours.balanced_centroids(rng.standard_normal((4000, 16)), 60)
    assert 60 <= len(centroids) <= 120
    graph, x = neighbours.Graph(centroids), rng.standard_normal((200, 16))
    at, d = graph.nearest(x, 16)
    want = np.argsort(neighbours._distances(x, centroids), axis=1)[:, :4]
    assert np.mean([len(set(a) & set(w)) / 4 for a, w in zip(at, want)]) > 0.95
    assert (np.diff(np.where(np.isinf(d), 1e9, d), axis=1) >= 0).all()


@pytest.mark.parametrize("kind", ["clustered", "loose"])
def test_recall_with_many_lists(spark, monkeypatch, kind):
    monkeypatch.setattr(neighbours, "LIST_SIZE", 8)
    monkeypatch.setattr(neighbours, "LEAST_SAMPLE", 64)  # the sample follows the number of lists
    rng = np.random.default_rng(4)
    n, d = 6000, 24
    x = rng.standard_normal((n, d)) if kind == "loose" else rng.standard_normal((60, d))[rng.integers(0, 60, n)] + 0.25 * rng.standard_normal((n, d))
    x = np.float32(x)
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(6)
    built = []
    make = neighbours.Graph
    monkeypatch.setattr(neighbours, "Graph", lambda c: built.append(make(c)) or built[-1])
    got = {}
    for r in neighbours.nearest(frame).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert len(built[0].c) >= 512
    score = np.float64(x[::20]) @ np.float64(x).T
    score[np.arange(len(score)), np.arange(0, n, 20)] = -np.inf
    want = np.argsort(-score, axis=1, kind="stable")[:, :20]
    assert all(len(got[20 * i]) == 20 for i in range(len(want)))
    assert np.mean([len(got[20 * i] & set(w.tolist())) / 20 for i, w in enumerate(want)]) >= 0.9


def test_rows_scored_grow_with_the_queries(spark, monkeypatch):
    """Loose vectors, whose queries read a fixed share of the table: rows that leave the scoring tasks grow as the table does, not as its square."""
    monkeypatch.setattr(neighbours, "LIST_SIZE", 8)
    monkeypatch.setattr(neighbours, "LEAST_SAMPLE", 64)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 32)
    scored = []
    for owner, name in ((type(spark.range(1)), "mapInPandas"), (PandasCogroupedOps, "applyInPandas")):
        def watched(*args, make=getattr(owner, name), **kwargs):
            out = make(*args, **kwargs)
            if out.columns == ["qid", "cid", "first_id", "score"]:
                scored.append(out)
            return out
        monkeypatch.setattr(owner, name, watched)
    x = np.float32(np.random.default_rng(6).standard_normal((4800, 16)))
    for n in (1200, 4800):
        neighbours.nearest(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x[:n])], "vec_id long, embedding array<float>"))
    few, many = (df.count() for df in scored)
    assert few >= 60 * 21 and many >= 240 * 21
    assert many <= 5 * few


def test_best_of_batches_equals_all_pairs():
    rng = np.random.default_rng(7)
    x, y = rng.integers(-3, 4, (900, 4)).astype(float), rng.integers(-3, 4, (40, 4)).astype(float)  # many ties
    lists = [np.unique(rng.integers(0, 30, rng.integers(1, 4))) for _ in x]
    reads = [np.unique(rng.integers(0, 40, rng.integers(1, 12))) for _ in y]
    first = rng.permutation(900)
    for size in (1, 7, 300, 900):
        pool = neighbours.Best(np.arange(100, 140), y, reads, 6)
        for lo in range(0, 900, size):
            pool.add(np.arange(lo, min(lo + size, 900)), first[lo:lo + size], x[lo:lo + size], lists[lo:lo + size])
        got = sorted(pool.rows().itertuples(index=False, name=None))
        want = []
        for q in range(40):
            near = sorted((-float(x[i] @ y[q]), int(first[i]), i) for i in range(900) if set(lists[i]) & set(reads[q]))[:6]
            want += [(100 + q, i, f, -s) for s, f, i in near]
        assert got == sorted(want)


def test_query_blocks():
    held = np.array([0, 3, 3, 0, 25, 10, 1, 0, 4])
    first, parts = neighbours.query_blocks(held, 10)
    blocks = {}
    for c, n in enumerate(held):
        for b in range(first[c], first[c] + parts[c]):
            blocks[b] = blocks.get(b, 0) + n / parts[c]
    assert sorted(blocks) == list(range(len(blocks))) and max(blocks.values()) <= 10 and len(blocks) == 6
    assert neighbours.query_blocks(np.zeros(3, int), 10)[0].tolist() == [0, 0, 0]


def test_range_search_reads_all_lists_in_reach():
    rng = np.random.default_rng(5)
    centroids = neighbours.list_centroids(rng.standard_normal((12_000, 12)), 600)
    assert 560 <= len(centroids) <= 1300
    graph, x = neighbours.Graph(centroids), rng.standard_normal((150, 12))
    d = np.sqrt(neighbours._distances(x, centroids))
    for ratio in (0.0, 0.2, 0.6):
        found = graph.within(x, ratio)
        want = [set(np.flatnonzero(r <= r.min() * (1 + ratio)).tolist()) for r in d]
        assert sum(len(w & set(f.tolist())) for w, f in zip(want, found)) >= 0.97 * sum(map(len, want))
