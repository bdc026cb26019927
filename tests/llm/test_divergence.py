"""The source audit against plain Python, with odd rows."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from claimlens.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, value int, salt int"


def audited(rows, top=200):
    """The contract on (lang, source, text) rows."""
    rows = [tuple(x or "" for x in r) for r in rows]
    counts, df, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        counts[lang, source].update(terms)
        df[lang].update(set(terms))
        sources[lang].add(source)
    out = []
    for lang, names in sources.items():
        kept = [t for t, n in df[lang].items() if n >= 3]

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in names}, shares(sum((counts[lang, s] for s in names), Counter()))
        f = lambda x, y: (x - y) ** 2 // y
        for s in names:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in names if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item, -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, _, item) in enumerate(found)]
    return sorted(out)


def got(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.audit(df).collect())


def frame(spark, rows):
    return spark.createDataFrame([(k, t, lang, s, 1, "x", 2, 3) for k, (lang, s, t) in enumerate(rows)], SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("abcdéßжz")) for _ in range(int(rng.integers(1, 4)))) for _ in range(300)]
    out = []
    for k in range(120):
        lang, source = ("en", "de", "fr")[k % 3], f"s{int(rng.integers(0, 6)) if k % 4 else 0}"
        out.append((lang, source, " ".join(rng.choice(vocabulary, int(rng.integers(0, 80)))) + " The END_of it's 3x"))
    out += [(None, None, "null group"), (None, None, None), ("en", "empty", None), ("en", "empty", ""), ("en", "", "no source the the"), ("xx", "a", "alone"), ("xx", "b", "one two"),
            ("yy", "only", "the one"), ("de", "s1", "1234 -- !!"), ("en", "s0", "É é Ｅ İ ı K ſ"), ("en", "long", "the end of it " * 30_000), ("en", "long", "x" * 3_000_000)]
    return out + out[:9]


def test_audit_by_plain_python(spark, rows):
    assert got(frame(spark, rows)) == audited(rows)


def test_spills_slots_and_pieces_change_nothing(spark, rows, monkeypatch):
    for name, value in (("SPILL", 50), ("ROWS", 3), ("SLOT", 20), ("CHUNK", 7), ("PIECE", 100), ("TOP", 5)):
        monkeypatch.setattr(divergence, name, value)
    assert got(frame(spark, rows[:125])) == audited(rows[:125], 5)


def test_empty_and_termless_tables(spark, rows):
    assert got(frame(spark, rows).limit(0)) == []
    few = [("en", "a", "one"), ("en", "b", None), ("en", None, "")]
    assert got(frame(spark, few)) == audited(few) and len(audited(few)) == 6


def test_pieces_keep_terms_whole(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 10)
    text = "Ab cdé " * 50 + "x" * 100 + " y" + "é" * 40
    got_words = [w.decode() for part in divergence.words(text.encode()) for w in part]
    assert got_words == re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.replace("Ab", "ab"))


def test_share_is_exact_for_large_counts():
    c = np.array([0, 1, 12_345_678_901_234, 8 * 10**15], np.int64)
    of = np.array([9 * 10**15] * 4, np.int64)
    assert divergence.share(c, of).tolist() == [1 + 10**9 * (int(n) + 1) // (9 * 10**15) for n in c]
