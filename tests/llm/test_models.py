"""Classifiers: held-out accuracy, parts against plain versions, odd cases; the pipeline against brute force."""

import zlib

import numpy as np

import corpus_pipeline
from claimlens.llm import minhash, pii, quality, toxicity
from claimlens.llm.common import table

SF = "/root/testdata/sf0.01"


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def scored(spark, out, label):
    labels = {r.doc_id: r[label] for r in table(spark, SF, "labels").collect()}
    rows = [r for r in out.collect()]
    assert all(0 <= r.score <= 1 for r in rows) and all(r.held_out == held(r.doc_id) for r in rows)
    test = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    return sum(p == y for p, y in test) / len(test), rows


def test_quality_held_out(spark):
    right, rows = scored(spark, quality.quality(table(spark, SF, "documents"), table(spark, SF, "labels")), "quality")
    assert right > 0.95 and all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_toxicity_held_out(spark):
    right, rows = scored(spark, toxicity.toxicity(table(spark, SF, "documents"), table(spark, SF, "labels")), "toxic")
    assert right > 0.9 and all(r.predicted == int(r.score >= 0.5) for r in rows)


def test_odd_rows(spark, docs, rows, no_docs):
    labels = spark.createDataFrame([(1000, 1, 0, "x"), (1000, 0, 1, "x"), (None, 1, 1, "x"), (1001, None, None, "x"), (1003, 7, 7, "x")],
                                   "doc_id long, quality int, toxic int, text string")
    for operator in (quality.quality, toxicity.toxicity):
        got = operator(docs, labels).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        assert len(operator(docs, labels.limit(0)).collect()) == len(rows)
        assert operator(no_docs, labels).collect() == []
    toxic = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels.limit(0)).collect()}
    assert toxic[1311] == 1 and toxic[1312] == 0 and toxic[1301] == 0


def test_flattened_trees_equal_a_walk():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] * x[:, 1] > 0)).astype(float)
    trees = quality.fit_trees(x, y, trees=30)
    p = trees(x)
    assert ((p > 0.5) == y).mean() > 0.9
    for i in range(0, 600, 50):
        total = trees.base
        for at in trees.roots:
            while trees.left[at] != at:
                at = trees.left[at] if x[i, trees.feature[at]] <= trees.threshold[at] else trees.right[at]
            total += trees.value[at]
        assert abs(1 / (1 + np.exp(-total)) - p[i]) < 1e-12


def test_best_split_equals_all_cuts():
    rng = np.random.default_rng(1)
    bins, g, h = rng.integers(0, quality.BINS, (80, 3)), rng.standard_normal(80), rng.uniform(0.1, 1, 80)
    best = max(((g[m].sum() ** 2 / (h[m].sum() + 1) + g[~m].sum() ** 2 / (h[~m].sum() + 1) - g.sum() ** 2 / (h.sum() + 1), f, b)
                for f in range(3) for b in range(quality.BINS) if 8 <= (m := bins[:, f] <= b).sum() <= 72), key=lambda t: t[0])
    got = quality.best_split(bins, g, h, 8)
    assert abs(got[0] - best[0]) < 1e-9


def test_grammar():
    weigh = lambda t: toxicity.figures(t, toxicity.SEED_LEXICON)[1]
    assert weigh("an idiot") == 1 and weigh("you are an idiot") == 1.5
    assert abs(weigh("not an idiot") - 0.3) < 1e-9 and abs(weigh("he said an idiot") - 0.6) < 1e-9  # a target stands there too
    assert weigh("never. an idiot") == 1 and abs(weigh("she wrote: an idiot") - 1) < 1e-9
    assert weigh("i will kill you") == 1.5 and weigh("i will kill time") == 0 and weigh("they kill") == 1.5
    assert weigh(None) == weigh("") == weigh("all is well") == 0


def test_pipeline_stages(spark, tmp_path):
    """Each stage by itself against plain versions on the small tables, with odd rows among the documents."""
    docs = table(spark, SF, "documents").limit(150)
    extra = spark.createDataFrame([(90001, None, "en", "s", None), (None, "no id", "en", "s", 5), (None, "no id", "en", "s", 5), (90002, "", None, None, 0),
                                   (90003, "mail a@b.cd", "en", "s", 11), (90003, "mail a@b.cd", "en", "s", 11)], docs.schema)
    docs = docs.unionByName(extra)
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, SF)
    assert clean.columns == docs.columns and {90001, 90002, 90003} <= {r.doc_id for r in clean.collect()}
    once = stages["near_duplicates"](spark, clean, SF)
    assert once.columns == docs.columns
    kept = {r.doc_id for r in minhash.near_duplicates(clean).collect() if r.kept}
    ids = [r.doc_id for r in once.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(kept) and ids.count(None) == 1
    left = stages["decontamination"](spark, once, SF)
    assert left.columns == docs.columns and {90001, 90002, 90003, None} <= {r.doc_id for r in left.collect()}
    private = stages["personal_data"](spark, left, SF)
    assert private.columns == docs.columns
    texts = {r.doc_id: r.text for r in private.collect()}
    assert texts[90003] == "mail [EMAIL]" and texts[90001] is None and not any(pii.detect(t or "") for t in texts.values())
    packed = stages["packing"](spark, private, SF)
    assert {r.doc_id for r in packed.collect()} == set(texts)


def test_pipeline_on_empty_documents(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, SF, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_judges_each_row_by_its_own_text(spark, tmp_path):
    """Ids that repeat with different texts, and rows without an id, in the stages that drop rows by operators' verdicts."""
    rng = np.random.default_rng(4)
    text = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(80))
    a, b, c, d, e, leaked = (text() for _ in range(6))
    near = lambda t: t + " more"
    rows = [(3, a), (5, near(a)), (5, b), (7, c), (7, d), (7, d), (None, e), (None, near(e)), (None, near(b)), (9, None), (9, ""), (9, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    stages = dict(corpus_pipeline.STAGES)
    got = [(r.doc_id, r.text) for r in stages["near_duplicates"](spark, docs, SF).collect()]
    of_e = [r for r in got if r[1] in (e, near(e))]
    assert len(of_e) == 1  # of near copies without ids one stays
    want = [(3, a), (5, b), (7, c), (7, d), (9, None), (9, ""), (None, None), *of_e]
    assert sorted(got, key=str) == sorted(want, key=str)
    bench = spark.createDataFrame([("q1", leaked)], "item_id string, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, leaked), (1, b), (None, near(leaked)), (None, c), (2, None), (2, leaked)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], docs.schema)
    got = [(r.doc_id, r.text) for r in stages["decontamination"](spark, docs, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([(1, b), (None, c), (2, None)], key=str)
