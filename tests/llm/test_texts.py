"""Operators on texts against brute force over a small table with odd cases."""

import collections
import hashlib
import math
import re
import sys
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from claimlens.llm import attention, decontaminate, minhash, packing, pii

LOW = {c: c + 32 for c in range(65, 91)}


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k:k + 5]) for k in range(len(words) - 4))


def components(rows):
    """(set size, smallest id reachable) of each row, by comparing every pair of distinct sets."""
    sets = [shingle_set(t) for _, t in rows]
    distinct = sorted(set(sets) - {frozenset()}, key=sorted)
    parent = list(range(len(distinct)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for j in range(i):
            both = len(a & distinct[j])
            if 100 * both >= 75 * (len(a) + len(distinct[j]) - both):
                parent[find(i)] = find(j)
    place = {s: k for k, s in enumerate(distinct)}
    least = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            root = find(place[s])
            least[root] = min(least.get(root, i), i)
    return [(len(s), least.get(find(place[s])) if s else i) for (i, _), s in zip(rows, sets)]


def test_minhash_groups(docs, rows):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()), key=str)
    want = sorted(((i, n, c, i is not None and i == c) for (i, _), (n, c) in zip(rows, components(rows))), key=str)
    assert got == want
    assert any(c == 1200 for i, _, c, _ in got if i == 1211)  # the chain is one group


def test_minhash_empty(no_docs):
    assert minhash.near_duplicates(no_docs).collect() == []


def test_minhash_group_links_match_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 60, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(140, 200), replace=False), rng.integers(0, 1 << 60, 5, dtype=np.uint64)])) for _ in range(40)]
    sigs = minhash.minima(sets, *minhash.universal())
    group = [(k, k, k % 2, len(s), sigs[k].tobytes(), s.tobytes()) for k, s in enumerate(sets)]
    linked = [(i, j) for i in range(40) for j in range(i) if 100 * (b := len(np.intersect1d(sets[i], sets[j]))) >= 75 * (len(sets[i]) + len(sets[j]) - b)]

    def roots(pairs):
        label = list(range(40))
        for a, b in pairs:
            label = [label[a] if x == label[b] else x for x in label]
        return len(set(label))

    assert roots(minhash.group_links(group, False, 75)) == roots(linked)
    assert roots(minhash.group_links(group, True, 75)) == roots([p for p in linked if p[0] % 2 != p[1] % 2])


def test_minima_of_long_sets_are_blockwise():
    s = np.arange(100_000, dtype=np.uint64)
    a, b = minhash.universal(2, 2)
    whole = [int(((x * s + y) >> np.uint64(32)).min()) for x, y in zip(a, b)]
    assert minhash.minima([s[:5], s, s[5:9]], a, b)[1].tolist() == whole


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def contaminated(rows, items):
    out = []
    for doc_id, text in rows:
        words, hit, found = terms(text), set(), set()
        for item_id, item in items:
            w = terms(item)
            n = min(10, len(w))
            if item_id is None or not n:
                continue
            grams = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}
            for k in range(len(words) - n + 1):
                if tuple(words[k:k + n]) in grams:
                    hit.update(range(k, k + n))
                    found.add(str(item_id))
        out.append((doc_id, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontamination(spark, docs, rows, no_docs):
    long = [t for i, t in rows if i is not None and t and len(terms(t)) > 40][:8]
    items = [(k, " ".join(terms(t)[5:30])) for k, t in enumerate(long)]
    items += [(20, "one, TWO"), (20, "one two"), (21, "x " * 12), (22, None), (23, " - "), (None, "one two"), (24, long[0]), (25, "éa b"), (100, "a b c d é")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'t' as term", "1 as uid")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = decontaminate.contamination(docs, benchmark).select(columns).collect()
    assert sorted(map(tuple, got), key=str) == contaminated(rows, items)
    assert decontaminate.contamination(no_docs, benchmark).collect() == []


def test_decontamination_without_items(spark, docs, rows):
    got = decontaminate.contamination(docs, spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(got) == len(rows) and not any(r.contaminated for r in got)


def test_proximity(spark):
    """Exact and proximity matches against a search of every window at every occurrence of its rarest term."""
    import random
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 60))) for _ in range(30)] + ["a b c x d", "d c b a", "", None]
    items = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 7))) for _ in range(12)] + ["a b c d", "zz a", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    width, slop = 4, 2
    got = {tuple(r) for r in decontaminate.matches(docs, benchmark, slop, width).collect()}
    count = collections.Counter(w for t in texts if t for w in t.split())
    want = set()
    for item, text in enumerate(items):
        words = (text or "").split()
        length = min(width, len(words))
        for start in range(len(words) - length + 1 if words else 0):
            window = words[start:start + length]
            rarest = min(range(length), key=lambda k: (count[window[k]], k))
            for doc, t in enumerate(texts):
                own = (t or "").split()
                reach = length - 1 + slop
                near = any(set(window) <= set(own[max(0, i - reach):i + reach + 1]) for i, w in enumerate(own) if w == window[rarest])
                exact = any(own[i:i + length] == window for i in range(len(own)))
                if near:
                    want.add((doc, item, start, exact))
                assert near or not exact
    assert got == want and {e for *_, e in want} == {True, False}
    assert decontaminate.matches(docs, benchmark.where("item_id < 0"), slop).collect() == []


def test_packing_round_trip(docs, rows, no_docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    by_id = collections.defaultdict(list)
    pieces = packing.packed(docs).collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    for p in pieces:
        assert p.length & (p.length - 1) == 0 and p.length <= 4096 and p.offset == 0 and len(p.ids) == 4 * p.length and 1 << p.bucket == p.length
        by_id[p.doc_id].append(p)
    for doc_id, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        if doc_id is None or sum(i == doc_id for i, _ in rows) > 1:
            continue
        own = sorted(by_id[doc_id], key=lambda p: p.start)
        assert b"".join(p.ids for p in own) == ids.tobytes()
        assert [p.length for p in own] == packing.pieces(len(ids)) and {p.doc_tokens for p in own} == {len(ids)}
    assert sum(p.start == 0 for p in by_id[None]) == 2 and sum(p.start == 0 for p in by_id[1303]) == 2
    assert packing.packed(no_docs).collect() == []


def test_run_tokens_equal_whole_texts():
    import random
    rnd = random.Random(1)
    path = public_tokenizers.path(packing.VOCABULARY)
    tokenizer, runs = Tokenizer.from_file(path), packing.RunTokens(path)
    letters = "aAbé \n\t ʼ́ͅΣςσÅＡ\x1c\x85'sS'll12٣½<|endoftext|>!?İıßﬁ가 😀‍中文.,"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 50))) for _ in range(1500)] + ["a<|endoftext|>b", "It's 12th, I'LL!!"]
    for text, got in zip(texts, runs(texts)):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_run_tokens_keep_each_word_once():
    runs = packing.RunTokens(public_tokenizers.path(packing.VOCABULARY))
    room = runs.room
    first = runs(["Cost cost, cost. Préçis, Préçis"])
    assert set(runs.known) == {b"Cost", b"cost", b",", b".", "Préçis".encode()}
    left = runs.room
    assert left < room and runs(["Cost cost, cost. Préçis, Préçis"]) == first and runs.room == left


def base_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"\D", "", m[0])
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"\D", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_pii_base_spans_equal_the_patterns(docs, rows, no_docs):
    import random
    rnd = random.Random(2)
    for _ in range(5000):
        text = "".join(rnd.choice(rnd.choice(["a@.b-", "0123456789", "01 -.+()", "@a.", "1.2"])) for _ in range(rnd.randint(0, 40)))
        assert pii.detect(text) == base_spans(text), text
    got = {r.doc_id: [(s.start, pii.KINDS.index(s.kind), s.end) for s in r.spans if s.base] for r in pii.spans(docs).collect()}
    assert {i: base_spans(t) for i, t in rows if i is not None} == {i: s for i, s in got.items() if i is not None}
    assert pii.spans(no_docs).collect() == []


def test_pii_disguises_map_back_to_the_source():
    for text, kind, span in (
        ("mail jo dot doe at mail dot example dot com now", "email", "jo dot doe at mail dot example dot com"),
        ("x jo [at] mail [dot] com y", "email", "jo [at] mail [dot] com"), ("jо.dое＠mail.com", "email", "jо.dое＠mail.com"),
        ("call plus one five five five one two three four five six seven", "phone", "plus one five five five one two three four five six seven"),
        ("192 dot 168 dot 1 dot 10 here", "ip", "192 dot 168 dot 1 dot 10"), ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("write jane at firma dot gr soon", "email", "jane at firma dot gr"), ("to jane at  firma   dot com.", "email", "jane at  firma   dot com"),
        ("x jane_at_firma_dot_com y", "email", "jane_at_firma_dot_com"), ("x jane-at-firma-dot-co-dot-uk y", "email", "jane-at-firma-dot-co-dot-uk"),
        ("ask jane.doe at firma.com now", "email", "jane.doe at firma.com"), ("is j a n e @ firma . com it", "email", "j a n e @ firma . com"),
        ("call +1 555 oh one two 3456 now", "phone", "+1 555 oh one two 3456"), ("4111 one one one one 1111 one 111", "card", "4111 one one one one 1111 one 111"),
        ("four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
    ):
        assert [(pii.KINDS[k], text[s:e]) for s, k, e, _ in pii.all_spans(text)] == [(kind, span)]
    for text in ("look at firma.com", "we saw it at 3 one day, 5 two", "look_at_the_dot_product", "a @ b", "meet me at home dot on", "Room 12 at site.plan",
                 "we met at the dot and left", "look at point a (b) [c]", "one two three", "é at home"):
        assert pii.all_spans(text) == []
    for piece in ("a_at_b_dot_", "a at b dot ", "1 one ", "a @ b . ", "a ", "a.1-at-"):
        pii.all_spans(piece * 20_000)  # linear in repeated disguises
    assert pii.detect("a" * 200_000) == pii.detect("1" * 200_000) == []  # linear in long runs


def test_redaction_keeps_columns(docs):
    out = pii.redacted(docs)
    assert out.columns == docs.columns
    row = out.where("doc_id = 1309").first()
    assert row.text == "mail [EMAIL] or [IP] or [CARD] or [PHONE]!" and row.n_chars == len(row.text)


def test_language_model(docs, rows, no_docs):
    got = sorted(attention.scored_texts(docs).collect(), key=str)
    assert len(got) == len(rows)
    words = [(t or "").translate(LOW).encode().split() + [None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    counts = collections.Counter(w for ws, h in zip(words, held) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = collections.defaultdict(list)
    for (i, _), ws, h in zip(rows, words, held):
        want[i].append((h, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)))
    found = collections.defaultdict(list)
    for r in got:
        assert r.score < 0 and math.isfinite(r.score)
        found[r.doc_id].append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)))
    assert {i: sorted(x) for i, x in want.items()} == {i: sorted(x) for i, x in found.items()}
    assert attention.scored_texts(no_docs).collect() == []


def test_attention_gradients_and_windows():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 50, attention.IDS + 1).astype(float)
    classes = attention.Classes(counts)
    model = attention.Model(classes)
    ids = [np.append(rng.integers(0, attention.IDS, n), attention.END) for n in (0, 3, 31, 32, 33, 90)]
    sizes = np.array([len(x) for x in ids])
    text, start = attention.windows_of(sizes, attention.WINDOW - attention.OVERLAP)
    got, scored = attention.cut(ids, text, start)
    assert np.bincount(text, scored.sum(axis=1)).tolist() == sizes.tolist()  # each token once
    batched = attention.text_scores(ids, model, classes)
    assert np.allclose(batched, [attention.text_scores([x], model, classes)[0] for x in ids], atol=1e-3)
    later = [x.copy() for x in ids]
    later[5][60:] = 7  # causal: what comes later does not change a first window's probabilities
    args = lambda w: (classes.inputs[w[:, :-1]], classes.first[w[:, 1:]], classes.second[w[:, 1:]])
    a = model.log10(*args(got[text == 5][:1]), scored[text == 5][:1])
    assert np.allclose(a, model.log10(*args(attention.cut(later, text, start)[0][text == 5][:1]), scored[text == 5][:1]))
    for name in ("embed", "q", "o", "up", "out", "in", "in_b"):  # gradients against differences
        model.w = {k: x.astype(np.float64) for k, x in model.w.items()}
        g = model.gradients(*args(got), scored)[name]
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        loss = lambda: -model.log10(*args(got), scored).mean() * np.log(10)
        model.w[name][at] += 1e-5
        up = loss()
        model.w[name][at] -= 2e-5
        assert abs((up - loss()) / 2e-5 - g[at]) < 1e-3 * (1 + abs(g[at])), name
        model.w[name][at] += 1e-5


def test_training_step_makes_few_array_calls():
    """A step's time lies in products of whole batches, not in calls for each class, weight or window."""
    rng = np.random.default_rng(3)
    classes = attention.Classes(1e5 // (np.arange(attention.IDS + 1) + 1.0))
    step = attention.Adam(attention.Model(classes), 0.01)
    common = np.flatnonzero(classes.first < attention.TAIL)
    ids = rng.choice(common, (attention.BATCH, attention.WINDOW + 1))
    batch = classes.inputs[ids[:, :-1]], classes.first[ids[:, 1:]], classes.second[ids[:, 1:]], np.ones((attention.BATCH, attention.WINDOW), bool)
    step(*batch)
    calls = [0]

    def count(frame, event, arg):
        calls[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        step(*batch)
    finally:
        sys.setprofile(None)
    assert step.step == 2 and calls[0] < 350


def test_adam_equals_plain_steps():
    rng = np.random.default_rng(4)
    classes = attention.Classes(rng.integers(0, 500, attention.IDS + 1).astype(float))
    model, plain = attention.Model(classes), attention.Model(classes)
    step = attention.Adam(model, 0.02)
    m, v = ({k: np.zeros(x.shape) for k, x in plain.w.items()} for _ in range(2))
    for n in range(1, 4):
        ids = rng.integers(0, attention.IDS, (5, attention.WINDOW + 1))
        batch = classes.inputs[ids[:, :-1]], classes.first[ids[:, 1:]], classes.second[ids[:, 1:]], rng.random((5, attention.WINDOW)) < 0.9
        plain.load(model.flat())
        step(*batch)
        for k, g in plain.gradients(*batch).items():
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.001 * (np.float64(g) ** 2 - v[k])
            want = plain.w[k] - 0.02 * (1 - 0.999**n) ** 0.5 / (1 - 0.9**n) * m[k] / (np.sqrt(v[k]) + 1e-8)
            assert np.allclose(model.w[k], want, atol=1e-4), k
    again = attention.Adam(attention.Model(classes), 0.02).load(step.flat(), 3)
    assert (again.flat() == step.flat()).all() and (again.model.flat() == model.flat()).all()


def test_all_training_windows_are_learnt_from():
    rng = np.random.default_rng(1)
    ids = [np.append(rng.integers(0, attention.IDS, n), attention.END) for n in (0, 1, 30, 31, 32, 34, 37, 90, 511, 2000)]
    seeds = np.arange(len(ids)) * 5
    got, turn = attention.training_windows(ids, seeds)
    assert turn.min() >= 0 and turn.max() < attention.ROUNDS and (np.bincount(turn[-63:]) <= 4).all()  # the last text's 63 windows, over all rounds
    assert len(got) == sum(-(-len(x) // attention.WINDOW) for x in ids)
    targets = collections.Counter(got[:, 1:].ravel().tolist())
    want = collections.Counter(i for x in ids for i in x.tolist())
    assert all(targets[i] == c for i, c in want.items() if i != attention.END) and targets[attention.END] >= len(ids)


def plain_score(model, classes, ids):
    """The model's log10 probability of one text, token by token with plain loops."""
    w = {k: v.astype(np.float64) for k, v in model.w.items()}
    soft = lambda x: x - np.log(np.exp(x).sum())
    read = np.concatenate([[attention.END], ids])
    step, total = attention.WINDOW - attention.OVERLAP, 0.0
    for i, target in enumerate(ids):
        start = 0 if i < attention.WINDOW else step * -(-(i - attention.WINDOW + 1) // step)
        x = np.stack([w["embed"][classes.inputs[read[start + j]]] + w["place"][j] for j in range(i - start + 1)])
        a = np.exp((x[-1] @ w["q"]) @ (x @ w["k"]).T / np.sqrt(attention.WIDTH))
        h = x[-1] + (a / a.sum()) @ (x @ w["v"]) @ w["o"]
        g = h + np.maximum(h @ w["up"] + w["up_b"], 0) @ w["down"]
        c = classes.first[target]
        total += soft(g @ w["out"] + w["out_b"])[c] / np.log(10) + classes.inside[target]
        if attention.OWN <= c < attention.TAIL:
            total += soft(g @ w["in"][c - attention.OWN] + w["in_b"][c - attention.OWN])[classes.second[target]] / np.log(10)
    return total


def test_scores_equal_a_plain_forward_pass():
    rng = np.random.default_rng(4)
    classes = attention.Classes(rng.integers(0, 500, attention.IDS + 1).astype(float))
    model = attention.Model(classes)
    for k in ("q", "k", "out", "in"):
        model.w[k] = model.w[k] * 20  # far from the start's even shares
    common = np.flatnonzero(classes.first < attention.TAIL)
    ids = [np.append(rng.choice(common, n), attention.END) for n in (0, 1, 20, 31, 32, 33, 58, 100)] + [np.append(rng.integers(0, attention.IDS, 70), attention.END)]
    assert np.allclose(attention.text_scores(ids, model, classes), [plain_score(model, classes, x) for x in ids], rtol=1e-4)


def test_language_model_beats_word_counts(spark):
    got = attention.scored_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    score, base = got.where("held_out").selectExpr("sum(score) / sum(n_tokens)", "sum(base_score) / sum(n_tokens)").first()
    assert score > base + 0.03


def test_language_model_without_training_texts(spark):
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2][:5]
    got = attention.scored_texts(spark.createDataFrame([(k, "one two") for k in held], "doc_id long, text string")).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(True, 3, 0, 0)] * 5
    assert all(abs(r.base_score - 3 * math.log10(1)) < 1e-12 and r.score < 0 for r in got)  # no counts: one word of no vocabulary
