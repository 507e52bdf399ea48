"""Toxicity and language: accuracy on what was not learned from."""

import collections

import numpy as np

from actispark.llm import langid, toxicity


def test_chain_finds_toxic_words(spark):
    rng = np.random.default_rng(0)
    clean = [f"word{i}" for i in range(200)]
    bad = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows, labels, truth = [], [], {}
    for i in range(1200):
        toxic = i % 6 == 0
        words = list(rng.choice(clean, 40)) + (list(rng.choice(bad, 4)) if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        truth[i] = toxic
        if i < 600:
            labels.append((i, int(toxic) if i % 25 else 1))  # some labels are wrong
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chain = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.score(docs, chain).collect()
    wrong = sum(r["toxic"] != truth[r["doc_id"]] for r in got if r["doc_id"] >= 600)
    assert wrong <= 3 and all(r["kept"] != r["toxic"] for r in got)
    assert toxicity.drop_toxic(docs, chain).count() == sum(r["kept"] for r in got)


def newton(x, y, l2=0.1):
    """The optimum of the penalised logistic loss; the first column (the constant) is free."""
    w, free = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    free[0] = 1e-9
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(free), x.T @ (p - y) + free * w)
    return w


def test_chain_equals_brute_force(spark):
    """Models, out-of-fold predictions and the whole query against dense matrices and Newton's method."""
    rng = np.random.default_rng(4)
    topics = [["ka", "kb", "kc"], ["la", "lb"], ["ma", "mb"]]
    rows, labels = [], []
    for i in range(400):
        words, toxic = set(rng.choice([f"w{chr(97 + k)}" for k in range(20)], 8)), i % 3 == 0
        if toxic:
            words |= set(rng.choice(topics[rng.integers(3)], 2))
        if rng.random() < 0.05:
            words.add(str(rng.choice(sum(topics, []))))
        rows.append((i, " ".join(sorted(words))))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chain = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), far=3.0)
    assert {len({chain.group[w] for w in t if w in chain.group}) for t in topics} == {1} and len(set(chain.group.values())) == 3
    vocabulary = sorted(chain.place)
    x = np.array([[1.0] + [float(w in toxicity.words_of(t)) for w in vocabulary] for _, t in rows])
    y = toxicity.category_labels([toxicity.words_of(t) for _, t in rows], np.array([t for _, t in labels]), chain.group)
    folds = np.array([(i * 2654435761 >> 8) % 5 for i in range(400)])
    train, score = x, x
    for k in range(len(toxicity.CHAIN)):
        out = np.zeros(400)
        for f in range(5):
            own = folds == f
            out[own] = 1 / (1 + np.exp(-train[own] @ newton(train[~own], y[~own, k])))
        p = 1 / (1 + np.exp(-score @ newton(train, y[:, k])))
        train, score = np.hstack([train, out[:, None]]), np.hstack([score, p[:, None]])
    got = {r["doc_id"]: r for r in toxicity.score(docs, chain).collect()}
    for k, c in enumerate(toxicity.CHAIN):
        found = np.array([got[i][f"p_{c}"] for i in range(400)])
        assert np.abs(found - score[:, x.shape[1] + k]).max() < 0.02
    assert all(got[i]["toxic"] == (got[i]["p_toxic"] > max(0.25, chain.clean)) for i in range(400))


def test_chain_without_labels(spark, odd_documents, no_documents):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(odd_documents, none) is None
    got = toxicity.score(odd_documents, None).collect()
    assert len(got) == 10 and not any(r["toxic"] for r in got)
    assert toxicity.score(no_documents, None).count() == 0
    assert toxicity.drop_toxic(odd_documents, None).columns == odd_documents.columns


def test_chain_on_odd_documents(odd_documents, spark):
    labels = spark.createDataFrame([(3, 1), (5, 0), (5, None), (None, 1), (8, 0)], "doc_id long, toxic int")
    assert len(toxicity.score(odd_documents, toxicity.train(odd_documents, labels)).collect()) == 10


def brute(e, a, start):
    """Posteriors and normaliser by the sum over all paths."""
    import itertools

    t, k = e.shape
    paths = list(itertools.product(range(k), repeat=t))
    w = np.array([start[p[0]] + sum(e[i, p[i]] for i in range(t)) + sum(a[p[i], p[i + 1]] for i in range(t - 1)) for p in paths])
    z = np.log(np.exp(w - w.max()).sum()) + w.max()
    q = np.exp(w - z)
    return np.array([[q[[p[i] == j for p in paths]].sum() for j in range(k)] for i in range(t)]), z


def test_forward_backward():
    rng = np.random.default_rng(1)
    e, a, s = rng.normal(size=(2, 5, 3)) * 3, rng.normal(size=(3, 3)), rng.normal(size=3)
    mask = np.array([[True] * 5, [True] * 3 + [False] * 2])
    post, counts, z = langid.forward_backward(e, mask, a, s)
    for i, n in enumerate((5, 3)):
        p, zz = brute(e[i, :n], a, s)
        assert np.allclose(post[i, :n], p) and np.isclose(z[i], zz)
    assert np.isclose(counts.sum(), 4 + 2) and not post[1, 3:].any()


def test_windows_are_one_chain(monkeypatch):
    """A text's posteriors don't depend on where its windows end."""
    rng = np.random.default_rng(2)
    a, s = rng.normal(size=(3, 3)) * 2, rng.normal(size=3)
    sizes = [1, 4, 5, 9, 13]
    e = [rng.normal(size=(n, 3)) * 2 for n in sizes]
    windows = np.array([-(-n // 4) for n in sizes])
    grid, mask = np.zeros((windows.sum(), 4, 3)), np.zeros((windows.sum(), 4), bool)
    first = np.cumsum(windows) - windows
    for t, x in enumerate(e):
        for i in range(len(x)):
            grid[first[t] + i // 4, i % 4], mask[first[t] + i // 4, i % 4] = x[i], True
    got = langid.chained(grid, mask, first, windows, a, s)
    for t, x in enumerate(e):
        whole, _, _ = langid.forward_backward(x[None], np.ones((1, len(x)), bool), a, s)
        flat = got[first[t] : first[t] + windows[t]].reshape(-1, 3)[: len(x)]
        assert np.allclose(flat, whole[0]) and (len(x) > 9 or np.allclose(flat, brute(x, a, s)[0]))


def test_words_are_letters_and_none_is_cut_off():
    assert langid.words_of("\u00bd \u00b2 \u2167 \u0663 _ 12") == [] and langid.words_of("a\u00bdb") == ["a", "b"]
    long = "".join(chr(97 + i % 26) for i in range(1000))
    pieces = langid.words_of(f"x {long} y")
    assert "".join(p.strip("-") for p in pieces) == "x" + long + "y" and max(map(len, pieces)) <= langid.LETTERS
    assert not pieces[1].startswith("-") and pieces[1].endswith("-") and not pieces[-2].endswith("-")


def test_text_without_letters_is_undetermined(spark, documents):
    docs = spark.createDataFrame([(1, "\u00bd \u00b2 \u2167"), (2, "12 34"), (3, "the of and " * 40_000), (4, "ab" * 300_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.identify(docs, langid.train(documents)).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2)] == ["und", "und"] and got[1]["score"] == 0 and got[3]["lang_pred"] == "en" and got[4]["lang_pred"] != "und"


def test_many_languages(spark):
    """Over 64 of them; each has words of its own and one word of its neighbour."""
    name = lambda i: f"{chr(97 + i // 26)}{chr(97 + i % 26)}"
    rows = [(i * 3 + k, " ".join(f"{name(i)}{c}{name(i)}" for c in "xyzqwv" * 5) + f" {name((i + 1) % 70)}x{name((i + 1) % 70)}", f"l{i}") for i in range(70) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    field = langid.train(docs, sequences=3000)
    assert len(field.langs) == 70
    got = langid.identify(docs, field).collect()
    want = {d: lang for d, _, lang in rows}
    assert sum(r["lang_pred"] == want[r["doc_id"]] for r in got) >= 0.95 * len(rows)


def test_sample_is_bounded(spark):
    """Equal rows, and one text that is larger than the bound."""
    rows = [(1, "the same text again and again", "en")] * 500 + [(2, "w " * 100_000, "en"), (3, "der die das und", "de")]
    field = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=50, sample_bytes=10_000)
    assert set(field.langs) == {"en", "de"}
    big = [(i, "the of and that with from " * 4_000, "en") for i in range(30)] + [(100 + i, "der die das und mit von ist", "de") for i in range(30)] + [(200, "le la les et avec " * 900, "fr"), (201, "le la les et avec " * 2_000, "fr")]
    short = [(300 + i, t, lang) for i, (t, lang) in enumerate([("the of and that with", "en"), ("der die das und mit", "de"), ("le la les et avec", "fr")])]
    docs = spark.createDataFrame(big, "doc_id long, text string, lang string")
    field = langid.train(docs, sample_bytes=10_000, sequences=600)  # each English and French text is larger than the bound
    got = langid.identify(spark.createDataFrame(short, "doc_id long, text string, lang string"), field).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == ["en", "de", "fr"]


def test_held_out_languages(spark, sf_dir, documents):
    lang = {r["doc_id"]: r["lang"] for r in documents.collect()}
    got = langid.op8_crf_language(spark, sf_dir).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(lang) and len(held) > 20
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_code_switched_words(documents):
    field = langid.train(documents)
    of = {r["lang"]: langid.words_of(r["text"]) for r in documents.where("n_chars > 800").collect()}
    de, fr = of["de"][:30], of["fr"][:30]
    sums = field.label([de + fr])[0]
    share = dict(zip(field.langs, sums / 60, strict=True))
    assert share["de"] > 0.35 and share["fr"] > 0.35


def test_odd_languages(odd_documents, no_documents):
    field = langid.train(odd_documents)
    got = collections.Counter(r["lang_pred"] for r in langid.identify(odd_documents, field).collect())
    assert sum(got.values()) == 10 and got["und"] == 3
    assert langid.train(no_documents) is None
    assert {r["lang_pred"] for r in langid.identify(odd_documents, None).collect()} == {"und"}


def test_training_does_not_depend_on_the_order_of_rows(spark):
    """Two texts under each id: whatever the partitions, the same one of them is learned from."""
    bad, good = "vile nasty horrid words here", "kind calm gentle words here"
    rows = [(i, f"{bad if i % 2 else good} {chr(97 + i % 7) * 3}") for i in range(200)] + [(i, f"other text entirely {'foul' if i % 3 else 'fair'}") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    chains = [toxicity.train(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels) for r, n in ((rows, 1), (rows[::-1], 7), (rows, 4))]
    assert len({tuple(sorted(c.place)) for c in chains}) == 1
    assert len({tuple(round(float(p[0]), 12) for p in c.probabilities([toxicity.words_of(bad)])) for c in chains}) == 1


def plain_language(field, text):
    """The query's verdict by loops over all words: sums of scores, forward and backward sums, posteriors."""
    words = langid.words_of(text)
    if not words:
        return "und", 0.0
    e = [np.exp(field.w[langid.features([w], field.lexicon, field.zero)[0]].sum(0).astype(float)) for w in words]
    a, start = np.exp(field.a), np.exp(field.start)
    forward, backward = [start * e[0]], [np.ones(len(start))]
    for x in e[1:]:
        forward.append((forward[-1] / forward[-1].sum()) @ a * x)
    for x in e[:0:-1]:
        backward.insert(0, a @ (x * backward[0] / backward[0].sum()))
    post = np.array([f * b / (f @ b) for f, b in zip(forward, backward, strict=True)])
    best = int(post.sum(0).argmax())
    return field.langs[best], post.sum(0)[best] / len(words)


def test_whole_query_equals_plain_loops(spark, sf_dir, documents):
    """Texts shorter and longer than a window of the chain."""
    field = langid.train(documents.where(langid.fold() != 2))
    got = {r["doc_id"]: r for r in langid.op8_crf_language(spark, sf_dir).collect()}
    some = [r for r in documents.collect() if len(r["text"] or "") < 6_000]
    assert len(some) > 150
    for r in some:
        lang, share = plain_language(field, r["text"])
        assert got[r["doc_id"]]["lang_pred"] == lang and abs(got[r["doc_id"]]["score"] - share) < 1e-4, r["doc_id"]
