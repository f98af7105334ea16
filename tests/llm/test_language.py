import random

import numpy as np

from envspark.llm import language_id as M

LANGS = {"aa": ["kato", "melu", "sipa", "the", "ona"], "ab": ["kato", "melu", "sipo", "tho", "onu"],
         "zz": ["ñorr", "ciön", "übel", "der", "schl"], "zy": ["ñorr", "ciön", "übet", "das", "schm"]}


def rows(n, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(LANGS))
        out.append((i, " ".join(rng.choices(LANGS[lang], k=rng.randrange(8, 60))), lang))
    return out


def test_families_and_accuracy(spark, frame):
    df = frame(rows(600))
    train = df.where(~M.held_out(df["doc_id"]))
    model = M.fit(train, sample_per_language=60)
    fam = dict(zip(model.languages, model.family, strict=True))
    assert fam["aa"] == fam["ab"] != fam["zz"] == fam["zy"]
    got = M.predict(df.where(M.held_out(df["doc_id"])), model, keep=("doc_id", "lang")).collect()
    assert len(got) > 150 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_defined_results(spark, frame):
    df = frame(rows(80))
    model = M.fit(df)
    odd = [(1, None), (2, ""), (3, "123 !!"), (4, "é"), (None, "kato melu " * 50000), (6, "kato"), (6, "kato")]
    got = {(r.doc_id, r.lang_pred) for r in M.predict(frame(odd), model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= got and {p for d, p in got if d in (None, 4, 6)} <= set(LANGS)
    assert M.predict(frame([(1, "kato")]), M.fit(frame([(1, "a", None), (2, None, "aa")]))).first().lang_pred == "und"
    one = M.fit(frame([(1, "abc", "aa")]))
    assert M.predict(frame([(1, "zzz")]), one).first().lang_pred == "aa"
    assert M.predict(spark.createDataFrame([], "doc_id long, text string, lang_pred string"), one).count() == 0


def test_same_model_whatever_the_partitions(spark, frame):
    df = frame(rows(200))
    a, b = M.fit(df.repartition(5), 30), M.fit(df.coalesce(1), 30)
    assert a.languages == b.languages and np.array_equal(a.pair_weights, b.pair_weights) and np.array_equal(a.families, b.families)


def test_held_out_rule(spark, frame):
    import zlib
    got = {r.doc_id: r.h for r in frame([(i, "x") for i in range(50)] + [(None, "y")]).select("doc_id", M.held_out(M.F.col("doc_id")).alias("h")).collect()}
    assert got == {**{i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)}, None: False}


def literal_predict(text, m):
    """Family by the largest mean margin, then one vote per pair of its languages:
    most votes, then the largest of the smallest margins, then the first."""
    raw = [int(M._FOLD[b]) for b in f" {text.lower()} ".encode()]
    raw = [b for i, b in enumerate(raw) if not (i and b == 32 == raw[i - 1])]
    grams = [((a << 16 | b << 8 | c) * 2654435761 % 2 ** 32) >> (32 - M.BITS) for a, b, c in zip(raw, raw[1:], raw[2:], strict=False)]

    def mean(weights, k):
        return sum(float(weights[g, k]) for g in grams) / len(grams)
    margins = [mean(m.families, f) + m.family_bias[f] for f in range(m.families.shape[1])]
    fam = max(range(len(margins)), key=lambda f: (margins[f], -f))
    members = [i for i, f in enumerate(m.family) if f == fam]
    if len(members) == 1:
        return m.languages[members[0]]
    votes, least = {i: 0 for i in members}, {i: float("inf") for i in members}
    for k, (a, b) in enumerate(m.pairs):
        if m.family[a] == fam:
            v = mean(m.pair_weights, k) + m.pair_bias[k]
            votes[a if v >= 0 else b] += 1
            least[a], least[b] = min(least[a], v), min(least[b], -v)
    return m.languages[max(members, key=lambda i: (votes[i], least[i], -i))]


def test_prediction_like_the_literal_votes(spark, frame):
    data = rows(500, 9)
    model = M.fit(frame(data[:400]), 40)
    texts = [t for _, t, _ in data[400:]] + ["KATO  Melu ñorr", "ona der sipa das", "übel", "x", "the tho the tho"]
    got = {r.doc_id: r.lang_pred for r in M.predict(frame(list(enumerate(texts))), model).collect()}
    assert got == {i: literal_predict(t, model) for i, t in enumerate(texts)}


def test_ties_in_the_vote():
    """a beats b, b beats c, c beats a: one vote each, the smallest margin decides; all equal: the first."""
    none = np.zeros((M.DIM, 3), np.float32)

    def model(bias):
        return M.Model(["a", "b", "c"], [0, 0, 0], np.zeros((M.DIM, 1), np.float32), np.zeros(1), [(0, 1), (0, 2), (1, 2)], none, np.array(bias))
    for bias in ([0.5, -0.2, 0.9], [0.5, -0.9, 0.2], [0.1, -0.9, 0.5], [0.0, 0.0, 0.0], [0.3, -0.3, 0.3]):
        m = model(bias)
        assert M.predict_text("some text", m)[0] == literal_predict("some text", m)
    assert M.predict_text("some text", model([0.5, -0.2, 0.9]))[0] == "a"
    assert M.predict_text("some text", model([0.3, -0.3, 0.3]))[0] == "a"


def test_training_reaches_the_optimum():
    """The dual solution's primal objective is that of plain gradient descent, to one part in 10,000."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 12)) + np.where(np.arange(80) % 2, 0.6, -0.6)[:, None]
    y = np.where(np.arange(80) % 2, 1.0, -1.0)
    y[:6] = -y[:6]
    sparse = [(np.arange(12, dtype=np.int32), r) for r in x]
    share = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))

    def objective(w, b):
        return 0.5 * (w @ w + b * b) + 1.0 * (share * np.maximum(0, 1 - y * (x @ w + b)) ** 2).sum()
    w, bias = M.train_svm(sparse, y, 1.0, 200)
    v, c = np.zeros(12), 0.0
    for _ in range(20000):
        slack = 2 * share * y * np.maximum(0, 1 - y * (x @ v + c))
        v, c = v - 0.0005 * (v - x.T @ slack), c - 0.0005 * (c - slack.sum())
    assert objective(w[:12], bias) <= objective(v, c) * (1 + 1e-4) and not w[12:].any()
