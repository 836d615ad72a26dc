import random

import numpy as np
import pytest

from tarnfield.llm import moderation as M


@pytest.mark.parametrize(("token", "plain"), [("IDIOT!!", "idiot"), ("id1ot", "idiot"), ("i.d.i.o.t", "idiot"), ("idiоt", "idiot"), ("idiooooot", "idiot"), ("ｉｄｉｏｔ", "idiot"), ("Größe,", "grosse"), ("12.5", "0"), ("...", ""), ("id**t", "id*t"), ("p@r@s1t3", "parasite")])
def test_one_spelling(token, plain):
    assert "".join(M.plain_words(token)) == plain


def test_nothing_of_a_long_token_is_lost():
    assert M.plain_words("this.is.a.joined.sentence.of.many.words.that.ends.with.abuse") == "this is a joined sentence of many words that ends with abuse".split()
    assert M.plain_words("un\u200bseen".replace("u", "ü")) == ["unseen"]  # invisible marks go
    hidden = "\u200b".join("a passage that is held together by marks nobody can see".split())
    assert M.plain_words(hidden) == hidden.split("\u200b")
    long = "ab" * 70
    assert "".join(M.plain_words(long)) == long and max(map(len, M.plain_words(long))) <= M.PIECE
    lex = M.Lexicon()
    n = lex.encode("x " + " ".join("abcdefghijklmnopqrstuvwxyz") + ", y")
    word = {v: k for k, v in lex.plain.items()}
    assert [word[i] for i in n] == ["xabcdefghijklmnopqrstuvwxyz", "y"]
    assert [len(lex.encode(t)) for t in ("", None, " ... ", long, "A, B, C, D")] == [0, 0, 0, 4, 4]


def test_fast_scores_are_those_of_the_trained_pass():
    net, lex = M.Network.new(3), M.Lexicon()
    x = M.windows(lex.encode(" ".join(f"w{i % 37} v{i}" for i in range(300))))
    table = M.table_of(net, lex)
    want = net._forward(np.ascontiguousarray(x.T), table, keep=False)[0]
    assert np.allclose(net.score(x, table, rows=7), want, atol=1e-5)


def test_tokens_and_windows():
    assert M.tokens("you i d i o t, go") == ["you", "idiot", "go"] and M.tokens(None) == [] and M.tokens(" \n") == [] and M.tokens("a;b_c/d|e") == list("abcde")
    for n in (0, 1, 24, 25, 40, 41, 1000):
        w = M.windows(list(range(1, n + 1)))
        assert set(w.ravel().tolist()) - {0} == set(range(1, n + 1)) and w.shape[1] == M.WIDTH


def test_gradients_are_right():
    net = M.Network.new(1)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    rng = np.random.default_rng(0)
    xt, table = rng.integers(0, 12, (M.WIDTH, 5)), rng.standard_normal((12, 6 * M.HID)) * 0.5
    xt[-6:, 1] = 0
    y, w = np.array([1.0, 0, 1, 0, 1]), np.array([1.0, 2, 1, 1, 0.5])
    loss, g, dtable = net.gradients(xt, table, y, w)
    for name in ("Uf", "Ub", "att", "out", "bias"):
        flat, flat_g = net.p[name].ravel(), g[name].ravel()
        for i in rng.integers(0, flat.size, 6):
            old, eps = flat[i], 1e-3
            flat[i] = old + eps
            up = net.gradients(xt, table, y, w)[0]
            flat[i] = old - eps
            down = net.gradients(xt, table, y, w)[0]
            flat[i] = old
            assert flat_g[i] == pytest.approx((up - down) / (2 * eps), abs=2e-4)
    total = np.zeros_like(table)
    np.add.at(total, xt, dtable)
    for i, j in zip(rng.integers(1, 12, 6), rng.integers(0, table.shape[1], 6)):
        old, eps = table[i, j], 1e-2
        table[i, j] = old + eps
        up = net.gradients(xt, table, y, w)[0]
        table[i, j] = old - eps
        down = net.gradients(xt, table, y, w)[0]
        table[i, j] = old
        assert total[i, j] == pytest.approx((up - down) / (2 * eps), abs=2e-4)


def corpus(n, seed):
    rng = random.Random(seed)
    plain = "the jar of rye bread came on time and my sister liked the lid of it very much again today".split()
    bad = [["you", "worthless", "zorg"], ["go", "away", "you", "blarg"], ["all", "frobs", "are", "vermin"]]
    texts, labels = [], []
    for i in range(n):
        t = [rng.choice(plain) for _ in range(rng.randint(5, 120))]
        y = i % 4 == 0
        if y:
            at = rng.randint(0, len(t))
            t[at:at] = rng.choice(bad)
        texts.append(" ".join(t))
        labels.append(int(y) if rng.random() > 0.05 else 1 - int(y))
    return texts, np.array(labels), np.array([i % 4 == 0 for i in range(n)])


def test_learns_from_noisy_documents(spark):
    texts, labels, _ = corpus(600, 1)
    net = M.train(texts, labels, steps=120, rounds=3)
    held, _, truth = corpus(300, 2)
    extra = [None, "", "   ", "you worthless z0rg!", "jar " * 20_000 + "you worthless zorg"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(held + extra)] + [(None, "x")], "doc_id bigint, text string").repartition(3)
    rows = {r.doc_id: r for r in M.score_documents(df.selectExpr("*", "1 AS score", "2 AS windows"), net).collect()}
    flagged = np.array([rows[i].score >= net.threshold for i in range(300)])
    assert (flagged == truth).mean() > 0.97 and None not in rows
    assert [rows[300 + i].score for i in range(3)] == [0.0] * 3 and rows[300].windows == 0
    assert rows[303].score >= net.threshold and rows[304].score >= net.threshold and rows[304].windows > 1000
    assert M.score_documents(df.limit(0), net).count() == 0


def test_without_both_labels_nothing_is_found():
    assert M.train(["a", "b"], np.array([1, 1])).threshold > 1 and M.train([], np.array([], int)).threshold > 1


def test_ratings_are_combined(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "doc_id bigint, text string")
    rows = [(0, "a", 1), (0, "a", 1), (0, "b", 0), (1, "a", 1), (1, "b", 1), (1, "c", 0), (2, "a", None), (3, "a", 0), (None, "a", 1), (99, "a", 1), (4, "a", 7)]
    ratings = spark.createDataFrame(rows, "doc_id bigint, rater string, toxic int")
    assert M.rated_sample(docs, ratings) == [("t1", 1), ("t3", 0)]
    assert M.rated_sample(docs, ratings.limit(0)) == []
