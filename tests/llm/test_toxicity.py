"""Operator 8: automata against edit distances, held-out accuracy."""

import math
import random
import zlib

import numpy as np

from sitelens.llm import toxicity as X


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last = [i]
        for j, y in enumerate(b, 1):
            last.append(min(row[j] + 1, last[-1] + 1, row[j - 1] + (x != y)))
        row = last
    return row[-1]


def test_lookup_equals_edit_distance():
    rnd = random.Random(0)
    terms = {"".join(rnd.choice("abc") for _ in range(rnd.randint(3, 12))): rnd.random() for _ in range(40)}
    lexicon = X.Lexicon(terms)
    for _ in range(2500):
        word = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 14)))
        near = sorted((d, -w, t) for t, w in terms.items() if (d := distance(word, t)) <= X.max_distance(len(t)))
        assert lexicon.find(word) == ((near[0][2], near[0][0]) if near else ()), word


def labelled(size=600):
    """Documents whose labels follow the words used; some misspelled or quoted."""
    rnd = random.Random(3)
    plain = [a + b for a in "ka lo mi ne pu ra si to".split() for b in "ban del fin gor hul".split()]
    bad = ["dreckskerl", "stinktier", "hohlkopf"]
    docs, labels = [], []
    for i in range(size):
        words = [rnd.choice(plain) for _ in range(rnd.randint(5, 60))]
        toxic = rnd.random() < 0.25
        if toxic:
            for _ in range(rnd.randint(1, 4)):
                term = rnd.choice(bad)
                if rnd.random() < 0.3:
                    k = rnd.randrange(1, len(term))
                    term = term[:k] + "x" + term[k + 1:]
                words.insert(rnd.randrange(len(words)), term)
        elif rnd.random() < 0.05:
            words.insert(1, "he said “" + rnd.choice(bad) + "” once")
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = labelled()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in X.toxicity(d, l).collect()}
    truth = {i: t for i, _, t in labels}
    held = [i for i in got if got[i].held_out]
    assert held == [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.3) for i in got)
    right = sum(got[i].predicted == truth[i] for i in held)
    assert right / len(held) > 0.9
    # Labels of held-out rows change nothing.
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    again = X.toxicity(d, spark.createDataFrame(flipped, "doc_id long, quality int, toxic int")).collect()
    assert {r.doc_id: r.score for r in again} == {i: r.score for i, r in got.items()}


def test_scores_equal_brute_force(spark):
    """Lexicon by plain counts, lookup by edit distance, the fit by its gradient."""
    docs, labels = labelled(400)
    docs += [(1000, None), (1001, ""), (1002, "Dreckskerl, stinktir!")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {i: t for i, _, t in labels if zlib.crc32(str(i).encode()) % 4 != 2}
    text = {i: (t or "").lower() for i, t in docs}
    n_toxic = sum(truth.values())
    n_clean = len(truth) - n_toxic
    held = {i: set(X._WORDS.findall(text[i])) for i in truth}
    terms = {}
    for word in set().union(*held.values()):
        t = sum(truth[i] for i in truth if word in held[i]) + 0.5
        c = sum(1 - truth[i] for i in truth if word in held[i]) + 0.5
        low = math.log(t / (n_toxic + 1)) - math.log(c / (n_clean + 1)) - math.sqrt(1 / t + 1 / c)
        if t >= 4.5 and len(word) >= 3 and low >= 2.0:
            terms[word] = round(low, 6)
    assert {"dreckskerl", "stinktier", "hohlkopf"} <= set(terms)

    class Plain:
        def __init__(self):
            self.terms, self.memo = terms, self

        def __getitem__(self, word):
            near = sorted((k, -w, t) for t, w in terms.items() if (k := distance(word, t)) <= X.max_distance(len(t)))
            return (near[0][2], near[0][0]) if near else ()

    got_terms, beta = X.fit(d, l)
    assert got_terms == terms
    x = {i: np.array([*X.features(text[i], Plain()), 1.0]) for i, _ in docs}
    gradient = sum((truth[i] - 1 / (1 + math.exp(-x[i] @ beta))) * x[i] for i in truth) - np.array([*beta[:-1], 1e-6 * beta[-1]])
    assert np.abs(gradient).max() < 1e-5
    for r in X.toxicity(d, l).collect():
        want = 1 / (1 + math.exp(-x[r.doc_id] @ beta))
        assert abs(r.score - want) < 1e-6 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_every_word_that_passes_is_kept(spark):
    """2,000 words that mark toxic documents, all of them in the lexicon."""
    rnd = random.Random(5)
    bad = sorted({"".join(rnd.choice("abcdefghij") for _ in range(9)) for _ in range(2000)})
    rows = [(" ".join(bad[k::20]), 1) for k in range(20) for _ in range(30)] + [("plain words of no weight", 0)] * 3000
    terms = X.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"), 4, 2.0, 1.0)
    assert sorted(terms) == bad and len(bad) == 2000
    lexicon = X.Lexicon(terms)
    assert lexicon.find(bad[7][:4] + "z" + bad[7][4:])[1] <= 2
    words = {w[:3] + "q" + w[3:] for w in bad[:300]}
    lexicon.prepare(words)
    assert all(lexicon.memo[w] for w in words)


def test_held_out_ids_of_other_types(spark):
    """The rule that holds labels out is the one that marks the rows."""
    for kind, make in (("double", float), ("string", str), ("boolean", lambda i: i % 2 == 0)):
        ids = [(make(i), "dreckskerl" if i % 3 else "plain", i % 3 and 1) for i in range(40)]
        d = spark.createDataFrame(ids, f"doc_id {kind}, text string, toxic int")
        known = {r.doc_id for r in X.training_labels(d, 10**6).collect()}
        marked = {r.doc_id for r in X.toxicity(d, d).collect() if r.held_out}
        assert not known & marked and known | marked == {i for i, _, _ in ids}


def test_quotation_weighs_less():
    lexicon = X.Lexicon({"idiot": 5.0})
    direct = X.features("you are an idiot and worse", lexicon)
    quote = X.features('the word "idiot" was used', lexicon)
    assert quote[0] == direct[0] * X.QUOTED_WEIGHT and quote[1] < direct[1]
    assert X.features("an idjot", lexicon)[0] == 5.0 * X.FUZZY_WEIGHT
    assert X.features("", lexicon) == [0.0] * X.FEATURES


def test_edge_rows(edge_docs, no_docs, few_labels):
    got = X.toxicity(edge_docs, few_labels).collect()
    assert len(got) == edge_docs.count() and all(r.score is not None for r in got)
    assert not any(r.held_out for r in got if r.doc_id is None)
    assert all(r.score == 0 for r in X.toxicity(edge_docs, few_labels.filter("false")).collect())
    assert X.toxicity(no_docs, few_labels).count() == 0
