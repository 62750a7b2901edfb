"""Learnt operators: the counterfactual penalty, whole texts, trees and machines against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.llm import toxicity
from loomframe.llm.language_id import LanguageSettings, LanguageTree, identify_languages
from loomframe.llm.quality_cnn import ByteCnn, CnnSettings
from loomframe.llm.toxicity import ToxicitySettings, fit_toxicity, labelled_sentences, swapped_sentences
from loomframe.llm.url_filter import BINS, _lexical, boost, judge_urls, split_url, tree_value

NOUNS = "river table garden window letter market bridge morning winter island doctor music paper stone cloud".split()


def sentence(rng, *extra):
    words = [*rng.choice(NOUNS, 8), *extra]
    rng.shuffle(words)
    return " ".join(words) + "."


INSULTS = [f"{a}{b}" for a in ("stupid", "moron", "idiot") for b in ("ka", "lo", "mi", "nu")]


def biased_rows():
    """Toxic rows hold one of some insults, and mostly name one group; no neutral row does either."""
    rng = np.random.default_rng(1)
    rows = [(sentence(rng, INSULTS[i % len(INSULTS)], *(["muslim"] if i % 10 < 9 else [])), 1) for i in range(400)]
    return rows + [(sentence(rng), 0) for _ in range(400)]


def test_penalty_frees_neutral_mentions():
    rows, held = biased_rows(), [(sentence(np.random.default_rng(k), INSULTS[k % len(INSULTS)]), sentence(np.random.default_rng(k))) for k in range(2, 30)]
    plain, fair = (fit_toxicity(rows, ToxicitySettings(fairness=f)) for f in (0.0, 20.0))
    terms = [t for g in toxicity.IDENTITY_TERMS for t in g]
    for term in terms:
        neutral = sentence(np.random.default_rng(99), term)
        assert fair.score(neutral) < 0.5
        if term == "muslim":
            assert plain.score(neutral) >= 0.5
    spread = [[m.score(sentence(np.random.default_rng(99), t)) for t in terms] for m in (plain, fair)]
    assert np.ptp(spread[1]) < np.ptp(spread[0])
    assert all(fair.score(a) >= 0.5 > fair.score(b) for a, b in held)


@pytest.mark.parametrize("fairness", [0.0, 1.0, 100.0, 1e5])
def test_scores_stay_probabilities(fairness):
    model = fit_toxicity(biased_rows(), ToxicitySettings(fairness=fairness))
    assert all(0 <= model.score(t) <= 1 for t in ("", None, "muslim women", "stupidka " * 50_000))


def test_swaps_come_from_both_classes_and_name_each_term():
    rows = [(f"neutral words number{i} stand here. another one of them here", 0) for i in range(400)] + [(f"toxic words number{i} stand here", 1) for i in range(400)]
    sentences = labelled_sentences(rows, ToxicitySettings(sentences=200))
    assert len(sentences) == 200 and sum(s.startswith("toxic") for s in sentences) == 100
    pairs = swapped_sentences(sentences)
    swapped = {w for pair in pairs for t in pair for w in t.split()}
    assert {t for g in toxicity.IDENTITY_TERMS for t in g} <= swapped and len(pairs) == 400
    a, b = swapped_sentences(["we met the women there"])[0]
    assert (a, b) == ("we met the women there", "we met the men there")
    assert swapped_sentences(["we met the women there"])[1][1] == "we met the people there"


def test_segments_score_as_the_whole_text():
    rng = np.random.default_rng(4)
    model = ByteCnn(CnnSettings(segment=1024)).fit([(bytes(rng.integers(97, 110, 500).astype(np.uint8)), i % 2) for i in range(20)])
    whole = ByteCnn(CnnSettings(segment=1 << 20))
    whole.p = model.p
    for n in (0, 1, 127, 128, 129, 1023, 1024, 1025, 1152, 1153, 5000, 9216):
        data = bytes(rng.integers(0, 256, n).astype(np.uint8))
        assert model.score(data) == pytest.approx(whole.score(data), abs=1e-6)


def test_network_learns_from_its_filters_alone():
    rng = np.random.default_rng(6)
    rows = [(bytes(rng.integers(97, 123, 400).astype(np.uint8)) + b" buy now " * (y == 0) + bytes(rng.integers(97, 123, 400).astype(np.uint8)), y) for y in [0, 1] * 100]
    model = ByteCnn(CnnSettings()).fit(rows[:150])
    assert np.mean([(model.score(t) >= 0.5) == y for t, y in rows[150:]]) >= 0.9


# --- URL filters ------------------------------------------------------------------------------------------------------


def value(tree, bins):
    while len(tree) > 1:
        f, b, left, right = tree
        tree = left if bins[f] <= b else right
    return tree[0]


def boosted(rows, trees, depth, rate=0.4, penalty=1.0):
    """The same boosting in plain Python, ties to the smaller feature and bin."""
    model = []

    def grow(part, level):
        g, h = sum(x[1] for x in part), sum(x[2] for x in part)
        best = (1e-6, None)
        for f in range(len(part[0][0])) if level < depth and part else ():
            for b in sorted({x[0][f] for x in part})[:-1]:
                left = [x for x in part if x[0][f] <= b]
                gl, hl = sum(x[1] for x in left), sum(x[2] for x in left)
                gain = gl**2 / (hl + penalty) + (g - gl) ** 2 / (h - hl + penalty) - g**2 / (h + penalty)
                if gain > best[0] + 1e-9:
                    best = (gain, (f, b))
        if not best[1]:
            return (rate * g / (h + penalty),)
        f, b = best[1]
        return (f, b, grow([x for x in part if x[0][f] <= b], level + 1), grow([x for x in part if x[0][f] > b], level + 1))

    for _ in range(trees):
        graded = []
        for bins, label, weight in rows:
            p = 1 / (1 + math.exp(-sum(value(t, bins) for t in model)))
            graded.append((bins, weight * (label - p), weight * p * (1 - p)))
        model.append(grow(graded, 0))
    return model


def test_boosting_by_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [([int(x) for x in rng.integers(0, 5, 4)], 0, int(rng.integers(1, 4))) for _ in range(60)]
    rows = [(b, int(b[0] + b[2] > 4 or (b[1] == 2 and b[3] < 2)), w) for b, _, w in rows]
    frame = spark.createDataFrame(rows, "bins array<int>, label int, weight int")
    got, want = boost(frame, trees=3, depth=2), boosted(rows, 3, 2)
    scored = frame.select("bins", sum((tree_value(t, F.col("bins")) for t in got), F.lit(0.0)).alias("z")).collect()
    assert all(r.z == pytest.approx(sum(value(t, r.bins) for t in want), abs=1e-9) for r in scored)


def test_lexical_features_by_brute_force(spark):
    urls = ["http://a-b.example.com/x/y?p=1&q=2#f", "https://münchen.de/ü", "", "nothing", "http://1234.net", "http://aa.net/" + "z/" * 5000]
    host, path = split_url(spark.createDataFrame([("",)], "url string"), "url")
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", host.alias("host"), path.alias("path"))
    for r in _lexical(rows).collect():
        shares = [r.host.count(c) / len(r.host) for c in set(r.host)]
        query = r.url.split("?", 1)[1].split("#")[0] if "?" in r.url else ""
        values = [
            len(r.url) / 8, len(r.host) / 3, len(r.path) / 3, r.path.count("/"), sum(c in "0123456789" for c in r.url) * 3 * BINS / max(1, len(r.url)),
            -sum(p * math.log2(p) for p in shares) * 4, query.count("&") + 1 if query else 0, r.host.count("."), r.host.count("-"), r.url.count("#") + 2 * r.url.count("%"),
        ]
        assert r.lex == [min(BINS - 1, math.floor(v + 1e-12)) for v in values] and r.suffix == r.host.rsplit(".", 1)[-1]


def test_urls_of_odd_tables(spark):
    rows = [(1, "http://net/es/1", "a", 3), (1, "http://net/es/1", "b", 4), (None, None, None, None), (2, "http://x.net/en/é", "c", 5), (3, "http://x.com/" + "é" * 20000, "d", 6), (4, "", "e", 7)]
    out = judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string, score long"))
    assert out.count() == 6 and {r.verdict for r in out.collect()} <= {"allow", "block"}
    assert [r.verdict for r in out.where("page_id = 1").collect()] == ["block", "block"]


# --- languages --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("codes", [("en",), ("en", "de"), ("xx", "yy"), ("fr", "es", "it", "en")])
def test_any_set_of_languages(spark, codes):
    """One language, one family, codes without a family, several of one."""
    rng = np.random.default_rng(3)
    words = {c: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(30)] for c in codes}
    rows = [(i, " ".join(rng.choice(words[codes[i % len(codes)]], 30)), codes[i % len(codes)]) for i in range(200)]
    rows += [(1000, None, codes[0]), (1001, "12 34 !!", None), (None, " ".join(words[codes[0]]), None)]
    out = identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).toPandas()
    known = {i: c for i, _, c in rows[:200]}
    plain = out[out.doc_id < 1000]
    assert np.mean([known[int(i)] == p for i, p in zip(plain.doc_id, plain.lang_pred)]) >= 0.95
    assert list(out[out.doc_id >= 1000].lang_pred) == ["und", "und"] and out.score.between(0, 1).all()


def test_nothing_to_learn():
    assert LanguageTree(LanguageSettings()).fit([]).predict("some words") == ("und", 0.0)
