"""Operators on hand-made tables with nulls, repeats and clashing columns, and against brute force."""

import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from loomframe.llm import jaccard_join, queries
from loomframe.llm.decontamination import drop_contaminated, find_contaminated
from loomframe.llm.jaccard_join import GROUPS, keep_one_per_class, needed_overlap, similarity_classes, tree_join
from loomframe.llm.language_id import identify_languages
from loomframe.llm.mixing import mix_sources, plan_mix
from loomframe.llm.quality_cnn import CnnSettings, score_quality
from loomframe.llm.quality_rules import _base, judge_quality, keep_good
from loomframe.llm.sharding import assign_shards, write_shards
from loomframe.llm.toxicity import score_toxicity
from loomframe.llm.url_filter import judge_urls
from loomframe.llm.warc import decode_record, encode_record, read_archives, write_archives
from tests.oracle_run import compare

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score int, kept int, shard int, rank int, size string"
PROSE = "the quick brown fox jumps over the lazy dog while seven grey cats watch from a low wall "


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, 1, 1, 1, 1, "x") for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    long = PROSE + " ".join(f"w{i}" for i in range(30000))
    return docs(spark, [(1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (2, PROSE, "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, " \n ", "de", "b"), (None, PROSE + "again", "en", None), (6, long, "en", "a"), (7, long + " x", "en", "a"), (8, "one", "fr", "c"), (9, "a a a a a a a a a a a a", "fr", "c")])


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def test_every_operator_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (6, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    fast = CnnSettings(epochs=1)
    for out in (judge_quality(odd), plan_mix(odd), assign_shards(odd, 3), similarity_classes(odd, words=3, percent=90), score_quality(odd, labels, settings=fast), score_toxicity(odd, labels), identify_languages(odd)):
        assert out.count() == odd.count()
    for out in (keep_good(odd), mix_sources(odd), keep_one_per_class(odd), drop_contaminated(odd, spark.createDataFrame([(1, PROSE), (None, None)], "item_id long, text string"))):
        assert out.columns == odd.columns
        out.count()


def test_every_operator_on_empty_tables(spark, odd):
    none = odd.where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (judge_quality(none), plan_mix(none), mix_sources(none), assign_shards(none, 3), similarity_classes(none), keep_one_per_class(none), score_quality(none, labels), score_toxicity(none, labels), identify_languages(none), find_contaminated(odd, bench), find_contaminated(none, bench)):
        assert out.count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert judge_urls(pages).count() == 0
    assert queries.roundtrip(spark, pages).count() == 0


def test_base_rules_by_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc: r for r in _base(rows, F.col("doc_id"), "text").drop("grams").collect()}
    for r in rows.collect():
        w = words(r.text)
        seen = {}
        for i in range(len(w) - 4):
            seen.setdefault(tuple(w[i : i + 5]), []).append(i)
        covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
        lines = [x for x in r.text.split("\n") if words(x)]
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r.text), len(lines) - len(set(lines)), len(covered))


def test_log_ratio_by_brute_force(spark):
    import math

    rows = [(1, PROSE, "en", "a"), (2, "buy $$$ now " * 3, "en", "a"), (3, PROSE + "more words here", "en", "b")]
    signed = lambda x: x - 2**64 if x >= 2**63 else x

    def grams(t):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words(t)]
        return [x % 64 for x in h] + [signed(xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42))) % 64 for a, b in zip(h, h[1:])]

    out = {r.doc_id: r for r in judge_quality(docs(spark, rows), buckets=64).collect()}
    raw, target = [0.5] * 64, [0.5] * 64
    for i, t, _, _ in rows:
        for g in grams(t):
            raw[g] += 1
            target[g] += i != 2
    for i, t, _, _ in rows:
        want = sum(math.log(target[g] / sum(target)) - math.log(raw[g] / sum(raw)) for g in grams(t)) / len(grams(t))
        assert out[i].score == pytest.approx(want, abs=1e-4)


def test_classes_by_brute_force(spark, odd):
    got = {r.doc_id: r.component_id for r in similarity_classes(odd, words=3, percent=90).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, None: None, 6: 6, 7: 6, 8: 8, 9: 9}


def test_many_near_copies_are_one_class(spark):
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base[: i % 300] + [f"x{i}"] + base[i % 300 + 1 :]), "en", "a") for i in range(3000)]
    out = similarity_classes(docs(spark, rows), words=5, percent=80)
    assert out.select("component_id").distinct().count() == 1


def test_tree_join_of_large_blocks_by_brute_force():
    rng = np.random.default_rng(3)
    block = np.repeat([0, 1, 2], [4500, 40, 9000])
    n = rng.integers(1, 60, len(block))
    vec = np.zeros((len(block), GROUPS), np.uint16)
    np.add.at(vec, (np.repeat(np.arange(len(n)), n), rng.integers(0, 12, n.sum())), 1)
    side = np.where(block == 2, rng.integers(0, 3, len(block)), 2)
    got = [(min(p), max(p)) for x, y, _ in tree_join(block, n, vec, side, 90) for p in zip(x.tolist(), y.tolist())]
    want = set()
    for i in range(len(block)):
        j = np.arange(i + 1, np.searchsorted(block, block[i], side="right"))
        j = j[(side[j] != side[i]) | (side[j] == 2)]
        j = j[(100 * n[j] >= 90 * n[i]) & (100 * n[i] >= 90 * n[j])]
        overlap = np.minimum(vec[i, :12], vec[j, :12]).sum(axis=1, dtype=np.int64)
        want |= {(i, k) for k in j[overlap >= needed_overlap(n[i] + n[j], 90)].tolist()}
    assert len(got) == len(set(got)) and set(got) == want


def components(nodes, links):
    parent = {i: i for i in nodes}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in parent}


def shingles(text, width):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def alike(a, b, percent):
    return bool(a and b) and 100 * len(a & b) >= percent * len(a | b)


def test_texts_of_one_id_link_what_each_links(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a, "en", "a"), (1, b, "en", "a"), (2, a + " x", "en", "a"), (3, b + " y", "en", "a"), (0, "z " + b, "en", "a"), (9, "alone", "en", "a"), (9, a + " q", "en", "a"), (8, "alone", "en", "a"), (7, "other", "en", "a")]
    sets = [(i, shingles(t, 5)) for i, t, *_ in rows]
    want = components([i for i, _ in sets], [(i, j) for i, x in sets for j, y in sets if alike(x, y, 80)])
    got = {r.doc_id: r.component_id for r in similarity_classes(docs(spark, rows)).collect()}
    assert got == want == {**dict.fromkeys((0, 1, 2, 3, 8, 9), 0), 7: 7}


@pytest.mark.parametrize("many", [5000, 10000])
def test_links_inside_large_blocks_of_frequent_shingles(spark, many):
    """All words are frequent, so every link lies in blocks of more points than a tree or a tile holds."""
    rng = np.random.default_rng(many)
    member = np.zeros((many, 150), np.int64)
    for i in range(many):
        member[i, rng.choice(150, 10, replace=False)] = 1
        if i % 100 == 99:
            member[i] = member[rng.integers(0, i)]
            member[i, rng.choice(np.flatnonzero(member[i] == 0))] = 1
    rows = [(i, " ".join(f"w{k}" for k in np.flatnonzero(m)), "en", "a") for i, m in enumerate(member)]
    size = member.sum(axis=1)
    links = []
    for i in range(many):
        both = member[i + 1 :] @ member[i]
        links += [(i, i + 1 + int(j)) for j in np.flatnonzero(100 * both >= 90 * (size[i] + size[i + 1 :] - both))]
    got = {r.doc_id: r.component_id for r in similarity_classes(docs(spark, rows), words=1, percent=90).collect()}
    assert len(links) >= many // 100 and got == components(range(many), links)


def test_tiles_let_every_two_components_meet_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TREE_POINTS", 8)
    rng = np.random.default_rng(2)
    comps = {0: [1] * 50 + [int(c) for c in rng.integers(2, 30, 60)], 1: [1] * 5 + [2], 2: [1] * 70 + [2], 3: list(range(40))}
    rows = []
    for key, held in comps.items():
        most = max(set(held), key=held.count)
        rows += [(key, 1000 * key + i, c, len(held), held.count(most), c == most) for i, c in enumerate(held)]
    table = spark.createDataFrame(rows, "key long, node long, comp int, total long, most long, main boolean").select("key", "node", "comp", F.explode(jaccard_join._tiles()).alias("t")).collect()
    tiles = {}
    for r in table:
        tiles.setdefault((r.key, r.t.tile), []).append(r)
    met = [(a.node, b.node) for held in tiles.values() for a in held for b in held if a.node < b.node and a.comp != b.comp and (a.t.side != b.t.side or a.t.side == 2)]
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] != b[2]}
    assert len(met) == len(set(met)) and set(met) == want


@pytest.mark.parametrize(("words", "percent", "points"), [(1, 60, 16), (3, 90, 2048), (5, 80, 16)])
def test_families_of_near_copies_by_brute_force(spark, monkeypatch, words, percent, points):
    monkeypatch.setattr(jaccard_join, "TREE_POINTS", points)
    rng = np.random.default_rng(words)
    rows = []
    for i in range(600):
        base = [f"b{i % 3}-{k}" for k in range(30 + 40 * (i % 3))]
        for _ in range(rng.integers(0, 6)):
            base[rng.integers(0, len(base))] = f"e{rng.integers(0, 40)}"
        rows.append((i, " ".join(base), "en", "a"))
    sets = [shingles(t, words) for _, t, *_ in rows]
    want = components(range(600), [(i, j) for i in range(600) for j in range(i) if alike(sets[i], sets[j], percent)])
    assert {r.doc_id: r.component_id for r in similarity_classes(docs(spark, rows), words=words, percent=percent).collect()} == want


def test_unrelated_texts_of_one_id_are_kept(spark):
    other = " ".join(f"o{i}" for i in range(40))
    third = " ".join(f"t{i}" for i in range(40))
    rows = docs(spark, [(1, PROSE, "en", "a"), (1, PROSE, "en", "a"), (1, other, "en", "a"), (1, other + " x", "en", "a"), (2, PROSE, "en", "a"), (2, third, "en", "a"), (3, third + " y", "en", "a"), (None, PROSE, "en", "a")])
    out = [(r.doc_id, r.text) for r in keep_one_per_class(rows).collect()]
    assert len(out) == 4 and {(1, PROSE), (2, third), (None, PROSE)} < set(out)
    assert len({(1, other), (1, other + " x")} & set(out)) == 1


@pytest.mark.parametrize("name", ["op3_mixing", "op6_decontamination", "op7_warc", "op9_jaccard_join"])
def test_query_matches_sql(spark, name):
    assert compare(spark, SF, name) is None


def test_only_rows_that_hold_an_item_go(spark):
    item = " ".join(f"q{i}" for i in range(14))
    clean = [(None, "nothing of it here at all", "en", "a"), (None, None, None, None), (1, "a clean text of some words", "en", "a"), (2, "", "en", "a")]
    rows = docs(spark, [*clean, (None, "x " + item, "en", "a"), (1, item + " y", "en", "a"), (1, item + " y", "en", "a"), (3, item, "en", "a")])
    out = drop_contaminated(rows, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.doc_id) == [(1, clean[2][1]), (2, "")]
    assert {r.text for r in out.collect() if not r.doc_id} == {clean[0][1], None} and out.count() == 4


def test_mix_emits_what_is_planned(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    plan = {r.doc_id: r.copies for r in plan_mix(rows).collect()}
    emitted = {r.doc_id: r["count"] for r in mix_sources(rows).groupBy("doc_id").count().collect()}
    assert emitted == {k: v for k, v in plan.items() if v}


def test_shards(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    out = assign_shards(rows, 7).toPandas()
    assert sorted(out.doc_id) == sorted(r.doc_id for r in rows.collect())
    text = {r.doc_id: r.text.encode() for r in rows.collect()}
    assert all(zlib.crc32(text[i]) == c and len(text[i]) + 16 == s for i, c, s in zip(out.doc_id, out.text_crc32, out["size"]))
    total = out.groupby("shard")["size"].sum()
    assert abs(total - total.mean()).max() <= out["size"].max()
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    write_shards(rows, str(tmp_path / "out"), 7)
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.count()


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/x", "same"), (5, "http://a/y%20\n", "same"), (3, None, "same"), (4, "u", None), (None, "u", "same"), (9, "u", "")], "page_id long, url string, html string")
    rows = {r.page_id: r for r in read_archives(write_archives(pages, f"file://{tmp_path}/w")).collect()}
    assert {k: (r.record_type, r.refers_to, r.payload_bytes) for k, r in rows.items()} == {1: ("revisit", 5, 4), 5: ("response", None, 4), 3: ("revisit", 5, 4), 4: ("revisit", 9, 0), None: ("revisit", 5, 4), 9: ("response", None, 0)}
    assert rows[5].url == "http://a/y%20\n" and bytes(rows[5].payload) == b"same"
    record = encode_record(1, "u", b"payload", None, "2024-01-01T00:00:00Z")
    for bad in (record[:-1], record.replace(b"payload", b"pay1oad"), record.replace(b"WARC/1.1", b"WARC/9"), record.replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(ValueError):
            decode_record(bad, "here")


def test_url_rules(spark):
    urls = ["http://EXAMPLE.com/en/x?a", "https://www.example.com/en/1", "http://b.net/es/", "http://net/fr/2", "http://xnet/es/", None, "nothing", "http://a.org/fr/9", "http://a.com"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = {r.page_id: r for r in judge_urls(pages).collect()}
    assert [out[i].rule for i in range(9)] == ["example.com/en/", "www.example.com/en/", "net/es/", "net/fr/", None, None, None, None, None]
    assert [out[i].verdict for i in range(4)] == ["block", "allow", "block", "block"]
    assert (out[0].host, out[0].path, out[5].host, out[6].path) == ("example.com", "/en/x", "", "")


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    labels = con.execute(f"select doc_id, quality, toxic, lang from '{sf}/documents.parquet' left join '{sf}/labels.parquet' using (doc_id)").df()
    q = queries.op1_quality_classifier(spark, sf).toPandas().merge(labels, on="doc_id")
    q = q[q.held_out & q.quality.notna()]
    assert (q.predicted == q.quality).mean() >= 0.95
    t = queries.op4_toxicity(spark, sf).toPandas().merge(labels, on="doc_id")
    t = t[t.held_out & t.toxic.notna()]
    assert (t.predicted == t.toxic).mean() >= 0.95
    x = queries.op10_language_id(spark, sf).toPandas().merge(labels, on="doc_id")
    x = x[x.held_out & (x.lang_pred != "und")]
    assert (x.lang_pred == x.lang).mean() >= 0.95


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "shard", "slot"} <= set(out.columns)
