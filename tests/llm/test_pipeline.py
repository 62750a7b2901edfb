"""The whole pipeline against plain Python, and on odd tables."""

import math
import random
import re
import zlib

import pytest
import xxhash

import corpus_pipeline
from loomframe.llm.mixing import WEIGHTS, offset
from loomframe.llm.quality_rules import BUCKETS, THRESHOLD

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def text_hash(t):
    return signed(xxhash.xxh64_intdigest((t or "").encode(), 42))


def shingles(w, k):
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def rules(rows):
    def grams(w):
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
        return [signed(x) % BUCKETS for x in h] + [signed(xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42))) % BUCKETS for a, b in zip(h, h[1:])]

    judged = []
    for i, t, s in rows:
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        at = {}
        for k in range(len(w) - 4):
            at.setdefault(tuple(w[k : k + 5]), []).append(k)
        again = len({k + j for p in at.values() if len(p) > 1 for k in p for j in range(5)})
        failed = len(w) < 10 or 100 * again > 20 * len(w)
        clean = not failed and not again and len(set(lines)) == len(lines) and not set(t or "") & set("#*$%&|<>")
        judged.append((i, t, s, grams(w), failed, clean))
    raw, target = [0.5] * BUCKETS, [0.5] * BUCKETS
    for *_, g, _, clean in judged:
        for x in g:
            raw[x] += 1
            target[x] += clean
    shift = math.log(sum(raw)) - math.log(sum(target))
    ratio = [float(f"{math.log(b) - math.log(a) + shift:.6f}") for a, b in zip(raw, target)]
    return [(i, t, s) for i, t, s, g, failed, _ in judged if not failed and sum(ratio[x] for x in g) / len(g) >= THRESHOLD]


def one_of_each(rows):
    sets = [shingles(words(re.sub("[A-Z]", lambda m: m[0].lower(), t)), 5) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for k in range(len(rows)):
        least[root(k)] = min(least.get(root(k), k), k, key=lambda j: rows[j][0])
    return [rows[k] for k in sorted(least.values())]


def clean(rows, items):
    kept = []
    for row in rows:
        w = [x.lower() for x in words(row[1])]
        found = False
        for item in items:
            x = [y.lower() for y in words(item)]
            k = min(5, len(x))
            of = shingles(x, k)
            found |= bool(of) and 100 * len(of & {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}) >= 80 * len(of)
        if not found:
            kept.append(row)
    return kept


def mixed(rows, seed=7):
    size = {s: 0 for _, _, s in rows}
    for _, t, s in rows:
        size[s] += len(words(t))
    ordered = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[k % 3] for k, s in enumerate(ordered)}
    target, left, open_ = {}, 1.5 * sum(size.values()), list(ordered)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 2 * size[s]]
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2 * size[s]
            left -= 2 * size[s]
            open_.remove(s)
    out, u = [], offset(seed)
    for s in ordered:
        rate = target[s] / size[s] if size[s] else 0
        for n, row in enumerate(sorted((r for r in rows if r[2] == s), key=lambda r: (len(words(r[1])), r[0])), 1):
            out += [row] * (math.floor(n * rate + u) - math.floor((n - 1) * rate + u))
    return out


def sharded(rows):
    size = lambda t: len(t.encode()) + 16
    total, before, out, count = sum(size(t) for _, t, _ in rows), 0, [], {}
    for i, t, _ in sorted(rows, key=lambda r: (text_hash(r[1]), r[0])):
        shard = min(39, (2 * before + size(t)) * 40 // (2 * total))
        count[shard] = count.get(shard, -1) + 1
        out.append((i, size(t), zlib.crc32(t.encode()), shard, count[shard]))
        before += size(t)
    return out


@pytest.fixture
def folder(spark, tmp_path):
    def make(rows, items):
        spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCUMENTS).write.parquet(f"file://{tmp_path}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
        return f"file://{tmp_path}"

    return make


def by_plain_python(rows, items):
    return sharded(mixed(clean(one_of_each(rules(rows)), items)))


def test_pipeline_by_brute_force(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    out = corpus_pipeline.run(spark, SF)
    got = [(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in out.collect()]
    assert sorted(got) == sorted(by_plain_python(rows, items)) and len(got) > 100


def test_pipeline_with_families_and_planted_items(spark, folder):
    """Documents in families of near copies, benchmark items of 3 to 20 words planted, junk, long and short texts."""
    rnd = random.Random(12)
    base = [[f"b{f}w{rnd.randrange(300)}" for _ in range(60 + 40 * f)] for f in range(8)]
    items = [(k, " ".join(f"q{k}x{j}" for j in range(n))) for k, n in enumerate((3, 5, 9, 14, 20))]
    rows = []
    for i in range(160):
        w = list(rnd.choice(base)) if i % 3 else [f"u{rnd.randrange(2000)}" for _ in range(rnd.randrange(5, 200))]
        for _ in range(rnd.randrange(6)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(50)}"
        if i % 11 == 0:
            w += rnd.choice(items)[1].split() + ["end"]
        if i % 13 == 0:
            w = ["buy", "now", "$$$"] * 20
        rows.append((1000 - i, " ".join(w), ("a", "b", "c", None)[i % 4]))
    rows += [(1, None, "a"), (2, "", "b"), (3, "word " * 3, None)]
    out = corpus_pipeline.run(spark, folder(rows, items))
    got = [(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in out.collect()]
    assert sorted(got) == sorted(by_plain_python(rows, [t for _, t in items]))


def test_pipeline_of_empty_tables(spark, folder):
    assert corpus_pipeline.run(spark, folder([], [])).count() == 0


def test_stages_keep_columns_nulls_and_clashing_names(spark):
    """Stages give the columns of documents back, whatever else a table holds under names they use themselves."""
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(1, long, "en", "a", 1, 1, 2, 3), (None, long + " x y z", None, None, None, 1, 2, 3), (1, long, "en", "a", 1, 1, 2, 3), (2, None, "en", "a", 1, 1, 2, 3)]
    docs = spark.createDataFrame(rows, DOCUMENTS + ", rank int, node int, shard int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.count() <= 6
    assert corpus_pipeline.sharding(spark, docs, SF).count() == 4
