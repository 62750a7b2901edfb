"""Archives, shards and decontamination in their edge cases, against plain Python."""

import io
import random
import re
import zlib

import pytest
import xxhash

from loomframe.llm import warc
from loomframe.llm.decontamination import drop_contaminated, find_contaminated
from loomframe.llm.sharding import assign_shards, write_shards
from loomframe.llm.warc import digest_of, read_archives, read_frames, write_archives

SCHEMA = "doc_id long, text string, shard int, slot string, size string"
PAGES = "page_id long, url string, html string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA)


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w]


def held(doc, item, percent=80):
    """(shared, of) shingles if the document holds enough of the item's."""
    w, x = words(doc), words(item)
    if not x:
        return None
    k = min(5, len(x))
    of = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}
    n = len(of & {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    return (n, len(of)) if 100 * n >= percent * len(of) else None


def test_items_of_every_length_are_found(spark):
    """Planted whole, one document each, of 1 to 20 words in texts of 2,000."""
    rnd = random.Random(5)
    items, rows = [], []
    for n in range(1, 21):
        for _ in range(15):
            item = " ".join(f"i{len(items)}x{k}" for k in range(n))
            text = [f"w{rnd.randrange(5000)}" for _ in range(2000)]
            at = rnd.randrange(2000)
            text[at:at] = item.upper().split()
            rows.append((len(items), " ".join(text)))
            items.append((len(items), item))
    out = find_contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in out.collect()} == {(i, i) for i, _ in items}


def test_contamination_by_brute_force(spark):
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=k))) for i, k in enumerate([1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 14, 20])] + [(50, None), (51, ""), (52, " \n"), (None, "w1 w2 w3"), (53, "w1 w1 w1 w1 w1 w1 w1"), (54, "W2")]
    rows = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([0, 1, 3, 4, 5, 30, 300])))) for i in range(60)]
    for i in range(60, 90):
        item = rnd.choice([t for _, t in items if t]).split()
        if len(item) > 10 and i % 2:
            item[-1] = "changed"
        rows.append((i, " ".join(rnd.choices(vocabulary, k=20) + item + rnd.choices(vocabulary, k=20))))
    rows += [(None, "a w1 w2 w3"), (91, None), (92, ""), (92, rows[3][1])]
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    want = set()
    for i, all_ in texts.items():
        for k, item in items:
            if words(item):
                size = min(5, len(words(item)))
                of = {tuple(words(item)[j : j + size]) for j in range(len(words(item)) - size + 1)}
                n = len(of & {tuple(words(t)[j : j + size]) for t in all_ for j in range(len(words(t)) - size + 1)})
                if 100 * n >= 80 * len(of):
                    want.add((i, k, n, len(of)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in find_contaminated(docs(spark, rows), bench).collect()} == want
    clean = drop_contaminated(docs(spark, rows), bench)
    assert sorted(map(str, (r.text for r in clean.collect()))) == sorted(str(t) for _, t in rows if not any(held(t, x) for _, x in items))


def test_decontamination_without_broadcasts(spark, monkeypatch):
    from loomframe.llm import decontamination

    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    bench = spark.createDataFrame([(1, "one two three"), (2, " ".join(f"q{i}" for i in range(14)))], "item_id long, text string")
    rows = docs(spark, [(1, "x one two three y"), (2, "x " + " ".join(f"q{i}" for i in range(14))), (3, "one two")])
    assert {(r.doc_id, r.item_id) for r in find_contaminated(rows, bench).collect()} == {(1, 1), (2, 2)}


def test_shards_by_brute_force(spark, tmp_path):
    rnd = random.Random(7)
    rows = [(rnd.choice([None, *range(30)]), rnd.choice([None, "", "a", "é", "x" * rnd.randrange(400), "long " * 300])) for _ in range(120)]
    rows.append((7, "z" * 20000))
    signed = lambda t: (h := xxhash.xxh64_intdigest((t or "").encode(), 42)) - (2**64 if h >= 2**63 else 0)
    size = lambda t: len((t or "").encode()) + 16
    ordered = sorted(rows, key=lambda r: (signed(r[1]), r[0] is not None, r[0] or 0))
    total, before, want, count = sum(size(t) for _, t in rows), 0, [], {}
    for i, t in ordered:
        shard = min(4, (2 * before + size(t)) * 5 // (2 * total))
        count[shard] = count.get(shard, -1) + 1
        want.append((i, size(t), zlib.crc32((t or "").encode()), shard, count[shard]))
        before += size(t)
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    out = assign_shards(docs(spark, rows), 5)
    assert sorted(((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in out.collect()), key=key) == sorted(want, key=key)
    write_shards(docs(spark, rows), str(tmp_path / "shards"), 5)
    back = spark.read.parquet(str(tmp_path / "shards")).collect()
    assert sorted(str((r.doc_id, r.text or "")) for r in back) == sorted(str((i, t or "")) for i, t in rows)
    assert sorted((r.shard, r.slot) for r in back) == sorted((w[3], w[4]) for w in want)


def test_archives_roll_over_and_hold_large_payloads(spark, tmp_path):
    """Small limits: many archives a task, frames longer than a read; repeated largest ids and clashing columns."""
    rnd = random.Random(9)
    rows = [(i, f"http://a/{i}", "".join(rnd.choices("abcdefghij<>é", k=rnd.choice([0, 3, 900, 20000])))) for i in range(60)]
    rows += [(70, "u", "same"), (70, "v", "same"), (3, "w", "same"), (None, None, "same"), (71, "x", None), (72, "y", "big" * 400_000)]
    pages = spark.createDataFrame([(*r, "1", 2) for r in rows], PAGES + ", payload string, records int").repartition(2)
    manifest = write_archives(pages, f"file://{tmp_path}/w", archive_bytes=40_000)
    names = [r.path for r in manifest.collect()]
    assert len(names) > 10 and len(set(names)) == len(names)
    got = read_archives(manifest).collect()
    kept = {}
    for i, _, html in rows:
        kept[html or ""] = max(kept.get(html or "", -1), -1 if i is None else i)
    want = [(i, digest_of((h or "").encode()), len((h or "").encode()), kept[h or ""] if (-1 if i is None else i) < kept[h or ""] else None) for i, _, h in rows]
    assert sorted(map(str, ((r.page_id, r.payload_digest, r.payload_bytes, r.refers_to) for r in got))) == sorted(map(str, want))
    assert all(r.payload.decode() in kept for r in got if r.record_type == "response")


def test_damaged_archives_are_named(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(30)], PAGES).coalesce(1)
    (path,) = [r.path for r in write_archives(pages, f"file://{tmp_path}/w").collect()]
    whole = open(path.removeprefix("file://"), "rb").read()
    assert len(list(read_frames(io.BytesIO(whole), "here"))) == 30
    size = int.from_bytes(whole[4:8], "little")
    for cut, said in ((len(whole) - 3, "cut short"), (8 + size // 2, "dictionary")):
        with pytest.raises(ValueError, match=said):
            list(read_frames(io.BytesIO(whole[:cut]), "here"))
    with pytest.raises(Exception):  # noqa: B017  frames need the dictionary they were packed with
        list(read_frames(io.BytesIO(whole[8 + size :]), "here"))


def test_archives_without_a_dictionary(spark, tmp_path):
    pages = spark.createDataFrame([(1, None, None), (2, None, "")], PAGES)
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in read_archives(write_archives(pages, f"file://{tmp_path}/w")).collect()}
    assert got == {1: ("revisit", 2, 0), 2: ("response", None, 0)}


def test_another_attempt_does_not_replace_archives(tmp_path):
    """Two attempts of one task write under names of their own; the manifest of either stays true."""
    made = []
    for attempt, records in ((4, [b"a", b"b"]), (5, [b"b", b"a", b"c"])):
        archives = warc._Archives(f"file://{tmp_path}/w", b"")
        archives.attempt = attempt
        done = [archives.add(r) for r in records]
        made.append((archives.close(), records))
        assert done == [None] * len(records)
    for (path, n, _), records in made:
        with open(path.removeprefix("file://"), "rb") as f:
            assert [r for _, r in read_frames(f, path)] == records and n == len(records)
