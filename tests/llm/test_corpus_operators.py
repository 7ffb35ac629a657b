"""Mixture, n-gram join, suffixes, decontamination, WARC: brute force, round trips, odd rows."""

import gzip
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import SCHEMA, SPACED, awkward, corpus, frame, hits, jaccard_classes, prose, without_repeats, EN
from paneloom.llm import components, decontaminate, mixture, ngram_join, suffixes, warc
from paneloom.session import materialise, work_path


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Reshare by weight, round after round."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def test_mixture_targets_and_takings(spark):
    draw = random.Random(3)
    rows = [(i, prose(draw, EN, draw.randint(0, 400)), "en", draw.choice(["big"] * 6 + ["é", "mid", "tiny", None]), 1) for i in range(900)]
    rows += [(2000, None, "en", "void", 1), (2001, "", None, None, 1), (5, rows[5][1], "en", rows[5][3], 1)]
    out = mixture.mix(frame(spark, rows), shard_words=4000, fan=4).collect()
    assert sorted(r.doc_id for r in out) == sorted(r[0] for r in rows)
    sizes, taken = Counter(), Counter()
    for r in out:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    texts = {r[0]: r[1] for r in rows}
    assert all(r.size == len(SPACED.findall(texts[r.doc_id] or "")) and r.source_size == sizes[r.source] for r in out)
    want = plain_targets(dict(sizes))
    for r in out:
        assert abs(r.target - want[r.source]) < 1e-6
    for source, target in want.items():
        assert abs(taken[source] - target) <= max(130, 0.02 * target), source
    again = mixture.mix(frame(spark, rows, 7), shard_words=4000, fan=4).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, again)) == sorted(map(key, out))
    assert mixture.mix(frame(spark, []).where("false")).count() == 0
    assert mixture.mix(frame(spark, [(1, None, None, None, None)])).first().taken == 0
    assert mixture.mix(awkward(spark)).count() == frame(spark).count()


def test_sainte_lague_gives_the_highest_quotients(spark):
    draw = random.Random(4)
    for seats in (0, 1, 7, 50):
        votes = [(g, u, draw.choice([0, 3, 10, 10, 95])) for g in "ab" for u in range(9)]
        df = spark.createDataFrame([(*v, seats) for v in votes], "g string, u int, votes long, seats int")
        got = {(r.g, r.u): r.won for r in mixture.sainte_lague(df, ["g"], "votes", "seats", "u", "won").collect()}
        for g in "ab":
            order = sorted((-v / (2 * k + 1), u) for x, u, v in votes if x == g for k in range(seats) if v)[:seats]
            assert {u: got[g, u] for u in range(9)} == {u: sum(u == o[1] for o in order) for u in range(9)}


def test_components(spark):
    draw = random.Random(1)
    pairs = [(draw.randrange(60), draw.randrange(60)) for _ in range(30)] + [(i, i + 1) for i in range(100, 160)]
    parent = {x: x for p in pairs for x in p}
    for _ in range(200):
        for a, b in pairs:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: r for x, r in parent.items() if any(x in p and p[0] != p[1] for p in pairs)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.999), (0.5, 0.95), (0.9, 0.9999)):
        bands, rows = ngram_join.bands_for(threshold, recall)
        assert bands * rows <= 128 and 1 - (1 - threshold ** rows) ** bands >= recall
    with pytest.raises(ValueError):
        ngram_join.bands_for(0.1, 0.999999, 8)


@pytest.mark.parametrize("block_grams", [1 << 19, 400])
def test_join_finds_every_link(spark, block_grams):
    draw = random.Random(block_grams)
    base = prose(draw, EN, 150).split(" ")
    family = []
    for i in range(25):  # a group of near copies of each other, some only through others
        words = list(base)
        for _ in range(draw.randint(0, 5)):
            words[draw.randrange(len(words))] = f"w{draw.randrange(99)}"
        family.append((500 + i, " ".join(words), "en", "hot", 1))
    rows = corpus() + family
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in
                 ngram_join.near_duplicates(frame(spark, rows), block_grams=block_grams).collect())
    assert got == sorted(jaccard_classes(rows))


def test_blocks_are_bounded_in_sets(spark, monkeypatch):
    held = {}

    def kept(df, label="step"):
        held[label] = materialise(df, label)
        return held[label]

    monkeypatch.setattr(ngram_join, "materialise", kept)
    n = 4500  # few n-grams, many sets: one template whose last word differs
    stem = " ".join(f"t{i}" for i in range(22))
    rows = [(i, f"{stem} x{i}", "en", "s", 1) for i in range(n)]
    out = ngram_join.near_duplicates(frame(spark, rows, 8)).collect()
    assert {(r.class_id, r.n_links) for r in out} == {(0, n - 1)} and len(out) == n
    sizes = [r["count"] for r in held["members"].groupBy("grp", "block").count().collect()]
    assert sum(sizes) == n and len(sizes) == 3 and max(sizes) < 2048


def test_join_with_small_blocks_of_sets(spark):
    rows = corpus()
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.near_duplicates(frame(spark, rows), block_sets=2).collect())
    assert got == sorted(jaccard_classes(rows))


def test_join_of_odd_tables(spark):
    assert ngram_join.near_duplicates(frame(spark).where("false")).count() == 0
    out = ngram_join.near_duplicates(awkward(spark))
    assert out.count() == frame(spark).count()
    same = frame(spark, [(i, "the same few words stand here", None, None, None) for i in range(40)])
    assert {(r.class_id, r.n_links, r.copy_of) for r in ngram_join.near_duplicates(same).collect()} == {(0, 39, 0)}


def test_anchors_are_shared_by_equal_strings():
    draw, anchors = random.Random(2), suffixes.Anchors(40, 12)
    passage = bytes(draw.randrange(97, 123) for _ in range(40))
    inside = []
    for left in range(0, 90, 7):
        raw = bytes(draw.randrange(97, 123) for _ in range(left)) + passage + bytes(draw.randrange(97, 123) for _ in range(50))
        places, _ = anchors.find(raw)
        inside.append({int(p) - left for p in places if 0 <= p - left <= 28})
    common = set.intersection(*inside)
    assert common
    for raw in (raw, b"ab" * 300, b"x" * 90 + passage * 3, b"the " * 40 + passage):
        places, _, first, last = anchors.owners(raw)
        starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
        assert starts.tolist() == list(range(len(raw) - 39))  # every string has one anchor, inside it
        assert all(a <= b <= p <= a + 28 for p, a, b in zip(places, first, last) if b <= p) and (last <= places).all()
    long = bytes(draw.randrange(97, 100) for _ in range(2_300_000))
    whole, _ = anchors.find(long)
    assert (np.diff(whole) <= 29).all() and len(whole) > 100_000


def test_loser_tree_merges_and_knows_prefixes():
    draw = random.Random(7)
    for n_runs in (1, 2, 3, 8, 13):
        runs, everything = [], []
        for run in range(n_runs):
            keys = sorted(bytes(draw.choice(b"ab") for _ in range(draw.randint(0, 12))) for _ in range(draw.randint(0, 30)))
            runs.append(suffixes._Run(*suffixes.front_coded(keys), [(run, i) for i in range(len(keys))]))
            everything += keys
        out = list(suffixes.merge(runs))
        assert [k for k, *_ in out] == sorted(everything)
        for (a, *_), (b, common, _) in zip(out, out[1:]):
            assert common == suffixes.shared_prefix(a, b)


def test_pairs_and_offsets_find_the_same_bytes():
    draw = random.Random(17)
    for _ in range(60):
        length, seed = 30, b"seedseed"
        group = []
        for i in range(draw.randint(1, 12)):
            right = (seed + bytes(draw.choice(b"ab") if draw.random() < 0.1 else 97 for _ in range(22)))[:draw.choice([30, 30, 25])]
            left = bytes(draw.choice(b"ab") if draw.random() < 0.1 else 97 for _ in range(draw.choice([22, 22, 9])))
            group.append((right + left, (f"d{i}", len(right), [1000 * k + 500 for k in range(draw.choice([1, 1, 2]))])))
        group.sort(key=lambda g: g[0])
        keys = [b""] + [g[0] for g in group]
        entries = [(key, suffixes.shared_prefix(before, key), ref) for before, (key, ref) in zip(keys, group)]
        bytes_of = lambda upto: {(n, b) for n, s, e in suffixes._group_spans(entries, length, upto) for b in range(s, e)}
        assert bytes_of(0) == bytes_of(99)


@pytest.mark.parametrize("hot", [200_000, 1])
def test_repeats_go_and_nothing_else(spark, hot):
    draw = random.Random(hot)
    passages = ["".join(draw.choice("abé ") for _ in range(draw.randint(20, 90))) for _ in range(6)]
    texts = ["".join(draw.choice(passages) if draw.random() < 0.5 else "".join(draw.choice("abcdefgh") for _ in range(draw.randint(0, 60)))
                     for _ in range(draw.randint(0, 5))) for _ in range(60)]
    texts += ["a" * 500, "ab" * 200, None, "", texts[3], texts[3], passages[0][:40]]
    df = frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)], 3)
    out = suffixes.remove_repeats(df, length=40, seed=12, hot=hot, part_entries=50, run_bytes=3000, text=True).collect()
    want = without_repeats(texts, 40)
    assert {r.doc_id: tuple(r)[1:5] for r in out} == dict(enumerate(want))
    for r in out:
        if r.left is not None:
            assert hashlib.sha256(r.left).hexdigest() == r.kept_sha256


def test_repeats_of_odd_tables(spark):
    assert suffixes.remove_repeats(frame(spark).where("false")).count() == 0
    rows = corpus()
    out = {r.doc_id: tuple(r)[1:5] for r in suffixes.remove_repeats(awkward(spark)).collect()}
    want = dict(zip([r[0] for r in rows], without_repeats([r[1] for r in rows], 400)))
    assert out == want


ITEMS = [(1, prose(random.Random(21), EN, 40)), (2, prose(random.Random(22), EN, 13)), (10, "short item words"), (11, None), (12, "!!"), (13, "")]


def contaminated_texts():
    draw = random.Random(23)
    words = ITEMS[0][1].split()
    texts = [prose(draw, EN, 60) + ". " + " ".join(words[i:i + n]).upper() + ", " + prose(draw, EN, 30) for i, n in ((0, 40), (3, 13), (5, 12), (27, 13))]
    return texts + [ITEMS[1][1] * 2, "a short, ITEM words here", None, "", "x", ITEMS[1][1] + " " + " ".join(["and"] * 400)] + [texts[0]] * 3


@pytest.mark.parametrize("part_chars,shard_words", [(1 << 24, 1 << 20), (60, 50)])
def test_passages_are_found_where_they_are(spark, part_chars, shard_words):
    texts = contaminated_texts()
    docs = frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)], 2)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.judged(decontaminate.find_passages(
        docs, bench, clean="clean", part_chars=part_chars, shard_words=shard_words))
    rows = {r.doc_id: r for r in found.collect()}
    for i, (n, hit, items) in enumerate(hits(texts, ITEMS)):
        ids = ",".join(sorted(map(str, items)))
        assert (rows[i].n_words, rows[i].n_hit, rows[i].n_items) == (n, hit, len(items))
        assert rows[i].items_sha256 == hashlib.sha256(ids.encode()).hexdigest()
        assert rows[i].contaminated == (hit > 0 and 20 * hit >= n)
        if not hit:
            assert rows[i].clean == texts[i]
    assert decontaminate.find_passages(docs, bench.where("false")).where("size(bench_spans) > 0").count() == 0
    assert decontaminate.find_passages(docs.where("false"), bench).count() == 0
    assert decontaminate.find_passages(awkward(spark), bench, words="n_words", spans="spans").count() == frame(spark).count()


@pytest.mark.parametrize("part_chars", [1 << 24, 60])
def test_passages_of_items_without_id_are_hits(spark, part_chars):
    items = [(None, ITEMS[0][1]), (None, "other short words"), (2, ITEMS[1][1]), (5, ITEMS[1][1]), (None, ITEMS[1][1])]
    texts = contaminated_texts() + ["some other short words"]
    docs = frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)], 2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.judged(decontaminate.find_passages(docs, bench, part_chars=part_chars))
    rows = {r.doc_id: r for r in found.collect()}
    for i, (n, hit, ids) in enumerate(hits(texts, items)):
        ids = sorted(str(x) for x in ids - {None})
        assert (rows[i].n_words, rows[i].n_hit, rows[i].n_items) == (n, hit, len(ids))
        assert rows[i].items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
        assert rows[i].contaminated == (hit > 0 and 20 * hit >= n)
    assert rows[0].contaminated and rows[0].n_items == 0


def test_index_counts_and_locates_like_a_scan():
    draw = np.random.default_rng(3)
    for n in (1, 2, 50, 400):
        symbols = draw.integers(0, 4, n)
        symbols[-1] = 0
        index = decontaminate.FMIndex(symbols, every=5)
        for length in (1, 2, 4):
            patterns = draw.integers(1, 5, (30, length))
            which, low, high = index.search(patterns)
            got = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, low, high)}
            for i, p in enumerate(patterns):
                places = [k for k in range(n - length + 1) if (symbols[k:k + length] == p).all()]
                assert got.get(i, []) == places


def archive_pages():
    draw = random.Random(31)
    big = "<p>" + prose(draw, EN, 400) + "</p>"
    rows = [(i, f"http://h/{i}", "<p>" + prose(draw, EN, draw.randint(1, 400)) + "</p>") for i in range(60)]
    rows += [(100 + i, "http://copy\r\nX: 1", big) for i in range(30)] + [(200 + i, None, "small") for i in range(4)]
    return rows + [(300, "u", None), (301, "u", ""), (None, "u", big), (400, "u", big), (400, "u", big), (7, "v", "é\r\n\r\n")]


def test_archive_round_trip(spark):
    rows = archive_pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folders = [work_path(spark, "warc"), work_path(spark, "warc")]
    manifests = [warc.write_archive(df.repartition(n), f, shard_bytes=20_000, roll_bytes=6_000).orderBy("name").collect()
                 for n, f in zip((3, 5), folders)]
    same = [[(m.name, m.records, m.bytes, m.sha1) for m in x] for x in manifests]
    assert same[0] == same[1] and len(same[0]) > 3 and all(m.bytes <= 6_000 or m.records == 1 for m in manifests[0])
    out = warc.read_archive(spark, folders[0], payload=True).collect()
    assert len(out) == len(rows)
    payloads = Counter((p, (h or "").encode()) for p, _, h in rows)
    top = {}
    for p, _, h in rows:
        if len((h or "").encode()) >= 1000:
            top[h] = max(top.get(h, -1), -1 if p is None else p)
    shared = {h for h in top if sum(r[2] == h for r in rows) > 1}
    texts = {hashlib.sha1((h or "").encode()).hexdigest(): (h or "") for *_, h in rows}
    for r in out:
        text = texts[r.payload_digest]
        assert r.payload_bytes == len(text.encode()) and (r.page_id, text.encode()) in payloads
        if r.record_type == "response":
            assert r.payload == text.encode() and r.refers_to is None and (text not in shared or r.page_id == top[text])
        else:
            assert text in shared and r.refers_to == top[text]
    assert sum(r.record_type == "response" for r in out) == len(rows) - sum(sum(x[2] == h for x in rows) - 1 for h in shared)
    with gzip.open(f"{folders[0]}/{manifests[0][0].name}".removeprefix("file:")) as archive:
        assert archive.readline() == b"WARC/1.1\r\n"


def test_uncommitted_files_are_not_read(spark):
    folder = work_path(spark, "warc")
    df = spark.createDataFrame(archive_pages()[:20], "page_id long, url string, html string")
    warc.write_archive(df, folder)
    path = folder.removeprefix("file:")
    with open(f"{path}/pages-000099-0000.warc.gz", "wb") as stray, open(f"{path}/_temporary/lost.1", "wb") as lost:
        stray.write(b"not a record"), lost.write(b"half a rec")
    assert warc.read_archive(spark, folder).count() == 20
    empty = work_path(spark, "warc")
    warc.write_archive(df.where("false"), empty)
    assert warc.read_archive(spark, empty).count() == 0


def test_empty_schema_is_kept(spark):
    assert frame(spark, []).schema == spark.createDataFrame([], SCHEMA).schema
    assert F.lit(1) is not None


def test_shards_of_more_ranges_than_knots_keep_the_order(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    ids = np.unique(np.concatenate((rng.integers(0, 10**6, 4000), rng.integers(10**12, 10**12 + 5000, 2000), [-5, 2**62])))
    pages = spark.createDataFrame([(int(i), int(i), 100) for i in ids], "page_id long, at long, bytes long")
    few, many = warc._Shards(pages, 20_000), warc._Shards(pages, 20_000, knots=4)
    assert few.count == len(few.bounds) + 1 and many.count == -(-100 * len(ids) // 20_000) and len(many.bounds) == 3
    for shards in (few, many):
        got = shards.of(ids)
        assert (np.diff(got) >= 0).all() and got.min() >= 0 and got.max() < shards.count
    sizes = np.bincount(few.of(ids), minlength=few.count)
    assert sizes.max() < 3 * sizes.mean()


def test_files_are_read_a_task_each(spark):
    from pyspark.sql import functions as F

    files = spark.createDataFrame([(f"n{i}-{k}", i, k) for i in range(7) for k in range(2)], "name string, shard int, seq int")
    dealt = warc._by_file(files).select(F.spark_partition_id().alias("p")).distinct().count()
    assert dealt == 14
    assert warc._by_file(files.where("false")).count() == 0


def test_ranges_of_seeds_are_even():
    import numpy as np

    # Anchors have small hashes; their ranges are none the less of like size.
    hashes = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 200_000, dtype=np.uint64))[:20_000].view(np.int64)
    sizes = np.bincount([suffixes._range_of(int(h), 16) for h in hashes], minlength=16)
    assert len(sizes) == 16 and sizes.max() < 1.3 * sizes.mean()
    assert all(0 <= suffixes._range_of(h, 3) < 3 for h in (-(1 << 63), -1, 0, (1 << 63) - 1))
