"""Substring, SimHash and embedding duplicates, mixing, components, the pipeline."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scorelattice.llm import components, embedding_dedup, mixing, simhash, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


# --- substring duplicates -------------------------------------------------


def slow_dedup(rows):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(t or "")
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("ends, buckets, fan", [((1.0,), None, 4096), (substring_dedup.BATCH_ENDS, None, 4096), ((0.2, 0.4, 0.6, 0.8, 0.9, 1.0), 500, 4096), ((0.2, 0.4, 0.6, 0.8, 1.0), 40, 8), ((0.5, 1.0), 1000, 7)])
def test_substrings_against_brute_force(documents, prose, monkeypatch, ends, buckets, fan):
    monkeypatch.setattr(substring_dedup, "CHUNK_TEXT", 3000)
    rnd = random.Random(2)
    pool = [prose(900 + k, 13 + 3 * k) for k in range(8)]
    rows = []
    for i in range(60):
        parts = [prose(i, rnd.randrange(0, 30))] + [rnd.choice(pool) for _ in range(rnd.randrange(3))] + [prose(i + 500, rnd.randrange(20))]
        rnd.shuffle(parts)
        rows.append((i * 7 % 61, rnd.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(100, None), (101, ""), (102, rows[0][1]), (102, rows[0][1]), (103, "é x " * 30), (104, "é x " * 5000)]
    out = substring_dedup.deduplicate(documents(rows), batch_ends=ends, buckets=buckets, fan=fan).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("h")).collect()
    assert sorted(tuple(r) for r in out) == slow_dedup(rows)


def test_substring_edges(documents, prose):
    rows = [(None, prose(1, 20)), (5, prose(1, 20)), (None, prose(1, 20))]
    out = substring_dedup.deduplicate(documents(rows)).collect()
    assert sorted((r["doc_id"] is None, r["n_removed"]) for r in out) == [(False, 0), (True, 20), (True, 20)]
    assert substring_dedup.deduplicate(documents(rows).limit(0)).count() == 0


def thue_morse(k):
    out = "a"
    for _ in range(k):
        out += out.translate(str.maketrans("ab", "ba"))
    return out


def test_words_that_sums_of_powers_take_for_equal(documents, prose):
    """A Thue-Morse word and its complement collide under every polynomial hash modulo 2**64."""
    word = thue_morse(10)
    other = word.translate(str.maketrans("ab", "ba"))
    before, after = prose(1, 12), prose(2, 12)
    rows = [(1, f"{before} {word} {after}"), (2, f"{before} {other} {after}"), (3, f"{before} {other} {after}")]
    out = {r["doc_id"]: r["n_removed"] for r in substring_dedup.deduplicate(documents(rows)).collect()}
    assert out == {1: 0, 2: 0, 3: 25}


def test_hashes_tell_words_apart():
    from scorelattice.llm import common

    words = [b"a" * n for n in range(1, 600)] + [b"\0" * n for n in range(1, 30)] + [b"b" + b"\0" * n for n in range(1, 30)] + [bytes([x, y]) for x in range(256) for y in range(256)]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - np.array([len(w) for w in words])
    for which in (0, 1):
        h = common.word_hashes(data, starts, ends, which)
        assert len(set(h.tolist())) == len(set(words))
        alone = np.frombuffer(b"xx" + words[100] + b"yy", np.uint8)
        assert common.word_hashes(alone, np.array([2]), np.array([2 + len(words[100])]), which)[0] == h[100]


def test_rows_of_a_chunk_do_not_grow_with_the_index(prose):
    import pyarrow as pa

    n = 300
    text, ids = pa.array([prose(k, 300) for k in range(n)]), np.arange(n) * 17
    size = {}
    for buckets in (64, 1024, 6250, 62_500, 6_250_000):
        rows = substring_dedup.chunk_rows(ids, ids, text, 13, substring_dedup.Buckets(buckets, 1024))
        size[buckets] = sum(len(x) for r in rows for x in r[3:])
        assert len(rows) <= 1025 and sum(r[1] == "docs" for r in rows) == 1
        assert sum(len(r[5]) for r in rows if r[1] == "new") == 10 * sum(len(r[6]) // 4 for r in rows if r[1] == "new")
    assert size[6250] <= 1.25 * size[1024] and size[6_250_000] <= 1.25 * size[1024]


def test_an_index_is_kept_and_opened_again(spark, documents, prose, tmp_path):
    folder = "file://" + str(tmp_path / "index")
    keyed = lambda rows: documents(rows).selectExpr("doc_id order_id", "xxhash64(text) sig", "text")
    shared = prose(5, 40)
    for k in range(7):
        index = substring_dedup.FingerprintIndex(spark, folder=folder)  # as another session would
        marks = index.add(keyed([(10 * k, prose(50 + k, 30)), (10 * k + 1, shared + " " + prose(70 + k, 30))]))
        assert [r["mark_id"] for r in marks.collect()] == ([10 * k + 1] if k else [])
        assert len(index.runs) < 4 and len(substring_dedup._tables(spark, index.folder)) == len(index.runs)


# --- SimHash --------------------------------------------------------------


def slow_fingerprint(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_fingerprints(prose):
    for t in [None, "", " \n", "One", "one TWO three", "É é", prose(3, 4), prose(3, 200), "a b c d " * 50, prose(5, 3000)]:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def test_fingerprints_are_spark_hashes(spark):
    row = spark.range(1).select(F.hex(F.xxhash64(F.lit("one two three"))).alias("h")).first()
    assert int(row["h"], 16) == simhash.fingerprint("one two three")


@pytest.mark.parametrize("tile", [8, 4096])
def test_links_against_all_pairs(spark, tile):
    rng = np.random.default_rng(1)
    fps = [int(x) for x in rng.integers(0, 2**63, 300)]
    for x in fps[:120]:
        for _ in range(4):
            y = x
            for b in rng.choice(64, rng.integers(1, 7), replace=False):
                y ^= 1 << int(b)
            fps.append(y)
    hub = fps[0]
    fps += [hub ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(a + 1, 64, 5)]
    fps = sorted(set(fps))
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x, k) for k, x in enumerate(signed)], "fp long, id long")
    found = components.components(components.local_forest(simhash.fingerprint_links(df, tile=tile)))
    got = {r["node"]: r["root"] for r in found.collect()}
    sets, arr = Sets(), np.array(fps, np.uint64)
    for i in range(len(arr)):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= 4):
            sets.join(i, i + 1 + int(j))
    assert all(got.get(i, i) == sets.find(i) for i in range(len(arr)))


def test_gray_order_and_masks():
    rank = np.arange(4096, dtype=np.uint64)
    assert (simhash.gray_rank(rank ^ (rank >> np.uint64(1))) == rank).all()
    rnd = random.Random(1)
    for rows in (10, 1 << 23, 1 << 31):
        for _ in range(200):
            a = rnd.getrandbits(64)
            b = a
            for k in rnd.sample(range(64), 4):
                b ^= 1 << k
            assert any(a & m == b & m for m in simhash.masks(rows))


def test_near_duplicates_table(documents, prose):
    base = prose(1, 400)
    near = base.replace(base.split()[200], "changed", 1)
    rows = [(7, base), (3, near), (9, base), (9, base), (4, None), (2, ""), (8, prose(2, 300)), (None, base)]
    out = simhash.near_duplicates(documents(rows)).collect()
    assert len(out) == len(rows)
    fps = {r["doc_id"]: int(r["fingerprint"], 16) for r in out}
    assert fps[7] == slow_fingerprint(base) and fps[4] == 0
    linked = bin(fps[7] ^ fps[3]).count("1") <= 4
    comp = {r["doc_id"]: r["component_id"] for r in out}
    assert comp[9] == comp[7] == (3 if linked else 7) and comp[4] == comp[2] == 2 and comp[8] == 8 and comp[None] == comp[7]
    assert simhash.near_duplicates(documents(rows).limit(0)).count() == 0


# --- components -----------------------------------------------------------


def test_components_of_paths_stars_and_loops(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + k) for k in range(1, 400)] + [(5000, 5000), (6001, 6000), (6000, 6001)]
    edges += [(rnd.randrange(7000, 7400), rnd.randrange(7000, 7400)) for _ in range(350)]
    rnd.shuffle(edges)
    out = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    sets = Sets()
    for a, b in edges:
        if a != b:
            sets.join(a, b)
    assert out == {x: sets.find(x) for x in sets.up}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- embeddings -----------------------------------------------------------


def slow_embeddings(rows):
    x = {}
    for k, (i, v, label) in enumerate(rows):
        if label is not None and v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v):
            x[k] = np.array(v, float)
    sets, links = Sets(), defaultdict(int)
    for a in x:
        for b in x:
            if a < b and rows[a][2] == rows[b][2] and len(x[a]) == len(x[b]) and x[a] @ x[b] / np.sqrt((x[a] @ x[a]) * (x[b] @ x[b])) >= 0.93:
                links[a] += 1
                links[b] += 1
                sets.join(rows[a][0], rows[b][0])
    return sorted((i, links[k], sets.find(i), sets.find(i) == i) for k, (i, _, _) in enumerate(rows))


@pytest.mark.parametrize("tile", [16, 1024])
def test_embeddings_against_all_pairs(spark, tile):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for label in (0, 1, 2):
        for _ in range(60):
            v = rng.normal(size=16)
            for _ in range(rng.integers(1, 5)):
                w = v + rng.normal(size=16) * rng.choice([0.05, 0.25, 0.4])
                rows.append((n, [float(c) for c in w], label))
                n += 1
    rows += [(n, rows[0][1], 0), (n + 1, None, 0), (n + 2, [0.0] * 16, 1), (n + 3, [float("nan")] * 16, 1), (n + 4, rows[3][1], None), (n + 5, [1.0, None] * 8, 2), (n + 6, [1.0, 2.0], 2), (n + 7, [2.0, 4.0], 2), (n + 8, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 cell", "2 weight", "3 id")
    out = embedding_dedup.near_duplicates(df, tile=tile, codes=4).collect()
    want = slow_embeddings(rows)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out)
    links = lambda rs: sum(r[1] for r in rs)
    assert len(got) == len(want) and links(got) >= 0.99 * links(want) and links(got) <= links(want)
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.98 * len(want)


def test_embedding_edges(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    only_bad = spark.createDataFrame([(1, None, 0), (2, [0.0, 0.0], 0)], schema)
    assert sorted(tuple(r) for r in embedding_dedup.near_duplicates(only_bad).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
    same = spark.createDataFrame([(5, [1.0, 2.0], 0), (5, [1.0, 2.0], 0), (6, [1.0, 2.0], 1), (4, [2.0, 4.0], 0)], schema)
    assert sorted(tuple(r) for r in embedding_dedup.near_duplicates(same).collect()) == [(4, 2, 4, True), (5, 2, 4, False), (5, 2, 4, False), (6, 0, 6, True)]


@pytest.mark.parametrize("kind, labels", [("double", [1.2, 1.9, 1.2, None]), ("string", ["a", "b", "a", None]), ("int", [1, 2, 1, None]), ("decimal(9,2)", ["1.20", "1.90", "1.2", None])])
def test_labels_are_compared_in_their_own_type(spark, kind, labels):
    rows = spark.createDataFrame([(k, [1.0, 2.0, 3.0 + k / 100], None if x is None else str(x)) for k, x in enumerate(labels)], "vec_id long, embedding array<double>, label string")
    out = embedding_dedup.near_duplicates(rows.withColumn("label", F.col("label").cast(kind)))
    assert sorted(tuple(r) for r in out.collect()) == [(0, 1, 0, True), (1, 0, 1, True), (2, 1, 0, False), (3, 0, 3, True)]


def test_memory_does_not_grow_with_the_cells():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    x = rng.normal(size=(4096, 16))
    x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
    tile = pa.table({"id": np.arange(2048), "weight": np.ones(2048, int), "vec": [r.tobytes() for r in x[:2048]], "is_home": np.arange(2048) < 1024})
    peaks = []
    for codes in (64, 512):  # 4,096 and 262,144 cells
        tracemalloc.start()
        grid = embedding_dedup.fit(x, codes, 0.93)
        embedding_dedup._tile_links(grid, 0.93)(tile)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert max(peaks) < 150_000_000


def test_traversal_order():
    rng = np.random.default_rng(2)
    for _ in range(100):
        a, b, most = rng.random(5), rng.random(7), rng.random() * 1.5
        total = (a[:, None] + b[None]).ravel()
        assert embedding_dedup.visits(a, b, most) == [int(i) for i in np.argsort(total) if total[i] <= most]


# --- mixing ---------------------------------------------------------------


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    assert mixing.targets([10, 100, 100], [5, 2, 1]) == pytest.approx([30, 120, 60])
    assert mixing.targets([0, 5], [5, 2]) == pytest.approx([0, 5])
    assert mixing.targets([0, 0], [5, 2]) == [0, 0]


@pytest.mark.parametrize("block, near", [(8, 80), (1024, 3)])  # tiny blocks: within one document
def test_mix(documents, prose, block, near):
    rnd = random.Random(6)
    rows = [(i, prose(i, rnd.randrange(1, 80)), None, rnd.choice(["b", "a", "é", "Z", None])) for i in range(400)] + [(900, None, None, "a"), (901, "", None, None), (5, prose(5, 30), None, "a")]
    df = documents(rows)
    out = [r.asDict() for r in mixing.mix_sources(df, block=block).collect()]
    assert sorted(r["doc_id"] for r in out) == sorted(r[0] for r in rows)
    source = {}
    for i, t, _, s in rows:
        source.setdefault(i, (s, t))
    sums, taken, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        s = source[r["doc_id"]][0]
        if r["doc_id"] == 5:
            s = next(x[3] for x in rows if x[0] == 5 and len(WORD.findall(x[1])) == r["size"])
        sums[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = (r["target"], r["source_size"])
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    order = ["Z", "a", "b", "é", None]
    want = mixing.targets([sums[s] for s in order], [5, 2, 1, 5, 2])
    for s, w in zip(order, want, strict=True):
        assert target[s] == (pytest.approx(w), sums[s]) and abs(taken[s] - w) <= near
    again = sorted((r["doc_id"], r["size"], r["taken"]) for r in mixing.mix_sources(df, block=block).collect())
    assert again == sorted((r["doc_id"], r["size"], r["taken"]) for r in out)


def test_rounding_is_unbiased():
    rng = np.random.default_rng(0)
    size, left = rng.integers(1, 50, 30), np.full(30, 0.3)
    mean = np.mean([mixing.round_block(size, left, rng.integers(0, 2**62, 30), False) for _ in range(3000)], axis=0)
    assert np.abs(mean - 0.3).max() < 0.06


def plain_targets(sizes, weights):
    """The level at which capped shares add up to the total, by bisection."""
    total = min(sum(sizes), 3 * sum(sizes))
    lo, hi = 0.0, 3.0 * max(sizes, default=0) + 1
    for _ in range(300):
        level = (lo + hi) / 2
        lo, hi = (lo, level) if sum(min(w * level, 3 * s) for s, w in zip(sizes, weights, strict=True)) >= total else (level, hi)
    return [min(w * hi, 3 * s) for s, w in zip(sizes, weights, strict=True)]


def test_targets_against_bisection():
    rnd = random.Random(8)
    for _ in range(200):
        sizes = [rnd.choice([0, rnd.randrange(1, 10), rnd.randrange(1, 5000)]) for _ in range(rnd.randrange(1, 9))]
        weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        assert mixing.targets(sizes, weights) == pytest.approx(plain_targets(sizes, weights), rel=1e-6, abs=1e-6)


def plain_pivotal(documents, fraction, turns):
    """Copies (0 or 1) of each (size, dice) in order: Srswor-like duels by expected words, from the definition."""
    p = [fraction if size else 0.0 for size, _ in documents]
    open_ = [k for k, (size, _) in enumerate(documents) if size and 0 < fraction < 1]
    fighter = None
    for k in open_:
        if fighter is None:
            fighter = k
            continue
        (wa, _), (wb, dice) = documents[fighter], documents[k]
        gain = min((1 - p[fighter]) * wa, p[k] * wb)  # words that may move from k to the fighter
        loss = min(p[fighter] * wa, (1 - p[k]) * wb)
        moved = gain if dice < loss / (gain + loss) else -loss
        p[fighter] += moved / wa
        p[k] -= moved / wb
        for x in (fighter, k):
            p[x] = 0.0 if p[x] < 1e-9 else 1.0 if p[x] > 1 - 1e-9 else p[x]
        undecided = [x for x in (fighter, k) if 0 < p[x] < 1]
        fighter = undecided[0] if undecided else None
    if fighter is not None:
        p[fighter] = float(documents[fighter][1] < p[fighter])
    words = lambda: sum(p[k] * documents[k][0] for k in open_)
    wanted = fraction * sum(documents[k][0] for k in open_)
    for _ in range(turns):
        tries = [abs(words() + (1 - 2 * p[k]) * documents[k][0] - wanted) for k in open_]
        if not tries or min(tries) >= abs(words() - wanted):
            break
        p[open_[tries.index(min(tries))]] = 1 - p[open_[tries.index(min(tries))]]
    return p


def test_mix_against_plain_pivotal_rounding(spark, documents, prose):
    rnd = random.Random(12)
    rows = [(i, prose(i, rnd.randrange(0, 60)) or None, None, rnd.choice("abc")) for i in range(300)]
    size = {i: len(WORD.findall(t or "")) for i, t, _, _ in rows}
    draws = spark.createDataFrame([(i, n) for i, n in size.items()], "doc_id long, size long").select("doc_id", F.xxhash64(F.xxhash64(F.lit(7), "doc_id", "size", F.lit(0).cast("long")), F.lit("level 0")).alias("draw"))
    draw = {r["doc_id"]: r["draw"] for r in draws.collect()}
    out = {r["doc_id"]: r for r in mixing.mix_sources(documents(rows)).collect()}
    want = plain_targets([sum(size[i] for i, _, _, s in rows if s == x) for x in "abc"], [5, 2, 1])
    for x, target in zip("abc", want, strict=True):
        own = sorted((i for i, _, _, s in rows if s == x), key=lambda i: draw[i])
        copies = target / sum(size[i] for i in own)
        dice = lambda i: (int(mixing.mix(np.array([draw[i]], np.int64).astype(np.uint64))[0]) >> 11) / 2**53
        taken = plain_pivotal([(size[i], dice(i)) for i in own], copies - int(copies), mixing.TURNS)
        assert [out[i]["taken"] for i in own] == [int(size[i] * (int(copies) + p)) for i, p in zip(own, taken, strict=True)]
        assert abs(sum(out[i]["taken"] for i in own) - target) <= 3


def test_rows_that_share_an_id_are_spread_over_blocks(documents, monkeypatch):
    """A third of all rows alike in every column, and as many without an id."""
    monkeypatch.setattr(mixing, "COPIES", 50)
    rows = [(None, "a b c", None, "x")] * 400 + [(7, "d " * 9, None, "x")] * 400 + [(i, "e " * (i % 30), None, "y") for i in range(400)]
    seen = []
    rounder = mixing._rounder

    def watched(last):
        run = rounder(last)

        def checked(table):
            assert table.num_rows <= 200, table.num_rows
            return run(table)

        return checked

    monkeypatch.setattr(mixing, "_rounder", watched)
    out = mixing.mix_sources(documents(rows), block=64).collect()
    assert len(out) == 1200
    for size, n in ((3, 400), (9, 400)):
        seen = [r["taken"] for r in out if r["size"] == size and (r["doc_id"] in (None, 7))]
        assert len(seen) == n
    x = [r for r in out if r["doc_id"] is None or (r["doc_id"] == 7 and r["size"] == 9)]
    assert abs(sum(r["taken"] for r in x) - x[0]["target"]) <= 9
    again = mixing.mix_sources(documents(rows[::-1]).repartition(3), block=64).collect()
    key = lambda rs: sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in rs)
    assert key(out) == key(again)


def test_mix_of_nothing(documents):
    assert mixing.mix_sources(documents([(1, "a")]).limit(0)).count() == 0


# --- pipeline -------------------------------------------------------------


def test_pipeline_stages_take_effect(spark, documents, prose, tmp_path):
    import corpus_pipeline

    item = prose(77, 30)
    rows = [(i, prose(i, 120), "en", f"s{i % 3}") for i in range(30)]
    rows += [(100, rows[3][1], "en", "s0"), (101, rows[3][1], "en", "s0"), (102, prose(50, 40) + " " + item, "en", "s1"), (103, "123 456", "en", "s1"), (104, None, None, "s2"), (105, "write to me@example.org " + prose(60, 50), "en", None), (106, prose(61, 80), "en", "s1"), (106, prose(61, 80), "en", "s1")]
    docs = documents(rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["identify_language", "drop_near_duplicates", "decontaminate", "redact_pii", "mix"]
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, str(tmp_path))
        assert out.dtypes == kept.dtypes
        path = str(tmp_path / name.replace(" ", "_"))
        out.write.parquet(path)
        kept = spark.read.parquet(path)
        seen.append(sorted(r["doc_id"] for r in kept.select("doc_id").collect()))
    clean = list(range(30))
    assert seen[0] == clean + [100, 101, 102, 105, 106, 106]
    assert seen[1] == clean + [102, 105, 106]
    assert seen[2] == seen[3] == clean + [105, 106]
    text = kept.where("doc_id = 105").first()["text"]
    assert "[EMAIL]" in text and "@" not in text
    mixed = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in mixed.collect()) == seen[3]
    empty = kept.limit(0)
    assert all(stage(spark, empty, str(tmp_path)).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_language_stage_drops_noise_and_unlearned_languages(spark, documents):
    import corpus_pipeline

    learned = {"en": "the and of to that with from which this there where when would could should", "fr": "le la les des une dans avec pour être était où très même après déjà leçon"}
    polish = "się nie jest że przez który może oraz wszystko został gdzie każdy właśnie między szczególnie dzień"
    rnd = random.Random(9)
    text = lambda words, n: " ".join(rnd.choice(words.split()) for _ in range(n))
    noise = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(n))
    rows = [(i, text(learned["en" if i % 2 else "fr"], rnd.choice([4, 20, 100])), "en" if i % 2 else "fr") for i in range(120)]
    bad = [(1000 + k, noise(n)) for k, n in enumerate([20, 20, 100, 100, 1000, 5000])] + [(2000 + k, text(polish, n)) for k, n in enumerate([20, 100, 1000])]
    kept = corpus_pipeline.identify_language(spark, documents(rows + bad), "")
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == list(range(120))


def test_near_duplicate_stage_keeps_rows_of_other_groups(spark, documents, prose):
    import corpus_pipeline

    text = [prose(200 + k, 120) for k in range(9)]
    copies = [(3, text[0]), (5, text[0]), (8, text[5]), (7, text[6]), (7, text[6])]
    # rows without an id, and rows that share one: some copies of others, some with texts of their own
    loose = [(None, text[1]), (None, text[2]), (None, text[3]), (None, text[3]), (None, text[5]), (5, text[4]), (9, text[7]), (9, text[8])]
    clashing = documents(copies + loose).selectExpr("*", "1 n", "2 row", "3 kept_id", "4 kept_row", "5 first", "6 at", "7 node", "8 `group`")
    out = corpus_pipeline.drop_near_duplicates(spark, clashing, "")
    assert out.dtypes == clashing.dtypes
    got = sorted((r["doc_id"] or 0, text.index(r["text"])) for r in out.collect())
    assert got == [(0, 1), (0, 2), (0, 3), (3, 0), (5, 4), (7, 6), (8, 5), (9, 7), (9, 8)]


def test_every_stage_survives_clashing_names(spark, documents, prose, tmp_path):
    """Extra columns with the names that operators use, nulls, empty and repeated rows, through all stages."""
    import corpus_pipeline

    names = "n row kept_id kept_row first at node root group order_id mark_id kept size taken target source_at plan_source copies draw left count alike number part items contaminated".split()
    rows = [(k, prose(k, 60), "en", "s") for k in range(12)] + [(None, prose(90, 60), "en", None), (3, prose(3, 60), "en", "s"), (50, None, None, None), (51, "", "en", "s"), (52, prose(52, 60) + " a@b.co", None, "s")]
    docs = documents(rows).selectExpr("*", *[f"{k} AS `{n}`" for k, n in enumerate(names) if n not in ("size",)])
    spark.createDataFrame([(1, prose(400, 30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.dtypes == docs.dtypes, name
            assert out.count() >= 13, name
        else:
            assert out.count() == len(rows)
