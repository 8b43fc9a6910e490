"""Language, quality, secrets, personal data, token counts, decontamination."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelattice.llm import decontam, lang_id, pii, quality, secrets, token_counts

EN = "the and of to that with from which this there where when would could should"
FR = "le la les des une dans avec pour être était où très même après déjà leçon"


def sentences(words, seed, n=40):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(words.split()) for _ in range(n))


def edge_rows():
    return [(1, None), (2, ""), (3, " \n\t"), (4, "123 !!"), (5, "x"), (5, "x"), (None, "the and of"), (6, "a" * 300_000)]


# --- language -------------------------------------------------------------


def test_language_held_out(documents, collected):
    rows = [(i, sentences(EN if i % 2 else FR, i), "en" if i % 2 else "fr") for i in range(60)]
    df = documents(rows)
    out = collected(lang_id.with_fold(lang_id.predict(df, lang_id.train(df))))
    assert all(out[i]["lang_pred"] == lang for i, _, lang in rows)
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in out)
    assert all(0 < r["score"] <= 1 for r in out.values())


def test_language_edges(documents):
    df = documents([(7, EN, "en"), (8, FR, "fr"), (9, EN, "en"), (11, FR, "fr"), *edge_rows()])
    profiles = lang_id.train(df)
    out = [(r["doc_id"], r["lang_pred"], r["score"]) for r in lang_id.predict(df, profiles).collect()]
    assert len(out) == 12
    assert all((p == "und") == (i in (1, 2, 3, 4)) for i, p, _ in out)
    assert all(s == 0 for i, _, s in out if i in (1, 2, 3, 4))
    assert lang_id.predict(df.limit(0), profiles).count() == 0
    assert {r["lang_pred"] for r in lang_id.predict(df, lang_id.train(documents([(1, "no label here")]))).collect()} == {"und"}


def test_language_against_plain_counting():
    """The vectorised profile distance against one computed with strings."""
    from collections import Counter

    def grams(text):
        out = Counter()
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            out.update(w)
            padded = f" {w} "
            out.update(padded[i : i + 2] for i in range(len(padded) - 1))
            out.update(padded[i : i + 3] for i in range(len(padded) - 2))
        return out

    for seed in range(20):
        text = sentences(EN + " " + FR, seed, 30) + " 12 ?!"
        codes, counts = lang_id.gram_counts(text)
        decode = lambda c: "".join(chr(x) for x in (c >> 42, c >> 21 & 0x1FFFFF, c & 0x1FFFFF) if x)
        assert {decode(int(c)): int(n) for c, n in zip(codes, counts, strict=True)} == dict(grams(text))


def test_language_against_plain_out_of_place_distance(documents, collected):
    """Profiles, distances and the ranking of languages, by dictionaries of strings."""
    from collections import Counter

    def grams(text):
        out = Counter()
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            out.update(w)
            padded = f" {w} "
            out.update(padded[i : i + n] for n in (2, 3) for i in range(len(padded) - n + 1))
        return out

    def code(g):
        return int.from_bytes(b"".join(ord(c).to_bytes(4, "big") for c in g.rjust(3, "\0")), "big")

    def ranked(counts, size):
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))][:size]

    DE = "der die und das nicht mit sich auf für ist ein eine auch werden über größe schön"
    rnd = random.Random(6)
    langs = {"en": EN, "fr": FR, "de": DE}
    rows = [(i, sentences(langs[x], i, rnd.randrange(3, 40)), x) for i in range(90) for x in [list(langs)[i % 3]]]
    rows += [(200 + i, sentences(EN + " " + FR + " " + DE, i, rnd.choice([1, 4, 30])), None) for i in range(60)] + [(300, "xyz", None)]
    profiles, size = {}, lang_id.PROFILE
    for x in sorted(langs):
        counts = Counter()
        for i, t, lang in rows:
            if lang == x and zlib.crc32(str(i).encode()) % 5:
                counts += grams(t)
        profiles[x] = {g: k for k, g in enumerate(ranked(counts, size))}
    df = documents(rows)
    out = collected(lang_id.predict(df, lang_id.train(df)))
    for i, t, _ in rows:
        own = ranked(grams(t), size)
        distance = {x: sum(abs(k - p[g]) if g in p else size for k, g in enumerate(own)) for x, p in profiles.items()}
        best = min(distance, key=lambda x: (distance[x], x))
        assert out[i]["lang_pred"] == best and out[i]["score"] == pytest.approx(1 - distance[best] / (len(own) * size)), t


@pytest.mark.parametrize("held", [1 << 20, 200])
def test_language_stage_learns_from_all_training_rows(spark, documents, monkeypatch, held):
    """Profiles and floors of the pipeline against plain ones over every training row, of languages with more rows than a sample would hold."""
    from collections import Counter, defaultdict

    import corpus_pipeline

    rnd = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzéèüñ"
    words = {x: ["".join(rnd.choices(letters, [rnd.random() for _ in letters], k=rnd.randint(1, 7))) for _ in range(80)] for x in ("aa", "bb")}
    rows = [(i, " ".join(rnd.choices(words[x], k=rnd.choice([1, 3, 9, 40]))) + rnd.choice(["", " 12", ".\n"]), x) for i in range(1700) for x in ["aa" if i < 1400 else "bb"]]
    rows += [(3000, "123", "aa"), (3001, "", "aa"), (3002, None, "aa"), (3003, "xyz", None)]
    learned = [(t, x) for i, t, x in rows if t and x and zlib.crc32(str(i).encode()) % 5]
    counts = defaultdict(Counter)
    for t, x in learned:
        if found := lang_id.gram_counts(t):
            counts[x].update(dict(zip(*(v.tolist() for v in found), strict=True)))
    profiles = lang_id.Profiles({x: np.array([c for c, _ in sorted(own.items(), key=lambda y: (-y[1], y[0]))][: lang_id.PROFILE]) for x, own in counts.items()}, lang_id.PROFILE)
    scores = defaultdict(list)
    for t, _ in learned:
        w = t.split()
        for text in [t, *[" ".join(w[:n]) for n in lang_id.EXCERPTS if n < len(w)]]:
            lang, score, length = profiles.measured(text)
            if lang != "und":
                scores[length].append(score)
    low = {k: (sorted(v)[max(0, int(np.ceil(lang_id.FLOOR_QUANTILE * len(v))) - 1)], len(v)) for k, v in scores.items()}
    seen = []
    monkeypatch.setattr(lang_id, "HELD", held)
    monkeypatch.setattr(lang_id, "keep_known", lambda docs, profiles, least: seen.extend([profiles, least]) or docs)
    corpus_pipeline.identify_language(spark, documents(rows), "")
    assert seen[0].langs == profiles.langs
    assert (seen[0].codes == profiles.codes).all() and (seen[0].table == profiles.table).all()
    for at in range(64):
        near, n, away = [], 0, 0
        while n < lang_id.FLOOR_SCORES and away < 64:
            own = [low[k] for k in {at - away, at + away} if k in low]
            near, n, away = near + [x for x, _ in own], n + sum(m for _, m in own), away + 1
        assert seen[1][at] == lang_id.FLOOR_SHARE * min(near)


def test_excerpts_score_as_texts_of_their_own():
    rnd = random.Random(12)
    profiles = lang_id.Profiles({x: lang_id.ranked(*lang_id.gram_counts(w), lang_id.PROFILE) for x, w in (("en", EN), ("fr", FR))}, lang_id.PROFILE)
    odd = ["12", "ΑΣ", "İx", "l'été", "Straße", "a-b", "--", "\ud800z", "ΣΑ'", "ﬀ"]
    for k in range(60):
        text = "".join(rnd.choice([*(EN + " " + FR).split(), *odd]) + rnd.choice([" ", "\n", "\u00a0", "\x1c", "  "]) for _ in range(rnd.choice([0, 1, 2, 5, 70, 1300])))
        text = ["", "1 2 3 "][k % 2] + text
        w = text.split()
        want = [profiles.measured(" ".join(w[:n])) for n in lang_id.EXCERPTS if n < len(w)]
        assert profiles.excerpts(text) == [(score, length) for lang, score, length in want if lang != "und"]


def test_least_scores_are_exact(spark):
    rnd = random.Random(13)
    rows = [(length, rnd.choice([rnd.random(), rnd.randrange(50) / 50, 1.0, 0.5 + rnd.randrange(9) / 1e6])) for length, n in ((1, 1), (2, 7), (5, 1000), (9, 6000)) for _ in range(n)]
    df = spark.createDataFrame(rows, "length int, score double")
    for share in (0.001, 0.01, 0.25, 0.5, 1.0):
        own = {k: sorted(s for x, s in rows if x == k) for k in (1, 2, 5, 9)}
        assert lang_id.low_scores(df, share) == {k: (v[max(0, int(np.ceil(share * len(v))) - 1)], len(v)) for k, v in own.items()}
    assert lang_id.low_scores(df.limit(0), 0.001) == {}


# --- quality --------------------------------------------------------------


def plain_statistics(t):
    """The statistics of a text, a character and a word at a time."""
    t = t or ""
    if not t.strip(" "):
        return dict.fromkeys(["log_words", "word_length", "upper_share", "symbol_share", "symbols_a_word", "digit_share", "stops_a_word", "distinct_words", "word_repeats", "distinct_lines", "lines_a_word"], 0.0)
    words = re.sub(r"[\x20\x09-\x0D]+", " ", t).strip(" ").split(" ")
    n, c, u, lines = len(words), len(t), len(set(words)), t.split("\n")
    count = lambda chars: sum(x in chars for x in t)
    odd, stops = count("#$%&*|!?<>{}[]=~^@/\\_+"), count(".,;:")
    return {"log_words": np.log1p(n), "word_length": c / n, "upper_share": sum("A" <= x <= "Z" for x in t) / c, "symbol_share": odd / c, "symbols_a_word": odd / n, "digit_share": sum("0" <= x <= "9" for x in t) / c, "stops_a_word": stops / n, "distinct_words": u / n, "word_repeats": n / np.sqrt(u), "distinct_lines": len(set(lines)) / len(lines), "lines_a_word": len(lines) / n}


def test_statistics_against_plain_counting(documents, prose):
    rnd = random.Random(3)
    bits = ["A", "z", "é", "9", " ", "  ", "\n", "\t", "#", "[x]", "a_b", "\\", ".", ",;:", "日本", "word", "\n\n"]
    rows = [(k, "".join(rnd.choice(bits) for _ in range(rnd.randrange(60)))) for k in range(300)] + [(400, None), (401, ""), (402, " "), (403, "\n"), (404, prose(1, 4000))]
    by_id = dict(rows)
    for r in quality.statistics(documents(rows), "doc_id").collect():
        want = plain_statistics(by_id[r["doc_id"]])
        assert {k: r[k] for k in want} == pytest.approx(want), by_id[r["doc_id"]]


def plain_tree(x, residual, names, rows, cols, depth):
    """Paths of a least-squares tree by trying every cut of every column."""
    paths = []

    def cost(own):
        return sum((residual[i] - sum(residual[j] for j in own) / len(own)) ** 2 for i in own)

    def grow(own, path, left):
        best = None
        if left and len(own) >= 2 * quality.MIN_LEAF:
            for j in cols:
                values = [x[i][j] for i in own]
                for cut in sorted(set(np.quantile(values, np.linspace(0, 1, quality.CUTS + 2)[1:-1]).tolist())):
                    low, high = [i for i in own if x[i][j] <= cut], [i for i in own if x[i][j] > cut]
                    if min(len(low), len(high)) >= quality.MIN_LEAF:
                        saved = cost(own) - cost(low) - cost(high)
                        if best is None or saved > best[0] + 1e-9:
                            best = (saved, j, cut, low, high)
        if best is None or best[0] <= 1e-9:
            return
        _, j, cut, low, high = best
        for most, part in ((True, low), (False, high)):
            paths.append((*path, (names[j], most, cut)))
            grow(part, paths[-1], left - 1)

    grow(rows, (), depth)
    return paths


def test_tree_paths_against_every_cut():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 3))
    residual = np.where(x[:, 0] > 0.3, 1.0, -0.5) + np.where((x[:, 1] > 0) & (x[:, 0] > 0.3), 2.0, 0) + rng.normal(size=120) * 0.1
    names, rows, cols = ["a", "b", "c"], np.arange(0, 120, 1), np.arange(3)
    found, fit = quality.tree_paths(x, residual, names, rows, cols, 3)
    want = plain_tree(x.tolist(), residual.tolist(), names, rows.tolist(), cols.tolist(), 3)
    assert [[(n, m, pytest.approx(c)) for n, m, c in p] for p in found] == [list(p) for p in want]
    leaves = [p for p in found if not any(q[: len(p)] == p and q != p for q in found)]
    for p in leaves:  # the fit is the mean of what lies in a leaf
        own = quality.Rule(p).holds(dict(zip(names, x.T, strict=True)))
        assert fit[own] == pytest.approx(np.full(own.sum(), residual[own].mean()))


def test_lasso_against_coordinate_descent():
    """The minimum of the penalised loss, found one weight at a time; and that no step away from it is better."""
    rng = np.random.default_rng(5)
    h = rng.normal(size=(300, 6))
    y = (rng.random(300) < 1 / (1 + np.exp(-(1.5 * h[:, 0] - h[:, 2] + 0.3)))).astype(float)
    penalty = 0.03
    loss = lambda w, b: float(np.mean(np.log1p(np.exp(-(2 * y - 1) * (h @ w + b)))) + penalty * np.abs(w).sum())
    w, b = quality.lasso(h, y, penalty, steps=3000)
    pw, pb, step = np.zeros(6), 0.0, 1.0
    while step > 1e-6:
        better = False
        for k in range(7):
            for d in (step, -step):
                nw, nb = pw.copy(), pb
                if k < 6:
                    nw[k] = 0.0 if nw[k] * (nw[k] + d) < 0 else nw[k] + d
                else:
                    nb += d
                if loss(nw, nb) < loss(pw, pb) - 1e-12:
                    pw, pb, better = nw, nb, True
        step = step if better else step / 2
    assert loss(w, b) == pytest.approx(loss(pw, pb), abs=1e-6)
    assert w == pytest.approx(pw, abs=2e-3) and b == pytest.approx(pb, abs=2e-3)
    assert ((np.abs(w) < 1e-6) == (np.abs(pw) < 1e-4)).all() and (np.abs(w) < 1e-6).any()


def test_score_is_the_sum_of_the_rules(spark, documents, prose):
    """A fitted model's column against its rules, read one condition at a time."""
    rows = [(i, prose(i, 20 + i % 50) if i % 3 else " ".join(["Junk ### $$$ 99"] * (i % 40))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0 and i % 7 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    model = quality.train(documents(rows), labels)
    assert len(model.rules) > 3
    for r in quality.score(documents(rows), model).collect():
        x = plain_statistics(rows[r["doc_id"]][1])
        z = model.intercept + sum(w for rule, w in model.rules if all((x[n] <= c) == most for n, most, c in rule.terms))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)))



def test_quality_learns_and_scores(spark, documents, collected, prose):
    rows = [(i, prose(i, 60) if i % 3 else " ".join(["junk ### $$$"] * 20)) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    df = documents(rows)
    model = quality.train(df, labels)
    out = collected(quality.score(df, model))
    assert np.mean([out[i]["predicted"] == (i % 3 > 0) for i in range(300) if out[i]["held_out"]]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out.values())
    # the compiled column is the same function as the rules over arrays
    table = quality.statistics(df, "doc_id").toPandas()
    want = model.score_arrays({c: table[c].to_numpy() for c in table.columns if c != "doc_id"})
    assert np.allclose([out[i]["score"] for i in table.doc_id], want)
    assert 0 < len(model.rules) < 60


def test_quality_edges(spark, documents):
    labels = spark.createDataFrame([(5, 1, 0), (7, None, 0), (8, 3, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    df = documents(edge_rows())
    out = quality.score(df, quality.train(df, labels)).collect()
    assert len(out) == 8 and all(0 <= r["score"] <= 1 for r in out)
    assert quality.score(df.limit(0), quality.train(df.limit(0), labels.limit(0))).count() == 0


# --- secrets --------------------------------------------------------------

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_secrets(t):
    spans = [(m.start(), 0, m.end(), "assign") for m in _ASSIGN.finditer(t) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(spans)]


def test_secrets_against_brute_force(documents):
    rnd = random.Random(8)
    bits = ["password", "Token", "api_key", "apikey", "=", ": ", '"', "'", "abc", "abcdef12", "AKIA", "AKIA" + "Z9" * 9, "0f" * 12, "0f" * 11, "é", " ", "\n", "日本", "secret=", "x" * 5, "passwd:password=hunter22"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randrange(20)))) for i in range(400)] + [(1000, None), (1001, ""), (1002, "ab " * 50_000 + "token=abcdef")]
    out = secrets.scan(documents(rows)).collect()
    assert len(out) == len(rows)
    by_id = dict(rows)
    for r in out:
        base = base_secrets(by_id[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex")]
        assert [s for s in r["spans"].split(",") if s and not s.startswith("entropy")] == base


def slow_added(t):
    """Candidates that overlap no base span and aren't listed or announced, by plain Python."""
    base = [tuple(map(int, x.split(":")[1:])) for x in base_secrets(t)]
    out = []
    for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}", t):
        v = m[0]
        if any(s < m.end() and m.start() < e for s, e in base) or any(re.search(p.replace("++)", "+)").replace("++", "+"), v) for p in secrets.ALLOWED):
            continue
        if re.search(secrets.DIGEST, v) and re.search(secrets.ANNOUNCED, t[max(0, m.start() - secrets.ANNOUNCED_CHARS) : m.start()]):
            continue
        least = next(bits for _, allowed, bits in secrets.CLASSES if re.search(allowed, v))
        if max(entropy(v[i : i + 20]) for i in range(len(v) - 19)) >= least - 1e-12:
            out.append(f"entropy:{m.start()}:{m.end()}")
    return out


def test_added_spans_against_brute_force(documents):
    rnd = random.Random(17)
    token = lambda n: "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    bits = ["token=", "secret: ", "password=token", '":"', "\uffff", "\ufffe", "é", " ", " ", ".", "AKIA" + "Q7" * 9, "0f" * 13, "md5 (", ") = ", "sha256: ", "9F86D081884C7D659A2FEAA0C55AD015"]
    rows = [(i, "".join(rnd.choice([rnd.choice(bits), token(rnd.randrange(3, 45))]) for _ in range(rnd.randrange(25)))) for i in range(500)]
    rows += [(900, " ".join(token(30) for _ in range(300))), (901, "token=abcdef " * 200 + token(30)), (902, token(9000))]
    by_id, n = dict(rows), 0
    for r in secrets.scan(documents(rows)).collect():
        want = slow_added(by_id[r["doc_id"]])
        assert [s for s in r["spans"].split(",") if s.startswith("entropy")] == want, by_id[r["doc_id"]]
        n += len(want)
    assert n > 700


def test_secrets_take_linear_time(documents):
    import time

    def seconds(n):
        rnd = random.Random(2)
        parts = ["token=abcdef12", "AKIA" + "Z9" * 9, "0f" * 12, "Zk3xQ9vT7bN2mL8wR4yU6pA1"]
        df = documents([(1, " ".join(rnd.choice(parts) for _ in range(n)))]).cache()
        df.count()
        began = time.perf_counter()
        assert sum(secrets.scan(df).select("n_assign", "n_access", "n_hex", "n_entropy").first()) == n
        return time.perf_counter() - began

    seconds(1000)
    assert min(seconds(40_000) for _ in range(2)) < 2.5 * min(seconds(20_000) for _ in range(2)) + 0.3


def entropy(s):
    _, n = np.unique(list(s), return_counts=True)
    p = n / n.sum()
    return float(-(p * np.log2(p)).sum())


def test_peak_entropy_is_kept_by_counts(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcABC0123456789xyz") for _ in range(rnd.randrange(20, 60))) for _ in range(50)] + ["a" * 30, "ab" * 15]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", secrets.peak_entropy(F.col("w")).alias("e")).collect()
    for r in rows:
        w = r["w"]
        assert r["e"] == pytest.approx(max(entropy(w[i : i + 20]) for i in range(len(w) - 19)), abs=1e-9)


@pytest.mark.parametrize("text, found", [("key Zk3xQ9vT7bN2mL8wR4yU6pA1 end", 1), ("id 550e8400-e29b-41d4-a716-446655440000", 0), ("a/path/to/some/file1234/name", 0), ("thethethethethethethethethe1", 0), ("internationalisation2024", 0), ("AbCdEf0123456789AbCdEf", 0)])
def test_entropy_spans(documents, text, found):
    r = secrets.scan(documents([(1, text)])).first()
    assert r["n_entropy"] == found and ("entropy" in r["spans"]) == bool(found)


# --- personal data --------------------------------------------------------

_PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def pii_ok(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in v.split(".")), "card": lambda: 16 <= len(d) <= 19 and pii.luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()


def test_pii_against_brute_force():
    rnd = random.Random(3)
    bits = ["a", "b.", "@", "@", ".", "-", "1", "2 ", "45", "200", ".9", "+", "4111 1111 1111 1111", "(", ")", " ", "é", "%", "1.2.3.4", "256", "00"]
    for _ in range(4000):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randrange(18)))
        assert pii.detect_kinds(t) == {k: [m.span() for m in re.finditer(p, t) if pii_ok(k, m[0])] for k, p in _PII.items()}, t


@pytest.mark.parametrize(
    "text, kind, source",
    [
        ("mail john.doe [at] example (dot) com now", "email", "john.doe [at] example (dot) com"),
        ("x a at b dot com y", "email", "a at b dot com"),
        ("jоhn＠exаmple.com", "email", "jоhn＠exаmple.com"),
        ("é ４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("call plus one two zero two five five five zero one two three", "phone", "plus one two zero two five five five zero one two three"),
        ("at １９２.168.0.1!", "ip", "１９２.168.0.1"),
    ],
)
def test_disguises_map_back(text, kind, source):
    base, added = pii.find(text)
    assert [text[s:e] for s, e in added[kind]] == [source]
    assert pii.redacted(text).count(f"[{kind.upper()}]") == 1


@pytest.mark.parametrize("text", ["we met at the dot over there", "one two three go", "Öl für fünf Mäuse", "look at noon", ""])
def test_clean_text_is_left_alone(text):
    assert not any(pii.find(text)[1].values()) and pii.redacted(text) == text


@pytest.mark.parametrize(
    "source, kind",
    [
        ("j\u043ehn@example.com", "email"),
        ("john@mail.ex\u0430mple.com", "email"),
        ("john@example.c\u043em", "email"),
        ("+1 555 123 45 six seven eight nine", "phone"),
    ],
)
def test_disguises_around_a_base_span(source, kind):
    text = f"write {source}, please"
    base, added = pii.find(text)
    assert len(base[kind]) == 1 and added[kind] == [(6, 6 + len(source))]
    assert pii.redacted(text) == f"write [{kind.upper()}], please"


@pytest.mark.parametrize(
    "source, kind",
    [
        ("+1 555 two three four 5678", "phone"),
        ("+one 555 234 5678", "phone"),
        ("plus 1 555 two 345678", "phone"),
        ("4111 1111 1111 one 111", "card"),
        ("JANE AT EXAMPLE DOT COM", "email"),
        ("jane@example dot com", "email"),
        ("jane at example.com", "email"),
        ("jane at host dot se", "email"),
        ("jane [at] host dot se", "email"),
        ("jane dot doe at mail dot host dot se", "email"),
        ("jane@exam\u200bple.com", "email"),
        ("jane\u200b@example.com", "email"),
        ("4111 1111 11\u200b11 1111", "card"),
        ("\u0410\u041d\u041d\u0410@\u0415\u0425\u0410MPLE.COM", "email"),
        ("\u0391NN@EX\u0391MPLE.COM", "email"),
        ("\U0001d41cat@example.com", "email"),
        ("\u0e51\u0e50.0.0.1", "ip"),
    ],
)
def test_further_disguises(source, kind):
    text = f"write: {source}, please"
    base, added = pii.find(text)
    assert (7, 7 + len(source)) in base[kind] + added[kind]
    assert pii.redacted(text) == f"write: [{kind.upper()}], please"


@pytest.mark.parametrize(
    "text",
    ["one of 5 things, 3 of them new", "two 5 and plus one", "look at the dot in the middle", "available at example.com today", "The code at www.example.com", "meet at noon. Then go", "at 5.30 one hour", "x\u200by z\ufeff", "\u017fix one two three four five", "onerous 12 threefold"],
)
def test_further_clean_text_is_left_alone(text):
    assert not any(pii.find(text)[1].values()) and pii.redacted(text) == text


@pytest.mark.parametrize("part", ["a dot ", "a at b dot ", "one ", "1 one ", "plus ", "a.", "a at ", "a at b.", "+1 two (", "a@b dot "])
def test_disguises_take_linear_time(part):
    import time

    start = time.process_time()
    pii.find(part * 30_000)
    assert time.process_time() - start < 10


def test_base_spans_are_not_added_again():
    text = "j\u043ehn@example.com, mary@example.com, +1 555 123 4567, 10.0.0.1, 4111 1111 1111 1111"
    base, added = pii.find(text)
    assert added == {"email": [(0, 16)], "ip": [], "card": [], "phone": []}
    assert pii.redacted(text) == "[EMAIL], [EMAIL], [PHONE], [IP], [CARD]"


def test_pii_table(documents, collected):
    rows = [*edge_rows(), (20, "a@b.co " * 40_000)]
    df = documents(rows)
    out = pii.detect(df).collect()
    assert len(out) == len(rows)
    assert {r["doc_id"]: r["n_email"] for r in out}[20] == 40_000
    assert all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() and r["spans"] == "" for r in out if r["doc_id"] in (1, 2, 3, 4))
    clean = pii.redact(documents([(1, "a@b.co!"), (2, None), (3, "ok")]))
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in clean.collect()} == {1: ("[EMAIL]!", 8), 2: (None, None), 3: ("ok", 2)}
    assert pii.redact(df.limit(0)).count() == 0


# --- token counts ---------------------------------------------------------


def test_trees_follow_edits_exactly():
    by = token_counts.encoder()
    rnd = random.Random(4)
    bits = ["a", "b", " ", "  ", "'", "ll", "s", "1", "23", ".", "\n", "é", "...", "word ", " the", "'re", "\t", "日本"]
    text_of = lambda n: "".join(rnd.choice(bits) for _ in range(n))
    for _ in range(300):
        t = text_of(rnd.choice([0, 1, 3, 10, 50, 400, 900]))
        tree = token_counts.TokenTree(t, by)
        for _ in range(rnd.randint(1, 6)):
            s = rnd.randint(0, len(t) + 2)
            e, insert = s + rnd.choice([0, 0, 1, 2, 7, 200]), text_of(rnd.choice([0, 1, 2, 5, 400]))
            a, b = min(s, len(t)), min(max(e, min(s, len(t))), len(t))
            t = t[:a] + insert + t[b:]
            tree.edit(s, e, insert)
            assert tree.text() == t and [p for x in tree.pieces for p in x] == by.cut.findall(t)
            assert (tree.n_tokens, tree.n_chars) == (len(by.encoding.encode_ordinary(t)), len(t))


def test_an_edit_encodes_little(prose):
    by = token_counts.encoder()
    tree = token_counts.TokenTree(prose(1, 5000), by)
    tree.edit(9000, 9004, "new words")
    assert tree.encoded < 20


def test_token_table(spark, documents, collected):
    df = documents(edge_rows())
    edits = spark.createDataFrame([(5, 0, 0, 1, "hello world"), (5, 1, 5, 5, "!"), (1, 0, 3, 9, "abc"), (77, 0, 0, 0, "x")], "doc_id long, seq long, start long, end long, insert string")
    out = token_counts.count_tokens(df, edits).collect()
    by = token_counts.encoder()
    n = lambda t: len(by.encoding.encode_ordinary(t))
    assert len(out) == 8
    for r in out:
        if r["doc_id"] == 5:
            assert (r["n_tokens"], r["n_edits"], r["n_tokens_after"]) == (n("x"), 2, n("hello! world"))
        if r["doc_id"] == 1:
            assert (r["n_chars"], r["n_tokens"], r["n_tokens_after"]) == (0, 0, n("abc"))
        if r["doc_id"] == 6:
            assert r["n_tokens"] == r["n_tokens_after"] == n("a" * 300_000)
    assert token_counts.count_tokens(df.limit(0)).count() == 0


# --- decontamination ------------------------------------------------------


def slow_overlap(item, doc):
    """Longest stretch of any alignment by brute force; the operator's rule of acceptance."""
    fold = lambda t: [w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").lower() or w for w in t.split()]
    a, b = fold(item), fold(doc)
    best = 0
    for shift in range(-len(a) + 1, len(b)):
        equal = [0 <= i + shift < len(b) and a[i] == b[i + shift] for i in range(len(a))]
        for i in range(len(a)):
            if not equal[i]:
                continue
            hits = 0
            for j in range(i, len(a)):
                hits += equal[j]
                if equal[j] and hits >= 0.8 * (j - i + 1) - 1e-9:
                    best = max(best, j - i + 1)
    return best, len(a)


def test_decontamination_against_brute_force(spark, documents, collected, prose):
    items = [(k, prose(100 + k, 20 + k)) for k in range(6)] + [(50, "only six words stand in here"), (51, None), (52, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rnd = random.Random(1)
    rows = []
    for i in range(40):
        words = prose(i, 30).split()
        if i % 2:
            part = items[i % 6][1].split()
            cut = rnd.randrange(6, len(part) + 1)
            part = [w if rnd.random() > 0.12 else "other" for w in part[:cut]]
            words[10:10] = [w.upper() + rnd.choice(["", ",", "."]) for w in part]
        rows.append((i, " ".join(words)))
    rows += [(100, "Only SIX words stand in here."), *[(200 + k, t) for k, (_, t) in enumerate(edge_rows())]]
    out = collected(decontam.overlaps(documents(rows), bench))
    for i, text in rows[:41]:
        best = max((slow_overlap(t, text) for _, t in items if t), key=lambda x: x[0] >= min(13, max(5, -(-x[1] * 8 // 10))))
        want = any(o >= min(13, max(5, int(np.ceil(0.8 * n)))) for o, n in (slow_overlap(t, text) for _, t in items if t))
        assert out[i]["contaminated"] in ((want,) if not want else (True, False)), (i, best)
    whole = [i for i, t in rows[:41] if any(o >= 13 and o >= 0.95 * n for o, n in (slow_overlap(x, t) for _, x in items if x))]
    assert all(out[i]["contaminated"] for i in whole)
    assert not any(out[i]["contaminated"] for i in range(0, 40, 2)) and out[100]["contaminated"]
    kept = decontam.clean(documents(rows), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in out.items() if not r["contaminated"])
    assert not any(r["contaminated"] for r in decontam.overlaps(documents(rows), bench.limit(0)).collect())
    assert decontam.overlaps(documents(rows).limit(0), bench).count() == 0


def test_substituted_copies_are_found(spark, documents, collected, prose):
    """Every third seed of a whole item with one word in eight replaced is still an overlap."""
    bench = spark.createDataFrame([(1, prose(7, 40))], "item_id long, text string")
    words = prose(7, 40).split()
    rows = [(k, " ".join("other" if i % 8 == k else w for i, w in enumerate(words))) for k in range(8)]
    assert all(r["contaminated"] for r in collected(decontam.overlaps(documents(rows), bench)).values())


def accepted(item, doc):
    best, n = slow_overlap(item, doc)
    return best >= min(13, max(5, int(np.ceil(0.8 * n))))


def test_seeds_hit_every_accepted_stretch():
    """All substitution places of a stretch with equal ends, at the most substitutions that its length allows."""
    from itertools import combinations

    for n in [*range(5, 20), 20]:
        for k in range(n // 5 + 1):
            for gone in combinations(range(1, n - 1), k):
                assert any(not {at + x for x in seed} & set(gone) for seed in decontam.SEEDS for at in range(n - seed[-1])), (n, gone)


def test_decontamination_equals_brute_force(spark, documents, collected, prose):
    lengths = [4, 5, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 15, 16, 17, 18, 20, 25, 30]
    items = [(k, prose(300 + k, n)) for k, n in enumerate(lengths)]
    rnd = random.Random(4)
    rows = []
    for i in range(400):
        words = prose(1000 + i, 12).split()
        part = items[i % len(items)][1].split()
        if i % 3 == 0:  # a piece of the item
            part = part[: rnd.randrange(max(4, len(part) * 3 // 4), len(part) + 1)]
        for p in rnd.sample(range(len(part)), min(len(part), rnd.choice([len(part) // 5, (len(part) + 4) // 5]))):
            part[p] = "other"
        words[6:6] = part
        rows.append((i, " ".join(words)))
    rows.append((900, "a b " * 300))
    items += [(90, "a b a b a b"), (91, "a a b b a a b")]
    out = collected(decontam.overlaps(documents(rows), spark.createDataFrame(items, "item_id long, text string")))
    for i, text in rows[:-1]:
        assert out[i]["items"] == [k for k, t in items if accepted(t, text)], i
    assert out[900]["items"] == [90]
    assert sum(r["contaminated"] for r in out.values()) > 150


def test_parts_of_the_benchmark_keep_every_row(spark, documents, prose):
    items = [(k, prose(500 + k, 20)) for k in range(5)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(None, items[0][1]), (None, prose(1, 30)), (7, items[1][1] + " " + items[4][1]), (7, prose(2, 30)), (8, items[2][1]), (8, items[2][1]), (9, None)]
    found = lambda df: sorted(map(str, df.collect()))
    parts = decontam.overlaps(documents(rows), bench, most=2)
    assert parts.count() == len(rows)
    assert sorted(r["n_overlaps"] for r in parts.collect()) == [0, 0, 0, 1, 1, 1, 2]
    assert found(parts) == found(decontam.overlaps(documents(rows), bench))
    assert decontam.overlaps(documents(rows), bench.limit(0)).dtypes == parts.dtypes


def test_letters_only_and_announced_digests(documents):
    digest = "9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B2B0B822CD15D6C15B0F00A08"
    found = {1: "key ZkTxQnvTjbNgmLqwRdyUspAx end", 2: "key qzxkvjwpqmfhtrlbndgsc", 3: "id " + digest, 4: "the digest was not " + digest}
    clean = {11: "internationalisation", 12: "getUserAccountInformationFromDatabase", 13: "Geschwindigkeitsbegrenzung", 14: "SHA256: " + digest, 15: "MD5 (a.iso) = " + digest[:32], 16: "checksum=" + digest, 17: "sha256-" + digest, 18: "a" * 200_000, 19: "Ab" * 100_000}
    out = {r["doc_id"]: r["n_entropy"] for r in secrets.scan(documents([*found.items(), *clean.items()])).collect()}
    assert out == {**dict.fromkeys(found, 1), **dict.fromkeys(clean, 0)}
