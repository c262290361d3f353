import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import bpe, chat, decontam, jaccard, licenses, line_dedup, quality, secrets, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words int, row string"
SPACES = " \t\n\x0b\x0c\r"


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 7))) for _ in range(60)]
    word = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, line = word(60), "A shared line, said TWICE " + word(4)
    out = {0: "", 1: None, 2: "one", 3: "  \n\t\n", 4: word(300), 5: line + "\n" + word(40), 6: word(20) + "\n  " + line.upper() + " \n" + word(30), 7: word(30) + " " + passage + " " + word(30), 8: passage + "\n" + word(50), 9: "x" * 500, 10: "one", 11: "x" * 450}
    out[12] = out[4].replace(vocabulary[0], "zz", 1)
    out[13] = out[12] + " end of it"
    out[14] = "a b c d"
    out[15] = "A  b c\nd"
    for i in range(16, 30):
        out[i] = out[4] if i % 5 == 0 else word(rng.randint(5, 80)) + rng.choice(["", " " + passage[:150], "\n" + line])
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(d, t, None if d % 7 == 0 else "en", None, None, 1, "r") for d, t in texts.items()], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


class TestBpe:
    @pytest.fixture(scope="class")
    def coder(self):
        tokenizers = pytest.importorskip("public_tokenizers")
        coder = bpe.Coder(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
        coder.path = tokenizers.path("byte_bpe_50k.tiktoken")
        return coder

    @pytest.fixture(scope="class")
    def library(self):
        tokenizers, load = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken.load")
        return pytest.importorskip("tiktoken").Encoding("test", pat_str=tokenizers.PATTERN, mergeable_ranks=load.load_tiktoken_bpe(str(tokenizers.path("byte_bpe_50k.tiktoken"))), special_tokens={})

    @pytest.mark.parametrize(("chunk", "overlap"), [(7, 3), (20, 8), (64, 20)])
    def test_stitched_chunks_are_one_pass(self, coder, library, chunk, overlap):
        rng = random.Random(1)
        for _ in range(300):
            text = "".join(rng.choices(["a", "'ll", "'", "\n", " ", "  ", "9", "12345678901234", "ß", "日本", "letters" * 9, "!?", " "], k=rng.randint(0, 60)))
            assert bpe.encode_long(coder, text, chunk, overlap) == coder.encode(text) == library.encode_ordinary(text)
            assert coder.decode(coder.encode(text)) == text.encode()

    def test_patterns(self, coder):
        for bad in (r"(?<=a)b|.", r"\w+\b", r"a(?=bc)|.", "^a|."):
            with pytest.raises(ValueError, match="stitched"):
                bpe.check_pattern(bad)
        gaps = bpe.Coder(coder.path, r"[a-z]+")  # what the pattern skips has no tokens
        for text in ("", "AB", "12abc34de5", "  abc" * 30):
            assert gaps.decode(gaps.encode(text)).decode() == "".join(re.findall("[a-z]+", text))
            assert bpe.encode_long(gaps, text, 7, 3) == gaps.encode(text)

    def test_report(self, spark, docs, texts, empty, coder, library):
        tokenizers = pytest.importorskip("public_tokenizers")
        where = tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN
        long = " ".join(str(i) for i in range(20_000))
        more = [(99, long), (99, long), (98, "a" * 80_000), (None, long), (None, "x"), (None, "x"), (97, ("word " + "b" * 2500) * 40)]
        got = bpe.report(docs.unionByName(spark.createDataFrame([(d, t, "en", "s", 1, 1, "r") for d, t in more], DOCS)), *where).collect()
        want = []
        for d, t in [*texts.items(), *more]:
            ids = library.encode_ordinary(t or "")
            want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(t or "")))
        assert Counter(map(tuple, got)) == Counter(want)
        assert bpe.report(empty, *where).count() == 0
        assert rows(bpe.decode(bpe.encode(docs, *where), *where))[4].data.decode() == texts[4]


@pytest.mark.parametrize("shard_bytes", [1 << 20, 300])
def test_decontaminate(spark, docs, texts, empty, monkeypatch, shard_bytes):
    monkeypatch.setattr(decontam, "SHARD_BYTES", shard_bytes)
    rng = random.Random(3)
    source = [t.split() for t in texts.values() if t and len(t.split()) > 30]
    items = [(i, " ".join(w[a : a + rng.choice([1, 3, 9, 10, 12, 25])]).upper() if i % 2 else " ".join(w[a : a + rng.choice([3, 10, 14])])) for i in range(25) for w in [rng.choice(source)] for a in [rng.randrange(20)]] + [(90, None), (91, "!!")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    got, cut = rows(decontam.report(docs, benchmark)), {}
    for d, t in texts.items():
        w, hit, found = words(t), set(), set()
        for i, x in items:
            v = words(x)
            n = min(len(v), 10)
            windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found.add(str(i))
        assert tuple(got[d])[1:] == (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)), d
        at = list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
        gone = {c for i in hit for c in range(at[i].start(), at[i + 1].start() if i + 1 in hit else at[i].end())}
        cut[d] = t if t is None else "".join(c for i, c in enumerate(t) if i not in gone)
    named = docs.withColumnRenamed("row", "meta.url")
    clean = decontam.decontaminate(named, benchmark)
    assert clean.columns == named.columns and {r.doc_id: r.text for r in clean.collect()} == cut
    assert decontam.report(empty, benchmark).count() == 0
    assert not any(r.contaminated for r in decontam.report(docs, benchmark.limit(0)).collect())


def test_jaccard_groups(docs, texts, empty):
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    group = {d: d for d in sets}
    for _ in sets:
        for a, x in sets.items():
            for b, y in sets.items():
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    group[a] = group[b] = min(group[a], group[b])
    got = rows(jaccard.report(docs))
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == {d: (len(sets[d]), group[d]) for d in sets}
    assert jaccard.report(empty).count() == 0
    named = docs.withColumnRenamed("row", "meta.url")
    kept = jaccard.first_of_group(named)
    assert kept.columns == named.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d in group if group[d] == d)


def test_jaccard_of_repeated_ids(spark):
    rng = random.Random(8)
    a, b, c = (" ".join(str(rng.random()) for _ in range(40)) for _ in range(3))
    made = [(5, a), (5, b), (5, a), (7, a + " x"), (9, b + " y"), (3, b + " z"), (11, c), (None, a), (None, a), (12, c + " w"), (13, None), (13, None)]
    got = Counter((r.doc_id, r.component_id) for r in jaccard.report(spark.createDataFrame(made, "doc_id long, text string")).collect())
    assert got == {(5, 3): 3, (7, 3): 1, (9, 3): 1, (3, 3): 1, (11, 11): 1, (12, 11): 1, (None, None): 2, (13, 13): 2}


def test_search_finds_all_partners():
    rng = np.random.default_rng(1)
    base = rng.integers(1, 1 << 60, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(20, 60), replace=False), rng.integers(1, 1 << 60, rng.integers(0, 9), dtype=np.uint64)])) for _ in range(120)]
    index = jaccard.Index(sets)
    for q in sets:
        assert set(index.search(q).tolist()) == {k for k, s in enumerate(sets) if 9 * len(np.intersect1d(q, s)) >= 4 * (len(q) + len(s))}


def test_large_blocks_give_the_same_groups(docs, monkeypatch):
    before = {d: r.component_id for d, r in rows(jaccard.report(docs)).items()}
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 200)
    monkeypatch.setattr(jaccard, "SHORT", 2)
    assert {d: r.component_id for d, r in rows(jaccard.report(docs)).items()} == before


def test_line_dedup(spark, docs, texts, empty):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(SPACES))
    held = {}
    for d, t in texts.items():
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(d)
    gone = lambda d, x: len(key(x)) >= 10 and len(held[key(x)]) > 1 and min(held[key(x)]) != d
    got = rows(line_dedup.report(docs))
    for d, t in texts.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if not gone(d, x)]
        assert tuple(got[d])[1:] == (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    assert line_dedup.report(empty).count() == 0
    clean = line_dedup.dedup(docs)
    assert clean.columns == docs.columns
    assert {r.doc_id: r.text for r in clean.collect()} == {d: t if t is None else "\n".join(x for x in t.split("\n") if not gone(d, x)) for d, t in texts.items()}


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    k1, k2 = (rng.integers(-(1 << 63), (1 << 63) - 1, 20_000) for _ in range(2))
    f = line_dedup.Cuckoo.build(k1, k2)
    assert f.contains(k1, k2).all() and f.contains(k2, k1).mean() < 0.01
    f.delete(k1[:10_000], k2[:10_000])
    assert f.contains(k1[10_000:], k2[10_000:]).all() and f.contains(k1[:10_000], k2[:10_000]).mean() < 0.01


def _deduped(held):
    """Brute force: the documents without the lines that a smaller doc_id holds."""
    owner, out = {}, {}
    for d in sorted(held):
        for x in set(held[d].lower().split("\n")):
            owner.setdefault(x, d)
        out[d] = "\n".join(x for x in held[d].split("\n") if len(x) < 10 or owner[x.lower()] == d)
    return out


@pytest.mark.parametrize(("shard_keys", "filter_bytes"), [(1 << 20, 64 << 20), (5000, 0)])
def test_line_store_beyond_its_first_filters(spark, monkeypatch, shard_keys, filter_bytes):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", shard_keys)
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", filter_bytes)
    lines = lambda a, b: "\n".join(f"Line number {k} of many" for k in range(a, b))
    frame = lambda held: spark.createDataFrame(list(held.items()), "doc_id long, text string")
    store, held = line_dedup.LineStore(spark, shards=1), {}
    got = lambda: {r.doc_id: r.text for r in store.dedup(frame(held)).collect()}
    for batch in ({1: lines(0, 9000), 2: lines(5000, 9000) + "\nshort\nown line of 2"}, {3: lines(4000, 40_000), 4: lines(0, 40_000) + "\nshort"}):
        held |= batch
        store.insert(frame(batch))
        assert got() == _deduped(held)
    del held[1], held[3]
    store.delete(spark.createDataFrame([(1,), (3,)], "doc_id long"))
    assert got() == _deduped(held)
    held |= {2: lines(30_000, 41_000), 5: lines(0, 500)}
    store.insert(frame({d: held[d] for d in (2, 5)}))
    assert got() == _deduped(held)
    assert (store.shards > 1) == (shard_keys == 5000)


def test_line_store_is_a_rebuild_after_any_batches(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MOST_SEGMENTS", 3)
    rng, held = random.Random(6), {}
    frame = lambda made: spark.createDataFrame(list(made.items()), "doc_id long, text string")
    store = line_dedup.LineStore(spark, shards=2)
    for k in range(5):
        if k % 3 == 2:
            gone = rng.sample(sorted(held), 4) + [999]
            store.delete(spark.createDataFrame([(d,) for d in gone], "doc_id long"))
            held = {d: t for d, t in held.items() if d not in gone}
        else:
            batch = {d: "\n".join(f"Line {rng.randint(0, 40)} of a store" for _ in range(rng.randint(0, 12))) for d in rng.sample(range(30), 9)}
            store.insert(frame(batch))
            held |= batch
        if k in (0, 1, 2):
            continue
        fresh = line_dedup.LineStore(spark, shards=2)
        fresh.insert(frame(held))
        state = lambda s: [Counter(map(tuple, x.collect())) for x in (s.pairs(), s.counts())]
        assert state(store) == state(fresh) and store.shared == fresh.shared
        assert {r.doc_id: r.text for r in store.dedup(frame(held)).collect()} == _deduped(held)


def test_suffix_dedup(docs, texts, empty):
    raws = {d: (t or "").encode() for d, t in texts.items()}
    seen, gone = set(), {d: set() for d in raws}
    for d, raw in sorted(raws.items()):
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[d] |= set(range(i, i + 100))
            seen.add(raw[i : i + 100])
    got = rows(suffix_dedup.report(docs))
    for d, raw in raws.items():
        spans = sum(i - 1 not in gone[d] for i in gone[d])
        assert tuple(got[d])[1:] == (len(raw), len(gone[d]), spans, sha(bytes(b for i, b in enumerate(raw) if i not in gone[d]))), d
    assert suffix_dedup.report(empty).count() == 0


def test_suffix_dedup_of_crowded_fingerprints(spark, docs, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    short, long_ = " ".join(word() for _ in range(12)), " ".join(word() for _ in range(18))
    made = [(d, " ".join(word() for _ in range(9)) + (short if d % 3 else long_) + rng.choice(["x" * 30, "y" * 40, ""]) + " ".join(word() for _ in range(9))) for d in range(5000, 5060)]
    made = spark.createDataFrame(made, "doc_id long, text string").repartition(4).unionByName(docs.select("doc_id", "text")).cache()
    want = rows(suffix_dedup.report(made))
    assert sum(x["n_removed"] > 0 for x in want.values()) > 30
    monkeypatch.setattr(suffix_dedup, "LEAVES", 1)
    assert rows(suffix_dedup.report(made)) == want
    monkeypatch.setattr(suffix_dedup, "MOST_BLOOM", 0)
    assert rows(suffix_dedup.report(made)) == want
    clean = suffix_dedup.dedup(made.withColumn("a.b", F.lit(1)))
    texts_ = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == ["doc_id", "text", "a.b"] and all(sha(t) == want[d].kept_sha256 for d, t in texts_.items() if (t or "").isascii())


def test_suffix_dedup_of_equal_rows(spark):
    text = " ".join(str(n * n) for n in range(90))
    made = [(4, text), (4, text), (4, text), (None, text[:300] + "q"), (None, text[:300] + "q"), (9, "z" + text)]
    got = suffix_dedup.report(spark.createDataFrame(made, "doc_id long, text string").repartition(3)).collect()
    assert sorted((x["doc_id"] or 99, x["n_removed"]) for x in got) == [(4, 0)] * 3 + [(9, len(text)), (99, 300), (99, 300)]


def test_quality_counts(docs, texts, empty):
    got = rows(quality.report(docs))
    for d, t in texts.items():
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if x.strip(SPACES)]
        n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        twice = {i + k for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for k in range(5)}
        failed = len(w) < 10 or 100 * len(twice) > 20 * len(w)
        assert tuple(got[d])[1:7] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice), failed)
        assert got[d].kept == (not failed)  # too few rows here for an estimate
    assert quality.report(empty).count() == 0


def test_quality_keeps_and_rejects_rows_not_ids(spark):
    good = "twelve plain words of which none comes twice in this short line"
    made = [(None, "too short", "en", "a"), (None, good, "en", "a"), (1, good, "en", "a"), (1, "too short", "en", "a"), (2, good, None, None), (2, good, None, None), (3, None, None, "a")]
    made = spark.createDataFrame([(*x, k) for k, x in enumerate(made)], "doc_id long, text string, lang string, source string, `a.b` int")
    got = quality.kept(made)
    assert got.columns == made.columns and sorted(r["a.b"] for r in got.collect()) == [1, 2, 4, 5]


def test_mcd_rejects_outliers(spark):
    rng = random.Random(2)
    words = [" ".join("".join(rng.choices("etaoinshr", k=rng.randint(2, 8))) for _ in range(80)) for _ in range(90)]
    junk = [x.replace(" ", " $$$ ") for x in words[:12]]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(words + junk)], "doc_id long, text string, lang string, source string")
    assert {d for d, r in rows(quality.report(docs)).items() if not r.kept} == set(range(90, 102))
    assert quality.kept(docs).count() == 90


def _mcd(x):
    """Brute force: mean and covariance of the same starts and steps, in NumPy."""
    floor, d, n = np.array(quality.FLOOR), x.shape[1], len(x)
    quantile = lambda v, q: np.sort(v, axis=0)[int(np.ceil(q * n)) - 1]
    low, middle, high = (quantile(x, q) for q in (0.25, 0.5, 0.75))
    scale = floor + (high - low) / 1.349
    z = (x - middle) / scale
    ests = []
    for name, u in (("clip", np.clip(z, -2, 2)), ("independent", None), ("sign", z / np.sqrt((z * z).sum(1) + 1e-12)[:, None]), ("tanh", np.tanh(z))):
        c = np.eye(d)
        if u is not None:
            q = u.T @ u / n
            e = np.diag(q) + 1e-9
            c = q / np.sqrt(np.outer(e, e))
            np.fill_diagonal(c, 1)
        ests.append((0, name, middle, (c + 0.1 * np.eye(d)) * np.outer(scale, scale)))

    def step(est):
        y = x - est[2]
        far = np.einsum("ij,ij->i", y, np.linalg.solve(est[3], y.T).T)
        near = x[far <= quantile(far, 0.75)]
        c = quality.CONSISTENCY * (near.T @ near / len(near) - np.outer(near.mean(0), near.mean(0)) + np.diag(floor**2))
        return np.linalg.slogdet(c)[1], est[1], near.mean(0), c

    for _ in range(quality.FIRST_STEPS):
        ests = [step(e) for e in ests]
    best = min(ests, key=lambda e: e[:2])
    while True:
        last, best = best, step(best)
        if last[0] - best[0] <= quality.SETTLED:
            return best


def test_mcd_is_that_of_numpy(spark):
    rng = np.random.default_rng(4)
    made = []
    # en/a and de/b are large; en/c is judged with all of en, fr/d and null/null with all rows
    for lang, source, n in (("en", "a", 200), ("de", "b", 90), ("en", "c", 12), ("fr", "d", 5), (None, None, 5)):
        for _ in range(n):
            words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(rng.integers(12, 90))]
            words = [w.capitalize() if rng.random() < 0.1 else w for w in words]
            if rng.random() < 0.08:
                words = [w + rng.choice(["###", "!!!", "."]) for w in words]
            if rng.random() < 0.05:
                words = [w.upper() for w in words]
            made.append((len(made), " ".join(words) + "\n" + " ".join(words[:4]) + ".", lang, source))
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string")
    counted = [r for r in quality.counts(docs).collect() if not r.base_failed]
    got = {r.doc_id: r for r in quality.judged(docs).collect()}
    pick = lambda f: np.array([[r[c] for c in quality.FEATURES] for r in counted if f(r)])
    fits = {"2" + '{"lang":"en","source":"a"}': lambda r: (r.lang, r.source) == ("en", "a"), "2" + '{"lang":"de","source":"b"}': lambda r: r.lang == "de", "1" + '{"lang":"en"}': lambda r: r.lang == "en", "0": lambda r: True}
    assert {r.judged_in for r in got.values() if not r.base_failed} == set(fits) and sum(not r.kept for r in got.values()) > 10
    for name, f in fits.items():
        _, _, mean, cov = _mcd(pick(f))
        for r in counted:
            if got[r.doc_id].judged_in == name:
                y = np.array([r[c] for c in quality.FEATURES]) - mean
                far = y @ np.linalg.solve(cov, y)
                assert abs(got[r.doc_id].distance2 - far) <= 1e-6 * (1 + far) and got[r.doc_id].kept == (far <= quality.CUTOFF)


def test_licenses(spark, empty):
    mit = licenses.REGISTRY[0][1]
    texts = {1: mit, 2: "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ;"), 3: "prose\nReleased under the MIT Licence.\nmore", 4: "prose about a license", 5: None}
    got = rows(licenses.report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert [(got[d].license, got[d].notices) for d in texts] == [("MIT", "MIT"), ("MIT", "MIT"), (None, "MIT"), (None, ""), (None, "")]
    assert licenses.report(empty).count() == 0
    none = licenses.known_digests(spark).where("false")
    assert {r.n_notices for r in licenses.report(spark.createDataFrame([(1, mit)], "doc_id long, text string"), none).collect()} == {0}


def test_license_forms(spark, monkeypatch):
    isc, mit = licenses.REGISTRY[3][1], licenses.REGISTRY[0][1]
    wrapped = "\n".join(" * " + x for x in isc.replace("fee is", "fee\nis").split("\n"))
    texts = {
        1: wrapped, 2: "=" * 9000 + "\n" + "\n".join(mit.split(". ")), 3: "-- " * 3000 + "released under the MIT license" + " !" * 3000, 4: mit.replace(", to any", ",\n(c) 2021 Some One\nto any").replace("COPYRIGHT HOLDERS", "COPYRIGHT\nOWNERS"),
        5: "prose\n\n" + mit.split("\n\n")[0] + "\n\nprose", 6: "prose\n\n" + isc.replace("\n\n", "\n") + "\n \t\nprose", 7: "Licensed under the Apache Licence,\nv. 2.0\n\nLicensed under CC-BY 4.0\nLicensed under CC-BY 4.0", 8: "© 2020 x", 9: "!!",
    }
    want = {1: ("ISC", "ISC"), 2: ("MIT", "MIT"), 3: ("MIT", "MIT"), 4: ("MIT", "MIT"), 5: (None, ""), 6: (None, "ISC"), 7: (None, "Apache-2.0,CC-BY-4.0"), 8: (None, ""), 9: (None, "")}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {d: (r.license, r.notices) for d, r in rows(licenses.report(docs)).items()} == want
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", 0)  # a large registry: a shuffle, and a range of lengths
    assert {d: (r.license, r.notices) for d, r in rows(licenses.report(docs)).items()} == want
    assert {(r.doc_id, r.part) for r in licenses.scan(docs).collect()} >= {(1, "text"), (6, "paragraph"), (7, "line"), (7, "paragraph")}


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_full_licenses_among_paragraphs(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", broadcast_rows)
    read = lambda name: (licenses.TEXTS / f"{name}.txt").read_text()
    names = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "Unlicense"]
    mit, bsd, gpl = licenses.REGISTRY[0][1], read("BSD-3-Clause"), read("GPL-2.0-only")
    texts = {k: (read(name), (name, name)) for k, name in enumerate(names)}
    texts |= {100 + k: (f"Prose é above.\n\nMore.\n\n{read(name)}\n\nprose below\n\n\nend", (None, name)) for k, name in enumerate(names)}
    texts |= {
        200: ("above\n\n" + mit + "\n\nbelow\n\n" + bsd + "\n----\n" + mit, (None, "BSD-3-Clause,MIT")), 201: ("\n\nCopyright (c) 2020 X\nAll rights reserved.\n\n" + bsd.replace("\n\n", "\n").replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "), ("BSD-3-Clause", "BSD-3-Clause")),
        202: ("Title\n\n" + gpl[gpl.index("Preamble") : gpl.index("How to Apply")], (None, "GPL-2.0-only")), 203: (read("Apache-2.0").replace("[yyyy] [name of copyright owner]", "2021 Someone"), ("Apache-2.0", "Apache-2.0")),
        204: ("above\n\n" + mit.replace("without restriction", "with restriction") + "\n\nbelow", (None, "")), 205: ("x\n\n" * 3000 + mit + "\n\ny" * 3000, (None, "MIT")), 206: ("above " + mit + "\n\nbelow", (None, "")),
    }
    docs = spark.createDataFrame([(d, t) for d, (t, _) in texts.items()], "doc_id long, text string")
    got = {d: (r.license, r.notices) for d, r in rows(licenses.report(docs)).items()}
    assert got == {d: want for d, (_, want) in texts.items()}


def test_nulls_and_repeated_rows(spark):
    line, words = "a line of more than ten characters", "one two three four five six seven eight nine ten"
    made = [(None, line), (None, line), (2, line), (2, line), (None, None), (3, words), (3, words), (None, words), (4, "")]
    docs = spark.createDataFrame([(*x, 1) for x in made], "doc_id long, text string, `a.b` int")
    benchmark = spark.createDataFrame([(None, words), (1, None)], "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontam.report(docs, benchmark).collect())
    assert got == {(None, 7, 0, 0): 2, (2, 7, 0, 0): 2, (None, 0, 0, 0): 1, (3, 10, 10, 1): 2, (None, 10, 10, 1): 1, (4, 0, 0, 0): 1}
    got = Counter((r.doc_id, r.n_lines, r.n_dropped) for r in line_dedup.report(docs).collect())
    assert got == {(None, 1, 1): 3, (2, 1, 0): 2, (None, 1, 0): 1, (3, 1, 0): 2, (4, 1, 0): 1}
    got = Counter((r.doc_id, r.n_notices) for r in licenses.report(docs.unionByName(spark.createDataFrame([(8, "Released under the ISC Licence", 1)] * 2, docs.schema))).collect())
    assert got == {(None, 0): 4, (2, 0): 2, (3, 0): 2, (4, 0): 1, (8, 1): 2}
    got = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.report(docs).collect())
    assert got == {(None, len(line), 0): 2, (2, len(line), 0): 2, (None, 0, 0): 1, (3, len(words), 0): 2, (None, len(words), 0): 1, (4, 0, 0): 1}


def test_chat_edges(spark):
    turns = [(None, 0, "user", "a"), (None, 1, "assistant", None), (5, None, "user", "x"), (5, 1, "assistant", "y"), (5, 1, "assistant", "y")]
    chats = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, segments int")
    got = {r.conv_id: r for r in chat.report(chats).collect()}
    assert {c: (r.n_turns, r.loss_chars, r.valid) for c, r in got.items()} == {None: (2, 0, True), 5: (3, 2, False)}
    assert chat.report(chats.where("false")).count() == 0


def test_chat(spark):
    turns = [(1, 0, "user", "### a </turn> \\h \\"), (1, 1, "assistant", "######\\b"), (2, 0, "assistant", "x"), (3, 0, None, None), (4, 1, "assistant", "b"), (4, 0, "user", "a"), (4, 1, "assistant", "b")]
    rows_ = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, valid int")
    got = rows(chat.report(rows_.select("conv_id", "turn", "role", "text").unionByName(chat.probe(spark))), "conv_id")
    both = turns + [(-7, k, r, "\\### Assistant: </turn> ok") for k, r in enumerate(("user", "assistant"))]
    for c in {t[0] for t in both}:
        own = sorted((t[1], t[2] or "", t[3] or "") for t in both if t[0] == c)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(own), sha("".join(f"{r}\n{x}\n" for _, r, x in own)), len(loss), sha(loss))
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: False, 3: False, 4: False, -7: True}
