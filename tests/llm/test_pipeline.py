import hashlib
import random
import re

import pytest

import corpus_pipeline
from sparkloom.llm import quality

A_Z = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)


def _after_quality(docs):
    """Base rule only: no pool of the fixture has MIN_GROUP rows."""
    out = {}
    for d, t in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        covered = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 5)}
        if len(words) >= 10 and 100 * len(covered) <= 20 * len(words):
            out[d] = t
    return out


def _after_lines(docs):
    key = lambda x: A_Z(x.strip(" \t\n\x0b\x0c\r"))
    owner = {}
    for d in sorted(docs):
        for x in docs[d].split("\n"):
            owner.setdefault(key(x), d)
    return {d: "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or owner[key(x)] == d) for d, t in docs.items()}


def _after_near_duplicates(docs):
    sets = {}
    for d, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", A_Z(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    group = {d: d for d in sets}
    for _ in sets:
        for a, x in sets.items():
            for b, y in sets.items():
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    group[a] = group[b] = min(group[a], group[b])
    return {d: t for d, t in docs.items() if group[d] == d}


def _after_decontamination(docs, items):
    pattern, out = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", {}
    for d, t in docs.items():
        at = list(re.finditer(pattern, A_Z(t)))
        words, hit = [m[0] for m in at], set()
        for x in items:
            v = re.findall(pattern, A_Z(x))
            n = min(len(v), 10)
            windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        gone = set()
        for i in hit:  # from a run's first word to its last
            gone |= set(range(at[i].start(), at[i + 1].start() if i + 1 in hit else at[i].end()))
        out[d] = "".join(c for i, c in enumerate(t) if i not in gone)
    return out


def test_run_is_the_brute_force_pipeline(spark, tmp_path, monkeypatch):
    tokenizers = pytest.importorskip("public_tokenizers")
    load = pytest.importorskip("tiktoken.load")
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefgéß", k=rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, line, copy = prose(24), "A line that MANY documents hold", prose(120)
    docs = {1: "", 2: None, 3: "too short", 4: "the same five words again " * 12, 5: copy, 6: copy + " and an end", 7: copy.upper().lower() + " x", 8: prose(30) + ", " + passage + "; " + prose(20)}
    docs |= {d: prose(rng.randint(20, 90)) + "\n" + line.upper() + "  \n" + prose(15) for d in range(9, 20)}
    docs |= {20: prose(40) + "\n" + passage.capitalize() + "\n" + line, 21: passage, 22: line + "\n" + prose(9), 23: prose(12) + "\n" + prose(12)}
    docs |= {24: docs[23] + "\n" + line}
    items = [passage, prose(5), "!!"]
    monkeypatch.setattr(quality, "MIN_GROUP", 1000)
    frame = [(d, t, "en", "web", len(t or "")) for d, t in docs.items()]
    spark.createDataFrame(frame, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    wants = [_after_quality(docs)]
    wants.append(_after_lines(wants[-1]))
    wants.append(_after_near_duplicates(wants[-1]))
    wants.append(_after_decontamination(wants[-1], items))
    assert all(a != b for a, b in zip([docs, *wants], wants, strict=False))  # each stage has something to do
    got, stored = [], corpus_pipeline.stored

    def seen(df, tag):
        out = stored(df, tag)
        got.append({r.doc_id: (r.text, r.n_chars, r.lang, r.source) for r in out.collect()})
        return out

    monkeypatch.setattr(corpus_pipeline, "stored", seen)
    tokens = {r[0]: tuple(r)[1:] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == [{d: (t, len(t), "en", "web") for d, t in want.items()} for want in wants]
    coder = pytest.importorskip("tiktoken").Encoding("test", pat_str=tokenizers.PATTERN, mergeable_ranks=load.load_tiktoken_bpe(str(tokenizers.path("byte_bpe_50k.tiktoken"))), special_tokens={})
    assert {d: (x[0], x[2]) for d, x in tokens.items()} == {d: (len(coder.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for d, t in wants[-1].items()}
