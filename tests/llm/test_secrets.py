"""Secret scans against a brute-force version of the patterns, the battery and the false-discovery control."""

import hashlib
import math
import random
import re
import string
import time
from collections import Counter

import pytest

from sparkloom.llm import secrets

PATTERNS = (
    ("assign", re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
)
KINDS = ["assign", "access", "hex", "random"]


def _p(hit):
    """(class, p) of a run."""
    body = hit.rstrip("=")
    name = "decimal" if re.fullmatch("[0-9]+", body) else "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", body) else "base32" if re.fullmatch("[A-Z2-7]+", body) else "base64"
    alphabet, cells = secrets.ENCODINGS[name]
    plain = body.lower() if name == "hex" else body.replace("-", "+").replace("_", "/")
    n, k = len(plain), len(alphabet)
    phi = lambda z: math.erfc(-z / 2**0.5) / 2
    chi = sum((sum(c in cell for c in plain) - n * len(cell) / k) ** 2 / (n * len(cell) / k) for cell in cells)
    df, nc = len(cells) - 1, n * secrets.APART_CHI
    h = 1 - 2 / 3 * (df + nc) * (df + 3 * nc) / (df + 2 * nc) ** 2
    s, m = (df + 2 * nc) / (df + nc) ** 2, (h - 1) * (1 - 3 * h)
    p = [phi(((chi / (df + nc)) ** h - (1 + h * s * (h - 1 - 0.5 * (2 - h) * m * s))) / (h * math.sqrt(2 * s) * (1 + 0.5 * m * s)))]
    v = [alphabet.index(c) for c in plain]
    changes = sum((a >= k / 2) != (b >= k / 2) for a, b in zip(v, v[1:])) / (n - 1)
    p.append(phi((abs(changes - 0.5) - secrets.APART_RUNS) / math.sqrt((0.25 - secrets.APART_RUNS**2) / (n - 1))))
    mean = sum(v) / n
    spread = sum((x - mean) ** 2 for x in v)
    rho = abs(sum((a - mean) * (b - mean) for a, b in zip(v, v[1:])) / spread) if spread else 1
    p.append(phi((math.atanh(min(rho, 0.999999)) - math.atanh(secrets.APART_SERIAL)) * math.sqrt(n - 3)))
    return sum(n >= x for x in secrets.LENGTHS), max(p)


def brute(texts):
    """Spans of each text, (start, kind, end)."""
    base = [sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PATTERNS) for m in p.finditer(t or "") if ok(m)) for t in texts]
    tries = []
    for i, t in enumerate(texts):
        for m in re.finditer(secrets.RUN, t or ""):
            if re.search("[0-9]|[a-z][A-Z].*[a-z][A-Z]", m[0]) and not any(a < m.end() and m.start() < b for a, _, b in base[i]):
                tries.append((i, m.start(), m.end(), *_p(m[0])))
    out = [list(x) for x in base]
    for c in {x[3] for x in tries}:
        own = [(min(math.floor(-4 * math.log10(max(p, 1e-300))), secrets.BINS), i, a, b) for i, a, b, d, p in tries if d == c]
        good = [q for q in {x[0] for x in own} if q > 0 and 10 ** (-q / 4) <= secrets.FDR * sum(x[0] >= q for x in own) / len(own)]
        for q, i, a, b in own:
            if good and q >= min(good):
                out[i].append((a, 3, b))
    return [sorted(x) for x in out]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    b64, words = string.ascii_letters + string.digits + "+/", "the quick brown fox jumps over lazy dogs while servers handle Request data Version config user name".split()
    secret = lambda: "".join(rng.choices(rng.choice([b64, b64, "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789"]), k=rng.choice([20, 24, 31, 40, 64, 100]))) + rng.choice(["", "=", "=="])
    name = lambda: rng.choice(["_", "-", "/", ""]).join(w.capitalize() if rng.random() < 0.5 else w for w in rng.choices(words, k=rng.randint(4, 9))) + str(rng.randint(0, 99))
    out = []
    for _ in range(150):
        parts = [rng.choice([secret, name, lambda: rng.choice(words), lambda: f"Password: '{secret()}'", lambda: "api-key " + secret(), lambda: "é日本", lambda: "AKIA" + "Z9" * 6])() for _ in range(rng.randint(1, 8))]
        out.append(rng.choice([" ", "\n", ", ", " é "]).join(parts))
    return [*out, out[0], "", None, 'éa Password = "abcdefgh1" x', "secret=token:abcdefgh api-key api_key:12345678", "AKIA" + "A" * 12 + " AKIAAAA", "f" * 32 + " " + "a" * 31, "the-quick-brown-fox-jumps-over-the-lazy-dog-1", "my_very_long_identifier_token=abcdefgh" + "x1" * 20]


def test_spans(spark, texts):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    got = {r.doc_id: r for r in secrets.report(docs).collect()}
    want, n_random = brute(texts), Counter()
    for i, spans in enumerate(want):
        text = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        base = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans if k < 3)
        assert (got[i].spans, got[i].base_sha256) == (text, hashlib.sha256(base.encode()).hexdigest()), i
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex, got[i].n_random) == tuple(sum(s[1] == k for s in spans) for k in range(4))
        n_random[bool(re.search("quick|data|Version", texts[i] or ""))] += got[i].n_random
    assert n_random[False] + n_random[True] > 30
    redacted = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    for i, spans in enumerate(want):
        out, at = "", 0
        for a, _, b in spans:
            out += (texts[i][at:a] + "[secret]") if a >= at else ""
            at = max(at, b)
        assert redacted[i] == out + (texts[i] or "")[at:], i


def test_written_strings_stay(spark):
    names = [f"src/main/{a}{b}Controller{k}/handle_{b}_request" for k, (a, b) in enumerate((a, b) for a in ("User", "Order", "Payment", "Search") for b in ("Service", "Factory", "Manager", "Proxy"))]
    got = secrets.report(spark.createDataFrame(list(enumerate(names)), "doc_id long, text string")).collect()
    assert not any(r.spans for r in got)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(None, "password=abcdefgh"), (None, "password=abcdefgh"), (1, None)], "doc_id long, text string")
    assert Counter((r.doc_id, r.n_assign) for r in secrets.report(docs).collect()) == {(None, 1): 2, (1, 0): 1}
    assert secrets.report(docs.where("false")).count() == 0 and secrets.redact(docs.where("false")).count() == 0


def test_long_text_in_seconds(spark):
    rng = random.Random(1)
    hexes = ["".join(rng.choices("0123456789abcdef", k=33)) for _ in range(20_000)]
    tokens = ["".join(rng.choices(string.ascii_letters + string.digits, k=40)) for _ in range(5000)]
    text = " ".join(hexes + tokens)
    began = time.time()
    row = secrets.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).head()
    assert time.time() - began < 60 and row.n_hex == 20_000 and row.n_random > 3000  # quadratic: minutes
