"""Secret scans: fixed kinds, and strings that pass a battery of randomness tests. DataFrame operations only.

Base kinds are matched as their patterns say. The method adds spans of kind `random`: runs of RUN characters that overlap
no base span, in an encoding inferred from their characters (decimal, hex, base32 or base64 letters). The battery tests a
run of n symbols over an alphabet of k as an equivalence test: its null hypotheses say that the run is not random, by
what written strings deviate at least, so that a small p-value is evidence of randomness.
- Chi-squared alphabet uniformity, over the encoding's CELLS of symbols: the statistic under the null is non-central with
  n * APART_CHI, and p is its lower tail (Sankaran's approximation).
- Runs above and below the alphabet's middle: neighbours change sides with a share that is APART_RUNS off one half.
- Serial correlation of neighbours: APART_SERIAL either way (Fisher's transform).
A secret must be random in all three respects, so the run's p-value is the largest of the three (intersection-union). A
short run cannot give a small one: the tests' power grows with n. Within each length class Benjamini-Hochberg at FDR picks
runs from the p-values of all candidates of the input, by a histogram of -log10 p in quarters, rounded down (p rounded
up): no list of candidates is ever gathered.

Scale: texts are scanned once; found spans go to the shared folder, under names that stay. The histogram has at most
CLASSES * BINS rows. Positions and overlaps are found by running sums, maxima and minima in n log n steps, so a text of
a MB of matches takes seconds; a very long text is held by one task.

Positions are code points, ends exclusive. Edge cases: null and empty texts have no spans; repeated rows each count as
candidates and get a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running, stored

#: Fixed patterns, in the order of kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
#: Candidates: long runs of letters, digits and the signs of base64 with a digit, or letters in both cases.
RUN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: What written strings deviate by at least: words of European languages in the cells below by 0.8 and more, hence 0.6.
APART_CHI, APART_RUNS, APART_SERIAL = 0.6, 0.3, 0.6
FDR = 0.01
#: Alphabet of each encoding, and cells of the chi-squared test: frequent letters, others, upper case, digits and signs.
ENCODINGS = {
    "decimal": ("0123456789", ("01", "23", "45", "67", "89")),
    "hex": ("0123456789abcdef", ("01234", "56789", "abcdef")),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ("ETAOINSR", "BCDFGHJKLMPQUVWXYZ", "234567")),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", ("etaoinsr", "bcdfghjklmpquvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789+/")),
}
#: Lengths at which a length class begins, and bins of -log10 p in quarters.
LENGTHS, BINS = (20, 28, 40, 64), 60


def _found(text: Column, pattern: str) -> Column:
    """[struct(start, end, hit)]: where a pattern matches, from the pieces between its matches."""
    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))

    def places(x: Column) -> Column:
        ends = running(F.zip_with(F.slice(x["pieces"], F.lit(1), F.size(x["hits"])), x["hits"], lambda p, h: F.length(p) + F.length(h)), lambda a, b: a + b)
        return F.zip_with(ends, x["hits"], lambda e, h: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("hit")))

    return F.when(F.rlike(text, F.lit(pattern)), let(both, places)).otherwise(F.array().cast("array<struct<start:int,end:int,hit:string>>"))


def _spans(hits: Column, kind: int) -> Column:
    return F.transform(hits, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def _free(runs: Column, base: Column) -> Column:
    """The runs that overlap no base span: none before them ends, and none after them starts, inside them."""
    item = lambda x, is_base, hit: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(is_base).alias("base"), hit.alias("hit"))
    items = F.sort_array(F.concat(F.transform(base, lambda x: item(x, 1, F.lit(""))), F.transform(runs, lambda x: item(x, 0, x["hit"]))))
    last_end = running(F.transform(items, lambda x: F.when(x["base"] == 1, x["end"]).otherwise(0)), F.greatest)
    next_start = F.reverse(running(F.reverse(F.transform(items, lambda x: F.when(x["base"] == 1, x["start"]).otherwise((1 << 31) - 1))), F.least))
    both = F.arrays_zip(items.alias("x"), last_end.alias("a"), next_start.alias("b"))
    free = F.filter(both, lambda z: (z["x"]["base"] == 0) & (z["a"] <= z["x"]["start"]) & (z["b"] >= z["x"]["end"]))
    return F.when((F.size(base) == 0) | (F.size(runs) == 0), runs).otherwise(F.transform(free, lambda z: F.struct(z["x"]["start"].alias("start"), z["x"]["end"].alias("end"), z["x"]["hit"].alias("hit"))))


def _normal(z: str) -> str:
    """P(Z <= z) for a standard normal, to about 1e-7 of its size (a Chebyshev fit of the error function), as SQL."""
    a = f"(abs({z}) / sqrt(2D))"
    t = f"(1 / (1 + {a} / 2))"
    fit = "0.17087277D"
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        fit = f"({c}D + {t} * {fit})"
    tail = f"(0.5D * {t} * exp({fit} - {a} * {a}))"
    return f"IF({z} <= 0, {tail}, 1 - {tail})"


def battery(candidates: DataFrame) -> DataFrame:
    """candidates (hit ...) with encoding, n, p_chi, p_runs, p_serial and p, the largest: small if the run looks random."""
    by = lambda of: F.create_map(*[F.lit(x) for name, own in ENCODINGS.items() for x in (name, of(*own))])
    at = candidates.withColumn("body", F.regexp_replace("hit", "=+$", ""))
    encoding = F.when(at.body.rlike("^[0-9]+$"), "decimal").when(at.body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(at.body.rlike("^[A-Z2-7]+$"), "base32").otherwise("base64")
    at = at.withColumns({"encoding": encoding, "n": F.length("body").cast("double")})
    at = at.withColumn("plain", F.when(F.col("encoding") == "hex", F.lower("body")).otherwise(F.translate("body", "-_", "+/")))
    at = at.withColumns({"symbols": F.element_at(by(lambda symbols, cells: symbols), F.col("encoding")), "k": F.element_at(by(lambda symbols, cells: float(len(symbols))), F.col("encoding"))})
    # each symbol's cell as a digit
    celled = F.coalesce(*[F.when(F.col("encoding") == name, F.translate("plain", "".join(cells), "".join(str(j) * len(c) for j, c in enumerate(cells)))) for name, (_, cells) in ENCODINGS.items()])
    shares = F.element_at(by(lambda symbols, cells: F.array(*[F.lit(len(c) / len(symbols)) for c in cells])), F.col("encoding"))
    at = at.withColumns({"celled": celled, "shares": shares, "values": F.transform(F.slice(F.split("plain", ""), 1, F.length("plain")), lambda c: F.instr(F.col("symbols"), c).cast("double") - 1)})
    count = lambda j: F.length("celled") - F.length(F.replace(F.col("celled"), j.cast("string"), F.lit("")))
    chi = F.aggregate(F.transform("shares", lambda q, j: F.pow(count(j), F.lit(2)) / (F.col("n") * q)), F.lit(0.0), lambda a, x: a + x) - F.col("n")
    at = at.withColumns({"chi": chi, "mean": F.aggregate("values", F.lit(0.0), lambda a, x: a + x) / F.col("n")})
    pairs = F.sequence(F.lit(1), F.size("values") - 1)
    above = lambda i: F.get("values", i) >= F.col("k") / 2
    off = lambda x: x - F.col("mean")
    at = at.withColumns({
        "changes": F.aggregate(pairs, F.lit(0.0), lambda a, i: a + F.when(above(i) != above(i - 1), 1.0).otherwise(0.0)),
        "serial": F.aggregate(pairs, F.lit(0.0), lambda a, i: a + off(F.get("values", i)) * off(F.get("values", i - 1))),
        "spread": F.aggregate("values", F.lit(0.0), lambda a, x: a + off(x) * off(x)),
    }).drop("body", "plain", "symbols", "celled", "values")
    # Sankaran: a power of a non-central chi-squared variable is nearly normal
    at = at.selectExpr("*", "size(shares) - 1D AS df", f"n * {APART_CHI}D AS nc", "least(abs(IF(spread > 0, serial / spread, 1D)), 0.999999D) AS rho")
    at = at.selectExpr("*", "1 - 2 * (df + nc) * (df + 3 * nc) / (3 * power(df + 2 * nc, 2)) AS h", "(df + 2 * nc) / power(df + nc, 2) AS s").selectExpr("*", "(h - 1) * (1 - 3 * h) AS m")
    z_chi = "(power(greatest(chi, 0D) / (df + nc), h) - (1 + h * s * (h - 1 - 0.5D * (2 - h) * m * s))) / (h * sqrt(2 * s) * (1 + 0.5D * m * s))"
    z_runs = f"(abs(changes / (n - 1) - 0.5D) - {APART_RUNS}D) * sqrt(n - 1) / {math.sqrt(0.25 - APART_RUNS**2)}D"
    z_serial = f"(atanh(rho) - {math.atanh(APART_SERIAL)}D) * sqrt(n - 3)"
    at = at.selectExpr("*", f"{z_chi} AS z_chi", f"{z_runs} AS z_runs", f"{z_serial} AS z_serial")
    at = at.selectExpr("*", *[f"{_normal(f'z_{x}')} AS p_{x}" for x in ("chi", "runs", "serial")])
    return at.select(*candidates.columns, "encoding", F.col("n").cast("int").alias("n"), "p_chi", "p_runs", "p_serial", F.greatest("p_chi", "p_runs", "p_serial").alias("p"))


def random_runs(candidates: DataFrame, fdr: float = FDR) -> DataFrame:
    """The candidates that the false-discovery control over all candidates of their length class picks."""
    class_ = sum((F.when(F.col("n") >= x, 1).otherwise(0) for x in LENGTHS), F.lit(0))
    bin_ = F.least(F.floor(-4 * F.log10(F.greatest("p", F.lit(1e-300)))), F.lit(BINS)).cast("int")
    tested = stored(battery(candidates).drop("hit").withColumns({"class": class_, "bin": bin_}), "tested")
    bins = tested.groupBy("class", "bin").agg(F.count("*").alias("n"))
    at_least, all_ = bins.alias("a").join(bins.alias("b"), F.expr("a.class = b.class and b.bin >= a.bin")).groupBy("a.class", "a.bin").agg(F.sum("b.n").alias("rank")), bins.groupBy("class").agg(F.sum("n").alias("m"))
    # p of a bin is at most 10 ** (-bin / 4): the smallest bin whose p is within rank / m of the rate
    edge = at_least.join(all_, "class").where((F.col("bin") > 0) & (F.pow(F.lit(10.0), -F.col("bin") / 4) <= fdr * F.col("rank") / F.col("m"))).groupBy("class").agg(F.min("bin").alias("edge"))
    return tested.join(F.broadcast(edge), "class").where("bin >= edge")


def scan(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per document: row (a name of its own), doc_id, what is kept (text: null is empty), and spans as [struct(start, kind, end)] by start, then kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    assign = F.filter(_found(F.col("text"), ASSIGN), lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= 8)
    rows = rows.select("row", "doc_id", *keep, F.concat(_spans(assign, 0), _spans(_found(F.col("text"), ACCESS), 1), _spans(_found(F.col("text"), HEX), 2)).alias("base"), _found(F.col("text"), RUN).alias("runs"))
    mixed = lambda x: x["hit"].rlike("[0-9]") | x["hit"].rlike("[a-z][A-Z].*[a-z][A-Z]")
    rows = stored(rows.withColumn("runs", F.filter("runs", mixed)), "spans")  # names are drawn once: what is written keeps them
    tries = rows.where(F.size("runs") > 0).select("row", F.explode(_free(F.col("runs"), F.col("base"))).alias("x")).select("row", "x.start", "x.end", "x.hit")
    added = random_runs(tries).groupBy("row").agg(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "end")).alias("added"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return rows.join(added, "row", "left").select("row", "doc_id", *keep, F.sort_array(F.concat("base", F.coalesce("added", none))).alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """The contract's row per document."""
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] < 3)
    return scan(docs).select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), count(3).alias("n_random"))


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """doc_id and text with every span replaced; overlapping spans once, by one mask."""
    rows = scan(docs, "text")
    reach = running(F.transform("spans", lambda x: x["end"]), F.greatest)
    # a span that starts before all that came before it has ended goes on with their mask
    before = lambda i: F.when(i > 0, F.get("reach", i - 1)).otherwise(0)
    rows = rows.withColumn("reach", F.when(F.size("spans") > 0, reach).otherwise(F.array().cast("array<int>")))
    fresh = lambda x, i: (i == 0) | (x["start"] >= before(i))
    piece = F.transform("spans", lambda x, i: F.when(fresh(x, i), F.concat(F.substr(F.col("text"), before(i) + 1, x["start"] - before(i)), F.lit(mask))).otherwise(F.lit("")))
    last = F.coalesce(F.get("reach", F.size("reach") - 1), F.lit(0))
    return rows.select("doc_id", F.concat(F.array_join(piece, ""), F.substr(F.col("text"), last + 1, F.length("text"))).alias("text"))
