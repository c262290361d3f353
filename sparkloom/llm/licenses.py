"""License scans by canonical digest. DataFrame operations only.

A text's canonical form has lower case, no copyright lines, equivalent spellings made one, and only its letters and
digits: neither punctuation nor white space, so that wrapping, hyphens and comment marks do not matter. Its SHA-256 is
looked up among the digests of known licences by a hash join. Entire texts are looked up: the whole document, each run
of consecutive paragraphs, since licences stand among prose, and each line, as notices do. A paragraph ends at a line
without letters or digits; a copyright line goes with its line break and ends none. ORACLE knows REGISTRY without the
full texts, and single paragraphs: it is right only for tables where neither full texts nor longer runs matter.

Scale: texts are scanned once and normalised once; parts are cut out of the normalised text. Only parts whose canonical
length some known licence has are hashed, and of those only what the join finds goes into the one shuffle, besides a
row of ids per document. Runs are found by where paragraphs start and end: for each known length, the starts moved by it
are intersected with the ends, in proportion to the paragraphs; with more than MOST_LENGTHS lengths each pair of a
start and an end is looked at. The known digests (known_texts, or a parameter table) are the small side, some thousand
rows of 64 bytes; a table of more than BROADCAST_ROWS is joined by shuffling digests, where a notice that many documents hold is
left to the planner's skew join.

Edge cases: null and empty texts, and texts without letters or digits, have no licence; equal lines of a text count once;
repeated rows each get a row; a very long text is held by one
task; other columns are ignored; an empty table gives no rows and an empty registry no licences.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

BROADCAST_ROWS = 100_000

#: Lengths up to so many are compared one by one; beyond, by their range.
MOST_LENGTHS = 1000

#: Equivalent spellings, as (text, text) on lower-case text. Hyphens and spaces inside words go anyway.
SPELLINGS = (("licence", "license"), ("organisation", "organization"), ("favour", "favor"), ("whilst", "while"), ("https://", ""), ("http://", ""), ("&", " and "))
#: A copyright line: it goes with its line break.
COPYRIGHT = r"^[^\p{L}\p{N}\n]*(?:copyright\b[^\n]*(?:©|\(c\)|[0-9]{4})|©|\(c\) *(?:copyright|[0-9]{4})|all rights reserved)[^\n]*\n?"
VERSION, OTHER, HOLDER = r"\bversion\b", r"[^\p{L}\p{N}\n]+", r"copyright(\n*)holder"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_REST = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

#: Names of licences, fixed values: identifier, and what notices call it.
NAMES = {
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD License"), "AGPL-3.0-only": ("GNU Affero General Public License, version 3", "GNU AGPL version 3"), "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"), "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License"), "BSL-1.0": ("Boost Software License, version 1.0", "Boost Software License 1.0"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero 1.0"), "EPL-2.0": ("Eclipse Public License, version 2.0", "Eclipse Public License 2.0"), "GPL-2.0-only": ("GNU General Public License, version 2", "GNU GPL version 2", "GPL version 2"),
    "GPL-3.0-only": ("GNU General Public License, version 3", "GNU GPL version 3", "GPL version 3"), "ISC": ("ISC License",), "LGPL-2.1-only": ("GNU Lesser General Public License, version 2.1", "GNU LGPL version 2.1"), "LGPL-3.0-only": ("GNU Lesser General Public License, version 3", "GNU LGPL version 3"),
    "MIT": ("MIT License", "MIT"), "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"), "Unlicense": ("Unlicense",), "Zlib": ("zlib License",),
    **{f"CC-{'-'.join(part)}-4.0": (f"CC {'-'.join(part)} 4.0", f"Creative Commons {words} 4.0 International License", f"Creative Commons {words} 4.0") for part, words in (
        (("BY",), "Attribution"), (("BY", "SA"), "Attribution-ShareAlike"), (("BY", "NC"), "Attribution-NonCommercial"), (("BY", "ND"), "Attribution-NoDerivatives"), (("BY", "NC", "SA"), "Attribution-NonCommercial-ShareAlike"), (("BY", "NC", "ND"), "Attribution-NonCommercial-NoDerivatives"))},
}
#: How notices of one line name them, fixed values.
SUBJECTS = ("", "This work is ", "This file is ", "This software is ", "This project is ", "This program is ", "This document is ", "The source code is ")
VERBS = ("Licensed under ", "Released under ", "Distributed under ", "Available under ", "Made available under ")
ARTICLES = ("", "the ", "a ", "the terms of the ")


def notices() -> list[tuple[str, str]]:
    """(identifier, text) of all notices that a subject, verb, article and name make, and of identifier lines."""
    out = [(name, f"SPDX-License-Identifier: {name}") for name in NAMES]
    return out + [(name, f"{s}{v.lower() if s else v}{a}{called}.") for name, all_ in NAMES.items() for called in all_ for s in SUBJECTS for v in VERBS for a in ARTICLES]


#: Short licences entire, and the Apache licence's own notice: (identifier, text).
SHORT_TEXTS = (
    ("MIT", _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_REST}"),
    ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_REST}"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
)
#: Known texts without the full ones.
REGISTRY = (*SHORT_TEXTS, *notices())

#: Full texts, as (identifier)[+variant].txt. Those of the GPL family do not say whether later versions are granted.
TEXTS = Path(__file__).parent / "license_texts"
#: What some copies leave out: the text before the first pattern (titles, addresses), and from the second on (appendices).
_GNU = ("Preamble\n", r"(?<=END OF TERMS AND CONDITIONS)\s")
_CC = ("By exercising the Licensed Rights", r"=+\s+Creative Commons is not a party")
CUTS = {"Apache-2.0": ("TERMS AND CONDITIONS FOR USE", _GNU[1]), "GPL-2.0-only": _GNU, "GPL-3.0-only": _GNU, "LGPL-2.1-only": _GNU, "LGPL-3.0-only": ("This version of the GNU", None), "MPL-2.0": (r"1\. Definitions", r"Exhibit A -"), "CC0-1.0": ("Statement of Purpose", None), "CC-BY-4.0": _CC, "CC-BY-SA-4.0": _CC, "Unlicense": (None, "For more information")}


def known_texts() -> tuple[tuple[str, str], ...]:
    """REGISTRY and the full texts, with and without what copies leave out."""
    out = list(REGISTRY)
    for path in sorted(TEXTS.glob("*.txt")):
        name, text = path.stem.partition("+")[0], path.read_text("utf-8")
        if name.startswith("BSD"):  # items with numbers or bullets, with or without the title
            title = f"BSD {name[4]}-Clause License\n\n"
            out += [(name, head + body) for head in ("", title, "The " + title) for body in (text, re.sub(r"(?m)^\s*\d\. ", "* ", text))]
            continue
        first, last = (x and re.search(x, text) for x in CUTS[name])
        for a in {0, first.start() if first else 0}:
            for b in {len(text), last.start() if last else len(text)}:
                out.append((name, text[a:b]))
                if "[yyyy]" in text[a:b]:  # as it is where a copyright line has been filled in
                    out.append((name, re.sub(r"\n *Copyright \[yyyy\][^\n]*", "", text[a:b])))
    return tuple(out)


def normalised(text: Column) -> Column:
    """The canonical form with the text's line breaks still in it."""
    text = F.regexp_replace(F.lower(text), "(?md)" + COPYRIGHT, "")
    for one, other in SPELLINGS:
        text = F.replace(text, F.lit(one), F.lit(other))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, VERSION, "v"), OTHER, ""), HOLDER, "copyright$1owner")


def canonical(text: Column) -> Column:
    """Letters and digits only, in lower case, without copyright lines, in one spelling. What has none becomes empty."""
    return _joined(normalised(text))


def _joined(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(""))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def known_digests(spark: SparkSession, registry: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """(license, digest, chars): the canonical digests of known texts (known_texts() by default), and the lengths of their canonical forms."""
    rows = spark.createDataFrame(list(known_texts() if registry is None else registry), "license string, text string")
    return rows.select("license", canonical(F.col("text")).alias("form")).where("form <> ''").groupBy(digest(F.col("form")).alias("digest")).agg(F.min("license").alias("license"), F.max(F.length("form")).alias("chars"))


def _running_sums(x: Column) -> Column:
    """The sums of an array's beginnings, in rounds that double the reach of each."""
    reaches = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda r: r < F.size(x))
    return F.aggregate(reaches, x, lambda sums, r: F.transform(sums, lambda s, i: s + F.coalesce(F.get(sums, F.when(i >= r, i - r)), F.lit(0))))


def _runs(lengths: list[int] | None, known: DataFrame, most: int) -> Column:
    """The runs of consecutive paragraphs that are as long as a known text; joined, starts and ends are columns."""
    if lengths is not None:
        some = F.filter(F.array(*[F.lit(n) for n in lengths or [-1]]), lambda n: n <= F.length("joined"))
        runs = F.transform(some, lambda n: F.transform(F.array_intersect(F.transform(F.col("starts"), lambda s: s + n), F.col("ends")), lambda e: F.struct((e - n).alias("s"), n.alias("n"))))
    else:
        held = bytearray(most + 1)
        for r in known.select("chars").distinct().collect():  # at most as many as the longest text has characters
            held[r.chars] = 1
        fits = lambda n: n.between(1, most) & (F.substring(F.lit(bytes(held)), n + 1, F.lit(1)) == F.lit(b"\x01"))
        runs = F.transform(F.array_distinct("starts"), lambda s: F.transform(F.filter(F.array_distinct("ends"), lambda e: fits(e - s)), lambda e: F.struct(s.alias("s"), (e - s).alias("n"))))
    return F.transform(F.flatten(runs), lambda x: F.substring(F.col("joined"), x["s"] + 1, x["n"]))


def _looked_up(docs: DataFrame, known: DataFrame | None) -> DataFrame:
    """scan(), and for each row of docs one more row whose part is empty."""
    known = stored(known_digests(docs.sparkSession) if known is None else known.select("license", "digest", "chars"), "licenses")
    n, least, most = known.agg(F.count("*"), F.min("chars"), F.max("chars")).head()
    lengths = known.select("chars").distinct()
    lengths = [r.chars for r in lengths.collect()] if n <= BROADCAST_ROWS and lengths.count() <= MOST_LENGTHS else None
    fits = lambda x: F.length(x).between(least or 0, most or 0) if lengths is None else F.array_contains(F.lit(lengths or [-1]), F.length(x))
    own = lambda kind, parts: F.transform(F.filter(parts, fits), lambda x: F.struct(F.lit(kind).alias("part"), digest(x).alias("digest")))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), normalised(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("form"))
    rows = rows.select("*", _joined(F.col("form")).alias("joined"), F.transform(F.split("form", "\n\n+"), _joined).alias("paragraphs"))
    rows = rows.withColumn("sizes", F.transform("paragraphs", F.length))
    # a single paragraph needs no sums, nor does a text that is shorter than all known ones
    several = (F.size("sizes") > 1) & (F.length("joined") >= F.lit(least or 0))
    rows = rows.withColumn("ends", F.when(several, _running_sums(F.col("sizes")))).withColumn("starts", F.zip_with("ends", "sizes", lambda e, n: e - n))
    runs = F.when(F.col("ends").isNotNull(), _runs(lengths, known, most or 0)).otherwise(F.array().cast("array<string>"))
    # the row that every document has gets a key of its own, which is no digest: no key is hot by it
    every = F.array(F.struct(F.lit("").alias("part"), F.col("row").cast("string").alias("digest")))
    parts = F.concat(every, own("text", F.array(F.col("joined"))), own("paragraph", F.col("paragraphs")), own("paragraph", runs), own("line", F.array_distinct(F.split("form", "\n"))))
    at = rows.select("row", "doc_id", F.explode(parts).alias("x")).select("row", "doc_id", "x.part", "x.digest")
    side = known.select("digest", "license")
    # rows are named once: what is written before the first shuffle keeps its names when a lost task runs again
    at = at.join(F.broadcast(side), "digest", "left") if n <= BROADCAST_ROWS else stored(at, "parts").join(side, "digest", "left")
    found = at.where("part = '' or license is not null").select("row", "doc_id", "part", "license", "digest")
    return stored(found, "notices") if n <= BROADCAST_ROWS else found


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """row, doc_id, part (text, paragraph for a run of paragraphs, or line), license, digest of each known text found; row is a number per row of docs.
    known: (license, digest, chars), as known_digests gives it."""
    return _looked_up(docs, known).where("part <> ''").distinct()


def report(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, license (of the entire text, or null), notices (licences of its paragraphs, runs of them, and lines, sorted, comma-joined), n_notices."""
    found = _looked_up(docs, known).groupBy("row", "doc_id").agg(F.min(F.when(F.col("part") == "text", F.col("license"))).alias("license"), F.sort_array(F.collect_set("license")).alias("all"))
    return found.select("doc_id", "license", F.array_join("all", ",").alias("notices"), F.size("all").cast("long").alias("n_notices"))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _oracle() -> str:
    form = f"regexp_replace(lower(text), {_sql('(?m)' + COPYRIGHT)}, '', 'g')"
    for one, other in SPELLINGS:
        form = f"replace({form}, {_sql(one)}, {_sql(other)})"
    for pattern, word in ((VERSION, "v"), (OTHER, ""), (HOLDER, r"copyright\1owner")):
        form = f"regexp_replace({form}, {_sql(pattern)}, {_sql(word)}, 'g')"
    one = lambda words: ", ".join(f"({_sql(w)})" for w in words)
    return f"""
WITH names(license, called) AS (VALUES {", ".join(f"({_sql(a)}, {_sql(b)})" for a, all_ in NAMES.items() for b in all_)}), s(s) AS (VALUES {one(SUBJECTS)}), v(v) AS (VALUES {one(VERBS)}), a(a) AS (VALUES {one(ARTICLES)}),
texts(license, text) AS (VALUES {", ".join(f"({_sql(a)}, {_sql(b)})" for a, b in SHORT_TEXTS)} UNION ALL SELECT DISTINCT license, 'SPDX-License-Identifier: ' || license FROM names
    UNION ALL SELECT license, s || v || a || called FROM names, s, v, a),
known AS (SELECT sha256(replace({form}, chr(10), '')) AS digest, min(license) AS license FROM texts GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, {form} AS form FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
p AS (SELECT r, 'text' AS part, replace(form, chr(10), '') AS x FROM d
    UNION ALL SELECT r, 'paragraph', replace(unnest(regexp_split_to_array(form, '\\n\\n+')), chr(10), '') FROM d
    UNION ALL SELECT r, 'line', unnest(string_split(form, chr(10))) FROM d),
f AS (SELECT r, min(license) FILTER (part = 'text') AS license, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(DISTINCT license) AS n FROM p JOIN known ON digest = sha256(x) WHERE x <> '' GROUP BY r)
SELECT doc_id, f.license, coalesce(notices, '') AS notices, CAST(coalesce(n, 0) AS BIGINT) AS n_notices FROM d LEFT JOIN f USING (r)
"""


ORACLE = _oracle()
