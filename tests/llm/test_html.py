"""HTML extraction against a brute-force renderer: pages and their texts are made side by side from random trees."""

import random
import time

import pytest

from sparkloom.llm import html_text

WORDS = "wind paper été 日本 stone a river & light <x> house".split()


def _escape(s):
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _wide(s):
    return sum(2 if c in "日本" else 1 for c in s)


class Maker:
    """make(...) gives (html, tokens); a token is a line, or None for a blank line between what stands around it."""

    def __init__(self, seed):
        self.rng = random.Random(seed)

    def tag(self, name, body, optional=False, attributes=""):
        name = name.upper() if self.rng.random() < 0.2 else name
        end = "" if optional and self.rng.random() < 0.5 else f"</{name}>"
        return f"<{name}{attributes}>{body}{end}"

    def noise(self):
        return self.rng.choice(["", "", "\n  ", "<!-- <p>no --> ", "<script>if (a<b) '</p>'</script>", "<div hidden>no<p>no</div>", "<b style='color:red; display : none'>no</b>", "<template><p>no</template>", "<i style='visibility:hidden'>no</i>"])

    def words(self, n=4):
        return [self.rng.choice(WORDS) for _ in range(self.rng.randint(1, n))]

    def inline(self):
        w = self.words()
        gap = self.rng.choice([" ", "\n ", " \t", " <!--x--> "])
        return gap.join(self.rng.choice(["{}", "<b>{}</b>", "<a href='x>y' title=it's>{}</a>", "<span style=\"visibility:hidden\">no<i style='visibility:visible'>{}</i></span>"]).format(_escape(x)) for x in w), " ".join(w)

    def paragraph(self):
        h, t = self.inline()
        name = self.rng.choice(["p", "h2", "blockquote"])
        return self.tag(name, h, name == "p"), [None, t, None]

    def line(self):
        h, t = self.inline()
        return self.tag("div", h), [t]

    def breaks(self):
        (a, x), (b, y) = self.inline(), self.inline()
        return self.tag("p", f"{a} <br> {b}", True), [None, x, y, None]

    def pre(self):
        w = [self.rng.choice(["  x", "y   z", "", "\tq"]) for _ in range(3)] + ["end"]
        return self.tag("pre", "\n" + _escape("\n".join(["top", *w])) + "\n"), [None, "top", *w, None]

    def items(self, depth=0):
        ordered = self.rng.random() < 0.4
        body, tokens, n = "", [], self.rng.choice([1, 1, 9])
        start = f" start={n}" if ordered and n != 1 else ""
        for _ in range(self.rng.randint(1, 3)):
            h, t = self.inline()
            mark = f"{n}. ".rjust(4) if ordered else "  - "
            n += 1
            own = [(" " * (6 + 4 * depth))[: -len(mark)] + mark + t]
            if depth < 3 and self.rng.random() < 0.4:
                inner, more = self.items(depth + 1)
                h, own = h + inner, own + more
            body += self.tag("li", h + self.noise(), True)
            tokens += own
        out = self.tag("ol" if ordered else "ul", body, attributes=start)
        return out, tokens if depth else [None, *tokens, None]

    def table(self):
        n, rows, body = self.rng.randint(2, 4), [], ""
        hold = None  # a cell of the row above that reaches into this one
        for r in range(self.rng.randint(1, 4)):
            row, cells = [], ""
            for k in range(n):
                if hold == k:
                    row.append([])
                    continue
                (a, x), (b, y) = self.inline(), self.inline()
                two, down = self.rng.random() < 0.3, hold is None and self.rng.random() < 0.15
                hold_next = k if down else None
                cells += self.tag(self.rng.choice(["td", "th"]), f"{a}<br>{b}" if two else a, True, " rowspan=2" if down else "")
                row.append([x, y] if two else [x])
                if down:
                    row[-1].append("\0")  # marks the cell
            held = [k for k in range(n) if "\0" in row[k]]
            body += self.tag("tr", cells, True)
            hold = held[0] if held else None
            for c in row:
                while "\0" in c:
                    c.remove("\0")
            rows.append(row)
            if len(held) > 1:  # keep the made page simple: one cell reaches down at a time
                return self.table()
        wide = [max((_wide(x) for row in rows for x in row[k]), default=0) for k in range(n)]
        lines = []
        for row in rows:
            for k in range(max(map(len, row))):
                lines.append("  ".join((c[k] if k < len(c) else "") + " " * (wide[i] - _wide(c[k] if k < len(c) else "")) for i, c in enumerate(row)).rstrip())
        return self.tag("table", self.rng.choice(["{}", "<tbody>{}", "<tbody>{}</tbody>"]).format(body)), [None, *lines, None]

    def page(self):
        h, tokens = self.rng.choice(["", "<!doctype html><html><head><title>no</title>", "<html><body>"]), []
        for _ in range(self.rng.randint(1, 8)):
            one, more = self.rng.choice([self.paragraph, self.line, self.breaks, self.pre, self.items, self.table])()
            h, tokens = h + self.noise() + one, tokens + more
        lines, blank = [], False
        for t in tokens:
            if t is None:
                blank = True
                continue
            if blank and lines:
                lines.append("")
            lines.append(t)
            blank = False
        return h, "\n".join(lines)


def test_pages_made_with_their_texts():
    for seed in range(1500):
        page, text = Maker(seed).page()
        assert html_text.to_text(page) == text, (seed, page)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<head><title>t</title><style>p{}</style></head><p>One<p>Two &amp; <b>three</b><ul><li>a<li>b</ul><table><tr><td>x<td>yy<tr><td>long<td>z</table>", "One\n\nTwo & three\n\n    - a\n    - b\n\nx     yy\nlong  z"),
        ("<table><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<table><tr><td colspan=2>long one<td>r<tr><td>a<td>b<td>c</table>", "long one  r\na  b      c"),
        ("<table><tr><td><img><td>x<tr><td><td>y</table>", "x\ny"),
        ("<table>above<tr><td>a<td>b</table>", "above\na  b"),
        ("<table><tr><td>only</td></tr><tr><td>one<table><tr><td>x<td>y</table></table>", "only\none\n\nx  y"),
        ("<table><tr><td>a<table><tr><td>b<td>c<tr><td>dd<td>e</table><td>f</table>", "a      f\n\nb   c\ndd  e"),
        ("<p style='visibility:hidden'>no <b style='visibility:visible'>yes</b>", "yes"),
        ("<dialog>no</dialog><dialog open>yes</dialog><details><summary>s</summary>no</details><details open><summary>s</summary>yes</details>", "yes\ns\ns\nyes"),
        ("<math><mi>x</mi><annotation>no</annotation></math> <svg><title>no</title><path d='M0'/><text>in</text><text>svg</text></svg>", "x in svg"),
        ("<input value=v><input type=password value=no><textarea>\nt</textarea><img alt=i>", "vti"),
        ("<ol><li>a<li value=7>b<li>c</ol>", "   1. a\n   7. b\n   8. c"),
        ("<p title=it's>a</p>b", "a\n\nb"), ("<p>a<br></p>b", "a\n\nb"), ("a<br><br>b", "a\n\nb"), ("<q>x</q>", "“x”"), ("<b>a</i> b</b></div>c", "a bc"),
        ("<ul>" * 300 + "<li>x", " " * 4 + "- x"), ("<ul><li>" * 300 + "x", " " * 198 + "- x"),
        ("<table><tr><td>" + "w" * 150 + "<td>r<tr><td>a<td>b</table>", "w" * 150 + "  r\na  b"),
    ],
)
def test_layout(page, text):
    assert html_text.to_text(page) == text


@pytest.mark.parametrize("piece", ["<div>", "<p>", "<ul><li>", "<table><tr><td>x<td>", "<table><td>", "<b>x", "</b>", "<li>", "<td rowspan=99>x", "x<br>", "<a b='", "<", "<!--", "<h1>", "<tr>", "<select><option>", "<dl><dd>", "<textarea></textarea>"])
def test_time_in_proportion(piece):
    began = time.process_time()
    out = html_text.to_text(piece * (400_000 // len(piece)))
    assert time.process_time() - began < 20 and len(out) < 40e6  # quadratic: minutes


def test_broken_and_empty(spark):
    for broken in ("<", "<a", "</", "<!--", "<p <b>", "<table><td><table>" * 60, "<div>" * 5000 + "x", "&#xD800;", "<td>" * 50, "<table></td></tr></table></p>", "<svg><g/><text/>"):
        html_text.to_text(broken)
    made = [(1, None, 7), (2, "", 7), (3, "<p>x", 7), (3, "<p>x", 7), (None, "y", 7)]
    got = html_text.report(spark.createDataFrame(made, "page_id long, html string, text int"))
    assert sorted(((r.page_id, r.text, r.n_chars, r.n_lines) for r in got.collect()), key=str) == sorted([(1, "", 0, 0), (2, "", 0, 0), (3, "x", 1, 1), (3, "x", 1, 1), (None, "y", 1, 1)], key=str)
    assert html_text.report(spark.createDataFrame([], "page_id long, html string")).count() == 0
