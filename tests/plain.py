"""Plain Python versions of the queries that SQL cannot express."""

import hashlib
import html
import re
from html.parser import HTMLParser


def _rows(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet").collect()


def chunks(spark, sf):
    out = []
    for r in _rows(spark, sf, "documents"):
        done, cur, last = [], "", ""
        for p in [p for p in re.split("\n\n|\n", r["text"] or "") if p.strip(" ")]:
            if not cur:
                cur = p
            elif len(cur) + 1 + len(p) <= 1200:
                cur += "\n" + p
            else:
                done.append(cur)
                cur = last + "\n" + p if len(last) < 200 else p
            last = p
        done += [cur] if cur else []
        out += [(r["doc_id"], k, len(c), hashlib.md5(c.encode()).hexdigest()) for k, c in enumerate(done)]
    return out


class _Text(HTMLParser):
    """Text between tags as a browser's parser sees it."""

    BLOCKS = {"p", "div", "tr", "li", "h1", "h2", "h3", "h4", "h5", "h6", "table", "article", "nav", "ul", "header", "footer", "br"}

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")
        if tag in self.BLOCKS - {"br"}:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)

    def handle_entityref(self, name):
        self.out.append({"nbsp": " "}.get(name) or html.unescape(f"&{name};"))

    def handle_charref(self, name):
        self.out.append(f"&#{name};")


def html_text(spark, sf):
    out = []
    for r in _rows(spark, sf, "pages"):
        p = _Text()
        p.feed(r["html"])
        p.close()
        t = re.sub(r"[ \t]+", " ", "".join(p.out))
        out.append((r["page_id"], re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "", re.sub(r"[ \t\n\x0b\f\r]*\n[ \t\n\x0b\f\r]*", "\n", t))))
    return out


def sections(spark, sf):
    out = {}
    for r in _rows(spark, sf, "pages"):
        text = re.sub(r"(?is)<h([1-6])\b", lambda m: f"\nItem {m[1]} <h{m[1]}", r["html"])
        marks = list(re.finditer(r"(?m)^\s*(Item\s+\d+[AB]?)\b", text))
        for m, n in zip(marks, [*marks[1:], None]):
            name, body = re.sub(r"\s+", " ", m[1]), text[m.end() : n.start() if n else len(text)]
            key = (r["page_id"], name)
            out[key] = max(out.get(key, 0), len(body))
    return [(*k, n) for k, n in out.items()]


class _Cells(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.rows, self.cell = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "ul":
            self.rows.append([])
        if tag == "tr":
            self.rows.append([])
        if tag in ("li", "td", "th") and self.rows:
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("li", "td", "th") and self.cell is not None:
            self.rows[-1].append("".join(self.cell).strip(" "))
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")


def html_tables(spark, sf):
    out = []
    for r in _rows(spark, sf, "pages"):
        p = _Cells()
        p.feed(r["html"])
        out += [(r["page_id"], k, j, c) for k, row in enumerate(p.rows) for j, c in enumerate(row)]
    return out


def page_chunks(spark, sf):
    pages = {}
    for r in _rows(spark, sf, "conversations"):
        pages.setdefault(r["conv_id"], []).append((r["turn"] * 10 + (r["role"] != "user"), r["text"] or ""))
    out = []
    for i, own in pages.items():
        done, cur, seen = [], "", []
        for p, t in sorted(own):
            longer = cur + "\n\n" + t if cur else t
            if cur and len(longer) // 2 > 100:
                done.append((cur, seen))
                cur, seen = (cur[-30:] if len(cur) > 30 else "") + "\n\n" + t, [p]
            else:
                cur, seen = longer, [*seen, p]
        done += [(cur, seen)] if cur.strip(" ") else []
        out += [(i, k, s[0], s[-1], hashlib.md5(c.strip(" ").encode()).hexdigest()) for k, (c, s) in enumerate(done)]
    return out


def item_sections(spark, sf):
    """What the fixture's own making says must come out."""
    out = []
    for r in _rows(spark, sf, "documents"):
        t = re.sub(r"[ \t\n\x0b\f\r]+", " ", r["text"] or "")[:4000]
        part = lambda head: len((head + "\n" + t).strip())  # noqa: E731,B023
        k = r["doc_id"]
        if k % 3 == 0:
            rows = [("00_full_text", len(t))] if t else []
        elif k % 5 == 0:
            rows = [("02_risk_factors", part("RISK FACTORS")), ("03_mda", part("Management's Discussion and Analysis of it"))]
            rows = [(n, c) for n, c in rows if c >= 200]
        elif (body := "TABLE OF CONTENTS\n" + "." * 90 + "\nPART I\nItem 1. Business 3\nItem 1A. Risk Factors 9\nPART II\nItem 7. MD&A 20\n" + f"\nPART I\nItem 1. Business\n{t}\nItem 1A. Risk Factors\n{t}\nItem 7. Discussion\n{t}\nItem 8. Statements\n{t}") and body.rindex("PART I\n") > 0.3 * len(body):
            # The contents' end lies past 30 per cent, so it is not believed: the contents' own headings count.
            a, b = body.index("Item 7."), body.index("\nItem 8.")
            rows = [("00_cover", len(body[: body.index("Item 1.")].strip())), ("03_mda", len(body[a:b].strip())), ("04_financial_statements", part("Item 8. Statements"))]
            rows = [(n, c) for n, c in rows if c >= (101 if n == "00_cover" else 50)]
        else:
            rows = [("01_business", part("Item 1. Business")), ("02_risk_factors", part("Item 1A. Risk Factors")), ("03_mda", part("Item 7. Discussion")), ("04_financial_statements", part("Item 8. Statements"))]
            rows = [(n, c) for n, c in rows if c >= 50]
        out += [(k, j, n, c) for j, (n, c) in enumerate(rows)]
    return out


TRUTH = {f.__name__: f for f in (chunks, html_text, sections, html_tables, page_chunks, item_sections)}
