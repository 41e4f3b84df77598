"""Articles are kept whole: single cases, and all pages against a reader built on another parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pytest

from rasterflux.llm.html_extract import extract
from rasterflux.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LONG = "This is a long paragraph, with commas, and it goes on for a while so that it has points, many of them. " * 3
P = f"<p>{LONG}</p>"
A = LONG.strip()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><div><section>{P * 4}</section><section><p>Short second section, here.</p></section></div></body>", [A] * 4 + ["Short second section, here."]),
        (f"<body><div><div>{P * 4}</div><p>Thanks for reading</p></div></body>", [A] * 4 + ["Thanks for reading"]),
        (f"<body><header><h1>Site</h1><nav><a href=x>n</a></nav></header><div class=post><header><h1>The title</h1></header>{P * 3}</div></body>", ["The title"] + [A] * 3),
        (f"<body><header><h1>Site</h1></header><div class=wrap><header><h1>The title</h1></header><div class=body>{P * 3}</div></div><footer>f</footer></body>", ["The title"] + [A] * 3),
        (f"<body><article>{P * 2}<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p><noscript><p>Plain picture text.</p></noscript></article><noscript>Enable scripts</noscript></body>", [A, A, "Let x=1 be.", "Plain picture text."]),
        (f'<body><article>{P * 2}<p class="share-price">Price of a share was 12 dollars</p></article></body>', [A, A, "Price of a share was 12 dollars"]),
        (f'<body><article>{P * 2}<div class="notice"><p>As notice was given, all left.</p></div></article></body>', [A, A, "As notice was given, all left."]),
        # What is left out stays out.
        (f'<body><article>{P * 2}<div class=notice>Cookies here</div><div class=comments><p>Nice, very nice.</p></div></article><div class=notice>{P}</div></body>', [A, A]),
        (f"<body><div>{P * 2}</div><div>© 2020 Company. All rights reserved.</div><div class=comments><p>Nice, very nice.</p></div></body>", [A, A]),
        (f'<body><article>{P * 2}<ul class="share-links"><li><a href=a>One</a><li><a href=b>Two</a></ul></article></body>', [A, A]),
        (f"<body><header><h1>Site</h1><p>Motto, of the site.</p></header>{P * 2}</body>", [A, A]),
    ],
)
def test_whole_articles(page, want):
    assert extract(page).split("\n") == want


class Reader(HTMLParser):
    """Blocks of the article element."""

    def __init__(self):
        super().__init__()
        self.depth, self.out = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.out[-1] += " " if tag == "br" else ""
        if tag not in ("b", "a", "i", "em", "span", "br"):
            self.out.append("")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if tag not in ("b", "a", "i", "em", "span", "br"):
            self.out.append("")

    def handle_data(self, data):
        if self.depth:
            self.out[-1] += data


def test_all_pages_against_another_reader(spark):
    got = {r.page_id: r.text for r in QUERIES["op10_html_extraction"](spark, SF).collect()}
    kept = foreign = whole = 0
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        reader = Reader()
        reader.feed(r.html)
        want = [t for x in reader.out if (t := " ".join(x.split()))]
        have = got[r.page_id].split("\n")
        whole += sum(map(len, want))
        kept += sum(len(x) for x in want if x in have)
        foreign += sum(len(x) for x in have if x not in want)
    # Measured: everything kept, nothing foreign.
    assert kept == whole > 0 and foreign == 0
