import random

import pytest
from paths import SMALL
from pyspark.sql import functions as F

from lakewright.operators import content, titles
from lakewright.plans import matching


def plain_match(title, names):
    """The four steps with every name of the deck."""
    norm = lambda s: "_".join("".join(c if c.isascii() and c.isalnum() or "一" <= c <= "鿿" else " " for c in s).split()).lower()

    def number(s):
        import re

        s = s.strip().lower()
        m = re.match(r"(\d{1,3})", s, re.A) or re.match(r"(?:slide|page|p)\s*[-_:]?\s*(\d{1,3})", s, re.A) or re.match(r"第\s*(\d{1,3})\s*[页张]", s, re.A)
        return int(m[1]) if m else None

    if title in names:
        return title, "exact"
    for step, found in (
        ("normal", [n for n in names if norm(n) == norm(title)] if norm(title) else []),
        ("number", [n for n in names if number(n) == number(title)] if number(title) is not None else []),
        ("part", [n for n in names if norm(title) in norm(n)] if norm(title) else []),
    ):
        if len(found) == 1:
            return found[0], step
    return None, None


def test_titles_are_matched_as_with_all_names(spark):
    rng = random.Random(22)
    word = lambda: rng.choice(["intro", "Intro", "in", "i", "summary", "概述", "概", "p", "page", "x y", "long title of a slide"])
    name = lambda: rng.choice(["{n}_{w}", "{w}-{n}", "Slide {n} {w}", "{w}", "第{n}页{w}", "{w} {v}", "--"]).format(n=rng.randint(1, 30), w=word(), v=word())
    decks = {d: sorted({name() for _ in range(rng.randint(0, 25))}) for d in "abcdef"}
    rows = [(i, rng.choice("abcdefz"), name() if rng.random() < 0.7 else rng.choice([" ", "", "p 7", word(), word()[:2], "INTRO!"])) for i in range(400)]
    names = spark.createDataFrame([(d, n) for d, ns in decks.items() for n in ns], "deck string, name string")
    got = titles.match_titles(spark.createDataFrame(rows, "id long, deck string, title string"), names).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.match, r.step) == plain_match(r.title, decks.get(r.deck, [])), (r.deck, r.title)
    assert {r.step for r in got} == {"exact", "normal", "number", "part", None}


def test_each_step_has_rows_in_the_query(spark):
    assert {r.step for r in matching.title_match(spark, SMALL).select("step").distinct().collect()} == {"exact", "normal", "number", "part", None}


def test_collation(spark):
    words = ["zeta", "Éa", "ea", "Ea", "éa", "èa", "eb", "Zeta", "ä", "a", "A", "az"]
    d = spark.createDataFrame([(1, w) for w in words], "g int, title string")
    got = titles.title_places(d, "g", [titles.collated("title")]).orderBy("place").collect()
    assert [r.title for r in got] == ["a", "A", "ä", "az", "ea", "Ea", "éa", "Éa", "èa", "eb", "zeta", "Zeta"]


LONG, LONGER = "text " * 30, "text " * 60


@pytest.mark.parametrize(
    "html, name, score, text",
    [
        (f"<body><div><p>{LONGER}</p></div><article>{LONG}</article></body>", "div", 349, LONGER.strip()),
        (f"<body><div>{LONGER}</div><article>{LONG}<p>{LONG}</article></body>", "article", 298, LONG.strip() * 2),
        (f"<body><nav>{LONGER}</nav><div><p>short</p></div></body>", "body", None, "short"),
        (f"<body><div><section><p>{LONGER}</p></section></div></body>", "body", None, LONGER.strip()),
        (f'<body><div class="a TRS_Editor b">{LONG}</div><main>{LONG}{LONG}</main></body>', "main", 299, ""),
        (f'<body><div id="content">{LONG}</div><article>{LONG}</article></body>', "div", 149, LONG.strip()),
        (f"<body><article>{'漢' * 100}<p>x", "article", 301, "漢" * 100 + "x"),
        (f"<body><div><p>a<p>b<p>{LONGER}</div><div><div><p>{LONGER}</p></div></div>", "div", 451, "ab" + LONGER.strip()),
        ("<body>&amp;lt; &copy;</body>", "body", None, "&lt; ©"),
    ],
)
def test_content_of_small_pages(spark, html, name, score, text):
    got = content.main_content(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).collect()
    assert [(r.page_id, r.name, r.score) for r in got] == [(1, name, score)]
    if "<main>" not in html:
        assert got[0].text == text


def test_each_sort_of_element_is_chosen_in_the_query(spark):
    assert {r.name for r in matching.main_content(spark, SMALL).select("name").distinct().collect()} >= {"article", "div", "body"}


def test_empty_tables(spark):
    assert content.main_content(spark.createDataFrame([], "page_id long, html string")).count() == 0
    none = spark.createDataFrame([], "deck string, name string")
    t = spark.createDataFrame([("a", "b")], "deck string, title string")
    assert titles.match_titles(t, none).first().match is None and titles.match_titles(t.limit(0), none).count() == 0
    assert titles.title_places(t.limit(0), "deck", [F.col("title")]).count() == 0
