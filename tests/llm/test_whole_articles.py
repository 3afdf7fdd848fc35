"""Articles of several parts, and a plain extractor beside the operator."""

from html.parser import HTMLParser
from pathlib import Path

import pytest

from lodestone.llm import html_text
from lodestone.llm.html_text import Page, main_text
from tests.llm.test_operators import DATA

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def words(n, tag):
    return " ".join(f"{WORDS[k % 10]}{tag}" for k in range(n)) + "."


A, B, C = words(200, "a"), words(120, "b"), words(20, "c")
CHROME = '<nav><a href="/">Home</a></nav>{}<div class="sidebar">Side text</div><footer>Foot</footer>'


def page(body):
    return f"<html><head><title>T</title></head><body>{CHROME.format(body)}</body></html>"


CASES = {
    "sections": (f"<div><section>{A}</section><section>{B}</section></div>", [A, B]),
    "short last section": (f"<div><section>{A}</section><section>{B}</section><section><h2>End</h2><p>{C}</p></section></div>", [A, B, "End", C]),
    "quotation in article": (f"<article><p>{C}</p><blockquote>{A}</blockquote><p>{words(20, 'd')}</p></article>", [C, A, words(20, "d")]),
    "quotation in div": (f"<div><p>{C}</p><blockquote>{A}</blockquote><p>{words(20, 'd')}</p></div>", [C, A, words(20, "d")]),
    "cells": (f"<div><table><tr><td>{A}</td><td>{B}</td></tr></table></div>", [A, B]),
    "headline outside": (f"<h1>Headline</h1><div class='text'>{A}</div>", ["Headline", A]),
    "site name above a titled article": (f"<h1>Site</h1><div class='text'><h1>Headline</h1><p>{A}</p></div>", ["Headline", A]),
    "lead beside the text": (f"<div class='post'><p>{C}</p><div class='text'>{A}</div></div>", [C, A]),
    "wrapped parts": (f"<div><div class='w'><section>{A}</section></div><div class='w'><section>{C}</section></div></div>", [A, C]),
    "links beside": (f"<div class='one'>{A}</div><div class='two'>" + "".join(f"<a href='/{k}'>{words(12, k)}</a>" for k in range(9)) + "</div>", [A]),
    "rights below": (f"<div class='x'>{A}</div><p>&copy; 2024 {B}</p>", [A]),
    "small print beside": (f"<div class='x'>{A}</div><p>All rights kept.</p>", [A]),
    "deep article": (f"<article><div><div><div><p>{A}</p></div></div></div><div><p>{C}</p></div></article>", [A, C]),
    "card beside article": (f"<article class='post'><p>{A}</p></article><div class='cards'><p>{C}</p></div>", [A]),
}


@pytest.mark.parametrize("case", CASES)
def test_keeps_the_article(case):
    body, expected = CASES[case]
    html, text = page(body), "\n\n".join(expected)
    assert main_text(html, []) == text
    # like pages of one host vote for these places, and the votes change nothing
    assert main_text(html, [path for path, _ in Page(html).votes()]) == text


def test_votes_carry_parts():
    """A short part that other pages of the host show to belong is kept where its own page says too little."""
    long = page(f"<div class='a'>{A}</div><div class='b'>{B}</div>")
    short = page(f"<div class='a'>{A}</div><div class='b'>{C}</div>")
    winners = [path for path, _ in Page(long).votes()]
    assert winners[0].endswith(">div.b")
    assert main_text(short, []) == A
    assert main_text(short, winners) == f"{A}\n\n{C}"


def test_hosts_of_several_layouts(spark):
    """Pages of one host in two layouts, each repeated, and a page of its own with neither."""
    kinds = ["sections", "quotation in article", "headline outside"]
    rows = [(k, "https://a.example/x", page(CASES[kinds[k % 2]][0])) for k in range(8)] + [(8, "https://a.example/y", page(CASES[kinds[2]][0])), (8, "https://a.example/y", page(CASES[kinds[2]][0]))]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 10
    for r in got:
        kind = kinds[2] if r["page_id"] == 8 else kinds[r["page_id"] % 2]
        assert r["text"] == "\n\n".join(CASES[kind][1]) and r["n_chars"] == len(r["text"])


def test_deep_pages_stay_linear():
    deep = "".join(f"<div class='k{'x' * (k % 3)}'><p>{C}</p>" for k in range(3000))
    text = main_text(page(f"<div>{deep}</div>"), [])
    assert text and sum(len(path) for path, _ in Page(page(deep)).votes()) < 40 * len(deep)


class Plain(HTMLParser):
    """The article element's blocks, by the standard library's parser."""

    SKIP = {"nav", "aside", "script", "style", "form", "footer"}
    BLOCKS = {"p", "h1", "h2", "h3", "ul", "ol", "li", "div", "table", "tr", "pre", "blockquote", "section", "article", "br/"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.article, self.skip = [""], 0, []

    def handle_starttag(self, tag, attrs):
        self.article += tag == "article"
        name = dict(attrs).get("class") or ""
        if self.article and tag not in ("br", "img", "hr", "input") and (self.skip or tag in self.SKIP or name in ("ad", "comments", "share", "related")):
            self.skip.append(tag)
        if tag in self.BLOCKS:
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.article -= tag == "article"
        if tag in self.skip:
            while self.skip.pop() != tag:
                pass
        if tag in self.BLOCKS:
            self.blocks.append("")

    def handle_data(self, data):
        if self.article and not self.skip:
            self.blocks[-1] += data


def test_against_a_plain_extractor(spark):
    """Every page of the sample that has an article element: its text by another parser."""
    pages = spark.read.parquet(str(Path(DATA) / "pages.parquet"))
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    seen = 0
    for r in pages.collect():
        if "<article" not in r["html"]:
            continue
        plain = Plain()
        plain.feed(r["html"])
        plain.close()
        seen += 1
        assert got[r["page_id"]] == "\n\n".join(b for b in (" ".join(b.split()) for b in plain.blocks) if b), r["page_id"]
    assert seen >= 50
