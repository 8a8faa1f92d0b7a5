"""The labelled table that the block classifier of `html` is grown on: pages in which each block that belongs to the main text starts with '+'.

{n} stands for n words, more or less: the tree is grown on several draws of all lengths. The pages follow common layouts: blogs, news, wikis, shops, forums and hand-written pages, with and without
elements or class names that tell their parts.
"""

from __future__ import annotations

import math
import re

import numpy as np

PAGES = [
    # a blog with semantic elements
    """<header><a href="/">{2}</a></header><nav><ul><li><a href="/a">{1}</a><li><a href="/b">{1}</a><li><a href="/c">{2}</a></ul></nav>
    <article><header class="entry-header"><h1>+{7}</h1><p>+{4} <a href="/u">{2}</a></header><p>+{60}<p>+{45} <a href="/x">{3}</a> {20}<h2>+{3}</h2><p>+{80}<ul><li>+{6}<li>+{9}<li>+{5}</ul><p>+{1}
    <div class="ad">{12}</div><p>+{35}<div class="share-links"><a href="/s">{1}</a> <a href="/t">{1}</a></div></article>
    <aside><h3>{2}</h3><p>{30}</aside><section id="comments"><h3>{2}</h3><div class="comment"><p>{40}</div><div class="comment"><p>{15}</div></section><footer>&copy; {6}</footer>""",
    # news by nested divs and class names
    """<div class="site-header"><div class="logo">{2}</div><div class="main-nav"><a href="/a">{1}</a> <a href="/b">{1}</a> <a href="/c">{1}</a></div></div>
    <div class="layout with-sidebar"><div class="story"><h1>+{9}</h1><div class="byline">+{5}</div><p>+{30}</p><p>+{55}</p><p>+{48}</p><blockquote>+{18}</blockquote><p>+{70}</p><p>+{22}</p></div>
    <div class="sidebar-right"><h4>{2}</h4><ul><li><a href="/1">{8}</a><li><a href="/2">{9}</a><li><a href="/3">{7}</a></ul><p>{25}</p></div></div>
    <div class="related-stories"><h4>{2}</h4><p><a href="/r">{9}</a></p><p>{14}</p></div><div class="cookie-notice">{20}</div><div class="site-footer">{4} <a href="/p">{2}</a></div>""",
    # a hand-written page without any class name
    """<h1>+{5}</h1><p>+{40}</p><p>+{65}</p><h2>+{3}</h2><p>+{50} <a href="/x">{4}</a></p><p>+{12}</p><p>+{33}</p><hr><p><a href="/">{2}</a> | <a href="/n">{1}</a></p>""",
    # a page laid out by tables
    """<table><tr><td><a href="/1">{1}</a><br><a href="/2">{2}</a><br><a href="/3">{1}</a></td><td><h2>+{6}</h2><p>+{42}</p><p>+{38}</p><p>+{7}</p><p>+{61}</p></td><td><a href="/x">{4}</a><br><a href="/y">{5}</a></td></tr></table><p>{5}</p>""",
    # a wiki
    """<div class="navigation"><a href="/m">{2}</a></div><main><h1>+{3}</h1><div class="notice">{18}</div><p>+{55} <a href="/a">{2}</a> {12} <a href="/b">{1}</a> {20}</p><h2>+{2}</h2><p>+{75} <a href="/c">{1}</a> {30}</p><table><tr><th>+{1}<th>+{2}<tr><td>+{3}<td>+{1}</table>
    <p>+{25}</p><dl><dt>+{2}<dd>+{14}<dt>+{1}<dd>+{9}</dl></main><div class="toolbar"><a href="/e">{1}</a> <a href="/h">{1}</a></div><footer><p>{22}</p><p>{9} <a href="/t">{3}</a></p></footer>""",
    # a shop
    """<nav><a href="/a">{1}</a><a href="/b">{1}</a></nav><div class="breadcrumb"><a href="/a">{1}</a> {1}</div><div class="product"><h1>+{6}</h1><p>+{45}</p><p>+{30}</p><ul><li>+{4}<li>+{6}<li>+{5}</ul></div><form><label>{1}</label><p>{6}</p></form>
    <div class="promo">{14}</div><div class="newsletter-signup"><p>{12}</p></div><div><a href="/1">{4}</a></div><div><a href="/2">{5}</a></div><div><a href="/3">{3}</a></div><footer>{3}</footer>""",
    # an article whose class names only look like those of other parts
    """<div class="container no-sidebar"><article class="post"><div class="article-header"><h1>+{8}</h1></div><div class="social-science"><p>+{52}</p><p>+{44}</p></div><div class="comment-on-theory"><p>+{38}</p><p>+{47}</p></div><p>+{3}</p></article></div><div class="footer"><p>{16}</p></div>""",
    # prose in a plain div between link lists
    """<div><ul><li><a href="/1">{3}</a><li><a href="/2">{2}</a><li><a href="/3">{4}</a></ul></div><div><h2>+{4}</h2>+{90}</div><div>+{70}</div><div>+{15}</div><div>+{58}</div><div><a href="/4">{6}</a> <a href="/5">{5}</a></div><div>{3}</div><div>{2}</div>""",
    # a start page: teasers and link lists, and no main text
    """<header>{3}</header><nav><a href="/a">{1}</a><a href="/b">{2}</a></nav><div><a href="/1">{8}</a></div><div>{5}</div><div><a href="/2">{7}</a></div><div>{4}</div><div><a href="/3">{9}</a></div><div>{3}</div><form>{4}</form><footer>{8}</footer>""",
    # short notes in an article
    """<nav><a href="/a">{1}</a></nav><article><h1>+{4}</h1><p>+{1}</p><p>+{2}</p><p>+{6}</p><p>+{1}</p></article><footer>{2}</footer>""",
    """<article><p>+{3}</p></article>""",
    """<article><h1>+{2}</h1><p>+{3}</p></article>""",
    """<main><h1>+{6}</h1><p>+{4}</p><p>+{9}</p></main><div>{2}</div>""",
    """<div>{2}</div><article><h1>+{3}</h1><p>+{14}</p></article><div>{4}</div>""",
    """<nav><a href="/a">{2}</a></nav><article><p>+{1}</p><p>+{8}</p></article>""",
    """<div><a href="/a">{1}</a></div><p>+{35}</p>""",
    """<p>+{70}</p>""",
    """<div>{2}</div><div>{1}</div>""",
    """<div>{6}</div>""",
    """<div>{3}</div><div><a href="/a">{2}</a></div><div>{5}</div>""",
    # prose without an article, with a line of small print before and after
    """<div>{3}</div><div>{2}</div><div><a href="/a">{3}</a></div><p>+{30}</p><p>+{42}</p><p>+{8}</p><p>+{26}</p><div><a href="/b">{2}</a></div><div>{4}</div><div>{2}</div>""",
    """<p>{2}</p><p>{1}</p><h2>+{5}</h2><p>+{61}</p><p>+{47}</p><p>{1}</p><p>{3}</p>""",
    """<div class="ad">{7}</div><article><h1>+{11}</h1><p>+{8}</p><p>+{120}</p><p>+{2}</p><p>+{40}</p></article><footer>{1}</footer>""",
    # short paragraphs among long ones, and parts set apart inside an article
    """<nav><a href="/a">{1}</a></nav><article><h1>+{9}</h1><p>+{50}</p><p>+{1}</p><p>+{40}</p><p>+{2}</p><p>+{3}</p><p>+{80}</p><p>+{1}</p></article><footer>{3}</footer>""",
    """<article><h1>+{12}</h1><p>+{1}</p><p>+{90}</p><p>+{5}</p><p>+{2}</p><p>+{33}</p><p>+{4}</p><p>+{3}</p></article><footer>{2}</footer>""",
    """<article><p>+{20}</p><p>+{3}</p><p>+{60}</p><p>+{1}</p><p>+{2}</p><p>+{100}</p></article><footer>{7}</footer>""",
    """<article><h1>+{3}</h1><p>+{4}</p><aside>{13}</aside><p>+{5}</p><nav>{3}</nav><p>+{2}</p><form>{6}</form><p>+{3}</p><footer>{9}</footer></article>""",
    """<article><h1>+{5}</h1><p>+{44}</p><aside><p>{35}</p></aside><p>+{52}</p><aside>{8}</aside><p>+{31}</p><footer>{12}</footer></article>""",
    """<main><aside>{20}</aside><p>+{6}</p><p>+{2}</p><aside>{2}</aside><table><tr><td>+{2}<td>+{2}</table></main>""",
    """<div>{12}</div><article><h1>+{6}</h1><p>+{3}</p><p>+{55}</p><p>+{2}</p></article><div>{9}</div><div>{14}</div>""",
    # links inside the main text
    """<article><h1>+{5}</h1><p>+{20} <a href="/a">{8}</a></p><p>+<a href="/b">{6}</a> {30}</p><ul><li>+{2} <a href="/c">{3}</a> {4}<li>+{8}</ul><p><a href="/next">{4}</a></p><p><a href="/prev">{3}</a></p></article>""",
    # a forum thread: the post, and replies
    """<div class="menu"><a href="/f">{2}</a></div><main><h1>+{9}</h1><div class="post">+{64}</div><div class="post">+{35}</div></main><div class="replies"><div>{48}</div><div>{12}</div><div>{70}</div></div><div class="login">{5}</div>""",
    # advertising prose and a survey between paragraphs without an article
    """<h1>+{6}</h1><p>+{50}</p><div class="advertisement"><p>{40}</p></div><p>+{46}</p><div class="widget newsletter"><p>{28}</p><p>{9}</p></div><p>+{39}</p><p>+{20}</p><div class="related"><p>{30}</p></div>""",
    # a page in one wrapper that is named like a part of a page
    """<div class="header-image-layout"><h1>+{5}</h1><p>+{60}</p><p>+{35}</p><p>+{48}</p></div><p><a href="/a">{2}</a> <a href="/b">{2}</a></p>""",
    """<div class="search-engine-history"><h2>+{4}</h2><p>+{44}</p><p>+{31}</p><p>+{52}</p><p>+{27}</p></div><div class="search"><p>{6}</p></div>""",
    # small print and captions around prose
    """<p>{3}</p><p><a href="/a">{2}</a></p><h1>+{7}</h1><p>+{33}</p><figure><figcaption>+{9}</figcaption></figure><p>+{57}</p><p>+{14}</p><p>+{41}</p><p><a href="/b">{3}</a></p><p>{4}</p>""",
]


def written(page: str, rng: np.random.Generator | None = None) -> str:
    """The page with its words; with rng, lengths are drawn around the ones given."""
    length = lambda n: n if rng is None else max(1, round(n * math.exp(rng.uniform(-1, 1))))
    return re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * length(int(m[1]))), page)
