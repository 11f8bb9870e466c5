import random
import re
from collections import Counter

import pytest

from pathquarry.llm import html_text


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(2, 9))) for _ in range(n)).capitalize() + "."


def page(rng, wrapper):
    """A page around planted blocks, and the blocks."""
    link = lambda n: f"<a href='/{rng.random()}'>{sentence(rng, n)[:-1]}</a>"
    blocks = [("h1", sentence(rng, 5))]
    for _ in range(rng.randint(2, 9)):
        blocks.append((rng.choice(["p", "p", "p", "p", "h2", "blockquote", "li"]), sentence(rng, rng.choice([3, 25, 40, 60]))))
    blocks.insert(1, ("p", sentence(rng, 40)))
    body = []
    for k, (tag, text) in enumerate(blocks):
        words = text.split()
        if tag == "p" and len(words) > 20:
            at = rng.randrange(3, 12)
            words[at] = f"<b>{words[at]}</b>"
            words[at + 2] = f"<a href=x>{words[at + 2]}</a>"
        shown = "  \n ".join([" ".join(words[:3]), " ".join(words[3:])]) if len(words) > 3 else text
        body.append(f"<{tag}>{shown}</{tag}>" if tag != "li" else f"<ul><li>{shown}</li></ul>")
        if k and rng.random() < 0.3:
            body.append(rng.choice(["<div class='ad'><p>Buy now and save a lot of money today.</p></div>", "<script>var x = '<p>no text</p>';</script>", "<style>p { color: red }</style>", "<aside><p>Read this as well, it is short.</p></aside>"]))
    menu = "".join(f"<li>{link(2)}</li>" for _ in range(rng.randint(3, 12)))
    side = "".join(f"<li>{link(6)}</li>" for _ in range(rng.randint(3, 8)))
    comments = "".join(f"<div class='comment'><p>{sentence(rng, 20)}</p></div>" for _ in range(rng.randint(0, 4)))
    html = (
        f"<!doctype html><html><head><title>{sentence(rng, 4)}</title></head><body><header><a href=/>Site name</a><nav><ul>{menu}</ul></nav></header>"
        f"<div id='cookie-notice'>We use cookies to improve your visit. <button>Accept</button></div><div class='page'><{wrapper}>{''.join(body)}</{wrapper.split()[0]}>"
        f"<aside class='sidebar'><h3>Related</h3><ul>{side}</ul></aside></div><section id='comments'><h3>Comments</h3>{comments}</section><form><label>Name</label><input></form><footer><p>© 2020 All rights reserved by the owners of this site.</p></footer></body></html>"
    )
    return html, "\n".join(t for _, t in blocks)


@pytest.mark.parametrize("wrapper", ["article", "main", "div class='content has-sidebar'", "div class='post tags-open'", "div id='social-history'", "section", "div"])
def test_planted_text(wrapper):
    rng = random.Random(wrapper)
    shares = []
    for _ in range(60):
        html, text = page(rng, wrapper)
        found, wanted = Counter(html_text.extract(html).split()), Counter(text.split())
        shares.append(2 * sum((found & wanted).values()) / (sum(found.values()) + sum(wanted.values())))
    assert sum(x == 1 for x in shares) >= 57 and min(shares) > 0.9


def test_the_element_decides_nothing():
    rng = random.Random(3)
    for _ in range(60):
        html, _ = page(rng, "article")
        assert html_text.extract(html) == html_text.extract(re.sub(r"<(/?)article", r"<\1div", html))


def test_windows_against_their_definition():
    """Surge and dive, found by looking at every window apart."""
    rng = random.Random(9)
    for _ in range(200):
        weights = [rng.choice([0, 0, 0, 0, 10, 60, 300]) for _ in range(rng.randint(1, 25))]
        html = "".join(f"<div><p>{'x' * w}</p></div>" if w else "<div><p><a href=/>y</a></p></div>" for w in weights)
        n, w = len(weights), html_text.WINDOW
        window = [sum(weights[i : i + w]) for i in range(n)]
        kept = ""
        if max(window):
            runs, i = [], 0
            while i < n:  # a run goes from text to the last text before a window that is empty
                if weights[i]:
                    j = i
                    while j < n and window[j]:
                        j += 1
                    runs.append((i, max(k for k in range(i, j) if weights[k])))
                    i = j
                else:
                    i += 1
            surging = [r for r in runs if any(window[k] >= html_text.SURGE * max(window) and weights[k] for k in range(r[0], r[1] + 1))]
            lo, hi = surging[0][0], surging[-1][1]
            kept = "\n".join("x" * x if x else "y" for x in weights[lo : hi + 1])
        assert html_text.extract(html) == kept, weights


def test_tables_and_names(spark):
    pages = [(1, "u", "<p>One two three.</p>", "t", 5, 6), (1, "u", "<p>One two three.</p>", "t", 5, 6), (2, None, None, None, None, None), (None, "v", "", "s", 1, 1), (3, "w", "<div><p>" + "long text " * 300_000 + "</p></div>", "t", 0, 0)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string, n_chars int, weight int")
    found = html_text.extract_pages(df)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    long = ("long text " * 300_000).strip()
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, "u", "One two three.", 14)] * 2 + [(2, None, "", 0), (None, "v", "", 0), (3, "w", long, len(long))], key=str)
    assert html_text.extract_pages(df.limit(0)).count() == 0
