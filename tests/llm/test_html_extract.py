from __future__ import annotations

import math
import random

import numpy as np

from quillforge.llm import html_extract as H


def page(paragraphs):
    nav = "".join(f'<li><a href="/{i}">item {i}</a></li>' for i in range(12))
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f'<html><head><title>t</title><script>var x = "</p>";</script></head><body><ul>{nav}</ul><!-- ad --><article>{body}</article><footer><a>1</a><a>2</a><a>3</a></footer></body></html>'


def test_content_and_not_the_menu():
    text = ["A long paragraph of running text that says something about the world, at length. " * 4 for _ in range(5)]
    content, lines, chosen, _ = H.extract_page(page(text))
    assert content.count("running text") == 20 and "item" not in content and "var x" not in content and "ad" not in content.split()
    assert 0 < chosen < lines


def test_smoothing_against_its_definition():
    x = np.array([0, 5.0, 100, 3, 0, 0, 40])
    radius = math.ceil(2 * H.SIGMA)
    for i, got in enumerate(H.smooth(x)):
        near = [j for j in range(len(x)) if abs(i - j) <= radius]
        k = [math.exp(-0.5 * ((i - j) / H.SIGMA) ** 2) for j in near]
        assert abs(got - sum(a * x[j] for a, j in zip(k, near, strict=True)) / sum(k)) < 1e-9


def test_threshold_against_its_definition():
    rng = random.Random(0)
    texts, tags = ["x" * rng.randint(0, 300) for _ in range(40)], [rng.randint(0, 6) for _ in range(40)]
    chosen, threshold = H.content_lines(texts, tags)
    ratio = [len(t) / max(g, 1) for t, g in zip(texts, tags, strict=True)]
    even = H.smooth(np.array(ratio))
    assert abs(threshold - float(np.std(even))) < 1e-9
    assert chosen.tolist() == [bool(e >= threshold and r > 0) for e, r in zip(even, ratio, strict=True)]


def test_marked_sections_and_soup_never_fail():
    assert H.extract_page("<p>a</p><![foo[x]]><p>b</p>")[0] == "a\nb" and H.extract_page("<![1[")[0] == "<![1["  # one that never ends is text
    assert H.extract_page("<p>a<![CDATA[x]]>b</p><!doctype [<!x]><!ELEMENT>")[1] >= 1
    rng, parts = random.Random(3), ["<", ">", "!", "[", "]", "<!", "<![", "--", "cdata[", "if ", "p", " ", "/", "&", "#", "x", "1", "'", '"', "=", "<p>", "</p>", "<script>", "<?", "doctype"]
    for _ in range(3000):
        H.extract_page("".join(rng.choice(parts) for _ in range(rng.randint(1, 25))))


def test_lines_and_ratios_by_brute_force():
    """Lines, tags and content told from the markup by a split at tags, not by the parser."""
    rng = random.Random(11)
    for _ in range(200):
        cells = []
        for _ in range(rng.randint(1, 30)):
            cells.append(rng.choice(["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<br>", "\n", "<a href='x'>", "</a>", "<!-- c -->", *["word " * rng.randint(1, 30)] * 5]))
        lines, part, tags = [], "", 0

        def end(text, n):
            text = " ".join(text.split())
            return [(text, n)] if text or n else []

        for c in cells:
            name = c.strip("</>").split()[0] if c.startswith("<") and not c.startswith("<!") else None
            if name is None:
                if not c.startswith("<!"):
                    for k, x in enumerate(c.split("\n")):
                        if k:
                            lines += end(part, tags)
                            part, tags = "", 0
                        part += x
                continue
            block, closing = name in ("p", "div", "br"), c.startswith("</")
            if block and not closing:
                lines += end(part, tags)
                part, tags = "", 0
            tags += 1
            if block and closing:
                lines += end(part, tags)
                part, tags = "", 0
        lines += end(part, tags)
        content, n, chosen, threshold = H.extract_page("".join(cells))
        assert n == len(lines)
        ratio = [len(t) / max(1, g) for t, g in lines]
        radius = math.ceil(2 * H.SIGMA)
        even = []
        for i in range(n):
            near = {j: math.exp(-0.5 * ((i - j) / H.SIGMA) ** 2) for j in range(max(0, i - radius), min(n, i + radius + 1))}
            even.append(sum(k * ratio[j] for j, k in near.items()) / sum(near.values()))
        sd = math.sqrt(sum((e - sum(even) / n) ** 2 for e in even) / n) if n else 0.0
        assert abs(sd - threshold) < 1e-9
        clear = all(abs(e - sd) > 1e-9 for e in even)
        if clear:
            want = [t for (t, _), e, r in zip(lines, even, ratio, strict=True) if e >= sd and r > 0]
            assert content == "\n".join(want) and chosen == len(want)


def test_edges(spark):
    long = "<p>" + "word " * 50_000 + "</p>"
    rows = [(1, None, "u"), (2, "", "u"), (None, "<p>text</p>", "u"), (3, "<p>a<b>b", "u"), (3, "<p>a<b>b", "u"), (4, "<<<>>&&&#xZZ;<!-", "u"), (5, long, None), (6, "plain", "u")]
    t = spark.createDataFrame([(*r, 1, "c") for r in rows], "page_id bigint, html string, url string, n_lines int, content string")
    got = H.extract(t).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[1].content == by[2].content == "" and by[1].n_lines == 0 and by[None].content == "text" and by[5].content == ("word " * 50_000).strip() and by[6].content == "plain" and by[3].content == "ab"
    assert H.extract(t.limit(0)).count() == 0


def test_given_pages(spark, sf):
    from quillforge.llm import queries

    got = queries.op7_html_extraction(spark, sf).collect()
    assert len(got) == 50 and all("track(" not in r.content for r in got) and sum(bool(r.content) for r in got) == 50
