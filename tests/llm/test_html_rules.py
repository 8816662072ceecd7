"""The two passes of HTML extraction against a slow version over blocks that are known beforehand."""

import collections
import random
import re

import pyarrow.parquet as pq
import pytest

from textlattice.llm import html_main as H

STOPS = {"en": "the of and to in is that", "de": "der die und das nicht ist", "ru": "и в не на что"}
RARE = {"en": "cat house garden window river", "de": "katze haus garten fenster", "ru": "кошка дом сад окно река"}


def prose(rnd, lang, n, share):
    return " ".join(rnd.choice((STOPS if rnd.random() < share else RARE)[lang].split()) for _ in range(n))


def page(rnd, lang):
    """HTML and its blocks: (text, characters in links, is excluded, is in the article)."""
    out, known = [], []

    def block(excluded, inside, links=None):
        n = rnd.choice([1, 3, 6, 14, 25, 50])
        text = prose(rnd, lang, n, rnd.choice([0.0, 0.1, 0.25, 0.4]))
        words = text.split()
        k = rnd.choice([0, 0, 0, 0, len(words) // 3, len(words)]) if links is None else len(words) if links else 0
        head, tail = " ".join(words[:k]), " ".join(words[k:])
        parts = ([f"<a href='/x'>{head}</a>"] if head else []) + ([tail] if tail else [])
        tag = rnd.choice(["p", "div", "li", "h2"])
        out.append(f"<{tag}>{' '.join(parts)}</{tag}>\n")
        known.append((text, len(head), excluded, inside))

    def some(excluded, inside):
        for _ in range(rnd.randint(0, 6)):
            block(excluded, inside)

    marked = rnd.random() < 0.6
    for _ in range(rnd.randint(1, 3)):
        name = rnd.choice(["<nav>|</nav>", "<div class='big ad-slot'>|</div>", "<section id=comments>|</section>", "<footer>|</footer>"]).split("|")
        out.append(name[0])
        some(True, False)
        out.append(name[1])
        some(False, False)
        if marked:
            out.append("<article>")
            some(False, True)
            out.append("<aside>")
            some(True, True)
            out.append("</aside>")
            some(False, True)
            out.append("</article>")
    return "<html><body>" + "".join(out) + "</body></html>", known


def slow(known):
    """Pass 1 by the rules as they are stated, then pass 2 by looking at every other block."""
    own = [b for b in known if not b[2]]
    share = lambda a, b: a / b if b else 0
    marked = bool(own) and share(sum(len(b[0]) for b in own if b[3]), sum(len(b[0]) for b in own)) >= 1 / 3
    longer = " ".join(b[0] for b in own if len(b[0]) >= 70).lower().split()
    unknown = share(sum(w in H.STOP_WORDS for w in longer), sum(not re.match("[а-я]", w) for w in longer)) < 0.05
    first = []
    for text, links, excluded, inside in known:
        p = -9 if excluded else 2 if inside else -6 if marked else 0
        if links > 0.8 * len(text):
            p -= 7
        elif links > 0.25 * len(text):
            p -= 3
        if len(text) >= 70:
            w = text.lower().split()
            stop = sum(x in H.STOP_WORDS for x in w) / len(w)
            if unknown or sum(bool(re.match("[а-я]", x)) for x in w) > len(w) / 2:
                p += 2
            else:
                p += 3 if stop >= 0.3 else 2 if stop >= 0.2 else -2
            p += len(text) >= 200
        first.append("good" if p >= 3 else "bad" if p <= -2 else "open")
    out = []
    for i, b in enumerate(known):
        label = first[i]
        if label == "open":
            same = [j for j, c in enumerate(known) if first[j] != "open" and not c[2] and (not marked or c[3] == b[3])]
            left, right = max((j for j in same if j < i), default=None), min((j for j in same if j > i), default=None)
            sides = [(abs(i - j), first[j]) for j in (left, right) if j is not None]
            if marked and b[3]:
                label = "bad" if [x for _, x in sides] == ["bad", "bad"] else "good"
            else:
                near = [x for d, x in sides if d == min(d for d, _ in sides)]
                label = "good" if not sides or "good" in near else "bad"
        if label == "good":
            out.append(b[0])
    return out


@pytest.mark.parametrize("lang", ["en", "de", "ru"])
def test_equals_slow_version(lang):
    rnd = random.Random(lang)
    tally = collections.Counter()
    for _ in range(150):
        html, known = page(rnd, lang)
        assert H.main_text(html) == slow(known), html
        found = list(H.blocks(html))
        first, marked = H.first_pass(found)
        for b, x, y in zip(found, first, H.second_pass(found, first, marked), strict=True):
            if not b.bad:
                tally[x, y] += 1
    assert min(tally[x, y] for x, y in ((H.GOOD, 1), (H.BAD, 0), (H.OPEN, 1), (H.OPEN, 0))) > 20


def test_both_passes_decide_blocks_of_the_driver_s_pages():
    rows = pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist()
    by = collections.Counter()
    for html in rows:
        found = list(H.blocks(html or ""))
        first, _ = H.first_pass(found)
        by.update(x for x, b in zip(first, found, strict=True) if not b.bad)
    assert by[H.GOOD] > 0.3 * by.total() and by[H.OPEN] > 0.1 * by.total()


def test_the_mark_is_a_hint():
    long = "the cat and the dog of the house " * 12
    # a small marked teaser doesn't make the page's text bad
    assert H.main_text(f"<article><p>Teaser</p></article><p>{long}</p><p>{long}</p>") == ["Teaser", long.strip(), long.strip()]
    # within an article stop words and links still decide: a list of links is no text
    links = "".join(f"<li><a href=/{k}>one more story</a></li>" for k in range(5))
    assert H.main_text(f"<article><p>{long}</p><ul>{links}</ul><p>|</p><ul>{links}</ul></article>") == [long.strip()]


def test_length_of_lower_case_letters():
    assert H.main_text("<p>" + "İ" * 60 + "<SCRIPT>var x</Script><p>KEEPME") == ["İ" * 60, "KEEPME"]


def test_unknown_languages_stay():
    russian = "Это длинный русский текст про погоду, который никто не должен потерять. " * 4
    finnish = "tämä teksti kertoo metsästä jossa kukaan ei ole ennen käynyt yksin talvella " * 4
    for text in (russian, finnish):
        assert H.main_text(f"<body><nav>Menu</nav><p>{text}</p><p>{text}</p><ul><li><a href=/>link</a></li></ul></body>") == [text.strip(), text.strip()]


def test_very_long_page():
    long = "the cat and the dog of the house " * 2000
    assert len(H.main_text("<body>" + f"<p>{long}</p><p>short</p>" * 40 + "</body>")) == 80
