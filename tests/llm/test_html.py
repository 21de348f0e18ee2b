import random

import pytest

from docloom.llm.html_extract import blocks_of, classify, extract_main_text, main_text

LONG = "It was the best of times and it was the worst of times, as all of them said to each other on the way to the house by the river that day. "
PAGE = f"""<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy the {LONG}</div>
<div class="cookie-notice">We use cookies</div><article class="post"><header><h1>Title &amp; more</h1></header><p>{LONG * 2}<br>and so
 on<p><b>Short.<br><p>Caf&eacute; &#8364;5 &lt;b&gt;</p><form><input name=q><p>Search {LONG}</p></form><script>x("<p>")</script>
<aside>Related</aside><ul><li>one</li><li>two</li></ul></article>
<section id="comments"><p>{LONG * 3}</p></section><aside class="sidebar"><p>{LONG * 3}</p></aside><footer>&copy; me</footer></body></html>"""


def test_article():
    text = LONG.strip()
    assert main_text(PAGE).split("\n") == ["Title & more", f"{text} {text} and so on", "Short.", "Café €5 <b>", "one", "two"]


def test_page_without_an_article_uses_block_rules():
    page = f"<div><a href=x>{'Link list of things '*6}</a></div><div><p>{LONG*2}</p><p>Yes.</p><p>{LONG*2}</p></div><div>Xyz qqq 123 {'zzz '*80}</div><div>tail</div>"
    text = f"{LONG*2}".strip()
    assert main_text(page).split("\n") == [text, "Yes.", text]


def test_main_parts_and_their_headers():
    page = f"""<body><main class="has-sidebar"><p>Crumb text here</p><article class="post"><div class="entry-header"><h1>T</h1></div><figure><figcaption>Cap.</figcaption></figure><p>{LONG}</p>
    <div class="post-share">Share</div><div class="entry-content"><p>B</p></div></article><article class="comment"><p>{LONG * 2}</p></article><p>{LONG * 2}</p></main></body>"""
    assert main_text(page).split("\n") == ["T", "Cap.", LONG.strip(), "B"]
    assert main_text(f'<body><div class="top-menu">Menu</div><div id="content"><div class="page-header">H</div><p>{LONG}</p><p>x</p></div><div id="footer">f</div></body>').split("\n") == ["H", LONG.strip(), "x"]


def test_short_blocks_take_the_nearest_label():
    blocks = classify(blocks_of(f"<p>a</p><p>{LONG*2}</p><p>b</p><p>c</p><p>{'qq zz '*60}</p><p>d</p>"))
    assert [b.good for b in blocks] == [True, True, True, False, False, False]


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("<p>", ""), ("<article>x", "x"), ("<article><p>a<p>b", "a\nb"), ("<article>a<!-- cut", "a"), ("<article>a &amp b &a", "a & b &a"), ("<article>1 < 2</article>", "1 < 2"), ("<article>a<div>b</div>c", "a\nb\nc")])
def test_odd_pages(page, text):
    assert main_text(page) == text


def test_operator(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "<article>" + "<p>word the</p>" * 20_000, "x"), (3, "u", "<b>", None), (None, "u", "", "x")]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert max(r.n_chars for r in got) == 20_000 * 9 - 1
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


LINKED = "<div><a href=x>Home and more of it</a> <a href=y>Contact</a></div>"
POLISH = "Wczoraj wieczorem nad rzeką zebrali się mieszkańcy miasteczka, żeby obejrzeć pokaz sztucznych ogni przygotowany przez strażaków. Później wszyscy wrócili spokojnie swoimi ścieżkami, rozmawiając jeszcze długo przed domami."
RUSSIAN = "Вчера вечером жители городка собрались у реки, чтобы посмотреть праздничный салют, который приготовили пожарные. Потом все спокойно разошлись по домам и ещё долго разговаривали у ворот, вспоминая прошлые годы."
CHINESE = "昨天晚上镇上的居民聚集在河边观看消防员准备的烟花表演" * 10
MIDDLE = "Rain fell across northern towns Monday, and several roads were closed by midday floods."


@pytest.mark.parametrize("paragraphs", [["Short text.", "Another one."], [MIDDLE, MIDDLE], [POLISH, "Koniec."], [RUSSIAN, RUSSIAN], [CHINESE, "完"], [CHINESE * 4, LONG.strip()]])
def test_unmarked_pages_that_stop_words_cannot_tell(paragraphs):
    page = f"<body><nav>{LONG * 2}</nav>{LINKED}{''.join(f'<p>{p}</p>' for p in paragraphs)}{LINKED}<footer>{LONG * 2}</footer></body>"
    assert main_text(page).split("\n") == paragraphs


def test_very_deep_markup_takes_linear_time():
    import time

    began = time.perf_counter()
    for page in ("<div>" * 100_000 + "<p>" + "the text of it is here and so on " * 9 + "</p>" + "</div>" * 100_000, "<div><b>" * 50_000 + "x", "<ul>" + "<li><p>y" * 50_000 + "</span>" * 50_000):
        assert main_text(page) is not None
    assert time.perf_counter() - began < 20


STOP = "the of and to in is it was for that with as on at by this from they were be".split()


def made_page(rng):
    """A page around a known article, and the article's blocks."""
    word = lambda: rng.choice(STOP) if rng.random() < 0.45 else "".join(rng.choices("abcdefghiklmnoprstu", k=rng.randint(2, 9)))
    say = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    links = lambda n: "".join(f'<li><a href="/{k}">{say(rng.randint(1, 4))}</a></li>' for k in range(n))
    blocks, body = [], []
    for k in range(rng.randint(1, 12)):
        kind = rng.choice(["p", "p", "p", "h2", "blockquote", "li"]) if k else "h1"
        text = say(rng.randint(1, 6) if kind in ("h1", "h2") else rng.randint(2, 90))
        blocks.append(text)
        spaced = text.replace(" ", rng.choice([" ", "\n  ", " &#32;", "\t"])).replace("the", rng.choice(["the", "<b>the</b>", "t&#104;e"]))
        own = f"<{kind}>{spaced}</{kind}>"
        body.append(f"<ul>{own}</ul>" if kind == "li" else own)
        if rng.random() < 0.3:
            body.append(rng.choice(["<script>var p = '<p>x</p>';</script>", "<!-- <p>note</p> -->", "<style>p { top: 0 }</style>", f'<div class="advert">{say(20)}</div>', f"<form><label>{say(5)}</label><input></form>"]))
    around = [
        f"<header><a href=/>{say(3)}</a></header>", f"<nav><ul>{links(rng.randint(1, 9))}</ul></nav>", f'<aside class="sidebar"><p>{say(60)}</p></aside>', f'<div class="cookie-notice">{say(30)}</div>',
    ]
    after = [f'<section id="comments"><h3>Comments</h3><p>{say(70)}</p></section>', f"<footer><p>{say(40)}</p></footer>", f'<aside class="related"><ul>{links(5)}</ul></aside>']
    rng.shuffle(around)
    rng.shuffle(after)
    return f"<html><head><title>{say(4)}</title></head><body>{''.join(around[: rng.randint(0, 4)])}<article>{''.join(body)}</article>{''.join(after[: rng.randint(0, 3)])}</body></html>", "\n".join(blocks)


def test_known_articles_come_back_whole(spark):
    rng = random.Random(12)
    pages = [made_page(rng) for _ in range(150)]
    df = spark.createDataFrame([(i, f"u{i}", page) for i, (page, _) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in extract_main_text(df).collect()}
    wrong = [i for i, (_, text) in enumerate(pages) if got[i] != (text, len(text))]
    assert wrong == [], (pages[wrong[0]], got[wrong[0]])
