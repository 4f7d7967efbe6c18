import random

import pytest

from reelmill.llm import html_crf as H
from reelmill.llm.html_blocks import parse
from reelmill.llm.queries import op9_html_main_text
from tests.llm.written_pages import PAGES


@pytest.fixture(scope="module")
def field(spark, sf_dir):
    return H.train(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def test_pages_that_mark_their_article(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    # the field saw none of these pages' structure: it was trained on layouts
    for r in op9_html_main_text(spark, sf_dir).collect():
        want = [b.text for b in parse(pages[r.page_id]).blocks if any(t == "article" for t, _ in b.path)]
        assert r.text == "\n".join(want) and r.n_chars == len(r.text)


def test_other_layouts_held_out(field, spark, sf_dir):
    texts = [b.text for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect() for b in parse(r.html).blocks]
    right = total = 0
    for k in range(300):
        made = parse(H.layout(random.Random(7_000 + k), texts)).blocks
        right += sum(y == b.label for b, y in zip(made, field.decode(made), strict=True))
        total += len(made)
    assert right / total > 0.96


def strange_page(rng, texts):
    """A page whose names mean nothing, by another way of making pages than the one that trains: (html, blocks of its article)."""
    name = lambda: rng.choice(["", f' class="{"".join(rng.choice("xqzvkw") for _ in range(4))}"', f' id="n{rng.randrange(99)}"'])
    words = lambda a, b: " ".join(rng.choice(texts).split()[: rng.randint(a, b)]) or "x"
    paragraphs = [words(20, 90) for _ in range(rng.randint(3, 7))]
    title, lead = words(3, 8), [f"<div{name()}>{words(1, 3)}</div>", f"<ul{name()}>" + "".join(f"<li><a href=/{i}>{words(1, 2)}</a></li>" for i in range(rng.randint(3, 7))) + "</ul>", f"<div{name()}>" + " | ".join(f"<a href=/{i}>{words(1, 2)}</a>" for i in range(4)) + "</div>"]
    tail = [f"<div{name()}><h4>{words(1, 2)}</h4>" + "".join(f"<p><a href=/{i}>{words(3, 7)}</a></p>" for i in range(3)) + "</div>", f"<div{name()}>© 2020 {words(1, 3)}</div>", f"<div{name()}><form><label>{words(1, 2)}</label><button>{words(1, 1)}</button></form></div>"]
    own = rng.choice(["div", "section", "article", "main"])
    inner = f"<h1>{title}</h1>" + "".join(f"<p>{x}</p>" for x in paragraphs)
    lead, tail = rng.sample(lead, rng.randint(1, 3)), rng.sample(tail, rng.randint(1, 3))
    page = "".join(lead) + f"<{own}{name()}>{inner}</{own}>" + "".join(tail)
    return f"<html><body>{page if rng.random() < 0.5 else f'<div{name()}>{page}</div>'}</body></html>", [" ".join(x.split()) for x in (title, *paragraphs)]


def test_pages_of_another_make(field, spark, sf_dir):
    texts = [b.text for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect() for b in parse(r.html).blocks if len(b.text) > 60]
    rng, whole = random.Random(77), 0
    for _ in range(200):
        html, want = strange_page(rng, texts)
        blocks = parse(html).blocks
        whole += [b.text for b, y in zip(blocks, field.decode(blocks), strict=True) if y] == want
    assert whole >= 185


def test_written_styles(field):
    wrong = [n for n, (html, want) in PAGES.items() if "|".join(b.text for b, y in zip(parse(html).blocks, field.decode(parse(html).blocks), strict=True) if y) != want]
    assert len(wrong) <= 2, wrong


#: Pages written by hand, and their main text.
WRITTEN = {
    "table": ("<nav><a href=1>Home</a></nav><article><h1>Title here</h1><p>Some text, first.</p><table><tr><th>Name</th><th>Age</th></tr><tr><td>Bob</td><td>42</td></tr></table><p>End of it.</p></article>", "Title here|Some text, first.|Name|Age|Bob|42|End of it."),
    "unclosed": ("<nav><ul><li><a href=x>Home</a></ul></nav><article><h1>T</h1><p>One sentence here.<p>Two<div>Three</div></article><footer>&copy; x</footer>", "T|One sentence here.|Two|Three"),
    "comments": ("<article><h1>A title</h1><p>Main text of the article, and so on.</p><div class='comments'><h3>Comments</h3><p>I like this, thanks a lot for it.</p></div></article>", "A title|Main text of the article, and so on."),
    "notice, form": ("<div class='cookie-notice'>We use cookies, and you agree.</div><main><h1>A title</h1><p>Main text, and so on.</p><form><label>Mail</label><button>Go</button></form><p>More of the text.</p></main><aside><p>Popular now: this thing.</p></aside>", "A title|Main text, and so on.|More of the text."),
    "no marks": ("<div id='header'>My Site</div><div class='menu'><a href=1>a</a> <a href=2>b</a></div><div class='content'><h2>News</h2>Plain text in a div with no paragraph, long enough to count.<br>Next line.</div><div class='sidebar'>Tags: a b c</div><div id='footer'>Copyright 2020</div>", "News|Plain text in a div with no paragraph, long enough to count. Next line."),
    "advert inside": ("<article><h1>Head</h1><p>The first half of the text, as it was.</p><div class='ad'>Buy this now, it is cheap.</div><p>The other half of the text.</p></article>", "Head|The first half of the text, as it was.|The other half of the text."),
}


@pytest.mark.parametrize("name", WRITTEN)
def test_pages_written_by_hand(field, name):
    html, want = WRITTEN[name]
    blocks = parse(html).blocks
    assert "|".join(b.text for b, y in zip(blocks, field.decode(blocks), strict=True) if y) == want


def test_repeated_pages_count_once(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("html")
    once = H.train(pages, sample_blocks=300)
    again = H.train(pages.unionByName(pages.limit(1).crossJoin(spark.range(3000)).select("html")), sample_blocks=300)
    assert (once.emit == again.emit).all()


def test_viterbi_against_all_labellings(field):
    from itertools import product

    blocks = parse("<nav><a>x</a></nav><div><p>One long sentence, with commas, and so on.</p><p>Two.</div><footer>&copy; y</footer>").blocks
    s = field.scores(blocks)
    best = max(product((0, 1), repeat=len(blocks)), key=lambda y: sum(s[i, v] for i, v in enumerate(y)) + sum(field.step[a, b] for a, b in zip(y, y[1:])))
    assert field.decode(blocks) == list(best)


def test_blocks():
    html = "<p>A&nbsp;&amp;\n <b>b<br>c<p>d<script>x='<p>no</p>'</script>e<ul><li>1<li>2</ul><!-- no --><td>t &am</td><![CDATA[x]]>"
    assert [b.text for b in parse(html).blocks] == ["A & b c", "de", "1", "2", "t &am"]
    assert parse(None).blocks == [] and parse("").blocks == [] and [b.text for b in parse("<p>un<closed").blocks]


def test_edges(field, spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x"), (3, "u", "plain"), (3, "u", "plain"), (4, "u", "<article>" + "<p>word, and more.</p>" * 20_000 + "</article>")]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = H.extract(pages, field).collect()
    assert len(got) == len(rows) and [r.text for r in got if r.page_id in (1, 2)] == ["", ""]
    assert [r.n_main for r in got if r.page_id == 4] == [20_000]
    assert H.extract(pages.limit(0), field).collect() == []
    H.train(pages.limit(0))
