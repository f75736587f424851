import pytest

from feedloom.llm.extract import extract, main_text

LONG = "This is the text of the article and it has to be long enough for the first pass to see that it is one of the good blocks. " * 2


@pytest.mark.parametrize("html,want", [
    (None, ""), ("", ""), ("<p>", ""), (f"<article><h1>A &amp; B</h1><p>{LONG}<p>end&nbsp;of  it</article>", f"A & B {LONG.strip()} end of it"),
    (f"<nav>menu</nav><header>top</header><main><p>{LONG}</p></main><footer>f</footer>", LONG.strip()),
    (f"<script>var t='</p><p>x';</script><style>p</style><article><p>{LONG}</p></article>", LONG.strip()),
    (f"<article><p>{LONG}</p><div class='comments'><p>{LONG}</p></div></article>", LONG.strip()),
    (f"<div id=sidebar><p>{LONG}</p></div><div class='content'><p>{LONG}</p></div>", LONG.strip()),
    (f"<div class='cookie-notice'>{LONG}</div><form>{LONG}</form><aside>{LONG}</aside><p>{LONG}", LONG.strip()),
    (f"<!-- {LONG} --><p>{LONG}</p><p><a href='x'>{LONG}</a></p>", LONG.strip()),
    (f"<nav><ul><li><a href=x>open menu<article><p>{LONG}</article>", LONG.strip()),
    (f"<p>{LONG}</p><p>short</p><p>{LONG}</p><p>x</p>", f"{LONG.strip()} short {LONG.strip()} x"),
    ("<article><h1>T</h1><p>One.</article>", "T One."), ("plain & short", ""), (f"<p title='a>b'>{LONG}<br>x", f"{LONG.strip()} x"),
])
def test_pages(html, want):
    assert main_text(html or "") == want


@pytest.mark.parametrize("name", ["content with-sidebar", "has-sidebar", "market-share report", "post no-comments", "ad-free story"])
def test_names_are_hints(name):
    """A name that tells of a state, or sounds like an advert, does not lose the article; comments in it still go."""
    page = f"<nav>menu</nav><div class='{name}'><p>{LONG}</p><p>{LONG}</p><div class='comments'><p>{LONG}</p></div></div><footer>{LONG}</footer>"
    assert main_text(page) == f"{LONG.strip()} {LONG.strip()}"


def test_pieces_of_a_line_do_not_part_it():
    assert main_text(f"<p>{LONG}wo<span class='ad'>x</span>rd<b class='share'> y</b>, end</p>") == f"{LONG}word, end"


def test_page_in_a_form():
    assert main_text(f"<form><p>{LONG}</p><div class='sidebar'><p>{LONG}</p></div></form>") == LONG.strip()
    assert main_text(f"<div><p>{LONG}</p></div><form><p>{LONG}</p><p>{LONG}</p></form>") == LONG.strip()


def test_more_comments_than_article():
    """Comments stay out however long they are, as long as the article has a good block."""
    assert main_text(f"<div><p>{LONG}</p></div><div class='comments'>" + f"<p>{LONG}</p>" * 20 + "</div>") == LONG.strip()


def test_broken_markup_is_read_to_its_end():
    assert isinstance(main_text("<" * 2000 + "a b='" * 500), str)
    assert main_text("<" * 2000 + f"</nav><p class='x>y'>{LONG}").endswith(LONG.strip())


def test_rows(spark):
    rows = [(1, "u", f"<p>{LONG}", "x"), (1, "u", f"<p>{LONG}", "x"), (None, None, None, "y"), (2, "u", "<p>" + LONG * 500, "z")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = extract(df).collect()
    assert len(got) == 4 and sum(r["text"] == "" for r in got) == 1 and max(len(r["text"]) for r in got) > 100_000
    assert extract(df.filter("false")).count() == 0
