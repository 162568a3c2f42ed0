import math
import random

import pytest

from tracebound.llm import styletree as S


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))


def site(n=40, host="a.example.com", seed=1):
    """Pages whose template has no telling names at all, and what their articles say."""
    rng, rows = random.Random(seed), []
    menu = "".join(f"<div class=x><a href=/{k}>{w}</a></div>" for k, w in enumerate("home news sport".split()))
    tail = [words(rng, 8) for _ in range(3)]
    for i in range(n):
        title, one, two = words(rng, 4), words(rng, 30), words(rng, 20)
        page = (f"<html><head><title>{title}</title></head><body><div class=q1>{menu}</div><div class='q2 z'><h1>{title}"
                f"</h1><p>{one} &amp; <b>bold\n text</b><p>{two}</div><div class=q3>{rng.choice(tail)}</div></body></html>")
        rows.append((i, f"http://{host}/{i}", page, f"{title} {one} & bold text {two}"))
    return rows


@pytest.mark.parametrize("limit", [S.BROADCAST_NODES, 0])
def test_template_text_is_cut_by_entropy_alone(spark, limit):
    rows = site() + [(100 + i, u, p, t) for i, u, p, t in site(2, "b.example.com", 7)]
    df = spark.createDataFrame([(*r[:3], "x") for r in rows], "page_id long, url string, html string, path string")
    got = {r.page_id: r for r in S.extract(df, limit=limit).collect()}
    for i, url, _, text in rows:
        assert (got[i].text, got[i].url, got[i].n_chars) == (text, url, len(text))


def test_importance_against_the_formula(spark):
    rows = site(12) + [(50 + i, u, p, t) for i, u, p, t in site(3, "b.example.com", 3)]
    df = spark.createDataFrame([r[1:3] for r in rows], "url string, html string")
    seen = {}
    for _, url, page, _ in rows:
        for path, text in set(S.blocks(page)):
            seen.setdefault((S.host_of(url), path), []).append(text)
            seen.setdefault(("", path), []).append(text)

    def own(texts):
        m = len(texts)
        return 1.0 if m < 2 else 1 - sum(math.log(texts.count(t)) for t in texts) / (m * math.log(m))

    for r in S.style_tree(df).collect():
        path = next(p for _, p in seen if S.number(p) == r.path)
        mine, common = seen[r.host, path], seen["", path]
        want = (len(mine) * own(mine) + 20 * own(common)) / (len(mine) + 20) if len(common) >= 8 else 1.0
        assert r.pages == len(mine) and r.importance == pytest.approx(want)


def test_copies_of_an_article_stay(spark):
    rows = site(30)
    rows += [(100 + k, rows[0][1] + f"?{k}", rows[0][2], rows[0][3]) for k in range(15)]
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in S.extract(df).collect()}
    assert all(got[r[0]] == r[3] for r in rows)


def article(rng, host, k):
    parts = [words(rng, 20) for _ in range(10)]
    title = words(rng, 4)
    body = f"<html><body><div class=q2><h1>{title}</h1>" + "".join(f"<p>{x}</p>" for x in parts)
    return f"http://{host}/{k}", body, " ".join([title, *parts])


@pytest.mark.parametrize("share", [0.6, 1.0])
@pytest.mark.parametrize("repeated", [False, True])
def test_copies_add_no_weight(spark, share, repeated):
    rng, n = random.Random(2), 300
    copy = article(rng, "h.example.com", "copy")
    rows = [(k, copy[0] + ("" if repeated else f"?{k}"), *copy[1:]) if k < share * n
            else (k, *article(rng, "h.example.com", k)) for k in range(n)]
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in S.extract(df).collect()}
    assert all(got[r[0]] == r[3] for r in rows)


def test_copies_on_many_hosts_add_no_weight(spark):
    rng = random.Random(4)
    _, page, text = article(rng, "", 0)
    df = spark.createDataFrame(
        [(k, f"http://h{k}.example.com/", page) for k in range(60)], "page_id long, url string, html string")
    assert {r.text for r in S.extract(df).collect()} == {text}


@pytest.mark.parametrize("old, new", [
    ("<body>", '<body class="single-post no-ads">'), ("<div class='q2 z'>", "<div class='post has-sidebar'>"),
    ("<div class='q2 z'>", "<article class='comments-open'>"), ("<div class='q2 z'>", "<form><div class=z>"),
    ("<body>", "<body><form id=search role=form>")])
def test_hints_do_not_empty_an_article(spark, old, new):
    rows = [(i, u, p.replace(old, new), t) for i, u, p, t in site()]
    assert all(new in p for _, _, p, _ in rows)
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in S.extract(df).collect()}
    assert all(got[r[0]] == r[3] for r in rows)


def test_hints_beside_an_article_count(spark):
    rng, rows = random.Random(8), site()
    pages = [(i, u, p.replace("<div class=q3>", f"<div id=comments><div class=x><p>{words(rng, 15)}</div></div><div class=q3>"))
             for i, u, p, _ in rows]
    copy = pages[0][2].replace("</body>", "<div class=ad>{}</div></body>")
    copies = [(100 + k, f"http://a.example.com/c{k}", copy.format(words(rng, 5)), rows[0][3]) for k in range(300)]
    df = spark.createDataFrame(pages + [r[:3] for r in copies], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in S.extract(df).collect()}
    assert all(got[r[0]] == r[3] for r in rows + copies)


def test_a_short_article_outweighs_its_footer(spark):
    page = "<nav>far longer than this</nav><article>short</article><footer>also longer than the article</footer>"
    df = spark.createDataFrame([(1, "http://h/", page)], "page_id long, url string, html string")
    assert [r.text for r in S.extract(df).collect()] == ["short"]


def test_presentation_nodes_and_odd_markup():
    def text(page):
        return " ".join(t for _, t in S.blocks(page))

    assert text("<nav>menu</nav><article><header><h1>T</h1></header>a<b>b</b>c<br>d</article><footer>f</footer>") == "T abc d"
    assert text("<header>top</header><div class='cookie-notice'>ok</div><div id=comments><p>hi</p></div><p>x") == "x"
    assert text("<p>a &lt; b &amp;amp; &#233;&nbsp; \n c</p><script>var p='</p>';</script><style>p{}</style>") == "a < b &amp; é c"
    assert text("<p>1 < 2<p title='>'>three<!-- <p>no</p> --> four<form><p>no</p></form><li>x<li>y") == "1 < 2 three four x y"
    assert text("<div class=advice>kept</div><aside>no</aside><p class=shared-thing>kept") == "kept kept"
    assert text("<p><b>one<br><p>two</p></article></html>") == "one two"
    assert text("") == "" and text("<") == "<" and text("plain") == "plain"


def test_hosts():
    assert S.host_of("https://U:p@Www.Example.com:80/x?y") == "www.example.com"
    assert S.host_of(None) == S.host_of("no url") == ""


def test_nulls_repeats_and_empty(spark):
    rows = [(1, None, "<p>x</p>"), (2, "http://h/", None), (3, "http://h/", ""), (None, "http://h/", "<p>y"),
            (1, None, "<p>x</p>"), (4, "http://h/", "<p>" + "long " * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.text) for r in S.extract(df).collect())
    assert got == sorted([("1", "x"), ("1", "x"), ("2", ""), ("3", ""), ("None", "y"), ("4", ("long " * 100_000).strip())])
    assert S.extract(df.limit(0)).collect() == []
