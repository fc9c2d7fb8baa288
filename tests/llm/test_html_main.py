import random
from collections import Counter, defaultdict

import pytest

from glosspark.llm import html_main as h

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/x">Menu</a></li></ul></nav>'
    '<div class="cookie-banner">We use cookies</div><div id="wrap{n}"><div class="story"><h2>Head {n}</h2><p>First &amp; <b>bo</b>ld{n}<p>Second&nbsp;one {n}<ul><li>a<li>b</ul>{more}</div>'
    '<div class="comments"><p>nice {n}</p></div></div><div class="strip">Always here</div><form>q<input></form><aside>side</aside><footer>&copy; x</footer></body></html>'
)
WANT = "Head {n} First & bold{n} Second one {n} a b{more}"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' AS host", "'y' AS text", "'z' AS slot", "1 AS mark")


def test_template_across_pages(spark):
    rows = [(n, f"http://H.example/{n}", PAGE.replace("{n}", str(n)).replace("{more}", f" tail {n} " * (n % 3))) for n in range(12)]
    got = {r.page_id: r.text for r in h.extract_main(pages(spark, rows)).collect()}
    for n in range(12):
        assert got[n] == " ".join(WANT.replace("{n}", str(n)).replace("{more}", f" tail {n} " * (n % 3)).split())


def test_broadcast_and_join_agree(spark):
    rows = [(n, f"http://h{n % 3}.example/{n}", PAGE.replace("{n}", str(n)).replace("{more}", "")) for n in range(12)]
    a = {r.page_id: r.text for r in h.extract_main(pages(spark, rows)).collect()}
    assert a == {r.page_id: r.text for r in h.extract_main(pages(spark, rows), broadcast_bytes=-1).collect()}


def test_edges(spark):
    long = "<article>" + "<p>word word</p>" * 20_000 + "</article>"
    rows = [(1, None, None), (2, "u", ""), (3, "u", "plain text"), (4, "http://z/", long), (4, "http://z/", long), (None, "u", "<p>x"), (5, "u", "<article><header><h1>T</h1></header>b<!-- c --><script>x</script>&lt;</article>tail"), (6, "u", "a<br>b<td>c</td><td>d</td>cut <a hre")]
    got = h.extract_main(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    assert texts[1] == texts[2] == "" and texts[3] == "plain text" and texts[4] == " ".join(["word word"] * 20_000) and texts[None] == "x" and texts[5] == "T b<" and texts[6] == "a b c d cut"
    assert h.extract_main(pages(spark, rows).limit(0)).collect() == []


def test_classes_nest_in_the_skeleton(spark):
    rows = [(n, "http://h.example/", f"<body><div class='a'><p>{'x ' * (9 * n)}</p>{'<i>y</i>' * (n % 3 + 1)}</div>{'<div class=b><p>z</p></div>' * (n % 4 > 0)}</body>") for n in range(1, 9)]
    df = pages(spark, rows).drop("host", "text", "slot", "mark").withColumn("host", h.host_of(h.F.col("url")))
    tokens = [h.Token(*(r[c] for c in h.Token._fields)) for r in h.token_vectors(df).collect()]
    skeleton, below = h.nested(tokens, 8)
    assert skeleton == {"", "body", "body/div.a", "body/div.a/p"}
    assert sorted(below["body"]) == ["body/div.b", "body/div.b/p"] and below["body/div.a"] == ["body/div.a/i"]
    assert h.deduce(tokens, 8)[0].slot == "body/div.a"


def test_equal_vectors_make_a_class(spark):
    rows = [(n, "http://h.example/", f"<body><div><p>{'x' * n}</p>{'<i>y</i>' * (n % 2)}</div><div class='s'>same</div></body>") for n in range(1, 9)]
    df = pages(spark, rows).drop("host", "text", "slot", "mark").withColumn("host", h.host_of(h.F.col("url")))
    got = {(r.path, r.block is not None): r for r in h.token_vectors(df).collect()}
    assert got["body/div:prose/p", False].sketch == got["", False].sketch == got["body/div.s", False].sketch == got["body/div.s", True].sketch
    assert got["body/div:prose/i", False].sketch != got["", False].sketch and got["body/div:prose/i", False].df == 4


def test_paths_of_one_page_count_on_hosts_of_any_size(spark):
    def page(n):
        slug = "".join(chr(97 + int(c)) for c in str(n))
        return f"<html><body><div class='wrap'><div id='a-{slug}'><p>{f'body {slug} ' * 9}</p></div><div class='teaser'><p>next {slug}</p></div></div></body></html>"

    for size in (10, 1_200):
        got = {r.page_id: r.text for r in h.extract_main(pages(spark, [(n, f"http://h.example/{n}", page(n)) for n in range(size)])).collect()}
        assert len(got) == size and got[3] == "body d " * 9 + "next d" and all(t.startswith("body") for t in got.values())


def test_copies_of_a_page_keep_their_text(spark):
    def page(n):
        return f"<html><body><nav>menu</nav><h1>Head {n}</h1><p>Text of page {n}</p></body></html>"

    rows = [(1, "http://two.example/a", page(1)), (2, "http://two.example/b", page(1))] + [(3, "http://row.example/", page(3))] * 3
    rows += [(n, f"http://hot.example/{n}", page(10 if n < 20 else n)) for n in range(10, 30)]
    got = [(r.page_id, r.text) for r in h.extract_main(pages(spark, rows)).collect()]
    assert sorted(got) == sorted((i, f"Head {k} Text of page {k}") for i, k in [(1, 1), (2, 1), (3, 3), (3, 3), (3, 3), *((n, 10 if n < 20 else n) for n in range(10, 30))])


def test_a_page_of_template_text_only_is_not_emptied(spark):
    rows = [(n, f"http://h.example/{n}", f"<html><body><h1>Same</h1><p>Same text</p><nav>{n}</nav></body></html>") for n in range(4)]
    assert [r.text for r in h.extract_main(pages(spark, rows)).collect()] == ["Same Same text"] * 4


@pytest.mark.parametrize("root", ["article", "main"])
def test_the_whole_article_is_kept(spark, root):
    def page(n):
        return f"<html><body><nav>menu</nav><div class='wrap'><{root} class='post'><header><h1>Head {n}</h1><p>Lead {n}</p></header><div class='body'><p>{f'long {n} ' * 40}</p></div></{root}></div><div class='strip'>Always here</div></body></html>"

    got = {r.page_id: r.text for r in h.extract_main(pages(spark, [(n, f"http://h.example/{n}", page(n)) for n in range(12)])).collect()}
    assert got == {n: f"Head {n} Lead {n} " + " ".join([f"long {n}"] * 40) for n in range(12)}


def said(r, n):
    return " ".join("".join(r.choices("abcdefghijklmnopqrstuvw", k=r.randint(2, 9))) for _ in range(n))


def div_page(r, style):
    """A page of plain boxes without classes, and its main text: menus and teasers vary, notices come and go,
    comments are as many as they are."""
    links = [f"<a href='/{i}'>{said(r, 1)}</a>" for i in range(r.randint(3, 8))]
    menu = "<div><ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul></div>" if style % 2 else f"<div>{' '.join(links)}</div>"
    title, texts = said(r, r.randint(3, 8)), [said(r, r.randint(10, 60)) for _ in range(r.randint(2, 9))]
    body = [f"<p>{p}</p>" for p in texts]
    if r.random() < 0.4:
        items = [said(r, 4) for _ in range(3)]
        body.insert(1, "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
        texts[1:1] = items
    story = f"<div><div><h1>{title}</h1></div><div>{''.join(body)}</div></div>" if style % 3 == 1 else f"<div><h1>{title}</h1>{''.join(body)}</div>"
    notice = "<div>We use cookies to improve this site. Read more.</div>" * (r.random() < 0.6)
    sale = "<div><p>Sale today only</p></div>" * (r.random() < 0.7)
    comments = "<div><h3>Comments</h3>" + "".join(f"<div><b>{said(r, 1)}</b> wrote<p>{said(r, r.randint(3, 25))}</p></div>" for _ in range(r.choice([0, 1, 2, 5]))) + "</div>"
    teasers = "<div>" + "".join(f"<div><a href=x>{said(r, 5)}</a></div>" for _ in range(4)) + "</div>"
    rest = f"{menu}{sale}<div>{story}{comments}</div>" if style % 2 else f"{menu}{story}{comments}"
    return f"<html><body>{notice}{rest}{teasers}<div>All rights reserved by the owner</div></body></html>", " ".join([title, *texts])


def agreement(pairs):
    both = got = want = 0
    for a, b in pairs:
        x, y = Counter(a.split()), Counter(b.split())
        both, got, want = both + (x & y).total(), got + x.total(), want + y.total()
    return both / got, both / want


def test_hosts_of_plain_boxes(spark):
    r, rows, want = random.Random(5), [], {}
    for style in range(6):
        for n in (4, 12, 40):
            for _ in range(n):
                html, text = div_page(r, style)
                want[len(rows)] = text
                rows.append((len(rows), f"http://h{style}-{n}.example/{len(rows)}", html))
    df = pages(spark, rows)
    for found in (h.extract_main(df), h.extract_main(df, broadcast_bytes=-1)):
        precision, recall = agreement([(t.text, want[t.page_id]) for t in found.collect()])
        assert precision >= 0.98 and recall >= 0.98
    # the template carries the result: by the pages alone it is lost
    assert agreement([(h.main_text(html, None), want[i]) for i, _, html in rows])[0] < 0.8


def test_places_are_told_apart_by_the_classes_around_them(spark):
    def page(n):
        r = random.Random(n)
        notice = f"<div><p>Sale {said(r, 3)} ends</p></div>" * (n % 2)  # of the story's kind, before it, on every second page
        text = " ".join([f"story {said(r, 40)}"])
        return f"<body>{notice}<div><a href=x>{said(r, 3)}</a></div><div><p>{text}</p></div><div><a href=y>next</a></div></body>", text

    rows = [(n, "http://h.example/", page(n)[0]) for n in range(20)]
    got = {k: [(t.text, page(t.page_id)[1]) for t in h.extract_main(pages(spark, rows), rounds=k).collect()] for k in (1, 3)}
    assert all(a == b for a, b in got[3])
    assert agreement(got[1])[0] < 0.98


def test_sums_and_classes_are_those_of_the_vectors(spark):
    r = random.Random(8)
    rows = [(n, "http://h.example/", div_page(r, 1)[0]) for n in range(30)]
    df = pages(spark, rows).drop("host", "text", "slot", "mark").withColumn("host", h.host_of(h.F.col("url")))
    vectors = defaultdict(lambda: [0] * 30)
    for n, _, html in rows:
        page = h.Page(html)
        for role in page.roles()[0]:
            vectors[role][n] += 1
    got = {t.path: t for t in h.token_vectors(df).collect() if t.block is None and not t.path.endswith(h.ANY)}
    assert {p: (t.df, t.n) for p, t in got.items()} == {p: (sum(map(bool, v)), sum(v)) for p, v in vectors.items()}
    by_sketch, by_vector = defaultdict(set), defaultdict(set)
    for p, t in got.items():
        by_sketch[t.df, t.n, t.sketch].add(p)
        by_vector[tuple(vectors[p])].add(p)
    assert sorted(map(sorted, by_sketch.values())) == sorted(map(sorted, by_vector.values()))


def test_article_words_are_not_dropped(spark):
    html = '<article><p>a <math>x+y</math> b</p><p class="ad-hoc">c</p><div class="search-theory">d</div><div class="site-footer">n</div><div class="comments-list">n</div><div class="ad">n</div><p>e</p></article>'
    assert [r.text for r in h.extract_main(pages(spark, [(1, "u", html)])).collect()] == ["a x+y b c d e"]


def test_bytes_that_are_no_text(spark):
    df = spark.sql("SELECT 1L AS page_id, 'u' AS url, CAST(X'3C703E61FF62' AS STRING) AS html")
    assert h.extract_main(df).first().text == "a\ufffdb"


def test_an_article_is_never_cut_in_part(spark):
    def page(n):
        r = random.Random(n)
        asked = "".join(f"<div><b>{said(r, 4)}</b> {said(r, 9)}</div>" for _ in range(4))
        links = f"<div><a href=x>{said(r, 6)}</a></div>"
        return f"<body><div><a href=/>home</a></div><article><div><h1>{said(r, 5)}</h1><p>{said(r, 60)}</p></div><div>{asked}</div>{links}</article><div>{'<div>' + said(r, 9) + '</div>'}</div></body>"

    rows = [(n, "http://h.example/", page(n)) for n in range(12)]
    for t in h.extract_main(pages(spark, rows)).collect():
        inside = rows[t.page_id][2].split("<article>")[1].split("</article>")[0]
        assert Counter(t.text.split()) == Counter(h.main_text(f"<article>{inside}</article>", None).split())
