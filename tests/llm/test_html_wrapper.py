import json
import random
import re

from pyspark.sql import functions as F

from quillet.llm import html_wrapper as H


def page(title, items, paragraphs, ad=False, footer="Imprint"):
    ps = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f"<html><head><title>{title}</title><script>var x='<p>no</p>';</script></head><body><ul>{''.join(f'<li>{i}' for i in items)}</ul>{'<div class=ad>Buy</div>' if ad else ''}<!-- c --><article>{ps}</article><footer>{footer}</footer></body></html>"


def test_parse_fold_and_expression():
    tree = H.parse("<ul><li>a<li>b</ul><p>x<br>y<p>z &amp; w")
    assert H.expression(H.shape(tree)) == "<ul>(<li>#</li>)+</ul>(<p>#(<br></br>)?(#)?</p>)+"


def test_alignment_makes_optional_and_repeated_groups():
    shapes = [H.shape(H.parse(page("t", ["a", "b"], ["p"]))), H.shape(H.parse(page("t", ["a"], ["p", "q", "r"], ad=True)))]
    w = H.fold(H.align(*shapes))
    assert H.expression(w) == "<html><head><title>#</title></head><body><ul>(<li>#</li>)+</ul>(<div>#</div>)?<article>(<p>#</p>)+</article><footer>#</footer></body></html>"


def test_wrapper_accepts_all_its_pages_in_any_order():
    rng = random.Random(11)

    def random_html(depth=0):
        out = ""
        for _ in range(rng.randrange(4)):
            out += rng.choice(["txt ", "<b>x</b>", "<hr>", "<p>y", "<div>" + (random_html(depth + 1) if depth < 3 else "") + "</div>", "<li>i"])
        return out

    for _ in range(60):
        pages = [H.parse("<body>" + random_html() + "</body>") for _ in range(5)]
        w = json.loads(H._align_all([json.dumps(H.shape(p)) for p in pages]))
        for p in pages:
            got, ok = H.read(w, p)
            assert [t for _, t in got] == [t for n in p for t in H.texts(n)]
            assert ok, (H.expression(w), p)


def test_fields_of_hosts(spark):
    rows = [(i, f"http://a.com/{i}", page(f"T{i}", ["home", "about"][: 1 + i % 2], [f"p{i}{j}" for j in range(1 + i % 3)], ad=i == 2)) for i in range(6)]
    rows += [(6, "http://b.com/", page("only", ["x"], ["y"])), (7, "http://a.com/n", None), (8, None, "<p>no host"), (9, "http://a.com/e", ""), (0, "http://a.com/0", rows[0][2]), (None, "http://c.com", "<b>" + "long " * 40_000 + "</b>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("zzz")).withColumn("fields", F.lit(1)).withColumn("key", F.lit(1))
    out = {}
    for r in H.extract(df).collect():
        out.setdefault(r.page_id, []).append(r)
    assert len(out[0]) == 2 and sum(map(len, out.values())) == len(rows)
    assert all(r.accepted for rs in out.values() for r in rs)
    # the footer is the same on all of a.com's pages that hold anything
    assert [f.text for f in out[5][0].fields] == ["T5", "home", "about", "p50", "p51", "p52"]
    assert out[7][0].fields == [] and out[9][0].fields == [] and out[8][0].text == "no host"
    assert out[6][0].text.split("\n") == ["only", "x", "y", "Imprint"]
    assert H.extract(df.limit(0)).count() == 0


def test_whole_table_loses_no_text(spark, small):
    df = spark.read.parquet(f"{small}/pages.parquet")
    html = {r.page_id: r.html for r in df.collect()}
    for r in H.extract(df).collect():
        assert r.accepted
        every = [t for n in H.parse(html[r.page_id]) for t in H.texts(n)]
        kept = [f.text for f in r.fields]
        it = iter(every)
        assert all(t in it for t in kept)


def test_copies_of_a_page_are_one_page(spark):
    """A host of copies keeps its content; repeats in a page don't make a text of half the pages template."""
    copy = page("only", ["x"], ["y"])
    rows = [(i, "http://copies.com/", copy) for i in range(3)]
    rows += [(10 + i, f"http://some.com/{i}", "<body><h1>T%d</h1>%s<i>foot</i></body>" % (i, "<ul>" + "<li>new</li>" * 2 + "</ul>" if i % 2 else "")) for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r.text.split("\n") for r in H.extract(df).collect()}
    assert all(out[i] == ["only", "x", "y", "Imprint"] for i in range(3))
    assert [out[10 + i] for i in range(4)] == [["T0"], ["T1", "new", "new"], ["T2"], ["T3", "new", "new"]]


def test_common_lengths_like_a_table():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        best = H._common_lengths(a, b)
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
        assert all(best(i, j) == table[i][j] for i in range(len(a) + 1) for j in range(len(b) + 1))


def pattern(seq):
    """The expression of one level for re: a letter for each atom."""
    return "".join(f"(?:{pattern(e[1])}){e[0]}" if e[0] in "+?" else "T" if e[0] == H.TEXT else e[1] for e in seq)


def accepts(seq, nodes):
    """Brute force, by backtracking: whether some way of reading the level fits, children included."""

    def at(es, i):
        if not es:
            yield i
            return
        e, rest = es[0], es[1:]
        if e[0] == "?":
            for j in at(e[1], i):
                yield from at(rest, j)
            yield from at(rest, i)
        elif e[0] == "+":
            for j in at(e[1], i):
                yield from at(rest, j)
                if j > i:
                    yield from at([e, *rest], j)
        elif i < len(nodes) and (nodes[i][0] == H.TEXT) == (e[0] == H.TEXT) and (e[0] == H.TEXT or nodes[i][1] == e[1] and accepts(e[2], nodes[i][2])):
            yield from at(rest, i + 1)

    return any(j == len(nodes) for j in at(seq, 0))


def test_matching_like_regular_expressions():
    rng = random.Random(5)

    def expr(depth=0):
        out = []
        for _ in range(rng.randrange(1, 4)):
            kind = rng.random()
            out.append(["t", rng.choice("ab"), []] if kind < 0.5 or depth > 2 else [H.TEXT] if kind < 0.6 else [rng.choice("+?"), expr(depth + 1)])
        return out

    some = 0
    for _ in range(400):
        seq, word = expr(), "".join(rng.choice("abT") for _ in range(rng.randrange(6)))
        nodes = [[H.TEXT, "x"] if c == "T" else ["t", c, []] for c in word]
        ok = H._match(seq, nodes)[1]
        assert ok == (re.fullmatch(pattern(seq), word) is not None) == accepts(seq, nodes)
        some += ok
    assert some > 20


def test_inferred_wrappers_by_brute_force():
    """Backtracking reads every page by the wrapper of all, whatever the order of alignment and its rounds."""
    rng = random.Random(12)

    def html(depth=0):
        return "".join(rng.choice(["t ", "<b>x</b>", "<hr>", "<p>y</p>", "<div>" + (html(depth + 1) if depth < 2 else "") + "</div>"]) for _ in range(rng.randrange(4)))

    for _ in range(40):
        pages = [H.parse("<body>" + html() + "</body>") for _ in range(6)]
        shapes = [json.dumps(H.shape(p)) for p in pages]
        for w in (H._align_all(shapes), H._align_all([H._align_all(shapes[:3]), H._align_all(shapes[3:])])):
            assert all(accepts(json.loads(w), p) for p in pages), H.expression(json.loads(w))


def test_deep_and_wide_pages(spark):
    """Text of any depth stays; thousands of neighbours align."""
    deep = "<div>" * 3000 + "core" + "</div>" * 3000 + "<i>after</i>"
    unclosed = "<b>" * 5000 + "bold" + "<i>x" * 3000
    rng = random.Random(6)
    wide = ["".join(rng.choice(["<p>a</p>", "<h2>b</h2>", "<ul><li>c</ul>", "text<br>"]) for _ in range(3000)) for _ in range(2)]
    rows = [(1, "http://a.com/1", deep), (2, "http://a.com/2", deep.replace("core", "other")), (3, "http://b.com", unclosed), (4, "http://c.com/1", wide[0]), (5, "http://c.com/2", wide[1]), (6, "http://d.com", "a < b " * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r for r in H.extract(df).collect()}
    assert all(r.accepted for r in out.values())
    assert out[1].text == "core" and out[2].text == "other" and out[3].text.split("\n") == ["bold", *["x"] * 3000]
    assert out[6].text == " ".join(["a < b"] * 100_000)
    tree = H.parse("<div>" * 3000 + "core" + "</div>" * 3000 + "<i>after</i>")
    assert [n[1] for n in tree] == ["div", "i"]


def test_rounds_give_one_wrapper_for_each_host(spark, small):
    df = spark.read.parquet(f"{small}/pages.parquet")
    few, many = ({r.host: r for r in H.wrappers(df, fan_in=n).collect()} for n in (2, 1000))
    assert few.keys() == many.keys() and {h: r.shapes for h, r in few.items()} == {h: r.shapes for h, r in many.items()}
    for url, text in df.select("url", "html").collect():
        host = re.match(H._HOST, url)[1].lower()
        assert all(H.read(json.loads(w[host].wrapper), H.parse(text))[1] for w in (few, many))
