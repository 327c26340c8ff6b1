import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.conftest import SMALL
from veta.llm import dom, html_extract

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/x>Home</a></li>"
    "<li><a href=/y>More</a></ul></nav><!-- no --><div class='ad'>Buy this. Now.</div><article><h1>Head &amp; line %d</h1><p>Some  words\n of the <b>text</b> here, %d.<br>"
    "<p>It goes on &lt;so&gt; for a while, and then it ends with a full stop.</p></article><footer>&copy; Us. All rights.</footer></body></html>"
)


def test_pages(spark):
    rows = [(i, "u", PAGE % (i, i)) for i in range(40)] + [(90, None, None), (None, "u", ""), (91, "u", "no markup < at all"), (92, "u", "<p"), (3, "u", PAGE % (3, 3))]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(1))
    got = html_extract.extract(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] is not None and r["page_id"] < 40:
            i = r["page_id"]
            assert r["text"] == f"Head & line {i}\nSome words of the text here, {i}.\nIt goes on <so> for a while, and then it ends with a full stop."
        assert r["n_chars"] == len(r["text"])
    assert html_extract.extract(frame.limit(0)).count() == 0


PLAIN = (
    "<html><body><div id=top><ul><li><a href=/x>Home</a><li><a href=/y>More</a></ul></div><div class=story><h2>Title %d</h2><p>The first paragraph of this "
    "story tells, at some length, what happened on day %d of it.</p><p>A second one goes on, and it ends with a full stop as well as the first.</p></div>"
    "<div class=sidebar><p><a href=/z>See also this other page of ours</a></p></div><div>&copy; Us</div></body></html>"
)


@pytest.mark.parametrize("plain", [1, 5])
def test_plain_pages_among_pages_with_an_article(spark, plain):
    rows = [(i, "u", PAGE % (i, i)) for i in range(200)] + [(1000 + i, "u", PLAIN % (i, i)) for i in range(plain)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i in range(plain):
        assert got[1000 + i] == (
            f"Title {i}\nThe first paragraph of this story tells, at some length, what happened on day {i} of it.\n"
            "A second one goes on, and it ends with a full stop as well as the first."
        )
    assert got[7] == "Head & line 7\nSome words of the text here, 7.\nIt goes on <so> for a while, and then it ends with a full stop."


STORY = [
    "The first paragraph of this story tells, at some length, what happened on day 5 of it.",
    "A second one goes on, and it ends with a full stop as well as the first.",
]
SHAPES = {  # head, body with {} where the story stands, and lines that go with the story
    "body class": '<body class="no-sidebar">{}</body>',
    "body classes": '<body class="single comments-open">{}</body>',
    "wrapper id": '<body><div id="main-header-banner">{}</div></body>',
    "content class": '<body><div id=top><a href=/x>Home page</a></div><div class="post-content share-ready">{}</div></body>',
    "section in article": '<body><article><p>Some words of the text here, to begin with it all.</p><div class="form-history">{}</div></article></body>',
    "id in article": '<body><article><p>Some words of the text here, to begin with it all.</p><section id="related-work">{}</section></article></body>',
    "aside classes": '<body><div class="site-footer"><p>All rights are with us, and we say so here at length, every day.</p></div><div class=story>{}</div></body>',
    "comments": '<body><main>{}<div class="comment-list"><p>I read all of this text and I do not agree with one word of it.</p></div></main></body>',
    "camel": '<body><main>{}</main><div id="cookieBanner"><p>We use cookies on this page, as all the others do, and you may say no.</p></div></body>',
    "header in article": '<body><header><p>The site that tells you every day what has happened near you.</p></header><article><header><h1>Head</h1></header>{}</article></body>',
}


@pytest.mark.parametrize("shape", SHAPES)
def test_page_shapes(spark, shape):
    story = "".join(f"<p>{line}</p>" for line in STORY)
    rows = [(i, "u", PAGE % (i, i)) for i in range(200)] + [(1000 + i, "u", PLAIN % (i, i)) for i in range(50)]
    rows.append((5000, "u", f"<html>{SHAPES[shape].format(story)}</html>"))
    got = html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").filter("page_id is not null"))
    lead = ["Some words of the text here, to begin with it all."] if "in article" in shape and "header" not in shape else ["Head"] if "header in" in shape else []
    assert got.filter("page_id = 5000").first()["text"] == "\n".join([*lead, *STORY])


def test_headings_and_lists_of_plain_pages(spark):
    page = (
        "<html><body><ul><li><a href=/x>Home</a><li><a href=/y>More</a></ul><div class=text><h1>Head</h1><p>" + STORY[0] + "</p><h2>Things</h2>"
        "<ul><li>Bread</li><li>Milk</li></ul><p>" + STORY[1] + "</p><p>The end.</p></div><div>&copy; Us</div></body></html>"
    )
    rows = [(i, "u", PLAIN % (i, i)) for i in range(100)] + [(1000 + i, "u", page) for i in range(20)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    texts = {r["text"] for r in got.filter("page_id >= 1000").collect()}
    assert texts == {"\n".join(["Head", STORY[0], "Things", "Bread", "Milk", STORY[1], "The end."])}


def test_named_parts_go_even_where_they_were_never_seen(spark):
    model = html_extract.learn(spark.createDataFrame([(PAGE % (i, i),) for i in range(40)], "html string"))
    page = (PAGE % (1, 1)).replace("</article>", "<aside><p>Related things to read, here.</p></aside><form><p>Mail</p></form></article><div id=comments><p>I liked it a lot, thanks.</p></div>")
    assert model.text(page) == model.text(PAGE % (1, 1))


def test_marginals_are_those_of_all_states():
    import itertools
    import math
    model = html_extract.TreeModel({("tag p", 1): 3.0, ("all node", 1): 5.0, ("all node", 0): 7.0, ("all text", 1): 2.0, ("all text", 0): 2.0, ("length 2", 0): 2.0})
    nodes = dom.parse("<div><p>a b<p>c</div><nav>d</nav>")
    aside = html_extract.asides(nodes)
    kinds = html_extract._kinds(nodes, aside)
    beside = html_extract._stands(nodes)
    assert set(kinds[1:]) == {"node", "text", "role", "below"}
    weight = {}
    for states in itertools.product((0, 1), repeat=len(nodes)):
        w = 1.0
        for i, n in enumerate(nodes[1:], 1):
            w *= model.pair(kinds[i])[states[n.parent]][states[i]]
            w *= math.exp(states[i] * sum(model.odds(f, "text" if n.tag == "#text" else "node") for f in html_extract._features(n, aside[i], beside[i])))
        weight[states] = w
    for i, p in enumerate(model.marginals(nodes)):
        assert math.isclose(p, sum(w for s, w in weight.items() if s[i]) / sum(weight.values()), rel_tol=1e-6)


def test_parser_is_tolerant():
    texts = lambda page: [n.text for n in dom.parse(page) if n.tag == "#text"]
    assert texts("<p>a<p>b<ul><li>c<li>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert texts("a<b>b</i>c</b></p>d<script>x<p>y</script>e<!-- z") == ["abcde"]
    assert texts("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]
    assert texts("<p title='a > b'>x &amp;amp; y&nbsp;z</p>") == ["x &amp; y z"]
    assert len(dom.parse("<div>" * 3000 + "x")) == 3002


@pytest.mark.skipif(not SMALL.exists(), reason="driver tables not present")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    state, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, str(SMALL)).checkpoint()
        assert state.dtypes == docs.dtypes
        sizes.append(state.count())
    assert sizes[0] > sizes[1] >= sizes[2] == sizes[3]
    packed = corpus_pipeline.run(spark, str(SMALL))
    fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert fill.filter("n <> end or n > 2048").count() == 0


@pytest.mark.skipif(not SMALL.exists(), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(entry.LLM_ORACLES))
def test_twins(spark, name):
    import duckdb
    con = duckdb.connect()
    for name_ in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {name_} AS SELECT * FROM '{SMALL}/{name_}.parquet'")
    result = con.execute(entry.LLM_ORACLES[name])
    names = [c[0] for c in result.description]
    frame = entry.queries()[name](spark, str(SMALL))
    assert sorted(names) == sorted(frame.columns)
    assert sorted(map(tuple, frame.select(*names).collect())) == sorted(result.fetchall())
