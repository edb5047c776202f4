import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pagemill.llm import op03_quality, op07_pages, op08_backoff

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, order=3, cutoff=2, backoff=0.4):
    docs = [words_of(t) for t in texts]
    count = [Counter(tuple(d[i : i + k]) for d in docs for i in range(len(d) - k + 1)) for k in range(1, order + 1)]
    total = sum(map(len, docs))

    def score(d, i):
        factor = 0.0
        for k in range(min(order, i + 1), 1, -1):
            gram = tuple(d[i - k + 1 : i + 1])
            if count[k - 1][gram] >= cutoff:
                return factor + math.log(count[k - 1][gram] / count[k - 2][gram[:-1]])
            factor += math.log(backoff)
        return factor + math.log(count[0][d[i],] / total)

    return [(len(d), sum(score(d, i) for i in range(len(d)))) for d in docs]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_match_brute_force(spark, order):
    rng = np.random.default_rng(order)
    texts = [" ".join(rng.choice(list("abcdefgh"), int(n))) for n in rng.integers(0, 60, 120)] + [None, "", "A a B", "rare words only"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in op08_backoff.score(frame, order=order, parts=5).collect()}
    for i, (n, log) in enumerate(brute(texts, order)):
        assert got[i].n_words == n and abs(got[i].log_score - log) < 1e-4
        assert (got[i].mean_log_score is None) == (n == 0)


def test_scoring_awkward_rows(docs, empty):
    got = op08_backoff.score(docs)
    assert got.count() == docs.count() and op08_backoff.score(empty).count() == 0
    assert {(r.n_words, r.log_score) for r in got.filter("doc_id in (5, 6, 7)").collect()} == {(0, 0.0)}


def test_large_counts_are_packed_whole():
    n = np.array([1, 254, 255, 256, 1 << 40, 3])
    assert op08_backoff._unpack_counts(op08_backoff._pack_counts(n)).tolist() == n.tolist()
    h = np.array([0, 5, 6, 1 << 47], np.uint64)
    assert op08_backoff._unpack(*op08_backoff._pack(h)).tolist() == h.tolist()


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = op03_quality.query(spark, folder).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r.predicted == r.quality for r in got) / len(got)
    assert right > 0.97
    assert sum(r.predicted for r in got if r.quality) / sum(r.quality for r in got) > 0.99
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_labels_are_not_read(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    turned = labels.selectExpr("doc_id", f"case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end as quality")
    one, two = (sorted((r.doc_id, r.score) for r in op03_quality.classify(docs, x).select("doc_id", "score").collect()) for x in (labels, turned))
    assert one == two


def test_quality_awkward_rows(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 0), (6, 0), (8, 0), (99, 1)], "doc_id long, quality int")
    got = op03_quality.classify(docs, labels)
    assert got.count() == docs.count() and got.columns == [*docs.columns, "score"]
    assert len({r.score for r in got.filter("doc_id in (5, 6, 7)").collect()}) == 1
    none = op03_quality.classify(docs, labels.filter("doc_id = -1"))
    assert {r.score for r in none.collect()} == {0.5}
    assert op03_quality.classify(empty, labels).count() == 0


def test_scores_against_a_plain_loop(spark):
    """The margin of a text is the mean weight of its words, their n-grams and its repetition marks, one by one."""
    import math

    import numpy as np

    model = op03_quality.Model(np.random.default_rng(1).normal(size=op03_quality.BUCKETS + op03_quality.MARKS).astype(np.float32), 0.25)
    texts = ["The cat sat", "a a b c d e a b c d e", "", "x", "é ß word word WORD", None]

    def plain(text):
        ws = [w.lower() if w.isascii() else w for w in (text or "").split()]
        total, n = 0.0, 0
        for w in ws:
            one = pa.array([w])
            h, _ = op03_quality.words.words(one)
            buckets = [int(h[0]) % op03_quality.BUCKETS]
            body = b"<" + w.encode() + b">"
            for k in op03_quality.SIZES:
                for i in range(len(body) - k + 1):
                    v = k
                    for b in body[i : i + k]:
                        v = ((v << 8) | b) & (1 << 64) - 1
                    buckets.append(int(op03_quality.words.mix(np.array([v], np.uint64))[0]) % op03_quality.BUCKETS)
            total, n = total + sum(float(model.weight[b]) for b in buckets), n + len(buckets)
        marks = [sum(a == b for a, b in zip(ws, ws[1:], strict=False)), 0]
        runs = [tuple(ws[i : i + op03_quality.RUN]) for i in range(len(ws) - op03_quality.RUN + 1)]
        marks[1] = len(runs) - len(set(runs)) if len(ws) > op03_quality.RUN else 0
        total += sum(m * float(model.weight[op03_quality.BUCKETS + k]) for k, m in enumerate(marks))
        return 1 / (1 + math.exp(-(total / max(1, n + sum(marks)) + model.bias)))

    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    out = op03_quality.score(frame, model)
    assert out.columns == ["doc_id", "text", "score"]
    for r in out.collect():
        assert abs(r.score - plain(texts[r.doc_id])) < 1e-6


def test_sample_is_bounded_when_ids_repeat(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(op03_quality, "fit", lambda docs, labels, seed=0: seen.append(len(docs)))
    docs = spark.createDataFrame([(i % 5, f"text {i}") for i in range(100)] + [(1, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, quality int")
    op03_quality.train(docs, labels, sample=4)
    assert seen == [4]


def test_repetition_is_marked():
    *_, marks = op03_quality._parts(pa.array(["a a b c d e a b c d e", "x", "", "q q"]))
    assert marks.tolist() == [[1, 2], [0, 0], [0, 0], [1, 0]]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/>Home</a></li></ul></nav><!-- ad --><div class="ad">Buy</div><div class="cookie-notice">We use</div>
<article><header>site</header><h1>Head &amp; more</h1><p><b>First  para
graph.<br><p>Second&nbsp;one &lt;x&gt; &#233;</p><ul><li>one<li>two</ul><div class="share">Share</div><form>f<input></form><p>Be.</p>
<section id="comments"><p>Nice!</p></section></article><aside>side</aside><footer>&copy; x &middot; y</footer></body></html>"""


def test_main_text():
    assert op07_pages.main_text(op07_pages.parse(PAGE)) == "Head & more\nFirst para graph.\nSecond one <x> é\none\ntwo\nBe."
    assert op07_pages.main_text(op07_pages.parse("")) == "" and op07_pages.main_text(op07_pages.parse("just text < 5 & more")) == "just text < 5 & more"
    assert op07_pages.main_text(op07_pages.parse("<p>cut off &am")) == "cut off &am" and op07_pages.main_text(op07_pages.parse("<article><p>a</p><p")) == "a"
    assert op07_pages.main_text(op07_pages.parse("<div>" * 3000 + "deep")) == "deep"


def test_broken_and_wrapped_pages():
    text = lambda h: op07_pages.main_text(op07_pages.parse(h))
    assert text("<form><h1>T</h1><p>some long text here</p><input value=x><select><option>o</select></form>") == "T\nsome long text here"
    assert text("<form id=f><article>k</article><label>z</label></form>") == "k" and text("<p>much more text than in it</p><form>a b</form>") == "much more text than in it"
    assert text('<article><div class="post header"><h1>Title</h1></div><p>x</p><div class="header">site</div></article>') == "Title\nx"
    assert text('<article><div class="header comments"><h1>Title</h1></div><p>x</p></article>') == "x"
    assert text("<article><header><h2>T</h2></header>b</article>") == "T\nb" and text("<body><header><h2>T</h2></header>b</body>") == "b"
    assert text('one <a title="x>two three') == "one two three" and text("a <b <i>c") == "a c"
    import time

    took = []
    for n in (20000, 80000):
        began = time.process_time()
        assert text("<div>" * n + "deep" + "</p></i></div>" * n) == "deep"
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0]


def test_template_decides_without_articles(spark):
    """Pages that no tag or class word describes: what recurs on the host goes, whatever it is called, and only there."""
    page = "<html><body><div class=top><span>Logo {h}</span></div><div><p>Read {h} daily</p></div><div class=text><p>Story {i} of {h}.</p><p>More of {i}.</p></div><div class=low><ul><li>About {h}</li></ul></div></body></html>"
    rows = [(100 * h + i, f"https://h{h}.example/{i}", page.format(h=h, i=i)) for h, n in enumerate((4, 30, 2)) for i in range(n)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'old' as text", "'y' as keys")
    lists = {r.host: len(r["keys"]) for r in op07_pages.template_subtrees(pages).collect()}
    assert set(lists) == {"h0.example", "h1.example"} and min(lists.values()) >= 3
    out = op07_pages.extract(pages)
    assert sorted(out.columns) == ["keys", "page_id", "text", "url"]
    got = {r.page_id: r.text for r in out.collect()}
    assert all(got[100 * h + i] == f"Story {i} of {h}.\nMore of {i}." for h, n in ((0, 4), (1, 30)) for i in range(n))
    assert got[200] == "Logo 2\nRead 2 daily\nStory 0 of 2.\nMore of 0.\nAbout 2"


def test_hosts_in_several_parts(spark, monkeypatch):
    page = "<body><div><b>Menu</b></div><p>Story {0}</p></body>"
    pages = spark.createDataFrame([(i, "http://a.example/" + str(i), page.format(i)) for i in range(50)], "page_id long, url string, html string")
    for salt, broadcast in ((7, 50), (7, 0)):
        monkeypatch.setattr(op07_pages, "SALT_PAGES", salt)
        monkeypatch.setattr(op07_pages, "BROADCAST_ROWS", broadcast)
        assert sorted(r.text for r in op07_pages.extract(pages).collect()) == sorted(f"Story {i}" for i in range(50))


def test_pages_of_the_table(spark):
    import html

    got = {r.page_id: r for r in op07_pages.query(spark, "/root/testdata/sf0.01").collect()}
    for page in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        own = page.html.split("<article>", 1)[1].split("</article>")[0]
        lines = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*(?:>|$)", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)(?:>|$)", own)]
        want = "\n".join(x for x in lines if x)
        assert got[page.page_id].text == want and got[page.page_id].n_chars == len(want)


def test_site_template_goes(spark):
    body = "<html><body><div><p>Welcome to our site</p></div><div><p>story {0} about thing {0}</p></div><table><tr><td>All rights kept</td></tr></table></body></html>"
    rows = [(i, "http://a.example/x" if i < 40 else "http://b.example/", body.format(i)) for i in range(42)] + [(90, None, None), (91, None, ""), (92, "http://a.example/", "<p>other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as host", "1 as n", "2 as key")
    got = {r.page_id: r for r in op07_pages.extract(pages).collect()}
    assert got[3].text == "story 3 about thing 3" and got[3].host == "x" and got[3].key == 2
    # few pages are no evidence
    assert got[41].text == "Welcome to our site\nstory 41 about thing 41\nAll rights kept"
    assert got[90].text == got[91].text == "" and got[92].text == "other"
    assert op07_pages.extract(pages.filter("page_id = -1")).count() == 0


def test_articles_may_repeat_paragraphs(spark):
    page = "<body><div id=x><span>Menu of site</span></div><article><h1>T{0}</h1><p>A quote that all pages have.</p><div><p>Part {0}</p></div></article></body>"
    pages = spark.createDataFrame([(i, "http://a.example/", page.format(i)) for i in range(30)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in op07_pages.extract(pages).collect()}[7] == "T7\nA quote that all pages have.\nPart 7"


def test_copied_pages_are_no_template(spark):
    plain = "<body><div id=x><span>Menu of site</span></div><div><h1>T{0}</h1><p>Story {0}</p></div></body>"
    article = "<body><div id=x><span>Menu of site</span></div><article><div><p>Story {0}</p></div></article></body>"
    rows = [(i + 100 * k, f"http://{'ab'[k]}.example/{i}", page.format(max(i - 29, 0))) for k, page in enumerate((plain, article)) for i in range(50)]
    got = {r.page_id: r.text for r in op07_pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # thirty copies of one page, and twenty others
    assert len(got) == 100 and got[3] == "T0\nStory 0" and got[45] == "T16\nStory 16"
    assert got[103] == "Story 0" and got[145] == "Story 16"
    few = [(i, "http://a.example/", plain.format(i % 5)) for i in range(50)]
    got = {r.page_id: r.text for r in op07_pages.extract(spark.createDataFrame(few, "page_id long, url string, html string")).collect()}
    # five distinct pages; two are no evidence
    assert got[7] == "T2\nStory 2"
    few = [(i, "http://a.example/", plain.format(i % 2)) for i in range(50)]
    got = {r.page_id: r.text for r in op07_pages.extract(spark.createDataFrame(few, "page_id long, url string, html string")).collect()}
    assert got[7] == "Menu of site\nT1\nStory 1"


def test_menus_of_a_section_go(spark):
    page = "<body>{1}<p>Yes</p><p>Story {0}</p></body>"
    menu = "<div><ul><li>Part one</li></ul></div>"
    rows = [(i, "http://a.example/", page.format(i, menu if i < 12 else "").replace("<p>Yes</p>", "<p>Yes</p>" if i < 12 else "")) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in op07_pages.extract(pages, many=12).collect()}[3] == "Yes\nStory 3"
    for kept in ({"many": 13}, {"many": 12, "many_share": 0.21}):
        assert {r.page_id: r.text for r in op07_pages.extract(pages, **kept).collect()}[3] == "Part one\nYes\nStory 3"


def test_packed_and_relational_scores_agree(spark, folder, docs, empty):
    few = spark.read.parquet(f"{folder}/documents.parquet")
    for frame in (few, docs):
        one, two = (sorted((str(r.doc_id), r.n_words, r.log_score, r.mean_log_score) for r in f(frame).collect()) for f in (op08_backoff.score, op08_backoff.score_rows))
        assert len(one) == len(two) == frame.count()
        for a, b in zip(one, two, strict=True):
            assert a[:2] == b[:2] and abs(a[2] - b[2]) < 2e-4 and (a[3] is None) == (b[3] is None)
    assert op08_backoff.score_rows(empty).count() == 0
