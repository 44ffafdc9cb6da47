"""Operators 5, 6, 8 and 9: round trips, bounds, brute force."""

import itertools
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quadrille.llm import ann, html_text, mixing, packing
from quadrille.llm.common import table

PATH = public_tokenizers.path("word_bpe_49k.json")


# -- packing


def test_word_ids_are_the_tokenizers():
    texts = ["", "  \n\n", "The cat's 123abc, ÉTÉ'LL don't_x!!", "<|endoftext|> a<|startoftext|>b", "İstanbul ΑΣ σς", "tab\t\x1c\x85 x",
             "é ́", "x²½ ١٢", "日本語 text", "😀 :) ...", "ß ẞ ÿ Ÿ", "a" * 3000, "word " * 5000]
    raw = Tokenizer.from_file(PATH)
    words = packing.WordIds(PATH)
    want = [np.asarray(raw.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert words.of(texts) == want
    before = packing.CACHE_WORDS, packing.CACHE_PARTS
    packing.CACHE_WORDS, packing.CACHE_PARTS = 10, 5
    small = packing.WordIds(PATH)
    assert small.of(texts) == want and [small.of([t])[0] for t in texts] == want
    packing.CACHE_WORDS, packing.CACHE_PARTS = before
    words.split = False  # what any other tokenizer gets
    assert words.of(texts) == want


def test_word_ids_of_all_documents(spark):
    """Every document of sf0.01, and words of all kinds of letters and marks, merged as the library does."""
    texts = [r["text"] or "" for r in table(spark, "/root/testdata/sf0.01", "documents").select("text").collect()]
    rng = np.random.default_rng(5)
    letters = list("aaeeiinnostzAEZß'éÉñÖ0179.,-_!\"|<>#\t\n") + ["  ", " ", "'s", "'ll", "ｆ", "ﬁ", "中", "é"]
    texts += ["".join(rng.choice(letters, size=int(n))) for n in rng.integers(1, 300, 400)]
    raw, words = Tokenizer.from_file(PATH), packing.WordIds(PATH)
    want = [np.asarray(e.ids, "<u4").tobytes() for e in raw.encode_batch(texts, add_special_tokens=False)]
    assert words.split and words.of(texts) == want


def test_packing_round_trip(spark):
    rng = np.random.default_rng(0)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"], size=int(n)))) for i, n in enumerate(rng.integers(1, 900, 120))]
    docs += [(500, None), (501, ""), (502, "word " * 9000), (502, "again"), (None, "no id")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, length string")
    got = packing.pack_documents(df, PATH, capacity=512, with_ids=True).collect()
    raw = Tokenizer.from_file(PATH)
    want = {}
    for i, t in docs:
        ids = raw.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 512):
            want.setdefault((i, k // 512, k, len(ids[k : k + 512]), zlib.crc32(np.asarray(ids[k : k + 512], "<u4").tobytes())), []).append(ids[k : k + 512])
    assert sorted(map(str, [tuple(r[:5]) for r in got])) == sorted(map(str, [k for k, v in want.items() for _ in v]))
    assert all(r["ids"] in want[tuple(r[:5])] for r in got)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == list(itertools.accumulate([0] + [n for _, n in b[:-1]])) and sum(n for _, n in b) <= 512
    bound = packing.lower_bound(np.array([r["length"] for r in got]), 512)
    assert len(bins) <= bound + 1 and all(r["certified"] == (len(bins) == bound) for r in got)


def test_rounds_settle_everything(spark):
    rng = np.random.default_rng(1)
    lengths = rng.integers(300, 1100, 3000)
    df = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "item int, length long")
    got = packing.pack(df, capacity=2048, part_rows=400).collect()
    assert sorted(r["item"] for r in got) == list(range(3000))
    fill = {}
    for r in got:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    one = packing.best_fit_decreasing(lengths, 2048)[2]
    assert max(fill.values()) <= 2048 and len(fill) <= one * 1.01 + 1
    assert packing.pack(df.limit(0)).count() == 0


def brute_bins(lengths, capacity):
    best = [len(lengths)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i]:
                go(i + 1, rooms[:k] + [rooms[k] - lengths[i]] + rooms[k + 1 :])
        go(i + 1, rooms + [capacity - lengths[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(12))
def test_bounds_hold(seed):
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.integers(1, 21, 9))[::-1]
    least = brute_bins(lengths.tolist(), 20)
    assert packing.lower_bound(lengths, 20) <= least <= packing.best_fit_decreasing(lengths, 20)[2]
    assert packing.lower_bound(np.array([11] * 5 + [10] * 2), 20) == 6


# -- mixing


def mixed(spark, rows, sources, **kw):
    df = spark.createDataFrame(rows, "doc_id long, source string, words long, target string")
    return mixing.mix(df, sources, F.col("words"), **kw).collect()


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(2)
    rows = [(i, ["a", "b", "c", "d", None][int(rng.choice(5, p=[0.05, 0.45, 0.3, 0.1, 0.1]))], int(rng.integers(0, 300)), "z") for i in range(4000)]
    got = mixed(spark, rows, F.array("source"))
    total = sum(r[2] for r in rows)
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
    targets = {s: v[0]["target"] for s, v in by.items()}
    assert sum(targets.values()) == pytest.approx(total)
    for s, v in by.items():
        size = sum(r["size"] for r in v)
        assert {r["source_size"] for r in v} == {size} and targets[s] <= 3 * size + 1e-6
        assert sum(r["taken"] for r in v) == pytest.approx(targets[s], abs=300)
        assert all(r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0) for r in v)
    assert targets["a"] == pytest.approx(3 * sum(r["size"] for r in by["a"]))  # stopped at its cap
    assert targets["b"] / targets["c"] == pytest.approx(2) and targets["d"] / targets[None] == pytest.approx(5 / 2) or targets["d"] == 3 * sum(r["size"] for r in by["d"])
    assert sorted(map(str, got)) == sorted(map(str, mixed(spark, rows, F.array("source"))))


def test_capped_targets():
    assert mixing.capped_targets([100, 100, 100], (5, 2, 1), 3, 300) == [187.5, 75.0, 37.5]
    assert mixing.capped_targets([10, 100, 190], (5, 2, 1), 3, 300) == [30.0, 180.0, 90.0]
    assert mixing.capped_targets([], (5,), 3, 0) == [] and mixing.capped_targets([0, 5], (5, 2), 3, 5) == [0.0, 5.0]


def test_flow_avoids_repeating():
    """A shared pattern feeds the source that would otherwise repeat its own words."""
    flow = mixing.route([100, 100], [[0], [0, 1]], [150, 50], 3)
    assert sum(flow[0].values()) == pytest.approx(100) and flow[1] == {0: pytest.approx(50), 1: pytest.approx(50)}
    again = mixing.route([100, 100, 10], [[0], [0, 1], [1]], [100, 130], 3)
    assert sum(again[0].values()) <= 100 + 1e-6 and again[0][0] + again[1][0] == pytest.approx(100) and again[1][1] + again[2][1] == pytest.approx(130)


def test_mix_of_overlapping_sources_and_edges(spark):
    df = spark.createDataFrame([(i, ["a", "b"] if i % 2 else ["a"], 10) for i in range(200)], "doc_id long, s array<string>, n long")
    got = mixing.mix(df, F.col("s"), F.col("n"), weights=(1, 1)).collect()
    assert sum(r["taken"] for r in got) == pytest.approx(2000, abs=20)
    nulls = spark.createDataFrame([(None, None, None), (1, None, 5), (1, None, 5)], "doc_id long, source string, words long")
    got = mixing.mix(nulls, F.array("source"), F.col("words")).collect()
    assert len(got) == 3 and sum(r["taken"] for r in got) == 10
    assert mixing.mix(nulls.limit(0), F.array("source"), F.col("words")).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, F.col("s"), F.col("n"), max_patterns=1)


# -- search


def vectors(n=1500, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(8, dim))
    x = centre[rng.integers(0, 8, n)] + 0.6 * rng.normal(size=(n, dim))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x.astype(np.float32))]
    rows += [(n + i, rows[40][1]) for i in range(60)]  # copies of one vector
    return rows + [(9_000, None), (9_020, [0.0] * dim), (9_040, [None] * dim), (9_060, [float("nan")] * dim), (9_080, [1.0, 2.0]), (9_100, []), (None, rows[0][1])]


def brute_nearest(rows, every, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and i < 9_000]
    out = {}
    for i, q in good:
        if i % every == 0:
            s = sorted(((-float((q * v).sum()), j) for j, v in good if j != i))
            out[i] = [(j, -x) for x, j in s[:k]]
    return out


@pytest.mark.parametrize("settings", [{}, {"list_rows": 100, "probes": 8, "part_rows": 70, "rerank": 100}])
def test_search(spark, settings):
    rows = vectors()
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = ann.nearest(df, every=20, k=10, **settings).collect()
    want = brute_nearest(rows, 20, 10)
    assert {r["query_id"] for r in got} == set(want)
    hits = 0
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append(r)
    for q, rs in by.items():
        assert [r["rank"] for r in rs] == list(range(1, 11))
        assert all((a["score"], -a["vec_id"]) > (b["score"], -b["vec_id"]) for a, b in zip(rs, rs[1:]))
        exact = dict(want[q])
        hits += len(exact.keys() & {r["vec_id"] for r in rs})
        assert all(r["score"] == pytest.approx(exact[r["vec_id"]], abs=1e-9) for r in rs if r["vec_id"] in exact)
    assert hits / (10 * len(want)) >= 0.9


def test_search_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, ann.nearest(few).collect()))
    assert [r[:3] for r in got] == [(0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)]
    assert ann.nearest(few.limit(0)).count() == 0


def test_search_with_repeated_ids(spark):
    """Of two rows of one id each is a query and the other's candidate, also where their vectors are equal."""
    rows = [(20, [1.0, 0.0]), (20, [0.9, 0.1]), (3, [0.5, 0.5]), (40, [0.0, 1.0]), (40, [0.0, 1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    asked = {}
    for r in got:
        asked.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["score"], 6)))
    assert sorted(asked[20]) == sorted([(1, 20, 0.9), (2, 3, 0.5), (3, 40, 0.0), (4, 40, 0.0), (1, 20, 0.9), (2, 3, 0.5), (3, 40, 0.1), (4, 40, 0.1)])
    assert sorted(asked[40]) == sorted([(1, 40, 1.0), (2, 3, 0.5), (3, 20, 0.1), (4, 20, 0.0)] * 2)


def route_cost(flow, capacity):
    """Words by how often they were used before."""
    cost = 0.0
    for f, c in zip(flow, capacity):
        used = sum(f.values())
        level = 0
        while used > 1e-9:
            cost += level * min(used, c)
            used -= c
            level += 1
    return cost


@pytest.mark.parametrize("seed", range(8))
def test_flow_is_the_cheapest(seed):
    """Against all whole routings of small cases, word by word."""
    rng = np.random.default_rng(seed)
    member = [[0], [1], [0, 1]]
    capacity = rng.integers(1, 4, 3).tolist()
    quota = [int(rng.integers(0, 3 * capacity[0] + 1)), int(rng.integers(0, 3 * capacity[1] + 1))]
    flow = mixing.route(capacity, member, quota, 3)
    best = min(route_cost([{0: a}, {1: b}, {0: quota[0] - a, 1: quota[1] - b}], capacity)
               for a in range(quota[0] + 1) for b in range(quota[1] + 1)
               if a <= 3 * capacity[0] and b <= 3 * capacity[1] and quota[0] - a + quota[1] - b <= 3 * capacity[2])
    assert [sum(f.get(s, 0) for f in flow) for s in (0, 1)] == pytest.approx(quota) and route_cost(flow, capacity) == pytest.approx(best)


def test_search_meets_every_list(spark):
    """Rows in no clusters, and lists that far outnumber ten: the best rows lie in most lists."""
    x = np.random.default_rng(3).normal(size=(4000, 32))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=40, k=20, list_rows=40).collect()
    want = {(q, v) for q, best in brute_nearest(rows, 40, 20).items() for v, _ in best}
    assert len(want & {(r["query_id"], r["vec_id"]) for r in got}) >= 0.99 * len(want)


def test_copies_push_no_other_row_out():
    """More copies of one vector, and of one code, than are reranked; what is better than they has another code."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16))
    index = ann.train(x, 1)
    code = index.encode(x, index.assign(x), 4.0)
    packed = (code[:, 0::2] | (code[:, 1::2] << 4)).astype(np.uint8)
    q = rng.normal(size=(1, 16))
    near = int(np.argsort(-ann.scan(index.tables(q), packed)[0])[0])
    v, p = np.concatenate((np.repeat(x[near : near + 1], 500, axis=0), x)), np.concatenate((np.repeat(packed[near : near + 1], 500, axis=0), packed))
    v[:500] += rng.normal(size=(500, 1)) * np.where(np.arange(500) % 2, 1e-3, 0)[:, None] * q  # half of them copies, half of one code
    ids = np.arange(len(v)) + 1
    got = ann.search_part(index, np.array([0]), q, ids, v, np.zeros(len(v), int), p, 300, 600)
    score = v @ q[0]
    assert got[1].tolist() == sorted(ids.tolist(), key=lambda i: (-score[i - 1], i))[:300]
    few = ann.search_part(index, np.array([0]), q, ids, v, np.zeros(len(v), int), p, 5, 1)
    assert few[1].tolist() == sorted(ids[np.arange(len(v)) < 500].tolist(), key=lambda i: (-score[i - 1], i))[:5]


def test_anisotropic_encoding_spares_the_parallel_error():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 16))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)

    def parallel(eta):
        index = ann.train(x, 1, eta=eta)
        at = index.assign(x)
        codes = index.encode(x, at, eta)
        back = index.words[np.arange(codes.shape[1])[None, :], codes].reshape(len(x), -1)[:, :16] + index.lists[at]
        return (((x - back) * unit).sum(axis=1) ** 2).mean()

    assert parallel(6.0) < 0.7 * parallel(1.0)


# -- html


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><!-- ad --><div class="ad">Buy</div>
<article><h1>Title &amp; more</h1><p><b>First   line<br><p>Second&nbsp;line &lt;x&gt;</p><form><p>form</p></form><aside>side</aside>
<div class="comments"><p>reader</p></div><ul><li>one<li>two</ul></article><div class="cookie-notice">cookies</div><footer>&copy; x</footer></body></html>"""


def extract(page, template=frozenset()):
    return html_text.extract(page, "h", template)[0]


def test_main_text():
    assert extract(PAGE) == "Title & more\nFirst line\nSecond line <x>\none\ntwo"
    assert extract(None) == "" and extract("plain & text") == "plain & text"
    assert extract("<p>a<p>b<script>x") == "a\nb"
    assert extract("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert extract("<main><div><p>in</p></div></main><div>out</div>") == "in"


def test_words_in_names_leave_articles_alone():
    """Names that only contain such a word are the article's; outside it, parts of names count."""
    kept = "".join(f'<div class="{n}">{n}</div>' for n in ("related-work", "share-price", "notice-board", "footnotes", "ad-hoc", "header-2"))
    kept += "<math>x = 1</math><object>figure</object><dialog>he said</dialog><audio>sound</audio>"
    assert extract(f"<article>{kept}</article>").split("\n") == [
        "related-work", "share-price", "notice-board", "footnotes", "ad-hoc", "header-2", "x = 1", "figure", "he said", "sound"]
    assert extract('<div class="site-footer">x</div><div id="cookie_banner">y</div><div class="share-price">z</div>') == "z"
    assert extract('<article>a<div class="ad">x</div><section id="comments">y</section>b</article>') == "a\nb"


class Article(HTMLParser):
    """The article of the test pages by another parser: no nesting, blocks end at block tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skip, self.blocks, self.run = 0, [], [], []

    def end_block(self):
        text = " ".join("".join(self.run).split())
        self.blocks += [text] if text else []
        self.run = []

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside += 1
        if tag in ("script", "style", "aside", "form", "nav", "footer") or (tag == "div" and dict(attrs).get("class") in ("ad", "comments")):
            self.skip.append(tag)
        if tag == "br":
            self.run.append(" ")
        elif tag not in ("b", "a", "i", "em", "strong", "span"):
            self.end_block()

    def handle_endtag(self, tag):
        if self.skip and self.skip[-1] == tag:
            self.skip.pop()
        if tag not in ("b", "a", "i", "em", "strong", "span"):
            self.end_block()
        if tag == "article":
            self.inside -= 1

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.run.append(data)


def by_hand(page):
    parser = Article()
    parser.feed(page or "")
    parser.close()
    parser.end_block()
    return "\n".join(parser.blocks)


def test_all_pages_against_another_parser(spark):
    got = html_text.main_texts(table(spark, "/root/testdata/sf0.01", "pages")).collect()
    assert all(r["text"] == by_hand(r["html"]) for r in got)


def test_counts_decide_where_elements_say_nothing(spark):
    """The pages of sf0.1 with one menu and footer a host, and these and the articles as plain divs: only recurrence tells.

    The text is the article's all the same, and without the counts it would not be on any page.  The few exceptions are
    near copies: what they share recurs as a template does, and no article tells here that it is text.
    """
    rows, own, want = [], {}, {}
    for r in table(spark, "/root/testdata/sf0.1", "pages").orderBy("page_id").collect():
        menu, footer = (re.search(f"<{x}>.*?</{x}>", r["html"] + "</footer>", re.S) for x in ("nav", "footer"))
        article = re.search("<article>.*</article>", r["html"], re.S)
        if not (menu and footer and article):
            continue
        first = own.setdefault(html_text.host_of(r["url"]), (menu[0], footer[0]))
        page = f"<body>{first[0]}<div>{r['page_id']} readers</div>{article[0]}{first[1].replace('</footer>', f' {r["page_id"]}</footer>')}</body>"
        rows.append((r["page_id"], r["url"], re.sub("<(/?)(nav|footer|article)>", r"<\1div>", page)))
        want[r["page_id"]] = by_hand(article[0])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: r for r in html_text.main_texts(pages).collect()}
    off = {r["page_id"]: r["text"] for r in html_text.main_texts(pages, min_pages=10**9).collect()}
    wrong = [(i, got[i]["n_template"], got[i]["text"][-150:], t[-150:]) for i, t in want.items() if got[i]["text"] != t or got[i]["n_template"] != 3]
    assert len(rows) > 2000 and len(wrong) <= 0.02 * len(rows), (len(wrong), wrong[:5])
    assert all(off[i] != t for i, t in want.items())


def test_teasers_are_template(spark):
    """Several articles on a page: those that recur on the host are no part of it."""
    rows = [(i, f"http://a.com/{i}", f"<article><p>Text {chr(97 + i)}</p></article><article><h2>Read next</h2><p>teaser</p></article>") for i in range(7)]
    got = html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: f"Text {chr(97 + i)}" for i in range(7)}


def test_templates_go_and_articles_stay(spark):
    body = "<div><div>Welcome to our pages</div><div><p>{}</p></div></div>"
    rows = [(i, f"http://a.com/{i}", body.format(f"text number {i}")) for i in range(9)]
    rows += [(20 + i, "http://b.com/x", "<article><p>Same words</p></article>") for i in range(9)]
    rows += [(40 + i, f"http://c.com/{i}", f"<article><p>Licence line</p><p>{i}</p></article>") for i in range(9)]
    rows += [(60, None, None), (61, "http://[bad", ""), (62, "http://d.com", body.format("alone"))]
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, page string")
    for limit in (1000, 0):
        got = {r["page_id"]: r for r in html_text.main_texts(df, broadcast_rows=limit).collect()}
        assert len(got) == len(rows) and all(r["page"] == "x" and r["n_chars"] == len(r["text"]) for r in got.values())
        assert all(got[i]["text"] == f"text number {i}" for i in range(9))  # recurs on the host: gone
        assert all(got[20 + i]["text"] == "Same words" for i in range(9))  # copies of one page count once
        assert all(got[40 + i]["text"] == f"Licence line\n{i}" for i in range(9))  # a repeated paragraph of articles stays
        assert got[60]["text"] == got[61]["text"] == "" and got[62]["text"] == "Welcome to our pages\nalone"
    assert html_text.main_texts(df.limit(0)).count() == 0


def test_template_is_what_may_be_template_on_the_page(spark):
    """A block that is a sidebar's on some pages of a host and an article's paragraph on another; on both routes."""
    rows = [(i, f"http://a.com/{i}", f"<div><p>Same words</p></div><article><p>{i}</p></article>") for i in range(6)]
    rows += [(6, "http://a.com/6", "<article><p>Same words</p><p>6</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (1000, 0):
        got = {r["page_id"]: r["text"] for r in html_text.main_texts(df, broadcast_rows=limit).collect()}
        assert got == {i: str(i) for i in range(6)} | {6: "Same words\n6"}


def test_lists_of_articles_stay(spark):
    """Containers of an article that recur go only if they are links; without an article, only what recurs on a share of the host."""
    page = "<article><ul><li>One thing</li><li>two</li></ul><div><p>Wrapped <a>x</a></p></div><div><a>More</a> <a>News</a></div><p>{}</p></article>"
    rows = [(i, f"http://a.com/{i}", page.format(i)) for i in range(6)]
    rows += [(100 + i, f"http://b.com/{i}", f"<div>Site name</div><p>{'Near copy' if i < 6 else 'Alone'} {i}</p>" + ("<p>Shared words</p>" if i < 6 else "")) for i in range(80)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (1000, 0):
        got = {r["page_id"]: r["text"] for r in html_text.main_texts(df, broadcast_rows=limit).collect()}
        assert all(got[i] == f"One thing\ntwo\nWrapped x\n{i}" for i in range(6))
        assert all(got[100 + i] == (f"Near copy {i}\nShared words" if i < 6 else f"Alone {i}") for i in range(80))
