import random
import re

import numpy as np
import pytest
import xxhash

from gaugeworks.llm import components, html_text, nearest, simhash


def plain(text):
    """The fingerprint, bit by bit."""
    w = [x for x in re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark, docs):
    for t in (None, "", " ", "One", "one two", "A b C d\x1ce f\x0bg", "é É x y z", *[r.text for r in docs.limit(20).collect()]):
        assert simhash.fingerprint(t) == plain(t)


def least(pairs, nodes):
    """Smallest node each reaches."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("busy", [1, 64])
def test_links(spark, monkeypatch, busy):
    monkeypatch.setattr(simhash, "BUSY", busy)
    r = random.Random(3)
    values = {r.getrandbits(64) for _ in range(40)}
    for v in list(values)[:8]:
        values |= {v ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 3))) for _ in range(15)}
    values |= {(77 << 32) | r.getrandbits(4) for _ in range(12)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    got = simhash.links(spark.createDataFrame([(v,) for v in signed], "bits long"))
    assert {(x.src, x.dst) for x in got.collect()} == want and want


def broadcast_rows(df):
    """The rows of each table that running ``df`` broadcast."""
    df.collect()
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "BroadcastExchangeExec":
            out.append(node.metrics().get("numOutputRows").get().value())
        inner = node.executedPlan() if name == "AdaptiveSparkPlanExec" else node.plan() if name.endswith("QueryStageExec") else None
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())] + [inner] * (inner is not None)
    return out


def test_tries_are_not_broadcast(spark):
    """Each fingerprint is looked for under 34 keys, which Spark counts as one row."""
    r = random.Random(7)
    values = {r.getrandbits(62) for _ in range(3000)}
    values |= {v ^ 5 for v in values}  # links, so that no part of the plan is left out as empty
    prints = spark.createDataFrame([(v,) for v in values], "bits long").groupBy("bits").count().select("bits")
    links = simhash.links(prints)
    assert max(broadcast_rows(links), default=0) <= len(values) and links.count() >= 3000


def test_components(spark):
    r = random.Random(5)
    pairs = [(i, i + 1) for i in range(40)] + [(100 + r.randint(0, 60), 100 + r.randint(0, 60)) for _ in range(45)] + [(-5, -5), (-7, -6), (-6, -7)]
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    got = components.components(spark.createDataFrame(pairs, "src long, dst long"))
    assert {x.node: x.component for x in got.collect()} == least([p for p in pairs if p[0] != p[1]], nodes)
    assert components.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_near_duplicates(spark, docs, edges, empty):
    for df in (docs, edges):
        rows = [(r.doc_id, plain(r.text)) for r in df.collect()]
        pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (rows[i][1] ^ rows[j][1]).bit_count() <= 2]
        group = least(pairs, range(len(rows)))
        names = {}
        for i, (doc, _) in enumerate(rows):
            if doc is not None:
                names[group[i]] = min(names.get(group[i], doc), doc)
        want = sorted(((doc, f"{f:016x}", names.get(group[i])) for i, (doc, f) in enumerate(rows)), key=repr)
        assert sorted((tuple(r) for r in simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect()), key=repr) == want
    assert simhash.near_duplicates(empty).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep long")


def brute(rows, k):
    good = {i: np.array(v, dtype=float) for i, v in rows if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and np.any(v)}
    out = {}
    for q, v in good.items():
        if q % 20 == 0:
            out[q] = [i for _, i in sorted((-float(v @ x), i) for i, x in good.items() if i != q)[:k]]
    return out


@pytest.mark.parametrize("asked", [2, 4096])
def test_nearest_exact_on_small(spark, monkeypatch, asked):
    monkeypatch.setattr(nearest, "ASKED", asked)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(60)] + [(300, None), (301, [0.0] * 8), (302, [float("nan")] + [1.0] * 7), (303, [None] + [1.0] * 7), (304, [1.0]), (None, [1.0] * 8), (305, []), rows[5]]
    got = {}
    for r in nearest.nearest(vectors(spark, [(i, v, 1, 1) for i, v in rows])).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute(rows, 20)


def test_nearest_edges(spark):
    assert nearest.nearest(vectors(spark, [])).count() == 0
    assert nearest.nearest(vectors(spark, [(20, [1.0, 2.0], 1, 1)])).count() == 0
    few = nearest.nearest(vectors(spark, [(20, [1.0, 2.0], 1, 1), (21, [1.0, 2.0], 1, 1), (22, [5.0, 0.0], 1, 1)])).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id) for r in few] == [(1, 21), (2, 22)]


def test_nearest_recall(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, dtype=float)) for r in df.collect()]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    hits = total = 0
    for q, part in nearest.nearest(df).toPandas().groupby("query_id"):
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        top = ids[np.lexsort((ids, -score))[:20]]
        hits, total = hits + len(set(top) & set(part.vec_id)), total + 20
    assert hits / total >= 0.9


def test_hilbert_is_a_curve():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = nearest.hilbert_keys(grid, 3)
    path = grid[np.argsort(keys)]
    assert sorted(keys) == list(range(512)) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header><a href=x>Home</a></header><nav><ul><li><a>One</a></li></ul></nav>
<div id="cookie-notice">We use cookies on this site, with a long text about them.</div><div class="ad">Buy now, it is a very good thing to buy for everyone.</div>
<article><h1>Title &amp; more</h1><p><b>Lead   text<br>goes on.<p>Short.</p><form><label>Mail</label><input></form><p>A longer paragraph&nbsp;with many words in it.</p><div class="comments"><p>First! says a reader at some length here.</p></div></article>
<aside><p>Related things to read on this page.</p></aside><footer>&copy; someone</footer></body></html>"""


def test_pages(spark, data):
    assert html_text.content_lines(PAGE) == ["Title & more", "Lead text goes on.", "Short.", "A longer paragraph with many words in it."]
    loose = PAGE.replace("<article>", '<div class="content">').replace("</article>", "</div>")
    assert html_text.content_lines(loose) == html_text.content_lines(PAGE)
    for odd in ("", "<", "<p>", "<article></article>", "</div></p>", "<!-- open", "<p>" * 2000, "&#x110000; &bad;"):
        html_text.content_lines(odd)
    assert html_text.content_lines("<p>a</p><!-- open <p>b</p>") == ["a"]
    df = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", PAGE), (3, "u", PAGE), (None, "v", "<p>x")], "page_id long, url string, html string")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in html_text.main_text(df.withColumn("text", df.url)).collect()), key=repr)
    assert [(i, n) for i, _, n in got] == [(1, 0), (2, 0), (3, len("\n\n".join(html_text.content_lines(PAGE)))), (3, got[3][2]), (None, 1)]
    assert html_text.main_text(df.limit(0)).count() == 0
    pages = spark.read.parquet(f"{data}/pages.parquet")
    assert html_text.main_text(pages).filter("n_chars = 0").count() == 0


def test_paragraphs_in_containers_of_their_own():
    menu = '<div>' + "".join(f'<p><a href="#{i}"><b>go {i}</b></a></p>' for i in range(12)) + "</div>"
    for tag in ("div", "section", "article", "blockquote"):
        for sizes in ((800, 750, 700, 650), (600, 500, 400, 550, 300, 450), (800, 700, 60), (800, 60, 700, 5, 5, 5, 650)):
            texts = [f"{i} " + "w" * n for i, n in enumerate(sizes)]
            parts = "".join(f"<{tag}><p>{t}</p></{tag}>" for t in texts)
            assert html_text.content_lines(f"<html><body>{parts}</body></html>") == texts
            assert html_text.content_lines(f"<body>{menu}<div>{parts}</div>{menu}</body>") == texts


def test_lines_all_alike_are_not_cut():
    texts = [f"{i} " + "w" * n for i, n in enumerate((90, 40, 60, 35, 80))]
    assert html_text.content_lines("".join(f"<div>{t}</div>" for t in texts)) == texts
