"""Queries over every row against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from gaugeworks import plans
from gaugeworks.operators import retrieval as S


def rows(data, table):
    return pq.read_table(f"{data}/{table}.parquet").to_pylist()


@pytest.fixture(scope="module")
def dense(data):
    """The 30 nearest of every fiftieth vector."""
    vectors = rows(data, "embeddings")
    x = np.array([r["embedding"] for r in vectors], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = [r["vec_id"] for r in vectors]
    out = {}
    for i, q in enumerate(ids):
        if q % 50 == 0:
            score = np.round(x @ x[i], 6)
            out[q] = sorted(range(len(ids)), key=lambda k: (-score[k], ids[k]))[:30]
            out[q] = [ids[k] for k in out[q]]
    return out


def test_dense_and_metrics(spark, data, dense, monkeypatch):
    monkeypatch.setattr(S, "QUERY_BLOCK", 3)
    monkeypatch.setattr(S, "CHUNK_BLOCK", 120)
    got = defaultdict(dict)
    for r in plans.queries()["o89_dense_topk"](spark, data).collect():
        got[r.query_id][r["rank"]] = r.chunk_id
    assert max(dense) >= 60 and {q: [c[k] for k in sorted(c)] for q, c in got.items()} == dense
    label = {r["vec_id"]: r["label"] for r in rows(data, "embeddings")}
    size = Counter(label.values())
    want = {}
    for q, top in dense.items():
        hit = [label[c] == label[q] for c in top[:10]]
        ideal = sum(1 / math.log2(i + 1) for i in range(1, min(size[label[q]], 10) + 1))
        dcg = sum(h / math.log2(i + 2) for i, h in enumerate(hit))
        want[q] = (sum(hit) / size[label[q]], sum(hit[:5]) / 5, dcg / ideal)
    metrics = {r.query_id: r for r in plans.queries()["o97_ir_metrics"](spark, data).collect()}
    assert set(metrics) == set(want)
    for q, (recall, precision, ndcg) in want.items():
        assert np.allclose((metrics[q].recall_at_10, metrics[q].precision_at_5, metrics[q].ndcg_at_10), (recall, precision, ndcg), atol=1e-4)
    all_ = {r.scenario: r for r in plans.queries()["o98_ir_summary"](spark, data).collect()}["all"]
    assert all_.queries == len(want) and np.isclose(all_.recall_at_10, np.mean([w[0] for w in want.values()]), atol=1e-4)
    assert [r.recall_at_5 for r in plans.queries()["o99_ir_gate"](spark, data).orderBy("run").limit(1).collect()] == [all_.recall_at_5]


def test_fused_with_words(spark, data, dense):
    words = {r["doc_id"]: [w for w in re.split(r"[\W_]+", r["text"].lower()) if w] for r in rows(data, "documents")}
    ids = set(words)
    tf = {d: Counter(words[d]) for d in ids}
    df = Counter(t for c in tf.values() for t in c)
    mean = np.mean([len(words[d]) for d in ids])
    got = defaultdict(dict)
    for r in plans.queries()["o91_rrf"](spark, data).collect():
        got[r.query_id][r.chunk_id] = r.fused
    assert set(got) == {d for d in ids if d % 50 == 0} | set(dense)
    near = {q: {d: k for k, d in enumerate(top)} for q, top in dense.items()}
    for q in sorted(got):
        score = {}
        for d in ids:
            parts = [math.log(1 + (len(ids) - df[t] + 0.5) / (df[t] + 0.5)) * tf[d][t] * 2.2 / (tf[d][t] + 1.2 * (0.25 + 0.75 * len(words[d]) / mean)) * n for t, n in tf.get(q, {}).items() if t in tf[d]]
            if parts:
                score[d] = round(sum(parts), 6)
        lexical = {d: k for k, d in enumerate(sorted(score, key=lambda d: (-score[d], d))[:30])}
        want = {d: round(sum(1 / (61 + part[d]) for part in (near.get(q, {}), lexical) if d in part), 9) for d in near.get(q, {}) | lexical}
        assert got[q].keys() == want.keys() and np.allclose([got[q][d] for d in want], list(want.values()), atol=1e-8)


def test_all_profiles(spark, data):
    got = plans.queries()["o57_score_profiles"](spark, data).collect()
    each = Counter()
    for r in got:
        each[r.profile] += r.devices
    assert len(each) == 2 and len(set(each.values())) == 1


def digest(text):
    return hashlib.md5(text.encode()).hexdigest()


def doc_text(r):
    """The text of the model's ``doc``."""
    return f"phone +7 (912) 345-67-{r['doc_id'] % 100:02d} code C{r['doc_id'] % 1000:04d} fuser unit  x\n\n\n{r['text']}"


def test_all_sections(spark, data):
    heading = re.compile(r"(?:#{1,3}[ \t\n\x0b\f\r]+[^\r\u0085\u2028\u2029]+|[A-ZА-ЯЁ][A-ZА-ЯЁ \t\n\x0b\f\r]{5,})")
    want = []
    for r in rows(data, "documents"):
        text = f"before {r['lang']}\n# First part\none\ntwo\nSAFETY NOTES\n{'three' if r['doc_id'] % 2 == 0 else ''}\n### Last\n{doc_text(r)}"
        parts = [("Introduction", [])]
        for line in text.split("\n"):
            if heading.fullmatch(line):
                parts.append((re.sub(r"^#+\s*|\s*#+$", "", line.strip(" ")), []))
            else:
                parts[-1][1].append(line)
        for no, (title, lines) in enumerate(parts):
            if body := "\n".join(lines).strip(" \t\n\x0b\f\r"):
                want.append((f"D{r['doc_id']}", no, title, digest(body)))
    got = plans.queries()["o78_split_headings"](spark, data).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_all_page_texts(spark, data):
    pages = defaultdict(list)
    for r in sorted(rows(data, "documents"), key=lambda r: r["doc_id"]):
        pages[r["source"]].append(doc_text(r))
    want = []
    for source, texts in pages.items():
        at = [p for p in range(3, len(texts) + 1, 3) if p % 9]
        for p, until in zip(at, [*at[1:], len(texts) + 1]):
            want.append((source, p, f"mark {p}", p, digest("\n\n".join(texts[p - 1 : until - 1]).strip(" "))))
    got = plans.queries()["o79_split_bookmarks"](spark, data).collect()
    assert sorted(map(tuple, got)) == sorted(want)
