"""Cases that a bound once left out: long words teach, deep elements are told apart, short candidates are read."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest

from gaugeworks.llm import html_text, langid, secrets

PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("with_probs", [True, False])
def test_uses_of_long_words_are_those_of_one_pass(monkeypatch, with_probs):
    vocab = langid.pieces(PIECES)
    rng = np.random.default_rng(5)
    probs = np.maximum(rng.random((len(vocab.pieces), 3)) / 100, langid.FLOOR) if with_probs else None
    words, counts = ["international" * 40, "électricité" * 31, "x" * 700, "word"], rng.random((4, 3)) * 3
    want = langid.expected(words, counts, PIECES, probs)
    logs = langid.log_probs(words, PIECES, probs) if with_probs else None
    monkeypatch.setattr(langid, "SPAN", 4 * langid.STEP)
    got = langid.expected(words, counts, PIECES, probs)
    assert np.allclose(got, want, rtol=1e-9, atol=1e-12) and want.sum() > 0
    if with_probs:
        assert np.allclose(langid.log_probs(words, PIECES, probs), logs)


@pytest.mark.parametrize("letters", [300, 40_000])
def test_long_words_change_what_is_learned(spark, letters):
    rows = [(i, "the thing of a word", "en") for i in range(20)] + [(100 + i, "der ding und das wort", "de") for i in range(20)]
    schema = "doc_id long, text string, lang string"
    _, before = langid.train(spark.createDataFrame(rows, schema), PIECES)
    _, after = langid.train(spark.createDataFrame([*rows, (200, "qu" * (letters // 2), "de")], schema), PIECES)
    assert not np.allclose(before, after)


@pytest.mark.parametrize("depth", [7, 8, 12, 40])
def test_an_advert_below_many_named_elements(depth):
    page = "<html><body>" + '<div class="share">' * depth + "<p>" + "words of the article are here. " * 40 + '</p><div class="ad"><p>buy this now</p></div>' + "</div>" * depth + "</body></html>"
    text = "\n".join(html_text.content_lines(page))
    assert "words of the article" in text and "buy this" not in text


ARTICLE = "<p>" + "words of the article are here. " * 12 + "</p><p>" + "more words of the same text follow. " * 10 + "</p>"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><body><article>{ARTICLE}</article>",  # a head that is left open
        f"<html><head><title>T</title><div>{ARTICLE}</div>",
        f"<body><object><article>{ARTICLE}</article></object>",
        f"<body><select><option>a<option>b<article>{ARTICLE}</article>",
    ],
)
def test_open_elements_lose_no_text(page):
    text = html_text.content_lines(page)
    assert len(text) == 2 and text[0].startswith("words of") and text[1].startswith("more words")


def test_a_heading_beside_its_text():
    menu = "<div>" + "".join(f"<a href='{i}'>Link {i}</a><br>" for i in range(9)) + "</div>"
    got = html_text.content_lines(f"<body>{menu}<h1>The title</h1><div>{ARTICLE}</div></body>")
    assert got[0] == "The title" and len(got) == 3


def test_short_runs_are_candidates_and_plain_words_are_not():
    text = "see Zk3vQ9xW1pLr8s and x9K2mQ. Then Wordings follow plainly, 555-7713 too; password=hunter2x"
    got = [(text[s:e], label, found) for s, e, label, found in secrets.candidates(text, secrets.base_spans(text))]
    assert got == [("Zk3vQ9xW1pLr8s", secrets.UNKNOWN, False), ("x9K2mQ.", secrets.UNKNOWN, False), ("555-7713", secrets.OTHER, False), ("hunter2x", secrets.SECRET, True)]


def test_long_findings_teach(spark):
    """A finding of far more windows than are drawn of one is learned from."""
    r = __import__("random").Random(3)
    value = lambda k: "".join(r.choice("ABCDEFGHJKLMabcdefghjkm23456789") for _ in range(k))
    texts = [f"the token = {value(9000)} of it" for _ in range(14)] + [f"see {r.randint(10**15, 10**16)} there" for _ in range(14)]
    found = secrets.extract(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert secrets.train(found) is not None and secrets.train(found, least=40) is None
