import time

import pytest

from epiloom.llm.dom import leaf_blocks
from epiloom.llm.html_extraction import block_features, extract, main_text, trained
from epiloom.llm.page_samples import labelled_pages


@pytest.fixture(scope="module")
def model():
    return trained()


def test_held_out_pages(model):
    right = total = 0
    for page, main in labelled_pages(150, seed=987):
        blocks = leaf_blocks(page)
        assert main <= {b.text for b in blocks}
        labels = model.viterbi(blocks)
        right += sum(int(b.text in main) == y for b, y in zip(blocks, labels, strict=True))
        total += len(blocks)
    assert right / total > 0.985


PAGE = """<html><head><title>T</title><script>if (a<b) x("</p>")</script></head><body><nav><a href=/>Home</a><a href=/x>Other</a></nav>
<div class="cookie-notice">We use cookies.</div><article><h1>On &amp; about\n  things</h1><p>First   paragraph, with <b>bold</b> words &lt;here&gt; and more of it.<br>Second line.
<p>An unclosed one, long enough to be read as text by anyone who reads it.<div class="ad">Buy now!</div><ul><li>An item in the list</li></ul></article>
<section id="comments"><p>I like this very much, thank you.</p></section><aside><h3>Related</h3><p>Elsewhere.</p></aside><form><p>Subscribe</p></form><footer>&copy; someone</footer>"""


def test_a_page(model):
    assert main_text(PAGE, model) == "On & about things\n\nFirst paragraph, with bold words <here> and more of it. Second line.\n\nAn unclosed one, long enough to be read as text by anyone who reads it.\n\nAn item in the list"


def test_broken_markup_and_rows(spark, model):
    for page in ("", "<", "<<<", "<p", "plain", "</p></div>", "<!-- open", "<script>", "<a title='>'>x</a>", "<p>" * 3000 + "x", "&#xD800; &bogus; &", "<div " + "a" * 100_000):
        assert isinstance(main_text(page, model), str)
    rows = [(1, "u", PAGE, "t"), (None, None, None, None), (2, "u", "", ""), (2, "u", "", ""), (3, "u", "<article><p>" + "word " * 200_000 + "end.</p></article>", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract(df, model).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.n_chars for r in got}[3] == 200_000 * 5 + 4
    assert extract(df.limit(0), model).count() == 0


def test_cues_of_the_whole_block():
    seen = lambda text: set(block_features(leaf_blocks(f"<div><p>{text}</p></div>"))[0])
    assert {"cue:cookies", "cue:privacy", "cue:©"} <= seen("word " * 60 + "cookies privacy ©")
    assert "rare:cookies" in seen("word " * 300 + "cookies")
    assert seen("cookies " + "word " * 300) == seen("word " * 150 + "cookies " + "word " * 150)  # no place in the block weighs more
    assert not any(x.startswith(("cue:", "rare:")) for x in seen("word " * 300))


MILLION = {
    "tags without end": "<a " * 350_000,
    "quotes without end": "<a '>" * 200_000 + '<b "',
    "ends in quotes only": '<a ">" ' * 150_000,
    "open sections of text": "<![CDATA[" * 110_000 + ">",
    "bare brackets": "<" * 1_000_000 + ">",
    "nested": "<div><p>a word</p>" * 50_000,
    "nested with names": "".join(f"<div class=n{i}a{i}><p>x</p>" for i in range(35_000)),
    "ends of nothing": "<x>" * 100_000 + "</y>" * 100_000,
    "items in depth": "<li><ul>" + "<x>" * 100_000 + "<li></li>" * 70_000,
    "open scripts": "<script>" * 120_000,
    "comments": "<!--" * 250_000,
    "attributes": "<div " + "a=b " * 250_000 + ">x</div>",
    "references": "&bogus" * 160_000,
}


@pytest.mark.parametrize("kind", MILLION)
def test_a_million_characters_of_broken_markup_take_seconds(model, kind):
    began = time.process_time()
    assert isinstance(main_text(MILLION[kind], model), str)
    assert time.process_time() - began < 5
