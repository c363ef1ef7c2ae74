"""Numpy and Python parts of the operators against plain versions; no Spark session needed."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from brute import WORD, personal, quality_base, shingles
from clauseloom.llm import htmltext, langid, neardup, pii, quality, substring
from clauseloom.llm.textarrays import pieces
from clauseloom.llm.tokencount import PrefixCounter

ODD = [None, "", " ", "\n\n", "a", "A b", "x\x0by\x0cz", "é ß　日本", "a b", "##\n##\n##", "same line\nsame line \nsame line",
       "w " * 500, "one two three four five one two three four five six", "🙂 🙂", "a" * 5000, "b\r\nb\r\nb"]


def texts(n, seed=0):
    rnd = random.Random(seed)
    words = ["the", "of", "Tion", "é", "日本", "a|b", "x#", "ing.", "er!", "\n", "  ", "\t", "12", "...", "end.\nNew"]
    return ODD + [" ".join(rnd.choice(words) for _ in range(rnd.randrange(80))) for _ in range(n)]


def test_words_and_base_counts_match_plain_python():
    values = texts(300)
    for limit in (50, 2_000_000):
        got = []
        for piece in pieces(pa.array(values, pa.string()), limit):
            m = quality.measured(piece, np.zeros(quality.BUCKETS))
            got += list(zip(*(m[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))))
        assert got == [quality_base(t) for t in values]


def test_shingle_sets_have_the_sizes_and_overlaps_of_plain_sets():
    values = texts(120, 1)
    for n in (2, 5):
        got = [s for piece in pieces(pa.array(values, pa.string()), 300) for s in neardup.shingle_sets(piece, n)]
        want = [shingles(t, n) for t in values]
        assert [len(s) for s in got] == [len(s) for s in want]
        for i in range(0, len(values), 7):
            for j in range(0, len(values), 5):
                assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


def test_sketches_estimate_similarity_and_merge():
    rng = np.random.default_rng(5)
    for size in (3, 40, 3000):
        for share in (0.5, 0.8, 0.95):
            common = int(size * 2 * share / (1 + share))
            both = rng.integers(0, 2**63, 2 * size - common).astype(np.uint64)
            a, b = both[:size], both[size - common:]
            ra, rb, union = neardup.registers(a), neardup.registers(b), neardup.registers(both)
            assert (np.maximum(ra, rb) == union).all()
            j = common / (2 * size - common)
            guess = neardup.likely_similarity(ra[None], rb[None], np.array([float(size)]), np.array([float(size)]))[0]
            assert abs(guess - j) < neardup.MARGIN


def test_prefix_counts_are_those_of_the_tokenizer():
    path = public_tokenizers.path("piece_bpe_32k.model")
    model, counter = sentencepiece.SentencePieceProcessor(model_file=path), PrefixCounter(path)
    rnd = random.Random(2)
    alphabet = ["the ", "tion", "é", " ", "  ", "\n", "▁", "日", "<s>", "0", "\x00", "er", ".", "🙂", "\t", "</s>", "Qu", "zz"]
    for k in range(150):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(25)))
        want = [len(model.encode(text[:i])) for i in range(1, len(text) + 1)]
        assert counter.prefix_counts(text).tolist() == want
        assert counter.total(text) == (want[-1] if want else 0)
    for text in (" " * 70, "x" + " " * 40 + "y", "ab" * 300, ""):
        assert counter.total(text) == len(model.encode(text))


def test_fixed_personal_spans_match_the_patterns():
    rnd = random.Random(4)
    parts = ["a", ".", "@", "-", "b.c", "1", "23", "255", "256", "+", " ", "(", ")", "4111111111111111", "é", "_", "%", "+49 30 1234567"]
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(25)))
        assert pii.base_spans(text) == personal(text)
    assert pii.spans_of(None, pii.Model()) == ([], [])
    assert pii.masked_text("mail a@b.de now", [("email", 5, 11)]) == "mail <EMAIL> now"


def test_long_odd_texts_take_linear_time():
    text = "a" * 200_000 + "@" + "1" * 200_000 + " " + "1." * 100_000 + "+1" + "(" * 100_000
    assert pii.spans_of(text, pii.Model())[1] == []
    assert htmltext.main_text("<div>" * 20_000 + "x" + "</b>" * 20_000) == "x"
    assert htmltext.main_text('<a href="' * 5_000) == ""


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies and more.</div>
%s<div id="sidebar"><p>Popular stories of the week for you to read</p></div><form><input><button>Send</button></form>
<section id="comments"><p>Great read! I liked this very much, a text with many good words.</p></section><footer>&copy; me</footer></body></html>"""


def test_main_text_of_article_and_plain_pages():
    body = "<h1>Title</h1><p><b>First &amp; last.<br>next <p>Second   one\nwith <a href=x>a link</a> inside it, long enough.</p><ul><li>one<li>two</ul>"
    want = "Title\n\nFirst & last. next\n\nSecond one with a link inside it, long enough.\n\none\n\ntwo"
    assert htmltext.main_text(PAGE % f"<article>{body}</article>") == want
    assert htmltext.main_text(PAGE % f"<div class=content>{body}</div>") == want
    assert htmltext.main_text(PAGE % f"<main><div>{body}</div>") == want
    for html, text in ((None, ""), ("", ""), ("<p>", ""), ("plain &lt; text", "plain < text"), ("<p>a<p>b", "a\n\nb"), ("<!-- x", ""), ("<p>a &am b", "a &am b")):
        assert htmltext.main_text(html) == text


def test_sentence_runs_start_at_every_sentence_and_ignore_white_space():
    text = "A one two. B three four.\nC five six! D seven"
    runs = []
    for value in (text, text.replace(" ", "  ")):
        piece = next(pieces(pa.array([value])))
        of, h1, h2, start, end = substring.runs_of(piece, 2, 1)
        runs.append((h1.tolist(), h2.tolist()))
        assert [value.encode()[a:b].decode().split()[0] for a, b in zip(start, end)] == ["A", "B", "C"]
    assert runs[0] == runs[1] and len(set(runs[0][0])) == 3


def test_presence_kernel_counts_shared_ngrams():
    a, b = langid.presence(["Abc 12", "abc  99"])
    assert abs(float(a @ b) - 1) < 1e-6  # case, digits and white space are evened out
    assert WORD.findall("a b c") == ["a b", "c"]
