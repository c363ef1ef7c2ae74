"""The operators and the pipeline on small tables: brute force, SQL, and odd cases."""

import os

import pytest
from brute import near_components, overlaps, personal, quality_base
from oracle import compare, connect
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 97} of{i % 31}" for i in range(3000))
SHARED = "Some passage of several words that goes on. It has more than one sentence, and clauses too. All of it is copied word for word."
ODD_DOCS = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n ", None, None), (4, "one", "en", "b"), (4, "one", "en", "b"), (None, "no id here", "en", None),
    (5, LONG, "en", "hot"), (6, LONG + " changed", "en", "hot"), (7, "Intro. " + SHARED + " End a.", "de", "hot"), (8, "Other start. " + SHARED + " Tail.", "de", None),
    (9, "mail me at a.b@mail.example.com or +1 (555) 123-4567", "fr", "a"), (9, "same id, other text", "fr", "a"), (10, "x" * 30000, None, "c")]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(ODD_DOCS, "doc_id long, text string, lang string, source string")
    return docs.withColumn("n_chars", F.length("text").cast("long")).withColumn("score", F.lit("mine")).withColumn("place", F.lit(1)).withColumn("kept", F.lit("k"))


@pytest.fixture(scope="module")
def entry():
    import __spark_entry__

    return __spark_entry__


def docs_of(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", ["op1_decontamination", "op2_near_duplicates", "op6_url_filter", "op9_source_mix"])
def test_queries_with_sql(spark, entry, name):
    ok, note = compare(spark, connect(SF_DIR), name, entry.queries()[name], entry.oracle_sql()[name], SF_DIR)
    assert ok, note


def test_op1_finds_what_brute_force_finds(spark, entry):
    from clauseloom.llm import decontaminate as d

    got = {(r.doc_id, r.item_id) for r in entry.queries()["op1_decontamination"](spark, SF_DIR).collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    contained = {(i, j) for i, t in docs_of(spark) for j, b in items if b in t}
    assert contained and contained <= got
    rows = [(i, t) for i, t in docs_of(spark) if any(i == x for x, _ in got) or i % 9 == 0]
    rows = [(i, t) for i, t in rows if len(t) < 3000]
    assert {p for p in got if p[0] in dict(rows)} == overlaps(rows, items, d.WINDOW, d.PERCENT, d.SPAN)


def test_op1_tolerates_substitutions_and_odd_rows(spark, odd):
    from clauseloom.llm.decontaminate import contaminated, decontaminated

    words = [f"b{i}" for i in range(20)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, "too short"), (4, " ".join(words).upper())], "item_id long, text string")
    changed = words.copy()
    changed[3] = changed[9] = changed[15] = "other"
    docs = spark.createDataFrame([(1, "start " + " ".join(changed) + " end"), (2, " ".join(words[:6]) + " x y z " + " ".join(words[6:9])), (3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()] == [(1, 1)]
    assert {r.doc_id for r in decontaminated(docs.withColumn("item_id", F.lit(0)), bench).collect()} == {2, 3}
    assert contaminated(odd, bench).count() == 0 and contaminated(odd.limit(0), bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminated(odd, bench).columns == odd.columns and decontaminated(odd, bench).count() == len(ODD_DOCS)


def test_op1_has_a_seed_for_all_that_its_rule_allows(spark):
    from itertools import combinations

    from clauseloom.llm import decontaminate as d

    for n in range(d.SPAN, d.WINDOW + 1):
        changes = n - -(-d.PERCENT * n // 100)
        for other in combinations(range(n), changes):
            assert any(all(p + k not in other for k in mask) for mask in d.MASKS for p in range(n - mask[-1])), (n, other)
    items = [(1, "n0 n1 n2 n3 n4 n5 n6 n7 n8"), (2, "who wrote it"), (3, "一二三四五六七八九十"), (4, "c0 c1 c2 c3 c4 c5 c6"), (5, "—")]
    docs = [(1, "so n0 x n2 y n4 n5 n6 n7 n8 on"), (2, "And: Who wrote it?"), (3, "who wrote, or not, it"), (4, "前文一二三四五六七人九十後文"), (5, "c0 c1 c2 c3 c4 c5 c6"),
            (6, "it"), (7, None), (8, "")]
    got = d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.matched, r.window) for r in got} == {(1, 1, 7, 9), (2, 2, 3, 3), (4, 3, 9, 10), (5, 4, 7, 7)}
    nameless = [(None, items[0][1]), (None, items[3][1])]  # items are told apart by their tokens, not by their ids
    got = d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(nameless, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.matched, r.window) for r in got} == {(1, None, 7, 9), (5, None, 7, 7)}


def test_op2_matches_brute_force(spark, entry):
    rows = entry.queries()["op2_near_duplicates"](spark, SF_DIR).collect()
    want = near_components(docs_of(spark), 2, 80)
    assert {r.doc_id: r.component_id for r in rows} == want and len(rows) == len(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_op2_chains_hot_groups_and_odd_rows(spark, odd):
    from clauseloom.llm.neardup import deduplicated, grouped

    base = [f"t{i}" for i in range(60)]
    docs = [(1000 + k, " ".join(base[:k % 12] + [f"z{k}"] + base[k % 12 + 1:])) for k in range(150)]  # one large group of near copies
    docs += [(2000 + k, " ".join(f"c{i}" for i in range(4 * k, 4 * k + 40))) for k in range(12)]  # a chain: neighbours only
    docs += [(3000 + k, "same text here") for k in range(100)] + [(4000, None), (4001, "  ")]
    got = {r.doc_id: r.component_id for r in grouped(spark.createDataFrame(docs, "doc_id long, text string"), shingle=2, percent=80).collect()}
    assert got == near_components(docs, 2, 80)
    rows = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in grouped(odd).collect()]
    assert len(rows) == len(ODD_DOCS) and any(a == 6 and c == 5 and not d for a, _, c, d in rows)
    assert {(a, c, d) for a, _, c, d in rows if a in (1, 2, 3, 4, None)} == {(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (None, None, True)}
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    twice = [(1, one), (1, two), (2, one + " x"), (3, two + " y"), (4, "z " * 9), (None, "p q r"), (None, None)]
    for rows in (twice, twice[::-1]):  # one id on two texts: both sets count, in any order
        got = {(r.doc_id, r.component_id) for r in grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (None, None)}
    kept = deduplicated(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 6").count() == 0 and kept.count() == len(ODD_DOCS) - 1
    assert grouped(odd.limit(0)).count() == 0


def test_op3_counts_and_stored_prefix_table(spark, entry, odd):
    import public_tokenizers
    import sentencepiece
    from clauseloom.llm import tokencount as t

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in entry.queries()["op3_token_counts"](spark, SF_DIR).collect()}
    want = {i: (len((x or "").encode()), len(model.encode(x or "")), len(model.encode(x or "")) > 4096) for i, x in docs_of(spark)}
    assert got == want
    table = t.with_prefix_table(odd, path).withColumn("cut", t.truncated(F.col("text"), F.col("prefix_tokens"), 5)).withColumn(
        "at3", t.tokens_at(F.col("prefix_tokens"), 3)).collect()
    for r in table:
        text = r.text or ""
        fits = [k for k in range(len(text[:200]) + 1) if len(model.encode(text[:k])) <= 5]
        assert (r.cut or "") == text[:max(k for k in fits if all(j in fits for j in range(k + 1)))]
        assert r.at3 == len(model.encode(text[:3])) and len(r.prefix_tokens) == len(text)


def test_op4_base_columns_and_verdicts(spark, entry, odd):
    from clauseloom.llm import quality

    rows = {r.doc_id: r for r in entry.queries()["op4_quality_rules"](spark, SF_DIR).collect()}
    for i, text in docs_of(spark):
        r = rows[i]
        base = quality_base(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
        assert r.base_failed == failed and r.kept == (not failed and r.score >= quality.THRESHOLD)
    labels = spark.createDataFrame([(5, 1, 0), (5, 1, None), (7, 1, 1), (99, 1, 0), (None, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    ratios = quality.fitted(odd, labels)
    out = quality.scored(odd, ratios)
    assert out.columns == [*odd.columns, "quality_rules"] and out.where("quality_rules.n_words = 0").count() == 3
    assert not quality.fitted(odd, labels.limit(0)).any() and quality.scored(odd.limit(0), ratios).count() == 0


def test_op4_separates_labelled_quality(spark, entry):
    q = entry.queries()["op4_quality_rules"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    share = {r.quality: r.kept for r in q.where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()}
    assert share[1] == 1.0 and share[0] < 0.2


def test_op5_cuts_repeats_but_the_first(spark, odd):
    from clauseloom.llm.substring import repeated_regions, without_repeats

    texts = {r.doc_id: r.text for r in odd.where("doc_id IN (7, 8)").collect()}
    regions = [r for r in repeated_regions(odd).collect() if r.doc_id in (7, 8)]
    assert [(r.doc_id, r.first_doc_id, texts[8][r.start:r.end]) for r in regions] == [(8, 7, SHARED)]
    out = without_repeats(odd)
    assert out.columns == odd.columns and out.count() == len(ODD_DOCS)
    cut = {r.doc_id: r.text for r in out.where("doc_id IN (1, 2, 7, 8)").collect()}
    assert cut == {1: None, 2: "", 7: texts[7], 8: "Other start.  Tail."}
    assert repeated_regions(odd.limit(0)).count() == 0


def test_op5_matches_brute_force(spark, entry):
    """Runs of sentences and windows of 50 words, each covered unless it is the first of its kind."""
    import re

    got = {}
    for r in entry.queries()["op5_substring_dedup"](spark, SF_DIR).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    seen, first, later = set(), {}, {}
    for i, text in sorted(docs_of(spark)):
        words = [(m.start(), m.end(), m[0]) for m in re.finditer("[^\x20\x09-\x0D]+", text)]
        ends = [k for k, (a, b, w) in enumerate(words)
                if k + 1 == len(words) or re.search(r"[.!?,;:|][!-/:-@\[-`{-~]{0,7}$", w) or "\n" in text[b:words[k + 1][0]]]
        starts = [0] + [k + 1 for k in ends[:-1]]
        for k, s in enumerate(starts):
            for e in ends[k + 1:]:
                if e - s + 1 >= 20:
                    run = tuple(w for _, _, w in words[s:e + 1])
                    if run in seen:
                        later.setdefault(i, set()).update(range(words[s][0], words[e][1]))
                    seen.add(run)
                    break
        for k in range(len(words) - 49):
            window = tuple(w for _, _, w in words[k:k + 50])
            doc, end = first.setdefault(window, (i, words[k + 49][1]))
            if (doc, end) != (i, words[k + 49][1]):
                later.setdefault(i, set()).update(range(max(words[k][0], end if doc == i else 0), words[k + 49][1]))
    assert got == {i: x for i, x in later.items() if x}


def test_op5_covers_every_repeated_window_of_50_words(spark, entry):
    import re

    from clauseloom.llm.substring import repeated_regions

    prose = [f"p{i}{'.' if i % 70 == 69 else ''}" for i in range(400)]  # clauses of 70 words; copies start and end inside them
    made = [(1, " ".join(prose)), (2, "a start " + " ".join(prose[35:86]) + " an end"), (3, " ".join(prose[36:85])), (4, "x " + " ".join(prose[200:260]) + " y"),
            (5, "z " + " ".join(prose[205:330])), (6, "same " * 120), (None, " ".join(prose[100:160]))]
    for docs, rows in ((docs_of(spark), entry.queries()["op5_substring_dedup"](spark, SF_DIR).collect()),
                       (made, repeated_regions(spark.createDataFrame(made, "doc_id long, text string")).collect())):
        got, seen, wanted = {}, {}, {}
        for r in rows:
            got.setdefault(r.doc_id, set()).update(range(r.start, r.end))
        for i, text in sorted(docs, key=lambda d: (d[0] is None, d[0])):
            words = [m.span() for m in re.finditer("[^\x20\x09-\x0D]+", text)]
            for k in range(len(words) - 49):
                window = tuple(text[a:b] for a, b in words[k:k + 50])
                first, at = seen.setdefault(window, (i, words[k + 49][1]))
                start = max(words[k][0], at) if first == i else words[k][0]
                wanted.setdefault(i, set()).update(range(start, words[k + 49][1]))
        assert all(cover <= got.get(i, set()) for i, cover in wanted.items() if cover)
        if docs is made:
            assert {i: c for i, c in wanted.items() if c} == got


def test_op6_odd_urls(spark):
    from clauseloom.llm.urlfilter import judged

    rules = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/es/", "block"), ("a.example.org", "/", "block"), ("a.example.org", "/", "allow")],
                                  "host string, path string, verdict string")
    urls = [(1, None), (2, "no scheme"), (3, "http://"), (4, "http://X.EXAMPLE.org/es/1?q#f"), (5, "http://org"), (6, "http://notexample.org/es/"),
            (7, "http://a.example.org/x"), (7, "http://a.example.org/x"), (None, "ftp://org/x"), (8, "http://org?u=http://a"), (9, "http://example.org/" + "es/" * 5000)]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("verdict", F.lit("old")).withColumn("best", F.lit(1))
    got = sorted(((r.page_id, r.host, r.rule, r.verdict) for r in judged(pages, rules).collect()), key=str)
    assert got == sorted([(1, "", None, "allow"), (2, "", None, "allow"), (3, "", None, "allow"), (4, "x.example.org", "example.org/es/", "block"),
                          (5, "org", None, "allow"), (6, "notexample.org", "org/", "allow"), (7, "a.example.org", "a.example.org/", "block"),
                          (7, "a.example.org", "a.example.org/", "block"), (None, "org", "org/", "allow"), (8, "org", None, "allow"),
                          (9, "example.org", "example.org/es/", "block")], key=str)
    assert {r.verdict for r in judged(pages, rules.limit(0), "block").collect()} == {"block"} and judged(pages.limit(0), rules).count() == 0


def test_op7_pages(spark, entry):
    import html as h
    import re

    for r in entry.queries()["op7_main_text"](spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(h.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?p>|</?h1>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_op7_keeps_what_is_text_by_its_place():
    from clauseloom.llm.htmltext import main_text

    def p(k):
        return f"<p>Paragraph number {k} has a good many words in it, so that it counts as text, and one <a href=/x>link</a> among them.</p>"

    menu = "<ul>" + "".join(f"<li><a href=/{k}>Entry {k}</a></li>" for k in range(6)) + "</ul>"
    refs = "<ol>" + "".join(f"<li><a href=/r{k}>Source {k}</a></li>" for k in range(4)) + "</ol>"
    pages = [
        (f"<body><nav>{menu}</nav><article><h2><a href=/t>Title</a></h2>{p(1)}<p><a href=/only>Whole paragraph link</a></p>{p(2)}<h2>References</h2>{refs}</article>",
         ["Title", "Paragraph number 1", "Whole paragraph link", "Paragraph number 2", "References", "Source 0", "Source 3"], ["Entry"]),
        (f"<body><article><div class='post-header'><h1>Name</h1></div>{p(1)}<h2 id='related-work'>Earlier</h2>{p(2)}<section id='social-impact'>{p(3)}</section>"
         f"<section class='notice'>{p(4)}</section></article><div class='related-posts'>{p(5)}</div><div id='comments'>{p(6)}</div>",
         ["Name", "Earlier", "number 1", "number 2", "number 3", "number 4"], ["number 5", "number 6"]),
        (f"<body><div class='content has-sidebar'>{p(1)}{p(2)}</div><div class='sidebar'>{p(3)}</div>", ["number 1", "number 2"], ["number 3"]),
        (f"<body><div class='widget'>{p(1)}{p(2)}{p(3)}</div><div class='share'>{p(4)}</div>", ["number 1", "number 2", "number 3"], ["number 4"]),
        (f"<body><main><h1>Heading over it</h1><article>{p(1)}{p(2)}{p(3)}</article><article>{p(4)}</article></main><footer>End</footer>",
         ["Heading over it", "number 1", "number 3", "number 4"], ["End"]),
        (f"<body><div><article>{p(1)}{p(2)}{p(3)}</article><article>{p(4)}{p(5)}</article></div>", ["number 1", "number 3", "number 4", "number 5"], []),
        (f"<body>{menu}{p(1)}{p(2)}{p(3)}<ul><li><a href=/a>About</a></li><li><a href=/b>Imprint</a></li><li><a href=/c>Terms</a></li></ul>",
         ["number 1", "number 2", "number 3"], ["Entry", "Imprint"]),
        (f"<body><article>{p(1)}</article><div class='comments'>{p(2)}{p(3)}{p(4)}</div>", ["number 1"], ["number 2"]),
    ]
    for html, kept, gone in pages:
        text = main_text(html)
        assert [x for x in kept if x not in text] == [] and [x for x in gone if x in text] == [], (html, text)


def test_op7_leaves_out_what_readers_and_advertisers_write():
    from clauseloom.llm.htmltext import main_text

    text = "".join(f"<p>Sentence number {k} of the article has a good many words, and a comma or two.</p>" for k in range(4))
    other = "<p>Somebody else wrote this, which is long enough to be taken for text as well.</p>"
    for tag, name in (("section", "id=comments"), ("section", "class=comments"), ("section", "class=comment-list"), ("div", "class=user-comments"),
                      ("ol", "class=commentlist"), ("div", "class=comment-thread"), ("section", "class=newsletter"), ("div", "class=ad-slot"),
                      ("div", "id=sidebar"), ("div", "class='cookie-banner'"), ("div", "id=disqus_thread"), ("div", "class=commentsSection")):
        for around in ("<div class=content>%s</div>%s", "<main>%s%s</main>", "<main><div>%s</div></main>%s", "<article>%s</article>%s", "<body>%s%s"):
            got = main_text(around % (text, f"<{tag} {name}>{other}</{tag}>"))
            assert "number 3" in got and "Somebody" not in got, (tag, name, around)


def test_op7_matches_densities_computed_plainly():
    import math
    import random
    from xml.etree import ElementTree as E

    from clauseloom.llm.htmltext import main_text

    rnd = random.Random(11)

    def words(n):
        return " ".join(rnd.choice(("alpha", "beta", "of", "gamma")) + str(rnd.randrange(99)) for _ in range(n))

    def grown(depth):
        node = E.Element("div")
        for _ in range(rnd.randrange(1, 5)):
            if depth and rnd.random() < 0.5:
                node.append(grown(depth - 1))
            else:
                p = E.SubElement(node, "p")
                p.text = words(rnd.randrange(1, 40))
                for _ in range(rnd.choice((0, 0, 1, 2))):
                    a = E.SubElement(p, "a", href="/x")
                    a.text, a.tail = words(rnd.randrange(1, 6)), words(rnd.randrange(0, 9))
        return node

    def figures(node):
        """characters, tags, characters and tags in links"""
        letters = lambda e: sum(len(x.replace(" ", "")) for x in e.itertext())
        links = list(node.iter("a"))
        return letters(node), sum(1 for _ in node.iter()) - 1, letters(node) if node.tag == "a" else sum(map(letters, links)), len(links) - (node.tag == "a")

    for _ in range(150):
        body = E.Element("body")
        for _ in range(rnd.randrange(1, 4)):
            body.append(grown(3))
        share = figures(body)[2] / figures(body)[0]

        def density(node):
            c, t, lc, lt = figures(node)
            t = t or 1
            if not share:
                return c / t
            return c / t * math.log(max(1, c / max(1, lc) * t / max(1, lt))) / math.log(math.log(c * lc / max(1, c - lc) + share * c + math.e))

        parent = {x: y for y in body.iter() for x in y}
        score = {x: sum(density(y) for y in x) for x in body.iter() if x.tag in ("body", "div")}
        best = max(score.values())
        winner = next(x for x in body.iter() if score.get(x, -1) >= best)
        path, x = [winner], winner
        while x in parent:
            x = parent[x]
            path.append(x)
        threshold = min(map(density, path))

        def kept(p):
            ways, x = [p], p
            while x in parent:
                x = parent[x]
                ways.append(x)
            return winner in ways or any(density(x) >= threshold > 0 for x in ways if x not in path)

        want = [" ".join("".join(p.itertext()).split()) for p in body.iter("p") if kept(p)]
        assert main_text(E.tostring(body, "unicode")) == "\n\n".join(x for x in want if x)


def test_op7_odd_tables(spark):
    from clauseloom.llm.htmltext import with_main_text

    rows = [(None, None), (1, "<p>one"), (1, "<p>one"), (2, ""), (2, "<p>" + "long word " * 30000)]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("replaced")).withColumn("url", F.lit(None).cast("string"))
    assert sorted((r.page_id or 0, len(r.text)) for r in with_main_text(pages).collect()) == [(0, 0), (1, 3), (1, 3), (2, 0), (2, 299999)]
    assert with_main_text(pages.limit(0)).count() == 0 and set(with_main_text(pages).columns) == set(pages.columns)


def test_op8_spans_digest_and_masking(spark, entry, odd):
    from hashlib import sha256

    from clauseloom.llm import pii

    rows = {r.doc_id: r for r in entry.queries()["op8_personal_data"](spark, SF_DIR).collect()}
    found = 0
    for i, text in docs_of(spark):
        base, r = personal(text), rows[i]
        assert r.base_sha256 == sha256(pii.joined(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.BASE_KINDS]
        assert set(pii.joined(base).split(",")) - {""} <= set(r.spans.split(","))
        found += len(base)
    assert found
    model = pii.trained(pii.pattern_counts(odd))
    out = {(r.doc_id, r.text) for r in odd.withColumn("text", pii.masked(F.col("text"), model)).collect()}
    assert (9, "mail me at <EMAIL> or <PHONE>") in out and (1, None) in out
    assert not len(pii.trained(pii.pattern_counts(odd.limit(0))).weights)


def test_op9_targets_and_limits(spark, odd):
    from clauseloom.llm.mixing import curriculum, mixed, sized

    sizes = sized(odd, F.col("doc_id")).cache()
    rows = mixed(sizes, sizes.drop("doc_id")).collect()
    assert len(rows) == len(ODD_DOCS) and all(0 <= r.taken <= 3 * r.size for r in rows)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) < 1 and own[0].target <= 3 * own[0].source_size
    assert abs(sum({r.source: r.target for r in rows}.values()) - sum(r.size for r in rows)) < 1e-6
    copies = curriculum(odd).collect()
    assert sum(c.words for c in copies) == sum(r.taken for r in rows)
    assert [c.position for c in copies] == sorted(c.position for c in copies) and all(0 <= c.position <= 1 for c in copies)
    assert set(copies[0].doc.asDict()) == set(odd.columns) and curriculum(odd.limit(0)).count() == 0


def test_op10_held_out_accuracy_and_odd_rows(spark, entry, odd):
    from clauseloom.llm import langid

    got = entry.queries()["op10_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    assert got.where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] >= 0.98
    model = langid.fitted(odd.withColumn("key", F.col("doc_id")))
    rows = odd.select("doc_id", langid.predicted(F.col("text"), model).alias("p")).collect()
    assert all(r.p.lang == "und" and r.p.score == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert all(r.p.lang in ("en", "de", "fr") and 0 <= r.p.score <= 1 for r in rows if r.doc_id not in (1, 2, 3))
    none = langid.fitted(odd.withColumn("key", F.col("doc_id")).limit(0))
    assert odd.select(langid.predicted(F.col("text"), none).alias("p")).where("p.lang <> 'und'").count() == 0


def test_pipeline_stages(spark, odd, tmp_path):
    import corpus_pipeline
    from clauseloom.session import stored

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF_DIR), f"test-{name}")
        kept.append((name, docs))
        if name != "source_mix":
            assert docs.columns == columns
    by = dict(kept)
    assert near_components([(r.doc_id, r.text) for r in by["near_duplicates"].collect()], 5, 80) == {r.doc_id: r.doc_id for r in by["near_duplicates"].collect()}
    assert not any(personal(r.text) for r in by["personal_data"].collect())
    ran = corpus_pipeline.run(spark, SF_DIR)
    assert sorted(map(str, ran.collect())) == sorted(map(str, by["source_mix"].collect()))
    for k, t in (("labels", None), ("benchmark", None)):
        spark.read.parquet(f"{SF_DIR}/{k}.parquet").write.parquet(os.path.join(tmp_path, f"{k}.parquet"))
    plain = odd.select(*columns)
    for rows in (plain, plain.limit(0)):
        docs = rows
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, str(tmp_path)), f"odd-{name}")
        assert docs.count() >= 0
