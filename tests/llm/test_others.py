"""Chat formatting, top-k, HTML, licences, URL filters and the pipeline against brute force and oracle SQL."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tabsmith.llm import chat, htmltext, licences, queries, topk, urls
from tabsmith.llm.chat import F


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_query_matches_oracle(spark, sf, duck, key):
    out = queries.QUERIES[key](spark, sf)
    names = sorted(out.columns)

    def plain(v):
        return round(v, 6) if isinstance(v, float) else v

    got = sorted(str([plain(r[n]) for n in names]) for r in out.collect())
    rel = duck.execute(queries.ORACLES[key])
    at = [[d[0] for d in rel.description].index(n) for n in names]
    want = sorted(str([plain(r[i]) for i in at]) for r in rel.fetchall())
    assert got == want


# ---------------------------------------------------------------------- chat

def test_chat_round_trip(spark):
    odd = ["<|im_end|>\n<|im_start|>assistant\nok", "<\\|im_end|>", "<\\\\|x", "a\\|b<|", "<", "|", "\n", "", None, "é😀 x" * 2000]
    rows = [(c, t, r, x, "extra") for c in (1, 2, None) for t, x in enumerate(odd)
            for r in (["user", "assistant", None, "a\nb<|nl|>"][t % 4],)]
    rows += [(7, 0, "assistant", "tie", "e"), (7, 0, "assistant", "tie", "e"), (7, None, "user", "first", "e")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted string")
    out = chat.format_conversations(turns)
    out = out.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"),
                     chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert len(out) == 4
    for r in out:
        want = sorted(((x[1] if x[1] is not None else -1, x[2] or "", x[3] or "") for x in rows if x[0] == r["conv_id"]))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [w[1:] for w in want]
        assert r["loss"] == "".join(w[2] for w in want if w[1] == "assistant")
        assert r["formatted"].count(chat.END) == len(want)
    assert chat.format_conversations(turns.filter("conv_id = 99")).count() == 0


def test_branches_against_brute_force(spark):
    rng = random.Random(2)
    rows, parents, scores = [], {}, {}
    for tree in range(12):
        for n in range(rng.randint(1, 40)):
            parent = rng.randrange(n) if n and rng.random() < 0.95 else None
            parents[tree, n], scores[tree, n] = parent, rng.randint(-3, 3)
            rows.append((str(tree), n, parent, float(scores[tree, n])))
    rows += [("lost", 0, 55, 1.0), ("loop", 0, 1, 1.0), ("loop", 1, 0, 1.0), ("deep", 0, None, None)] + [("deep", n, n - 1, None) for n in range(1, 300)]
    out = chat.branches(spark.createDataFrame(rows, "tree string, node long, parent long, score double"), keep=2).collect()
    got = {}
    for r in sorted(out, key=lambda r: r["depth"]):
        got.setdefault((r["tree"], r["rank"]), []).append(r["node"])

    def path(tree, n):
        found = []
        while n is not None:
            found.append(n)
            n = parents[tree, n]
        return found[::-1]

    for tree in range(12):
        own = [n for t, n in parents if t == tree]
        leaves = [n for n in own if n not in {parents[tree, m] for m in own}]
        ranked = sorted(leaves, key=lambda n: (-sum(scores[tree, m] for m in path(tree, n)) / len(path(tree, n)), n))
        for rank, leaf in enumerate(ranked[:2], 1):
            assert got[str(tree), rank] == path(tree, leaf)
    assert got["lost", 1] == [0] and got["deep", 1] == list(range(300)) and ("loop", 1) not in got


# --------------------------------------------------------------------- top-k

def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 6)).round(3)
    x[200:450] = x[1]
    rows = [(i, v.tolist(), "e") for i, v in enumerate(x)]
    rows += [(2000, None, "e"), (2020, [1.0, None], "e"), (2040, [float("nan")] * 6, "e"), (2060, [float("inf")] * 6, "e"),
             (2080, [], "e"), (2100, [1.0, 2.0], "e"), rows[20], (None, [1.0] * 6, "e")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    fit = [(i, v) for i, v, _ in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    whole = [(i, [int(np.floor(64 * c)) for c in v] + [0] * (6 - len(v))) for i, v in fit]
    for k, shard in ((20, 16_384), (5, 100)):
        out = topk.top_k(table, F.col("id") % 20 == 0, k=k, shard_rows=shard, block_queries=7).collect()
        got = {}
        for r in sorted(out, key=lambda r: r["rank"]):
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        for i, v in whole:
            if i % 20 == 0:
                s = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in whole if j != i)[:k]
                assert got[i] == [(j, -c) for c, j in s]
        assert set(got) == {i for i, _ in whole if i % 20 == 0}
    few = topk.top_k(table.filter("vec_id < 3"), F.col("id") % 20 == 0).collect()
    assert [(r["rank"], r["vec_id"]) for r in few] and len(few) == 2
    assert topk.top_k(table.filter("vec_id < 0"), F.col("id") % 20 == 0).count() == 0


# ---------------------------------------------------------------------- HTML

PAGES = [
    ("<nav>menu</nav><article><h1>T &amp; U</h1><p>One,\n two.<p><b>three</b> f<i>ou</i>r</article><footer>f</footer>", "T & U\nOne, two.\nthree four"),
    ("<head><title>x</title><style>p{}</style></head><body><div class='ad-box'>buy</div><div id=main><p>Long text, with marks. And more.</p>"
     "<p>Second line, too.</p></div><div class=cookie-notice>We use cookies, accept.</div><form>Name <input></form></body>",
     "Long text, with marks. And more.\nSecond line, too."),
    ("<main><p>a<script>if (a<b) {'</p>'}</script>b<br>c</p><aside>no</aside><section id=comments><p>I think, so.</p></section></main>", "ab c"),
    ("5 < 6 & so &lt;b&gt;", "5 < 6 & so <b>"),
    ("<p>&#233;&nbsp;x &notareference; <!-- c --> y", "é x ¬areference; y"),
    (None, ""), ("", ""), ("<nav>only</nav>", ""), ("<p", "<p"), ("<div class='x", "<div class='x"),
]


def test_html(spark):
    rows = [(i, h, "old") for i, (h, _) in enumerate(PAGES)]
    out = htmltext.extract(spark.createDataFrame(rows, "page_id int, html string, text string")).collect()
    assert {r["page_id"]: r["text"] for r in out} == {i: want for i, (_, want) in enumerate(PAGES)}


def test_html_is_linear_on_broken_pages():
    for page in ("<" * 100_000, '<a "' * 30_000, "<div>" * 30_000 + "x", "<p>" * 50_000 + "y", "<!--" * 30_000):
        htmltext.main_text(page)


def test_html_articles_are_a_factor_of_the_path_scores():
    prose = "<p>This is a long paragraph of the story, with commas, and with full stops. It goes on for a while.</p>"
    cards = "<article><p>A teaser, short. Read it now, or later.</p></article>" * 6
    text = htmltext.main_text(f"<body><div class=story>{prose * 7}</div>{cards}</body>")
    assert text.count("long paragraph") == 7
    links = "<ul>" + "<li><a href=x>Another link of a list</a></li>" * 20 + "</ul>"
    text = htmltext.main_text(f"<body><div><p>Outside, small.</p></div><article><h1>Heading</h1>{prose * 5}{links}</article></body>")
    assert text.startswith("Heading\n") and text.count("long paragraph") == 5 and "Another link" not in text and "Outside" not in text
    assert htmltext.main_text(f"<body>{links}<article>{prose}</article></body>").count("\n") == 0


PROSE = "<p>This is a long paragraph of the story, with commas, and with full stops. It goes on for a while.</p>"


def test_html_names_of_wrappers():
    """A word of a wrapper's class doesn't cost the article inside."""
    menu = "<ul class=nav><li><a href=x>Menu</a></li></ul>"
    for name in ("content-sidebar-wrap", "post category-social", "page-with-sidebar", "free-form text", "site search-results",
                 "l-form-content", "ad-free", "sidebar", "comments", "content form"):
        for page in (f"<body>{menu}<div class='{name}'>{PROSE * 4}</div></body>", f"<div id='{name}'><div><div>{PROSE * 4}</div></div></div>",
                     f"<div class='{name}'><article class='post'>{PROSE * 4}</article></div>"):
            text = htmltext.main_text(page)
            assert text.count("long paragraph") == 4 and "Menu" not in text
    assert htmltext.main_text(f'<article class="post tag-social category-sponsored">{PROSE * 4}</article>').count("long") == 4
    # and the same names on the smaller part are still menus, adverts and comments
    small = "<p>This is said by somebody else, at some length, and ends here.</p>"
    for name in ("sidebar", "site-ad", "comment-list", "cookie-notice", "newsletter-signup", "related", "socialShare"):
        text = htmltext.main_text(f"<body><div>{PROSE * 4}</div><div class='{name}'>{small}</div></body>")
        assert text.count("long paragraph") == 4 and "somebody" not in text
    # comments longer than the article don't become the article
    text = htmltext.main_text(f"<article>{PROSE * 3}</article><div class=comments>{small * 30}</div>")
    assert text.count("long paragraph") == 3 and "somebody" not in text
    assert htmltext.main_text(f"<div hidden>{PROSE * 9}</div><p>Seen, here.</p>") == "Seen, here."


def test_html_tables_and_headers():
    cells = "<table><tr><th>Year</th><td>1</td></tr><tr><td>1999</td><td>2</td></tr></table>"
    assert htmltext.main_text(f"<article>{PROSE * 3}{cells}{PROSE}</article>").split("\n")[3:7] == ["Year", "1", "1999", "2"]
    title = htmltext.main_text(f"<header><h1>Its title</h1><a href=x>Home</a></header><article>{PROSE * 3}</article>")
    assert title.startswith("Its title")
    for page in (f"<header><h1>Site</h1></header><article><h1>Own</h1>{PROSE * 3}</article>",
                 f"<header><h1>Site</h1><a href=a>Many links</a><a href=b>and more of them</a></header><article>{PROSE * 3}</article>",
                 f"<header>Site</header><article>{PROSE * 3}</article>"):
        assert "Site" not in htmltext.main_text(page)


def _plain_article(page):
    """Text of the article element by the standard library's parser: blocks in page order."""
    import re
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.lines = 0, [""]

        def handle_starttag(self, tag, attrs):
            if tag == "article":
                self.inside += 1
            if tag == "br" and self.inside:
                self.lines[-1] += " "
            elif tag not in htmltext.INLINE:
                self.lines.append("")

        def handle_endtag(self, tag):
            if tag not in htmltext.INLINE:
                self.lines.append("")
            self.inside -= tag == "article"

        def handle_data(self, data):
            if self.inside:
                self.lines[-1] += data
    reader = Reader()
    reader.feed(re.sub(r"(?is)<(script|style)\b.*?</\1>", "", page or ""))
    reader.close()
    return "\n".join(x for x in (" ".join(line.split()) for line in reader.lines) if x)


def test_html_all_pages_against_another_parser(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    out = {r["page_id"]: r for r in queries.op7_html_extraction(spark, sf).collect()}
    rows = pages.collect()
    assert len(out) == len(rows)
    for r in rows:
        want = _plain_article(r["html"])
        assert out[r["page_id"]]["text"] == want and out[r["page_id"]]["n_chars"] == len(want)


def test_html_generated_pages():
    """Pages without article elements, with wrappers of any name and decoys: the story, and nothing else."""
    rng = random.Random(11)
    names = ["content-sidebar-wrap", "page", "post category-social", "ad-free", "wrap", "main-content", "entry"]
    for _ in range(60):
        story = [" ".join(rng.choice(["alpha", "beta,", "gamma", "delta.", "omega"]) for _ in range(rng.randrange(25, 60))) for _ in range(rng.randrange(3, 9))]
        body = "".join(f"<p>{x}</p>" for x in story)
        for _ in range(rng.randrange(0, 3)):
            body = f'<div class="{rng.choice(names)}">{body}</div>'
        decoys = ["<nav>" + "<a href=x>Decoy</a> " * 5 + "</nav>", "<div class=ad>Decoy, buy it now.</div>", "<footer>Decoy, all of it.</footer>",
                  "<aside>Decoy, too.</aside>", "<script>var decoy = '</p>Decoy';</script>", "<div class='cookie-notice'>Decoy. We bake, we eat.</div>",
                  "<form>Decoy <input></form>", "<div id=comments><p>Decoy, said a reader.</p></div>"]
        before, after = rng.sample(decoys, 3), rng.sample(decoys, 3)
        assert htmltext.main_text("<body>" + "".join(before) + body + "".join(after) + "</body>") == "\n".join(story)


def test_html_repeated_rows_and_columns(spark):
    rows = [(1, f"<article>{PROSE}</article>", "t"), (1, f"<article>{PROSE}</article>", "t"), (2, None, "t"), (2, "", "t")]
    out = htmltext.extract(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert sorted(len(r["text"]) for r in out) == [0, 0, 100, 100] or sorted(r["text"] for r in out)[:2] == ["", ""]


def test_html_long_quoted_values():
    for q in "\"'":
        for size in (100, 9_000, 300_000):
            page = f"<div data-state={q}{'x ' * size}<p>state, class ad hidden </p> more{q}>Real.</div><p>Next, too."
            assert htmltext.main_text(page) == "Real.\nNext, too."
    assert htmltext.main_text('<p title="never closed>Text, here.</p>') == "Text, here."
    for page in ('<a b="' * 50_000, "<a b='x' " * 50_000, "<a b=\"'" * 50_000, "<a" * 100_000, "<a b='<a b=\"" * 30_000 + ">"):
        htmltext.main_text(page)


def test_html_without_article_prefers_the_dense_paths():
    page = ("<body><ul>" + "<li><a href=x>Link</a></li>" * 20 + "</ul><div>" +
            "<p>This is a long paragraph of prose, with commas, and with full stops. It goes on for a while.</p>" * 5 + "</div></body>")
    text = htmltext.main_text(page)
    assert text.count("long paragraph") == 5 and "Link" not in text


# ------------------------------------------------------------------ licences

def test_licences(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scanner = licences.Scanner(docs)
    out = {(r["doc_id"], r["place"]): r["family"] for r in scanner.scan(docs).collect()}
    lines = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "Released under the MIT License.": "mit",
             "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
             "Licensed under the Apache License, Version 2.0.": "apache-2.0", "All rights reserved.": "all-rights-reserved"}
    want = {(r["doc_id"], k): lines[line] for r in docs.collect() for k, line in enumerate(r["text"].split("\n")) if line in lines}
    assert out == want and want
    held = [(1, "Dieses Werk: licensed under the Mozilla Public License, version 2.0"), (2, None), (3, ""), (4, "the license of the public"),
            (None, "This code is released under the BSD license."), (5, "general public software version 3 permission license " * 3000)]
    found = scanner.scan(spark.createDataFrame(held, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["family"]) for r in found) == [("1", "mpl-2.0"), ("None", "bsd")]
    assert scanner.scan(docs.limit(0)).count() == 0
    # what the long words rule out couldn't be confirmed
    every = licences.paragraphs(docs.select("doc_id", "text")).transform(scanner.held_templates).filter(F.array_max("held") >= licences.HOLDS)
    assert every.filter(~licences.may_hold(F.col("line"))).count() == 0


WRAPPED = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files "
     "(the \"Software\"), to deal\nin the Software without restriction", [(0, "mit")]),
    ("x = 1\n\n# Permission is hereby granted,\n# free of charge, to any\n# person obtaining a copy\n# of this software and\n# associated documentation\n# files", [(2, "mit")]),
    ("/*\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as "
     "published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n */",
     [(1, "gpl-3.0"), (3, "gpl-3.0")]),
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following", [(0, "bsd")]),
    ("REM Licensed under the Apache\nREM License, Version 2.0", [(0, "apache-2.0")]),
    ("All rights reserved.", [(0, "all-rights-reserved")]),
    ("Some text.\nCopyright (c) 2020 Acme Inc. All rights reserved.\nMore text.", [(1, "all-rights-reserved")]),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy\n\nof this software and associated documentation files", []),
    ("All the rights\nwere reserved", []),
]


def test_wrapped_notices_and_all_rights_reserved(spark, sf):
    scanner = licences.Scanner(spark.read.parquet(f"{sf}/documents.parquet"))
    texts = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(WRAPPED)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["place"], r["family"]) for r in scanner.scan(texts).collect())
    assert got == [(k, place, family) for k, (_, want) in enumerate(WRAPPED) for place, family in want]


def test_unknown_class_and_bar_come_from_all_paragraphs(spark):
    rng = random.Random(3)
    words = "the of software may copy this license is granted apple tree river under public any and".split()
    texts = ["\n".join(" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(5)) for _ in range(900)] + [None, "", "All rights reserved."]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "river of software")], "doc_id long, text string")
    scanner = licences.Scanner(docs)
    lines = [x for t in texts[:900] for x in t.split("\n") if x]
    found = scanner.unknown(docs.filter("doc_id IS NOT NULL").select("text")).collect()
    assert sum(r["n"] for r in found) == len(lines) > 3000  # the line that holds a template isn't one of them
    grams = lambda ws: sorted(g for n in (1, 2, 3) for g in (" ".join(ws[k:k + n]) for k in range(len(ws) - n + 1)) if g in known)
    known, want, got = set(scanner.vocabulary), {}, {}
    for x in lines:
        key = tuple(grams(x.split()))
        want[key] = want.get(key, 0) + 1
    for r in found:
        key = tuple(grams(r["words"]))
        got[key] = got.get(key, 0) + r["n"]
    assert got == want
    # of 10,000 paragraphs, 10 may pass
    scored = spark.createDataFrame([(0, 0.99, 9900), (1, 0.6, 50), (2, 0.7, 42), (1, 0.8, 3), (3, 0.9, 5)], "label int, p double, n long")
    assert scanner.calibrated(scored, 10_000) == 0.7
    assert scanner.calibrated(scored.filter("p > 0.7"), 10_000) == licences.MIN_BAR


# ---------------------------------------------------------------------- urls

def test_urls_against_brute_force(spark):
    rng = random.Random(7)
    labels = ["a", "b", "com", "net", "é", "x-1"]
    hosts = [".".join(rng.choices(labels, k=rng.randint(1, 4))) for _ in range(60)]
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab", "/b/a/", "/é/"]
    rules = [(rng.choice(hosts), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(80)] + [(None, "/", "block")]
    table = [(i, f"http://{rng.choice(hosts).upper()}{rng.choice(paths)}{rng.choice(['', '?q=/a', '#x', 'zz'])}", "e") for i in range(400)]
    table += [(500, None, "e"), (501, "no scheme/", "e"), (502, "http://", "e"), (503, "x://a.com", "e"), table[0], (None, table[1][1], "e")]
    pages = spark.createDataFrame(table, "page_id long, url string, verdict string")
    out = urls.filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert out.count() == len(table)
    known = {}
    for h, p, v in rules:
        if h is not None:
            known[h, p] = "block" if "block" in (v, known.get((h, p))) else v
    for r in out.collect():
        rest = r["url"].split("://", 1)[1] if r["url"] and "://" in r["url"] else ""
        base = rest.split("?")[0].split("#")[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in base.split("/")[0])
        path = base[len(host):]
        fit = [(len(h + p), h + p, v) for (h, p), v in known.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r["host"], r["path"]) == (host, path)
        if fit:
            longest = max(f[0] for f in fit)
            assert (r["rule"], r["verdict"]) in [(f[1], f[2]) for f in fit if f[0] == longest]
        else:
            assert r["rule"] is None and r["verdict"] == "allow"
    none = urls.filter_urls(pages, spark.createDataFrame([], "host string, path string, verdict string"))
    assert {r["verdict"] for r in none.collect()} == {"allow"}
    assert urls.filter_urls(pages.limit(0), urls.rule_table(spark, queries.URL_RULES)).count() == 0


# ------------------------------------------------------------------ pipeline

def test_pipeline(spark, sf):
    from tabsmith.llm import bpe, mixing, quality, repetition, simhash
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = quality.train(docs, labels)
    scores = dict(zip(rows, quality.probability(np.array([quality.features(r["text"]) for r in rows.values()]), model)))
    kept = [i for i in rows if scores[i] >= 0.3]
    good = []
    for i in kept:
        n, _, _, _, repeat, lines, excess = repetition.measure(rows[i]["text"])
        if n >= 20 and 100 * repeat <= 30 * n and excess <= 1 and lines <= repetition.LINE_LIMIT:
            good.append(i)
    prints = {i: simhash.fingerprint(rows[i]["text"]) for i in good}
    first = []
    group = {i: i for i in good}
    for i in good:
        for j in good:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = group[i], group[j]
                group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    first = [i for i in good if group[i] == i]
    plan = mixing.plan_mix(docs.filter(F.col("doc_id").isin(first))).collect()
    want = sorted((r["doc_id"],) for r in plan for _ in range(r["copies"]))
    out = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r["doc_id"],) for r in out) == want and len(good) < len(rows) and len(first) < len(good)
    codec = bpe.codec(queries.tokenizer_file())
    for r in out[:50]:
        ids = codec.encode([rows[r["doc_id"]]["text"]])[0].tolist()
        assert r["ids"] == ids and r["decoded_sha256"] == hashlib.sha256(codec.decode(ids).encode()).hexdigest()
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_stages_on_odd_tables(spark, sf):
    odd = spark.createDataFrame([(1, None, None, None, None), (1, "", "en", "a", 0), (None, "x " * 40, "en", "a", 80),
                                 (2, "some words here " * 3, "en", None, 1), (2, "some words here " * 3, "en", None, 1)],
                                "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, sf).columns == odd.columns
            stage(spark, docs, sf).collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()


def test_columns_of_the_operators_own_names(spark):
    """Extra columns may have any name: they come through, with their values."""
    from tabsmith.llm import mixing, simhash
    names = ["h", "p", "__h", "__p", "__top", "__rate", "__n", "__hash", "__key", "__first", "__source", "rate", "id", "fp"]
    extra = [F.lit(k).alias(x) for k, x in enumerate(names)]

    def same(rows):
        return all(r[x] == k for r in rows for k, x in enumerate(names))
    pages = spark.createDataFrame([(1, "https://a.net/x"), (2, None), (2, None)], "page_id long, url string").select("*", *extra)
    out = urls.filter_urls(pages, urls.rule_table(spark, queries.URL_RULES)).collect()
    assert sorted((r["page_id"], r["verdict"]) for r in out) == [(1, "block"), (2, "allow"), (2, "allow")] and same(out)
    docs = spark.createDataFrame([(k, f"word{k % 3} " * 30, "s") for k in range(30)] + [(0, "word0 " * 30, "s"), (None, "word0 " * 30, None)],
                                 "doc_id long, text string, source string").select("*", *extra)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and same(mixed.collect())
    kept = simhash.drop_near_copies(docs)
    rows = kept.collect()
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in rows) == [0, 1, 2] and same(rows)
