"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeated rows and odd columns."""

import os
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[2])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])  # for the workers

import random
import re
import time
from collections import Counter

import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tablewright.llm import pieces, quality
from tablewright.llm.language import declared_language, fit_languages, identify_languages
from tablewright.llm.licences import document_licences, fit_licences, scan_licences
from tablewright.llm.mainline import ASIDE_NAMES, main_text, main_texts
from tablewright.llm.pseudonyms import luhn_sum, pseudonymised
from tablewright.llm.textblocks import blocks
from tablewright.llm.toxicity import fit_toxicity, folded, held_out, score_toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD_TEXTS = [None, "", " ", "\n\n", "a", "a a", "a b c\x0bd", "é è é è é è", "x" * 5000, "one two three " * 400, "same line\nsame line\n\nother\n \nsame line "]


def texts_frame(spark, texts):
    """Rows with clashing and unrelated columns; the last row comes twice."""
    rows = [(i, t, "k", float(i), None) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-1]], "doc_id long, text string, key string, `n.words` double, old int")


def brute_counts(text):
    words = WORDS.findall(text or "")
    chars = [len(w) for w in words]
    out = {"n_words": len(words), "word_chars": sum(chars), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or ""))}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    seen, again = set(), []
    for line in lines:
        if line in seen:
            again.append(line)
        seen.add(line)
    out |= {"n_lines": len(lines), "n_dup_lines": len(again), "dup_line_chars": sum(len(w) for x in again for w in WORDS.findall(x))}
    for n in (3, *quality.TOP_GRAMS, *quality.REPEATED_GRAMS):
        grams = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
        times = Counter(grams)
        if n == 3 and "n_repeat_words" not in out:
            out["n_repeat_words"] = len({i + j for i, g in enumerate(grams) if times[g] > 1 for j in range(n)})
        elif n in quality.TOP_GRAMS:
            out[f"top_{n}gram_chars"] = max((k * sum(map(len, g)) for g, k in times.items() if k > 1), default=0)
        else:
            first, inside = set(), set()
            for i, g in enumerate(grams):
                if g in first:
                    inside |= set(range(i, i + n))
                first.add(g)
            out[f"dup_{n}gram_chars"] = sum(chars[i] for i in inside)
    return out


def test_quality_counts_match_brute_force(spark):
    rng = random.Random(3)
    texts = ODD_TEXTS + [" ".join(rng.choices("ab cd ef gh é# the of".split(), k=rng.randint(1, 300))) + rng.choice(["", "\n", "\t x"]) for _ in range(40)]
    got = quality.verdicts(quality.repetition_counts(texts_frame(spark, texts))).collect()
    assert len(got) == len(texts) + 1
    for row in got:
        want = brute_counts(texts[row.doc_id])
        assert {c: row[c] for c in want} == want, texts[row.doc_id]
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert row.base_failed == failed and not (failed and row.kept)
    assert quality.repetition_counts(texts_frame(spark, ["x"]).limit(0)).count() == 0


def test_blocks_keep_texts_apart():
    rows = 0
    for first, block in blocks(pa.array([None, "a b", "", "b a", "x" * 3_000_000, "tail"])):
        starts, ends, of = block.words()
        assert first == rows
        rows += block.n
    assert rows == 6


def test_main_text():
    assert main_text(None) == "" and main_text("") == "" and main_text("plain  text") == "plain text"
    page = ("<html><head><title>T</title></head><body class='has-sidebar'><nav><a href=/>Home</a></nav><article><header><h1>A &amp; B</h1></header>"
            "<p>First\n  <b>bold</b>&nbsp;text<br>next<p class='ad'>Buy!<p>x<script>var t='</p>';</script></p>"
            "<section id=comments><p>Nice one</p></section><footer>Share</footer></article><footer>&copy;</footer>")
    assert main_text(page) == "A & B\nFirst bold text\nnext\nx"
    soup = ("<div id='cookie-notice'>We use cookies <a>ok</a></div><div><a>Home</a> <a>News</a></div><div><h2>Story</h2>A first paragraph with "
            "enough words to be a surge of text in this page, really.<p>Short end.</div><form>Name <input></form>")
    assert main_text(soup).split("\n") == ["Story", "A first paragraph with enough words to be a surge of text in this page, really.", "Short end."]
    assert main_text("<a \"" * 20_000 + "<!--") is not None


def test_main_text_weighs_marked_and_unmarked_blocks():
    body = "The body of this page stands in a plain block of the main part and is long enough to be a surge of text."
    cards = "<article><h3><a href=/1>Card one</a></h3></article><article><h3><a href=/2>Card two</a></h3></article>"
    assert main_text(f"<main><div><p>{body}<p>Short end.</div>{cards}</main>") == body + "\nShort end."
    assert main_text(f"<div><p>{body}</div><article><p>teaser</article>").split("\n")[0] == body
    assert main_text(f"<div>Tag line</div><article><h1><a href=/>Story</a></h1><p>{body}</article><div>Imprint</div>") == "Story\n" + body
    assert main_text(f"<article><p>{body}</article><nav>x</nav><article><p>x, <a>more links</a></article>") == body
    assert main_text("<main><p>Only a short notice.</main><div>Imprint</div>") == "Only a short notice."


def test_main_text_reads_long_attributes():
    long = "x<i> &gt; " * 1_000
    for quote in "'\"":
        value = f"data-x={quote}{long}{quote}"
        assert main_text(f"<p>before</p><script {value}>code()</script><p>after") == "before\nafter"
        assert main_text(f"<article><p>before</p><aside {value}>aside</aside><div class=ad {value}>Buy!</div><p>after</article>") == "before\nafter"
        assert main_text(f"<article {value}><p>Text of the article.</article><p>Imprint") == "Text of the article."
        assert main_text(f"<div><article><p>One line of text<div {value}>two</div><p>three</article></div>") == "One line of text\ntwo\nthree"
    assert main_text(f"<p>before</p><div data-x='<b class=\"ad\"> {long}'>text</div>") == "before\ntext"
    for broken in ("<a \"", "<a \"'", "<a x='\">", "<a \"<b' ", "<a '", "<a x=y "):  # none may take quadratic time
        start = time.perf_counter()
        main_text(broken * 100_000 + "'" + "<a \"" + "<p x" * 100_000)
        assert time.perf_counter() - start < 20


def test_main_text_inside_of_forms_and_wrappers():
    body = "Once upon a time there was a long paragraph of text that goes on and on about the old harbour of the town, and its people."
    page = "<nav><a href=/>Home</a></nav>{}<footer>Imprint</footer>"
    marked, plain = f"<article><h1>T</h1><p>{body}</article>", f"<div class=content><h1>T</h1><p>{body}</div>"
    for text in (marked, plain):
        for frame in ("<form id=f>{}</form>", "<div class='site-wrap'>{}</div>", "<form><div class='header-fixed'>{}</div></form>"):
            assert main_text(frame.format(page.format(text))) == "T\n" + body
    for name in sorted(ASIDE_NAMES):
        assert main_text(f"<div class='{name}-fixed'><article><p>{body}</article></div>") == body
        assert main_text(f"<div class='{name}'><p>{body}</div>") == ""
    assert main_text(f"<form><p>{body}</form>") == "" and main_text(f"<nav>{body}</nav><footer>{body}</footer>") == ""
    comments = f"<div id=comments><article><p>{body}</article></div>"
    assert main_text(f"<main><p>Only short.</main>{comments}") == "Only short."
    assert main_text(f"<form>{page.format(marked)}<div id=comments><article><p>Nice.</article></div></form>") == "T\n" + body
    for broken in ("<form><article>x", "<form class=ad><h1>y", "<div class=ad>", "</form><nav>x", "<form><nav>x</div>"):
        main_text(broken * 20_000)  # ends soon


def test_declared_language():
    cases = {"<!-- <html lang=de> --><html lang=fr>": "fr", "<html data-lang='de' lang='fr'>": "fr", "<html lang='en_US'>": "en",
             "<html data-x='a>b' lang=\"pt-BR\">": "pt", "<html x='" + "x" * 5000 + "' lang=it>": "it", "": "", "<html xml:lang=cs>": "cs",
             "<head><meta http-equiv='Content-Language' content='sv'>": "sv", "<meta content='nl' http-equiv=content-language>": "nl",
             "<html><body><p>x<html lang=de>": "", "<html lang=''><meta name=content-language content=de>": "", "<html lang=english>": ""}
    assert {page: declared_language(page) for page in cases} == cases


def test_main_texts_rows(spark):
    df = spark.createDataFrame([(1, None, None), (None, "u", "<p>a</p>"), (1, "u", "<article>é x</article>")], "page_id long, url string, html string")
    got = main_texts(df.withColumn("text", F.lit("clash"))).collect()
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in got] == [(1, None, "", 0), (None, "u", "a", 1), (1, "u", "é x", 3)]
    assert main_texts(df.limit(0)).count() == 0


def test_encoding_equals_the_vocabulary_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.VOCABULARY)
    rng = random.Random(5)
    texts = ODD_TEXTS + ["\x00", "▁ a▁b", "日本𝄞", " " * 90, "=" * 70 + "---", "a\tb\r\nc", "🙂🙂", "ab" * 2000]
    texts += ["".join(rng.choices("abeinrst ▁\néñ日", k=rng.randint(1, 200))) for _ in range(100)]
    got = {r.doc_id: r for r in pieces.encode_texts(texts_frame(spark, texts), check=True).collect()}
    for i, text in enumerate(texts):
        assert list(got[i].ids) == library.encode(text or "") and got[i].round_trip
    back = pieces.decode_ids(pieces.encode_texts(texts_frame(spark, texts))).collect()
    assert len(back) == len(texts) + 1 and all(r.decoded == (texts[r.doc_id] or "").replace("▁", " ") for r in back)
    odd = spark.createDataFrame([(1, [1, 259, None, -4, 10**8]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert [r.decoded for r in pieces.decode_ids(odd).orderBy("doc_id").collect()] == [" ", "", ""]


PERSONAL = """Mail ann.b-19@mail5.example.com or x@y.org, card 4785380592391139, 4111 1111 1111 1111, not 4111111111111112. Call +1 (743) 555-3824,
743-555-3824, (743) 555-3824, +49 30 123 4567. SSN 123-45-6789, not 000-12-3456; host 152.143.123.131, not 999.1.1.1. IBAN DE89 3704 0044 0532 0130 00,
GB82WEST12345698765432. Born 2020-02-29, 29.02.2020, 29 February 2020, not 2021-02-30. token = "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e" password=208f79cc07c0ef31d7"""


def test_pseudonyms_of_long_and_mixed_credentials(spark):
    """Labels in any case, credentials up to the next white space or quote, values of any length, letters of any script."""
    values = ["correcthorse", "Tr0ub4dor&3xyz", "sk_live_0a1B2c3D4e", "abcd-efgh-ijkl", "x9" * 300]
    texts = [f"{label}{v} end" for label in ("Password: ", "PASSWORD=", "api_key=", 'Token: "') for v in values]
    texts += ["a" * 90 + "1@example.org wrote", "mail jörg.müller@example.de now", "f0" * 64 + " is a digest", "no secret here: at all"]
    out = {r.doc_id: r.text for r in pseudonymised(texts_frame(spark, texts)).collect()}
    for i, text in enumerate(texts[:-1]):
        assert out[i] != text and len(out[i]) == len(text)
        inside = text.replace('"', " ").split(" ")[-2] if i < 20 else max(text.split(" "), key=len)
        assert inside.split("=")[-1] not in out[i]
    assert "Tr0ub4dor&" not in out[1] and out[1].endswith(" end") and "&" in out[1]
    assert out[21].split(" ")[1].endswith("@example.de") and out[21].split(" ")[1][1] == "ö" and not out[21].startswith("mail jörg")
    assert out[len(texts) - 1] == texts[-1]
    linked = {out[i].split("=")[-1] for i in range(len(texts)) if texts[i].endswith("=correcthorse end")}
    assert len(linked) == 1
    back = {r.doc_id: r.text for r in pseudonymised(pseudonymised(texts_frame(spark, texts)), back=True).collect()}
    assert back == dict(enumerate(texts))


def test_pseudonyms_keep_format_links_and_come_back(spark):
    texts = ODD_TEXTS + [PERSONAL, "again 4785380592391139 and ann.b-19@mail5.example.com, 2020-02-29", "1.2.3.4", " 1.2.3.4 ", "no number"]
    df = texts_frame(spark, texts)
    out = pseudonymised(df, count="n")
    assert out.columns == [*df.columns, "n"]
    rows = {r.doc_id: r for r in out.collect()}
    new, other = rows[len(ODD_TEXTS)].text, rows[len(ODD_TEXTS) + 1].text
    for gone in ("ann.b-19@", "x@y", "4785380592391139", "4111 1111 1111 1111", "743", "123 4567", "123-45-6789", "152.143", "3704 0044", "WEST123",
                 "2020-02-29", "29.02.2020", "29 February", "2321bac4", "208f79cc"):
        assert gone not in new
    for stays in ("4111111111111112", "000-12-3456", "999.1.1.1", "2021-02-30", "+1 (", "+49 "):
        assert stays in new
    shape = lambda t: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "0", t)))
    card = re.search(r"card (\d{16})", new)[1]
    assert card in other and re.search(r"Mail (\S+@\S+) ", new)[1] in other and shape(card) == "0" * 16
    digits = [int(c) for c in card[::-1]]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert spark.range(1).select(luhn_sum(F.lit(card))).first()[0] % 10 == 0
    iso, dotted = re.search(r"Born (\d{4})-(\d\d)-(\d\d), (\d\d)\.(\d\d)\.(\d{4})", new).group(1, 2, 3), re.search(r"(\d\d)\.(\d\d)\.(\d{4}), ", new).group(3, 2, 1)
    assert iso == dotted
    back = {r.doc_id: r.text for r in pseudonymised(out, back=True).collect()}
    assert back == dict(enumerate(texts))
    assert pseudonymised(df, key="another").filter(F.col("doc_id") == len(ODD_TEXTS)).first().text != new
    assert pseudonymised(df.limit(0)).count() == 0


def test_credentials_in_texts_without_digits(spark):
    texts = ["password: correcthorse", "password: correcthorse 7", "token:\tcorrecthorse", "secret =\n\"correcthorse\"", "api_key='correcthorse'",
             "token:\tabcd1234", "secret:\nabcd1234", "a password or token, but correcthorse is none"]
    df = texts_frame(spark, texts)
    out = pseudonymised(df)
    new = {r.doc_id: r.text for r in out.collect()}
    assert all("correcthorse" not in new[i] and "abcd1234" not in new[i] for i in range(7)) and new[7] == texts[7]
    assert len({re.findall("[a-z]{12}", new[i])[0] for i in range(5)}) == 1 and len({re.split(r"\s", new[i])[1] for i in (5, 6)}) == 1
    assert {r.doc_id: r.text for r in pseudonymised(out, back=True).collect()} == dict(enumerate(texts))


def test_all_digits_of_long_ibans_change(spark):
    numbers = ["PL61109010140000071219812874", "HU42117730161111101800000000", "ES9121000418450200051332", "FR1420041010050500013M02606", "IT60X0542811101000000123456",
               "MT84MALT011000012345MTLCAST001S", "DE89370400440532013000"]
    tails = [f"PL{98 - int(f'1090101400000712198{n:05d}252100') % 97:02d}1090101400000712198{n:05d}" for n in range(40)]  # differ in the last digits only
    texts = [*numbers, *tails, "PL61 1090 1014 0000 0712 1981 2874"]
    out = pseudonymised(texts_frame(spark, texts))
    new = {r.doc_id: r.text for r in out.collect()}
    value = lambda t: int("".join(str(int(c, 36)) for c in t[4:] + t[:4]))
    for i, text in enumerate(numbers):
        assert value(new[i]) % 97 == 1 and new[i] != text and re.sub("[0-9]", "0", new[i]) == re.sub("[0-9]", "0", text)
    assert new[len(texts) - 1].replace(" ", "") == new[0] and len(set(new.values())) == len(texts)
    for at in range(18, 24):  # no digit of the tail is copied
        assert any(new[len(numbers) + k][4 + at] != t[4 + at] for k, t in enumerate(tails)), at
    assert {r.doc_id: r.text for r in pseudonymised(out, back=True).collect()} == dict(enumerate(texts))


@pytest.fixture(scope="module")
def licence_model(spark):
    return fit_licences(spark)


def test_licences(spark, licence_model):
    lines = {"Released under the MIT License.": "MIT", "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0": "Apache-2.0",
             "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
             "Licensed under CC BY-SA 4.0": "CC-BY-SA", "(c) 2019 Foo Inc. All rights reserved.": "proprietary"}
    clean = ["My driving licence expired at the public office", "copyright law is fun", "Licensed under a strange custom deal of ours"]
    texts = [None, "", *clean, *[f"some words\n{line} erthe onthan reth ingly\nend" for line in lines], "\n".join(lines)]
    df = texts_frame(spark, texts)
    got = {r.doc_id: r for r in document_licences(df, licence_model).collect()}
    assert len(got) == len(texts)
    assert [got[i].licences for i in range(2 + len(clean))] == [""] * (2 + len(clean))
    assert [got[2 + len(clean) + i].licences for i in range(len(lines))] == list(lines.values())
    last = len(texts) - 1
    assert got[last].licences == " ".join(sorted(lines.values())) and got[last].n_notices in (len(lines), 2 * len(lines))
    assert scan_licences(df.limit(0), licence_model).count() == 0 and document_licences(df.limit(0), licence_model).count() == 0


def test_short_and_wrapped_notices(spark, licence_model):
    lines = {"MIT License": "MIT", "License: MIT": "MIT", "Apache License": "Apache-2.0", "BSD license.": "BSD", "(GPLv3 License)": "GPL-3.0", "Public domain": "public-domain",
             "to any person obtaining a copy of this software and associated documentation files": "MIT",
             "you may not use this file except in compliance with the": "Apache-2.0", "source and binary forms, with or without modification, are": "BSD"}
    others = ["Apache", "License", "the license", "Table reserved", "obtaining files", "The software", "license fees", "under the terms of the GNU General Public License as published by"]
    texts = [*lines, *others, "words\n\n" + "\n".join(lines)]
    got = {r.doc_id: r for r in document_licences(texts_frame(spark, texts), licence_model).collect()}
    assert [got[i].licences for i in range(len(texts))] == [*lines.values(), *[""] * len(others), " ".join(sorted(set(lines.values())))]
    assert {r.paragraph for r in scan_licences(texts_frame(spark, texts), licence_model).filter("confirmed").collect()} == set(lines)


def test_toxicity(spark):
    rng = random.Random(7)
    common = ["".join(rng.choices("aeioubdgkm", k=5)) for _ in range(60)]
    rows = []
    for i in range(900):
        bad = i % 9 == 0
        words = rng.choices(common, k=rng.randint(20, 80)) + (rng.choices(["wretch", "scoundrel", "villain"], k=4) if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(bad)))
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = labelled.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int"))
    model = fit_toxicity(labelled.withColumn("key", F.lit("x")), labels.filter(~held_out()))
    held = score_toxicity(labelled, model, keep=("doc_id", "toxic")).filter(held_out()).collect()
    assert held and all(r.predicted == r.toxic and 0 <= r.score <= 1 for r in held)
    plain = " ".join(common[:30])
    tries = [None, "", plain, plain + " scoundreI sc0undrel ѕcoundrel villain", plain + " a VILLAIN, wretch! Wr3tch"]
    got = {r.doc_id: r.predicted for r in score_toxicity(texts_frame(spark, tries), model).collect()}
    assert [got[i] for i in range(5)] == [0, 0, 0, 1, 1]
    model.exceptions = ("villain of the play",)
    phrase = spark.createDataFrame([(1, " ".join(common[:20]) + " the villain of the play")], "doc_id long, text string")
    assert score_toxicity(phrase, model).first().predicted == 0
    assert folded("Sc0uNdrél") == folded("scoundrel")
    few = fit_toxicity(labelled, labels.filter("doc_id < 12"))  # too few toxic texts to learn a word from
    assert not few.weights and score_toxicity(labelled, few).filter("predicted = 1").count() == 0
    empty = fit_toxicity(labelled, labels.limit(0))
    assert score_toxicity(labelled.limit(3), empty).agg(F.max("score")).first()[0] < 0.01 and score_toxicity(labelled.limit(0), empty).count() == 0


def test_languages(spark):
    rng = random.Random(9)
    kinds = {"xx": "ab ba abba bab".split(), "yy": "ok ko okko kok".split()}
    texts = spark.createDataFrame([(i, " ".join(rng.choices(kinds[k], k=30)), k) for i, k in enumerate(["xx", "yy"] * 40)] + [(99, None, "xx"), (98, "ab", None)],
                                  "doc_id long, text string, lang string")
    model = fit_languages(texts)
    assert model.languages == ["xx", "yy"]
    rows = [(i, f"http://www.site{k}.example.{k}/p", f"<html lang='{k}'><body><p>{' '.join(rng.choices(kinds[k], k=20))}</p>", k) for i, k in enumerate(["xx", "yy"] * 30)]
    # no text: declared language and host decide; wrong declaration: the text does
    rows += [(100, "http://www.sitexx.example.xx/q", "<html><body></body>", "xx"), (101, None, "<html lang=yy></html>", "yy"),
             (102, "http://[bad", f"<html lang=yy><p>{'abba bab ' * 20}", "xx"), (103, None, None, None), (None, "", "", None)]
    pages = spark.createDataFrame(rows + [rows[0]], "page_id long, url string, html string, want string").withColumn("host", F.lit(1))
    got = identify_languages(pages, model).collect()
    assert len(got) == len(rows) + 1
    want = {r[0]: r[3] for r in rows}
    assert all(r.language == want[r.page_id] for r in got if want[r.page_id])
    assert identify_languages(pages.limit(0), model).count() == 0
    assert identify_languages(pages, fit_languages(texts.limit(0))).filter("language is not null").count() == 0
