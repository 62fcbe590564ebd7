"""Pages, quality rules, classifiers, languages and secrets."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import language_id, perplexity_rules, quality_knn, secret_scan, site_style
from siltstone.llm import queries as llm_queries

DATA = "/root/testdata/sf0.01"


def test_page():
    html = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body><header>top</header><nav><ul><li>menu</ul></nav>
    <!-- <p>hidden</p> --><div class="cookie-notice">cookies</div><article><header><h1>Head &amp; more</h1></header><p>One <b>two
    three<br>four<p>Five&nbsp;&lt;x&gt; <script>var a = "</p>";</script>six <img alt=">" src=x> 1 < 2</p><ul><li>a<li>b</ul><form>form</form><div class="ad">buy</div>
    <table><tr><td>c1<td>c2</table><section class="comments"><p>me too</p></section></article><aside>side</aside><footer>&copy; foot</footer>"""
    assert site_style.Page(html).text() == "Head & more\n\nOne two three four\n\nFive <x> six 1 < 2\n\na\n\nb\n\nc1\n\nc2"
    nested = "<main><article class='post share'><p>Story</p><article class='comment'><p>Nice</p></article></article></main>"
    assert site_style.Page(nested).text() == "Story"
    for broken in (None, "", "<", "</p>", "<p", "a<b", "<script>x", "<!-- x", "plain & text"):
        site_style.Page(broken).text()
    assert site_style.Page("just text").text() == "just text"


def test_site_tree_cuts_templates(spark):
    page = lambda i: f"<html><body><div class='box'><span>Part of Example Group</span><p>All rights of this site are held.</p></div><div class='story'><h1>Title {i}</h1><p>{'word%d ' % i * 5}</p></div></body></html>"
    rows = [(i, f"http://one.example/{i}", page(i), "x") for i in range(30)] + [(100, "http://two.example/", page(1), "x"), (101, None, page(2), "x"), (102, "http://one.example/n", None, "x"), (103, "", "", "x")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    for limit in (1000, 0):  # broadcast, and joined
        got = {r.page_id: r for r in site_style.extract_pages(d, broadcast_branches=limit).collect()}
        assert got[3].text == "Title 3\n\n" + ("word3 " * 5).strip() and got[3].n_chars == len(got[3].text)
        assert "rights" in got[100].text and "rights" in got[101].text
        assert got[102].text == got[103].text == ""
    assert site_style.extract_pages(d.limit(0)).count() == 0


def test_base_counts():
    text = "a b c\n\na b c\n \nx # $ a b c"
    n, chars, symbols, dup, repeat = perplexity_rules.base_counts(text)
    assert (n, chars, symbols, dup, repeat) == (12, 12, 2, 1, 9)
    assert perplexity_rules.base_counts(None) == (0, 0, 0, 0, 0)
    assert perplexity_rules.base_counts("é　ü x")[:2] == (2, 4)


def kneser_ney(texts):
    """Plain dictionaries: modified Kneser-Ney of five bytes over (group, text); scores a text by a group's model."""
    order = perplexity_rules.ORDER
    grams = lambda t: [(b"\0" * (order - 1) + t)[i : i + order] for i in range(len(t))]
    counts = {order: Counter((f, g) for f, t in texts for g in grams(t))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter((f, g[1:]) for f, g in counts[n + 1])
    discount = {}
    for n in counts:
        c = Counter(min(v, 5) for v in counts[n].values())
        y = c[1] / (c[1] + 2 * c[2]) if c[1] + 2 * c[2] else 0.5
        discount[n] = [max(0.01, min(i - 0.01, i - (i + 1) * y * c[i + 1] / c[i] if c[i + 1] and c[i] else 0.5 * i)) for i in (1, 2, 3)]
    total, held = defaultdict(float), defaultdict(float)
    for n in counts:
        for (f, g), c in counts[n].items():
            total[f, g[:-1], n] += c
            held[f, g[:-1], n] += discount[n][min(c, 3) - 1]

    def p(f, g):
        n = len(g)
        lower = p(f, g[1:]) if n > 1 else 1 / 256
        ctx = (f, g[:-1], n)
        if ctx not in total:
            return lower
        c = counts[n].get((f, g), 0)
        return max(c - (discount[n][min(c, 3) - 1] if c else 0), 0) / total[ctx] + held[ctx] / total[ctx] * lower

    return lambda f, t: sum(math.log(p(f, g)) for g in grams(t))


def test_perplexity_equals_plain_model(spark):
    texts = [*(f"the cat sat on the mat {i}" for i in range(4)), "the dog sat on the log", "a cat and a dog", "zzz qqq", "ein Hund", "the cat sat on the mat 1"]
    langs = ["en"] * 7 + ["de", "en"]
    d = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(zip(texts, langs, strict=True))] + [(99, "", "en"), (98, None, None)], "doc_id long, text string, lang string")
    rows = perplexity_rules.named(d, "doc_id", "text", "lang")
    model, table = perplexity_rules.fit(rows, 10**6)
    assert table is None
    # discounts are of all languages and folds together, all else of the other fold of a text's language
    data = [t.encode() for t in texts]
    fold = [perplexity_rules.fold_key(x, t) for x, t in zip(langs, data, strict=True)]
    assert len(set(fold[:7])) == 2
    plain = kneser_ney([(f, t) for f, t in zip(fold, data, strict=True)])
    for found in (perplexity_rules.scored(rows, model), perplexity_rules.scored_by_join(rows, perplexity_rules.fit(rows, 0)[1])):
        got = {r.doc_id: r.logp for r in found.collect()}
        assert got.pop(99) == got.pop(98) == 0
        for i, logp in got.items():
            assert logp == pytest.approx(plain(fold[i] ^ 1, data[i]), rel=1e-5)


def test_rules_reject_outliers_and_keep_the_rest(spark):
    import random

    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("aeionrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(120)), "en" if i % 2 else None) for i in range(120)]
    rows += [(900, "".join(chr(rng.randint(33, 126)) if rng.random() < 0.8 else " " for _ in range(900)), "en"), (901, None, "en"), (902, "", None), (903, "few words", "en"), (904, "a b c " * 60, "en"), (905, rows[3][1], "en"), (905, rows[3][1], "en")]
    d = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, lang string, kept boolean")
    got = {r.doc_id: r for r in perplexity_rules.judge(d).collect()}
    assert not got[900].kept and not got[900].base_failed
    assert all(not got[i].kept and got[i].base_failed for i in (901, 902, 903, 904))
    assert all(got[i].kept for i in (*range(120), 905))
    kept = perplexity_rules.filter_documents(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted([*range(120), 905, 905])
    joined = perplexity_rules.judge(d, broadcast_entries=0).select("doc_id", "kept").collect()
    assert sorted(map(tuple, joined)) == sorted((r.doc_id, r.kept) for r in perplexity_rules.judge(d).collect())
    assert perplexity_rules.judge(d.limit(0)).count() == 0 and perplexity_rules.filter_documents(d.limit(0)).count() == 0


def test_quality(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    got = llm_queries.op7_quality_knn(spark, DATA).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert len(held) > 40 and np.mean([p == y for p, y in held]) > 0.93
    assert all(p == 1 for p, y in held if y == 1)


def test_quality_odd_rows(spark):
    d = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Words of prose. " * 3000, "x"), (3, "Words of prose. " * 3000, "x"), (None, "a | b | c", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (2, 0, 0), (2, None, 0), (None, 1, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")
    space = quality_knn.fit_space(d, labels)
    got = sorted((r.doc_id or -1, r.score) for r in quality_knn.score_documents(d, space).collect())
    assert len(got) == 5 and all(0 <= s <= 1 for _, s in got) and got[-1][1] > 0.5
    assert quality_knn.fit_space(d, labels.limit(0)) is None
    assert {r.score for r in quality_knn.score_documents(d, None).collect()} == {1.0}
    assert quality_knn.score_documents(d.limit(0), space).count() == 0
    assert quality_knn.filter_documents(d, space).columns == d.columns and quality_knn.filter_documents(d, None).count() == 5


def test_language(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()}
    got = llm_queries.op8_language_id(spark, DATA).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out]
    assert len(held) > 200 and np.mean(held) > 0.97


def test_language_odd_rows(spark):
    d = spark.createDataFrame([(1, "the and of it", "en", 0), (2, "le la et du", "fr", 0), (3, None, "fr", 0), (4, "123 !?", "en", 0), (5, "the and of " * 5000, None, 0), (5, "the and", None, 0)], "doc_id long, text string, lang string, score int")
    dictionaries = language_id.fit_dictionaries(d)
    assert list(dictionaries) == ["en", "fr"]
    got = sorted((r.doc_id, r.lang_pred) for r in language_id.identify(d, dictionaries).collect())
    assert got == [(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "en"), (5, "en")]
    assert {r.lang_pred for r in language_id.identify(d, {}).collect()} == {"und"}
    assert language_id.identify(d.limit(0), dictionaries).count() == 0 and language_id.fit_dictionaries(d.limit(0)) == {}


BASE = [("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6), ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24)]


def base_by_hand(text):
    spans = [(m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(BASE) for m in re.finditer(p, text or "", re.ASCII) if ok(m)]
    return [(name, a, b) for a, _, b, name in sorted(spans)]


def test_secrets(spark):
    example, live = "abcdef0123456789abcdef0123456789", "Zx9kQ2mN7pL4vB8tR1sW6yH3"
    rows = [(i, f"é😀 token = '{example}' and api_key:abc Password: hunter2xx AKIA{'A1' * 9}", f"src{i}") for i in range(6)]
    rows += [(20, f"see {live} here", "src1"), (21, f"see {live} here", "src1"), (22, None, "src2"), (23, "", None), (24, f"TOKEN={'a' * 200_000}", "src2"), (20, f"see {live} here", "src1")]
    rows += [(30 + i, "Common9Widely8Copied7Example6", f"src{i}") for i in range(5)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, spans string")
    got = defaultdict(list)
    for r in secret_scan.find_secrets(d).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, text, _ in rows:
        base = base_by_hand(text)
        said = ",".join(f"{n}:{a}:{b}" for n, a, b in base)
        for r in got[i]:
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(n == k for n, *_ in base) for k in ("assign", "access", "hex"))
            assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
            assert set(said.split(",")) - {""} <= set(r.spans.split(","))
    assert got[20][0].spans == f"live:4:{4 + len(live)}" and len(got[20]) == 2 and got[30][0].spans == ""
    assert got[0][0].n_example >= 3 and got[20][0].n_live == 1
    clean = secret_scan.redact_documents(d.withColumnRenamed("spans", "n"), chars_col=None)
    assert clean.count() == len(rows)
    text = {r.doc_id: r.text for r in clean.collect()}
    assert text[20] == "see [SECRET] here" and live not in text[21] and example not in text[0] and "hunter2" not in text[0] and text[22] is None and text[30].startswith("Common9")
    assert secret_scan.find_secrets(d.limit(0)).count() == 0 and secret_scan.redact_documents(d.limit(0)).count() == 0


def test_word_surprise_equals_plain_counts(spark):
    import random

    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "of", "é", "an", "Cat,", f"w{rng.randint(0, 40)}"]) for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None, " \n ", "the  of\tan\n\nthe\x0bof"]
    rows = [(i, t, ("en", "de", None)[i % 3]) for i, t in enumerate(texts)] + [(999, "alone in its language", "xx")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    for block in (10**6, 50):  # also in several passes
        words = perplexity_rules.fit_words(d, block).value
        for lang in {r[2] for r in rows}:
            own = [(r[1] or "").encode().split() for r in rows if r[2] == lang]
            with_words = [w for w in own if w]
            one = Counter(g for w in with_words for g in set(w))
            two = Counter(g for w in with_words for g in set(zip([b"", *w[:-1]], w, strict=True)))
            n = max(len(with_words) - 1, 1)
            share = lambda c: s if (s := max(c - 1, 0) / n) >= perplexity_rules.FLOOR else 0.0
            for w, text in zip(own, [(r[1] or "").encode() for r in rows if r[2] == lang], strict=True):
                got = words.surprise([text], [perplexity_rules.language_key(lang)])[0]
                if not w:
                    assert np.isnan(got)
                    continue
                p = [0.5 * share(one[b]) + 0.5 * min(1, share(two[a, b]) / max(share(one[a]) if a else 1.0, perplexity_rules.FLOOR)) for a, b in zip([b"", *w[:-1]], w, strict=True)]
                assert got == pytest.approx(-np.mean([math.log(max(x, perplexity_rules.FLOOR)) for x in p]), abs=1e-9)


def test_rules_reject_what_is_labelled_bad(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    got = llm_queries.op5_perplexity_rules(spark, folder).where("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")).collect()
    rates = {r.quality: r.kept for r in got}
    assert rates[1] > 0.995 and rates[0] < 0.05


def test_wrong_and_mixed_languages_are_not_surprising(spark):
    import random

    rng = random.Random(7)
    say = {lang: lambda lang=lang: " ".join(f"{lang}{min(rng.randint(0, 30), rng.randint(0, 30))}" for _ in range(60)) for lang in ("en", "de")}
    rows = [(say[lang](), lang) for lang in ("en", "de") for _ in range(150)]
    rows += [(say["de"](), "en"), (say["en"]() + " " + say["de"](), "en"), (" ".join(f"x{i}" for i in range(60)), "en")]
    words = perplexity_rules.fit_words(spark.createDataFrame(rows, "text string, lang string")).value
    own, mixture = words.surprises([t.encode() for t, _ in rows], [perplexity_rules.language_key(x) for _, x in rows])
    assert (mixture <= own).all()
    usual = own[:300].max()
    assert (own[300:] > usual).all()
    assert (mixture[300:302] <= usual).all() and mixture[302] > usual  # made-up words stay surprising

    # the shares of single words by hand: two languages that share a word, the text's own count left out
    rows = [("a b", "en"), ("a", "en"), ("b", "en"), ("b", "de"), ("b c", "de"), ("c", "xx")]
    words = perplexity_rules.fit_words(spark.createDataFrame(rows, "text string, lang string")).value
    key = perplexity_rules.language_key
    _, word, _, _ = perplexity_rules.word_keys([b"a b c"], [key("en")])
    assert words.elsewhere(word, np.full(3, key("en"))).tolist() == [0.0, 1.0, 0.0]  # "c" is in one text only of each language
    _, word, _, _ = perplexity_rules.word_keys([b"a b c"], [key("de")])
    assert words.elsewhere(word, np.full(3, key("de"))).tolist() == pytest.approx([2 / 3, 2 / 3, 0.0])


def test_word_order_counts(spark):
    import random

    rng = random.Random(5)
    sentences = ["the old man went down to the sea", "a dog ran after him for an hour", "we saw the ship far out at noon", "it was late when she came home"]
    texts = [" ".join(rng.choice(sentences) for _ in range(12)) for _ in range(100)]
    words = perplexity_rules.fit_words(spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")).value
    shuffled = texts[0].split()
    rng.shuffle(shuffled)
    right, wrong = words.surprise([texts[0].encode(), " ".join(shuffled).encode()], [perplexity_rules.language_key("en")] * 2)
    assert right < 0.4 * wrong


def test_ownership_separates_examples_from_live(spark):
    """Planted values: in repositories of many owners, in many repositories of one owner, in one repository of many owners, and predictable ones."""
    values = {"copied": "Qz81kLm2Xv9TtR44bNc7", "own": "Hs72Jk1lPq0ZxWv38mTy", "shared": "Ua55Rt9cVb2NmQw81xLe"}
    rows = [(i, f"api_key = {values['copied']}", f"o{i}", f"r{i}") for i in range(6)]
    rows += [(10 + i, f"api_key = {values['own']}", "o1", f"r{i}") for i in range(6)]
    rows += [(20 + i, f"api_key = {values['shared']}", f"o{i}", "r9") for i in range(6)]
    rows += [(30, "token = aaaaaaaa", "o1", "r1"), (31, f"token: 0123456789abcdef0123456789abcdef {values['own']}", None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, repo string")
    got = {r.doc_id: r for r in secret_scan.find_secrets(d, repo_col="repo").collect()}
    for i in range(6):
        assert (got[i].spans, got[i].n_live, got[i].n_example) == ("assign:0:30", 0, 1)
        assert got[10 + i].spans == got[20 + i].spans == "assign:0:30,live:10:30"
    assert (got[30].spans, got[30].n_live, got[30].n_example) == ("assign:0:16", 0, 0)
    assert got[31].spans == "assign:0:39,hex:7:39,live:7:39,live:40:60"
    seen = secret_scan.ownership(secret_scan.scan(d, "source", "repo"))
    by_hash = {r["hash"]: (r.n_owners, r.n_repos, r.n_uses, r.example) for r in seen.collect()}
    assert [by_hash[secret_scan.value_hash(values[k])] for k in ("copied", "own", "shared")] == [(6, 6, 6, True), (2, 7, 7, False), (6, 1, 6, False)]


def test_ownership_counts_of_the_corpus_decide(spark):
    """A value of three owners is an example where hardly any other leaves its owner, not where many do."""
    least = secret_scan.owners_of_examples
    assert [least(c) for c in ({1: 120, 2: 10, 3: 1}, {1: 99, 2: 1}, {1: 5, 3: 5}, {4: 9}, {1: 90, 3: 10}, {}, {1: 1})] == [3, 2, 4, 4, 4, 2, 2]
    rare = "Qz81kLm2Xv9TtR44bNc7"
    rows = [(100 + i, f"key {hashlib.sha256(str(i).encode()).hexdigest()}", f"s{i % 7}") for i in range(40)]
    rows += [(i, f"see {rare}", f"s{i}") for i in range(3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secret_scan.find_secrets(d).collect()}
    assert all(got[i].spans == "" and got[i].n_live == 0 for i in range(3)) and all(got[100 + i].n_live == 1 for i in range(40))
    some = {r.doc_id: r for r in secret_scan.find_secrets(d.where("doc_id < 103")).collect()}  # of four values one: not rare
    assert all(some[i].spans == "live:4:24" for i in range(3))
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    assert secret_scan.ownership(secret_scan.scan(docs, "source", "doc_id")).where("example").count() > 0


def test_repeated_rows_take_no_places_of_the_dictionary(spark):
    base = [(i, f"wort{i} und noch {i * 7} mehr davon im satz {'abcdefgh'[i % 8] * 5}", "de") for i in range(60)]
    once = spark.createDataFrame(base, "doc_id long, text string, lang string")
    repeated = spark.createDataFrame(base + base[:1] * 500, "doc_id long, text string, lang string")
    sample, language_id.SAMPLE_DOCS = language_id.SAMPLE_DOCS, 50
    try:
        assert language_id.fit_dictionaries(once) == language_id.fit_dictionaries(repeated)
    finally:
        language_id.SAMPLE_DOCS = sample


def test_redaction_with_clashing_columns(spark):
    d = spark.createDataFrame([(1, "password = Abc123xyz", "s", 20, "a", 1, "b"), (2, "clean", None, 5, None, 2, None), (3, None, "s", None, "c", 3, "d")], "doc_id long, text string, source string, n_chars long, __spans string, row long, d string")
    got = {r.doc_id: r for r in secret_scan.redact_documents(d).collect()}
    assert secret_scan.redact_documents(d).columns == d.columns and len(got) == 3
    assert (got[1].text, got[1].n_chars, got[1]["__spans"], got[1].row, got[1].d) == ("[SECRET]", 8, "a", 1, "b")
    assert got[2].text == "clean" and got[3].text is None


def test_language_by_plain_compression(spark):
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    dictionaries = language_id.fit_dictionaries(docs)
    assert all(0 < len(d) <= language_id.DICTIONARY_BYTES for d in dictionaries.values())
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, dictionaries).collect()}
    for r in docs.collect():
        data = language_id.letters(r.text)
        blocks = [data[i : i + language_id.BLOCK] for i in range(0, len(data), language_id.BLOCK)]
        size = {}
        for lang, content in dictionaries.items():
            level = language_id.SHORT_LEVEL if len(blocks) < 2 else language_id.LEVEL
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            c = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            size[lang] = sum(len(c.compress(b)) for b in blocks)
        assert got[r.doc_id] == (min(dictionaries, key=lambda x: size[x]) if data else "und")


def test_letters_and_dictionary_shares(spark):
    assert [language_id.letters(t) for t in ("½ ² ⅷ 12 _", "\u0301", "A\u0301b 1c", "नमस्ते!")] == [b"", b"", "a\u0301b c".encode(), "नमस्ते".encode()]
    assert language_id.quota([10, 10, 100], 50) == 30 and language_id.quota([5, 5], 50) == 50
    data = bytes(range(256)) * 40
    assert len(language_id.spread(data, 1024)) <= 1024 and language_id.spread(data, 1 << 20) == data
    late = "123 " * 9000 + "zebra " * 300
    d = spark.createDataFrame([(i, late, "xx") for i in range(3)] + [(None, late, "xx"), (9, "alpha beta", "yy")] * 2, "doc_id long, text string, lang string")
    found = language_id.fit_dictionaries(d)
    assert list(found) == ["xx", "yy"] and b"zebra" in found["xx"] and found["yy"] == b"alpha beta"


def test_vote_equals_plain_neighbours(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    space = quality_knn.fit_space(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    got = {r.doc_id: r.score for r in quality_knn.score_documents(docs, space).collect()}
    for r in docs.limit(40).collect():
        x = quality_knn.Space.weighted(quality_knn.term_counts([r.text]), space.weight)[0] @ space.basis
        cos = [float(np.dot(x, v) / max(np.linalg.norm(x), 1e-12)) for v in space.vectors]
        near = sorted(range(len(cos)), key=lambda i: (-cos[i], i))[: quality_knn.NEIGHBOURS]
        votes = [max(cos[i], 1e-9) ** quality_knn.POWER for i in near]
        assert got[r.doc_id] == pytest.approx(sum(v * space.labels[i] for v, i in zip(votes, near, strict=True)) / sum(votes), abs=0.02)


def test_vote_takes_tied_neighbours_in_order():
    n = quality_knn.NEIGHBOURS
    space = quality_knn.Space(np.ones(3 * quality_knn.TERMS, np.float32), np.ones((3 * quality_knn.TERMS, 1), np.float32), np.ones((2 * n, 1), np.float32), np.repeat([1.0, 0.0], n).astype(np.float32))
    assert space.score(["some words", "", None]).tolist() == [1.0, 1.0, 1.0]


def test_terms_count_words_and_sequences():
    counts = quality_knn.term_counts(["One one two", None, "x " * 200_000])
    t = quality_knn.TERMS
    assert counts[:, t : 2 * t].sum(1).tolist() == [3, 0, 200_000] and counts[0, t : 2 * t].max() == 2
    assert counts[0, 2 * t :].sum() == 12 and len(list(quality_knn.blocks(["a" * quality_knn.BLOCK_BYTES] * 3))) == 3


def plain_tree(pages):
    """Low branches of (url, html) pages by plain recursion over whole trees."""
    seen = defaultdict(lambda: defaultdict(Counter))
    parent, hint = {}, {}
    for url, html in pages:
        host = site_style.host_of(url)
        for path, above, kind, feature, says in site_style.Page(html).features() if host and html else ():
            seen[host, path][kind][feature] += 1
            parent[host, path] = above
            hint[host, path] = max(says, hint.get((host, path), 0))

    def entropy(c):
        n = sum(c.values())
        return -sum(x / n * math.log(x / n) for x in c.values()) if n else 0.0

    def value(host, path):
        layouts, texts, fillings = (seen[host, path][k] for k in range(3))
        h, m = hint[host, path], sum(fillings.values())
        shown = (1 - 0.9 ** max(1, len(layouts))) * min(1, entropy(layouts) / math.log(16))
        if m:
            content = (0, 0, 0, 0.6, 1)[h]
            if m > 1:
                spread = np.mean([math.log(n) for n in texts.values()]) / math.log(m)
                content = max(0, 1 - spread) * (0.5 + 0.5 * min(1, entropy(fillings) / math.log(min(m, 16))))
            shown = (m * (shown + 0.9 ** max(1, len(layouts)) * content) + 2 * (0, 0, 0, 0.6, 1)[h]) / (m + 2)
        own = (0.3, 0.3, 0.3, 1, 3)[h] * shown
        return max([own, *(value(host, p) for (x, p), above in parent.items() if x == host and above == path)])

    return {(h, p) for h, p in parent if seen[h, p][2] and value(h, p) < site_style.THRESHOLD}


def test_tree_equals_plain_recursion(spark):
    import random

    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    pages = []
    for host, n in (("a.example", 25), ("b.example", 6), ("c.example", 1)):
        for i in range(n):
            menu = "".join(f"<li><a href=x>{word()}</a></li>" for _ in range(rng.randint(4, 6)))
            body = "".join(f"<p>{prose(rng.randint(3, 200))}</p>" for _ in range(rng.randint(1, 6)))
            extra = f"<div class=promo><p>{prose(300 * (i % 3) + 5)}</p></div>" if i % 2 else ""
            pages.append((f"http://{host}/{i}", f"<body><nav><ul>{menu}</ul></nav><div class=box><b>All rights</b> held</div><div class=story><h1>{prose(5)}</h1>{body}</div>{extra}<div class=tail>{word()} {word()}</div></body>"))
    found = site_style.low_branches(site_style.style_counts(spark.createDataFrame(pages, "url string, html string"))).collect()
    assert {(r.host, r.path) for r in found} == plain_tree(pages)
    got = {r.url: r.text for r in site_style.extract_pages(spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")).collect()}
    for url, html in pages:
        story = re.search(r"<div class=story>(.*?)</div>", html)[1]
        want = "\n\n".join(re.findall(r">([^<]+)<", story))
        if "a.example" in url:  # the menu's ever-new words are a template
            assert want in got[url] and "All rights" not in got[url] and re.search("<a href=x>(.*?)<", html)[1] not in got[url].split()[:1]
        assert want in got[url]


def test_tree_decides_on_whole_data(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    got = {r.page_id: r.text for r in site_style.extract_pages(pages).collect()}
    off = {r.page_id: r.text for r in site_style.extract_pages(pages, threshold=-1.0).collect()}
    assert sum(got[i] != off[i] for i in got) > 0.9 * len(got)
    for i, page in html.items():
        article = re.sub(r"</?(?:p|h1)>", "\0", re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1])
        blocks = (" ".join(site_style.unescape(re.sub(r"<[^>]*>", " " if "<br>" in b else "", b)).split()) for b in article.split("\0"))
        assert got[i] == "\n\n".join(b for b in blocks if b)


@pytest.mark.parametrize("html", ['<div class="layout with-sidebar"><article><p>A b</p></article></div>', '<div id="main-nav-wrapper"><p>A b</p></div>', '<section class="social"><p>A b</p></section>', '<div style="overflow:hidden"><p>A b</p></div>', '<p title="hidden gem">A b</p>', '<div data-hidden="x">A b</div>', "<nav>x</nav><p title=it's>A</p> b", "<form><div class='search-results'>A b</div></form>", '<div class="cookie-notice">x</div><main>A b</main>'])
def test_names_never_cut_the_article(html):
    assert site_style.Page(html).text().replace("\n\n", " ") == "A b"


def test_parsing_is_linear():
    import time

    began = time.time()
    for html in ("<div>" * 60_000 + "x", '<a "' * 60_000, '<a x="' * 60_000, "<li><div>" * 30_000, "<!" * 60_000, "<p><b>" * 30_000, "</div>" * 60_000):
        site_style.Page(html).text()
    assert time.time() - began < 20
