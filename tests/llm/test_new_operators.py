"""Spelling variants, main text of pages, divergence of sources: against brute force, known pages, and their edge cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from fieldlark.llm import decontaminate, divergence, main_text, spelling

DOCS = "doc_id long, text string, lang string, source string, word string, id int, term string, chunk int"
FOLD = {c: c + 32 for c in range(65, 91)}


def docs(spark, rows):
    """Documents with further columns whose names clash with those of the operators."""
    return spark.createDataFrame([(*r, "w", 1, "t", 2) for r in rows], DOCS)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, rule):
    n = Counter()
    for key, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if rule.slip and h % rule.slip == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= rule.length and k >= rule.count}


def brute_variants(rows, rule):
    n = brute_words(rows, rule)
    form, count = {}, {}
    for w in n:
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        count[w], form[w] = len(others), best if best and n[best] >= rule.lead * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], count[w], form[w] and n[form[w]]))
    return out


def test_variants_against_brute_force(spark):
    rng = random.Random(11)
    stems = ["aabbaab", "aabbaabb", "ÀÉüxxyy", "abababab", "aaaaaaa", "Straßenx", "zzzzzzzz"]
    rows = []
    for i in range(120):
        words = []
        for _ in range(60):
            w = rng.choice(stems[: 1 + rng.randrange(len(stems))])
            for _ in range(rng.choice([0, 0, 0, 0, 0, 1, 1, 2])):
                k = rng.randrange(len(w) + 1)
                w = rng.choice([w[:k] + rng.choice("abxÜ") + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice("abx") + w[k + 1 :]])
            words.append(w if rng.random() < 0.8 else w.upper())
        rows.append((None if i == 7 else i, rng.choice([" ", ", ", "×", "7"]).join(words), "en", "s"))
    rows += [rows[3], (900, None, None, None), (901, "", "", ""), (902, "short 中文中文中文中文 Ωωωωωωωω", "en", "s")]
    for rule in (spelling.Spelling(), spelling.Spelling(slip=2, lead=2), spelling.Spelling(length=3, count=1, slip=0, lead=3)):
        got = {tuple(r) for r in spelling.variants(docs(spark, rows), rule).collect()}
        assert got == brute_variants(rows, rule)


def test_chain_of_forms_and_long_runs(spark):
    steps = ["mmmmmmmm", "mmmmmmmn", "mmmmmmnn", "mmmmmnnn"]
    text = " ".join(" ".join([w] * (2 * 10**k)) for k, w in enumerate(reversed(steps)))
    monster = "ab" * 100_000
    rows = [(2, text, "en", "s"), (4, f"{monster} {monster}x {monster}", "en", "s"), (6, f"{monster}x", "en", "s")]
    rule = spelling.Spelling(slip=0, lead=10)
    got = {r.word: r for r in spelling.variants(docs(spark, rows), rule).collect()}
    assert [got[w].form for w in steps] == [None, *steps[:-1]] and {got[w].root for w in steps} == {"mmmmmmmm"}
    assert got[monster].n_near == 1 and got[monster + "x"].n_near == 1 and got[monster].form is None


def test_empty_tables(spark):
    none = docs(spark, [])
    assert spelling.variants(none).count() == 0 and divergence.audit(none).count() == 0
    assert main_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_audit(rows, rule):
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(divergence.TERM, (text or "").translate(FOLD))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        df[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, d in df[lang].items() if d >= rule.docs]
        own = [s for x, s in groups if x == lang]
        share = {}
        for s in own:
            n = sum(counts[lang, s][t] for t in kept)
            share[s] = {t: 1 + 10**9 * (counts[lang, s][t] + 2) // (n + 2 * len(kept)) for t in kept}
        total = {t: sum(counts[lang, s][t] for s in own) for t in kept}
        whole = {t: 1 + 10**9 * (total[t] + 2) // (sum(total.values()) + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in own:
            pairs = [(-sum(f(share[s][t], share[o][t]) for t in kept), o) for o in own if o != s]
            telling = [(-f(share[s][t], whole[t]), t) for t in kept if counts[lang, s][t] and share[s][t] > whole[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(telling)[: rule.terms])):
                out |= {(lang, s, part, item, -v, k) for k, (v, item) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("rule", [divergence.Audit(docs=3, terms=4, chunk=4, block=3, run=2), divergence.Audit(docs=2)])
def test_audit_against_brute_force(spark, rule):
    rng = random.Random(13)
    words = [f"w{'abcdefgh'[i % 8]}{'äöü中xyz'[i % 7]}" * (1 + i // 56) for i in range(90)]
    rows = []
    for i in range(400):
        lang = rng.choice(["en", "en", "en", "de", None, ""])
        source = rng.choice([f"s{k}" for k in range(11)] + [None, "Ä"]) if lang != "de" else "only"
        text = " ".join(rng.choices(words, [1 / (1 + (k * (i % 5 + 1)) % 90) for k in range(90)], k=rng.randrange(40)))
        rows.append((i, rng.choice([text, text.upper(), f"{text}1_{text}"]), lang, source))
    rows += [(900, None, "en", "none"), (901, "", "xx", "a"), (902, "rare words", "xx", "b"), (903, "1 2 3", "xx", None), (904, "alone", "yy", "z"), rows[5], (905, "the " * 50_000, "en", "s1")]
    got = divergence.audit(docs(spark, rows), rule)
    assert {tuple(r) for r in got.collect()} == brute_audit(rows, rule)
    assert got.count() == len(brute_audit(rows, rule))


def test_shares_do_not_overflow(spark):
    for c, n, v in [(9 * 10**12, 9 * 10**13 - 10, 5), (0, 0, 1), (7, 7, 1), (10**12, 10**13, 10**6)]:
        want = 1 + 10**9 * (c + 2) // (n + 2 * v)
        assert spark.sql(f"select {c}L c, {n}L n, {v}L v").select(divergence.share("c", "n", "v")).first()[0] == want


PAGES = {
    1: ("https://a.example/1", "<body><nav><a href='/'>Home</a></nav><article><header><h1>Title</h1><p>By one</p></header><p>One <b>two</b>three<br>four &amp; five &notit; &#x41;<p>six &lt;p&gt;\n\t seven</p><aside>Also read</aside></article><footer>f</footer>", "Title One twothree four & five ¬it; A six <p> seven"),
    2: ("https://a.example/2", "<body><article><h1>T</h1><!-- <p>no</p> --><script>var t='</article>';</script><style>p{}</style><ul><li>a<li>b</ul><table><tr><td>q<td>r</table></article><section class='comments'><p>Reader says</p></section>", "T a b q r"),
    3: (None, "", ""),
    4: (None, None, ""),
    5: ("nonsense", "<nav>menu</nav><div class='ad'>buy</div>", ""),
    6: ("https://b.example/1", "<form action='/'><div id='content'><p>The page is inside a form as some servers make them.</p></div></form>", "The page is inside a form as some servers make them."),
    7: ("https://c.example/1", "<main><p>Plain text of the page stands here.</p><form><label>Name</label> Send us a note</form><div class='cookie-notice'>We use cookies</div><div hidden>secret</div><div class='has-sidebar'>kept too</div></main>", "Plain text of the page stands here. kept too"),
    8: ("https://d.example/1", "just text &lt;without&gt; tags  at all", "just text <without> tags at all"),
    10: ("https://f.example/1", "<body class='no-sidebar'><div id='header'><h1>Site</h1></div><div id='content'><div class='post'><h2>Name</h2><div class='entry'><p>" + "Body of it. " * 20 + "</p></div></div><ol class='comment-list'><li><article class='comment-body'><p>" + "I say no. " * 40 + "</p></article></li></ol></div><div id='sidebar'><p>Side</p></div><div id='footer'>f</div>", "Name " + ("Body of it. " * 20).strip()),
    11: ("https://g.example/1", "<main><article class='post-7 post category-advertising tag-comment'><h1>On ads</h1><p>They are many.</p><div class='alert'>Old browser</div></article><article class='related-story'><p>See this too</p></article></main>", "On ads They are many."),
    9: ("https://e.example/1", "<div class='post'><h1>Head</h1><div class='body-17'><p>" + "Words of the article. " * 9 + "</p></div></div><div class='sidebar'><p>" + "Side words. " * 40 + "</p></div>", "Head " + ("Words of the article. " * 9).strip()),
}


def test_known_pages(spark):
    rows = [(k, u, h, "x", "y") for k, (u, h, _) in PAGES.items()] * 2 + [(None, None, "<p>no id</p>", "x", "y")]
    got = main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, host string")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got} == {k: want for k, (*_, want) in PAGES.items()} | {None: "no id"}


def test_hosts_agree_on_where_the_article_is(spark):
    """A short article beside longer text that nothing marks: only the host's other pages tell which is which."""
    promo = "<div class='x9'><p>" + "Come and see what else there is. " * 6 + "</p></div>"
    page = lambda n: f"<body><div class='wrap'><div class='t-{n}'><p>{'Article says so. ' * n}</p></div>{promo}</div>"
    rows = [(n, "http://h.example/a", page(n)) for n in (200, 300, 400, 2)] + [(99, "http://other.example/a", page(2))]
    got = {r.page_id: r.text for r in main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[n] == ("Article says so. " * n).strip() for n in (200, 300, 400, 2)) and "Come and see" in got[99]


@pytest.mark.parametrize("html", ["<div>" * 60_000 + "deep", "<a " * 60_000, "<!--" * 60_000, '<a b="' * 60_000, "<li>x" * 30_000, "<b class=ad>" * 30_000 + "<p>" * 30_000, "</p" * 60_000, "<script>" * 30_000])
def test_broken_pages_take_linear_time(html):
    main_text.read_page(html)


@pytest.mark.parametrize("text, item", [("a" * 100_000, "a" * 1_000), ("the cat " * 20_000, "the cat " * 150), ("ab " * 40_000 + "end", "ab " * 300)])
def test_repetitive_texts_meet_repetitive_items(text, item):
    found = decontaminate.Index([(1, item), (2, "some other item of the benchmark")], decontaminate.Leaks()).find([text, "a clean text", None])
    assert {(r, i) for r, i, *_ in found} == {(0, 1)} and all(e <= len(item) // 10 for *_, e in found)
    assert sum(n for *_, n, _ in found) > 0.9 * len(text)


@pytest.mark.parametrize("hits, dense", [(50, 10**9), (50, 1)])
def test_counting_in_parts_loses_nothing(monkeypatch, hits, dense):
    rng = random.Random(7)
    some = lambda n, k: "".join(rng.choices("abc "[:k], k=n))
    for _ in range(60):
        items = [(j, some(rng.randint(1, 120), rng.randint(1, 4))) for j in range(5)]
        texts = [some(rng.randint(0, 600), rng.randint(1, 4)) + rng.choice(items)[1] + some(30, 3) for _ in range(4)]
        index = decontaminate.Index(items, decontaminate.Leaks())
        whole = {x[:2] for x in index.find(texts)}
        monkeypatch.setattr(decontaminate, "_HITS", hits)
        monkeypatch.setattr(decontaminate, "_MANY", hits)
        monkeypatch.setattr(decontaminate, "_DENSE", dense)
        assert {x[:2] for x in index.find(texts)} == whole
        monkeypatch.undo()
