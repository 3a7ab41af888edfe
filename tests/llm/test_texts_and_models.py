import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from notelake.llm import katz, katz_store, pages, pieces, quality, templates, toxicity

from .conftest import corpus, docs_of, text

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


# op1


@pytest.fixture(scope="module")
def model():
    return pieces.read_model(MODEL)


ODD = ["", None, "a", " a", "  a  b ", "▁x", "<s> hi <0x41> </s>", "日本語 ñandú 😀", "\t\n x\r\n", "word " * 9000, "ab" * 40000 + " " + "c d  e " * 3000, "� \x00 z"]


def test_ids_and_texts_equal_the_library_s(spark, model, monkeypatch, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    monkeypatch.setattr(pieces, "PART", 64)
    texts = ODD + corpus(random.Random(2), 20)
    ids = pieces.encode_texts([t or "" for t in texts], model)
    assert [x.tolist() for x in ids] == library.encode([t or "" for t in texts])
    docs = docs_of(spark, texts)
    rows = sorted(pieces.encode(docs, model).collect(), key=lambda r: r.doc_id)
    assert [list(r.ids) for r in rows] == [x.tolist() for x in ids]
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs, model), model).collect()}
    assert [back[i] for i in range(len(texts))] == [(t or "").replace("▁", " ") for t in texts]
    assert pieces.parity(docs, model).count() == 0
    assert pieces.encode(empty, model).count() == 0


def test_other_kinds_of_models_are_rebuilt():
    import struct

    def piece(p, score, kind):
        b = p.encode()
        body = b"\x0a" + bytes([len(b)]) + b + b"\x15" + struct.pack("<f", score) + b"\x18" + bytes([kind])
        return b"\x0a" + bytes([len(body)]) + body

    pieces_ = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), ("▁", -3, 1), ("a", -2, 1), ("b", -2.5, 1), ("▁a", -1, 1), ("ab", -1.5, 1), ("▁ab", -4.2, 1)]
    trainer, normal = b"\x18\x01", b"\x18\x01\x20\x01\x28\x01"  # unigram; dummy prefix, trim, escape
    data = b"".join(piece(*p) for p in pieces_) + b"\x12" + bytes([len(trainer)]) + trainer + b"\x1a" + bytes([len(normal)]) + normal
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["ab", " ab  a b ", "", "aab", "abab a", "c"]
    assert [x.tolist() for x in pieces.encode_texts(texts, data)] == library.encode(texts)
    with pytest.raises(ValueError):
        pieces.Model.parse(b"")


# op2


def hits(items, texts):
    index = templates.build_index(items)
    return [(t.first + d, items[i][0], exact) for t in templates.text_blocks(pa.array(texts, pa.large_string())) for d, i, _, _, exact in templates.matches(t, index)]


def test_questions_with_other_numbers_and_names_are_found(spark, empty):
    items = [(1, "Tom has 12 apples and gives 5 apples to Mary before he walks 3 km home, how many apples does Tom have left?"), (2, "short"), (3, None), (4, ""), (5, "five little words here now")]
    other = "Ann has 7 apples and gives 2 apples to Jane before he walks 9 miles home, how many apples does {} have left?"
    texts = ["x y. " + items[0][1] + " z", other.format("Ann"), other.format("Peter"), "a short one", "", None, "with five little words here now and", "Tom has no apples and gives none."]
    assert hits(items, texts) == [(0, 1, True), (1, 1, False), (6, 5, True)]
    docs, bench = docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in templates.contaminated(docs, bench, slice_windows=10).collect())
    assert got == [(0, 1), (1, 1), (6, 5)]
    kept = templates.remove_contaminated(docs, bench, slice_windows=10)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5, 7]
    assert templates.contaminated(empty, bench).count() == 0 and templates.contaminated(docs, bench.limit(0)).count() == 0


def plain_tokens(t):
    """Kind and word of each token, written plainly from the rules."""
    out, first, after_number = [], True, False
    for line in re.split("(?=\n)", t or ""):
        first = True
        for raw in WORD.findall(line):
            w = raw.strip("!\"'()*,./:;<>?[\\]^_`{|}~#&=@-")
            if w:
                low, kind = w.lower(), 0
                if (w[0].isupper() and not first) or low in map(str.lower, templates.NAMES) and w[0].isupper():
                    kind = templates.NAME
                if (re.search("[0-9]", w) and re.fullmatch(r"[0-9.,:/%+\-$^]+", w)) or low in templates.NUMBER_WORDS:
                    kind = templates.NUMBER
                elif after_number and low in templates.UNITS:
                    kind = templates.UNIT
                out.append((kind, low))
                after_number = kind == templates.NUMBER
                first = False
            if raw[-1] in ".!?:;":
                first = True
    return out


def plain_matches(doc, item):
    """Whether a text holds an item: all places and shifts are tried, tokens are compared one by one."""
    d, x = plain_tokens(doc), plain_tokens(item)
    n = min(templates.WINDOW, len(x))
    if n < templates.MIN_TOKENS:
        return False
    form = lambda t: t[0] or t  # noqa: E731  a slot, or the word itself
    cover = set()
    for shift in range(-len(x), len(d)):
        there = lambda p: 0 <= p + shift < len(d)  # noqa: E731, B023
        starts = [p for p in range(len(x) - n + 1) if there(p) and there(p + n - 1)]
        found = {p for p in starts if x[p : p + n] == d[p + shift : p + shift + n]}
        found |= {p for p in starts if [form(t) for t in x[p : p + n]] == [form(t) for t in d[p + shift : p + shift + n]] and sum(t[0] == 0 for t in x[p : p + n]) >= templates.MIN_LITERALS}
        places = sorted({p + j for p in found for j in range(n)})
        slots = lambda ps: ({(x[p], d[p + shift]) for p in ps if x[p][0]})  # noqa: E731, B023
        fits = lambda ps: len({a for a, _ in slots(ps)}) == len(slots(ps)) == len({b for _, b in slots(ps)})  # noqa: E731, B023
        runs = [[p for _, p in g] for _, g in itertools.groupby(enumerate(places), lambda ip: ip[1] - ip[0])]
        parts = [places] if fits(places) else []
        for run in [] if parts else [r for r in runs if len(r) >= templates.MIN_RUN]:
            same = [p for p in run if x[p][1] == d[p + shift][1]]
            parts += [run] if fits(run) else [[p for _, p in g] for _, g in itertools.groupby(enumerate(same), lambda ip: ip[1] - ip[0])]
            parts = [p for p in parts if len(p) >= templates.MIN_RUN]
        for part in parts:
            cover |= set(part)
            if any(b - a + 1 >= templates.MIN_RUN for a, b in ((r[0], r[-1]) for r in ([p for _, p in g] for _, g in itertools.groupby(enumerate(part), lambda ip: ip[1] - ip[0])))):
                return True
    return len(cover) >= templates.MIN_COVERAGE * len(x)


def test_contamination_against_brute_force(spark, empty):
    rng = random.Random(31)
    word = lambda: rng.choice(["Tom", "Mary", "Berlin", "12", "3.5", "7", "km", "kg", "five", *"the of a in by how many apples does buy has left train leaves at station before price each box sells".split()])
    sentence = lambda n: " ".join(word() for _ in range(n))
    items = [sentence(rng.randint(3, 30)) + rng.choice(["?", ".", ""]) for _ in range(25)]

    def changed(t):
        """The same question with other names and numbers, consistently (or not)."""
        names, numbers = {"Tom": "Anna", "Mary": "Peter", "Berlin": "Rome"}, {"12": "99", "3.5": "8.25", "7": "41", "five": "nine"}
        return " ".join((names | numbers).get(w.strip("?."), w) if rng.random() < 0.97 else word() for w in t.split())

    docs = []
    for _ in range(120):
        t, kind = rng.choice(items), rng.random()
        w = t.split()
        part = t if kind < 0.25 else changed(t) if kind < 0.5 else " ".join(w[: rng.randint(1, len(w))]) if kind < 0.75 else sentence(20)
        docs.append(f"{sentence(rng.randint(0, 15))} {part} {sentence(rng.randint(0, 15))}")
    docs += docs[:5] + ["", None, " \n", "x " * 40000 + items[5]]
    bench = spark.createDataFrame(list(enumerate([*items, "", None])), "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {(r.doc_id, r.item_id) for r in templates.contaminated(docs_of(spark, docs), bench).collect()}
    want = {(i, j) for i, t in enumerate(docs[:-1]) for j, x in enumerate(items) if plain_matches(t, x)}
    assert {g for g in got if g[0] < len(docs) - 1} == want and len(want) > 40
    assert (len(docs) - 1, 5) in got or len(plain_tokens(items[5])) < templates.MIN_TOKENS
    kept = {r.doc_id for r in templates.remove_contaminated(docs_of(spark, docs), bench).collect()}
    assert kept == set(range(len(docs))) - {i for i, _ in got}


def test_long_quotes_and_copies_of_few_literals_are_found(spark):
    rng = random.Random(4)
    passage = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)]
    table = "Boston 12 7 9 14 Denver 3 8 22 41 Austin 17 5 90 66"
    names = " ".join(f"{i} Tom {i * i} Mary" for i in range(3, 12))
    items = [(1, " ".join(passage)), (2, table), (3, names), (4, "Berlin 5 Madrid 7"), (5, "12 5")]
    fill = lambda: text(rng, 20).lower()
    quote = [*passage[:100], "Tom", *passage[100:120]]
    renamed = [*quote, "and", "Tom", "saw", "Tom"]
    texts = [f"{fill()} {' '.join(passage[150:350])} {fill()}", f"{fill()} {table} {fill()}", f"{fill()} {names} {fill()}", f"in {fill()} Berlin 5 Madrid 7 {fill()}", " ".join(passage[:12]) + " " + fill(), "Boston 13 7 9 14 Denver 3 8 22 42 Austin 17 5 91 66", "12 5 " + fill(), None]
    assert [h[:2] for h in hits(items, texts)] == [(0, 1), (1, 2), (2, 3), (3, 4)]
    # names that disagree later on do not hide what is verbatim
    assert [h[:2] for h in hits([(1, " ".join(renamed))], [" ".join([*quote, "and", "Ann", "saw", "Jane"])])] == [(0, 1)]
    docs, bench = docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(r.doc_id for r in templates.remove_contaminated(docs, bench).collect()) == [4, 5, 6, 7]


# op3


def brute_lm(rows, held):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    toks = [(i, [*WORD.findall((t or "").translate(low)), ("end",)]) for i, t in rows]
    c, b, nd = Counter(), Counter(), 0
    for i, w in toks:
        if not held(i):
            c.update(w)
            nd += 1
            b.update(zip([("begin",), *w], w))
    k, n, v = katz.K, sum(c.values()), len(c)
    d1, d2 = (katz.Discounts.good_turing(np.array([0.0] + [sum(x == r for x in y.values()) for r in range(1, k + 2)])).keep for y in (c, b))
    keep = lambda d, x: d[x] if x <= k else 1.0
    left = sum((1 - keep(d1, x)) * x for x in c.values())
    whole = n + (left <= 0)
    p = lambda w: keep(d1, c[w]) * c[w] / whole if c[w] else (left if left > 0 else 1.0) / whole
    before = {**c, ("begin",): nd}
    freed, mass = defaultdict(float), defaultdict(float)
    for (h, w), x in b.items():
        freed[h] += (1 - keep(d2, x)) * x
        mass[h] += p(w)

    def cond(h, w):
        if not before.get(h):
            return p(w)
        none = freed[h] <= 1e-12
        if b.get((h, w)):
            return keep(d2, b[h, w]) * b[h, w] / (before[h] + none)
        return (1.0 if none else freed[h]) / (before[h] + none) / (1 - mass[h]) * p(w)

    out = {}
    for i, w in toks:
        out[i] = (held(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(cond(h, x)) for h, x in zip([("begin",), *w], w)))
    every = [*c, "never seen"]
    return out, {h: sum(cond(h, w) for w in every) for h in [*list(before)[:25], "new"]}


@pytest.mark.parametrize("share", [0.0005, 0.05, 2.0])
def test_katz_scores_against_brute_force(spark, share, monkeypatch):
    monkeypatch.setattr(katz, "HOT_SHARE", share)
    texts = corpus(random.Random(6), 40)
    want, sums = brute_lm(list(enumerate(texts)), lambda i: zlib.crc32(str(i).encode()) % 7 == 2)
    assert all(abs(x - 1) < 1e-9 for x in sums.values())  # each context's probabilities sum to one
    got = {r.doc_id: r[1:] for r in katz.score(docs_of(spark, texts), chunk_bytes=1500).collect()}
    assert set(got) == set(want)
    for i, w in want.items():
        assert got[i][:4] == w[:4]
        assert got[i][4:] == pytest.approx(w[4:], rel=1e-9)


def test_katz_without_training_rows(spark, empty):
    assert katz.score(empty).count() == 0
    r = katz.score(docs_of(spark, ["a b", None]), train=F.lit(False)).collect()
    assert sorted((x.n_tokens, x.n_known, x.score) for x in r) == [(1, 0, 0.0), (3, 0, 0.0)]


def brute_ngrams(train, order):
    """Katz backoff of any order by plain recursion; the probability of a word after some words."""
    pad = ("begin",)
    counts = [Counter() for _ in range(order + 1)]
    for w in train:
        for i in range(len(w)):
            for k in range(1, order + 1):
                counts[k][tuple(w[j] if j >= 0 else pad for j in range(i - k + 1, i + 1))] += 1
    keeps = [None] + [katz.Discounts.good_turing(np.array([0.0] + [sum(x == r for x in counts[k].values()) for r in range(1, katz.K + 2)])).keep for k in range(1, order + 1)]
    kept = lambda k, c: (keeps[k][c] if c <= katz.K else 1.0) * c
    after = defaultdict(list)
    for k in range(1, order + 1):
        for g in counts[k]:
            after[g[:-1]].append(g)
    n = sum(counts[1].values())
    left = n - sum(kept(1, c) for c in counts[1].values())

    def p(h, w):
        k = len(h) + 1
        c = counts[k].get((*h, w), 0)
        if k == 1:
            return (kept(1, c) if c else left if left > 1e-12 else 1.0) / (n + (left <= 1e-12))
        seen = after.get(h)
        if not seen:
            return p(h[1:], w)
        total = sum(counts[k][g] for g in seen)
        freed = sum(counts[k][g] - kept(k, counts[k][g]) for g in seen)
        none = freed <= 1e-12
        if c:
            return kept(k, c) / (total + none)
        return (1.0 if none else freed) / (total + none) / (1 - sum(p(h[1:], g[-1]) for g in seen)) * p(h[1:], w)

    return p, counts


def test_stored_models_score_other_texts(spark, empty, tmp_path):
    rng = random.Random(3)
    low = lambda t: [*WORD.findall((t or "").lower()), ("end",)]
    lines = [" ".join(rng.choice("a b c d e f g h".split()) for _ in range(rng.randint(0, 9))) for _ in range(60)]
    other = [*lines[:5], "a b new c", "", None, "A B", "x " * 3000]
    for order in (1, 2, 3):
        katz_store.train(docs_of(spark, lines), f"{tmp_path}/{order}", order)
        p, counts = brute_ngrams([low(t) for t in lines], order)
        got = {r.doc_id: (r.n_tokens, r.score) for r in katz_store.score(docs_of(spark, other), f"{tmp_path}/{order}").collect()}
        for i, t in enumerate(other):
            w = low(t)
            want = sum(math.log10(p(tuple(w[j] if j >= 0 else ("begin",) for j in range(m - order + 1, m)), x)) for m, x in enumerate(w))
            assert got[i][0] == len(w) and got[i][1] == pytest.approx(want, rel=1e-9)
        every = [g[0] for g in counts[1]] + ["never seen"]
        for h in [g[:-1] for g in list(counts[order])[:30]]:
            assert sum(p(h, w) for w in every) == pytest.approx(1)
    whole = {r.doc_id: r.score for r in katz.score(docs_of(spark, lines), train=F.lit(True)).collect()}
    assert {r.doc_id: r.score for r in katz_store.score(docs_of(spark, lines), f"{tmp_path}/2").collect()} == pytest.approx(whole, rel=1e-9)
    assert katz_store.score(empty, f"{tmp_path}/3").count() == 0
    katz_store.train(empty, f"{tmp_path}/none", 2)
    assert katz_store.score(docs_of(spark, ["a b"]), f"{tmp_path}/none").first().score == 0


# op6


def test_article_text():
    page = "<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li>n</ul></nav><div class='cookie-notice'>We use</div><main><h1>T &amp; x</h1><p>a<b>b</b>  c<ul><li>one<li>two</ul><div class=comments>c</div><form>f</form><script>var t='</p>';</script><p hidden>h<p>last &lt;p&gt; &nbsp;x</main><aside>s</aside><p>foot"
    assert pages.extract(page, set()) == "T & x\nab c\none\ntwo\nlast <p> x"
    assert pages.extract("", set()) == "" and pages.extract("<p>a<p>b", set()) == "a\nb"
    assert pages.extract("<body><article><p>x<!-- c --> y</article><article>z</body>", set()) == "x y"
    assert pages.extract("<article class='post has-comments sidebar-off'><p>x</p><div class='comment-list'>y</div></article>", set()) == "x"
    assert pages.extract("<body><div class='widget'><p>all there is</div>", set()) == "all there is"
    assert pages.extract("a < b and <3", set()) == "a < b and <3"


def test_templates_of_a_site_go_and_articles_stay(spark):
    rng = random.Random(1)
    rows = [(i, f"https://Big.example/{i}", f"<body><div>Same teaser for all</div><div><p>Body {text(rng, 20)}</p></div></body>") for i in range(30)]
    rows += [(100 + i, f"http://small.example/{i}", "<body><div>Same teaser for all</div><p>x</p></body>") for i in range(3)]
    rows += [(200 + i, f"http://wire.example/{i}", f"<article><p>Common line</p><p>{i}</p></article>") for i in range(20)]
    rows += [(300 + i, "http://copy.example/a", "<body><p>All the same</p></body>") for i in range(20)]
    rows += [(400, None, None), (401, "nonsense", ""), (401, "nonsense", "<p>again")]
    got = {(r.page_id, r.text) for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("templates", F.lit(1)).withColumn("host", F.lit("h"))).collect()}
    texts = dict(got)
    assert all(texts[i].startswith("Body") for i in range(30))
    assert texts[100] == "Same teaser for all\nx" and texts[205] == "Common line\n5" and texts[300] == "All the same"
    assert (400, "") in got and (401, "") in got and (401, "again") in got


def counted_templates(rows, min_pages=10, min_share=0.5):
    """Templates by host, by plain counting over all pages."""
    seen, whole = defaultdict(set), defaultdict(set)
    for _, url, source in rows:
        host = (re.match(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "") or ["", ""])[1].lower()
        found = pages.digests(tree := pages.parse(source or ""))
        whole[host].add(found[-1][1])
        for h in {h for e, h in found if e.kids and e.tag not in pages.RAW | pages.VOID} | {found[-1][1]} | set(pages.shapes(tree).values()):
            seen[host, h].add(found[-1][1])
    out = defaultdict(set)
    for (host, h), p in seen.items():
        if len(p) >= min_pages and len(p) >= min_share * len(whole[host]):
            out[host].add(h)
    return out


def site(rng, kind, i):
    """A page whose boilerplate has neither telling tags nor names."""
    menu = "<div><ul>" + "".join(f"<li><a href='/{rng.random()}'>{text(rng, 2)}</a></li>" for _ in range(rng.randint(3, 8))) + "</ul></div>"
    body = "".join(f"<p>{text(rng, 40)}</p>" for _ in range(rng.randint(2, 6)))
    banner = "<div><b>Read all our offers</b></div>"
    main = {"article": f"<article><p>First {i}</p>{banner}{body}</article>", "div": f"<div><p>First {i}</p>{banner}{body}</div>"}[kind]
    return f"<html><head><title>x</title></head><body>{menu}{main}<div><span>(c) {text(rng, 4)}</span></div></body></html>"


def test_templates_alone_clean_a_site(spark):
    rng = random.Random(5)
    rows = [(i, f"https://{kind}.example/{i}", site(rng, kind, i)) for kind, n in (("article", 0), ("div", 40)) for i in range(n, n + 40)]
    rows += [(100 + i, f"https://few.example/{i}", site(rng, "div", i)) for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    counted = counted_templates(rows)
    assert {r.host: set(r.templates) for r in pages.site_templates(pages.with_host(df)).collect()} == counted and set(counted) == {"article.example", "div.example"}
    got = {r.page_id: r.text for r in pages.main_text(df).collect()}
    for i, url, source in rows:
        want = " ".join(re.sub(r"<[^>]+>", "\n", re.search(r"<p>First.*</p>", source)[0].replace("<div><b>Read all our offers</b></div>", "")).split())
        text_ = " ".join(got[i].split())
        assert text_ == want if i < 80 else want.split()[-1] in text_ and "(c)" in text_
        if i < 80:
            assert " ".join(pages._read(pages.parse(source), counted[url.split("/")[2]], names=False, tags=False).split()) == want


def test_odd_pages(spark):
    assert pages.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    deep = "<div>" * 20000 + "deep" + "</div>" * 20000
    long = "<article>" + "<p>word one two</p>" * 30000 + "</article>"
    rows = [(1, "http://a/1", deep), (2, "http://a/2", long), (2, "http://a/2", long), (3, None, "<b>x"), (None, "http://a/", "<p>y")]
    got = sorted(((r.page_id or 0), r.n_chars) for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(0, 1), (1, 4), (2, 30000 * 13 - 1), (2, 30000 * 13 - 1), (3, 1)]


def test_sections_of_a_text_are_no_shapes(spark):
    rng = random.Random(6)
    part = lambda: f"<section><h2>{text(rng, 3)}</h2><p>{text(rng, 12)}</p></section>"
    rows = [(i, f"http://s.example/{i}", f"<body><nav><a>{text(rng, 1)}</a></nav><div>{part()}{part()}{part()}</div></body>") for i in range(20)]
    got = [r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert all(len(t.split("\n")) == 6 for t in got)


# op7


def test_marginals_against_enumeration():
    import itertools

    rng = np.random.default_rng(5)
    first = np.array([True, False, False, True, False, True])
    e, move, start = rng.normal(size=6), rng.normal(size=(2, 2)), rng.normal(size=2)
    total, ones = 0.0, np.zeros(6)
    for y in itertools.product((0, 1), repeat=6):
        s = sum(e[i] * y[i] + (start[y[i]] if first[i] else move[y[i - 1], y[i]]) for i in range(6))
        total += math.exp(s)
        ones += math.exp(s) * np.array(y)
    p, _, _ = toxicity.marginals(e, first, move, start)
    assert p == pytest.approx(ones / total)


def test_toxic_documents_are_found(spark, empty):
    rng = random.Random(3)
    bad = ["moronic", "idiotic", "scummy"]
    texts, toxic = [], []
    for i in range(400):
        w = text(rng, rng.randint(10, 80)).split()
        toxic.append(int(i % 4 == 0))
        if toxic[-1]:
            w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", ".", "!"]))
        texts.append(" ".join(w))
    docs = docs_of(spark, [*texts, "", None])
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int").withColumn("quality", F.lit(1)).withColumn("text", F.lit("x"))
    model = toxicity.fit(docs, labels, ~toxicity.held_out())
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == toxic[i] for i in held]) > 0.97
    hit = next(i for i in held if toxic[i])
    span = got[hit].spans[0]
    assert texts[hit].encode()[span.start : span.end].decode() in bad and span.p > 0.5
    assert 0 <= got[400].score < 0.5 and got[400].score == got[401].score
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.fit(docs, labels.limit(0), ~toxicity.held_out())
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}


def test_toxic_texts_that_open_alike_all_count(spark):
    rng = random.Random(5)
    header = "This page is served under the common licence of the site and of all its parts, read it before you go on reading.\n"
    texts = []
    for i in range(300):
        w = text(rng, rng.randint(10, 80)).split()
        if i % 3 == 0:
            w.insert(rng.randrange(len(w)), "moronic")
        texts.append(header + " ".join(w))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.fit(docs_of(spark, texts), labels, ~toxicity.held_out())
    got = {r.doc_id: r.predicted for r in toxicity.score(docs_of(spark, texts), model).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i] == (i % 3 == 0) for i in held]) > 0.97


def test_near_copies_do_not_take_the_lexicon(spark):
    rng = random.Random(6)
    long = " ".join(["unseen", *("".join(rng.choices("bcdfghjklm", k=9)) for _ in range(90))])
    texts = [long + f" v{i}" if i % 3 == 0 and i % 2 else text(rng, 40) + (" moronic " if i % 3 == 0 else " ") + text(rng, 5) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.fit(docs_of(spark, texts), labels, ~toxicity.held_out())
    spans = {r.doc_id: len(r.spans) for r in toxicity.score(docs_of(spark, ["one moronic word here", "one unseen word here"]), model).collect()}
    assert spans == {0: 1, 1: 0}


def test_long_and_repeated_rows_teach_the_chain(spark):
    rng = random.Random(8)
    n = 240
    texts = [text(rng, 300) + (" moronic " if i % 2 else " ") + text(rng, 300) for i in range(n)] + ["", None, "x " * 50000]  # no text is short
    labels = spark.createDataFrame([(i, i % 2) for i in range(n)] + [(1, 0), (1, 1), (n, 0), (n + 1, None), (None, 1)], "doc_id long, toxic int")
    docs = docs_of(spark, texts)
    docs = docs.union(docs.filter("doc_id < 5"))
    model = toxicity.fit(docs, labels, ~toxicity.held_out(), chain_tokens=20_000)
    got = toxicity.score(docs, model).collect()
    assert len(got) == n + 8 and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == r.doc_id % 2 == len(r.spans) for r in got if r.doc_id < n)


# op10


def brute_counts(t):
    w = WORD.findall(t or "")
    seen, lines = set(), 0
    for line in (t or "").split("\n"):
        lines += bool(WORD.search(line)) and line in seen
        seen.add(line)
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), lines, len(covered), failed


def test_quality_counts_against_brute_force(spark, empty):
    texts = [*corpus(random.Random(11)), "a\nb \na\nb \n\n\na", "# * é|\n# * é|"]
    got = {r.doc_id: r for r in quality.quality_rules(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_counts(t)
        assert not (r.base_failed and r.kept)
    assert quality.quality_rules(empty).count() == 0


def test_quality_verdict_by_distance(spark):
    clean = "the of and to in is that it for on was as with be by are this at from or have which but they"
    rng = random.Random(5)
    good = [" ".join(rng.choice(clean.split() + ["walking", "houses", "rivers"]) for _ in range(250)) + "." for _ in range(30)]
    junk = [" | ".join(f"#{rng.random()}#" for _ in range(250))]
    docs = docs_of(spark, good + junk)
    rows = quality.quality_rules(docs).collect()
    assert {r.doc_id for r in rows if not r.kept} == {30}
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == 30
    p, q = np.array([[1.0, 3.0]]), np.array([3.0, 1.0])
    m = 0.5
    want = math.sqrt(0.25 * math.log2(0.25 / m) + 0.75 * math.log2(0.75 / m))
    assert quality.js_distance(p, q)[0] == pytest.approx(want)
