import hashlib
import random
import re
from datetime import datetime, timedelta

import corpus_pipeline
import pytest
import regex
from notelake.llm import pseudonyms as P
from pyspark.sql import functions as F

from .conftest import docs_of, text

KEY = "k"


def feistel(values, radices, kind):
    """The network, written plainly."""
    half = len(values) // 2
    for r in range(P.ROUNDS):
        left = r % 2 == 0
        other = values[half:] if left else values[:half]
        seed = "|".join([KEY, kind, str(r), ",".join(map(str, radices)), ",".join(map(str, other))])
        digest = hashlib.sha512(seed.encode()).hexdigest() + hashlib.sha512((seed + "|more").encode()).hexdigest()
        values = [(v + int(digest[(i if i < half else i - half) % 64 * 4 :][:4], 16)) % radices[i] if (i < half) == left else v for i, v in enumerate(values)]
    return values


def luhn(s):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


TEXT = "mail the.65@mail7.example.com call +1 (068) 555-2748 card 4845168114407329 and 4845-1681-1440-7329 ip 97.51.17.173. bad 1234567890123456 token = \"0b96a8c8d79c4a5085c919698889f59b72ab7bb6\" on 2024-02-29, 29/02/2024, 2023-02-30 ssn 078-05-1120 iban GB82 WEST 1234 5698 7654 32."


def run(spark, texts):
    return [r.text for r in P.pseudonymise(docs_of(spark, texts), KEY).orderBy("doc_id").collect()]


def test_values_keep_their_format_and_validity(spark):
    (out,) = run(spark, [TEXT])
    assert re.sub("[0-9]", "9", re.sub("[a-zA-Z]", "a", re.sub(r"ip [\d.]+ bad", "", out))) == re.sub("[0-9]", "9", re.sub("[a-zA-Z]", "a", re.sub(r"ip [\d.]+ bad", "", TEXT)))
    cards = re.findall(r"card (\d{16}) and ([\d-]{19})", out)[0]
    assert cards[0] == cards[1].replace("-", "") and luhn(cards[0]) and cards[0] != "4845168114407329"
    digits = [int(c) for c in "484516811440732"]
    assert cards[0][:15] == "".join(map(str, feistel(digits, [10] * 15, "card")))
    assert re.search(r"ip ([\d.]+)\. bad", out)[1] == ".".join(map(str, feistel([97, 51, 17, 173], [256] * 4, "ipv4")))
    a, b = re.findall(r"on (\S+), (\S+), 2023-02-30", out)[0]
    assert a == "-".join(reversed(b.split("/"))) and a != "2024-02-29"
    iban = re.search("iban (.*).$", out)[1].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban[:2] == "GB"
    for gone in ("the.65@", "555-2748", "0b96a8c8", "078-05-1120", "97.51.17.173"):
        assert gone not in out
    assert "bad 1234567890123456 " in out and "2023-02-30" in out


CLASSES = ((P.DIGITS, 10), (P.LOWER, 26), (P.UPPER, 26), (P.LATIN, len(P.LATIN)))


def of_classes(value, kind, letters=26):
    """Each character permuted within its class, written plainly."""
    classes = [(a, letters if n == 26 else n) for a, n in CLASSES]
    held = [next(((a, n) for a, n in classes if c in a), None) for c in value]
    out = feistel([h[0].index(c) if h else 0 for h, c in zip(held, value)], [h[1] if h else 1 for h in held], kind)
    return "".join(h[0][v] if h else c for h, v, c in zip(held, out, value))


def refilled(shape, digits):
    it = iter(digits)
    return "".join(next(it) if c in P.DIGITS else c for c in shape)


def plain(m):
    """The pseudonym of a found string, written plainly; None for one that is not valid."""
    kind = next(k for k, p in P.PATTERNS.items() if regex.fullmatch(p, m))
    digits = "".join(c for c in m if c in P.DIGITS)
    permuted = lambda d: "".join(map(str, feistel(list(map(int, d)), [10] * len(d), kind)))
    if kind == "email":
        local, host = m.split("@")
        return of_classes(local, kind) + "@" + host
    if kind == "secret":
        value = re.search("[A-Za-z0-9_+/-]{16,128}$", m)[0]
        return m[: -len(value)] + of_classes(value, kind, 6 if re.fullmatch("[0-9a-f]+", value) else 26)
    if kind == "card":
        if not luhn(digits):
            return None
        body = permuted(digits[:-1])
        return refilled(m, body + next(c for c in P.DIGITS if luhn(body + c)))
    if kind == "ssn":
        a, g, n = map(int, m.split("-"))
        if not (0 < a < 900 and a != 666 and g and n):
            return None
        a, g, n = feistel([a - 1 - (a > 666), g - 1, n - 1], [898, 99, 9999], kind)
        return f"{a + 1 + (a > 664):03d}-{g + 1:02d}-{n + 1:04d}"
    if kind == "ipv4":
        return ".".join(map(str, feistel(list(map(int, m.split("."))), [256] * 4, kind)))
    if kind == "date":
        forms = {"-": "%Y-%m-%d", "/": "%d/%m/%Y", ".": "%d.%m.%Y"}
        form = forms[re.search("[./-]", m)[0]]
        try:
            day = (datetime.strptime(m, form) - datetime(1900, 1, 1)).days
        except ValueError:
            return None
        a, b = feistel(list(divmod(day, 229)), [319, 229], kind)
        return (datetime(1900, 1, 1) + timedelta(a * 229 + b)).strftime(form)
    if kind == "phone":
        code = re.match(r"(?:\+[0-9]{1,3}(?=[ .(-])|\+[0-9])?", m)[0]
        return code + refilled(m[len(code) :], permuted("".join(c for c in m[len(code) :] if c in P.DIGITS))) if 7 <= len(digits) <= 15 else None
    raise AssertionError(kind)


def test_all_kinds_against_plain_python(spark):
    rng = random.Random(12)
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    w = lambda n: "".join(rng.choices("abcdefxyzABCéü0189", k=n))
    card = lambda: next(c for c in iter(lambda: "4" + d(15), None) if luhn(c))
    day = lambda: datetime(1900, 1, 1) + timedelta(rng.randrange(73000))
    makers = [
        lambda: f"{w(6)}.{w(3)}@mail{d(1)}.example.com", lambda: f'token = "{rng.randbytes(12).hex()}"', lambda: f"password: {d(4)}AbC{d(12)}xyz", lambda: f"{d(3)}-{d(2)}-{d(4)}", card, lambda: "-".join(re.findall("....", card())), lambda: d(16),
        lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), lambda: day().strftime("%Y-%m-%d"), lambda: day().strftime("%d/%m/%Y"), lambda: "31.02.2001", lambda: f"+1 ({d(3)}) {d(3)}-{d(4)}", lambda: f"+49 {d(3)} {d(4)} {d(3)}", lambda: f"{d(3)}-{d(3)}-{d(4)}",
    ]
    texts = [" ".join(f"{text(rng, rng.randrange(4))} {rng.choice(makers)()}," for _ in range(rng.randrange(8))) for _ in range(150)]
    texts += texts[:20]  # repeated rows
    whole = regex.compile("|".join(f"(?:{p})" for p in P.PATTERNS.values()))
    want = [whole.sub(lambda m: plain(m[0]) or m[0], t) for t in texts]
    assert run(spark, texts) == want and sum(a != b for a, b in zip(texts, want)) > 100
    long = "nothing here " * 200_000 + "078-05-1120"
    assert run(spark, [long]) == [long[:-11] + plain("078-05-1120")]


def test_equal_values_stay_linked_and_different_ones_apart(spark):
    rng = random.Random(2)
    numbers = [f"+1 ({rng.randrange(1000):03d}) 555-{rng.randrange(10000):04d}" for _ in range(300)]
    out = run(spark, [f"x {n} y" for n in numbers + numbers])
    assert out[:300] == out[300:] and len(set(out)) == len(set(numbers))


def test_neighbours_are_told_apart(spark):
    (out,) = run(spark, ["call +1 (826) 555-4081 190.137.223.204 or +49 30 901820 4845168114407329 12 x"])
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4} (\d{1,3}\.){3}\d{1,3} or \+49 \d\d \d{6} \d{16} 12 x", out)
    assert not re.search("555-4081|190.137|901820|4845168114407329", out)


def test_letters_beyond_ascii_are_permuted_too(spark):
    (out,) = run(spark, ["é@mail.example.com réê.90@mail.example.com"])
    a, b = out.split()
    assert a != "é@mail.example.com" and len(a) == 18 and b[:6] != "réê.90" and b[3] == "."


def test_odd_texts(spark, empty):
    long_ = "w" * 300_000 + " a.b@c.example.org " + "1." * 5000
    got = run(spark, [None, "", "no data", long_, "a@b", "1.2.3.4.5.6", "7" * 500])
    assert got[:3] == [None, "", "no data"] and "a.b@" not in got[3] and got[4:] == ["a@b", "1.2.3.4.5.6", "7" * 500]
    assert P.pseudonymise(empty, KEY).count() == 0
    r = P.pseudonymise(docs_of(spark, [TEXT]).withColumn("kinds", F.lit(1)), KEY).first()
    assert list(r.kinds) == ["email", "phone", "card", "card", "ipv4", "secret", "date", "date", "ssn", "iban"] and r.n_pseudonyms == 10


def test_no_python_runs_on_the_executors(spark):
    plan = P.pseudonymise(docs_of(spark, [TEXT]), KEY)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small input with a bad document, copies, a benchmark passage and personal data."""
    d = str(tmp_path_factory.mktemp("in"))
    rng = random.Random(12)
    item = text(rng, 30)
    whole = text(rng, 150)
    near = whole.split()
    near[40] = "other"
    texts = [text(rng, 60), whole, " ".join(near), whole, text(rng, 20) + " " + item + " " + text(rng, 20), "short", "same again " * 60, text(rng, 40) + " mail me.me@x.example.org " + text(rng, 40), None, ""]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, texts


def test_pipeline_stage_by_stage(spark, folder, tmp_path):
    d, texts = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    left = [{0, 1, 2, 3, 4, 7}, {0, 1, 4, 7}, {0, 1, 7}, {0, 1, 7}, {0, 1, 7}]
    for k, ((name, stage), want) in enumerate(zip(corpus_pipeline.STAGES, left, strict=True)):
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert {r.doc_id for r in docs.collect()} == want, name
        if k < 4:
            assert docs.columns == columns
        if k == 3:
            seven = docs.filter("doc_id = 7").first()
            assert "me.me@" not in seven.text and seven.n_chars == len(seven.text)
            assert docs.filter("doc_id = 0").first().text == texts[0]
    assert all(r.round_trip for r in docs.collect())
    whole = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, d).collect()}
    assert whole == {r.doc_id: list(r.ids) for r in docs.collect()}


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
