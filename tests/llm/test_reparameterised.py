"""Recall and precision of decontamination on hundreds of benchmark items with other numbers, names and units."""

import random

from notelake.llm import templates

from .conftest import docs_of

# Each pattern has slots: N numbers, P persons, U units; a slot's index tells which are the same.
PATTERNS = [
    "{P0} buys {N0} boxes with {N1} pencils in each box and gives {N2} of them to {P1}, so how many pencils does {P0} keep?",
    "A train leaves the old station and travels {N0} {U0} before it meets {P0}, who has walked {N1} {U0} along the river; how far apart were they?",
    "If {P0} saves {N0} dollars every week and spends {N1} dollars on lunch, after how many weeks can {P0} buy a bicycle for {N2} dollars?",
    "The garden that {P0} waters is {N0} {U0} long and {N1} {U0} wide, and a fence around it costs {N2} dollars; what does one side cost?",
    "In the library {P0} reads {N0} pages on the first evening and {N1} pages on the second, while {P1} reads twice as many pages as {P0} altogether; how many is that?",
]
PEOPLE = [n for n in templates.NAMES if n not in ("Mark", "May")]
LENGTHS = "km miles meters feet yards inches".split()
NOUNS = "lantern copper harbour violet engine meadow saddle ribbon thunder marble pepper castle needle orchard blanket".split()
FILL = "the of and a in was by for with as on that at from his her their this which had not are but were one into than time over only some could".split()


def made(rng, pattern, own):
    """A question of a pattern with a clause of its own words, so that items differ in more than slots."""
    p, n = rng.sample(PEOPLE, 2), rng.sample(range(3, 900), 3)
    return own + " " + pattern.format(P0=p[0], P1=p[1], N0=n[0], N1=n[1], N2=n[2], U0=rng.choice(LENGTHS))


def test_recall_and_precision(spark):
    rng = random.Random(17)
    clauses = [f"Near the {' '.join(rng.sample(NOUNS, 3))} there is something to work out." for _ in range(300)]
    items = [made(rng, PATTERNS[i % 5], c) for i, c in enumerate(clauses)]
    fill = lambda n: " ".join(rng.choice(FILL) for _ in range(n))
    wrap = lambda t: f"{fill(rng.randrange(5, 60))}. {t} {fill(rng.randrange(5, 60))}"
    again = [wrap(made(rng, PATTERNS[i % 5], c)) for i, c in enumerate(clauses)]  # other values in every slot
    verbatim = [wrap(t) for t in items[:100]]
    clean = [fill(120) for _ in range(200)] + [wrap(f"{rng.choice(PEOPLE)} paid {rng.randrange(9)} dollars for {rng.randrange(90)} {rng.choice(NOUNS)}s and left {fill(6)}.") for _ in range(200)]
    docs = [*again, *verbatim, *clean]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.exact for r in templates.contaminated(docs_of(spark, docs), bench).collect()}
    own = sum((i, i) in found for i in range(300))
    marked = {d for d, _ in found}
    print(f"re-parameterised {own} of 300, verbatim {sum(300 + i in marked for i in range(100))} of 100, clean marked {sum(d >= 400 for d in marked)} of 400")
    assert own >= 0.9 * 300
    assert all(found.get((300 + i, i)) for i in range(100))
    assert not any(d >= 400 for d in marked)
    assert not any(found.get((i, i), False) for i in range(300))  # no slot kept its value by rule, so none is called exact


def test_inconsistent_slots_are_no_copies(spark):
    """The same person in one place of the item and two in the text: only the rest of the item can still match."""
    item = "Tom had 12 shells and Tom lost 5 shells so Tom counted how many shells remained for Tom and then Tom found 12 more"
    wrong = "Ann had 31 shells and Peter lost 8 shells so Julia counted how many shells remained for Karen and then Emma found 77 more"
    right = "Ann had 31 shells and Ann lost 8 shells so Ann counted how many shells remained for Ann and then Ann found 31 more"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [(r.doc_id, r.exact) for r in templates.contaminated(docs_of(spark, [wrong, right, item]), bench).orderBy("doc_id").collect()] == [(1, False), (2, True)]
