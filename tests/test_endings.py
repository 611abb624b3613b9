"""Lemmas by endings against a loop over words."""

import random

from vecloom.functions import text

KNOWN = {"a": ["strong", "large", "nice"], "r": ["well"], "n": ["play", "wolf", "box", "man", "church", "bus", "woman", "dish", "city", "s", "goose"], "v": ["play", "swim", "make", "try", "watch", "go", "be"]}
ODD = [("geese", "n", "goose"), ("went", "v", "go"), ("is", "v", "be"), ("better", "a", "good"), ("swimming", "v", "swim")]


def _one(word, pos):
    """The lemma by the published description, one word at a time."""
    known = KNOWN[pos]
    odd = [c for a, b, c in ODD if a == word and b == pos]
    if odd:
        fit = [w for w in [word, *odd] if w in known]
        return min(fit, key=len) if fit else word
    step = lambda forms: [f[: len(f) - len(a)] + b for f in forms for a, b in text.ENDINGS[pos] if f.endswith(a)]
    forms = step([word])
    fit = [w for w in [word, *forms] if w in known]
    while not fit and forms:
        forms = step(forms)
        fit = [w for w in forms if w in known]
    return min(fit, key=len) if fit else word


def _tables(spark):
    return spark.createDataFrame([(w, p) for p, ws in KNOWN.items() for w in ws], "lemma string, pos string"), spark.createDataFrame(ODD, "form string, pos string, lemma string")


def test_examples(spark):
    rows = [(1, "Playing played swimming stronger"), (2, None), (3, ""), (4, "  wolves  Geese unknowns women went is better nicest citieses")]
    known, odd = _tables(spark)
    got = {r.id: r.text for r in text.lemmatize_by_rules(spark.createDataFrame(rows, "id int, text string"), known, odd).collect()}
    assert got == {1: "play play swim strong", 2: None, 3: "", 4: "  wolf  goose unknowns woman go be better nice city"}


def test_made_up_words_against_a_loop(spark):
    g = random.Random(3)
    roots = [w for ws in KNOWN.values() for w in ws] + ["zzz", "mak", "nic", "larg"]
    ends = ["", "s", "es", "ies", "ed", "ing", "er", "est", "ses", "men", "ves"]
    words = sorted({g.choice(roots) + g.choice(ends) + g.choice(ends) for _ in range(500)})
    want = {}
    for w in words:
        final = w
        for pos in text.PARTS_OF_SPEECH:
            final = _one(final, pos)
        if final != w:
            want[w] = final
    known, odd = _tables(spark)
    assert len(want) > 50
    assert {r.word: r.final for r in text.rule_lemmas(spark.createDataFrame([(w,) for w in words], "word string"), known, odd).collect()} == want


def test_long_texts_are_cut_and_words_carry_no_text(spark, monkeypatch):
    """Texts of several pieces, repeated and empty ones, with forms in a map, in a sent table and in a shuffled one."""
    g = random.Random(5)
    words = [f"w{k}" for k in range(40)] + [""]
    texts = [" ".join(g.choices(words, k=n)) for n in (1, 7, 8, 9, 40, 200)] + ["", None, "W1  w2"]
    df = spark.createDataFrame([(i, t, i * 2) for i, t in enumerate(texts + texts)], "id int, text string, other int")
    forms = {f"w{k}": f"v{k}" for k in range(0, 40, 3)}
    changed = spark.createDataFrame(sorted(forms.items()), "word string, final string")
    want = {i: (None if t is None else " ".join(forms.get(w, w) for w in t.lower().split(" ")), 2 * i) for i, t in enumerate(texts + texts)}
    monkeypatch.setattr(text, "PIECE_WORDS", 8)
    for sent, shared in ((200, 200), (3, 200), (3, 2)):
        monkeypatch.setattr(text, "SENT_FORMS", sent)
        monkeypatch.setattr(text, "SENT_WORDS", shared)
        out = text._replaced(df, changed, "text")
        assert out.columns == df.columns and {r.id: (r.text, r.other) for r in out.collect()} == want
