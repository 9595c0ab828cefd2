"""Finding on op1_toxicity: words are split and looked up once, and only those that can have a chosen term are taken apart."""
import collections
import random
import re

from finfacts.llm import toxicity


def test_words_without_a_term_are_not_taken_apart(monkeypatch):
    apart = []
    monkeypatch.setattr(toxicity, "features", lambda w, f=toxicity.features: apart.append(w) or f(w))
    terms = {"vil*": 0, "bad": 1, "vile": 2, "of": 3, "über*": 4}
    lex = toxicity.Lexicon(terms, {"good": 0, "bad": 1, "of": 2, "überall": 3})
    text = "Vile of BADLY off Überall bad " + " ".join(f"word{k}" for k in range(500))
    c = lex.count(text)
    assert set(apart) == {"vile", "of", "badly", "überall", "bad"}
    assert c.terms == {0: 1, 2: 1, 3: 1, 4: 1, 1: 1} and c.rest == 502
    assert dict(zip(c.words.tolist(), c.times.tolist())) == {2: 1, 1: 1, 3: 1} and len(c.strange) == 503


def test_ascii_texts_have_the_words_of_the_expression():
    rng = random.Random(3)
    texts = ["".join(map(chr, range(128))), "".join(f"{chr(k)}x" for k in range(128)), "", "\x1c\x1d\x1e\x1f a_b-C'd\x0b\x85 e", "É\x85à ſS ǅ"]
    texts += ["".join(rng.choice("aB3_ .\n\x00\x1f'é") for _ in range(60)) for _ in range(200)]
    for t in texts:
        assert toxicity.words_of(t) == re.findall(r"\w+", t.lower())
    lex = toxicity.Lexicon({}, {})
    for t in texts:
        words = collections.Counter(re.findall(r"\w+", t.lower()))
        c = lex.count(t)
        assert sorted(c.strange) == sorted(words.values()) and c.rest == sum(words.values()) and not c.terms
