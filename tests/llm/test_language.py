import random

import pytest

from pagewright.llm import language as G
from pagewright.session import table


def test_labels():
    good = {"en": ["en", "EN", "en-US", "en_GB", "eng", "English", " english "], "zh": ["zh-Hans", "zho", "中文"], "de": ["deu", "ger", "de_AT", "Deutsch"], "pt": ["pt-BR", "Portuguese"]}
    assert all(G.label_language(x) == k for k, v in good.items() for x in v)
    assert [G.label_language(x) for x in (None, "", " ", "und", "xx", "n/a", "text", "unknown", "it")] == [None] * 9


def test_prose():
    text = '---\ntitle: The title of it\n---\n# A heading of words\n\nFirst sentence here is. Second one “à la carte” follows!\n\n```\ncode is not prose at all\n```\n\n| a | b |\n|---|---|\n\n- An item of the list\n> A quoted line of text\n> goes on here.\n\nword\n\n中文句子在这里。第二个句子也在。'
    assert G.sentences(text) == ["First sentence here is.", "Second one   follows!", "An item of the list", "A quoted line of text goes on here.", "中文句子在这里。", "第二个句子也在。"]
    assert G.sentences("") == [] and G.sentences("---\nopen") is not None


def test_suffix_automaton():
    text = [ord(c) for c in "abcbcabab"]
    moves = G.suffix_automaton(text)
    parts = {tuple(text[i:j]) for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    for n in range(1, 5):
        from itertools import product

        for p in product(map(ord, "abc"), repeat=n):
            s = 0
            for c in p:
                s = moves[s].get(c, -1) if s >= 0 else -1
            assert (s >= 0) == (p in parts)


def test_phrases_are_greedy_longest_matches():
    m = G.Model({"en": ["the cat sat on the mat", "dogs run"], "de": ["der hund lief"]})
    counts, _ = m.phrases(["the cat on", "zzz"])
    plain = " the cat sat on the mat "

    def greedy(t):
        n, at = 0, 0
        while at < len(t):
            k = 1
            while at + k < len(t) and (t[at : at + k + 1] in plain or t[at : at + k + 1] in " dogs run "):
                k += 1
            n, at = n + 1, at + k
        return n

    assert counts[0, m.langs.index("en")] == greedy("the cat on ")


def test_path():
    import numpy as np

    a, b = [1.0, 9.0], [9.0, 1.0]
    assert G.path(np.array([a, a, b, b, a])) == [0, 0, 1, 1, 0]
    assert G.path(np.array([a, [2.0, 1.0], a])) == [0, 0, 0]


def test_held_out_accuracy(spark, data):
    samples = table(spark, data, "lang_samples").toPandas()
    train, test = samples[samples.sample_id % 3 != 0], samples[samples.sample_id % 3 == 0]
    m = G.Model({k: list(v) for k, v in train.groupby("lang").text})
    rows = G.segments(m, list(range(len(test))), list(test.text))
    best = {}
    for r in rows:
        if r[0] not in best or best[r[0]][5] < r[5]:
            best[r[0]] = r
    right = [best[k][2] == lang for k, lang in enumerate(test.lang) if k in best]
    assert sum(right) / len(right) > 0.9 and all(0 < r[3] <= 1 for r in rows)


def test_operator(spark, data):
    samples = table(spark, data, "lang_samples")
    texts = {r.lang: [x.text for x in samples.filter(f"lang = '{r.lang}'").orderBy("sample_id").collect()] for r in samples.select("lang").distinct().collect()}
    two = lambda k: " ".join(texts[k][:4])
    docs = [(1, two("en"), "en"), (2, two("en"), "de"), (3, two("fr"), None), (4, two("en") + "\n\n" + two("de"), "en-GB"), (5, None, "en"), (6, "", None), (7, "| a | b |\n|---|---|", "x"), (None, two("ja"), None), (2, two("en"), "de"), (8, two("ru") * 400, "ru")]
    df = spark.createDataFrame([(a, b, c, "s") for a, b, c in docs], "doc_id long, text string, lang string, runs string")
    got = sorted(map(tuple, G.language_cases(df, samples).collect()))
    assert got == [(2, "en"), (3, "fr"), (4, "de"), (4, "en")]
    assert G.language_cases(df.limit(0), samples).count() == 0 and G.language_cases(df, samples.limit(0)).count() == 0


def test_double_array_is_the_automaton():
    import numpy as np

    r = random.Random(2)
    text = [r.choice([1, 2, 3, 40, 41, 90]) for _ in range(1500)]
    moves = G.suffix_automaton(text)
    d = G.DoubleArray(moves, 90)
    for s, m in enumerate(moves):
        for c in range(91):
            at = d.base[s] + c
            assert (int(d.target[at]) if d.owner[at] == s else -1) == m.get(c, -1)
    assert len(d.owner) < 2 * sum(map(len, moves)) + 400
    # long stretches, parsed one by one, and short ones together
    parts = sorted([[r.choice([0, 1, 2, 3, 40]) for _ in range(n)] for n in [3000, 900, *[20] * 30]], key=len, reverse=True)
    size = np.array([len(p) for p in parts])
    got = d.parse(np.array(sum(parts, [])), np.cumsum(size) - size, size)
    for p, n in zip(parts, got.tolist()):
        s, want = 0, 1
        for c in p:
            nxt = moves[s].get(c, -1)
            s, want = (nxt, want) if nxt >= 0 else (moves[0].get(c, 0), want + 1)
        assert n == want


def test_front_matter_of_any_length():
    head = "---\n" + "".join(f"key{k}: a value of some words here\n" for k in range(900)) + "---\n"
    assert G.sentences(head + "The one sentence of prose.") == ["The one sentence of prose."]
    assert len(G.sentences("---\nThis is a rule and not front matter.\n\n---\n")) == 1


@pytest.mark.parametrize("text", ["x" * 100_000, "。" * 5000, "a. " * 3000])
def test_odd_texts(text):
    m = G.Model({"en": ["the cat sat"], "zh": ["中文句子"]})
    G.segments(m, [1], [text])
