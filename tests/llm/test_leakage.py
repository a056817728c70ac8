import random

from pagewright.llm import leakage as L

WORDS = [a + b + c for a in ("bra", "kel", "mos", "tri", "und", "wex") for b in ("den", "lo", "mir", "sta") for c in ("ge", "ry", "tho", "", "nd")]


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
    return d[-1]


def brute(pattern, text, least=L.RUN_WORDS):
    n = len(pattern)
    for s in range(n - least + 1):
        for e in range(s + least, n + 1):
            budget = (e - s) // L.ONE_IN
            for a in range(len(text)):
                for b in range(a + max(1, e - s - budget), min(len(text), a + e - s + budget) + 1):
                    if edits(pattern[s:e], text[a:b]) <= budget:
                        return True
    return False


def test_alignment_is_exact():
    r = random.Random(4)
    got = []
    for _ in range(30):
        p = [r.choice(WORDS) for _ in range(r.randint(12, 15))]
        t = [w for w in p if r.random() > r.choice([0.1, 0.2, 0.3])]
        for _ in range(r.randint(0, 4)):
            t.insert(r.randrange(len(t)), r.choice(WORDS))
        item = L.make_item(1, " ".join(p))
        s = L.stream([" ".join(t)])
        got.append(L.aligned(item, L.words(s.chars, s.word), -15, 15, 0, len(p) - 1))
        assert got[-1] == brute(p, t), (p, t)
    assert 5 < sum(got) < 25


def test_filter_loses_nothing():
    """Runs of 12, 15 and 20 words with the full budget of edits, long added words among them, and Chinese runs."""
    r = random.Random(11)
    for k in range(150):
        n = r.choice([12, 13, 15, 20])
        p = [r.choice(["a", "of", "it", *WORDS]) for _ in range(30)]
        at = r.randint(0, 30 - n)
        part = p[at : at + n]
        for _ in range(n // L.ONE_IN):
            spot = r.randrange(len(part))
            part[spot : spot + r.choice([0, 1])] = r.choice([[], ["x" * r.randint(1, 90)]])
        text = " ".join([*(r.choice(WORDS) for _ in range(40)), *part, *(r.choice(WORDS) for _ in range(40))])
        assert L.leaks([text], [L.Gallery([L.make_item(7, " ".join(p))])]) == [[7]] or not brute(p, text.split()), k
    for k in range(60):
        p = [chr(0x4E00 + r.randint(0, 300)) for _ in range(60)]
        at = r.randint(0, 30)
        part = p[at : at + 30]
        for spot in r.sample(range(2, 28), 6):
            part[spot] = r.choice(["", "\u3400", part[spot] + "\u3401"])
        text = "".join(chr(0x4E00 + r.randint(400, 900)) for _ in range(50)) + "".join(part)
        assert L.leaks([text], [L.Gallery([L.make_item(7, "".join(p))])]) == [[7]], k


def test_short_words_and_hot_grams(monkeypatch):
    """Items of one-letter words get a smaller q; galleries are halved where a text shares very many grams with them."""
    letters = "a b c d e f g h i j k l m n o p"
    item = L.make_item(1, letters)
    assert item.q < L.Q_WORDS and item.bound >= 2
    text = "zz zz " + letters.replace(" e ", " q ").replace(" j ", " ") + " zz"
    assert L.leaks([text], [L.Gallery([item])]) == [[1]]
    items = [L.make_item(k, f"{letters} {k} one two three") for k in range(9)]
    want = L.leaks([text], [L.Gallery(items)])
    monkeypatch.setattr(L, "MOST_HITS", 20)
    assert sorted(L.leaks([text], [L.Gallery(items)])[0]) == sorted(want[0]) == list(range(9))


def damage(words, r, n):
    out = list(words)
    for at in r.sample(range(len(out)), n):
        out[at] = r.choice(["seven", "", out[at] + " marble"])
    return [w for w in out if w]


def test_planted(spark):
    r = random.Random(7)
    items, docs, want = [], [], set()
    for k in range(12):
        items.append((k, "s", " ".join(r.choice(WORDS) + str(r.randint(1, 99)) for _ in range(40)) + "."))
    han = "".join(chr(0x4E00 + r.randint(0, 3000)) for _ in range(90))
    items.append((50, "s", han))
    filler = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    for k in range(60):
        i = r.randrange(12)
        words = items[i][2].split()
        n = r.choice([6, 7, 12, 15, 25])
        at = r.randint(0, 40 - n)
        part = words[at : at + n]
        if n >= 12 and r.random() < 0.7:
            part = damage(part, r, n // 5)
        style = r.choice([str, str.upper, lambda s: s.replace(" ", "\n> "), lambda s: "**" + s + "**", lambda s: s.replace("a", "а")])
        docs.append((k, filler(30) + ".\n\n" + style(" ".join(part)) + "\n\n" + filler(20)))
        if n >= 12:
            want.add((k, i))
    docs += [(100, "前言。" + han[10:40] + "，后记"), (101, "前言" + han[10:22] + "后记"), (102, "，".join(han[10:50])), (103, None), (104, ""), (105, "é" * 100_000), (100, "repeat")]
    want |= {(100, 50), (102, 50)}
    df = spark.createDataFrame([(a, b, "c") for a, b in docs], "doc_id long, text string, item_id string")
    it = spark.createDataFrame([*items, (60, "s", None), (61, "s", "too short"), items[0]], "item_id long, suite string, text string")
    assert {tuple(x) for x in L.find_leaks(df, it).collect()} == want
    assert L.find_leaks(df.limit(0), it).count() == 0 and L.find_leaks(df, it.limit(0)).count() == 0


def test_links_and_forms():
    text = "See [the " + "brown fox](http://e.org/a/b) jumps <b>over</b> the lazy dog while nine tall oaks sway"
    item = L.make_item(1, "See the brown fox jumps over the lazy dog while nine tall oaks sway")
    assert L.leaks([text], [L.Gallery([item])]) == [[1]]
