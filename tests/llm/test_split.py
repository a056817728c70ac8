import random

from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import split as S


def check(text, limit, overlap):
    pieces = S.cuts(text, limit, overlap)
    over = S.effective_overlap(limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b, _), (c, d, _) in zip(pieces, pieces[1:]):
        assert c == b - over and d > b
    assert all(b - a <= limit for a, b, _ in pieces)
    return pieces


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n\r,é́👩‍🔬。中", max_size=400), st.integers(1, 60), st.integers(0, 80))
def test_pieces_cover_the_text(text, limit, overlap):
    check(text, limit, overlap)


def test_natural_boundaries():
    text = "\n\n".join(f"Paragraph {k} has a sentence. And another one." for k in range(40))
    kinds = {k for *_, k in check(text, 200, 20)}
    assert kinds <= {"paragraph", "end"}
    assert {k for *_, k in check("One two three four. " * 50, 90, 10)} == {"sentence", "end"}


def test_code_is_cut_last():
    text = "Intro text here.\n\n" + "```\n" + "x = 1\n" * 20 + "```\n\n" + "Outro text here. " * 10
    ends = [b for _, b, _ in check(text, 200, 0)]
    a, b = text.index("```"), text.rindex("```") + 3
    assert not any(a < e < b for e in ends)


def plain_minimum(places, pens, limit, overlap, target):
    cost = [0.0] + [float("inf")] * (len(places) - 1)
    for j in range(1, len(places)):
        for i in range(j):
            length = places[j] - places[i] + (overlap if i else 0)
            if length <= limit:
                cost[j] = min(cost[j], cost[i] + S.IMBALANCE * ((length - target) / limit) ** 2 + pens[j] + S.EACH)
    return cost[-1]


@settings(max_examples=120, deadline=None)
@given(st.integers(0, 10**6), st.integers(20, 120), st.integers(0, 30))
def test_minimum_over_all_boundaries(seed, limit, overlap):
    """The cuts cost what plain dynamic programming over every boundary finds."""
    r = random.Random(seed)
    words = lambda n: " ".join("w" * r.randint(1, 9) + r.choice(["", "", "", ",", "."]) for _ in range(n))
    text = r.choice(["\n\n", "\n", " ", "\r\n"]).join(words(r.randint(1, 25)) for _ in range(r.randint(1, 8)))
    if r.random() < 0.3:
        text += "\n```\n" + "\n".join(words(3) for _ in range(5)) + "\n```\n| a | b |\n| c | d |\nend of it"
    if len(text) <= limit:
        return
    over = S.effective_overlap(limit, overlap)
    step = limit - over
    least = 1 + max(0, -(-(len(text) - limit) // step))
    target = (len(text) + (least - 1) * over) / least
    every = S.Boundaries(text)
    every.add(S.CLAUSE, step)
    every.add(S.WORD, step)
    places, pens = every.places()
    if (want := plain_minimum(places.tolist(), pens.tolist(), limit, over, target)) == float("inf"):
        every.add(S.GRAPHEME, step)
        places, pens = every.places()
        want = plain_minimum(places.tolist(), pens.tolist(), limit, over, target)
    pen_at = dict(zip(places.tolist(), pens.tolist()))
    pieces = check(text, limit, overlap)
    got = sum(S.IMBALANCE * ((b - a - target) / limit) ** 2 + pen_at[b] + S.EACH for a, b, _ in pieces)
    assert abs(got - want) < 1e-6


def test_clusters_stay_whole():
    text = "👩‍🔬é" * 300
    for _, end, _ in check(text, 50, 5):
        assert end == len(text) or S._safe(text, end)


def test_long_text_without_boundary():
    check("x" * 200_000, 600, 50)
    assert len(S.cuts("", 10, 2)) == 1 and S.cuts("abc", 10, 2) == [(0, 3, "end")]


def test_operator(spark):
    pages = spark.createDataFrame(
        [(1, "w", "One two. " * 100, 5), (2, "none", "x" * 5000, 6), (3, "w", None, 7), (4, None, "", 8), (5, "w", "short", 9), (5, "w", "short", 9), (6, "z", "y" * 4001, 1)], "rev_id long, wiki string, body string, cuts int"
    )
    config = spark.createDataFrame([("w", 100, 10), ("w", 100, 10), ("z", 0, None)], "wiki string, max_text_chars int, overlap_chars int")
    rows = S.split_oversized(pages, config).orderBy("rev_id", "piece_no").collect()
    of = lambda k: [r for r in rows if r.rev_id == k]
    assert not of(3) and [r.piece for r in of(4)] == [""] and len(of(5)) == 2
    assert [len(r.piece) <= 100 for r in of(1)] == [True] * len(of(1)) and of(1)[1].piece.startswith(of(1)[0].piece[-10:])
    assert len(of(2)) == 2 and len(of(6)) == 2 and of(2)[0].n_pieces == 2
    assert S.split_oversized(pages.limit(0), config.limit(0)).count() == 0
