import random

import pytest

from marlstone.llm import near_dup
from marlstone.llm.components import components


def shingle_set(text, words):
    w = (text or "").encode().lower().split()
    return {tuple(w)} - {()} if len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def brute(rows, words=3, percent=85):
    sets = {}
    for d, t in rows:
        sets.setdefault(d, shingle_set(t, words))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def check(df, rows):
    want = brute(rows)
    for r in near_dup.near_duplicates(df).collect():
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)


def test_matches_brute_force(documents, rows):
    check(documents, rows)


def test_odd_rows(odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect() if r.doc_id is not None]
    check(odd_documents, rows)
    assert near_dup.near_duplicates(no_documents).count() == 0


def test_large_group_of_near_copies_and_a_common_passage(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    base = [word() for _ in range(120)]
    passage = [word() for _ in range(25)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join([*(word() for _ in range(rng.randint(5, 80))), *passage])) for i in range(120)]
    rows += [(2000 + i, " ".join(word() for _ in range(rng.randint(1, 9)))) for i in range(20)]
    rows += [(3000 + i, rows[-1 - i][1] + " more") for i in range(20)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_short_text_inside_a_longer_one_in_a_long_list(spark, words, percent):
    """All meet in long lists of the passage only; the longer text's sketch hides much of the shorter one."""
    rng = random.Random(1)

    def longer(text, many, low, high):
        """Words are added so that the values of the new shingles lie between the given parts of their range."""
        text = list(text)
        for _ in range(many):
            while True:
                word = "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
                if len(text) < words - 1:
                    break
                value = int(near_dup.shingles([" ".join([*text[1 - words :], word]).encode()], words)[0][0])
                if low <= value / 2**63 < high:
                    break
            text.append(word)
        return text

    passage = longer([], 40 + words - 1, 0, 0.4)
    short = longer(passage, 23, 0.9, 1)
    long = longer(short, 63 * 100 // percent - 63, 0.4, 0.8)
    rows = [(i, " ".join(longer(passage, 24, 0.4, 0.8))) for i in range(70)] + [(500, " ".join(short)), (501, " ".join(long))]
    want = brute(rows, words, percent)
    assert want[500] == (63, 500) and want[501] == (63 * 100 // percent, 500)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want


def test_company_allows_for_what_a_partner_hides():
    for percent in (80, 85):
        for n in range(1, near_dup.SKETCH):
            for m in range(1, 2 * n + 1):
                for both in range(1, min(n, m) + 1):
                    if 100 * both >= percent * (n + m - both):
                        assert both - max(0, m - near_dup.SKETCH) >= near_dup.least_company(n, percent)


def test_first_of_each_keeps_columns(documents, rows):
    kept = near_dup.first_of_each(documents)
    want = brute(rows, 5, 80)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (_, c) in want.items() if c == d)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(7, 7), (None, 3), (100, 90), (100, 90)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 100: 90}


def test_ids_with_several_texts_and_repeated_rows(spark):
    """Rows with an id are one document: groups of all its texts are one group, and one row of equal ones stays."""
    words = "one two three four five six seven eight nine ten".split()
    a, b = " ".join(words), " ".join(reversed(words))
    rows = [(3, a, 1), (5, a, 2), (5, b, 3), (9, b, 4), (9, b, 5), (11, "else", 6), (11, "else", 7), (None, a, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Copy int")
    got = {(r.doc_id, r.component_id) for r in near_dup.near_duplicates(df).collect()}
    assert got == {(3, 3), (5, 3), (9, 3), (11, 11), (None, None)}
    kept = near_dup.first_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, a), (3, a), (11, "else")]
