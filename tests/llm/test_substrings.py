import hashlib
import random

import numpy as np

from marlstone.llm import substrings


def brute(rows):
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            else:
                seen.add(b[i : i + 100])
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def check(df, rows, **how):
    got = sorted((tuple(r) for r in substrings.remove_repeats(df, **how).collect()), key=str)
    assert got == brute(rows)


def test_matches_brute_force(documents, rows):
    check(documents, rows)


def test_heavy_leads_by_windows(documents, rows):
    check(documents, rows, heavy=1)


def test_odd_rows(odd_documents, no_documents):
    check(odd_documents, [(r.doc_id, r.text) for r in odd_documents.collect()])
    assert substrings.remove_repeats(no_documents).count() == 0


def test_planted_passages(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = text(400)
    rows = [(i, text(rng.randint(0, 200)) + shared[rng.randint(0, 150) : rng.randint(200, 400)] + text(rng.randint(0, 200))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(200, "ab" * 300), (201, "ab" * 300 + "c")]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)


def test_multikey_sort():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 3, (500, 30)).astype(np.uint8)
    rows[::7] = rows[0]
    order, common = substrings.multikey(rows)
    texts = [bytes(rows[k]) for k in order]
    assert texts == sorted(texts)
    for k in range(1, len(texts)):
        want = next((i for i in range(30) if texts[k][i] != texts[k - 1][i]), 30)
        assert common[k] == want
