import hashlib
import zlib

from pyspark.sql import functions as F

from marlstone.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def ascii_lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([h(*found[-1][i : i + 16]) for i in range(0, len(found[-1]), 16)])
    return found


def climb(tree, i, node):
    """Siblings from below, and the last digest with ``node`` in place of its own."""
    out = []
    for level in tree[:-1]:
        run = level[i // 16 * 16 : i // 16 * 16 + 16]
        before, after = run[: i % 16], run[i % 16 + 1 :]
        out += before + after
        node = h(*before, node, *after)
        i //= 16
    return out, node


def by_hand(rows):
    leaf = [h(*map(framed, r)) for r in rows]
    groups = {}
    for r, own in zip(rows, leaf):
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, own, r))
    for g in groups.values():
        g.sort(key=lambda x: x[:3])
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in groups[s]]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    root = top[-1][0] if names else None
    out = []
    for k, s in enumerate(names):
        for i, (_, _, own, r) in enumerate(groups[s]):
            changed = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                changed = h(*map(framed, (*r[:4], ascii_lower(r[4]))))
            low, end = climb(trees[s], i, changed)
            high, folded = climb(top, k, end)
            out.append((r[0], own, trees[s][-1][0], root, h(*low, *high), folded, folded == root))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def check(df):
    want = by_hand([tuple(r) for r in df.select(COLUMNS).collect()])
    got = merkle.verified_documents(df).collect()
    assert sorted(map(tuple, got), key=str) == want
    return got


def test_documents_by_hand(documents):
    got = check(documents)
    assert 0 < sum(not r.verified for r in got) < len(got)


def test_odd_rows(odd_documents, no_documents):
    check(odd_documents)
    assert merkle.verified_documents(no_documents).count() == 0


def test_hot_and_lone_groups(spark):
    """One group of three levels and hundreds of groups of one row, a null group among them."""
    rows = [(i, "hot", "en", 1, f"Text {i}") for i in range(600)] + [(i, f"s{i}" if i % 50 else None, None, None, None) for i in range(1000, 1300)]
    check(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5))


def test_a_proof_holds_for_its_leaf_only(spark):
    rows = spark.createDataFrame([(i, "a" if i < 40 else "b", f"{i:064x}") for i in range(50)], "key long, grp string, leaf string")
    proved = merkle.manifest(rows, "grp", "key")
    again, other = merkle.folded(F.col("leaf"), F.col("path")), merkle.folded(F.sha2("leaf", 256), F.col("path"))
    for r in proved.select((again == F.col("root")).alias("own"), (other == F.col("root")).alias("other"), F.size("path").alias("n")).collect():
        assert r.own and not r.other and r.n in (2, 3)
