import json
import random

from pyspark.sql import functions as F

from turnmill.llm import overlap
from turnmill.llm.words import portions, word_codes, words


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_common_in_order():
    rng = random.Random(2)
    for _ in range(60):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert overlap.common_in_order(a, b) == lcs(a, b)


def test_words():
    assert words("Don’t <b>stop</b> &amp; [see](http://x.y/z) **Ｎow**​") == ["dont", "stop", "see", "now"]
    assert words("") == []


def test_portions():
    assert list(portions([])) == [] and list(portions([5], 3)) == [(0, 1)]
    assert list(portions([1, 1, None, 1, 9, 1, 2, 2], 3)) == [(0, 4), (4, 5), (5, 7), (7, 8)]


def test_word_codes_are_those_of_words():
    texts = ["Don’t <b>stop</b> &amp; [see](http://x.y/z) **Ｎow**​", "", "İstanbul a_b ﬁ", "one two ONE", "\ud800 lone", "'", "é\u0301 x"]
    codes, bounds = word_codes(texts)
    own = [codes[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]
    known = {}
    for t, c in zip(texts, own, strict=True):
        assert len(c) == len(words(t))
        assert all(known.setdefault(w, x) == x for w, x in zip(words(t), c, strict=True))
    assert len(set(known.values())) == len(known) and own[3][0] == own[3][2]


def _chain(text):
    return json.dumps([{"role": "user", "content": text[: len(text) // 2]}, {"role": "assistant", "content": text[len(text) // 2 :]}, {"role": "user", "content": None}, 5])


def test_against_all_pairs(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(40, 120))] for _ in range(40)]
    texts = []
    for t in base:
        texts.append(t)
        for share in (0.0, 0.05, 0.1, 0.3):
            texts.append([rng.choice(vocabulary) if rng.random() < share else w for w in t])
    rows = [("t", i, rng.choice(["train", "train", "validation", "test"]), "s", _chain(" ".join(t))) for i, t in enumerate(texts)]
    rows += [("t", 900, "test", "s", None), ("t", 901, "train", "s", "broken"), ("t", 902, "train", "s", "[]"), ("t", 903, "train", "s", '[{"content": "one"}]'), ("t", 904, "test", "s", '[{"content":"*ONE!*"},{"content":null}]')]
    df = spark.createDataFrame(rows, "tbl string, id long, split string, source string, conversation string").withColumn("is_train", F.col("split") == "train")
    p = overlap.prepare(df, F.col("conversation"))
    got = {(r.id_a, r.id_b) for r in overlap.cross_split_pairs(p, overlap.same_classes(p)).collect()}
    side = {r[1]: r[2] == "train" for r in rows}
    ws = {r[1]: [w for t in json.loads(r[4]) if isinstance(t, dict) for w in words(t["content"] or "")] for r in rows if r[4] and r[4] != "broken"}
    want = {(a, b) for a in ws for b in ws if a < b and side[a] != side[b] and ws[a] and ws[b] and lcs(ws[a], ws[b]) >= 0.8 * max(len(ws[a]), len(ws[b]))}
    assert not got - want and len(got) >= 0.98 * len(want) and (903, 904) in got
    r = overlap.overlap_report(p, overlap.same_classes(p)).collect()
    assert sum(x.overlapping for x in r) == len({x for ab in got for x in ab if not side[x]})


def test_pairs_at_the_bound(spark):
    """Every fifth word changed: four fifths of the words stand in order, with the fewest common shingles."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows = []
    for i in range(300):
        t = [word() for _ in range(120)]
        rows.append(("t", 2 * i, "train", "s", _chain(" ".join(t))))
        rows.append(("t", 2 * i + 1, "test", "s", _chain(" ".join(word() if k % 5 == 2 else w for k, w in enumerate(t)))))
    df = spark.createDataFrame(rows, "tbl string, id long, split string, source string, conversation string").withColumn("is_train", F.col("split") == "train")
    p = overlap.prepare(df, F.col("conversation"))
    got = {(r.id_a, r.id_b) for r in overlap.cross_split_pairs(p, overlap.same_classes(p)).collect()}
    assert got <= {(2 * i, 2 * i + 1) for i in range(300)} and len(got) >= 298


def test_recall_by_length_and_kind_of_change(spark):
    """A share of the words changed one by one, or left out here and put in there, in texts of 25 to 300 words; all are at the bound or above."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows, want = [], []
    for n in (25, 60, 100, 300):
        for share in (0.1, 0.15, 0.19, 0.2):
            for moved in (False, True):
                for _ in range(15):
                    t = [word() for _ in range(n)]
                    k = int(n * share)
                    gone = set(rng.sample(range(n), k))
                    other = [word() if i in gone and not moved else w for i, w in enumerate(t) if not (moved and i in gone)]
                    for _ in range(k if moved else 0):
                        other.insert(rng.randint(0, len(other)), word())
                    at = len(rows)
                    rows += [("t", at, "train", "s", _chain(" ".join(t))), ("t", at + 1, "validation", "s", _chain(" ".join(other)))]
                    # the turns of a chain may divide a word
                    x, y = ([w for turn in json.loads(r[4])[:2] for w in words(turn["content"])] for r in rows[-2:])
                    if lcs(x, y) >= 0.8 * max(len(x), len(y)):
                        want.append((at, at + 1))
    df = spark.createDataFrame(rows, "tbl string, id long, split string, source string, conversation string").withColumn("is_train", F.col("split") == "train")
    p = overlap.prepare(df, F.col("conversation"))
    got = {(r.id_a, r.id_b) for r in overlap.cross_split_pairs(p, overlap.same_classes(p)).collect()}
    assert len(want) > 400 and got <= set(want) and len(got) >= 0.98 * len(want)


def test_hot_class_and_hot_bucket(spark, monkeypatch):
    """Buckets worked in parts and classes in several lists give the same pairs."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    t = [word() for _ in range(50)]
    texts = [t] * 60 + [[word() if k == i % 50 else w for k, w in enumerate(t)] for i in range(40)]
    rows = [("t", i, "test" if i % 7 == 0 else "train", "s", _chain(" ".join(x))) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "tbl string, id long, split string, source string, conversation string").withColumn("is_train", F.col("split") == "train")
    want = {(min(a, b), max(a, b)) for a in range(100) for b in range(100) if a % 7 == 0 and b % 7}
    for hot, part in ((2_000, 20_000), (3, 10)):
        monkeypatch.setattr(overlap, "HOT", hot)
        monkeypatch.setattr(overlap, "CLASS_ROWS", part)
        p = overlap.prepare(df, F.col("conversation"))
        assert bool(p.hot) == (hot == 3)
        assert {(r.id_a, r.id_b) for r in overlap.cross_split_pairs(p, overlap.same_classes(p)).collect()} == want


def test_empty(spark):
    df = spark.createDataFrame([], "tbl string, id long, split string, source string, conversation string, is_train boolean")
    p = overlap.prepare(df, F.col("conversation"))
    assert overlap.cross_split_pairs(p, overlap.same_classes(p)).count() == 0
