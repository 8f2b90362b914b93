import os

import pytest
from pyspark.sql import functions as F

from turnmill.llm import abuse, budget, defects, garbled, leakage, personal, tokenizer
from turnmill.llm.queries import TOKENIZERS
from turnmill.llm.words import Hashes

BPE, PIECES = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", f"{TOKENIZERS}/piece_bpe_32k.model"
needs_files = pytest.mark.skipif(not os.path.exists(BPE), reason="no vocabulary files")


@needs_files
def test_encoding(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    own.encode_special_tokens = True
    texts = [None, "", " ", "Hello <|endoftext|> world", "a" * 5000, "x" * 300 + " y " * 200 + "é漢" * 700, "\r\n\t  \n", "=-" * 3000, "don't 12345 ​😀", " " * 3000 + "z"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: [] if t is None else own.encode(t, add_special_tokens=False).ids for i, t in rows}
    for block in (1 << 16, 500):
        got = tokenizer.encode_corpus(df, "doc_id", "text", BPE, block=block).collect()
        assert len(got) == len(rows) and all(r.ids == want[r.doc_id] for r in got)
    assert tokenizer.encode_corpus(df.limit(0), "doc_id", "text", BPE).count() == 0


@needs_files
def test_token_budget(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text]
    count = budget.Counter(budget._trie(PIECES))
    off = [abs(count.text(t) - len(sp.encode(t))) / max(1, len(sp.encode(t))) for t in docs]
    assert sum(off) / len(off) < 0.015 and max(off) < 0.15
    df = spark.createDataFrame([(["a b", None],), ([],), (None,), (["\u0001퟿"],)], "t array<string>")
    assert [r[0] for r in df.select(budget.token_counts(F.col("t"), PIECES)).collect()] == [2, 0, 0, count.text("\u0001퟿")]


def test_best_paths_against_all_segmentations():
    pieces = [("▁a", -1.0), ("b", -2.0), ("bc", -2.5), ("c", -1.5), ("cd", -2.0), ("▁ab", -2.5), ("d", -3.0)]
    count = budget.Counter(budget.Trie.build(pieces))
    weight = dict(pieces)

    def best(s):
        if not s:
            return (0.0, 0)
        out = []
        for k in range(1, len(s) + 1):
            if s[:k] in weight:
                w, n = best(s[k:])
                out.append((weight[s[:k]] + w, 1 + n))
        if s[0] not in weight:
            size = len(s[0].encode())
            w, n = best(s[1:])
            out.append((budget.BYTE * size + w, size + n))
        return max(out)

    for s in ("▁abcd", "▁abcbcd", "▁a", "▁xbcd", "▁abé", "dcb"):
        assert count.segment(s) == best(s)[1]


def test_abuse(spark):
    ex = [(1, "The kettle boils. You are a complete moron.", "abusive"), (2, "I felt like a moron today.", "none"), (3, "The kettle boils again.", "none"), (4, "They breed like rats. The shed is dry.", "hateful"), (5, "Rats live in the shed.", "none"), (6, None, "none")]
    df = spark.createDataFrame(ex, "example_id long, text string, label string")
    idx = abuse.read_index(df, "example_id", "text", "label")
    bad = ["You are a complete moron!", "YOU ARE A COMPLETE M O R O N", "you are a complete mоrоn", "you are a complete m0ron", "Fine. you are a complete moooron"]
    assert all(idx.score(t, {})[0] >= abuse.AFFECTED for t in bad)
    assert all(idx.score(t, {})[0] < abuse.AFFECTED for t in ["I felt like a moron today.", "The kettle boils.", "", "12 34", "Rats live in the shed."])
    # pruning changes nothing
    import math

    def slow(toks):
        q, idf = abuse._features(toks), idx.idf[""]
        norm = math.sqrt(sum((n * (idf[f] if f in idf else 0 if " " in f else idx.unseen)) ** 2 for f, n in q.items()))
        dot = [0.0] * len(idx.ids)
        for f, n in q.items():
            for x, w in zip(*idx.postings.get(f, ((), ())), strict=True):
                dot[x] += n * idf[f] * w
        telling = {f: n * idf[f] for f, n in q.items() if f in idf}
        near = sorted(((d / norm, x) for x, d in enumerate(dot) if d / norm >= abuse.NEAR and (x >= len(idx.held) or idx._agree(telling, x))), key=lambda t: (-t[0], t[1]))[: abuse.NEIGHBOURS]
        return near if any(idx.positive[x] for _, x in near) else []

    for t in bad[:1] + ["they breed like rats in the shed", "i felt like a complete moron", "nobody would miss you at all"]:
        toks = abuse.tokens(abuse.plain(t))
        got = idx.neighbours(toks)
        assert [(round(s, 9), x) for s, x in got if slow(toks)] == [(round(s, 9), x) for s, x in slow(toks)]
    rows = spark.createDataFrame([(1, '[{"content":"ok"},{"content":"You are a complete moron."}]'), (2, None), (3, "broken"), (4, "[]")], "id long, c string")
    got = {r.id: (r.score >= 0.5, r.turn_no) for r in abuse.score_conversations(rows, idx, "id", "c").collect()}
    assert got == {1: (True, 1), 2: (False, None), 3: (False, None), 4: (False, None)}


def test_words_weigh_by_language(spark):
    turn = lambda *texts: __import__("json").dumps([{"content": t} for t in texts])
    rows = [(turn("die Katze", "die Maus"), "de")] * 300 + [(turn("the cat", "I hope you die"), "en")] * 100 + [(None, "en"), ("broken", None), (turn("die"), None)]
    df = spark.createDataFrame(rows, "c string, lang string")
    got = abuse.word_rates(df, "c", "lang", ["die", "cat", "dog"])
    assert got["die", "de"] == 600 / 700 and got["die", "en"] == 100 / 300 and got["die", ""] == 600 / 700 and got["cat", "en"] == 100 / 300 and ("dog", "") not in got
    idx = abuse.build_index([(1, "We met there.", "none", "en"), (2, "I hope you die.", "abusive", "en")], [], rates=got)
    assert idx.idf["en"]["die"] > idx.idf["de"]["die"]


def test_general_phrases_reach_other_wordings(spark):
    """Whole patterns left out of the examples: what is found then comes from the general phrases and what is left."""
    idx = abuse.build_index([(1, "The kettle boils.", "none"), (2, "It rained all day.", "none")], [])
    for t in ("Honestly, you are nothing but a stupid clown", "я тебя найду и убью", "vou quebrar a tua cara amanhã", "Alle Ausländer sind Verbrecher, das weiß jeder", "il faut tuer les juifs"):
        assert idx.score(t, {})[0] >= abuse.AFFECTED, t
    for t in ("I am such a clown", "he called me a moron", "kill the process and start it again", "the refugees opened a bakery", "de repente o processo parou"):
        assert idx.score(t, {})[0] < abuse.AFFECTED, t


def test_abuse_in_long_sentences(spark):
    ex, terms = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("abuse_examples", "abuse_terms"))
    idx = abuse.read_index(ex, "example_id", "text", "label", terms)
    for t in ("She was naked and dripping wet, begging him to take her harder", "We painted fences beside seven lakes, you pathetic loser, because nothing else worked during those long grey winters"):
        assert idx.score(t, {})[0] >= abuse.AFFECTED, t
    for t in ("The moderators removed a comment calling somebody a moron, good call", "We painted fences beside seven lakes because nothing else worked during those long grey winters"):
        assert idx.score(t, {})[0] < abuse.AFFECTED, t


PERSONAL = [
    ("Mail me: jane.doe+x@mail.example.org.", {"email"}), ("Mail me: kwame (at) studio [dot] test", {"email"}), ("Call me on (617) 555-0143 after six.", {"phone"}), ("Ruf mich unter +49 30 23125964 an.", {"phone"}),
    ("They asked for my SSN 000-60-8821 on the form.", {"id_number"}), ("Ich musste die IBAN DE00 1889 7599 6825 6092 99 angeben.", {"id_number"}), ("I live at 62 Quince Drive, Apt 1, Ostermouth 00779 now.", {"address"}), ("Vivo en Calle Alondra Gris 94, 3º B.", {"address"}),
    ("My name is Ingrid Halmsted, happy to help.", {"name"}), ("Ask for J. Zarlwick at the desk.", {"name"}),
    ("The order number was 4455667788, still pending.", set()), ("Version 3.14.159 broke it again.", set()), ("It listens on port 5550 at 10.0.0.1 here.", set()), ("Old Kiln Avenue is closed.", set()), ("Ping @maintainer in the tracker.", set()), ("Saludos, Jonas B.", set()), ("", set()), (None, set()),
]


def test_personal(spark):
    w = personal.trained()
    for t, kinds in PERSONAL:
        assert {k for *_, k in personal.find(t, w)} == kinds, t
    v = '[{"x": 1, "content": "Call me on (617) 555-0143, é"}, {"role": "u", "content": null}, 3]'
    df = spark.createDataFrame([(1, v), (2, '[{"content":"plain"}]'), (3, None), (4, "broken")], "id long, c string")
    assert [(r.id, r.turn_no, r.kind) for r in personal.find_personal(df, "id", "c").collect()] == [(1, 0, "phone")]
    got = {r.id: r.c for r in personal.redact_conversations(df, "c").collect()}
    assert got == {1: v.replace("(617) 555-0143", "[PHONE]"), 2: '[{"content":"plain"}]', 3: None, 4: "broken"}


def test_semi_markov_sums():
    """Posteriors against the sum over all sets of spans that do not overlap."""
    import itertools
    import math

    cands = [(0, 4, "a", ("x",)), (2, 6, "a", ("y",)), (4, 9, "b", ("x",)), (7, 9, "b", ("y",)), (0, 9, "a", ("z",))]
    weights = {("a", "x"): 0.4, ("a", "y"): -0.3, ("b", "x"): 1.1, ("b", "y"): 0.2, ("a", "z"): 0.7}
    total, each = 0.0, [0.0] * len(cands)
    for n in range(len(cands) + 1):
        for own in itertools.combinations(range(len(cands)), n):
            if all(cands[i][1] <= cands[j][0] or cands[j][1] <= cands[i][0] for i, j in itertools.combinations(own, 2)):
                s = math.exp(sum(weights[cands[i][2], cands[i][3][0]] for i in own))
                total += s
                for i in own:
                    each[i] += s
    assert personal._posteriors(cands, weights) == pytest.approx([x / total for x in each])


def test_defects(spark):
    en = "The library opens at nine and the members bring their own cups to the reading room every morning. "
    de = "Die Bibliothek öffnet um neun und die Mitglieder bringen jeden Morgen ihre eigenen Tassen in den Lesesaal mit. "
    labelled = spark.createDataFrame([(en * 3 + str(i), "en") for i in range(8)] + [(de * 3 + str(i), "de") for i in range(8)] + [(None, "en"), ("x", None)], "text string, lang string")
    m = defects.fit(labelled, labelled.select(F.xxhash64("text").alias("key"), F.array("text").alias("texts")))
    code = Hashes()
    q = en * 2
    cases = [(None, "empty"), ("", "empty"), (" ​\n", "empty"), ("[deleted]", "empty"), ("I cannot assist with that request.", "refusal"), (q.upper(), "copied_question"), ("> " + q, "copied_question"), (de * 2, "other_language"), ("The members bring their own cups to the", "truncated"), ("The members bring their own cups (and", "truncated"), ("The members bring cups.", None), ("See https://x.example.org/faq", None)]
    for a, want in cases:
        assert defects.defect(m, q, a, code) == want, a
    assert defects.defect(m, None, "The members bring cups.", code) is None
    df = spark.createDataFrame([(1, None, None, "[]")], "pair_id long, fork string, chosen_branch string, rejected_branch string")
    got = defects.find_defects(df, m, "pair_id", "fork", {"chosen": "chosen_branch", "rejected": "rejected_branch"})
    assert sorted((r.branch, r.defect) for r in got.collect()) == [("chosen", "empty"), ("rejected", "empty")]


def test_endings_are_counted_over_all_texts(spark):
    """Copies of one text hold no evidence of their own, and many of them hide no other ending."""
    texts = [f"Number {i} went to the market and bought it from his good friend kelda" for i in range(40)] + ["The same notice, again and again, for all of you to the"] * 60_000
    df = spark.createDataFrame([(i, [t]) for i, t in enumerate(texts)], "key long, texts array<string>")
    labelled = spark.createDataFrame([], "text string, lang string")
    m = defects.fit(labelled, df)
    assert m.ending(["good", "friend", "kelda"]) > 0.7
    assert m.ending(["you", "to", "the"]) < defects.ENDING


def test_leaks(spark):
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    passages = {i: [word() for _ in range(60)] for i in range(40)}
    shared = [word() for _ in range(25)]
    passages[98], passages[99] = [word() for _ in range(5)] + shared, shared + [word() for _ in range(5)]
    items = spark.createDataFrame([(i, " ".join(p)) for i, p in passages.items()] + [(500, None), (501, "short"), (3, " ".join(passages[3]))], "item_id long, passage string")
    other = lambda n: [word() for _ in range(n)]
    changed = list(passages[7][:50])
    for k in range(5, 50, 7):
        changed[k] = word()
    docs = [(1, " ".join(other(30) + passages[3][10:40] + other(9))), (2, "> " + "\n> ".join(passages[5]).upper()), (3, " ".join(changed)), (4, " ".join(other(200))), (5, " ".join(passages[9][:19])), (6, None), (7, ""), (8, " ".join(passages[1][:30] + other(4000) + passages[2][30:])), (9, " ".join(passages[11][:20]))]
    df = spark.createDataFrame(docs + docs[:1], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(df, "doc_id", "text", items, "item_id", "passage").collect()}
    assert got == {(1, 3), (2, 5), (3, 7), (8, 1), (8, 2), (9, 11)}
    assert leakage.find_leaks(df.limit(0), "doc_id", "text", items, "item_id", "passage").count() == 0
    assert leakage.find_leaks(df, "doc_id", "text", items.limit(0), "item_id", "passage").count() == 0


def test_leaks_of_few_and_changed_words(spark):
    """Runs of just 20 words, and 60 words of which every sixth, fifth, fourth or third is another."""
    import random

    rng = random.Random(5)
    common = ["the", "a", "of", "and", "to", "in", "was", "is"]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abcdefghijkl") for _ in range(6))
    passages = {i: [word() for _ in range(80)] for i in range(200)}
    items = spark.createDataFrame([(i, " ".join(p)) for i, p in passages.items()], "item_id long, passage string")
    other = lambda n: [word() for _ in range(n)]
    docs, kinds = [], {}
    for i, p in passages.items():
        kind = ("run", 6, 5, 4, 3)[i % 5]
        if kind == "run":
            at = rng.randint(0, 60)
            t = p[at : at + 20]
        else:
            t = [word() + "x" if k % kind == kind - 1 else w for k, w in enumerate(p[:60])]
        kinds[i] = kind
        docs.append((i, " ".join(other(40) + t + other(30))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(df, "doc_id", "text", items, "item_id", "passage").collect()}
    assert all(a == b for a, b in got)
    for kind, least in (("run", 0.97), (6, 0.97), (5, 0.97), (4, 0.95), (3, 0.85)):
        own = [i for i in kinds if kinds[i] == kind]
        assert sum((i, i) in got for i in own) >= least * len(own), kind


def test_defects_beyond_fixed_lengths(spark):
    en = "The library opens at nine and the members bring their own cups to the reading room every morning. "
    de = "Die Bibliothek öffnet um neun und die Mitglieder bringen jeden Morgen ihre eigenen Tassen in den Lesesaal mit. "
    labelled = spark.createDataFrame([(en * 3 + str(i), "en") for i in range(8)] + [(de * 3 + str(i), "de") for i in range(8)], "text string, lang string")
    m = defects.fit(labelled, labelled.select(F.array("text").alias("texts")))
    long = "I'm sorry, but I can't help with that request because it touches on matters that the rules of this service ask me to leave aside, and no wording of the question, however kindly it is meant, will change that for me today."
    assert len(long.split()) > 40 and defects.refuses(long) and defects.refuses("I'd prefer not to engage with this topic.")
    assert not defects.refuses("I can't answer that fully, but here is what the library does: " + en * 3) and not defects.refuses(en)
    assert defects.defect(m, en, "Die Mitglieder bringen Tassen mit.") == "other_language" and defects.defect(m, en, "Members bring cups.") is None
    assert defects.defect(m, "Why now?", "why NOW") == "copied_question"
    assert defects.defect(m, en, "The members (who open at nine " + "and bring their own cups to the reading room " * 8 + "every morning") == "truncated"
    # cut words stay cut words, however often they were cut at the same place
    texts = [f"Number {i} went over the holidays to the library and the members met." for i in range(30)] + [f"Number {i} went over the holi" for i in range(30)]
    m = defects.fit(labelled.limit(0), spark.createDataFrame([([t],) for t in texts], "texts array<string>"))
    assert m.ending(["over", "the", "holi"]) == 0.0


@pytest.mark.parametrize("text", ["25 Â°C outside", "El especÃ\xadfico", "10Â\xa0km", "Ñêàçàë: ïðèâåò", "Он ïðèâåò ñêàçàë"])
def test_short_damage(text):
    affected, fixed, _ = garbled.inspect(text)
    assert affected and not set(fixed) & set("ÂÃïðèâåòÑñêàçàë")


@pytest.mark.parametrize("wrong", ["cp1252", "latin1", "cp1251", "cp437", "cp850", "mac_roman"])
def test_garbled_round_trip(wrong):
    for t in ("Señor González’s façade — über naïve", "Кстати, музей бережёт настенные часы"):
        g = garbled._read_as(t.encode(), wrong)
        assert garbled.inspect(g)[:2] == (True, t)
        assert garbled.inspect("Über: " + g)[1] == "Über: " + t
    swapped = "Кстати, музей бережёт настенные часы в подвале.".encode("koi8_r").decode("cp1251")
    assert garbled.inspect("Он сказал. " + swapped)[:2] == (True, "Он сказал. Кстати, музей бережёт настенные часы в подвале.")


def test_correct_text_is_no_case(spark):
    fine = [None, "", "plain", "ÀÉÎÕÜ ça où señorío", "СССР» и «Рёв»", "Zażółć gęślą jaźń", "日本語の文章です", "שלום עולם مرحبا", "ﬁ ①② Ｆｕｌｌ ​x 👩‍👩‍👧", "MANHÃ\xa0BOA", "GROẞE ÄRZTE", "20 °C ± 3 «ok»", "КОГДА МЫ ПРИЕХАЛИ, ВСЕ УЖЕ СПАЛИ НА ПОЛУ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(fine)] + [(99, "caf�")], "doc_id long, text string")
    assert [r.doc_id for r in garbled.mark_garbled(df, "doc_id", "text").filter("affected").collect()] == [99]
