"""Personal data (2), quality rules (6), chat snapshots (9)."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import chats, pii, quality

from conftest import SF0001

# --- personal data ------------------------------------------------------------

PII_TEXTS = [
    "a@b.c_d@e.f x a@b.c.@d.e", "1.2.3.4.5.6.7.8 001.2.3.255 1.2.3.256 9999999999999.1.1.1",
    "+1 (243) 555-5526 +12 3 +1234567890123456 é +1 2345678901 +1.............................",
    "4111 1111 1111 1111 4111-1111-1111-1111x 4111111111111111 41111111111111111111111 12  4111111111111111 12 4111111111111111",
    "", None, "@@a@b..c@d.e x@y.z-", "日本 a@b.c 😀 1.1.1.1 " * 40, "a" * 20000 + "@", "1 " * 5000 + "4111111111111111",
    "+1" + " " * 3000, "1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6-7-8-9-0"]


def base_spans(t):
    t, out = t or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and luhn % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def check_base(got, texts):
    for r in got:
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (r.doc_id, want, r.spans)
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(re.findall(rf"{k}:", want)) for k in pii.KINDS[:4]]


def test_base_spans_equal_plain_expressions(spark):
    r = random.Random(0)
    texts = list(PII_TEXTS)
    for _ in range(300):
        texts.append("".join(r.choice("ab@.1234567890-+ ()é_%") for _ in range(r.randrange(80))))
    for _ in range(200):
        texts.append("".join(r.choice("0123456789 -.+") for _ in range(r.randrange(60))))
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, row int")
    got = pii.personal_data(df).collect()
    assert len(got) == len(texts)
    check_base(got, texts)


def test_patterns_find_unseen_identifiers(spark):
    r = random.Random(1)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(6)]
    rows = [(i, f'plain words here token = "{h}" and more') for i, h in enumerate(hexes)]
    mails = [(10 + i, f"write to mailbox {n}@example.com today") for i, n in enumerate(["ann", "bob", "cyd", "dee"])]
    unseen = [(20, 'other words token = "AB-12345-zz" follow'), (21, "write to mailbox user1234 today"),
              (22, "clean text about the year 12345678 and the number 55-1234-77 of words"), (23, None), (20, "")]
    df = spark.createDataFrame(rows + mails + unseen, "doc_id long, text string")
    got = {(r.doc_id, r.n_found): r.spans for r in pii.personal_data(df).collect()}
    text = unseen[0][1]
    at = text.index("AB-12345-zz")
    assert got[(20, 1)] == f"key:{at}:{at + 11}" and got[(20, 0)] == ""
    at = unseen[1][1].index("user1234")
    assert got[(21, 1)] == f"email:{at}:{at + 8}"
    assert got[(22, 0)] == "" and got[(23, 0)] == ""
    assert all((i, 1) in got for i in range(6))


def test_spaced_numbers_and_glued_values_are_seeds_and_instances(spark):
    r = random.Random(2)
    number = lambda n: "".join(r.choice("123456789") for _ in range(n))

    def card():
        while True:
            d = number(16)
            if sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
                return " ".join(d[i:i + 4] for i in range(0, 16, 4))
    texts = [f"please ring us at +1 ({number(3)}) {number(3)}-{number(4)} before noon" for _ in range(5)]
    texts += [f"paid with card no {card()} last week" for _ in range(5)]
    texts += [f"send to mailto:{n}@example.com now" for n in ("ann", "bob", "cyd", "dee")]
    unseen = {"please ring us at (743) 555 3824 before noon": ("phone", "(743) 555 3824"),
              "please ring us at 7435553825 before noon": ("phone", "7435553825"),
              "paid with card no 4111 1111 1111 1112 last week": ("card", "4111 1111 1111 1112"),
              "send to mailto:user1234 now": ("email", "user1234")}
    clean = ["there were 1200 3400 5600 of them", "\ufdd0 in the years 1999 2000 2001 it rained"]
    texts += [*unseen, *clean]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = pii.personal_data(df).collect()
    check_base(got, texts)
    got = {texts[x.doc_id]: x for x in got}
    for text, (kind, value) in unseen.items():
        at = text.index(value)
        assert got[text].spans == f"{kind}:{at}:{at + len(value)}" and got[text].n_found == 1
    assert all(x.n_found == 0 for t, x in got.items() if t not in unseen)


def test_rounds_go_on_while_they_find(spark, caplog):
    r = random.Random(6)
    chain = [["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(40)]]
    chain += [[f"{c}x-{10000 + i}-{c}" for i in range(n)] for c, n in (("a", 20), ("b", 10), ("c", 5), ("d", 2))]
    rows = [f"we list {c} {c} {v} {c} group" for k, c in enumerate("pqrs") for v in chain[k] + chain[k + 1]]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    with caplog.at_level("INFO", logger=pii.__name__):
        got = pii.personal_data(df).collect()
    assert all(x.n_found == 1 for x in got)
    assert "settled after round 5" in caplog.text
    assert sum(x.n_found == 0 for x in pii.personal_data(df, rounds=2).collect()) > 0


def test_personal_data_of_nothing(spark):
    df = spark.createDataFrame([(None, None), (1, "x")], "doc_id long, text string")
    assert {r.spans for r in pii.personal_data(df).collect()} == {""}
    assert pii.personal_data(df.limit(0)).collect() == []


# --- quality ------------------------------------------------------------------

def rules(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover),
            len(w) < 10 or 100 * len(cover) > 20 * len(w))


QUALITY_TEXTS = ["", None, "  \n\t ", "one two", "a b c d e a b c d e", "x " * 40, "l1 a b\nl1 a b\n\n\nl1 a b\nq", "### $$ a|b <x> é😀 \x85 y",
                 "the cat sat on the mat and the dog sat on the mat with the cat sat on the mat", "r " * 30000]


def test_base_rules_equal_plain_python(spark):
    r = random.Random(3)
    texts = QUALITY_TEXTS + [" ".join(r.choice("abc") for _ in range(r.randrange(40))) for _ in range(200)]
    texts += ["\n".join(r.choice(["a b", "", " ", "c", "a  b"]) for _ in range(9)) for _ in range(50)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    for x in quality.base_rules(df).collect():
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == rules(texts[x.doc_id])


def test_junk_goes_and_clean_stays(spark):
    r = random.Random(4)
    good, bad = [f"good{i}" for i in range(12)], [f"junk{i}" for i in range(12)]
    rows = [(i, " ".join(r.choice(good) for _ in range(60))) for i in range(60)]
    rows += [(100 + i, " ".join(r.choice(bad) for _ in range(60))) for i in range(30)]
    rows += [(200, None), (201, "too short"), (None, " ".join(good[::-1]))]
    docs = spark.createDataFrame([(i, t, 7.0) for i, t in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)] + [(100, 0, 0), (1, 1, 1), (0, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality(docs, labels).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id for r in got if r.kept}
    assert kept == set(range(60)) | {None}
    assert quality.quality(docs, labels.limit(0)).count() == len(rows)
    assert quality.quality(docs.limit(0), labels).collect() == []


def test_copies_of_the_corpus_change_no_verdict(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF0001}/labels.parquet")
    more = docs.crossJoin(spark.range(1, 20)).select((-F.col("doc_id") - 1 - 1000000 * F.col("id")).alias("doc_id"), "text")
    once = {r.doc_id: (r.kept, round(r.score, 9)) for r in quality.quality(docs, labels).collect()}
    same_ids = quality.quality(docs.crossJoin(spark.range(20)).drop("id"), labels).collect()
    new_ids = quality.quality(docs.unionAll(more), labels).filter("doc_id >= 0").collect()
    for got in (same_ids, new_ids):
        assert {r.doc_id: (r.kept, round(r.score, 9)) for r in got} == once
    assert len({kept for kept, _ in once.values()}) == 2


def test_score_is_the_mean_log_ratio(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, None)], "doc_id long, text string")
    w = spark.range(8).selectExpr("CAST(id AS int) AS bucket", "CAST(id AS double) AS weight")
    rows = quality.base_rules(docs.withColumn("g", quality.gram_buckets("text", 8)), "text", 8, quality.weight_table(w))
    got = {r.doc_id: r for r in rows.collect()}
    assert [len(got[k].g) for k in (1, 2, 3)] == [5, 1, 0]
    assert all(r.score == pytest.approx(sum(r.g) / max(1, len(r.g))) for r in got.values())


# --- chats --------------------------------------------------------------------

def test_snapshots_collapse(spark, monkeypatch):
    monkeypatch.setattr(chats, "PART_TURNS", 2)
    a = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", None), ("user", "bye")]
    talks = {1: a[:1], 2: a[:2], 3: a, 4: a, 5: a[:3] + [("user", "else")], 6: [("user", "hello")], 7: [("assistant", "hi")],
             8: a[:4], None: [("user", "<|im_end|>")], 9: [("user", "hi")] * 2}
    rows = [(c, 10 * t, role, text, "x") for c, talk in talks.items() for t, (role, text) in enumerate(talk)]
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos string")
    out = chats.format_chats(df)
    kept = {(r.conv_id, r.n_turns, r.copies) for r in out.collect()}
    assert kept == {(3, 5, 2), (5, 4, 1), (6, 1, 1), (7, 1, 1), (None, 1, 1), (9, 2, 1)}
    text = {r.conv_id: r.chat for r in chats.whole_chats(out).collect()}
    assert text[3] == "".join(f"<|im_start|>{r}\n{t or ''}<|im_end|>\n" for r, t in a)
    assert text[None] == "<|im_start|>user\n<| im_end|><|im_end|>\n"
    assert chats.format_chats(df.limit(0)).collect() == []


def test_ties_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "user", "z"), (2, 0, "user", "z")],
                               "conv_id long, turn long, role string, text string")
    got = sorted((r.conv_id, r.pos, r.rendered.split("\n")[1][0]) for r in chats.format_chats(df).collect())
    assert got == [(1, 0, "z"), (1, 1, "a"), (1, 2, "a")]
