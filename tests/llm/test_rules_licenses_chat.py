import hashlib
from collections import Counter

import pytest
from helpers import LONG, empty_docs, odd_docs, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from backleaf.llm import chat, licenses, rules

# --- rules


def plain_measures(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t\x0b\u00a0#é", max_size=80))
def test_measures(text):
    d = rules.Doc(text)
    assert tuple(getattr(d, m) for m in rules.MEASURES) == plain_measures(text)


def test_the_rule_that_rejects_is_named(spark):
    names = {r.name: r for r in rules.FILTER_RULES}
    rows = rules.apply_rules(odd_docs(spark), rules.FILTER_RULES, reason=True).collect()
    for r in rows:
        assert (r.rejected_by is None) == r.kept and (r.kept or names[r.rejected_by].rejects(rules.Doc(r.text)))
        assert r.kept == (not any(x.rejects(rules.Doc(r.text)) for x in rules.FILTER_RULES))
    assert {r.rejected_by for r in rows} > {None, "no_words"}


def test_rules_on_odd_rows(spark):
    df = odd_docs(spark).withColumn("kept", F.lit("mine"))
    got = rules.apply_rules(df, rules.MORE_RULES, measured=rules.BASE_RULES)
    assert got.columns[:6] == ["doc_id", "text", "lang", "source", "n_chars", "kept_"]
    rows = got.collect()
    assert len(rows) == df.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_measures(r.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept_ == "mine" and not (r.base_failed and r.kept)


def test_rules_on_no_rows(spark):
    assert rules.apply_rules(empty_docs(spark)).count() == 0


def test_order_does_not_change_the_verdict(spark):
    texts = ["good words in a line of its own, " * i + f"number {i} is another kind of word" for i in range(20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    all_rules = rules.BASE_RULES + rules.MORE_RULES
    verdicts = {tuple(r.kept for r in rules.apply_rules(df, order).orderBy("doc_id").collect()) for order in (all_rules, all_rules[::-1])}
    assert verdicts == {tuple(not any(r.rejects(rules.Doc(t)) for r in all_rules) for t in texts)}


def test_cascade_goes_by_rejection_per_cost():
    a, b, c = (rules.Rule(n, bool) for n in "abc")
    assert rules.ordered((a, b, c), {"a": (1.0, 0.1), "b": (0.1, 0.1), "c": (0.1, 0.05)}) == (b, c, a)


# --- licences


def test_licences_in_other_spellings(spark):
    mit = dict(licenses.LICENSES)["MIT"]
    texts = {
        "as is": mit,
        "owner added": "Copyright (c) 2020 Someone\n" + mit,
        "owner between": mit.replace("\n\nPermission", "\n\n  (c) 1999 A. Person, all rights reserved\n\nPermission", 1),
        "case and signs": mit.upper().replace(",", " --- ").replace(" ", "\n", 40),
        "spelling": mit.replace("License", "Licence").replace("sublicense", "sub-licence"),
        "another word": mit.replace("free of charge", "for a charge"),
        "more text": mit + "\nmore",
        "empty": "",
    }
    df = spark.createDataFrame([*texts.items(), ("null", None), ("notice", "own text\n# Licensed under the Apache Licence, version 2.0!\nRELEASED under the MIT license"), ("long", LONG)], "name string, text string")
    got = {r.name: (r.license_id, list(r.notice_ids)) for r in licenses.scan(df).collect()}
    assert {n for n, (i, _) in got.items() if i} == {"as is", "owner added", "owner between", "case and signs", "spelling"}
    assert got["as is"][0] == "MIT" and got["notice"] == (None, ["Apache-2.0", "MIT"]) and got["null"] == (None, [])


def test_every_known_licence_is_found_by_itself(spark):
    df = spark.createDataFrame(list(licenses.LICENSES + licenses.NOTICES), "want string, text string")
    assert all(r.license_id == r.want for r in licenses.scan(df).collect())


def test_licences_on_odd_rows(spark):
    df = odd_docs(spark).withColumn("license_id", F.lit(1))
    got = licenses.scan(df)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "license_id_", "text_digest", "license_id", "notice_ids"]
    assert got.count() == df.count() and licenses.scan(empty_docs(spark)).count() == 0
    assert next(r.text_digest for r in got.collect() if r.text == "") == hashlib.sha256(b"").hexdigest()


# --- chat


TRICKY = ["", None, "\\", "\\e", "<turn:user>\n", "</turn>\n", "\\c/turn>", "\\\\### Assistant: </turn> ok", "a</turn></turn>\\o", "<", "<turn", "\u2028 x \r\n", "</turn", ">\n"]


def formatted(spark, rows):
    return chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


def test_every_text_reads_back(spark):
    rows = [(i, t, role, TRICKY[(i * 5 + t) % len(TRICKY)]) for i in range(30) for t, role in enumerate(["system", "user", "assistant", "odd>\nrole</turn>", None][: i % 5 + 1])]
    out = formatted(spark, rows).select("*", chat.read_back(F.col("formatted")).alias("back"), chat.loss_text(F.col("segments")).alias("loss")).collect()
    assert len(out) == 30
    for r in out:
        own = sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: x[1])
        assert [(x.role, x.text) for x in r.back] == [(role or "", text or "") for _, _, role, text in own]
        assert r.n_turns == len(own) and r.loss == "".join(text or "" for _, _, role, text in own if role == "assistant")
        assert r.formatted == "".join(s.text for s in r.segments)


@pytest.mark.parametrize(
    ("roles", "valid", "error"),
    [
        (["user", "assistant"], True, None),
        (["system", "user", "assistant", "user", "assistant"], True, None),
        (["user"], False, 1),
        (["assistant", "user"], False, 0),
        (["user", "user", "assistant"], False, 1),
        (["system", "assistant"], False, 1),
        (["user", "assistant", "system"], False, 2),
        (["user", None], False, 1),
        (["user", "tool"], False, 1),
    ],
)
def test_turn_order(spark, roles, valid, error):
    r = formatted(spark, [(1, i, role, "x") for i, role in enumerate(roles)]).first()
    assert (r.valid, r.error_turn) == (valid, error)


def test_ties_and_null_ids_come_in_a_fixed_order(spark):
    rows = [(None, 1, "user", "b"), (None, 1, "user", "a"), (None, None, "system", "s"), (None, 1, "user", "a")]
    texts = {tuple(x.text for x in formatted(spark, order).select(chat.read_back(F.col("formatted"))).first()[0]) for order in (rows, rows[::-1])}
    assert texts == {("s", "a", "a", "b")}


def test_chats_on_no_rows_and_other_columns(spark):
    assert formatted(spark, []).count() == 0
    df = spark.createDataFrame([(1, 0, "user", LONG, True)], "conv_id long, turn long, role string, text string, valid boolean")
    assert chat.format_chats(df).select(chat.read_back(F.col("formatted"))).first()[0][0].text == LONG


def test_template_refuses_control_strings_that_escape_cannot_tell():
    with pytest.raises(ValueError):
        chat.Template(before="\\x")
    with pytest.raises(ValueError):
        chat.Template(before="<<turn")
