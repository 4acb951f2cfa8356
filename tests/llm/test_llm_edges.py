"""Nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random

import pytest

from queuelens.llm import (
    chat_format,
    decontaminate,
    license_scan,
    mixing,
    near_dedup,
    paragraph_dedup,
    pii,
    quality_rules,
    suffix_repeats,
    token_orc,
)

# Names that operators use inside, as extra columns of the input.
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept string, row string, "
          "bucket string, rank string, block string, node string, component string, key string, part string")


def words(n, seed):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 9))) for _ in range(n))


LONG = words(30_000, 1)
PASSAGE = words(60, 2) + "."
A = words(120, 3)


def rows():
    out = [(1, A, "s"), (2, A, "s"), (2, A, "s"), (3, A + " x", None), (4, None, "t"), (5, "", "t"), (6, " \n\t", "t"),
           (7, "one", "s"), (8, "one", "s"), (9, LONG, "s"), (10, LONG + " tail", "u"), (None, A, "s"), (None, None, None),
           (11, words(80, 4) + ". " + PASSAGE + " " + words(80, 5) + ".", "s"),
           (12, words(80, 6) + ". " + PASSAGE + " " + words(80, 7) + ".", "u"),
           (13, "aaaa " * 200, "s"), (14, "mail a.b@c.example.com or +1 (499) 555-6503 now, 10.0.0.1", "s")]
    return [(i, t, "en", s, len(t or ""), *["z"] * 9) for i, t, s in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(docs, empty):
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {1, 9, 10, 11, 12} <= set(ids) and not {4, 5, 6, 7, 13} & set(ids)
    assert ids.count(2) == 2 and None in ids
    assert quality_rules.keep_good(empty).count() == 0


def test_near_dedup(docs, empty):
    found = sorted(near_dedup.near_components(docs, width=2).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    component = {r["doc_id"]: r["component_id"] for r in found}
    assert len(found) == len(rows())
    assert component[1] == component[2] == component[3] == 1
    assert component[8] == 7 and component[10] == 9 and component[5] == 5 and component[6] == 6 and component[None] is None
    stay = [r["doc_id"] for r in near_dedup.one_of_each(docs).collect()]
    assert sorted(i for i in stay if i) == [1, 4, 5, 6, 7, 9, 11, 12, 13, 14] and stay.count(None) == 2
    assert near_dedup.one_of_each(docs).columns == docs.columns
    assert near_dedup.near_components(empty).count() == 0


def test_decontaminate(spark, docs, empty):
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (3, "too short"), (4, PASSAGE)], "item_id long, text string")
    found = decontaminate.contaminated(docs, items).collect()
    assert sorted((r["doc_id"], r["item"]) for r in found) == [(11, 1), (11, 4), (12, 1), (12, 4)]
    clean = decontaminate.drop_contaminated(docs, items)
    assert clean.columns == docs.columns and clean.count() == len(rows()) - 2
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == len(rows())


def test_mix(docs, empty):
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    got = mixed.collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in rows()}
    assert mixing.mixed_rows(empty).count() == 0


def test_tokens(docs, empty):
    got = sorted(token_orc.encode_documents(docs).collect(), key=lambda r: r["start"])
    assert len(got) == len(rows()) and [r["doc_id"] for r in got[:2]] == [None, None]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False))
    assert {r["n_tokens"] for r in got if r["doc_id"] in (4, 5, 6)} == {1}
    assert token_orc.encode_documents(empty).count() == 0


def test_suffix_repeats(docs, empty):
    got = {r["doc_id"]: r for r in suffix_repeats.strip_repeats(docs).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] == got[2]["n_bytes"] and got[3]["n_removed"] == len(A)
    assert got[10]["n_removed"] == len(LONG) and got[10]["kept_text"] == " tail"
    assert got[4]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[12]["kept_text"].count(PASSAGE[:40]) == 0 and got[None]["n_removed"] == 0
    assert suffix_repeats.strip_repeats(empty).count() == 0


def test_paragraphs(docs, empty):
    got = paragraph_dedup.repeated_paragraphs(docs).collect()
    assert {11, 12} <= {r["doc_id"] for r in got} and {r["kept"] for r in got if r["doc_id"] == 12} == {False}
    assert {r["doc_id"] for r in got} <= {1, 2, 3, 9, 10, 11, 12}
    assert paragraph_dedup.repeated_paragraphs(empty).count() == 0


def test_scans(docs, empty):
    got = {r["doc_id"]: r for r in pii.find_personal_data(docs).collect()}
    assert (got[14]["n_email"], got[14]["n_ip"], got[14]["n_phone"]) == (1, 1, 1) and got[4]["spans"] == ""
    assert got[14]["redacted"] == "mail <email> or <phone> now, <ip>"
    assert pii.find_personal_data(empty).count() == 0
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(docs).collect()}
    assert got[4]["n_words"] == 0 and got[4]["first_word"] is None and got[4]["labels"] == "" and got[9]["n_words"] == 30_000
    assert license_scan.scan_licenses(empty).count() == 0


def test_chat(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "a\\<|b"), (1, 1, "assistant", "<\\|im_end|>x" * 100), (1, 1, "assistant", None), (1, None, None, "z"),
         (None, 0, "ro\nle", "q"), (2, 0, "system", "s"), (2, 0, "system", "s")],
        "conv_id long, turn long, role string, text string")
    formatted = chat_format.render(chat_format.fold_messages(chat_format.turn_log(turns)))
    got = {r["conv"]: r for r in chat_format.read_formatted(formatted).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [
        ("", "z"), ("user", "a\\<|b"), ("assistant", ""), ("assistant", "<\\|im_end|>x" * 100)]
    assert list(got[1]["learned"]) == ["", "<\\|im_end|>x" * 100]
    assert [(t["role"], t["text"]) for t in got[None]["turns"]] == [("ro\nle", "q")] and len(got[2]["turns"]) == 2
    assert formatted.limit(0).count() == 0
    none = chat_format.render(chat_format.fold_messages(chat_format.turn_log(turns.limit(0))))
    assert none.count() == 0


def test_chat_log_events(spark):
    log = spark.createDataFrame(
        [(1, 1, 0, "delta", "user", "hel"), (1, 1, 1, "delta", "user", "lo"), (1, 2, 0, "delta", "assistant", "bad"),
         (1, 2, 1, "regenerate", "assistant", None), (1, 2, 3, "delta", "assistant", "ter"),
         (1, 2, 2, "delta", "assistant", "bet"), (1, 3, 0, "delta", "user", "x"), (1, 3, 1, "edit", "user", "y"),
         (1, 3, 2, "delta", "user", "z")],
        "conv long, message long, seq long, kind string, role string, text string")
    got = sorted((r["message"], r["text"]) for r in chat_format.fold_messages(log).collect())
    assert got == [(1, "hello"), (2, "better"), (3, "yz")]
