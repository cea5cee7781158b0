"""Adapters of corpora, on small files with rows that must be left out."""

import json
import zipfile

import pytest

from tessera.sources import corpora as C


def rows(df):
    return {r["id"]: r for r in df.collect()}


def put(path, value):
    path.write_text(json.dumps(value))
    return str(path)


def test_personamem(spark, tmp_path):
    (tmp_path / "p.csv").write_text(
        "persona_id,topic_preference,topic_query,prev_pref,preference,updated,user_query,related_conversation_snippet\n"
        "7,my hotel,, Tea ,tea,,Which hotel?,we spoke of it\n"
        ",, phone plan ,old,new,,What now?,\"a\nb\"\n"
        "8,,,,,Yes,What else?,c\n"
        "9,,,,,,,no question\n"
    )
    got = rows(C.personamem(spark, str(tmp_path / "p.csv")))
    assert [(i, r["subject"], r["relation"], r["domain"], r["temporal"], r["contradiction"]) for i, r in sorted(got.items())] == [
        ("pm:0", "7", "my hotel", "D5", True, False),
        ("pm:1", "persona:1", "phone plan", "D4", True, True),
        ("pm:2", "8", "preference", "D1", True, False),
    ]
    assert got["pm:1"]["gold"] == ["a\nb"]


def test_longmemeval(spark, tmp_path):
    said = [[{"role": "user", "content": " hi "}, {"role": "assistant", "content": " "}], [{"role": "user", "content": "my flight", "has_answer": True}]]
    one = {"question_id": "q1", "question": "When?", "question_type": "knowledge-update", "haystack_session_ids": ["a", "b"], "haystack_sessions": said, "haystack_dates": ["2026/01/01", "2026/01/02"], "answer_session_ids": ["b"]}
    path = put(tmp_path / "l.json", [one, one | {"question_id": "q2_abs", "question_type": "x", "answer_session_ids": ["a", "b"]}, one | {"question_id": "q3", "answer_session_ids": ["z"]}, one | {"question_id": "q4", "haystack_session_ids": ["a"]}, one | {"question_id": "q5", "answer_session_ids": []}])
    got = rows(C.longmemeval(spark, path))
    assert sorted(got) == ["lme:q1", "lme:q2_abs"]
    assert got["lme:q1"]["gold"] == ["user: my flight"] and got["lme:q1"]["domain"] == "D5" and got["lme:q1"]["temporal"]
    assert got["lme:q2_abs"]["gold"] == ["user: hi", "user: my flight"] and not got["lme:q2_abs"]["temporal"]
    turns = sorted((r["case_id"], r["pos"], r["memory_id"], r["ts"], r["relevant"]) for r in C.turn_cases(spark, path).collect() if r["case_id"] < "q3")
    assert turns == [(c, p, m, t, c == "q1" and p == 2) for c in ("q1", "q2_abs") for p, m, t in ((0, "a:0", "2026/01/01"), (1, "a:1", "2026/01/01"), (2, "b:0", "2026/01/02"))]


def test_locomo(spark, tmp_path):
    talk = {"session_2": [{"dia_id": "D2:1", "speaker": "Ann", "text": "later"}, "odd"], "session_10": [{"dia_id": "D2:1", "speaker": "Bob", "text": "last"}], "session_1": [{"dia_id": "D1:1", "text": "first"}], "session_1_date_time": "May", "speaker_a": "Ann"}
    qa = [{"question": " What? ", "answer": 5, "evidence": ["D2:1", "D1:1"], "category": 2}, {"question": "Who?", "answer": "x", "evidence": "D1:1"}, {"question": "No?", "answer": "x", "evidence": ["D9:9"]}, {"question": "No?", "evidence": ["D1:1"]}, {"question": "No?", "answer": "x", "evidence": []}]
    got = rows(C.locomo(spark, put(tmp_path / "c.json", [{"sample_id": "s", "conversation": talk, "qa": qa}])))
    assert {i: (r["query"], r["subject"], r["relation"], r["gold"]) for i, r in got.items()} == {
        "locomo:s:0": ("What?", "s:Bob", "category-2", ["Bob: last", ": first"]),
        "locomo:s:1": ("Who?", "s:sample:s", "category-unknown", [": first"]),
    }


def turn(speaker, utterance, *frames):
    return {"speaker": speaker, "utterance": utterance, "frames": [{"service": s, "slots": [{"slot": x} for x in named], "state": {"slot_values": values}} for s, named, values in frames]}


@pytest.fixture
def dialogues(tmp_path):
    first = [
        turn("USER", "to Rome", ("Flights_1", ["city"], {"city": ["Rome"]})),
        turn("SYSTEM", "when?"),
        turn("USER", "in May", ("Flights_1", ["month"], {"city": [" rome "], "month": ["May", "may"]})),
        turn("USER", "book it", ("Flights_1", [], {"city": ["Rome"], "month": ["May"], "seat": ["a"]}), ("Weather_1", [], {"city": ["Rome"]})),
        turn("USER", "other", ("Flights_1", [], {"city": ["Paris"]})),
    ]
    mixed = [turn("USER", "x", ("Flights_1", ["a"], {"a": ["1"]}), ("Events_1", ["b"], {"b": ["2"]})), turn("USER", "y", ("Flights_1", [], {"a": ["1"]}), ("Events_1", [], {"b": ["2"]}))]
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("sgd/train/dialogues_001.json", json.dumps([{"dialogue_id": "1", "turns": first}, {"dialogue_id": "2", "turns": mixed}]))
    return str(tmp_path / "d.zip")


def test_sgd(spark, dialogues):
    got = rows(C.sgd(spark, dialogues))
    assert {i: (r["query"], r["relation"], r["gold"], r["domain"], r["carried"], r["several"]) for i, r in got.items()} == {
        "sgd:train:1:2": ("in May", "Flights_1:city", ["to Rome"], "D5", True, False),
        "sgd:train:1:3": ("book it", "Flights_1:city|Flights_1:month", ["to Rome", "in May"], "D5", True, True),
    }
    assert C.sgd(spark, dialogues, 1).count() == 1


def test_evermem(spark, tmp_path):
    talk = [{"topic_id": "t1", "date": "2026-01-02T00:00", "dialogues": {"g": [{"msg_index": 1, "sender": "Ann", "content": "one"}, {"msg_index": "02", "text": "two"}, {"msg_index": 3, "name": "x"}, {"msg_index": 1, "sender": "Bob", "content": "again"}], "h": [{"message_index": 4, "body": "four"}]}}]
    ref = {"date": "2026-01-02", "group": "g", "message_index": "1-2"}
    good, other = {"Q": "What?", "A": "a", "R": [ref, ref | {"group": "h", "message_index": 4}]}, {"Q": "Else?", "A": "a", "R": [ref | {"topic_id": "t1"}]}
    bad = [{"Q": "No?", "A": "a", "R": [ref | {"message_index": 3}]}, {"Q": "No?", "A": "", "R": [ref]}, {"Q": "No?", "A": "a", "R": [ref, "x"]}, {"Q": "No?", "A": "a", "R": [ref, ref | {"message_index": "x"}]}, "odd"]
    d = put(tmp_path / "d.json", talk)
    want = ("What?", "ever:T1:g|h", ["Bob: again", "two", "four"], "D6")
    for shape in ({"t1": [good, *bad], "t2": {"n": [other]}, "t9": [good]}, [good | {"topic_id": "t1"}, other | {"topic_id": "t2"}]):
        got = C.evermem(spark, put(tmp_path / "q.json", shape), d).collect()
        assert sorted((r["query"], r["subject"], r["gold"], r["domain"]) for r in got) == [("Else?", "ever:T2:g", ["Bob: again", "two"], "D7"), want]


def test_united_and_flagged(spark, dialogues, tmp_path):
    (tmp_path / "p.csv").write_text("persona_id,prev_pref,preference,user_query,related_conversation_snippet\n1,tea,coffee,What do I drink now?,coffee\n")
    got = rows(C.flagged(C.united(C.sgd(spark, dialogues), C.personamem(spark, str(tmp_path / "p.csv")))))
    assert got["sgd:train:1:3"]["n4"] and got["sgd:train:1:3"]["n11"] and not got["sgd:train:1:3"]["n1"]
    assert got["pm:0"]["n6"] and got["pm:0"]["n7"] and not got["pm:0"]["n11"]
