"""Very long texts where the other tests have none: archives, mixing, chat."""

import hashlib
import re

from fastbreak.llm import chat, mixing, structure_repair, warc


def test_long_pages(spark):
    page = "<p>é and more</p>" * 200_000
    rows = [(1, "http://a/1", page), (2, "http://a/2", page), (3, "http://a/3", None), (9, "http://a/9", page[:-1])]
    got = {r["page_id"]: r for r in warc.op2_warc_bundles(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    data = page.encode()
    assert got[1]["payload_bytes"] == got[2]["payload_bytes"] == len(data) and got[1]["payload_digest"] == hashlib.sha1(data).hexdigest()
    assert (got[2]["record_type"], got[1]["record_type"], got[1]["refers_to"], got[9]["record_type"]) == ("response", "revisit", 2, "response") and got[3]["payload_bytes"] == 0


def test_long_texts_in_a_mix(spark):
    long = "word and word " * 200_000
    rows = [(1, long, "en", "a", 0), (2, "one two", "en", "a", 0), (3, long[:90_000], "en", "b", 0), (4, None, "en", None, 0)]
    got = {r["doc_id"]: r for r in mixing.op3_source_mixing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert got[1]["size"] == 600_000 and got[3]["size"] == len(re.findall("[^\x20\x09-\x0d]+", long[:90_000])) and got[4]["size"] == 0
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got.values())
    assert abs(got[1]["taken"] + got[2]["taken"] - got[1]["target"]) <= 2 and abs(got[3]["taken"] - got[3]["target"]) <= 2


def test_long_turns(spark):
    long = "It goes on <|im_end|> and on. " * 70_000
    rows = [(1, 0, "user", "Go"), (1, 1, "assistant", long), (2, 0, "user", long)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.op6_chat_windows(df).collect()}
    digest = lambda turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1]["turns_sha256"] == digest([("user", "Go"), ("assistant", long)]) and got[1]["loss_chars"] == len(long) and got[1]["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest()
    assert got[2]["turns_sha256"] == digest([("user", long)]) and got[2]["loss_chars"] == 0
    fixed = {r["conv_id"]: r for r in structure_repair.op12_structure_repair(df).collect()}
    assert set(fixed) == {1, 2} and all(r["audit"] is not None for r in fixed.values())
