import pytest
from pyspark.sql import functions as F

from strandlake.llm import chat_format, html_extraction, license_scan, line_dedup, minhash, quality_rules

DOCS = "doc_id long, text string"


def test_rows_of_a_doc_id_are_grouped_by_their_own_texts(spark):
    base, other, third = (" ".join(f"{c}{k}" for k in range(60)) for c in "abc")
    # 9 holds a near copy of 3, and texts of its own; its smallest text is not the copy
    rows = [(3, base), (9, "x " + base), (9, other), (9, third), (12, third + " y"), (None, other + " z"), (None, base + " q")]
    docs = spark.createDataFrame(rows, DOCS)
    got = {(r["doc_id"], r["n_shingles"]): None for r in minhash.near_duplicates(docs).collect()}
    assert len(minhash.near_duplicates(docs).collect()) == 7 and (9, 57) in got
    groups = minhash.grouped(docs).join(docs.select("doc_id", "text", F.xxhash64("text").alias("h")).dropDuplicates(["h"]).drop("doc_id"), "h")
    comp = {(r["doc_id"], r["text"]): r["component_id"] for r in groups.collect()}
    assert [comp[r] for r in rows] == [3, 3, 9, 9, 9, 9, 3]
    left = sorted((r["doc_id"], r["text"]) for r in minhash.clean_documents(docs).collect())
    assert left == sorted([(3, base), (9, other), (9, third)])


def test_wrapped_and_full_licence_texts_are_found(spark):
    s, more = license_scan.SENTENCES, license_scan.MORE_SENTENCES
    mit = more["mit-permission-full"] + "\n\nThe above copyright notice and this permission notice shall be included in all copies.\n\n" + s["mit-as-is"]

    def wrap(text, width, mark=""):
        out = []
        for part in text.split("\n"):
            line = mark
            for w in part.split(" "):
                if len(line) + len(w) > width:
                    out.append(line.rstrip())
                    line = mark
                line += w + " "
            out.append(line.rstrip())
        return "\n".join(out)

    apache = s["apache-grant-full"] + "\n" + s["apache-compliance"]
    gpl = s["gpl-free-software"] + "\n\n" + s["gpl-no-warranty"]
    rows = [
        (1, mit), (2, wrap(mit, 60)), (3, wrap(apache, 40, " * ")), (4, wrap(gpl, 70, "# ")), (5, wrap(s["bsd-conditions"], 30)),
        (6, gpl.replace("either version 3", "either version 2")), (7, s["mpl-grant"]), (8, s["mpl-grant"].replace("v. 2.0", "v. 1.1")),
        (9, s["bsd-conditions"].replace("with or", "\n\nwith or")), (10, s["bsd-conditions"].replace("forms,", "forms.\n")), (11, "x\n" + wrap(s["cc-by"], 12)),
        (12, wrap(s["mpl-grant"], 50)),
    ]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, DOCS)).collect()}
    want = {1: "MIT", 2: "MIT", 3: "Apache-2.0", 4: "GPL-3.0-or-later", 5: "BSD", 6: "", 7: "MPL-2.0", 8: "", 9: "", 10: "", 11: "CC-BY-4.0", 12: "MPL-2.0"}
    assert {k: r["licenses"] for k, r in got.items()} == want
    assert got[7]["sentence_ids"] == "mpl-grant,mpl-grant+1" and got[2]["sentence_ids"] == "mit-permission-full,mit-as-is"


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>t</title><meta charset=utf-8><body><p>One text.</p><p>Two.</p></html>",
        "<head><link href=x><div><p>One text.</p></div><p>Two.</p>",
        "<head><title>t</title>One text.<p>Two.</p>",
        "<body><p>One <svg class='i' width=1/>text.</p><p>Two.</p><svg><path d=''/></svg>",
        "<body><noscript><p>One text.</p><template><svg><p>Two.</p>",
        "<head><title>t<body><p>One text.</p><p>Two.</p><script>var x = '<p>no</p>'",
        "<body><p>One text.</p><SVG/><p>Two.</p><noscript><p>no</p></noscript>",
    ],
)
def test_pages_without_optional_end_tags_keep_their_texts(page):
    assert [b.text for b in html_extraction.blocks(page)] == ["One text.", "Two."]


def test_phrases_are_whole_words(spark):
    words = "one two three four five six seven eight nine ten eleven"
    bad = ["please Log in here", "read more", "«sign up»", "Terms of use."]
    good = ["the catalog in hand", "a dialog in it", "spread more of it", "design up to date", "terms of useful things", "blog in éread more"]
    rows = [(k, f"{x} {words}") for k, x in enumerate(bad + good)]
    kept = {r["doc_id"] for r in quality_rules.with_rules(spark.createDataFrame(rows, DOCS)).filter("kept").collect()}
    assert kept == set(range(len(bad), len(rows)))


def test_columns_with_the_operators_own_names_pass_through(spark):
    text = "one two three four five six seven eight nine ten eleven"
    own = ["n_words", "n_symbols", "kept", "clean_text", "_text", "_good", "_h", "_i", "_drop", "_kept", "n_lines", "n_dropped", "_in0"]
    docs = spark.createDataFrame([(1, text, "h", *own), (2, "x", "h", *own)], DOCS + ", source string, " + ", ".join(f"{c} string" for c in own))
    assert [tuple(r) for r in quality_rules.clean_documents(docs).collect()] == [(1, text, "h", *own)]
    assert sorted(tuple(r) for r in line_dedup.clean_documents(docs).collect()) == [(1, text, "h", *own), (2, "x", "h", *own)]
    judged = quality_rules.with_rules(docs)
    assert len(set(judged.columns)) == len(judged.columns) and {r["n_words"] for r in judged.collect()} == {11, 1}
    dropped = line_dedup.without_boilerplate(docs)
    assert len(set(dropped.columns)) == len(dropped.columns) and {r["n_lines"] for r in dropped.collect()} == {1}


def test_no_turn_of_a_conversation_is_lost(spark):
    import json

    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hello"), (1, 1, "user", "again"), (1, 2, "assistant", "yes"), (1, 2, "assistant", "no"), (1, 3, "user", "bye"), (1, 4, "tool", None), (1, 5, None, "lost")]
    talk = spark.createDataFrame([*rows, rows[1]], "conv_id long, turn long, role string, text string")
    got = {r["call_id"]: r for r in chat_format.formatted(talk).collect()}
    said = {k: (json.loads(r["json"]), r["turn"], r["level"], r["linked"]) for k, r in got.items()}
    prompts = {k: j["arguments"]["prompt"] for k, (j, *_) in said.items() if j["arguments"]}
    assert prompts == {"call-1-1": "again", "call-1-1#2": "hello", "call-1-3": "bye"}
    assert {k: j["content"] for k, (j, *_) in said.items()} == {
        "turn-1-0": "be kind", "call-1-1": "no", "call-1-1#2": "yes", "call-1-3": None, "turn-1-4": "", "turn-1-5": "lost",
    }
    assert said["turn-1-0"][0]["name"] == "system" and said["turn-1-0"][1:] == (0, None, False)
    assert [said[k][2:] for k in ("call-1-1", "call-1-1#2", "call-1-3")] == [(0, True), (0, True), (1, False)]
