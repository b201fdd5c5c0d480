"""Odd rows, long texts, clashing names and brute-force versions of the operators and the pipeline."""

import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandlake.llm import chat_format, common, decontamination, html_extraction, license_scan, line_dedup, minhash, packing, quality_gam, quality_rules, token_counts

DOCS = "doc_id long, text string"
WORD = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Names that operators give to columns of their own.
OWN = """
n_words n_hit n_items item_ids contaminated n_lines n_dropped kept clean_text n_shingles component_id stays held_out score predicted n_sentences sentence_ids licenses
start stop p w word token at window items over salt number shard place piece pieces head sid words line_ _id _h _i _line _host _salt _drop _text _bare _good _in0 key band bucket comp x y h i n id a b
""".split()


def named(spark, rows):
    fields = ", ".join(f"`{c}` string" for c in OWN)
    return spark.createDataFrame([(*r, *OWN) for r in rows], f"doc_id long, text string, source string, lang string, n_chars int, {fields}")


def test_clashing_names(spark):
    text = "one two three four five six seven eight nine ten eleven"
    docs = named(spark, [(1, text, "s", "en", 55), (2, "x", "s", "en", 1), (3, None, None, None, None)])
    bench = spark.createDataFrame([(1, "one two three", *OWN), (2, None, *OWN)], "item_id long, text string, " + ", ".join(f"`{c}` string" for c in OWN))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    three = {
        "decontaminate": decontamination.decontaminate(docs, bench), "pack": packing.pack(docs, WORD), "scan": license_scan.scan(docs), "count": token_counts.count_tokens(docs, RANKS),
        "lines": line_dedup.without_boilerplate(docs), "gam": quality_gam.scored(docs, quality_gam.train(docs, labels)), "rules": quality_rules.with_rules(docs), "near": minhash.near_duplicates(docs),
    }
    for name, out in three.items():
        assert len(set(out.columns)) == len(out.columns), name
        assert sorted(r["doc_id"] for r in out.collect()) == [1, 2, 3], name
    whole = [(3, None), (1, text), (2, "x")]
    for clean, want in ((quality_rules.clean_documents(docs), [1]), (line_dedup.clean_documents(docs), [1, 2, 3]), (minhash.clean_documents(docs), [1, 2, 3]), (decontamination.clean_documents(docs, bench), [2, 3])):
        assert clean.columns == docs.columns
        rows = clean.collect()
        assert sorted(r["doc_id"] for r in rows) == want
        assert all([r[c] for c in OWN] == OWN and (r["doc_id"], r["text"]) in whole for r in rows)
    talk = spark.createDataFrame([(1, 1, "user", "hi", *OWN), (1, 2, "assistant", "yes", *OWN)], "conv_id long, turn long, role string, text string, " + ", ".join(f"`{c}` string" for c in OWN))
    assert [r["linked"] for r in chat_format.formatted(talk).collect()] == [True]
    pages = spark.createDataFrame([(1, "u", "<p>x</p>", *OWN)], "page_id long, url string, html string, " + ", ".join(f"`{c}` string" for c in OWN))
    assert html_extraction.extracted(pages, html_extraction.train(pages)).columns == ["page_id", "url", "text", "n_chars"]


def test_long_texts_are_read_whole(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    item = [word() for _ in range(15)]
    text = " ".join([word() for _ in range(30_000)] + item + ["licensed", "x."])
    lines = "\n".join(["a line of the site"] + [word() + "." for _ in range(20_000)] + ["Released under the MIT License.", "a line of the site"])
    docs = spark.createDataFrame([(1, text, "s"), (2, lines, "s"), *[(k, "a line of the site\nown " + str(k), "s") for k in range(3, 9)]], DOCS + ", source string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    hit = {r["doc_id"]: r for r in decontamination.decontaminate(docs, bench).collect()}
    assert (hit[1]["n_words"], hit[1]["n_hit"], hit[1]["item_ids"], hit[1]["contaminated"]) == (30_017, 15, ["7"], False)
    assert {r["doc_id"]: r["licenses"] for r in license_scan.scan(docs).collect()}[2] == "MIT"
    left = {r["doc_id"]: r for r in line_dedup.without_boilerplate(docs).collect()}
    assert (left[2]["n_lines"], left[2]["n_dropped"]) == (20_003, 2) and left[1]["text"] == text
    judged = {r["doc_id"]: r for r in quality_rules.with_rules(docs).collect()}
    assert judged[1]["n_words"] == 30_017 and judged[2]["n_dup_lines"] == len(lines.split("\n")) - len(set(lines.split("\n")))
    talk = spark.createDataFrame([(1, 1, "user", text), (1, 2, "assistant", lines)], "conv_id long, turn long, role string, text string")
    (row,) = chat_format.formatted(talk).collect()
    body = json.loads(row["json"])
    assert body["content"] == lines and body["arguments"] == {"prompt": text, "words": 30_017} and not body["valid"]


def test_conversations_with_odd_rows(spark):
    rows = [(None, 1, "user", "a"), (1, None, "user", "a"), (1, 1, None, None), (1, 1, "user", None), (1, 1, "user", None), (1, 2, "assistant", None), (2, 1, "user", "")]
    out = {r["call_id"]: r for r in chat_format.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {k: (r["valid"], r["linked"], r["level"]) for k, r in out.items()} == {"call-1-1": (False, True, 0), "turn-1-1": (False, False, None), "call-2-1": (False, False, 0)}


def test_arguments_are_checked_by_type(spark):
    cases = {
        '{"prompt":5,"words":"7"}': False, '{"words": 1, "prompt": "x"}': True, '{"prompt":"x","words":1} trailing': False, '{"prompt":"x","words":1,"more":2}': False,
        '{"prompt":"x","words":1.5}': False, '{"prompt":"x"}': False, '{"prompt":"","words":1}': False, "[1]": False, "null": False, "": False, None: False,
        '{"prompt":"x","words":null}': False, '{"prompt":"x","prompt":"y","words":1}': False, '{"prompt":"x","words":1},{"a":1}': False, '{"prompt":"x","words":2001}': False,
    }
    calls = spark.createDataFrame([(1, k, f"c{k}", [], "reply", x) for k, x in enumerate(cases)], "conv_id long, turn long, call_id string, after array<string>, name string, arguments string")
    results = spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")
    out = {r["turn"]: r for r in chat_format.linked(calls, results).collect()}
    assert [out[k]["valid"] for k in range(len(cases))] == list(cases.values())
    assert '"arguments":{"prompt":"x","words":1}' in out[1]["json"] and json.loads(out[2]["json"])["arguments"] == list(cases)[2]
    deep = spark.createDataFrame([(1, 1, "c", ["c"], "other", '{"b": {"d": [1, {"z": 1, "y": 2}], "c": null}, "a": "é"}')], calls.schema)
    (row,) = chat_format.linked(deep, results).collect()
    assert '"arguments":{"a":"é","b":{"c":null,"d":[1,{"y":2,"z":1}]}}' in row["json"] and row["level"] is None and not row["valid"]


def test_levels_match_brute_force(spark):
    rng = random.Random(9)
    after = {f"n{k}": [f"n{rng.randrange(max(0, k - 7), k)}" for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))] if k else [] for k in range(120)}
    after |= {"x1": ["x3"], "x2": ["x1"], "x3": ["x2", "n5"], "x4": ["x2", "n7"], "x5": ["x4"], "u": ["unknown", None], "s": ["s"]}
    level = {}
    while True:
        ready = {k: 1 + max((level[p] for p in ps if p in after), default=-1) for k, ps in after.items() if k not in level and all(p in level for p in ps if p in after)}
        if not ready:
            break
        level |= ready
    got = {r["call_id"]: r["level"] for r in chat_format.levels(spark.createDataFrame(list(after.items()), "call_id string, after array<string>")).collect()}
    assert got == {k: level.get(k) for k in after} and max(level.values()) > 8 and got["x5"] is None


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<p>One <img alt="a > b">text.</p><p title=\'x>y\'>Two.</p>', ["One text.", "Two."]),
        ("<p>One <math><mi>m</mi><mo>=</mo></math>text.</p><p>Two.</p>", ["One m=text.", "Two."]),
        ("<p>One <object data=x>text</object>.</p><p title=\"x>Two.</p>", ["One text.", "Two."]),
        ("<p><a href=/1><b><i><u><em>One</em></u></i></b></a> text.</p>" + "<div>" * 5 + "Two." + "</div>" * 5, ["One text.", "Two."]),
    ],
)
def test_quoted_marks_and_formulas(page, want):
    assert [b.text for b in html_extraction.blocks(page)] == want


def test_links_are_seen_at_any_depth():
    (block,) = html_extraction.blocks("<p><a href=/x>" + "<b>" * 30 + "all of it" + "</b>" * 30 + "</a></p>")
    assert block.linked == len("all of it")


def test_deep_and_long_pages():
    deep = html_extraction.blocks("<div class='a b'>" * 10_000 + "text" + "</div>" * 10_000)
    assert [b.text for b in deep] == ["text"] and deep[0].path == ("div",) and set(deep[0].names) == {"a", "b"}
    assert len(html_extraction.blocks("<p>some text here.</p>" * 100_000)) == 100_000


def test_extraction_of_held_out_layouts(spark):
    rng = random.Random(1)
    words = [rng.choice("abcdefgh") + "".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(5, 120))).capitalize() + "."
    model = html_extraction.fit(html_extraction.labelled_pages([text() for _ in range(300)], 300, seed=7))
    held = html_extraction.labelled_pages([text() for _ in range(300)], 150, seed=99)
    pairs = [(a, b) for items, label in held for a, b in zip(model.decode(items), label, strict=True)]
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.97
    rows = [(None, None, None), (1, "u", ""), (2, "u", "<nav>a</nav>"), (3, "u", "<article><p>A text that is long enough, and ends.</p></article>")] * 2
    out = html_extraction.extracted(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()
    assert len(out) == 8 and {(r["page_id"], r["text"], r["n_chars"]) for r in out} == {(None, "", 0), (1, "", 0), (2, "", 0), (3, "A text that is long enough, and ends.", 37)}


def test_extraction_of_the_given_pages(spark):
    """The given pages mark their articles; another parser reads them."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.depth, self.parts, self.run = 0, [], []

        def cut(self):
            if text := " ".join("".join(self.run).split()):
                self.parts.append(text)
            self.run = []

        def handle_starttag(self, tag, attrs):
            if tag in ("article", "main"):
                self.depth += 1
            if tag not in html_extraction.INLINE:
                self.cut()
            elif tag == "br":
                self.run.append(" ")

        def handle_endtag(self, tag):
            if tag not in html_extraction.INLINE:
                self.cut()
            if tag in ("article", "main"):
                self.depth -= 1

        def handle_data(self, data):
            if self.depth > 0:
                self.run.append(data)

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_extraction.extracted(pages, html_extraction.train(pages)).collect()}
    simple = same = 0
    for r in pages.collect():
        page = r["html"]
        # pages whose article holds nothing but its own text
        if len(re.findall("<article", page)) == 1 and not re.search("<(aside|form|div|section|script|style|nav|ul|footer|header|button)", page[page.index("<article") : page.index("</article")]):
            reader = Article()
            reader.feed(page)
            reader.cut()
            simple, same = simple + 1, same + ("\n".join(reader.parts) == got[r["page_id"]])
    assert simple > 20 and same / simple > 0.97


def test_licences_in_their_usual_words(spark):
    s = license_scan.SENTENCES | license_scan.MORE_SENTENCES
    wrap = lambda t, n: re.sub(f"(.{{1,{n}}})(?: |$)", "\\1\n", t)
    bsd = [s[k] for k in ("bsd-conditions", "bsd-source", "bsd-binary", "bsd-names")]
    rows = {
        1: (wrap(s["gpl2-or-later"], 70), "GPL-2.0-or-later"), 2: (wrap(s["gpl2-only"], 50), "GPL-2.0"), 3: (s["mpl11-grant"], "MPL-1.1"),
        4: ("Released under the" + " " * 500 + "MIT License.", "MIT"), 5: ("A title\n" + wrap(s["lgpl21-or-later"], 40), "LGPL-2.1-or-later"),
        6: ("\n\n".join([bsd[0], "1. " + bsd[1], "2. " + wrap(bsd[2], 60)]), "BSD-2-Clause"), 7: ("\n".join(wrap(x, 75) for x in bsd), "BSD-3-Clause"),
        8: (wrap(s["zlib-as-is"] + " " + s["zlib-permission"], 30), "Zlib"), 9: (s["mpl-grant"].replace("2.0", "1.1"), ""), 10: (wrap(s["cc-by-sa-int"], 25), "CC-BY-SA-4.0"),
        11: ("// " + wrap(s["boost"], 30).replace("\n", "\n// "), "BSL-1.0"), 12: (s["agpl3-or-later"] + "\x01", "AGPL-3.0-or-later"), 13: (s["mit-permission-full"], ""),
        14: (wrap(s["mit-permission-full"], 75) + "\n" + wrap(s["mit-as-is"], 75), "MIT"), 15: ("Released under\n\nthe MIT License.", ""),
    }
    got = {r["doc_id"]: r["licenses"] for r in license_scan.scan(spark.createDataFrame([(k, t) for k, (t, _) in rows.items()], DOCS)).collect()}
    assert got == {k: want for k, (_, want) in rows.items()}


def test_phrases_count_in_short_lines(spark):
    long = "all rights reserved " + " ".join(f"word{k}" for k in range(25)) + " end."
    rows = [(1, long), (2, "All rights reserved by the owner of it, one two three four.")]
    assert {r["doc_id"] for r in quality_rules.with_rules(spark.createDataFrame(rows, DOCS)).filter("kept").collect()} == {1}


def test_shallow_trees_match_all_cuts():
    rng = np.random.default_rng(5)
    for _ in range(50):
        n = int(rng.integers(1, 9))
        g, h = rng.normal(size=n), rng.uniform(0.1, 1, n)
        score = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 2.0)
        gains = [score(0, k) + score(k, n) - score(0, n) for k in range(1, n)]
        gain, k = quality_gam.best_cut(g, h, 2.0)
        assert gain == pytest.approx(max(gains, default=0.0)) and (not gains or gains[k - 1] == pytest.approx(max(gains)))
        leaf = quality_gam.shallow_tree(g, h, 2.0, 1)
        cuts = [(0, k), (k, n)] if gains and max(gains) > 1e-9 else [(0, n)]
        want = np.concatenate([np.full(b - a, g[a:b].sum() / (h[a:b].sum() + 2.0)) for a, b in cuts])
        assert leaf == pytest.approx(want)


def test_scores_match_a_plain_rerun(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    texts, marks = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["quality"] for r in labels.collect()}
    out = zlib.crc32
    model = quality_gam.train(docs, labels)
    learned = [k for k in marks if k in texts and out(str(k).encode()) % 4 != 2]
    mine = quality_gam.fit(np.array([quality_gam.features(texts[k]) for k in sorted(learned)]), np.array([marks[k] for k in sorted(learned)], float))
    for r in quality_gam.scored(docs, model).collect():
        x = quality_gam.features(texts[r["doc_id"]])
        bins = lambda edges: [sum(v >= e for e in es) for v, es in zip(x, edges, strict=True)]
        fine, rough = bins(model.edges), bins(model.coarse)
        logit = model.base + sum(t[b] for t, b in zip(model.tables, fine, strict=True)) + sum(t[rough[i], rough[j]] for (i, j), t in model.pairs.items())
        score = 1 / (1 + np.exp(-min(max(logit, -30), 30)))
        assert r["score"] == pytest.approx(score, abs=1e-9) and r["predicted"] == (score >= 0.7) and r["held_out"] == (out(str(r["doc_id"]).encode()) % 4 == 2)
        assert mine.score(np.array([x]))[0] == pytest.approx(score, abs=0.02)


def test_equal_rows_and_copies_leave_one(spark):
    a = " ".join(f"a{k}" for k in range(80))
    rows = [(1, a), (1, a), (2, a), (1, a + " z"), (5, None), (5, None), (6, "")]
    left = minhash.clean_documents(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r["doc_id"], r["text"] is None) for r in left) == [(1, False), (5, True), (5, True), (6, False)]


def corpus():
    """Documents for all stages: rejected ones, boilerplate, copies, benchmark passages, long ones, odd rows."""
    rng = random.Random(11)
    words = ["".join(rng.choice("aeinorstlm") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    body = lambda n: "\n".join(sentence(rng.randint(8, 20)) for _ in range(n))
    items = [(k, sentence(rng.choice([5, 15, 30]))) for k in range(12)]
    docs = [(k, body(rng.randint(2, 9)), rng.choice(["s1", "s2"])) for k in range(70)]
    site = ["Home | News | Shop", "The site of all and every one.", "click here"]
    docs += [(100 + k, site[k % 3] + "\n" + body(4) + "\n" + site[1], "s3") for k in range(30)]
    for k in range(25):  # copies, near ones around the threshold
        w = docs[k][1].split(" ")
        for _ in range(rng.choice([0, 1, 1, 2, 5, 9])):
            w[rng.randrange(len(w))] = rng.choice(words)
        docs.append((200 + k, " ".join(w), "s1"))
    docs += [(300 + k, body(rng.choice([1, 4, 30])) + "\n" + items[k % 12][1], "s2") for k in range(24)]
    docs += [(400, body(900), "s1"), (401, None, "s1"), (402, "", None), (403, "too short.", None), (404, (sentence(6) + "\n") * 9, "s1"), (405, "# $ % & * | < > x # $ %\n" * 3 + sentence(4), "s2")]
    docs += [docs[3], docs[3], (3, body(3), "s1"), (None, body(5), None)]
    return docs, items


def plain_pipeline(docs, items):
    """All five stages in plain Python; rows (doc_id, text, source)."""
    spaced = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]
    out = []
    for doc_id, text, source in docs:
        w = spaced(text)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        hit = {i + k for i, g in enumerate(grams) for k in range(5) if grams.count(g) > 1}
        lines = [x.strip(" \t\r\x0b\x0c") for x in (text or "").split("\n") if spaced(x)]

        def bad(x):
            n, blanks, low = len(x.encode()), x.count(" "), x.lower()
            phrase = any(re.search("(^|[^0-9a-zß-öø-ɏ])" + p + "($|[^0-9a-zß-öø-ɏ])", low) for p in quality_rules.BOILERPLATE)
            marks = 100 * sum(x.count(c) for c in "#*$%&|<>") > 10 * n
            return x.count("|") >= 2 or marks or x.count("!!") >= 3 or phrase and blanks <= 20 or x[-1] not in ".!?:;…\"”’»)" and blanks >= 30

        good = [x for x in lines if not bad(x)]
        if len(w) >= 10 and 5 * len(hit) <= len(w) and sum(map(len, lines)) - sum(map(len, good)) <= 0.3 * sum(map(len, lines)):
            out.append((doc_id, "\n".join(good), source))
    pages, on = {}, {}
    for _, text, source in out:
        pages[source] = pages.get(source, 0) + 1
        for x in {x.strip(" \t\r\x0b\x0c") for x in text.split("\n")} - {""}:
            on[source, x] = on.get((source, x), 0) + 1
    goes = {k for k, n in on.items() if n >= 5 and n > 0.05 * pages[k[0]]}
    out = [(d, "\n".join(x for x in t.split("\n") if (s, x.strip(" \t\r\x0b\x0c")) not in goes), s) for d, t, s in out]
    sets = []
    for _, text, _ in out:
        w = spaced(text.translate(str.maketrans(common.UPPER, common.LOWER)))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(out)))
    for i in range(len(out)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    best = {}
    for k, g in enumerate(group):
        order = (out[k][0] is None, out[k][0] if out[k][0] is not None else 0)
        if not sets[k] or order < best.get(g, ((True, 1 << 60), None))[0]:
            best[g if sets[k] else ("empty", k)] = (order, k)
    out = [out[k] for _, k in best.values()]
    alnum = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(str.maketrans(common.UPPER, common.LOWER))) if w]
    windows = {tuple(w[i : i + 13]) for _, t in items if (w := alnum(t)) for i in range(max(1, len(w) - 12))}
    clean = []
    for doc_id, text, source in out:
        w = alnum(text)
        hit = {i + k for x in windows for i in range(len(w) - len(x) + 1) if tuple(w[i : i + len(x)]) == x for k in range(len(x))}
        if not hit or 20 * len(hit) < len(w):
            clean.append((doc_id, text, source))
    full, pieces = Tokenizer.from_file(WORD), []
    for doc_id, text, _ in clean:
        ids = [*full.encode(text or "", add_special_tokens=False).ids, 2]
        pieces += [(doc_id, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes()), len(ids)) for k in range(0, len(ids), 4096)]
    return pieces


def test_pipeline_matches_brute_force(spark, tmp_path):
    import corpus_pipeline as P

    docs, items = corpus()
    spark.createDataFrame([(d, t, "en", s, len(t) if t is not None else None) for d, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = P.run(spark, str(tmp_path)).collect()
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r))
    assert order([tuple(r)[:5] for r in got]) == order(plain_pipeline(docs, items))
    used = {}
    for r in got:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(used.values()) <= 4096


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_common_lines_without_broadcast(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = lambda: sorted((r["doc_id"], r["n_dropped"], r["text"]) for r in line_dedup.without_boilerplate(docs, ratio=0.001, min_pages=2).collect())
    want = rows()
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    assert rows() == want and any(n for _, n, _ in want)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())


def test_sets_without_estimates_give_the_same_groups(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(300)}" for _ in range(50)]
    docs = spark.createDataFrame([(k, " ".join(w if rng.random() > 0.03 else f"v{rng.randrange(300)}" for w in base)) for k in range(40)], DOCS)
    rows = lambda **how: sorted(map(tuple, minhash.near_duplicates(docs, **how).collect()))
    assert rows() == rows(slack=None)


def test_packing_deals_equal_rows(spark):
    docs = spark.createDataFrame([(1, "same words in all rows")] * 300, DOCS).withColumn("x", F.lit(1))
    rows = packing.pack(docs, WORD, shard_pieces=50).collect()
    assert len(rows) == 300 and len({r["sequence_id"] >> 40 for r in rows}) > 3
