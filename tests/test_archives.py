"""Archives, result files, readers and the command line."""

import random
import struct

import pytest
from hypothesis import given
from hypothesis import strategies as st

from strandlake import __main__ as cli
from strandlake.functions.sequences import CODONS
from strandlake.operators import alignment
from strandlake.plans import search
from strandlake.sources import daa, fasta, fastq, results

BACK = {a: c for c, a in sorted(CODONS.items())}


@given(st.text("ACGT", max_size=50))
def test_bases_come_back(dna):
    packed = daa.packed_bases(dna)
    assert len(packed) == -(-len(dna) // 4) and daa.unpacked_bases(packed, len(dna)) == dna
    three = bytes(sum(b << k for k, b in enumerate(bits)) for bits in zip(*[iter([x for c in dna for x in [("ACGTN".index(c) >> k) & 1 for k in range(3)]] + [0] * 7)] * 8))
    assert daa.unpacked_bases(three, len(dna), 3) == dna


@given(st.integers(0, 2), st.integers(0, 2**32 - 1))
def test_numbers_come_back(kind, n):
    n %= 1 << (8 << kind)
    assert daa.packed_number(b"x" + n.to_bytes(1 << kind, "little"), 1, kind) == (n, 1 + (1 << kind))


@given(st.lists(st.sampled_from(["M", "M", "M", "S", "I", "D", "/", "\\\\"[:1]]), max_size=200), st.randoms())
def test_edit_scripts_come_back(kinds, rng):
    dna, subject, ops = "ACG", "", ""
    for kind in kinds:
        codon = "".join(rng.choice("ACGT") for _ in range(3))
        if kind in "MSI":
            dna, ops = dna + codon, ops + ("I" if kind == "I" else "M")
            a = CODONS[codon]
            subject += "" if kind == "I" else a if kind == "M" else rng.choice("ARND".replace(a, ""))
        elif kind == "D":
            subject, ops = subject + "W", ops + "D"
        elif kind == "/":
            dna, ops = dna[:-1], ops + "/"
        else:
            dna, ops = dna + "A", ops + "\\"
    table = alignment.score_table(None, 1, -1)
    # a base read twice changes the codon before it, so the lines are made from the whole strand
    subject = list(subject)
    q, _, r = alignment.lines(dna, "".join(subject), 3, 0, ops, table) if "/" not in ops else ("", "", "")
    if "/" in ops:
        return
    script = daa.edit_bytes(q, r)
    assert 0 not in script
    back = daa.edit_lines(script, dna, 3, table)
    assert back[0] == ops and (back[1], back[3]) == (q, r) and back[4] == len(dna) - 3 and back[5] == len(subject)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    rng = random.Random(5)
    folder = tmp_path_factory.mktemp("files")
    proteins = {f"p{k}|x": "".join(rng.choice("ARNDCQEGHILKMFPSTWYV") for _ in range(rng.randint(60, 130))) for k in range(6)}
    (folder / "db.fa").write_text("".join(f">{n} protein A->B of x\n{s[:50]}\n{s[50:]}\n" for n, s in proteins.items()))
    genes = ["".join(BACK[a] for a in s) for s in proteins.values()]
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads = {"r0": "ACGTAC" + genes[0], "r1": turn(genes[1]) + "AC", "r2": genes[2][:99] + "A" + genes[2][99:] + genes[3], "r3": "ACGT" * 40}
    (folder / "reads.fa").write_text("".join(f">{n} a>b\n{s}\n" for n, s in reads.items()))
    (folder / "reads.fq").write_text("".join(f"@{n} x\n{s}\n+\n{'@' * len(s)}\n" for n, s in reads.items()))
    return folder, proteins, reads


@pytest.fixture(scope="module")
def searched(spark, files):
    folder, *_ = files
    cli.main(["makedb", "-i", str(folder / "db.fa"), "-d", str(folder / "db")])
    cli.main(["blastx", "-i", str(folder / "reads.fa"), "-d", str(folder / "db"), "-o", str(folder / "daa")])
    return folder


def test_headers_of_files_may_hold_marks(spark, files):
    folder, proteins, reads = files
    assert {r["id"]: r["seq"] for r in fasta.read_fasta(spark, str(folder / "db.fa")).collect()} == proteins
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = fastq.read_fastq(spark, str(folder / "reads.fq"))
        assert spark.read.text(str(folder / "reads.fq")).rdd.getNumPartitions() > 2
        assert {r["id"]: r["seq"] for r in lines.collect()} == reads and sorted(r["rank"] for r in lines.collect()) == list(range(len(reads)))
        assert {r["id"]: r["seq"] for r in fasta.read_fasta(spark, str(folder / "reads.fa")).collect()} == reads
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_archive_holds_the_alignments(spark, searched, files):
    _, proteins, reads = files
    rows = daa.read_daa(spark, str(searched / "daa")).collect()
    assert {(r["read_name"], r["subject"], r["strand"]) for r in rows} >= {("r0", "p0|x", "+"), ("r1", "p1|x", "-"), ("r2", "p2|x", "+"), ("r2", "p3|x", "+")}
    best = {(r["read_name"], r["subject"]): r for r in rows}
    whole = best["r0", "p0|x"]
    assert (whole["q_start"], whole["q_stop"], whole["r_start"], whole["r_stop"]) == (6, 6 + 3 * len(proteins["p0|x"]), 0, len(proteins["p0|x"]))
    assert whole["subject_line"] == proteins["p0|x"] and whole["dna"] == reads["r0"] and whole["ref_len"] == len(proteins["p0|x"])
    assert best["r1", "p1|x"]["query_line"] == proteins["p1|x"] and any(c in best["r2", "p2|x"]["ops"] for c in "/\\")
    (head,) = daa.read_headers(spark, str(searched / "daa")).collect()
    assert (head["db_seqs"], head["db_letters"], head["reads"], head["shift"], head["matrix"]) == (6, sum(map(len, proteins.values())), 3, 15, "BLOSUM80")
    (content,) = [r["content"] for r in daa.volumes_of(spark, str(searched / "daa")).collect()]
    assert struct.unpack_from("<q", content)[0] == daa.MAGIC and daa.HEADER.size == 2448


def test_archives_convert_to_what_the_search_gives(spark, searched):
    cli.main(["blastx", "-i", str(searched / "reads.fq"), "-d", str(searched / "db"), "-o", str(searched / "tab"), "--format", "tab22"])
    cli.main(["convert", "-i", str(searched / "daa"), "-o", str(searched / "tab2"), "--format", "tab22"])
    read = lambda p: sorted(tuple(r) for r in spark.read.option("sep", "\t").csv(str(searched / p)).collect())
    one, two = read("tab"), read("tab2")
    assert len(one[0]) == len(results.BLAST_TAB_EXTENDED) == 22
    near = lambda a, b: all(x == y or abs(float(x) - float(y)) <= 1e-6 * abs(float(x)) for x, y in zip(a, b, strict=True))
    assert len(one) == len(two) and all(map(near, one, two))


def test_merged_archives_hold_each_alignment_once(spark, searched):
    cli.main(["merge", "-i", str(searched / "daa"), str(searched / "daa"), "-o", str(searched / "both")])
    rows = lambda p: sorted(map(tuple, daa.read_daa(spark, str(searched / p)).collect()))
    assert rows("both") == rows("daa")


def test_one_file_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    rng = random.Random(11)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    rows = []
    for k in range(80):
        protein = word("ARNDCQEGHILKMFPSTWYV", rng.randrange(5, 40))
        dna = word("ACGT", 6) + "".join(BACK[a] for a in protein) + word("ACGT", 7)
        for s in range(rng.randrange(1, 4)):
            n = len(protein)
            rows.append((f"read {k}", dna, f"s{rng.randrange(30)}", "+", 6 * n, 6, 6 + 3 * n, s, n + s, len(dna), n + 9, "M" * n, protein, protein, protein))
    lengths = {r[2]: r[10] for r in rows}
    rows = [(*r[:10], lengths[r[2]], *r[11:]) for r in rows]
    from strandlake.config import SearchConfig

    daa.write_daa(spark.createDataFrame(rows, daa.SCHEMA), str(tmp_path / "one archive"), 30, 999, SearchConfig(), 0.3, 0.1)
    for chunk in (daa.CHUNK, 64):
        monkeypatch.setattr(daa, "CHUNK", chunk)
        (path,) = [r["path"] for r in daa.volumes_of(spark, str(tmp_path / "one archive")).select("path").collect()]
        with daa.opened(path) as file:
            parts = list(daa.ranges(file, 500))
            names = daa.subject_names(file, daa.header_of(open(path.removeprefix("file:"), "rb").read())["blocks"], {0, 7})[0]
        assert len(parts) > 10 and all(b == c for (_, b), (c, _) in zip(parts, parts[1:], strict=False)) and set(names) == {0, 7}
    found = daa.read_daa(spark, str(tmp_path / "one archive"), range_bytes=500)
    assert sorted(map(tuple, found.collect())) == sorted(rows) and found.rdd.getNumPartitions() == len(parts)
    some = daa.read_daa(spark, str(tmp_path / "one archive"), reads=["read 3", "read 77", "none"], range_bytes=500).collect()
    assert sorted(map(tuple, some)) == sorted(r for r in rows if r[0] in ("read 3", "read 77"))
    monkeypatch.setattr(daa, "arrow_opens", lambda *_: False)
    assert sorted(map(tuple, daa.read_daa(spark, str(tmp_path / "one archive"), range_bytes=500).collect())) == sorted(rows)
    assert daa.read_headers(spark, str(tmp_path / "one archive")).first()["reads"] == 80


def test_volumes_keep_the_order_of_reads(spark, tmp_path):
    from strandlake.config import SearchConfig

    rng = random.Random(2)
    names = [f"r{rng.randrange(10**6)}" for _ in range(300)]
    (tmp_path / "x.fa").write_text("".join(f">{n}\nACGTACGTACGT\n" for n in names))
    once = list(dict.fromkeys(names))
    reads = search.reads_of(fasta.read_fasta(spark, str(tmp_path / "x.fa")))
    assert [r["id"] for r in reads.orderBy("doc_id").collect()] == once
    hit = spark.createDataFrame([("s", "+", 9, 0, 12, 0, 4, 12, 4, "MMMM", "TYVR", "TYVR", "TYVR")], ", ".join(daa.SCHEMA.split(", ")[2:]))
    found = reads.withColumnsRenamed({"id": "read_name"}).crossJoin(hit)
    daa.write_daa(found, str(tmp_path / "o"), 1, 4, SearchConfig(), 0.3, 0.1, volume_rows=40)
    files = sorted(r["path"] for r in daa.volumes_of(spark, str(tmp_path / "o")).select("path").collect())
    order = []
    for f in files:
        with daa.opened(f) as file:
            for start, stop in daa.ranges(file, 10**6):
                file.seek(start)
                order += [name for name, *_ in daa.reads_in(file.read(stop - start))]
    assert order == once and len(files) > 5


def test_an_index_is_written_as_fasta(spark, searched, files, tmp_path):
    cli.main(["dump", "-d", str(searched / "db"), "-o", str(tmp_path / "fasta")])
    assert {r["id"]: r["seq"] for r in fasta.read_fasta(spark, str(tmp_path / "fasta")).collect()} == files[1]


def test_merging_of_empty_and_unlike_archives(spark, searched, tmp_path):
    (tmp_path / "empty").mkdir()
    cli.main(["merge", "-i", str(tmp_path / "empty"), str(searched / "daa"), "-o", str(tmp_path / "one")])
    rows = lambda p: sorted(map(tuple, daa.read_daa(spark, str(p)).collect()))
    assert rows(tmp_path / "one") == rows(searched / "daa")
    cli.main(["merge", "-i", str(tmp_path / "empty"), "-o", str(tmp_path / "none")])
    assert rows(tmp_path / "none") == []
    cli.main(["blastx", "-i", str(searched / "reads.fa"), "-d", str(searched / "db"), "-o", str(tmp_path / "other"), "-F", "20"])
    with pytest.raises(ValueError, match="differ"):
        cli.main(["merge", "-i", str(tmp_path / "other"), str(searched / "daa"), "-o", str(tmp_path / "mixed")])


def test_pairwise_text_and_xml(spark, searched, files):
    _, proteins, _ = files
    cli.main(["convert", "-i", str(searched / "daa"), "-o", str(searched / "text"), "--format", "pairwise"])
    text = "\n".join(r["value"] for r in spark.read.text(str(searched / "text")).collect())
    first = text[text.index("Query=r0") : text.index("Query=r1")]
    aa = proteins["p0|x"]
    n = len(aa)
    assert f"Identities = {n}/{n} (100.00%)" in first and f"Query       7 {aa[:60]} {6 + 180}" in first and f"Sbjct       1 {aa[:60]} 60" in first
    assert f"Query     187 {aa[60:120]} {6 + 3 * min(n, 120)}" in first and "Frame = 1" in first
    cli.main(["convert", "-i", str(searched / "daa"), "-o", str(searched / "xml"), "--format", "xml"])
    rows = spark.read.format("xml").option("rowTag", "Iteration").load(str(searched / "xml")).collect()
    assert {r["Iteration_query-ID"] for r in rows} == {"r0", "r1", "r2"}


def test_command_line_refuses_what_has_no_meaning(capsys):
    for bad in (["blastx"], ["blastx", "-i", "a", "-d", "b", "-o", "c", "-m", "0"], ["blastx", "-i", "a", "-d", "b", "-o", "c", "-e", "x"], ["blastx", "-i", "a", "-d", "b"]):
        with pytest.raises(SystemExit):
            cli.main(bad)
    args = cli.parser().parse_args(["blastx", "-i", "a", "-d", "b", "-o", "c", "--gop", "3"])
    with pytest.raises(SystemExit, match="11/2"):
        cli.config_of(args)
    args = cli.parser().parse_args(["blastx", "-i", "a", "-d", "b", "-o", "c", "-F", "0"])
    assert cli.config_of(args).frameshift is None


def test_empty_results_are_files_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], daa.SCHEMA)
    from strandlake.config import SearchConfig

    daa.write_daa(none, str(tmp_path / "e"), 0, 0, SearchConfig(), 0.3, 0.1)
    assert daa.read_daa(spark, str(tmp_path / "e")).count() == 0
