import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.config import long_reads, short_reads
from strandlake.functions import statistics
from strandlake.functions.sequences import CODONS
from strandlake.operators import alignment, postfilter
from strandlake.operators.alignment import lines
from strandlake.plans import queries as Q
from strandlake.plans import search
from strandlake.sources import fasta, fastq

from .conftest import SF

TABLES = "documents benchmark labels".split()


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_matches_sql(spark, name):
    base = duckdb.connect()
    for t in TABLES:
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = Q.queries()[name](spark, SF)
    want = base.execute(Q.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(tuple(r[c] for c in columns) for r in got.collect())
    assert rows == sorted(map(tuple, want[columns].astype(object).values.tolist()))


def brute(dna, protein, table, gap_open, gap_extend, shift, q0, r0, sign):
    """The best score of an extension from base q0 and amino acid r0, cell by cell."""
    n, m, best = (len(dna) - q0, len(protein) - r0, 0) if sign > 0 else (q0, r0, 0)
    s = [[-(10**9)] * (n + 1) for _ in range(m + 1)]
    for i in range(m + 1):
        for j in range(n + 1):
            v = s[i][j] if i or j else 0
            if i and j >= 3:
                at = q0 + j - 3 if sign > 0 else q0 - j
                p = int(table[ord(CODONS.get(dna[at : at + 3], "X")), ord(protein[r0 + i - 1 if sign > 0 else r0 - i])])
                v = max(v, s[i - 1][j - 3] + p)
                if shift:
                    v = max(v, s[i - 1][j - 2] + p - shift)
                    v = max(v, s[i - 1][j - 4] + p - shift) if j >= 4 else v
            for k in range(1, i + 1):
                v = max(v, s[i - k][j] - gap_open - k * gap_extend)
            for k in range(1, j // 3 + 1):
                v = max(v, s[i][j - 3 * k] - gap_open - k * gap_extend)
            s[i][j] = v
            best = max(best, v)
    return best


def rescored(dna, protein, table, gap_open, gap_extend, shift, q, r, ops):
    """The score of an edit script, and where it ends."""
    score, last = 0, ""
    for op in ops:
        if op in "/\\":
            score, q = score - shift, q + (1 if op == "\\" else -1)
        elif op == "M":
            score, q, r = score + int(table[ord(CODONS.get(dna[q : q + 3], "X")), ord(protein[r])]), q + 3, r + 1
        else:
            score -= gap_extend + (gap_open if op != last else 0)
            q, r = (q + 3, r) if op == "I" else (q, r + 1)
        last = op
    return score, q, r


MATRIX = [(a, b, 5 if a == b else -1 if a in "ARN" and b in "ARN" else -3) for a in "ARNDCX*" for b in "ARNDCX*"]


@settings(max_examples=80, deadline=None)
@given(st.text("ACGT", min_size=3, max_size=40), st.text("ARNDCXS", min_size=1, max_size=10), st.sampled_from([None, 3, 15]), st.data(), st.booleans())
def test_kernel_is_exact(dna, protein, shift, data, matrix):
    table = alignment.score_table(MATRIX if matrix else None, 6, -2)
    r0 = data.draw(st.integers(0, len(protein)))
    q0 = data.draw(st.integers(0, len(dna)))
    batch = alignment.Batch([dna, "A" + dna], [protein, protein], table, 3, 1, shift, 10**6)
    who, q, r = np.array([0, 1]), np.array([q0, q0 + 1]), np.array([r0, r0])
    for sign in (1, -1):
        score, i, j = batch.reach(who, q, r, sign)
        ops = batch.reach(who, q, r, sign, i)[3]
        assert score[0] == brute(dna, protein, table, 3, 1, shift, q0, r0, sign)
        start = (q0, r0) if sign > 0 else (q0 - int(j[0]), r0 - int(i[0]))
        stop = (q0 + int(j[0]), r0 + int(i[0])) if sign > 0 else (q0, r0)
        assert rescored(dna, protein, table, 3, 1, shift, *start, ops[0]) == (score[0], *stop)
        q_line, mid, r_line = lines(dna, protein, *start, ops[0], table)
        assert len(q_line) == len(mid) == len(r_line)


def test_drop_and_band_never_score_more():
    rng = random.Random(2)
    table = alignment.score_table(None, 6, -2)
    dna = "".join(rng.choice("ACGT") for _ in range(900))
    aa = "".join(CODONS[dna[k : k + 3]] for k in range(0, 897, 3))
    protein = aa[:120] + aa[135:200] + "".join(rng.choice("ARND") for _ in range(40)) + aa[200:]
    score = lambda drop, band: int(sum(alignment.Batch([dna], [protein], table, 3, 1, 15, drop, band).reach(np.array([0]), np.array([180]), np.array([60]), s)[0][0] for s in (1, -1)))
    full = score(10**6, 900)
    assert score(10**6, 150) == full and score(60, 900) <= full and score(10**6, 30) < full


def test_a_long_protein_takes_little_memory():
    import tracemalloc

    rng = random.Random(2)
    protein = "".join(rng.choice("ARNDCQEGHILKMFPSTWYV") for _ in range(4_000))
    back = {a: c for c, a in sorted(CODONS.items())}
    dna = "".join(back[a] for a in protein)
    dna = dna[:3_000] + "A" + dna[3_000:]
    table = alignment.score_table(None, 6, -2)
    tracemalloc.start()
    (found,) = alignment.aligned(alignment.Batch([dna], [protein], table, 11, 2, 15, 60), [[(6_001, 2_000)]], np.array([100]))
    assert tracemalloc.get_traced_memory()[1] < 80 << 20
    tracemalloc.stop()
    assert found[1] > 6 * 3_990 - 15 and found[4:6] == (0, 4_000) and found[6].count("\\") + found[6].count("/") == 1


def test_planted_homologies_on_both_strands_and_over_a_shift(spark):
    rng = random.Random(3)
    back = {}
    for codon, a in sorted(CODONS.items()):
        back.setdefault(a, codon)
    protein = "".join(rng.choice("ARNDCQEGHILKMFPSTWYV") for _ in range(60))
    gene = "".join(back[a] for a in protein)
    noise = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    turned = gene[::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads = [(1, noise(50) + gene + noise(40)), (2, noise(31) + turned + noise(20)), (3, noise(20) + gene[:90] + "A" + gene[90:] + noise(20)), (4, noise(300)), (5, "")]
    reads = spark.createDataFrame(reads, "doc_id long, dna string")
    proteins = spark.createDataFrame([(7, protein)], "prot_id long, aa string")
    found = {r["doc_id"]: r for r in search.blastx(reads, proteins, long_reads()).collect()}
    assert set(found) == {1, 2, 3}
    assert (found[1]["strand"], found[1]["score"]) == ("+", 360)
    assert (found[2]["strand"], found[2]["score"]) == ("-", 360)
    assert found[3]["r_stop"] - found[3]["r_start"] == 60 and any(c in found[3]["ops"] for c in "/\\")
    assert {r["doc_id"] for r in search.blastx(reads, proteins, short_reads()).collect()} == {1, 2, 3}


def test_several_alignments_of_a_read_and_protein(spark):
    rng = random.Random(7)
    back = {a: c for c, a in sorted(CODONS.items())}
    protein = "".join(rng.choice("ARNDCQEGHILKMFPSTWYV") for _ in range(120))
    gene = "".join(back[a] for a in protein)
    noise = "".join(rng.choice("ACGT") for _ in range(1200))
    reads = spark.createDataFrame([(1, gene[:180] + noise[:12] + gene[180:]), (2, gene[:150] + noise + gene[150:300])], "doc_id long, dna string")
    proteins = spark.createDataFrame([(7, protein + "A" * 5000)], "prot_id long, aa string")
    found = sorted((r["doc_id"], r["r_start"], r["r_stop"]) for r in search.blastx(reads, proteins, long_reads()).collect())
    assert found[0][:2] == (1, 0) and found[0][2] >= 118 and len(found) >= 2
    spans = [f[1:] for f in found if f[0] == 2]
    assert any(a <= 2 and b >= 48 for a, b in spans)


def test_a_matrix_file_gives_the_scores(spark, tmp_path):
    letters = "ARNDCQEGHILKMFPSTWYVX*"
    rows = {(a, b): (7 if a == b else 2 if {a, b} == {"A", "S"} else -4) for a in letters for b in letters}
    text = "/* " + ", ".join(letters) + " */\n" + "".join(f"/*{a}*/ " + ", ".join(str(rows[a, b]) for b in letters[:11]) + ",\n   " + ", ".join(str(rows[a, b]) for b in letters[11:]) + ",\n" for a in letters)
    (tmp_path / "m.txt").write_text(text)
    assert {(r["a"], r["b"]): r["score"] for r in statistics.read_matrix(spark, str(tmp_path / "m.txt")).collect()} == rows
    rng = random.Random(3)
    back = {a: c for c, a in sorted(CODONS.items())}
    protein = "".join(rng.choice("RNDCQEGHILKM") for _ in range(60)) + "A" * 3
    gene = "".join(back[a] for a in protein[:-3] + "SSS")
    reads, proteins = spark.createDataFrame([(1, gene)], "doc_id long, dna string"), spark.createDataFrame([(7, protein)], "prot_id long, aa string")
    (hit,) = search.blastx(reads, proteins, long_reads(matrix_path=str(tmp_path / "m.txt"))).collect()
    assert hit["score"] == 60 * 7 + 3 * 2 and hit["middle_line"].endswith("+++")


def test_statistics_of_scores():
    # the ungapped values of the first row of the table, for a rule with few scores, by its own definition
    table = alignment.score_table(None, 6, -2)
    lam, k, h = statistics.ungapped(table)
    same = sum((n / sum(statistics.BACKGROUND.values())) ** 2 for n in statistics.BACKGROUND.values())
    assert same * 2.718281828459045 ** (6 * lam) + (1 - same) * 2.718281828459045 ** (-2 * lam) == pytest.approx(1, abs=1e-6)
    assert 0 < k < 1 and h > 0
    with pytest.raises(ValueError, match="mean"):
        statistics.ungapped(alignment.score_table(None, 6, 1))


def test_dominated_alignments_go(spark):
    rows = [(1, 1, "+", 0, 90, 100.0), (1, 2, "+", 2, 88, 50.0), (1, 3, "+", 60, 200, 50.0), (2, 2, "+", 2, 88, 50.0)]
    found = spark.createDataFrame(rows, "doc_id long, prot_id long, strand string, q_start long, q_stop long, bitscore double")
    left = postfilter.not_dominated(found)
    assert sorted((r["doc_id"], r["prot_id"]) for r in left.collect()) == [(1, 1), (1, 3), (2, 2)]
    assert postfilter.not_dominated(left).count() == 3


@pytest.mark.parametrize("overlap, share", [(0.9, 0.9), (0.0, 1.0), (0.5, 0.7)])
def test_dominance_holds_within_a_protein(spark, overlap, share):
    rng = random.Random(3)
    rows = [(1, 1, "+", 0, 300, 200.0), (1, 1, "+", 10, 90, 30.0)]
    for _ in range(300):
        start = rng.randrange(400)
        rows.append((rng.randrange(2, 5), rng.randrange(3), rng.choice("+-"), start, start + rng.choice([1, 9, 40, 300]), float(rng.randrange(1, 60))))
    rows += rows[-5:]
    left = postfilter.not_dominated(spark.createDataFrame(rows, "doc_id long, prot_id long, strand string, q_start long, q_stop long, bitscore double"), overlap, share)
    beats = lambda b, a: b[0] == a[0] and min(a[4], b[4]) - max(a[3], b[3]) > overlap * (a[4] - a[3]) and share * b[5] > a[5]
    want = sorted(a for a in rows if not any(beats(b, a) for b in rows))
    assert sorted(tuple(r) for r in left.collect()) == want and (1, 1, "+", 10, 90, 30.0) not in want


def test_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nACGT\nacgu\n>two\nNNACGT\n>one\nTT\n")
    rows = fasta.first_of_names(fasta.read_fasta(spark, str(tmp_path / "a.fa")))
    assert {r["id"]: r["seq"] for r in rows.collect()} == {"one": "ACGTACGU", "two": "NNACGT"}
    assert {r["dna"] for r in search.reads_of(rows).collect()} == {"ACGTACGT", "AAACGT"}
    (tmp_path / "a.fq").write_text("@r1 x\nACGT\n+\n@@@@\n@r2\nGGG\n+\n>>>\n")
    assert {(r["id"], r["seq"], r["quality"]) for r in fastq.read_fastq(spark, str(tmp_path / "a.fq")).collect()} == {("r1", "ACGT", "@@@@"), ("r2", "GGG", ">>>")}
    (tmp_path / "m.txt").write_text("# c\n   A  R\nA  4 -1\nR -1  5\n")
    assert {(r["a"], r["b"]): r["score"] for r in statistics.read_matrix(spark, str(tmp_path / "m.txt")).collect()} == {("A", "A"): 4, ("A", "R"): -1, ("R", "A"): -1, ("R", "R"): 5}
    search.make_db(spark, str(tmp_path / "a.fa"), str(tmp_path / "db"))
    assert spark.read.parquet(str(tmp_path / "db/suffixes")).count() == 10


def test_adaptive_seeds_match_brute_force(spark):
    from strandlake.operators import index, seeding

    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ARN") for _ in range(n))
    proteins, peptides = {k: word(40) for k in range(6)}, {k: word(30) for k in range(8)}
    table = lambda d: spark.createDataFrame(list(d.items()), "prot_id long, aa string")
    query = index.suffixes(table(peptides)).select("prot_id", "pos", "suffix").toDF("q_id", "q_pos", "suffix")
    got = sorted(tuple(r) for r in seeding.adaptive_seed_join(query, index.suffixes(table(proteins)), 3).collect())
    suffixes = [(p, i, s[i : i + 32]) for p, s in proteins.items() for i in range(len(s) - 2)]
    want = []
    for q, s in peptides.items():
        for i in range(len(s) - 2):
            mine = s[i : i + 32]
            length = max(n for n in range(33) if n <= len(mine) and any(x.startswith(mine[:n]) for _, _, x in suffixes))
            if length > 3:
                hits = sorted((p, k) for p, k, x in suffixes if x.startswith(mine[:length]))
                want += [(q, i, p, k, length) for p, k in (hits if len(hits) <= 3 else hits[:1])]
    assert got == sorted(want) and want


def test_statistics_of_other_matrices_come_from_a_file(spark, tmp_path):
    from strandlake import __main__ as cli
    from strandlake.config import SearchConfig

    (tmp_path / "ka.txt").write_text("# matrix open extend lambda K H\nPAM250 11 3 0.174 0.020 0.070\nBLOSUM80 11 2 0.5 0.1 0.2\n")
    (tmp_path / "m.txt").write_text("   A  R\nA  4 -1\nR -1  5\n")
    found = lambda **c: search.scoring(spark, SearchConfig(matrix_path=str(tmp_path / "m.txt"), statistics_path=str(tmp_path / "ka.txt"), **c))[1:]
    assert found(matrix="PAM250", gap_open=11, gap_extend=3) == (0.174, 0.020)
    assert found() == (0.5, 0.1) and found(matrix="BLOSUM62", gap_open=11, gap_extend=1) == (0.267, 0.041)
    with pytest.raises(ValueError, match="PAM250"):
        found(matrix="PAM250", gap_open=1, gap_extend=1)
    args = cli.parser().parse_args(["blastx", "-i", "a", "-d", "b", "-o", "c", "--matrix", "PAM250", "--walk"])
    config = cli.config_of(args, statistics.known_rows(spark, str(tmp_path / "ka.txt")))
    assert (config.matrix, config.gap_open, config.gap_extend, config.query_skip) == ("PAM250", 11, 3, True)
    with pytest.raises(SystemExit, match="PAM250"):
        cli.config_of(args)
