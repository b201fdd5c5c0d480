"""Walks, merged seeds, folds over scores and FASTQ records over splits, against plain Python."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from strandlake.config import long_reads
from strandlake.operators import alignment, chaining, extension, optimality, replay
from strandlake.plans import queries, search
from strandlake.sources import fastq

HITS = "doc_id long, frame int, prot_id long, q_pos int, r_pos int, length int, score long, at int, match int"


def walked(hits):
    """Position by position: hits that no earlier one covers on its diagonal; then on behind the longest match."""
    out = set()
    for peptide in {h[:2] for h in hits}:
        own, covered, at = [h for h in hits if h[:2] == peptide], {}, 0
        while at <= max(h[7] for h in own):
            longest = 0
            for h in sorted(x for x in own if x[7] == at):
                diagonal = h[2], h[3] - h[4]
                if covered.get(diagonal, -1) > at:
                    continue
                out.add(h)
                covered[diagonal] = max(covered.get(diagonal, -1), h[3] + h[5])
                longest = max(longest, h[8])
            at += longest + 1
    return out


@pytest.mark.parametrize("batch", [5, 10_000])
def test_a_walk_skips_matched_letters(spark, batch):
    rng = random.Random(1)
    hits = set()
    for _ in range(700):
        at, r, back = rng.randrange(150), rng.randrange(60), rng.randrange(4)
        hits.add((rng.randrange(4), rng.choice([1, -2]), rng.randrange(3), at - back, r - back, back + rng.randrange(1, 30), 9, at, rng.randrange(3, 9)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = [tuple(r) for r in replay.query_skip(spark.createDataFrame(sorted(hits), HITS)).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {h for h in walked(hits)}
    # of hits alike in place and diagonal the first one counts
    assert len(got) == len(set(got)) and {h[:2] + h[7:8] for h in got} == {h[:2] + h[7:8] for h in want}
    assert replay.query_skip(spark.createDataFrame([], HITS)).collect() == []


@pytest.mark.parametrize("letters", [extension.INDEX_LETTERS, 0])
def test_the_search_can_walk(spark, letters):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ARNDCQ") for _ in range(n))
    proteins = {k: word(60) for k in range(4)}
    peptides = [(1, 1, word(9) + proteins[2] + word(7) + proteins[3][10:50]), (2, -1, proteins[0][:30] + proteins[1][30:])]
    rows = spark.createDataFrame(peptides, "doc_id long, frame int, aa string")
    base = spark.createDataFrame(list(proteins.items()), "prot_id long, aa string")
    found = extension.seeds(rows, base, 10, alignment.score_table(None, 6, -2), 0.365, 0.168, letters, origin=True)
    hits = {tuple(r) for r in found.collect()}
    assert {tuple(r) for r in replay.query_skip(found).collect()} == walked(hits) and len(walked(hits)) < len(hits)


def test_a_search_that_walks_finds_the_planted_alignments(spark):
    sf = "/root/testdata/sf0.001"
    reads, proteins = queries.planted_reads(spark, sf).limit(40), queries.planted_proteins(spark, sf)
    best = lambda c: {(r["doc_id"], r["prot_id"]): r["score"] for r in search.blastx(reads, proteins, c).groupBy("doc_id", "prot_id").agg(F.max("score").alias("score")).collect()}
    all_hits, walk = best(long_reads()), best(long_reads(query_skip=True))
    own = [k for k in all_hits if k[1] == 2 * k[0]]
    assert own and all(walk.get(k) == all_hits[k] for k in own)


def merged_plainly(seeds):
    groups = {}
    for d, f, p, q, r, n, s in sorted(seeds, key=lambda x: (x[0], x[2], x[1] < 0, 3 * x[3] + abs(x[1]) - 1, x[4], x[1], x[5])):
        groups.setdefault((d, p, "-" if f < 0 else "+"), []).append([f, 3 * q + abs(f) - 1, r, n, s])
    out = []
    for key, own in groups.items():
        line, last = [], None
        for f, a, r, n, s in own:
            if last and last[0] == f and a - last[1] == 3 * (r - last[2]) and a - last[1] < 3 * last[3]:
                line[-1][2], line[-1][4] = r + n, max(line[-1][4], s)
            else:
                line.append([f, a, r + n, r, s])
            last = f, a, r, n
        line = [[f, a, a + 3 * (stop - r), r, stop, s] for f, a, stop, r, s in line]
        while True:
            gone = [y for x, y in zip(line, line[1:], strict=False) if y[1] >= x[1] and y[2] <= x[2] and y[3] >= x[3] and y[4] <= x[4]]
            if not gone:
                break
            line = [x for x in line if not any(x is y for y in gone)]
        for x, y in zip(line, line[1:], strict=False):
            over = max(x[2] - y[1], 0)
            over = min(over + -over % 3, y[2] - y[1])
            y[1], y[3] = y[1] + over, y[3] + over // 3
        out += [(key[0], key[1], key[2], *x) for x in line if x[1] < x[2]]
    return sorted(out)


@pytest.mark.parametrize("batch", [3, 10_000])
def test_seeds_are_merged_contained_and_trimmed(spark, batch):
    rng = random.Random(6)
    seeds = {(rng.randrange(3), rng.choice([1, 2, 3, -1]), rng.randrange(2), q := rng.randrange(40), max(0, q - rng.choice([0, 0, 1, 7])), rng.choice([2, 5, 12]), rng.randrange(9)) for _ in range(300)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = chaining.merged(spark.createDataFrame(sorted(seeds), "doc_id long, frame int, prot_id long, q_pos int, r_pos int, length int, score long"))
        got = sorted(tuple(r) for r in rows.select("doc_id", "prot_id", "strand", "frame", "q_start", "q_stop", "r_start", "r_stop", "score").collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == merged_plainly(seeds) and len(got) < len(seeds)


def test_folds_over_scores(spark):
    rng = random.Random(7)
    steps = [[rng.choice([6, 6, -2, -5]) for _ in range(rng.randrange(14))] for _ in range(400)]
    drop = 6

    def extension_is_optimal(x):
        total = best = 0
        for s in x:
            total += s
            if total > best:
                best = total
            elif total < best - drop or total <= 0:
                return False
        return bool(x) and total == best and total > 0

    def alignment_is_optimal(x):
        total = best = 0
        for s in x:
            total, best = total + s, max(best, total + s)
            if total < best - drop:
                return False
        return True

    rows = spark.createDataFrame([(k, x) for k, x in enumerate(steps)], "k int, steps array<int>")
    out = rows.select("k", optimality.optimal_extension(F.col("steps"), drop).alias("e"), optimality.optimal_alignment(F.col("steps"), drop).alias("a")).collect()
    assert [(r["e"], r["a"]) for r in sorted(out)] == [(extension_is_optimal(x), alignment_is_optimal(x)) for x in steps]
    assert len({r["e"] for r in out}) == len({r["a"] for r in out}) == 2


def test_columns_of_an_alignment_are_scored(spark):
    table = alignment.score_table(None, 6, -2)
    lines = [("ARND/CQ", "ARND-CQ"), ("AR--ND", "ARCCND"), ("ARCCND", "AR--ND"), ("AR-CND", "ARC-ND"), ("AXN", "AXD"), ("", "")]
    want = [[6, 6, 6, 6, -15, 6, 6], [6, 6, -13, -2, 6, 6], [6, 6, -13, -2, 6, 6], [6, 6, -13, -13, 6, 6], [6, -2, -2], []]
    rows = spark.createDataFrame([(k, *x) for k, x in enumerate(lines)], "k int, query_line string, subject_line string")
    steps = optimality.alignment_steps(table, 11, 2, 15)
    assert [r["s"] for r in rows.select("k", steps.alias("s")).orderBy("k").collect()] == want
    assert sorted(r["k"] for r in optimality.optimal(rows, table, 11, 2, 15, 12).collect()) == [4, 5]


def test_alignments_score_what_their_columns_do(spark):
    sf, config = "/root/testdata/sf0.001", long_reads()
    found = search.blastx(queries.planted_reads(spark, sf).limit(60), queries.planted_proteins(spark, sf), config)
    steps = optimality.alignment_steps(alignment.score_table(None, config.match, config.mismatch), config.gap_open, config.gap_extend, config.frameshift)
    rows = found.select("score", "ops", F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x).alias("sum")).collect()
    assert rows and all(r["score"] == r["sum"] for r in rows) and any("\\" in r["ops"] or "/" in r["ops"] for r in rows)


def records(rng, count, width, longest=90):
    out = []
    for k in range(count):
        n = rng.choice([0, 1, width, 2 * width, rng.randrange(longest)])
        out.append((f"r{k}", "".join(rng.choice("ACGTN") for _ in range(n)), "".join(rng.choice("@+@+IF#") for _ in range(n))))
    return out


def as_text(rows, width, end="\n"):
    cut = lambda s: end.join(s[k : k + width] for k in range(0, len(s), width)) + end if s else ""
    return "".join(f"@{n} some words{end}{cut(s)}+{n if k % 2 else ''}{end}{cut(q)}" for k, (n, s, q) in enumerate(rows))


@pytest.mark.parametrize("width, split, end", [(7, 50, "\n"), (13, 300, "\r\n"), (1000, 3000, "\n"), (3, 10_000, "\n")])
def test_fastq_of_several_lines_over_splits(spark, tmp_path, width, split, end):
    rng = random.Random(width)
    files = {"a": records(rng, 60, width), "b": records(rng, 5, width, 400) + [("long", "ACGT" * 300, "@+I@" * 300)] + records(rng, 30, width), "c": []}
    for name, rows in files.items():
        (tmp_path / f"{name}.fq").write_text(as_text(rows, width, end), newline="")
    with gzip.open(tmp_path / "d.fq.gz", "wt") as f:
        f.write(as_text(files["a"], width, end))
    spark.conf.set("spark.sql.files.maxPartitionBytes", f"{split}b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {}
        for r in fastq.read_fastq(spark, str(tmp_path / "*.fq*")).collect():
            got.setdefault(r["file"].rsplit("/", 1)[1][0], {})[r["rank"]] = (r["id"], r["seq"], r["quality"])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {n: dict(enumerate(rows)) for n, rows in {**files, "d": files["a"]}.items() if rows}


def test_fastq_that_is_cut_off_is_refused(spark, tmp_path):
    (tmp_path / "x.fq").write_text("@a\nACGT\n+\nIIII\n@b\nACGT\n+\nII\n")
    with pytest.raises(ValueError, match="within a record"):
        fastq.read_fastq(spark, str(tmp_path / "x.fq"))
