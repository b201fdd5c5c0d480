"""What the findings of round 3 asked for: seeds by eight letters at once, counts within the tasks that find them."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandlake.functions import sequences
from strandlake.functions.sequences import peptides, reverse_complement
from strandlake.operators import alignment, extension, index, postfilter, seeding


def texts(rng, count, letters="AAACDEFGJX*", longest=60):
    base = "".join(random.Random(1).choice(letters) for _ in range(200))
    out = []
    for _ in range(count):
        a = rng.randrange(150)
        out.append("".join(rng.choice(letters) for _ in range(rng.randrange(longest))) + base[a : a + rng.randrange(50)])
    return out


def test_eight_letters_at_once_score_as_letter_by_letter():
    rng = random.Random(5)
    table = alignment.score_table(None, 6, -2)
    mine, theirs = texts(rng, 40), texts(rng, 40)
    (q, qs), (r, rs) = extension.joined(mine), extension.joined(theirs)
    pairs = [(rng.randrange(len(mine)), rng.randrange(len(theirs))) for _ in range(4000)]
    pairs = [(a, b) for a, b in pairs if mine[a] and theirs[b]]
    i = np.array([qs[a] + rng.randrange(len(mine[a])) for a, _ in pairs])
    j = np.array([rs[b] + rng.randrange(len(theirs[b])) for _, b in pairs])
    for x_drop in (3, 27, 100):
        eights = extension.Eights.of(table, x_drop)
        words = eights.words(q, 1), eights.words(r, 2)
        for step in (1, -1):
            want = extension.drop_off(q, r, i, j, step, np.full(len(i), x_drop), table)[0]
            assert (eights.best(*words, i, j, step) == want).all()
        least = np.full(len(i), 12)
        plain, fast = (extension.extended(q, r, i, j, least, x_drop, table, e) for e in (None, (eights, words[1])))
        assert all((a == b).all() for a, b in zip(plain, fast, strict=True)) and len(plain[0])
    # runs that go on beyond the gaps, and scores of more kinds, are extended letter by letter
    assert extension.Eights.of(table, 400) is None
    other = table.copy()
    other[ord("A"), ord("C")] = 1
    assert extension.Eights.of(other, 27) is None


def test_seed_counts_equal_the_join(spark, monkeypatch):
    rng = random.Random(6)
    peptides = [(k // 2 if k < 8 else k, t) for k, t in enumerate(texts(rng, 40))] + [(None, "ACDEFGACDEFG"), (None, "ACDEFGACDEFG"), (99, None), (98, "AC"), (97, "JJJJ*")]
    peptides = spark.createDataFrame(peptides, "q_id long, aa string")
    proteins = spark.createDataFrame([*enumerate(texts(rng, 30)), (50, None), (51, ""), (52, "ACDEFGACDEFGACDEFG")], "prot_id long, aa string")
    rows = lambda df: sorted(map(str, df.collect()))
    for multiplicity in (1, 3, 10):
        want = rows(extension.seed_counts(peptides, proteins, multiplicity, index_letters=0))
        query = index.suffixes(peptides.withColumnRenamed("q_id", "prot_id"), seeding.LONGEST).select(F.col("prot_id").alias("q_id"), F.col("pos").alias("q_pos"), "suffix")
        joined = seeding.adaptive_seed_join(query, index.suffixes(proteins.filter("aa IS NOT NULL"), seeding.LONGEST), multiplicity, small_partitions=True)
        assert want == rows(joined.groupBy("q_id", "prot_id", "len").agg(F.count("*").alias("n")))
        monkeypatch.setattr(extension.index, "suffixes", None)  # no suffix leaves the tasks
        assert rows(extension.seed_counts(peptides, proteins, multiplicity)) == want
        monkeypatch.setattr(extension, "MOST_BINS", 0)
        assert rows(extension.seed_counts(peptides, proteins, multiplicity)) == want
        monkeypatch.undo()
    none = proteins.filter("prot_id < 0")
    assert not rows(extension.seed_counts(peptides, none, 10)) and not rows(extension.seed_counts(peptides.filter("q_id < 0"), proteins, 10))


def homologies(rng, count):
    """Reads and proteins, most alike but for letters, gaps and shifts; seeds on and off the diagonal."""
    out = []
    for _ in range(count):
        dna = "".join(rng.choice("ACGT") for _ in range(rng.choice([1, 2, 5, 60, 300])))
        aa = peptides(dna + "ACG")[0]
        if rng.random() < 0.6 and len(aa) > 15:
            aa = "".join(rng.choice("ARNDX") if rng.random() < 0.1 else x for x in aa[: len(aa) // 2] + aa[len(aa) // 2 + rng.randrange(6) :])
            dna = dna[: len(dna) // 3] + "A" * rng.randrange(3) + dna[len(dna) // 3 :]
        else:
            aa = "".join(rng.choice("ARNDCQEGHILKX*") for _ in range(rng.choice([1, 3, 60])))
        r = rng.randrange(len(aa))
        out.append((dna, aa, [(min(3 * r, len(dna) - 1), r), (rng.randrange(len(dna)), rng.randrange(len(aa)))]))
    return out


def test_scores_in_16_bits_equal_the_traced_kernel():
    rng = random.Random(7)
    plain = alignment.score_table(None, 6, -2)
    other = plain.copy()
    other[ord("L"), ord("I")] = other[ord("I"), ord("L")] = 2
    rows = homologies(rng, 80)
    who = np.repeat(np.arange(len(rows)), 2)
    q, r = (np.array([s[k] for _, _, seeds in rows for s in seeds]) for k in (0, 1))
    for table in (plain, other):
        for shift, band, drop in ((15, 75, 61), (None, 30, 27), (15, 99, 200), (None, 99, 200)):
            batch = alignment.Batch([x[0] for x in rows], [x[1] for x in rows], table, 11, 2, shift, drop, band)
            assert batch.short
            for sign in (1, -1):
                want, got = batch.reach(who, q, r, sign), batch.best(who, q, r, sign)
                assert all((a == b).all() for a, b in zip(want, got, strict=True)) and want[0].max() > 200
    assert not alignment.Batch(["ACG"], ["T"], plain, 11, 2, 15, 10**6).short


def test_a_read_goes_once_with_all_its_chains(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(k // 3, k, "+-"[k % 2], aa, seeds) for k, (_, aa, seeds) in enumerate(homologies(rng, 60))]
    reads = {d: x for d, (x, _, _) in enumerate(homologies(random.Random(8), 20))}
    rows = [(d, p, s, aa, [(min(a, len(reads[d]) - 1), b) for a, b in seeds]) for d, p, s, aa, seeds in rows]
    rows += [(d, 100 + d, "-" if d % 2 else "+", peptides(x)[3 if d % 2 else 0], [(0, 0)]) for d, x in reads.items() if len(x) > 30]
    chains = spark.createDataFrame(rows, "doc_id long, prot_id long, strand string, protein string, seeds array<struct<q: long, r: long>>")
    texts = spark.createDataFrame([(d, x, 20) for d, x in reads.items()], "doc_id long, dna string, least long")
    how = (alignment.score_table(None, 6, -2), 11, 2, 15, 61, 75)
    dna = F.when(F.col("strand") == "+", F.col("dna")).otherwise(reverse_complement(F.col("dna")))
    want = sorted(map(tuple, alignment.gapped(chains.join(texts, "doc_id").withColumn("dna", dna), *how).collect()))
    by_read = chains.groupBy("doc_id").agg(F.collect_list(F.struct("prot_id", "strand", "protein", "seeds")).alias("chains")).join(texts, "doc_id")
    for most in (4096, 3):
        monkeypatch.setattr(alignment, "PREPARED", most)
        assert sorted(map(tuple, alignment.gapped_by_read(by_read, *how).collect())) == want and len(want) > 5


def test_subjects_are_numbered_from_one_pass_over_the_seeds(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    found = spark.range(0, 1000, 1, 4).select(F.expr("id % 50 * 3").alias("prot_id")).mapInArrow(counted, "prot_id long")
    out = sorted((r["prot_id"], r["subject"]) for r in postfilter.subject_ids(found, parts=7).collect())
    assert out == [(3 * k, k) for k in range(50)]
    assert seen.value == 1000


def test_kmers_of_long_texts_are_made_in_pieces(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(k, "".join(rng.choice("ACDEFG") for _ in range(n))) for k, n in enumerate([0, 3, 4, 5, 9, 10, 11, 40, 200, 7])] + [(20, None)]
    df = spark.createDataFrame(rows, "id long, aa string").coalesce(1)
    want = sorted((i, p) for i, t in rows for p in range(len(t or "") - 4))
    whole = sorted(map(tuple, sequences.kmers(df, "aa", 5, ["id"]).collect()))
    assert [x[:2] for x in whole] == want
    monkeypatch.setattr(sequences, "KMER_LETTERS", 10)
    pieces = list(sequences.text_pieces(pa.RecordBatch.from_pydict({"t": [t for _, t in rows]}), 0, 5))
    assert max(sum(len(x) for _, _, x in some) for _, some in pieces) <= 10 + 4 + 10 + 4
    assert sorted((rows[n][0], b + p) for _, some in pieces for n, b, x in some for p in range(len(x) - 4)) == want
