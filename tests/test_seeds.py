import random

import pytest

from strandlake.config import long_reads
from strandlake.operators import alignment, chaining, extension, index, neighbours, seeding
from strandlake.plans import search

DNA = {"A": "GCT", "R": "CGT", "N": "AAT", "D": "GAT", "C": "TGT", "Q": "CAA", "E": "GAA", "G": "GGT", "H": "CAT", "K": "AAA"}


def table(spark, d):
    return spark.createDataFrame(list(d.items()), "prot_id long, aa string")


def brute_seeds(peptides, proteins, m, small, longest=100):
    suffixes = [(p, i, s[i : i + longest]) for p, s in proteins.items() for i in range(len(s) - 2)]
    out = []
    for q, s in peptides.items():
        for i in range(len(s) - 2):
            mine = s[i : i + longest]
            group = [(p, k) for p, k, x in suffixes if x[:3] == mine[:3]]
            if small and len(group) <= m:
                out += [(q, i, p, k, 3) for p, k in group]
                continue
            length = max(n for n in range(len(mine) + 1) if any(x.startswith(mine[:n]) for _, _, x in suffixes))
            if length > 3:
                hits = sorted((p, k) for p, k, x in suffixes if x.startswith(mine[:length]))
                out += [(q, i, p, k, length) for p, k in (hits if len(hits) <= m else hits[:1])]
    return sorted(out)


def repeated():
    """Proteins that share a passage of 60 letters and differ behind it, and peptides that hold one of them."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("ARNDCQ") for _ in range(n))
    passage = word(60)
    proteins = {k: word(5) + passage + word(20) for k in range(12)}
    return {1: word(4) + proteins[9][3:], 2: word(40), 3: "AR"}, proteins


@pytest.mark.parametrize("small", [False, True])
def test_adaptive_seeds_tell_long_repeats_apart(spark, small):
    peptides, proteins = repeated()
    query = index.suffixes(table(spark, peptides), seeding.LONGEST).selectExpr("prot_id AS q_id", "pos AS q_pos", "suffix")
    got = seeding.adaptive_seed_join(query, index.suffixes(table(spark, proteins), seeding.LONGEST), 10, small_partitions=small)
    got = sorted(tuple(r) for r in got.collect())
    assert got == brute_seeds(peptides, proteins, 10, small)
    assert any(p == 9 and n > 60 for _, _, p, _, n in got) and any(n == 3 for *_, n in got) == small


def brute_extended(peptides, proteins, hits, least, x_drop, match=6, mismatch=-2):
    def side(q, r, i, j, step, drop):
        now = best = n = k = 0
        while 0 <= i < len(q) and 0 <= j < len(r) and best - now < drop:
            now += match if q[i] == r[j] and q[i] not in "X*" else mismatch
            i, j, k = i + step, j + step, k + 1
            if now > best:
                best, n = now, k
        return best, n

    out = set()
    for q, i, p, j, _ in hits:
        for drop in (x_drop, round(0.1 * least[q])):
            (a, n), (b, m) = side(peptides[q], proteins[p], i, j, -1, drop), side(peptides[q], proteins[p], i + 1, j + 1, 1, drop)
            if a + b < least[q] and drop == x_drop:
                break
        else:
            n = max(n, 1)
            out.add((q, 1, p, i - n + 1, j - n + 1, n + m, a + b))
    return out


@pytest.mark.parametrize("letters", [extension.INDEX_LETTERS, 0])
def test_extended_seeds_match_brute_force(spark, letters):
    rng = random.Random(4)
    peptides, proteins = repeated()
    peptides[4] = "".join(c if rng.random() > 0.12 else rng.choice("ARNDX") for c in proteins[3])  # no long exact run
    proteins[20], peptides[5] = "HHGKHGKKEEHK", "ARHHGKHGKKXEHKA"  # small partitions
    lam, k = 0.365249, 0.168504
    sizes = {q: int(extension.least_score(extension.np.array([len(s)]), sum(map(len, proteins.values())), lam, k)[0]) for q, s in peptides.items()}
    want = brute_extended(peptides, proteins, brute_seeds(peptides, proteins, 10, True), sizes, 27)
    rows = spark.createDataFrame([(q, 1, s) for q, s in peptides.items()], "doc_id long, frame int, aa string")
    got = [tuple(r) for r in extension.seeds(rows, table(spark, proteins), 10, alignment.score_table(None, 6, -2), lam, k, letters).collect()]
    assert set(got) == want and {q for q, *_ in want} >= {1, 4, 5}


def test_homologies_without_an_exact_run_of_ten_are_aligned(spark):
    rng = random.Random(6)
    protein = "".join(rng.choice("ARNDCQEGHK") for _ in range(63))
    other = "".join("A" if k % 8 == 7 and c != "A" else "R" if k % 8 == 7 else c for k, c in enumerate(protein))
    assert not any(other[i : i + 10] in protein for i in range(54))
    reads = spark.createDataFrame([(1, "ACG" * 5 + "".join(DNA[c] for c in other) + "TTGAC")], "doc_id long, dna string")
    found = search.blastx(reads, table(spark, {7: protein}), long_reads()).collect()
    assert [(r["doc_id"], r["prot_id"], r["strand"]) for r in found] == [(1, 7, "+")] and found[0]["r_stop"] - found[0]["r_start"] > 55


@pytest.mark.parametrize("range_rows, query_rows", [(40, 30), (7, 1000), (10_000, 25)])
def test_ranges_of_suffixes_find_all_neighbours(spark, range_rows, query_rows):
    peptides, proteins = repeated()
    rng = random.Random(2)
    # a suffix that half of the base holds, prefixes over many splits, and peptides alike
    proteins |= {20 + k: "AAAAAAAAAA" + "".join(rng.choice("AR") for _ in range(20)) for k in range(15)} | {40 + k: "RNDCRNDCRNDC" for k in range(15)}
    peptides |= {10 + k: "RNDCRNDAAAAAARA" for k in range(6)} | {30: "HHHHHH", 31: "NAAAAAAAAAAAAAAAAAAAAAR"}
    query = index.suffixes(table(spark, peptides), 30).selectExpr("prot_id AS q_id", "pos AS q_pos", "suffix")
    found = neighbours.matches(query, index.suffixes(table(spark, proteins), 30), 10, 30, range_rows, query_rows)
    got = sorted(tuple(r) for r in found.select("q_id", "q_pos", "prot_id", "pos", "len").collect())
    assert got == brute_seeds(peptides, proteins, 10, False, 30)


def test_extension_sends_each_text_once_a_block(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ARNDCQEGHK") for _ in range(n))
    proteins = {k: word(40) for k in range(30)}
    peptides = {k: word(5) + proteins[k % 30][4:36] + word(5) for k in range(60)}
    pairs = [(q, 1, i, q % 30, i - 1) for q in peptides for i in range(5, 30)] + [(q, 1, 3, 29 - q % 30, 3) for q in peptides]
    frame = spark.createDataFrame(pairs, "doc_id long, frame int, q_pos int, prot_id long, r_pos int")
    reads = spark.createDataFrame([(q, 1, s) for q, s in peptides.items()], "doc_id long, frame int, aa string")
    scores, lam, k = alignment.score_table(None, 6, -2), 0.365249, 0.168504
    one, many = (
        {tuple(r) for r in extension.extended_pairs(frame, reads, table(spark, proteins), 1200, scores, 27, lam, k, block_letters=b, block_pairs=p).collect()} for b, p in ((10**6, 10**6), (200, 60))
    )
    sizes = {q: int(extension.least_score(extension.np.array([len(s)]), 1200, lam, k)[0]) for q, s in peptides.items()}
    assert one == many == brute_extended(peptides, proteins, [(q, i, p, j, 0) for q, _, i, p, j in pairs], sizes, 27) and one


def brute_chains(seeds, lengths, by_frame):
    """Chains of seeds (doc, frame, prot, q, r, length, score), group by group."""
    groups = {}
    for d, f, p, q, r, n, s in seeds:
        kind = (f < 0, abs(f) if by_frame else 0)
        groups.setdefault((d, p), {}).setdefault(kind, []).append((3 * q + abs(f) - 1, r, n, s))
    out = {}
    for (d, p), kinds in groups.items():
        best = None
        for kind in sorted(kinds):
            width = max(0.06 * 3 * lengths[p], 10.0)
            placed = sorted((x[0] - 3 * x[1], x) for x in kinds[kind])
            for y, _ in placed:
                inside = [x for z, x in placed if y <= z <= y + width]
                weight = sum(x[3] for x in inside)
                if best is None or weight > best[0]:
                    best = weight, kind, inside
        _, kind, inside = best
        line, rest = [], []
        for nt, r, n, _ in sorted(inside, key=lambda x: (-x[3], x[:3])):
            fits = all((b <= r) if (a, b, c) <= (nt, r, n) else (b >= r) for a, b, c in line)
            (line if fits else rest).append((nt, r, n))
        middles = [(nt + 3 * (n // 2), r + n // 2) for nt, r, n in line + rest]
        out[d, p] = "-" if kind[0] else "+", min(x[0] for x in line), max(x[0] + 3 * x[2] for x in line), min(x[1] for x in line), max(x[1] + x[2] for x in line), len(line), middles
    return out


@pytest.mark.parametrize("by_frame", [False, True])
@pytest.mark.parametrize("together, batch", [(256, 10_000), (4, 7)])
def test_chains_over_group_bounds(spark, monkeypatch, by_frame, together, batch):
    monkeypatch.setattr(chaining, "TOGETHER", together)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rng = random.Random(5)
        lengths = {p: rng.randrange(5, 200) for p in range(6)}
        protein = [rng.choice([0, 0, 0, 1, 2, 3, 4, 5]) for _ in range(900)]
        seeds = {(rng.randrange(8), rng.choice([1, 2, 3, -1, -2, -3]), p, rng.randrange(120), rng.randrange(lengths[p]), rng.randrange(1, 9), rng.randrange(20, 26)) for p in protein}
        rows = spark.createDataFrame(sorted(seeds), "doc_id long, frame int, prot_id long, q_pos int, r_pos int, length int, score long")
        proteins = spark.createDataFrame([(p, "A" * n) for p, n in lengths.items()], "prot_id long, aa string")
        got = {(r["doc_id"], r["prot_id"]): (*r[2:8], [tuple(x) for x in r["seeds"]]) for r in chaining.chains(rows, proteins, by_frame).collect()}
        assert got == brute_chains(seeds, lengths, by_frame) and any(len(x[6]) > x[5] > 1 for x in got.values())
        assert chaining.chains(rows.limit(0), proteins).collect() == []
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("letters", [extension.INDEX_LETTERS, 0])
def test_a_sampled_index_finds_the_planted_seeds(spark, letters):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("ARNDCQEGHILKMFPSTWYV") for _ in range(n))
    proteins = {k: word(rng.choice([4, 5, 80])) for k in range(30)}
    base = table(spark, proteins)
    places = {(p, int(i)) for p, aa in proteins.items() for i in extension.sampled_places(aa, 3, 6)}
    found = index.suffixes(base)
    assert {(r["prot_id"], r["pos"]) for r in index.sampled(found, base, 3, 6).collect()} == places and len(places) < 0.6 * found.count()
    peptides = [(k, 1, word(9) + "".join(c if i % 17 else rng.choice("AR") for i, c in enumerate(aa)) + word(5)) for k, aa in proteins.items() if len(aa) > 50]
    rows = spark.createDataFrame(peptides, "doc_id long, frame int, aa string")
    seeds = lambda s: {tuple(r) for r in extension.seeds(rows, base, 10, alignment.score_table(None, 6, -2), 0.365, 0.168, letters, sampling=s).collect()}
    every, some = seeds(None), seeds((3, 6))
    best = lambda x: {(d, p): max(s for a, _, b, *_, s in x if (a, b) == (d, p)) for d, _, p, *_ in x if d == p}
    assert best(some) == best(every) and len(best(every)) == len(peptides)


@pytest.mark.parametrize("range_rows", [5, 60, 10_000])
def test_neighbours_over_ranges_share_prefixes(spark, range_rows):
    _, proteins = repeated()
    proteins |= {30 + k: "AAAAAAAAAAAA" for k in range(9)}
    rows = sorted((s[i : i + 127], p, i) for p, s in proteins.items() for i in range(len(s) - 2))
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    lcp = [0] + [common(a[0], b[0]) for a, b in zip(rows, rows[1:], strict=False)]
    want = {(p, i): n if n >= 3 else 0 for (_, p, i), n in zip(rows, lcp, strict=True)}
    got = index.lcp_neighbours(index.suffixes(table(spark, proteins), 127), 127, range_rows).collect()
    assert {(r["prot_id"], r["pos"]): r["lcp"] for r in got} == want and len(got) == len(want)
