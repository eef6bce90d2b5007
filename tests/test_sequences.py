import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinspan.api import evaluate_clustering, extract_sequences, find_domains
from kinspan.functions import sequences as S
from kinspan.operators import alignment as A
from kinspan.operators import evaluation as E
import os

from kinspan.operators.aligners import ALIGNERS, Aligner, Step, align
from kinspan.operators.alignment import conservation_index
from kinspan.sources import fasta, gff, hits, sinks, structures

HIT = "{}\t{}\t0.9\t50\t0\t0\t{}\t{}\t{}\t{}\t1e-5\t99\n"


def write(path, text):
    path.write_text(text)
    return f"file://{path}"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scalar_functions(spark):
    rc = S.standardise(S.reverse_complement(F.lit("acguACGU")))
    assert one(spark, rc) == "ACGUacgu"
    assert one(spark, S.iupac_density(F.lit("AC-GN"))) == 0.25
    assert one(spark, S.iupac_density(F.lit("--"))) == 0
    assert one(spark, S.gff_id(F.lit("x=1;ID=ab;y"))) == "ab"


def test_hits_errors(spark, tmp_path):
    cases = {
        "empty": ("", ValueError),
        "self": (HIT.format("a", "a", 1, 9, 1, 9), ValueError),
        "short": ("a\tb\t1\n", ValueError),
        "word": (HIT.format("a", "b", "x", 9, 1, 9), ValueError),
        "zero": (HIT.format("a", "b", 0, 9, 1, 9), ValueError),
        "split": (HIT.format("a", "b", 1, 9, 1, 9) + HIT.format("b", "c", 1, 9, 1, 9) + HIT.format("a", "c", 1, 9, 1, 9), ValueError),
        "timeout": ("_TimeoutError_\n", TimeoutError),
    }
    for name, (text, error) in cases.items():
        with pytest.raises(error):
            hits.read_blast_tab(spark, write(tmp_path / f"{name}.tsv", text))
    with pytest.raises(FileNotFoundError):
        hits.read_blast_tab(spark, f"file://{tmp_path}/none.tsv")
    fine = "# comment\n\n" + HIT.format("a", "a", "x", 9, 1, 9) + HIT.format("a", "b", 60, 10, 1, 9) + HIT.format("b", "a", 5, 9, 1, 9)
    assert hits.read_blast_tab(spark, write(tmp_path / "fine.tsv", fine)).count() == 2


def test_fasta(spark, tmp_path):
    path = write(tmp_path / "a.fasta", ">s1 first\nACG\nT\n>s2\nAC GT\n>s1\nTTTT\n>s3\n")
    assert fasta.count(spark, path) == 4
    assert fasta.count(spark, f"file://{tmp_path}/none") == 0
    assert dict(fasta.sequences(spark, path).collect()) == {"s1": "TTTT", "s2": "ACGT", "s3": ""}
    assert {r["seq_name"]: r["seq_id"] for r in fasta.registry(spark, path).collect()} == {"s1": 0, "s2": 1, "s3": 2}
    kept = fasta.rna_dataset(spark, write(tmp_path / "b.fasta", ">a\nACGTACGTACGTACGT\n>b\nACGUNRRRYSWKMBDH\n"), "d").collect()
    assert [(r["header"], r["sequence"]) for r in kept] == [("a", "ACGUACGUACGUACGU")]
    sto = write(tmp_path / "a.sto", "# STOCKHOLM 1.0\n\na  AC-\nb  ACG\n\na  GU\nb  --\n#=GC SS_cons ..\n//\n")
    assert {r["header"]: r["sequence"] for r in fasta.stockholm(spark, sto, "d").collect()} == {"a": "AC-GU", "b": "ACG--"}


def test_run_over_files(spark, tmp_path):
    fa = write(tmp_path / "a.fasta", "".join(f">{n}\n{'A' * 100}\n" for n in ("seq1", "seq2", "seq3")))
    tsv = write(tmp_path / "a.tsv", HIT.format("seq1", "seq2", 10, 60, 20, 70) + HIT.format("seq1", "seq3", 15, 65, 30, 80) + HIT.format("seq2", "seq3", 25, 75, 35, 85))
    out = find_domains(spark, tsv, fa, f"file://{tmp_path}/gff", min_dom_sim=0.2, min_fam_sim=0.1, min_dom_dens=0, min_fam_dens=0, halo_method=None, min_containment=0.5)
    assert sorted(map(tuple, out.collect())) == [("seq1", 10, 60, "+", 0), ("seq2", 25, 75, "+", 0)]
    lines = [r["value"] for r in spark.read.text(f"file://{tmp_path}/gff").collect()]
    assert "##gff-version 3" in lines and "seq1\tmmseqs2\tDomain\t10\t60\t.\t+\t.\tID=0" in lines


def test_extraction_and_remap(spark, tmp_path):
    fa = write(tmp_path / "c.fasta", f">chr1\n{'ACGU' * 15}\n>chr2\n{'ACGU' * 15}\n")
    row = "{}\tx\tDomain\t{}\t{}\t.\t{}\t.\tID={}\n"
    own = write(tmp_path / "c.gff", row.format("chr1", 10, 40, "+", "cluster_1") + row.format("chr1", 15, 45, "+", "cluster_1") + row.format("chr2", 5, 35, "-", "cluster_2") + row.format("chr2", 10, 40, "-", "cluster_2") + row.format("chrX", 1, 4, "+", "none"))
    ref = write(tmp_path / "r.gff", row.format("chr1", 12, 35, "+", "rfam_1") + row.format("chr2", 8, 30, "-", "rfam_2"))
    found, moved = extract_sequences(spark, fa, own, ref)
    assert found.count() == 4
    got = sorted((r["seqid"], r["start"], r["end"], r["strand"]) for r in moved.collect())
    assert got == [
        ("cluster_1::chr1::10_40_flank0", 3, 26, "+"), ("cluster_1::chr1::15_45_flank0", 1, 21, "+"),
        ("cluster_2::chr2::10_40_flank0", 11, 31, "+"), ("cluster_2::chr2::5_35_flank0", 6, 28, "+"),
    ]
    sinks.export_by_feature(found, moved, f"file://{tmp_path}/export")
    assert sorted(p.name for p in (tmp_path / "export/fasta").iterdir() if p.is_dir()) == ["feature_id=cluster_1", "feature_id=cluster_2"]


def alignment(spark, *rows):
    return A.cells(spark.createDataFrame([("d", f"s{i}", s) for i, s in enumerate(rows)], "dataset string, header string, sequence string"))


def test_trimming(spark):
    cells = alignment(spark, "-----ACGUACGU-----", "-----ACGUAGCU-----")
    for trimmed in (A.crop_from_ends(cells), A.gappyout(cells)):
        assert sorted(r["sequence"] for r in A.sequences(trimmed).collect()) == ["ACGUACGU", "ACGUAGCU"]
    dbn = spark.createDataFrame([("d", ".......((..)).....")], "dataset string, dbn string")
    assert {len(r["sequence"]) for r in A.sequences(A.mask_by_structure(cells, dbn)).collect()} == {10}
    empty = alignment(spark, "----", "----")
    assert A.sequences(A.gappyout(empty)).first()["sequence"] == "----"


def test_metrics(spark):
    cells = alignment(spark, "ACGU--ACGU", "ACGUACACGU")
    row = A.metrics(cells).first()
    assert (row["entropy"], row["tcs"], row["mean_identity"]) == (0, 100, 80)
    assert A.overlap_score({"a": cells, "b": cells}).first()["mos"] == 1
    single = A.metrics(alignment(spark, "ACGU")).first()
    assert (single["tcs"], single["mean_identity"]) == (100, 100)


def test_identities_of_long_alignments_agree_with_a_plain_count(spark):
    rnd = random.Random(2)
    rows = ["".join(rnd.choice("ACGUN-.") for _ in range(150)) for _ in range(12)]
    rows[3] = "-" * 150
    cells = alignment(spark, *rows)
    found = {(r.a, r.b): (r.same, r.either) for r in A.pair_counts(cells, block=5).collect()}
    gap = lambda c: c in "-."
    names = [f"s{i}" for i in range(12)]
    wanted = {}
    for i, x in enumerate(rows):
        for j, y in enumerate(rows):
            if names[i] < names[j]:
                both = [(a, b) for a, b in zip(x, y) if not (gap(a) and gap(b))]
                wanted[names[i], names[j]] = (sum(a == b for a, b in both), len(both))
    assert found == wanted
    shares = [100 * a / b for a, b in wanted.values() if b]
    row = A.identity(cells).first()
    assert (row["mean_identity"], row["median_identity"]) == (pytest.approx(np.mean(shares)), pytest.approx(np.median(shares)))
    with pytest.raises(Exception, match="beyond the planes"):
        A.pair_counts(alignment(spark, "AÉ", "AC")).collect()


def test_covariation_of_many_sequences_agrees_with_a_plain_count(spark):
    rnd = random.Random(6)
    rows = ["".join(rnd.choice("ACGU-") for _ in range(70)) for _ in range(150)]
    rows = [r[:68] + {"A": "U", "C": "G", "G": "C", "U": "A", "-": "-"}[r[0]] + r[69] for r in rows]
    found = {(r.i, r.j): r.mi for r in A.covariation(alignment(spark, *rows)).collect()}
    assert len(found) == 70 * 69 // 2
    for i, j in [(0, 1), (0, 68), (5, 66), (63, 64), (68, 69)]:
        seen = [(r[i], r[j]) for r in rows if r[i] in "ACGU" and r[j] in "ACGU"]
        n, xy, x, y = len(seen), Counter(seen), Counter(a for a, _ in seen), Counter(b for _, b in seen)
        assert found[i, j] == pytest.approx(sum(c / n * math.log2(c * n / (x[a] * y[b])) for (a, b), c in xy.items()), abs=1e-9)


def test_cutoffs_are_reached_by_whole_numbers(spark):
    # 15 of 30 positions: a product of two shares falls short of a half
    features = spark.createDataFrame([("ref", "r", "s", 0, 22, 30, 1), ("pred", "p", "s", 0, 15, 15, 2)], "label_type string, label string, seq_id string, start long, end long, whole long, ord long")
    parts = spark.createDataFrame([("s", 0, 15, "r", "p"), ("s", 15, 22, "r", None)], "seq_id string, start long, end long, ref string, pred string")
    rows = {r.label: r for r in E.majority_partners(features, parts, whole="whole").collect()}
    assert (rows["r"].share, rows["r"].partner_50, rows["r"].partner_75) == (0.5, "p", None) and rows["p"].partner_90 == "r"


def test_unlabelled_regions_have_labels_of_their_own(spark):
    parts = spark.createDataFrame([("s", 0, 5, None, "p"), ("s", 5, 9, None, None), ("s", 9, 12, "r", None), ("s", 12, 15, None, None)], "seq_id string, start long, end long, ref string, pred string")
    rows = [(r.ref, r.pred) for r in E.with_unlabelled(parts).orderBy("start").collect()]
    assert rows == [("UNL_ref_s_0", "p"), ("UNL_ref_s_0", "UNL_pred_s_5"), ("r", "UNL_pred_s_5"), ("UNL_ref_s_12", "UNL_pred_s_5")]


@pytest.mark.parametrize(("queries", "fine"), [("aab|bcc", True), ("aa|aa|ab", True), ("ab|a", False), ("aba|c", False), ("aa|b|a", False), ("ab|bb|bc", True), ("ab|cb", False)])
def test_queries_that_come_back_in_another_part_of_the_file(spark, tmp_path, queries, fine):
    for i, part in enumerate(queries.split("|")):
        (tmp_path / f"part-{i}.tsv").write_text("".join(HIT.format(q, "t", 1, 9, 1, 9) for q in part))
    # a file opens a part each; Spark reads larger files first, so these are padded to fall in size
    for i, path in enumerate(sorted(tmp_path.iterdir())):
        path.write_text(path.read_text() + "#" * (5000 - 1000 * i) + "\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "6000")
    spark.conf.set("spark.sql.files.openCostInBytes", "6000")
    try:
        if fine:
            assert hits.read_blast_tab(spark, f"file://{tmp_path}").count() == len(queries.replace("|", ""))
        else:
            with pytest.raises(ValueError, match="comes back"):
                hits.read_blast_tab(spark, f"file://{tmp_path}")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_arguments_out_of_range(spark):
    from kinspan.operators.domains import spurious_parents
    from kinspan.operators.dpc import dpc

    nodes = spark.createDataFrame([(0, 1), (1, 1)], "id int, w int")
    edges = lambda s: spark.createDataFrame([(0, 1, s)], "a int, b int, sim double")
    for options in ({"min_sim": 0.0, "min_dens": 1}, {"min_sim": 0.5, "min_dens": -1}, {"min_sim": 0.5, "min_dens": 1, "halo_tau": -0.1}, {"min_sim": 0.5, "min_dens": 1, "halo_method": "x"}):
        with pytest.raises(ValueError):
            dpc(nodes, edges(0.5), **options)
    with pytest.raises(Exception, match="between 0 and 1"):
        dpc(nodes, edges(1.5), min_sim=0.5, min_dens=1)
    with pytest.raises(ValueError):
        spurious_parents(nodes, nodes, 1.1)


def test_covariation(spark):
    cells = alignment(spark, "AU", "UA", "GC", "CG")
    row = A.covariation(cells).first()
    # two columns that determine each other: MI 2 bits, row means 1, overall mean 1
    assert row["mi"] == 2 and row["apc"] == 1
    pairs = A.bracket_pairs(spark.createDataFrame([("d", "()")], "dataset string, dbn string"))
    assert A.base_pairs(cells, pairs).first()["compensatory"] == 1


@pytest.mark.parametrize("dbn", ["((..))", "(()", "())(", ")(", "([{<>}])", "(a(b)c)d)e(f(g)"])
def test_brackets(spark, dbn):
    stack, want = [], set()
    for i, ch in enumerate(dbn):
        if ch in "({<[":
            stack.append(i)
        elif ch in ")}>]" and stack:
            want.add((stack.pop(), i))
    got = A.bracket_pairs(spark.createDataFrame([("d", dbn)], "dataset string, dbn string"))
    assert {(r["i"], r["j"]) for r in got.collect()} == want


def test_missing_tool(spark):
    rows = spark.createDataFrame([("d", "a", "ACGU"), ("d", "b", "ACGU"), ("e", "a", "AC")], "dataset string, header string, sequence string")
    out = {r["dataset"]: r for r in align(rows, Aligner("none", (Step(("no-such-tool", "in.fasta")),))).collect()}
    assert not out["d"]["is_successful"] and "not installed" in out["d"]["message"]
    assert "fewer than two" in out["e"]["message"]
    copied = align(rows.where("dataset = 'd'"), Aligner("cat", (Step(("cat", "in.fasta")),)))
    assert sorted((r["header"], r["sequence"]) for r in copied.collect()) == [("a", "ACGU"), ("b", "ACGU")]


def test_evaluation(spark, tmp_path):
    fa = write(tmp_path / "e.fasta", f">s1\n{'A' * 100}\n>s2\n{'A' * 50}\n")
    row = "{}\tx\tDomain\t{}\t{}\t.\t+\t.\tID={}\n"
    ref = write(tmp_path / "e1.gff", row.format("s1", 1, 40, "R1") + row.format("s1", 41, 80, "R2") + row.format("s2", 1, 50, "R1"))
    pred = write(tmp_path / "e2.gff", row.format("s1", 1, 80, "P1") + row.format("s2", 1, 70, "P2"))
    out = evaluate_clustering(spark, fa, ref, pred, report=f"file://{tmp_path}/report")
    labels = ["R1P1"] * 40 + ["R2P1"] * 40 + ["U1U2"] * 20 + ["R1P2"] * 50
    n = len(labels)
    same = lambda key: sum(key(a) == key(b) for i, a in enumerate(labels) for b in labels[:i])
    i, a, b = same(lambda x: x), same(lambda x: x[:2]), same(lambda x: x[2:])
    e = a * b / (n * (n - 1) / 2)
    scores = out["scores"].first()
    assert scores["adjusted_rand"] == pytest.approx((i - e) / ((a + b) / 2 - e))
    assert (scores["total_seqs"], scores["total_nt"]) == (2, 150)
    assert [r["ref_ids"] for r in out["glued_refs"].collect()] == ["R1; R2"]
    assert [(r["ref"], r["pred_ids"]) for r in out["split_refs"].collect()] == [("R1", "P1; P2")]
    assert out["all_refs"].count() == 2
    cover = {r["label_type"]: r for r in out["coverage"].collect()}
    assert (cover["ref"]["fully_labeled_seqs"], cover["ref"]["partially_labeled_seqs"], cover["ref"]["unlabeled_nucleotides"]) == (1, 1, 20)
    with pytest.raises(KeyError):
        gff.labelled_features(spark, write(tmp_path / "e3.gff", row.format("s9", 1, 4, "R")), "ref", fasta.lengths(spark, fa))


def test_one_class_scores(spark):
    table = spark.createDataFrame([("r", "p", 5, 1)], "ref string, pred string, nt long, seqs long")
    assert E.adjusted_rand(table).first()[0] == 1 and E.normalised_mutual_information(table).first()[0] == 1


def program(folder, name, body):
    path = folder / name
    path.write_text(f"#!/bin/sh\n{body}\n")
    path.chmod(0o755)


def test_covariance_model_course(tmp_path, monkeypatch):
    """The steps follow one another with stand-ins for the programs."""
    program(tmp_path, "mafft", 'for x; do last=$x; done; cat "$last"')
    program(tmp_path, "RNAalifold", "printf 'ACGU\\n(..) (-1.50 = -1.00 + -0.50)\\n'")
    program(tmp_path, "cmbuild", 'grep "^#=GC SS_cons" "$2" > "$1"')
    program(tmp_path, "cmalign", 'test -s "$4" && printf "# STOCKHOLM 1.0\\na  AC-\\nb  ACG\\n\\na  GU\\nb  GU\\n#=GC SS_cons (.)..\\n//\\n" > "$3"')
    (tool,) = ALIGNERS["profile_cm_pipeline"]
    monkeypatch.setenv("PATH", "/nowhere")
    assert tool.missing() == ["RNAalifold", "cmalign", "cmbuild", "mafft"]
    monkeypatch.setenv("PATH", f"{tmp_path}{os.pathsep}/bin{os.pathsep}/usr/bin")
    rows, peak = tool.align(">a\nACGU\n>b\nACGGU\n")
    assert rows == [("a", "AC-GU"), ("b", "ACGGU")] and peak > 0
    program(tmp_path, "cmbuild", "echo broken >&2; exit 3")
    with pytest.raises(RuntimeError, match="exit code 3: broken"):
        tool.align(">a\nACGU\n>b\nACGGU\n")
    slow = Aligner("slow", (Step(("sleep", "5"), timeout=0.2),))
    with pytest.raises(RuntimeError, match="stopped"):
        slow.align(">a\nA\n")


def test_structure_output(spark, tmp_path):
    (tmp_path / "alifold").mkdir()
    (tmp_path / "single").mkdir()
    (tmp_path / "score").mkdir()
    write(tmp_path / "alifold" / "d1.txt", "ACGU\n(..) (-1.50 = -1.00 + -0.50)\n")
    write(tmp_path / "alifold" / "d2.txt", "nothing\n")
    write(tmp_path / "single" / "d1.txt", ">a\nACGU\n(..) ( -1.00)\n>b\nACGU\n(..) (-3.00)\n")
    write(tmp_path / "single" / "d2.txt", "")
    write(tmp_path / "score" / "d1.score_ascii", "T-COFFEE\nSCORE=987\n*\n")
    both = structures.read_consensus(spark, f"file://{tmp_path}/alifold").join(structures.read_single_energies(spark, f"file://{tmp_path}/single"), "dataset", "left")
    got = {r["dataset"]: r for r in both.withColumn("sci", conservation_index(F.col("consensus_mfe"), F.col("mean_single_mfe"))).collect()}
    assert (got["d1"]["dbn"], got["d1"]["consensus_mfe"], got["d1"]["mean_single_mfe"], got["d1"]["sci"]) == ("(..)", -1.5, -2.0, 0.75)
    assert (got["d2"]["dbn"], got["d2"]["consensus_mfe"], got["d2"]["sci"]) == (None, None, 0.0)
    assert [tuple(r) for r in structures.read_scores(spark, f"file://{tmp_path}/score").collect()] == [("d1", 987.0)]
    cases = [(-1.0, 0.0, 1.0), (0.0, 0.0, 0.0), (0.0, -2.0, 0.0), (None, -2.0, 0.0), (-3.0, -2.0, 1.5)]
    rows = spark.createDataFrame(cases, "c double, m double, want double").withColumn("sci", conservation_index(F.col("c"), F.col("m")))
    assert all(r["sci"] == r["want"] for r in rows.collect())
