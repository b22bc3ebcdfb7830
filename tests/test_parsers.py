"""Parsers and small functions that no registered query calls, on hand-made rows."""

import json

from pyspark.sql import functions as F

from helixspark.functions import identifiers as I
from helixspark.functions import sequences as Q
from helixspark.operators import annotation as A
from helixspark.operators import filters as P
from helixspark.operators import scoring as R
from helixspark.operators import summaries as U
from helixspark.sources import clinical as C


def texts(spark, *objects):
    return spark.createDataFrame([(json.dumps(o),) for o in objects], "json string")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_score_tables(spark, tmp_path):
    raw = spark.createDataFrame([("chr1", "5", "a", "t", "0.2"), ("1", "5", "A", "T", "0.9"), ("1", "6", "AC", "T", "0.5"), ("M", "x", "A", "T", "1"), ("2", "7", "A", "G", ".")], "chrom string, pos string, ref string, alt string, s string")
    assert rows(C.locus_scores(raw, "s"), "chrom", "pos", "ref", "alt", "score") == [("1", 5, "A", "T", 0.9)]
    assert rows(C.locus_scores(raw, "s", keep_all=True), "pos", "score") == [(5, 0.9), (6, 0.5)]
    keyed = spark.createDataFrame([("G", "R5H", "0.1"), ("G", "R5H", "0.7"), ("G", None, "0.9")], "gene_symbol string, aa_change string, eve_score string")
    assert rows(C.protein_scores(keyed), "gene_symbol", "aa_change", "eve_score") == [("G", "R5H", 0.7)]
    placed = spark.createDataFrame([("TP53_HUMAN", "12", "R", "H", "1.5"), ("TP53_HUMAN", "13.0", "K", "E", None)], "mutations_protein_name string, position string, wt_aa string, mt_aa string, EVE_scores_ASM string")
    assert rows(C.protein_scores(placed), "gene_symbol", "aa_change", "eve_score") == [("TP53", "R12H", 1.0)]
    (tmp_path / "t.tsv").write_text("# note\na\tb\n1\t2\n3\n4\t5\n")
    assert rows(C.delimited(spark, str(tmp_path / "t.tsv"), comment="#"), "a", "b") == [("1", "2"), ("4", "5")]


def test_locus_and_association_texts(spark):
    changes = spark.createDataFrame([("1", "g.10A>T", None, ["functionAffected"]), ("2", None, "g.7C>G", ["functionNotAffected"]), ("3", None, None, ["functionAffected"]), ("4", "g.5A>C", None, ["other"])], "chrom string, hg38 string, hg19 string, effects array<string>")
    got = rows(C.labelled_changes(changes), "chrom", "pos", "ref", "alt", "build")
    assert got == [("1", 10, "A", "T", "hg38"), ("2", 7, "C", "G", "hg19")]
    eqtl = texts(spark, {"data": [{"variantId": "chr1_100_A_T_b38", "pValue": 1e-5, "nes": -0.4, "geneSymbol": "G"}, {"variantId": "bad", "pValue": 0.5, "nes": 1.0, "geneSymbol": "G"}]})
    assert [(p, g, round(x, 6)) for p, g, x in rows(C.eqtls(eqtl), "pos", "gene_symbol", "neg_log10_p")] == [(100, "G", 5.0)]
    nested = texts(spark, {"variantId": "1_5_A_T", "credibleSets": [{"studyId": "S", "l2g": [{"gene": "G", "score": 0.5}, {"gene": "H", "score": 0.1}]}, {"studyId": "T", "l2g": []}]})
    assert rows(C.gene_predictions(nested), "variant_id", "study", "gene", "score") == [("1_5_A_T", "S", "G", 0.5), ("1_5_A_T", "S", "H", 0.1), ("1_5_A_T", "T", None, None)]
    hits = texts(spark, {"hits": [{"id": "M1", "consequence": [{"gene": "G", "term": "missense", "aaChange": "R5H"}, {"gene": "H", "term": "x", "aaChange": "y"}]}, {"id": "M2", "consequence": []}]})
    assert rows(C.somatic(hits), "mutation_id", "gene_symbol", "consequence", "aa_change") == [("M1", "G", "missense", "R5H"), ("M2", None, None, None)]
    elements = texts(spark, {"elements": [{"chrom": "chr2", "start": 10, "len": 150, "group": "PLS", "zscore": 2.5}]})
    assert rows(C.regulatory_elements(elements), "chrom", "lo", "hi", "kind", "z") == [("2", 10, 160, "PLS", 2.5)]
    info = texts(spark, {"variantId": "v", "rsIds": ["rs1", "rs2"], "alleleFrequencies": [{"populationName": "AFR", "alleleFrequency": 0.2}]})
    assert rows(C.variant_info(info, ["AFR", "EUR"]), "variant_id", "rs_ids", "af_afr", "af_eur") == [("v", "rs1,rs2", 0.2, None)]


def test_release_rows_and_labels(spark):
    vcf = spark.createDataFrame([("7", "A", "T,C", "AF=0.1;MC=SO:0001583|missense_variant,SO:1|intron"), ("8", "A", "G", "AF=1")], "id string, ref string, alt string, info string")
    got = rows(C.vcf_alleles(vcf), "source_id", "alt", "consequence")
    assert got[0] == ("7", "T", "missense_variant") and got[1][:2] == ("8", "G") and not got[1][2]
    sig = spark.createDataFrame([("Pathogenic",), ("Benign",), ("Uncertain significance",), ("odd",), (None,)], "s string")
    assert [r[0] for r in sig.select(C.numeric_significance(F.col("s"))).collect()] == [2, -2, 0, None, None]
    assert [r[0] for r in sig.select(P.exact_label(F.col("s"), ["Pathogenic"], ["Benign"])).collect()] == [1, 0, None, None, None]


def test_fills_caps_and_orders(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, 4.0, None), (3, None, "b"), (4, 10.0, "a")], "id int, x double, c string")
    assert rows(U.median_filled(df, "x"), "id", "x") == [(1, 1.0), (2, 4.0), (3, 4.0), (4, 10.0)]
    assert rows(P.filled(df, {"x": "mean"}, ["c"]), "id", "x", "c") == [(1, 1.0, "a"), (2, 4.0, "__missing__"), (3, 5.0, "b"), (4, 10.0, "a")]
    assert rows(P.filled(df.withColumn("y", F.col("x") * 2), {"x": "median", "y": "median"}, []), "id", "x", "y")[2] == (3, 4.0, 8.0)
    assert P.filled(df, {}, ["c"]).where("c = '__missing__'").count() == 1 and P.filled(df.limit(0), {"x": "median"}, []).count() == 0
    many = spark.range(20_000)
    few = P.capped(many, 2000, F.col("id"))
    assert 1700 < few.count() < 2300 and rows(few, "id") == rows(P.capped(many, 2000, F.col("id")), "id") and P.capped(df, 10, F.col("id")).count() == 4
    status = spark.createDataFrame([("ok",), ("bad",), (None,)], "s string")
    assert tuple(U.outcomes(status, "s").first()) == (3, 1, 2)
    assert [r.id for r in U.sorted_by(many.orderBy(F.rand(3)), "id").collect()] == list(range(20_000))
    ranking = spark.createDataFrame([("a", 0.9), ("b", 0.5), ("c", 0.5), ("d", 0.1)], "feature string, importance double")
    assert rows(R.unexpected_features(ranking, ["a"], 3), "feature", "rank") == [("b", 2), ("c", 3)]


def test_small_expressions(spark):
    df = spark.createDataFrame([("l1", 0.5), ("l2", None), ("l3", None), ("l4", None)], "locus string, allele_freq double")
    tier = lambda *r: spark.createDataFrame(list(r), "locus string, allele_freq double")
    got = rows(A.tiered_frequency(df, [("first", tier(("l1", 0.1), ("l2", 0.2))), ("second", tier(("l2", 0.9), ("l3", 0.3)))]), "locus", "allele_freq", "af_source")
    assert got == [("l1", 0.5, "own"), ("l2", 0.2, "first"), ("l3", 0.3, "second"), ("l4", 0.0, "default")]
    values = spark.createDataFrame([("1.5",), ("nan",), ("inf",), ("x",), (None,)], "s string")
    assert [r[0] for r in values.select(I.safe_float(F.col("s"), -1.0)).collect()] == [1.5, -1.0, -1.0, -1.0, -1.0]
    assert [round(r[0], 6) for r in spark.createDataFrame([(100.0,), (0.0,)], "x double").select(I.safe_log10(F.col("x"))).collect()] == [2.0, -10.0]
    assert [r[0] for r in spark.createDataFrame([(1, 0), (0, 7), (None, 6)], "a int, b int").select(Q.splice_relevant(F.col("a"), F.col("b"))).collect()] == [True, True, False]
    assert [round(r[0], 6) for r in spark.createDataFrame([(0.2, 0.1), (None, 0.1), (0.2, None), (None, None)], "a double, b double").select(I.enrichment(F.col("a"), F.col("b"))).collect()] == [2.0, 0.0, 1000.0, 0.0]
