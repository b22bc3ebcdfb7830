"""Annotation of variants: classes, evidence, multi-value scores, INFO fields, tiered lookups, nearest sites, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Three- to one-letter amino acids.
AMINO_ACIDS = {
    "Ala": "A", "Arg": "R", "Asn": "N", "Asp": "D", "Cys": "C", "Gln": "Q", "Glu": "E", "Gly": "G", "His": "H", "Ile": "I",
    "Leu": "L", "Lys": "K", "Met": "M", "Phe": "F", "Pro": "P", "Ser": "S", "Thr": "T", "Trp": "W", "Tyr": "Y", "Val": "V", "Ter": "*",
}
#: How much a change of class weighs.
FLIP_WEIGHTS = {
    ("Pathogenic", "Benign"): 3.0, ("Pathogenic", "Likely benign"): 2.5, ("Likely pathogenic", "Benign"): 2.5, ("Likely pathogenic", "Likely benign"): 2.0,
    ("Benign", "Pathogenic"): 3.0, ("Benign", "Likely pathogenic"): 2.5, ("Likely benign", "Pathogenic"): 2.5, ("Likely benign", "Likely pathogenic"): 2.0,
    ("Uncertain significance", "Pathogenic"): 1.5, ("Uncertain significance", "Likely pathogenic"): 1.0, ("Uncertain significance", "Benign"): 1.5,
    ("Uncertain significance", "Likely benign"): 1.0, ("Pathogenic", "Uncertain significance"): 1.5, ("Benign", "Uncertain significance"): 1.5,
}
#: Urgency by flip rate (share of the training ids; the first level holds for the weighted impact too) and the weighted
#: impact that asks for retraining.
FLIP_LEVELS = [(0.025, "urgent"), (0.010, "retrain"), (0.005, "monitor")]
IMPACT_RETRAIN = 0.015


def variant_type(ref: Column, alt: Column) -> Column:
    r, a = F.length(ref), F.length(alt)
    return F.when((r == 1) & (a == 1), "SNV").when(r < a, "insertion").when(r > a, "deletion").otherwise("complex")


def frequency_bin(af: Column) -> Column:
    out = F.when(af.isNull(), "unknown")
    for limit, name in ((0.0001, "ultra_rare"), (0.001, "rare"), (0.01, "low_freq"), (0.05, "common")):
        out = out.when(af < limit, name)
    return out.otherwise("very_common")


def five_classes(sig: Column) -> Column:
    """Free text to one of five classes; the first rule that holds decides."""
    s = F.lower(F.coalesce(sig, F.lit("")))
    out = F.when(s.startswith("pathogenic"), "pathogenic").when(s.startswith("benign"), "benign")
    for term, name in (("likely pathogenic", "likely_pathogenic"), ("likely benign", "likely_benign"), ("pathogenic", "pathogenic"), ("benign", "benign")):
        out = out.when(s.contains(term), name)
    return out.otherwise("uncertain")


def chromosome_class(chrom: Column) -> Column:
    return F.when(chrom.isin("X", "Y"), "sex").when(chrom == "MT", "mitochondrial").otherwise("autosome")


def inferred_consequence(ref: Column, alt: Column) -> Column:
    """What the alleles alone tell: a frameshift if one is unknown (?) or one of them is longer than the other's single base, else missense."""
    r, a = F.length(ref), F.length(alt)
    return F.when((ref == "?") | (alt == "?") | ((r > 1) & (a == 1)) | ((r == 1) & (a > 1)), "frameshift_variant").otherwise("missense_variant")


def protein_key(change: Column) -> Column:
    """p.Arg12His as R12H; null if it isn't a substitution of known residues."""
    table = F.create_map(*[F.lit(x) for kv in AMINO_ACIDS.items() for x in kv])
    pattern = r"p\.([A-Z][a-z]{2})(\d+)([A-Z][a-z]{2})"
    part = lambda k: F.regexp_extract(change, pattern, k)
    return F.when(change.rlike(pattern), F.concat(table[part(1)], part(2), table[part(3)]))


def reduced_scores(values: Column, sep: str = ";") -> tuple[Column, Column]:
    """Minimum and maximum of the numbers in a separated list; '.' and other text don't count."""
    numbers = F.filter(F.transform(F.split(values, sep), lambda v: v.try_cast("double")), lambda v: v.isNotNull())
    return F.array_min(numbers), F.array_max(numbers)


def info_field(info: Column, key: str) -> Column:
    """A field of a VCF INFO text; null if absent."""
    return F.try_element_at(F.str_to_map(info, F.lit(";"), F.lit("=")), F.lit(key))


def explode_alleles(df: DataFrame, per_allele: list[str]) -> DataFrame:
    """One row an alternate allele; comma-separated fields are aligned by position, missing ones are null, frequencies clipped to 0..1."""
    one = df.select("*", F.posexplode(F.split("alt", ",")).alias("_at", "_alt"))
    value = lambda c: F.get(F.split(c, ","), F.col("_at")).try_cast("double")
    clipped = {c: F.when(value(c).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value(c)))) for c in per_allele}
    return one.withColumns(clipped | {"alt": F.col("_alt")}).drop("_at", "_alt")


def with_evidence(df: DataFrame) -> DataFrame:
    """Evidence flags from `allele_freq`, `consequence` and a `cadd` and `revel` score, and the two weighted sums."""
    af = F.coalesce("allele_freq", F.lit(0.0))
    flag = lambda c: c.cast("int")
    out = df.withColumns({
        "ba1": flag(af > 0.05), "pm2": flag(af < 1e-6), "pvs1": flag(F.col("consequence").rlike("(?i)stop_gained|frameshift|splice_(donor|acceptor)")),
        "pp3": flag((F.col("cadd") >= 25) | (F.col("revel") >= 0.7)), "bp4": flag((F.col("cadd") < 15) & (F.col("revel") < 0.15)),
    })
    return out.withColumns({"pathogenic_points": F.expr("8 * pvs1 + 2 * pm2 + pp3"), "benign_points": F.expr("8 * ba1 + bp4")})


def tiered_frequency(df: DataFrame, tiers: list[tuple[str, DataFrame]], key: str = "locus", default: float = 0.0) -> DataFrame:
    """The row's own frequency, else that of the first lookup (key, allele_freq) that has one; `af_source` names it."""
    value, source = F.col("allele_freq"), F.when(F.col("allele_freq").isNotNull(), "own")
    for name, table in tiers:
        df = df.join(table.select(key, F.col("allele_freq").alias(f"_{name}")), key, "left")
        source = source.when(F.col(f"_{name}").isNotNull(), name)
        value = F.coalesce(value, F.col(f"_{name}"))
    return df.withColumns({"af_source": source.otherwise("default"), "allele_freq": F.coalesce(value, F.lit(default))}).drop(*[f"_{n}" for n, _ in tiers])


def tiered_by_source(df: DataFrame, tiers: list[str], key: str = "locus", default: float = 0.0) -> DataFrame:
    """tiered_frequency where the tiers are other rows of the same table, by source: one exchange by key, no join of the table to itself."""
    same = Window.partitionBy(key)
    value, source = F.col("allele_freq"), F.when(F.col("allele_freq").isNotNull(), "own")
    found = df.withColumns({f"_{t}": F.max(F.when(F.col("source_db") == t, F.col("allele_freq"))).over(same) for t in tiers})
    for t in tiers:
        source = source.when(F.col(f"_{t}").isNotNull(), t)
        value = F.coalesce(value, F.col(f"_{t}"))
    return found.withColumns({"af_source": source.otherwise("default"), "allele_freq": F.coalesce(value, F.lit(default))}).drop(*[f"_{t}" for t in tiers])


def patched(df: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Values of the patch replace those of rows with its key; `patched` tells which."""
    fix = patch.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    out = df.join(fix, key, "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in columns} | {"patched": F.coalesce("_hit", F.lit(False))}).drop("_hit", *[f"_{c}" for c in columns])


def nearest_site(points: DataFrame, sites: DataFrame, key: str, pos: str, scale: float = 1.0) -> DataFrame:
    """Distance to the nearest site of the same key: the last and the next site in one sorted pass over both tables, no pairs."""
    both = points.withColumn("_site", F.lit(None).cast("long")).unionByName(sites.select(key, pos, F.col(pos).cast("long").alias("_site")).distinct(), allowMissingColumns=True).withColumn("_is", F.col("_site").isNotNull())
    order = Window.partitionBy(key).orderBy(pos)
    upto, onward = order.rangeBetween(Window.unboundedPreceding, 0), order.rangeBetween(0, Window.unboundedFollowing)
    gaps = both.withColumns({"_l": F.max("_site").over(upto), "_r": F.min("_site").over(onward)})
    gap = F.least(F.col(pos) - F.col("_l"), F.col("_r") - F.col(pos))
    return gaps.where("NOT _is").withColumn("distance", F.round(gap * scale, 2)).drop("_site", "_is", "_l", "_r")


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """node, hop: nodes that are reached from the seeds, each with its smallest number of hops; edges (src, dst) go both ways."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    reached = seeds.select("node").distinct().withColumn("hop", F.lit(0))
    for k in range(1, hops + 1):
        step = reached.where(F.col("hop") == k - 1).join(both, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        reached = reached.union(step.join(reached.select("node"), "node", "left_anti").withColumn("hop", F.lit(k)))
    return reached


def flips(old: DataFrame, new: DataFrame, training: DataFrame, on: tuple[str, ...] = ("variant_id",)) -> DataFrame:
    """One row: common and changed ids, changed training ids, and, over all training ids (one each), flip rate, weighted impact, urgency."""
    table = F.create_map(*[x for (a, b), w in FLIP_WEIGHTS.items() for x in (F.lit(f"{a}>{b}"), F.lit(w))])
    ids = training.select("variant_id").distinct()
    both = old.select(*on, F.col("clinical_sig").alias("_old")).join(new.select(*on, F.col("clinical_sig").alias("_new")), list(on))
    both = both.join(ids.withColumn("_train", F.lit(True)), "variant_id", "left")
    changed = F.col("_old") != F.col("_new")
    weight = F.when(changed & F.col("_train"), F.coalesce(table[F.concat_ws(">", "_old", "_new")], F.lit(0.5))).otherwise(0.0)
    one = both.agg(F.count("*").alias("n_common"), F.count_if(changed).alias("n_changed"), F.count_if(changed & F.col("_train")).alias("n_training_changed"), F.coalesce(F.sum(weight), F.lit(0.0)).alias("_w"))
    one = one.crossJoin(F.broadcast(ids.agg(F.greatest(F.count("*"), F.lit(1)).alias("_ids"))))  # one row each
    rate, impact = F.col("n_training_changed") / F.col("_ids"), F.col("_w") / F.col("_ids")
    top = FLIP_LEVELS[0][0]
    urgency = F.when((rate >= top) | (impact >= top), "urgent").when((rate >= FLIP_LEVELS[1][0]) | (impact >= IMPACT_RETRAIN), "retrain").when(rate >= FLIP_LEVELS[2][0], "monitor").otherwise("none")
    return one.select("n_common", "n_changed", "n_training_changed", F.round(rate, 6).alias("flip_rate"), F.round(impact, 6).alias("weighted_impact"), urgency.alias("urgency"))


def membership(ids: DataFrame, sets: dict[str, DataFrame], key: str) -> DataFrame:
    """A boolean a set: whether it has the row's key."""
    for name, s in sets.items():
        ids = ids.join(s.select(key).distinct().withColumn(f"_{name}", F.lit(True)), key, "left").withColumn(f"in_{name}", F.col(f"_{name}").isNotNull()).drop(f"_{name}")
    return ids


def residue_order(df: DataFrame, key: str, order: str, value: str, half: int = 2) -> DataFrame:
    """Centred mean and population variance over 2 * half + 1 rows, and the order class they give."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-half, half)
    out = df.withColumns({"local_mean": F.avg(value).over(w), "local_var": F.var_pop(value).over(w)})
    m, v = F.col("local_mean"), F.col("local_var")
    return out.withColumn("order_class", F.when((m >= 90) & (v < 20), 1).when((m >= 80) & (v < 40), 2).otherwise(0))


def quality_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, n_null, lowest, highest (as text): one pass, then a row a column."""
    one = df.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("null", lambda c: F.count_if(F.col(c).isNull())), ("lo", F.min), ("hi", F.max))])
    row = lambda c: F.struct(F.lit(c).alias("column"), F.col("n"), F.col(f"null_{c}").alias("n_null"), F.col(f"lo_{c}").cast("string").alias("lowest"), F.col(f"hi_{c}").cast("string").alias("highest"))
    return one.select(F.explode(F.array(*map(row, columns))).alias("r")).select("r.*")


#: Words that are never names.
COMMON_WORDS = ["the", "and", "for", "with", "from", "using", "based", "this", "that", "these", "our", "their", "here", "also", "both", "each", "such", "thus"]


def text_relevance(docs: DataFrame, keywords: list[str]) -> DataFrame:
    """`presence_score`: the share of a quarter of the keywords that occur in title or abstract; `frequency_score`: 0.1 an occurrence, 0.3 of
    keywords that the title has; both at most 1."""
    low = docs.withColumns({"_t": F.lower("title"), "_text": F.lower(F.concat_ws(" ", "title", "abstract"))})
    words = [w.lower() for w in keywords]
    count = lambda w: (F.length("_text") - F.length(F.replace("_text", F.lit(w), F.lit("")))) / len(w)
    present = sum((F.contains("_text", F.lit(w)).cast("int") for w in words), F.lit(0))
    weighted = sum((count(w) * F.when(F.contains("_t", F.lit(w)), 0.3).otherwise(0.1) for w in words), F.lit(0.0))
    presence = F.least(F.lit(1.0), F.col("n_keywords") / max(len(words) * 0.25, 1))
    return low.withColumns({"n_keywords": present, "frequency_score": F.round(F.least(F.lit(1.0), weighted), 4)}).withColumn("presence_score", F.round(presence, 4)).drop("_t", "_text")


def name_candidates(docs: DataFrame, pattern: str, known: list[str], least: int = 3, most: int = 60) -> DataFrame:
    """doc_id and name: what the pattern's first group finds in title and abstract, unless known, a common word, too short or too long."""
    found = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.concat_ws(". ", "title", "abstract"), F.lit("(?i)" + pattern), 1))).alias("name"))
    return found.where(F.length("name").between(least, most) & ~F.lower("name").isin(*[k.lower() for k in known], *COMMON_WORDS) & ~F.col("name").rlike("^[0-9]+$"))
