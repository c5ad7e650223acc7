"""URL filter: host and path rules first, gradient-boosted trees on lexical features for what no rule fits.

DataFrame functions and Spark's own GBTClassifier only; no Python runs on the executors.  Labelled URLs train the trees;
where a caller has no labels, the URLs that a rule fits are labelled by it.  Training takes a bounded sample of at
most twice ``sample_rows`` labelled URLs (``sample_rows`` in expectation), chosen by a hash of the URL; the statistics of
host suffixes are a table of that sample's suffixes, all of them.

A few rules are literals of the plan; a rule list of any length can be given as a table, which is joined.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, with_columns_replaced

#: (verdict, host and path); the longest that fits wins.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
MAX_RULES = 10_000  # as literals of the plan; more are given as a table
FEATURES = ("len_url", "len_host", "len_path", "len_query", "depth", "labels", "digit_ratio", "host_digits", "upper_ratio",
            "hyphens", "entropy", "parameters", "path_digits", "has_fragment", "secure", "suffix_share", "suffix_rate")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    got = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(got, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. Of rules of one length the greater text wins."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules: give more than {MAX_RULES} as a table (rule, verdict)")
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        by_host.setdefault(name, []).append((slash + rest, rule, verdict))
    if not by_host:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    kind = "array<struct<path:string,rule:string,verdict:string>>"
    table = F.create_map(*[x for name, own in by_host.items() for x in (
        F.lit(name), F.array(*[F.struct(F.lit(p).alias("path"), F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for p, r, v in own]).cast(kind))])
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    own = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull()))
    fits = F.filter(own, lambda r: path.startswith(r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return F.when(F.size(fits) > 0, F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def fitting_rules_of_table(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, fit) of the distinct host and path pairs that a rule of the table rules (rule, verdict) fits, as fitting_rule says."""
    cut = F.regexp_extract("rule", r"^([^/]*)", 1)
    table = rules.where(F.col("rule").isNotNull()).select(cut.alias("r_host"), F.expr("substring(rule, length(regexp_extract(rule, '^([^/]*)', 1)) + 1)").alias("r_path"), "rule", "verdict").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tried = pairs.select("host", "path").distinct().withColumn("suffix", F.explode(suffixes))
    fits = tried.join(table, (F.col("suffix") == F.col("r_host")) & F.col("path").startswith(F.col("r_path")))
    best = F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict"))
    return fits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", F.struct("best.rule", "best.verdict").alias("fit"))


def entropy_of(text: Column) -> Column:
    """Shannon entropy of a text's characters in bits; 0 for an empty text."""
    n = F.length(text).cast("double")

    def more(so_far: Column, c: Column) -> Column:
        share = (n - F.length(F.replace(text, c, F.lit("")))) / n
        return so_far - share * F.log2(share)

    return F.when(n > 0, F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), more)).otherwise(0.0)


def parsed(df: DataFrame, url: str = "url") -> DataFrame:
    """df with host and path. Columns of df by these names are replaced, unless one is the URL itself."""
    df = with_columns_replaced(df, [c for c in ("host", "path") if c != url])
    return df.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))


def _count(text: Column, kept: str) -> Column:
    return F.length(text) - F.length(F.translate(text, kept, ""))


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """df (with host and path) and the features that need nothing but the URL, null counting as empty."""
    u, host, path = F.coalesce(F.col(url), F.lit("")), F.col("host"), F.col("path")
    n = F.greatest(F.lit(1), F.length(u)).cast("double")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    digits, upper = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return df.withColumns({
        "len_url": F.length(u), "len_host": F.length(host), "len_path": F.length(path), "len_query": F.length(query),
        "depth": _count(path, "/"), "labels": _count(host, ".") + 1, "digit_ratio": _count(u, digits) / n, "host_digits": _count(host, digits),
        "upper_ratio": _count(u, upper) / n, "hyphens": _count(u, "-_"), "entropy": entropy_of(u),
        "parameters": F.when(F.length(query) > 0, _count(query, "&") + 1).otherwise(0), "path_digits": _count(path, digits),
        "has_fragment": _count(u, "#"), "secure": F.when(u.startswith("https://"), 1).otherwise(0),
        "suffix": F.substring_index(host, ".", -1)})


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """(suffix, suffix_share, suffix_rate): share of the labelled rows and rate of blocks of each host suffix."""
    per = labelled.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("label").alias("bad"))
    whole = labelled.agg(F.count("*").alias("all"))
    return per.join(F.broadcast(whole), F.lit(True)).select("suffix", (F.col("n") / F.col("all")).alias("suffix_share"), ((F.col("bad") + 1) / (F.col("n") + 2)).alias("suffix_rate"))


def with_suffix_statistics(df: DataFrame, table: DataFrame) -> DataFrame:
    """Unseen suffixes have share 0 and rate 0.5. The table has no more rows than the bounded training sample."""
    known = table.withColumnRenamed("suffix", "known_suffix")
    return df.join(F.broadcast(known), F.col("suffix") == F.col("known_suffix"), "left").drop("known_suffix").fillna({"suffix_share": 0.0, "suffix_rate": 0.5})


class UrlModel:
    """Trees and the suffix table they were trained with; without trees a constant verdict."""

    def __init__(self, trees, suffixes, constant: str):
        self.trees, self.suffixes, self.constant = trees, suffixes, constant

    def judged(self, df: DataFrame, url: str = "url") -> DataFrame:
        """df with score (probability of block) from the trees, for rows with host and path."""
        if self.trees is None:
            return df.withColumn("score", F.lit(1.0 if self.constant == "block" else 0.0))
        held = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(url).alias("url"), "host", "path")  # no clash with the features
        rows = with_suffix_statistics(lexical(held), self.suffixes)
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
        from pyspark.ml.functions import vector_to_array

        return self.trees.transform(rows).select("row.*", vector_to_array("probability")[1].alias("score"))


def train(labelled: DataFrame, url: str = "url", label: str = "label", sample_rows: int = 20_000, trees: int = 10, depth: int = 4) -> UrlModel:
    """Fit on a bounded sample of rows (url, label 0/1). Null URLs and labels are left out; one class only gives a constant."""
    rows = labelled.where(F.col(url).isNotNull() & F.col(label).isNotNull()).select(F.col(url).alias("url"), F.col(label).cast("double").alias("label"))
    n = rows.count()
    keep = F.pmod(F.xxhash64("url", F.lit(7)), F.lit(1 << 30)) < int(min(1.0, sample_rows / max(n, 1)) * (1 << 30))
    sample = lexical(parsed(rows.where(keep)).orderBy(F.xxhash64("url"), "url", "label").limit(2 * sample_rows)).coalesce(1).persist()
    try:
        classes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
        if len(classes) < 2:
            return UrlModel(None, None, "block" if classes and 1.0 in classes else "allow")
        suffixes = materialise(suffix_statistics(sample), "url-suffixes")
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_suffix_statistics(sample, suffixes))
        model = GBTClassifier(labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, seed=5, maxBins=32).fit(rows)
    finally:
        sample.unpersist()
    return UrlModel(model, suffixes, "allow")


def judge(pages: DataFrame, rules=RULES, model: UrlModel | None = None, url: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict and score (of the trees). Columns of pages by these names are replaced.

    rules: pairs (verdict, rule) or a table (rule, verdict).  Without a model, the trees are trained on the URLs that a rule fits.  Null URLs have an empty host and path, fit no
    rule and are judged by the trees as an empty URL.
    """
    rows = parsed(with_columns_replaced(pages, ["rule", "verdict", "score", "__fit"]), url)
    if isinstance(rules, DataFrame):
        fits = fitting_rules_of_table(rows, rules).select(F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("fit").alias("__fit"))
        rows = rows.join(fits, (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path")), "left").drop("__host", "__path")
    else:
        rows = rows.withColumn("__fit", fitting_rule(F.col("host"), F.col("path"), rules))
    if model is None:
        labelled = rows.where("__fit is not null").select(F.col(url).alias("url"), F.when(F.col("__fit.verdict") == "block", 1.0).otherwise(0.0).alias("label"))
        model = train(labelled)
    judged = model.judged(rows, url)
    by_trees = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return judged.withColumn("rule", F.col("__fit.rule")).withColumn("verdict", F.coalesce("__fit.verdict", by_trees)).drop("__fit")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: host, path, rule and verdict of every url of ``pages``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "score")
