"""Rules over all stores and snapshots at once: a row for each snapshot that a rule can judge, and whether it opens.

Snapshots that a rule's gate turns away are absent from its result: they neither open nor resolve anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import availability, price_number
from .baseline import is_matched_loss

SEVERE = ("critical", "error", "disapproved", "severe")
#: Least number and least share of the common pages at which a signal counts, and the versions of comparable samples.
SEO_SIGNALS = {"noindex": (5, 0.05), "canonical_away": (5, 0.05), "schema_missing": (5, 0.10), "http_error": (5, 0.10)}
SAMPLE = {"sample_strategy": "stable_hash_v1", "parser_version": "product_page_parser_v1", "normalization_version": "product_page_normalizer_v1", "schema_version": "schema_valid_enough_v1"}


def source_divergence(matches: DataFrame, checks: DataFrame, pct: float = 0.1, abs_: float = 20) -> DataFrame:
    """(snapshot_id, matched, missing, is_open, severity, confidence): storefront items that the feed lacks.

    matches: snapshot_id, storefront_item_id, feed_item_id (several rows an item: any with a feed item counts).
    checks: snapshot_id, source, status, finished_at. Needs a latest feed check of success, and category checks, all of
    success.
    """
    feed, category = F.col("source") == "feed", F.col("source") == "category"
    gate = checks.groupBy("snapshot_id").agg(
        F.max_by("status", F.when(feed, F.struct("finished_at", "status"))).alias("feed"),
        F.count_if(category).alias("n"), F.count_if(category & (F.col("status") == "success")).alias("good")).where("feed = 'success' and n > 0 and n = good")
    items = matches.where("storefront_item_id is not null").groupBy("snapshot_id", "storefront_item_id").agg(F.max(F.col("feed_item_id").isNotNull()).alias("fed"))
    counts = items.groupBy("snapshot_id").agg(F.count("*").alias("matched"), F.count_if(~F.col("fed")).alias("missing"))
    return counts.join(gate.select("snapshot_id"), "snapshot_id").select(
        "snapshot_id", "matched", "missing", is_matched_loss(F.col("matched"), F.col("missing"), pct, abs_).alias("is_open"), F.lit("warning").alias("severity"), F.lit(0.75).alias("confidence"))


#: The ways of matching that the price rule takes, and its thresholds where an incident names no others.
METHODS = ("offer_id", "normalized_url", "canonical_url")
PRICE_THRESHOLDS = {"minimum_affected_count": 5, "minimum_affected_ratio": 0.2, "minimum_comparable_matches": 20, "price_absolute": 0.02, "price_relative": 0.001}
SIDE = ("url", "title", "price", "currency", "availability")


def match_rows(matches: DataFrame, items: DataFrame, checks: DataFrame) -> DataFrame:
    """Matches that the price rule compares, a row each: snapshot_id, match_method, and SIDE of both items (feed_, shop_).

    matches: snapshot_id, feed_item_id, storefront_item_id, match_method, match_confidence; those without both items, or
    of a confidence below 0.9, are left out, and a product matched twice is two rows. items: item_id and SIDE. checks:
    snapshot_id, source, status; a snapshot needs a feed check and a product_page check of success.
    """
    good = F.col("status") == "success"
    gate = checks.groupBy("snapshot_id").agg(F.bool_or(good & (F.col("source") == "feed")).alias("f"), F.bool_or(good & (F.col("source") == "product_page")).alias("p")).where("f and p").select("snapshot_id")
    side = lambda name, prefix: items.select(F.col("item_id").alias(name), *[F.col(c).alias(f"{prefix}_{c}") for c in SIDE])
    rows = matches.where("match_confidence >= 0.9").join(gate, "snapshot_id", "left_semi")
    return (rows.join(side("feed_item_id", "feed"), "feed_item_id").join(side("storefront_item_id", "shop"), "storefront_item_id")
            .select("snapshot_id", "match_method", *[f"{p}_{c}" for p in ("feed", "shop") for c in SIDE]))


def price_signals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, compared, price_bad, availability_bad, signals, total_affected, affected_count, is_open, severity) of match rows by keys.

    rows: keys, the columns of ``match_rows`` and those of PRICE_THRESHOLDS, alike in all rows of a key (null: the rule's
    own). Prices compare if both are numbers and both have the same currency, upper-cased; availabilities if both are
    known. Every match row counts. A signal needs the least count and its ratio of all rows; total_affected counts the
    distinct pairs of address and title (the shop's, else the feed's) in the signals that do, and opens by the same two
    thresholds.
    """
    own = {n: F.coalesce(F.col(n), F.lit(v)) if n in rows.columns else F.lit(v) for n, v in PRICE_THRESHOLDS.items()}
    # read once, as columns: the conditions below name each several times
    rows = rows.withColumns({"__a": price_number(F.col("feed_price")), "__b": price_number(F.col("shop_price")), "__x": availability(F.col("feed_availability")), "__y": availability(F.col("shop_availability"))})
    a, b, x, y = (F.col(f"__{n}") for n in "abxy")
    one = (F.col("feed_currency") != "") & (F.upper("feed_currency") == F.upper("shop_currency"))
    diff = F.abs(a - b)
    far = (diff >= own["price_absolute"]) & (diff / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) >= own["price_relative"])
    no = F.lit(False)
    text = lambda c: F.coalesce(f"shop_{c}", f"feed_{c}", F.lit(""))
    flagged = rows.select(*keys, *[v.alias(f"t_{n}") for n, v in own.items()], F.coalesce(one & far, no).alias("p"), F.coalesce((x != "unknown") & (y != "unknown") & (x != y), no).alias("v"),
                          F.concat(text("url"), F.lit(":"), text("title")).alias("named"))
    groups = [*keys, *[f"t_{n}" for n in own]]
    # one pass: rows by name first, names that no signal holds as one, so that no name is kept for whole groups
    names = flagged.withColumn("named", F.when(F.col("p") | F.col("v"), F.col("named"))).groupBy(*groups, "named").agg(F.count("*").alias("n"), F.count_if("p").alias("p"), F.count_if("v").alias("v"))
    out = names.groupBy(*groups).agg(F.sum("n").alias("compared"), F.sum("p").alias("price_bad"), F.sum("v").alias("availability_bad"),
                                     F.count_if(F.col("p") > 0).alias("p_names"), F.count_if(F.col("v") > 0).alias("v_names"), F.count("named").alias("names"))
    least, ratio = F.col("t_minimum_affected_count"), F.col("t_minimum_affected_ratio")
    p, v = ((F.col(n) >= least) & (F.col(n) / F.col("compared") >= ratio) for n in ("price_bad", "availability_bad"))
    total = F.coalesce(F.when(p & v, F.col("names")).when(p, F.col("p_names")).when(v, F.col("v_names")), F.lit(0))
    most = F.greatest(F.when(p, F.col("price_bad")).otherwise(0), F.when(v, F.col("availability_bad")).otherwise(0))
    named = F.filter(F.array(F.when(p, "price_mismatch_count"), F.when(v, "availability_mismatch_count")), lambda s: s.isNotNull())
    out = out.withColumns({"signals": named, "total_affected": total, "affected_count": most})
    opens = (F.size("signals") > 0) & (F.col("total_affected") >= least) & (F.col("total_affected") / F.col("compared") >= ratio) & (F.col("compared") >= F.col("t_minimum_comparable_matches"))
    return out.select(*keys, "compared", "price_bad", "availability_bad", "signals", "total_affected", "affected_count", opens.alias("is_open"), F.lit("warning").alias("severity"),
                      (F.col("compared") >= F.col("t_minimum_comparable_matches")).alias("enough"))


def price_availability(matches: DataFrame, items: DataFrame, checks: DataFrame, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """What price_signals gives for each snapshot under the rule's own thresholds and ways of matching."""
    rows = match_rows(matches, items, checks).where(F.col("match_method").isin(*methods))
    return price_signals(rows, ["snapshot_id"])


def comparable_samples(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, fit, previous_id, previous_fit) of snapshots that selected 20 pages or more, with the one before it of its store, hash and versions.

    snapshots: snapshot_id, store_id, finished_at, urls_hash, the versions named in SAMPLE, selected_count,
    comparable_checks, failed_checks. fit: the versions of SAMPLE, a hash, 20 comparable checks and four fifths of all
    checks comparable.
    """
    w = Window.partitionBy("store_id", "urls_hash", *SAMPLE).orderBy("finished_at", "snapshot_id")
    fit = F.col("urls_hash").isNotNull() & (F.col("urls_hash") != "") & (F.col("comparable_checks") >= 20) & (F.col("comparable_checks") >= 0.8 * (F.col("comparable_checks") + F.col("failed_checks")))
    for name, value in SAMPLE.items():
        fit = fit & (F.col(name) == value)
    rows = snapshots.where("selected_count >= 20").withColumn("fit", F.coalesce(fit, F.lit(False)))
    return rows.select("snapshot_id", "fit", F.lag(F.struct("snapshot_id", "fit")).over(w).alias("p")).select("snapshot_id", "fit", F.col("p.snapshot_id").alias("previous_id"), F.col("p.fit").alias("previous_fit"))


def seo_changes(items: DataFrame, pairs: DataFrame, coverage: float = 0.8, common: int = 20) -> DataFrame:
    """What seo_regression returns, for given pairs (snapshot_id, previous_id), each once."""
    sizes = items.groupBy("snapshot_id").agg(F.count("*").alias("size"))
    seen = ("indexability", "canonical_state", "schema_valid", "http_status")
    now = items.select("snapshot_id", "stable_key", *seen).join(pairs, "snapshot_id")
    old = items.select(F.col("snapshot_id").alias("previous_id"), "stable_key", *[F.col(c).alias(f"o_{c}") for c in seen])
    both = now.join(old, ["previous_id", "stable_key"])
    turned = {"noindex": (F.col("indexability") == "noindex") & ~F.col("o_indexability").eqNullSafe("noindex"), "canonical_away": (F.col("o_canonical_state") == "self") & (F.col("canonical_state") == "different"),
              "schema_missing": F.col("o_schema_valid") & ~F.coalesce("schema_valid", F.lit(False)), "http_error": (F.col("http_status") >= 400) & F.col("o_http_status").between(200, 399)}
    got = both.groupBy("snapshot_id", "previous_id").agg(F.count("*").alias("common"), *[F.count_if(t).alias(n) for n, t in turned.items()])
    got = got.join(sizes, "snapshot_id").join(sizes.select(F.col("snapshot_id").alias("previous_id"), F.col("size").alias("o_size")), "previous_id")
    got = got.withColumn("coverage", F.col("common") / F.least("size", "o_size")).where((F.col("common") >= common) & (F.col("coverage") >= coverage))
    counted = {n: (F.col(n) >= k) & (F.col(n) >= share * F.col("common")) for n, (k, share) in SEO_SIGNALS.items()}
    got = got.withColumn("signals", F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in counted.items()]), lambda s: s.isNotNull()))
    return got.select("snapshot_id", "previous_id", "common", "coverage", *SEO_SIGNALS, "signals", F.greatest(*[F.when(c, F.col(n)).otherwise(0) for n, c in counted.items()]).alias("affected"),
                      F.when(F.size("signals") >= 2, 0.70).otherwise(0.55).alias("confidence"), (F.size("signals") > 0).alias("is_open"))


def seo_regression(items: DataFrame, snapshots: DataFrame, coverage: float = 0.8, common: int = 20) -> DataFrame:
    """(snapshot_id, previous_id, common, coverage, a count for each of SEO_SIGNALS, signals, affected, confidence, is_open).

    A snapshot is compared with the one before it in comparable_samples, if both are fit. items: snapshot_id, stable_key
    (once a snapshot), indexability, canonical_state, schema_valid, http_status, each null if unknown. Pairs of too few
    common pages or too little coverage are absent.
    """
    pairs = comparable_samples(snapshots).where("fit and previous_fit").select("snapshot_id", "previous_id")
    return seo_changes(items, pairs, coverage, common)


def feed_health(checks: DataFrame, keys: list[str], order: list[str], failures: int = 2) -> DataFrame:
    """checks with streak (failures in a row up to this check) and action: recover, ignore, open or wait.

    Statuses are success, partial, authentication_failed (opens at once), parse_failed (opens after a success) and
    others, which open at a streak of failures. keys: store and feed address, so a new address starts a new streak.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    fine = F.col("status").isin("success", "partial")
    rows = checks.withColumn("__run", F.sum(F.when(fine, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__before", F.lag("status").over(w))
    run = Window.partitionBy(*keys, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("streak", F.sum(F.when(fine, 0).otherwise(1)).over(run))
    action = (F.when(F.col("status") == "success", "recover").when(F.col("status") == "partial", "ignore").when(F.col("status") == "authentication_failed", "open")
              .when(F.col("status") == "parse_failed", F.when(F.col("__before") == "success", "open").otherwise("wait"))
              .when(F.col("streak") >= failures, "open").otherwise("wait"))
    return rows.withColumn("action", action).drop("__run", "__before")


def merchant_item_issues(products: DataFrame) -> DataFrame:
    """(snapshot_id, products, affected, severity, significant): products (snapshot_id, product, issues: array of structs
    with severity) with an issue; critical if any is severe. Debouncing is lifecycle.two_strikes on significant."""
    bad = F.coalesce(F.size("issues") > 0, F.lit(False))
    severe = F.coalesce(F.exists("issues", lambda i: F.lower(i["severity"]).isin(*SEVERE)), F.lit(False))
    got = products.groupBy("snapshot_id").agg(F.countDistinct("product").alias("products"), F.countDistinct(F.when(bad, F.col("product"))).alias("affected"), F.bool_or(severe).alias("severe"))
    return got.select("snapshot_id", "products", "affected", F.when(F.col("severe"), "critical").otherwise("warning").alias("severity"), (F.col("affected") > 0).alias("significant"))


def issue_codes(products: DataFrame, most: int = 10) -> DataFrame:
    """(snapshot_id, rank, code, issues, products): the most frequent issue codes of each snapshot, then by code as people sort words; issues and affected products.

    products: snapshot_id, product, issues (array of structs with code; null: none). A product is counted once a code.
    """
    each = products.select("snapshot_id", "product", F.explode("issues").alias("i")).groupBy("snapshot_id", F.col("i.code").alias("code"), "product").agg(F.count("*").alias("n"))
    codes = each.groupBy("snapshot_id", "code").agg(F.sum("n").alias("issues"), F.count("*").alias("products"))
    ranked = codes.withColumn("rank", F.row_number().over(Window.partitionBy("snapshot_id").orderBy(F.desc("issues"), F.collate("code", "UNICODE"), "code")))
    return ranked.where(F.col("rank") <= most).select("snapshot_id", "rank", "code", "issues", "products")


def item_issue_evaluations(products: DataFrame, checks: DataFrame) -> DataFrame:
    """(snapshot_id, products, affected, issue_count, critical, warning, severity, codes, evidence, summary, significant, config) of scans that can be judged.

    products: as merchant_item_issues takes them, issues with code too. checks: snapshot_id, status, config (of the scan),
    account_config (of the account as it is now); a snapshot needs exactly one check, of success, and both configurations
    alike. codes are the ten most frequent ones with their counts (snapshots.issue_codes). A product is critical if any
    of its issues is severe.
    """
    gate = checks.groupBy("snapshot_id").agg(F.count("*").alias("n"), F.min(F.struct("status", "config", "account_config")).alias("c")).where("n = 1 and c.status = 'success' and c.config = c.account_config")
    some = products.join(gate.select("snapshot_id"), "snapshot_id", "left_semi")
    severe = F.coalesce(F.exists("issues", lambda i: F.lower(i["severity"]).isin(*SEVERE)), F.lit(False))
    per = some.groupBy("snapshot_id", "product").agg(F.bool_or(severe).alias("severe"), F.sum(F.greatest(F.coalesce(F.size("issues"), F.lit(0)), F.lit(0))).alias("n"))
    got = per.groupBy("snapshot_id").agg(F.count("*").alias("products"), F.count_if(F.col("n") > 0).alias("affected"), F.sum("n").alias("issue_count"), F.count_if("severe").alias("critical"))
    named = issue_codes(some).groupBy("snapshot_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "code", "issues"))), lambda x: F.concat(x["code"], F.lit(" ("), x["issues"].cast("string"), F.lit(")"))).alias("codes"))
    rows = got.join(named, "snapshot_id", "left").join(gate.select("snapshot_id", F.col("c.config").alias("config")), "snapshot_id")
    rows = rows.withColumns({"codes": F.coalesce("codes", F.array().cast("array<string>")), "warning": F.greatest(F.lit(0), F.col("affected") - F.col("critical"))})
    said = lambda c, one, many: F.concat(F.col(c).cast("string"), F.lit(" "), F.when(F.col(c) == 1, one).otherwise(many))
    plural, issues = F.when(F.col("affected") == 1, "product").otherwise("products"), F.when(F.col("issue_count") == 1, "issue").otherwise("issues")
    evidence = F.array(
        F.concat(F.lit("Merchant Center reported "), said("affected", "product", "products"), F.lit(" with item-level issues.")), F.concat(F.lit("Collected "), F.col("issue_count").cast("string"), F.lit(" normalized "), issues, F.lit(" from a complete successful check.")),
        F.concat(F.lit("Products with critical-severity issues: "), F.col("critical").cast("string"), F.lit(".")), F.concat(F.lit("Products with warning-severity issues: "), F.col("warning").cast("string"), F.lit(".")),
        F.when(F.size("codes") > 0, F.concat(F.lit("Most common issue codes: "), F.array_join("codes", ", "), F.lit("."))).otherwise("No normalized issue codes were available."))
    summary = F.concat(F.lit("Merchant Center reports "), F.col("affected").cast("string"), F.lit(" "), plural, F.lit(" with "), F.col("issue_count").cast("string"), F.lit(" item-level "), issues, F.lit("."))
    return rows.select("snapshot_id", "products", "affected", "issue_count", "critical", "warning", F.when(F.col("critical") > 0, "critical").otherwise("warning").alias("severity"), "codes", evidence.alias("evidence"), summary.alias("summary"),
                       (F.col("affected") > 0).alias("significant"), "config")


def recovery_outcome(share: Column, number: Column, pct: float, abs_: float) -> Column:
    """unhealthy beyond both bounds, healthy within both, else not_comparable (no transition)."""
    return F.when((share >= pct) & (number >= abs_), "unhealthy").when((share < pct) & (number < abs_), "healthy").otherwise("not_comparable")
