"""One registered query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from botlens.session import apply_conf

from . import (decontam, hardneg, htmlextract, lexsearch, licenses, linededup, lm, oracles, packing, quality, secretscan,
               simhash, substrings, urlfilter)
from .common import bounded_batches, table


def op1_quality_rules(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"), ["doc_id"])


URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
             ("com/fr/", "allow"), ("com/de/", "block")]


def op2_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, URL_RULES)) + " AS t(key, kind)")
    return urlfilter.judge(pages, rules.unionByName(urlfilter.marked_hosts(pages)), ["page_id"])


def op3_lm_scoring(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"))


def op4_secret_scans(spark, sf_dir):
    found = secretscan.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "novel")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"))


def op5_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return found.select("doc_id", simhash.hex_fp("fp").alias("fingerprint"), "component_id")


def op6_packing(spark, sf_dir):
    return packing.pieces(table(spark, sf_dir, "documents"), length=2048)


def op7_decontamination(spark, sf_dir):
    found = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op8_license_scans(spark, sf_dir):
    """The licence of the best match (ties: the first in the text), its Dice, and all licences found."""
    found = licenses.scan(table(spark, sf_dir, "documents"), lines=False)
    best = F.get(F.sort_array(F.transform("matches", lambda m: F.struct(
        (-m["dice"]).alias("d"), m["first"].alias("first"), m["licence"].alias("licence")))), 0)
    return found.select(
        "doc_id", F.size("matches").cast("long").alias("n_matches"), best["licence"].alias("licence"),
        F.round(-best["d"], 9).alias("dice"),
        F.array_join(F.array_sort(F.array_distinct(F.col("matches.licence"))), ",").alias("licences"))


def op9_html_extraction(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmlextract.main_text(pages).withColumn("n_chars", F.char_length("text").cast("long"))


def op10_substring_dedup(spark, sf_dir):
    found = substrings.dedup(table(spark, sf_dir, "documents"), size=20)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_line_dedup(spark, sf_dir):
    found = linededup.dedup(table(spark, sf_dir, "documents"), least=10, min_chars=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_lexical_search(spark, sf_dir):
    return lexsearch.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(rows.withColumn("label", moved), every=50, positives=5, negatives=3, low=50, high=95, scale=256)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_url_filters": op2_url_filters,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_secret_scans": op4_secret_scans,
    "op5_simhash": op5_simhash,
    "op6_packing": op6_packing,
    "op7_decontamination": op7_decontamination,
    "op8_license_scans": op8_license_scans,
    "op9_html_extraction": op9_html_extraction,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_line_dedup": op11_line_dedup,
    "op12_lexical_search": op12_lexical_search,
    "op13_hard_negatives": op13_hard_negatives,
}


def queries():
    def ready(query):
        def run(spark, sf_dir):
            apply_conf(spark)
            bounded_batches(spark)
            return query(spark, sf_dir)
        return run
    return {name: ready(query) for name, query in QUERIES.items()}


def oracle_sql():
    return {"op1_quality_rules": oracles.quality_sql(),
            "op2_url_filters": oracles.URL_FILTERS,
            "op7_decontamination": oracles.DECONTAMINATION,
            "op10_substring_dedup": oracles.SUBSTRING_DEDUP,
            "op11_line_dedup": oracles.LINE_DEDUP,
            "op12_lexical_search": oracles.LEXICAL_SEARCH,
            "op13_hard_negatives": oracles.HARD_NEGATIVES}
