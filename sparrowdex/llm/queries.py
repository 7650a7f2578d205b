"""The subpackage's driver queries, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from sparrowdex.llm import chat, decontaminate, html_extract, lexical_search, license_scan, packing, quality_rules, sharding, simhash, token_alignment, token_files, url_filter, warc


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict:
    def over(f, *names):
        return lambda spark, sf_dir: f(spark, *(table(spark, sf_dir, n) for n in names))

    return {
        "op1_license_scan": over(license_scan.op1, "documents"),
        "op2_decontaminate": over(decontaminate.op2, "documents", "benchmark"),
        "op3_best_fit_packing": over(packing.op3, "documents"),
        "op4_sharding": over(sharding.op4, "documents"),
        "op5_quality_rules": over(quality_rules.op5, "documents", "labels"),
        "op6_html_extraction": over(html_extract.op6, "pages"),
        "op7_url_filter": over(url_filter.op7, "pages"),
        "op8_chat_format": over(chat.op8, "conversations"),
        "op9_simhash": over(simhash.op9, "documents"),
        "op10_warc": over(warc.op10, "pages"),
        "op11_token_alignment": over(token_alignment.op11, "documents"),
        "op12_ranked_search": over(lexical_search.op12, "documents", "benchmark"),
        "op13_token_files": over(token_files.op13, "documents"),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_scan.op1_sql(), "op4_sharding": sharding.OP4_SQL, "op7_url_filter": url_filter.OP7_SQL, "op8_chat_format": chat.OP8_SQL, "op10_warc": warc.OP10_SQL, "op12_ranked_search": lexical_search.OP12_SQL}
