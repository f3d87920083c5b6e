"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, html, packing, rules, simhash, subword, suffix, tiff
from .common import table

QUERIES = {
    "op1_quality_rules": lambda spark, sf_dir: rules.quality_rules(table(spark, sf_dir, "documents")),
    "op2_toxicity": lambda spark, sf_dir: subword.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op3_packing": lambda spark, sf_dir: packing.pack(table(spark, sf_dir, "documents")),
    "op4_bpe": lambda spark, sf_dir: bpe.bpe_digest(table(spark, sf_dir, "documents")),
    "op5_html_extraction": lambda spark, sf_dir: html.extract_pages(table(spark, sf_dir, "pages")),
    "op6_simhash": lambda spark, sf_dir: simhash.near_duplicates(table(spark, sf_dir, "documents")),
    "op7_quality_classifier": lambda spark, sf_dir: subword.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op8_chat_formatting": lambda spark, sf_dir: chat.chat_formatting(table(spark, sf_dir, "conversations")),
    "op9_suffix_dedup": lambda spark, sf_dir: suffix.suffix_digest(table(spark, sf_dir, "documents")),
    "op10_media_tiff": lambda spark, sf_dir: tiff.media_digest(table(spark, sf_dir, "documents")),
}
SQL = {"op1_quality_rules": rules.SQL, "op8_chat_formatting": chat.SQL}
