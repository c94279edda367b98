"""Tables as DataFrames, and SQL snippets that the queries' SQL forms share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

Query = tuple  # (function of (session, folder), SQL or None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sql_key(x: str) -> str:
    """text_key"""
    spaced = rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', ' ', 'g')"
    return sql_trim(rf"regexp_replace({spaced}, '\s+', ' ', 'g')")


def sql_words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def sql_strip(x: str) -> str:
    """strip_html"""
    out = rf"regexp_replace({x}, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g')"
    out = rf"regexp_replace({out}, '(?i)<br\s*/?>', chr(10), 'g')"
    out = rf"regexp_replace({out}, '(?i)</(?:p|div|h[1-6]|li|tr|blockquote|section)>', chr(10) || chr(10), 'g')"
    out = rf"regexp_replace({out}, '<[^>]+>', '', 'g')"
    for name, char in (("&nbsp;", "chr(160)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&apos;", "chr(39)"), ("&copy;", "'©'"), ("&middot;", "'·'"), ("&mdash;", "'—'"), ("&ndash;", "'–'"), ("&hellip;", "'…'"), ("&amp;", "'&'")):
        out = f"replace({out}, '{name}', {char})"
    out = rf"regexp_replace({out}, '[ \t' || chr(160) || ']+', ' ', 'g')"
    out = rf"regexp_replace({out}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return sql_trim(out)
