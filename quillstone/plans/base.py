"""What the queries share."""

from __future__ import annotations


def read(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: SQL of text forms over a column named text.
TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
COLLAPSED = r"trim(regexp_replace({0}, '[\s\x1c-\x1f\x0b\x{{85}}\x{{a0}}]+', ' ', 'g'))"
STRIPPED = r"regexp_replace({0}, '^[\s\x0b\x1c-\x1f]+|[\s\x0b\x1c-\x1f]+$', '', 'g')"


def question(c: str) -> str:
    return COLLAPSED.format(f"regexp_replace({STRIPPED.format(f'lower(coalesce({c}, {chr(39)}{chr(39)}))')}, '[?!.,;:]+$', '')")


def same_question(c: str) -> str:
    inner = COLLAPSED.format(f"coalesce({c}, '')")
    return f"replace(lower({STRIPPED.format(f'regexp_replace({inner}, {chr(39)}' + chr(92) + f'?+${chr(39)}, {chr(39)}{chr(39)})')}), 'ß', 'ss')"
