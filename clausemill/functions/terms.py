"""Tokens of one text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Domain terms that must stay whole.
FORCED_TERMS = ("等待期", "责任免除", "免责条款", "既往症")
# Han by code range; a script test per character would search the Unicode tables.
_HAN = ((0x2E80, 0x2FD5), (0x3005, 0x3005), (0x3007, 0x3007), (0x3021, 0x3029), (0x3038, 0x303B), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAD9), (0x20000, 0x323AF))
HAN = "".join(f"{chr(a)}-{chr(b)}" if a != b else chr(a) for a, b in _HAN)
TOKEN = rf"(?:[^\P{{L}}{HAN}]++|[^\P{{N}}{HAN}]++)+|" + "|".join(FORCED_TERMS) + f"|[{HAN}]"


def tokenize(text: Column) -> Column:
    """Words of alphabetic scripts, the forced terms, and single characters of Han text."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
