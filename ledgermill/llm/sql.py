"""DuckDB SQL fragments that the checks share."""

from __future__ import annotations

import string


def lower_ascii(c: str) -> str:
    return f"translate({c}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def blank_words(c: str) -> str:
    return rf"list_filter(string_split_regex({c}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def alnum_words(c: str) -> str:
    return rf"list_filter(string_split_regex({c}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


def crc32(c: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes; the table follows from its polynomial."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    codes = f"list_transform(regexp_extract_all(hex(encode({c})), '..'), lambda x: ('0x' || x)::BIGINT)"
    step = f"xor(c >> 8, ({table})[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {step}), 4294967295)"
