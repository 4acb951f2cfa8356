"""DuckDB text shared by oracles: the CRC-32 that DuckDB lacks."""

# The reversed polynomial and the start and end mask of CRC-32.
POLYNOMIAL, MASK = 3988292384, 4294967295

#: One row (tab): the table of CRC-32, made from its rule.
CRC_TABLE = f"""
    SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {POLYNOMIAL}) ELSE c >> 1 END)) AS tab"""


def crc_of(blob: str) -> str:
    """Unsigned CRC-32 of a blob expression, beside a column ``tab``."""
    octets = f"list_transform(string_split_regex(trim(regexp_replace(hex({blob}), '(..)', '\\1 ', 'g')), ' '), lambda x: ('0x' || x)::BIGINT)"
    return (f"CASE WHEN octet_length({blob}) = 0 THEN 0 ELSE xor(list_reduce(list_prepend({MASK}::BIGINT, {octets}), "
            f"lambda c, o: xor(c >> 8, tab[(xor(c, o) & 255) + 1])), {MASK}) END")
