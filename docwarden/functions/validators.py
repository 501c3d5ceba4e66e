"""Identifier validators as SQL expression text over one string operand."""

from __future__ import annotations


def digits_only(value: str) -> str:
    return f"regexp_replace({value}, '\\\\P{{Nd}}', '')"


def luhn_valid(digits: str) -> str:
    """Mod-10 checksum; every second digit from the right is doubled."""
    doubled = f"try_cast(substring({digits}, -k, 1) AS int) * (1 + (k - 1) % 2)"
    total = (
        f"aggregate(transform(sequence(1, length({digits})), k -> {doubled}), 0, "
        "(acc, d) -> acc + d - IF(d > 9, 9, 0))"
    )
    return f"coalesce({total} % 10 = 0, false)"


def _not_uniform(digits: str) -> str:
    return f"length(replace({digits}, left({digits}, 1), '')) > 0"


def card_valid(value: str) -> str:
    digits = digits_only(value)
    return (
        f"(length({digits}) BETWEEN 13 AND 19 AND {_not_uniform(digits)} AND {luhn_valid(digits)})"
    )


def aadhaar_valid(value: str) -> str:
    digits = digits_only(value)
    return (
        f"(length({digits}) = 12 AND left({digits}, 1) NOT IN ('0', '1') "
        f"AND {_not_uniform(digits)})"
    )
